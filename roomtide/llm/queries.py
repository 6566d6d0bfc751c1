"""The operators' queries over the whole test tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomtide.llm import (
    audit, chat, decontaminate, infill, jaccard, language, licenses, lines, mixing, quality, repeats, sharding, warc,
)
from roomtide.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[..., DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[build.__name__] = run
    return build


@query
def op7_benchmark_decontamination(table) -> DataFrame:
    return decontaminate.contamination(table("documents"), table("benchmark"))


ORACLES["op7_benchmark_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), item AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), gram AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM item WHERE len(w) > 0)
), hit AS (
  SELECT doc_id, i, p.n, gram.item_id
  FROM (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM doc, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)) AS p
  JOIN gram ON gram.g = p.g AND gram.n = p.n
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


@query
def op8_language_id(table) -> DataFrame:
    return language.languages(table("documents"))


@query
def op2_source_mix(table) -> DataFrame:
    return mixing.mix_report(table("documents"))


@query
def op4_sharding(table) -> DataFrame:
    return sharding.shard_plan(table("documents"))


@query
def op5_quality_rules(table) -> DataFrame:
    return quality.quality(table("documents"), table("labels"))


@query
def op1_license_scan(table) -> DataFrame:
    return licenses.license_report(table("documents"))


@query
def op6_chat_formatting(table) -> DataFrame:
    return chat.formatted_conversations(table("conversations"))


def _sql_escaped(column: str, role: bool = False) -> str:
    sql = f"replace({column}, '&', '&amp;')"
    for control in [*chat.CONTROLS, *(["\n"] if role else [])]:
        sql = f"replace({sql}, '{control}', '{chat.ENTITY[control[0]]}{control[1:]}')"
    return sql


ORACLES["op6_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START)} + length({_sql_escaped('role', True)}) + 1 + length({_sql_escaped('text')}) + {len(chat.END)})
    AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query
def op10_jaccard_join(table) -> DataFrame:
    return jaccard.jaccard_components(table("documents"))


@query
def op9_suffix_dedup(table) -> DataFrame:
    return repeats.repeat_report(table("documents"))


@query
def op3_line_dedup(table) -> DataFrame:
    return lines.line_report(table("documents"))


@query
def op11_fill_in_middle(table) -> DataFrame:
    return infill.infill_report(table("documents"))


ORACLES["op11_fill_in_middle"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), draw AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM doc
), cut AS (
  SELECT doc_id, n, text, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM draw
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
    array_to_string(u[b + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query
def op12_warc(table) -> DataFrame:
    return warc.archive_report(table("pages"))


ORACLES["op12_warc"] = f"""
WITH page AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), first AS (
  SELECT *, CASE WHEN size >= {warc.REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY digest, size) END AS original FROM page
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > original OR (page_id IS NULL AND original IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original OR (page_id IS NULL AND original IS NOT NULL) THEN original END AS refers_to
FROM first
"""


@query
def op13_filter_audit(table) -> DataFrame:
    return audit.interaction_audit(table("documents"), table("labels"))


ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents
), mask AS (
  SELECT part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM doc
), counted AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM mask GROUP BY part, m
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, step, 1 << (ascii(o[step]) - 65) AS bit,
    coalesce(list_sum([1 << (ascii(c) - 65) for c in string_split(o[1:step - 1], '') if c <> '']), 0) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5
), rows_ AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((m & CAST(before AS BIGINT)) = 0 AND m & bit = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((m & CAST(before AS BIGINT)) = 0 AND m & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER ((m & CAST(before AS BIGINT)) > 0 AND m & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER ((m & CAST(before AS BIGINT)) = 0 AND m & bit > 0), 0) AS good_lost,
    coalesce(sum(t) FILTER ((m & CAST(before AS BIGINT)) = 0 AND m & bit > 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rows_
"""
