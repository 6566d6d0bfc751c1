"""Fill-in-the-middle transformation by one regular expression match per document.

A text is tiled by units (lines). ``regexp_count`` gives their number, hashes
of the id choose two of the places between units, and a pattern made for the
row, whose counted groups are possessive, captures prefix, middle and suffix in
one match. Everything is built-in functions; possessive counts are matched in a
loop by the regex engine, so a text of any number of lines needs no deep stack.
"""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from roomtide.llm.common import named

LINES = r"[^\n]*+\n|[^\n]++"
# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = "7"


def chances(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the seed and an id (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none empty, none inside another, no end that begins another."""
    overlap = any(
        a in b or any(a.endswith(b[:n]) for n in range(1, len(b))) for a, b in permutations(marks, 2)
    )
    if len(set(marks)) != 3 or not all(marks) or overlap:
        raise ValueError(f"marks must be three strings that do not overlap: {marks}")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, unit: str = LINES,
    rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``key, n, form, output, prefix_chars, middle_chars`` of every row.

    ``rate`` percent of the texts are cut, and ``spm`` percent of these put the
    suffix first. ``unit`` is a pattern whose matches tile a text without a gap;
    ``n`` is their number. A text is left alone (``plain``, lengths null) if it
    is null or empty, holds one of ``marks``, or is not tiled by ``unit``. Equal
    ids are cut at places chosen by the same chances; a null id counts as an
    empty one. Rows are independent: repeated rows give repeated results, an
    empty table an empty one. Columns other than ``key`` and ``text`` are not
    carried along, so none can clash; ``key`` may not have the name of a result.
    """
    check_marks(marks)
    if key in ("n", "form", "output", "prefix_chars", "middle_chars"):
        raise ValueError(f"the id column has the name of a result: {key}")
    before_prefix, before_suffix, before_middle = marks
    h1, h2, h3, h4 = (F.col("_h")[i] for i in range(4))
    n, body = F.col("n"), F.col("_text")
    rows = docs.select(
        named(key), F.coalesce(named(text), F.lit("")).alias("_text"), F.array(*chances(named(key), seed)).alias("_h")
    ).withColumn("n", F.regexp_count("_text", F.lit(unit)).cast("bigint"))
    first, last = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    left_alone = (body == "") | (h3 % 100 >= rate)
    for mark in marks:
        left_alone = left_alone | body.contains(mark)
    rows = rows.withColumns({
        "_form": F.when(left_alone, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"),
        "_pattern": F.format_string(
            rf"\A(?<prefix>(?:{unit.replace('%', '%%')}){{%d}}+)(?<middle>(?:{unit.replace('%', '%%')}){{%d}}+)"
            r"(?<suffix>[\s\S]*+)", first, last - first,
        ),
    })
    prefix, suffix, middle = (
        re.sub(r"([\\$])", r"\\\1", mark) + f"${{{group}}}" for mark, group in zip(marks, ("prefix", "suffix", "middle"))
    )
    layout = F.when(F.col("_form") == "spm", suffix + prefix + middle).otherwise(prefix + suffix + middle)
    rows = rows.withColumn(
        "output", F.when(F.col("_form") == "plain", body).otherwise(F.regexp_replace(body, F.col("_pattern"), layout))
    )
    out = F.col("output")
    form = F.when(out.contains(before_middle) & (F.col("_form") != "plain"), F.col("_form")).otherwise("plain")
    rows = rows.withColumn("form", form)

    def at(mark: str) -> Column:
        return F.instr(out, mark)

    end_of_prefix = F.when(F.col("form") == "psm", at(before_suffix)).otherwise(at(before_middle))
    cut = F.col("form") != "plain"
    return rows.select(
        named(key), "n", "form", "output",
        F.when(cut, end_of_prefix - at(before_prefix) - len(before_prefix)).cast("bigint").alias("prefix_chars"),
        F.when(cut, F.char_length(out) - at(before_middle) - len(before_middle) + 1).cast("bigint").alias("middle_chars"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form."""
    prefix, suffix, middle = (
        rf"\Q{mark}\E(?<{group}>[\s\S]*?)" for mark, group in zip(marks, ("prefix", "suffix", "middle"))
    )
    whole = F.lit("${prefix}${middle}${suffix}")
    return (
        F.when(form == "psm", F.regexp_replace(output, F.lit(rf"\A{prefix}{suffix}{middle}\z"), whole))
        .when(form == "spm", F.regexp_replace(output, F.lit(rf"\A{suffix}{prefix}{middle}\z"), whole))
        .otherwise(output)
    )


def infill_report(docs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` does to ``doc_id, text``, with digests of the output and of the text read back from it."""
    done = fill_in_middle(docs)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
