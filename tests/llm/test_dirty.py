"""Operators and stages on tables whose other columns have awkward names; license spans against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roomtide.llm import decontaminate, jaccard, language, licenses, mixing, quality, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "node", "meta.x", "size", "copies", "spans", "items", "accepted", "shard", "_doc", "_id", "_text", "part"]
SCHEMA = ", ".join(f"`{c}` {'bigint' if c == 'doc_id' else 'string'}" for c in COLUMNS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "of", "and", "house", "river", "stone")) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    near = prose(1, 200)
    texts = [near, near + " more", prose(2, 80), prose(3, 80), None, "", " ", "x", prose(4, 80), prose(4, 80), "long " * 60_000]
    out = [(i, t, "en" if i % 2 else "de", "a" if i % 3 else None, *["clash"] * 12) for i, t in enumerate(texts)]
    return out + [out[2], (None, prose(5, 50), None, None, *["clash"] * 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("i1", prose(3, 80).split(" ", 5)[5]), ("i2", None), (None, "x")], "item_id string, text string")


def keyed(df):
    return sorted(((r["doc_id"], r["text"], r["meta.x"]) for r in df.collect()), key=str)


def test_stages_keep_columns_and_rows(spark, docs, rows, benchmark):
    every = sorted(((r[0], r[1], "clash") for r in rows), key=str)
    recognised = language.keep_recognised(docs)
    assert recognised.columns == COLUMNS and set(keyed(recognised)) <= set(every)
    assert {r[0] for r in rows if r[1] and r[1].startswith(("the", "of", "and"))} <= {k for k, *_ in keyed(recognised)} | {None}
    one = jaccard.keep_one(docs, shingle=5, threshold=80)
    gone = {1, 9}  # the near copy, and a copy; of the repeated row one is left
    assert one.columns == COLUMNS and [r[0] for r in keyed(one)] == sorted((r[0] for r in rows[:11] + rows[12:] if r[0] not in gone), key=str)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == COLUMNS and {r[0] for r in rows} - {r[0] for r in keyed(clean)} == {3, 7}
    assert keyed(decontaminate.decontaminate(docs, benchmark, part_rows=20)) == keyed(clean)  # several parts
    cut = decontaminate.decontaminate(docs, benchmark, action="remove", part_rows=20)
    assert cut.columns == COLUMNS and cut.count() == len(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == COLUMNS and set(keyed(mixed)) <= set(every)
    placed = sharding.sharded_documents(docs)
    assert set(COLUMNS) < set(placed.columns) and keyed(placed) == every
    for name, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_more_than_two_hundred_languages_are_learned(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in "abcdefgh" * 4), f"l{i:03d}") for i in range(230)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 230
    least = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_bytes=1)
    assert len(least.languages) == 230  # one text each, however small the share


# --- license spans ----------------------------------------------------------

def brute_spans(text):
    """Votes by diagonal, merged and verified as the operator's parameters say."""
    import re
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    entries = [(label, 2, t) for label, t in licenses.PHRASES] + [(label, 5, t) for label, t in licenses.TEMPLATES]
    found = []
    for number, (label, k, template) in enumerate(entries):
        own = template.split()
        runs = {}
        for o in range(len(own) - k + 1):
            runs.setdefault(tuple(own[o:o + k]), []).append(o)
        diagonals = {}
        for at in range(len(words) - k + 1):
            for o in runs.get(tuple(words[at:at + k]), ()):
                votes, first, last = diagonals.get(at - o, (0, at, at))
                diagonals[at - o] = (votes + 1, min(first, at), max(last, at))
        merged = []
        for d, (votes, first, last) in sorted(diagonals.items(), key=lambda x: (x[1][1], x[0])):
            if merged and k == 5 and abs(d - merged[-1][0]) <= licenses.SLACK and first - merged[-1][3] <= licenses.GAP:
                before = merged[-1]
                merged[-1] = (d, before[1] + votes, min(before[2], first), last, max(before[4], last))
            else:
                merged.append((d, votes, first, last, last))
        total = len(own) - k + 1
        for _, votes, first, _, last in merged:
            cover = min(votes / total, 1.0)
            if cover >= (licenses.MIN_COVER if k == 5 else 1.0):
                found.append((label, number, first, last + k - 1, round(cover, 9)))
    return sorted(found)


def test_license_spans_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "MIT License", "mit  LICENSE\nmit-license", "general public general public license license"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):  # words put in, left out, or changed
                at = rng.randrange(len(words))
                words[at:at + rng.randrange(2)] = [rng.choice(("Foo", "the", "license"))] * rng.randrange(3)
            parts += words[rng.randrange(8):] + ["filler"] * rng.randrange(40)
        texts.append(" ".join(parts).title() if rng.random() < 0.3 else ", ".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {}
    for r in licenses.license_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.template, r.first_word, r.last_word, round(r.cover, 9)))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_spans(text), text


def test_license_scan_of_a_long_text_is_linear(spark):
    seconds = {}
    for n in (40_000, 320_000):
        text = "word " * n + licenses.TEMPLATES[0][1]
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        licenses.license_report(df).collect()
        start = time.perf_counter()
        row = licenses.license_report(df).first()
        seconds[n] = time.perf_counter() - start
        assert (row.n_words, row.labels, row.score) == (n + len(licenses.TEMPLATES[0][1].split()), "mit", 1.0)
    assert seconds[320_000] < 8 * seconds[40_000] + 5
