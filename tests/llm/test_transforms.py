"""Fill-in-the-middle, WARC archives and the filter audit against brute force, on dirty tables."""

import gzip
import hashlib
import random
import re
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roomtide.llm import audit, infill, warc
from roomtide.session import fresh_path, remove


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- fill in the middle -----------------------------------------------------

TEXTS = [
    (1, "one\ntwo\nthree"), (2, ""), (3, None), (4, "\n\n\n"), (5, "a <P> mark\nb\n"), (6, "$1 \\E ${prefix} <\nS>\n<M\n"),
    (7, "é😀\n中\n" * 50), (None, "x\ny"), (8, "no line break"), (8, "no line break"), (9, "\r\n\x0b\n\x85 z\n"),
    (10, "a<S>b"), (11, "x" * 300_000), (12, "l\n" * 200_000),
] + [(i, "\n".join(f"line {j}" for j in range(i % 17))) for i in range(100, 160)]


def infilled(key, text, rate=100, spm=50):
    text, digest = text or "", sha(f"7:{'' if key is None else key}")
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, t, 1, "clash", None) for k, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string, `meta.output` string")


@pytest.mark.parametrize("rate, spm", [(100, 50), (30, 50), (100, 0), (0, 50)])
def test_infill_equals_brute_force(lines, rate, spm):
    done = infill.fill_in_middle(lines, rate=rate, spm=spm)
    expected = sorted((infilled(k, t, rate, spm) for k, t in TEXTS), key=str)
    assert bag(done, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == expected


def test_infill_is_undone(lines):
    done = infill.infill_report(lines)
    assert bag(done, "doc_id", "restored_sha256") == sorted(((k, sha(t or "")) for k, t in TEXTS), key=str)
    assert {r.form for r in done.collect()} == {"plain", "psm", "spm"}


def test_infill_parameters(spark, lines):
    named = lines.select(F.col("doc_id").alias("meta.id"), "text")
    words = infill.fill_in_middle(named, key="meta.id", unit=r"\S*+\s|\S++", marks=("[$", "{\\", "(%"))
    back = words.select(infill.restored(F.col("output"), F.col("form"), ("[$", "{\\", "(%")).alias("t"))
    assert bag(back, "t") == sorted(((t or "",) for _, t in TEXTS), key=str)
    gaps = infill.fill_in_middle(lines.where("doc_id = 1"), unit="t").first()
    assert (gaps.form, gaps.output, gaps.prefix_chars) == ("plain", "one\ntwo\nthree", None)
    assert infill.fill_in_middle(lines.limit(0)).count() == 0
    for marks in [("a", "a", "b"), ("", "a", "b"), ("ab", "bc", "x"), ("abc", "b", "x")]:
        with pytest.raises(ValueError):
            infill.fill_in_middle(lines, marks=marks)
    with pytest.raises(ValueError):
        infill.fill_in_middle(lines.withColumnRenamed("n", "m").withColumnRenamed("doc_id", "n"), key="n")


# --- WARC -------------------------------------------------------------------

LONG = "<p>é😀\r\n\r\nWARC/1.1\r\n</p>" * 20
PAGES = [
    (5, "http://a/x y\r\nEvil: 1", LONG), (3, None, LONG), (9, "http://a/é", LONG), (9, "http://a/é", LONG), (None, "u", LONG),
    (1, "", "short"), (2, "http://b", "short"), (4, "http://c", None), (6, "http://d", ""), (7, "http://e", "y" * 99),
    (8, "http://f", "y" * 99), (10, "http://g", "z" * 100), (11, "http://h", "z" * 100), (12, "http://h", "q" * 3_000_000),
    (None, "n", "w" * 200), (None, "n", "w" * 200), (13, "v", "é" * 50), (14, "v", "é" * 50), (20, "same", "r" * 150), (20, "same", "r" * 150),
]


def warc_rows(pages):
    out = []
    for key, _, html in pages:
        payload = (html or "").encode()
        ids = [k for k, _, h in pages if (h or "") == (html or "") and k is not None]
        later = len(payload) >= 100 and ids and (key is None or key > min(ids))
        out.append((key, len(payload), sha(html or ""), "revisit" if later else "response", min(ids) if later else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, h, "clash", 0) for k, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, `a.long` int").repartition(3)


def test_archives_equal_brute_force(pages):
    assert bag(warc.archive_report(pages), *COLUMNS) == warc_rows(PAGES)


def test_empty_table_has_no_records(spark, pages):
    assert warc.archive_report(pages.limit(0)).count() == 0
    assert warc.archive_report(pages.where("page_id is null and url = 'none'")).count() == 0


def test_large_group_of_copies(spark):
    many = spark.range(3000).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "c" * 400).otherwise(F.repeat(F.col("id").cast("string"), 60)).alias("html")
    )
    got = warc.archive_report(many)
    assert got.where("record_type = 'revisit'").count() == 999
    assert got.where("refers_to = 0").count() == 999


@pytest.fixture(scope="module")
def folder(spark, pages):
    path = fresh_path(spark)
    warc.write_archives(pages, path, archive_bytes=1000)
    yield path
    remove(spark, path)


def test_payloads_come_back(spark, folder):
    rows = [r for r in warc.read_archives(spark, folder).collect() if r.record_type == "response"]
    got = sorted((r.record_id, bytes(r.payload).decode()) for r in rows)
    want = [("" if k is None else str(k), h or "") for (k, _, h), (_, _, _, kind, _) in zip(PAGES, [warc_rows_of(p) for p in PAGES]) if kind == "response"]
    assert got == sorted(want)
    assert all(r.verified and r.error is None for r in rows)
    assert "http://a/x%20y%0D%0AEvil:%201" in {r.target_uri for r in warc.read_archives(spark, folder).collect()}


def warc_rows_of(page):
    return next(r for r in warc_rows(PAGES) if r[0] == page[0] and r[2] == sha(page[2] or ""))


def test_archives_are_plain_gzip_with_one_member_a_record(spark, folder):
    files = list(Path(folder.removeprefix("file:")).glob("part-*"))
    assert len(files) > 3
    total = 0
    for file in files:
        data = file.read_bytes()
        whole = gzip.decompress(data)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(warc.END_MARK)
        starts = [r["offset"] for r in warc.records(data)]
        assert all(data[at:at + 2] == b"\x1f\x8b" for at in starts)
        total += len(starts)
    assert total == len(PAGES)


def archive(*payloads):
    return b"".join(warc.member(warc.record(str(i), "u", p, hashlib.sha256(p).hexdigest(), None, warc.DATE)) for i, p in enumerate(payloads))


def test_damage_is_found():
    random.seed(3)
    noise = bytes(random.randrange(256) for _ in range(200_000))
    whole = archive(b"one", noise, b"three")
    assert [(r["payload"], r["verified"]) for r in warc.records(whole + warc.END_MARK)] == [(b"one", True), (noise, True), (b"three", True)]

    def last(data):
        return list(warc.records(data))[-1]

    assert "inside a member" in last(whole)["error"]  # no end mark
    assert "inside a member" in last(whole[:-30])["error"]
    assert "follow the end mark" in last(whole + warc.END_MARK + b"\0")["error"]
    assert "gzip" in last(b"junk" + whole + warc.END_MARK)["error"]
    record = warc.record("1", "u", b"body of it", sha("body of it"), None, warc.DATE)
    altered = list(warc.records(warc.member(record.replace(b"body of", b"BODY of")) + warc.END_MARK))
    assert [r["verified"] for r in altered] == [False] and "error" not in altered[0]
    for broken in (re.sub(rb"Length: \d+(\r\n\r\nHTTP)", rb"Length: 80\1", record), record[:-2], record + b"x", b"HTTP" + record):
        assert last(warc.member(broken) + warc.END_MARK).get("error")
    longer = re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 9\1\r\n\r\nHTTP", record)
    assert "shorter than its content length" in last(warc.member(longer) + warc.END_MARK)["error"]
    assert list(warc.records(b"")) == []


def test_broken_archive_stops_the_report(spark, folder):
    bad = spark.createDataFrame([(archive(b"one")[:-3],)], "b binary")
    path = fresh_path(spark)
    bad.select(F.col("b").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(path)
    rows = warc.read_archives(spark, path).collect()
    remove(spark, path)
    assert [(r.verified, bool(r.error)) for r in rows] == [(False, True)]


# --- filter audit -----------------------------------------------------------

def fails(doc, docs):
    key, text, _ = doc
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = [k for k, t, _ in docs if (t or "") == text and k is not None]
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": key is not None and key > min(same),
    }


def audited(docs, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    out = []
    for part in {p or "" for _, _, p in docs}:
        rows = [(d, fails(d, docs)) for d in docs if (d[2] or "") == part]
        steps = {}
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total = sum(r[1][f] for r in rows)
                steps["".join(order), step] = (
                    len(left), len(gone), total - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0][0] in good for r in gone), sum(r[0][0] in toxic for r in gone),
                )
        shapley = {f: sum(v[1] for (o, s), v in steps.items() if o[s - 1] == f) for f in "ABCDE"}
        out += [(part, o, s, *v, shapley[o[s - 1]]) for (o, s), v in steps.items()]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    random.seed(7)
    texts = [" ".join(f"w{random.randrange(k)}" for _ in range(n)) for n in (5, 99, 100, 101, 250) for k in (20, 400, 10**6)]
    texts += [t.upper() for t in texts[:8]] + [t + " #1" for t in texts[::2]] + ["", None, " \t\n", "É" * 500, "A b$"]
    docs = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(None, texts[9], "en"), (None, texts[9], "de"), (7, texts[3], "en"), (7, texts[3], "en"), (7, texts[3], "xx"), (1000, "w " * 100_000, "de")]
    labels = [(i, random.randrange(2), random.randrange(2)) for i in range(0, 320, 2)] + [(2, 1, 1), (None, 1, 1), (4, None, None)]
    return docs, labels


def test_audit_equals_brute_force(spark, corpus):
    docs, labels = corpus
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id bigint, text string, lang string, mask int, `a.same` string")
    got = audit.interaction_audit(df.repartition(5), spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, good int"))
    columns = [c.split()[0] for c in audit.REPORT.split(", ")]
    assert bag(got, *columns) == audited(docs, labels)
    assert audit.interaction_audit(df.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_swaps_reach_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), [tuple(range(n))]
        for place in audit.adjacent_swaps(n):
            order[place], order[place + 1] = order[place + 1], order[place]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_diagram_shares_branches_and_swaps_back():
    weights = {m: (m % 3 + 1, 0, 1) for m in range(32)}
    diagram = audit.Diagram(weights, 5, 3)
    before = [(i, n.weight, n.high.weight) for i, n in diagram.path()]
    assert len(diagram.leaves) == 3 and sum(map(len, diagram.levels)) < 31
    diagram.swap(2)
    assert diagram.order == [0, 1, 3, 2, 4]
    diagram.swap(2)
    assert [(i, n.weight, n.high.weight) for i, n in diagram.path()] == before


def test_audit_bounds_the_filters(spark):
    counts = spark.createDataFrame([("p", 1, 2, 0, 0)], "part string, mask int, rows bigint, good bigint, toxic bigint")
    assert [tuple(r)[3:5] for r in audit.audit(counts, "A").collect()] == [(0, 2)]
    for letters in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            audit.audit(counts, letters)
