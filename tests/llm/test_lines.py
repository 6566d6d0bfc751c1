"""Line dedup, and suffix-array dedup of long texts, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from roomtide.llm import lines, repeats


def brute(rows, run):
    """Later lines by text; a place is (id, text), and texts of one id are told apart by the operator's own order."""
    first, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        parts = (t or "").split("\n")
        gone = [False] * len(parts)
        for s in range(len(parts) - run + 1):
            window = tuple(parts[s:s + run])
            if first.setdefault(window, (i, s)) != (i, s):
                gone[s:s + run] = [True] * run
        out[i, t] = (len(parts), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), "\n".join(x for x, g in zip(parts, gone) if not g))
    return Counter((i, *out[i, t]) for i, t in rows)


def test_later_runs_go(spark):
    random.seed(4)
    pool = [f"line {k}" for k in range(12)] + ["", "é"]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(1, 40)))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a\nb"), (104, "a\nb\nc"), (105, "a\nb\nc\n"), (None, "x\na\nb\nc\ny"),
             (106, "same\n" * 30), (107, "q\nr\ns\nt"), (107, "q\nr\ns\nt"), (108, "long " * 20_000 + "\n1\n2")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, key int")
    for run in (1, 2, 3):
        got = Counter(tuple(r) for r in lines.dedup_lines(table, run=run).collect())
        assert got == brute(rows, run)
    assert lines.line_report(table.limit(0)).count() == 0


def test_long_passages_go_on_fewer_lines(spark):
    words = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    long, a, b = words(10, "w"), words(6, "a"), words(4, "b")
    rows = [(1, long), (2, long), (3, f"x\n{a}\n{b}\ny"), (4, f"{a}\n{b}"), (5, f"{b}\nz\n{a}"), (6, f"q\n{long}\nx"), (7, words(9, "w")), (8, words(9, "w"))]
    got = {r.id: (r.n_removed, r.kept) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    whole = dict(rows)
    assert got == {
        1: (0, long), 2: (1, ""), 3: (0, whole[3]), 4: (2, ""), 5: (0, whole[5]), 6: (1, "q\nx"), 7: (0, whole[7]), 8: (0, whole[8])
    }


@pytest.mark.parametrize("hot", [0, 1024])
def test_long_text_is_cut_at_all_its_places(spark, hot):
    """A long text shares passages with short ones, at differing surroundings; brute force over all windows."""
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choices("abcdefgh \n", k=n))
    passages = [letters(260) for _ in range(4)]
    long = "".join(letters(9000) + passages[i % 4][i % 7:] for i in range(16))
    texts = [long, *(letters(150) + p + letters(150) for p in passages), letters(400)]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    expected = {}
    for d, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        expected[d] = "".join(c for c, g in zip(t, gone) if not g).encode()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["id"]: bytes(r["kept"]) for r in repeats.strip_repeats(docs, hot=hot).collect()} == expected
    assert expected[1] != texts[1].encode() and expected[5] == texts[5].encode()


def test_anchors_hash_each_text_once(spark, monkeypatch):
    """One pass finds the segments; counting anchors and joining them read what it wrote."""
    seen, segments = spark.sparkContext.accumulator(0), repeats.segments

    def counted(buf, *rest):
        seen.add(len(buf))
        return segments(buf, *rest)

    monkeypatch.setattr(repeats, "segments", counted)
    words = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    texts = [words(60, "w") + " " + words(9 * i, f"x{i}y") for i in range(1, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.n_removed > 200 for r in repeats.strip_repeats(docs).collect())
    assert seen.value == sum(map(len, texts))


def test_suffixes_are_sorted_as_deep_as_asked_and_bounds_found_from_there():
    draw = random.Random(7)
    base = draw.choices(range(2, 40), k=300)
    text = np.array([*base[20:280], 1, *base[:150], *base[140:], 1, *base[100:190], *base[100:190], 0])
    for depth in (1, 2, 7, 40, 200):
        order, *borders = repeats.suffix_array(text, depth)
        head = [tuple(text[i:i + depth]) for i in order]
        assert sorted(order) == list(range(len(text))) and head == sorted(head)
        assert borders[-1] <= max(depth // 2, 1)
        assert repeats.short_prefixes(order, *borders, depth).tolist() == [True, *(x != y for x, y in zip(head, head[1:]))]


def test_windows_of_hot_anchors_are_rows_only_where_runs_leave_them_open(spark, monkeypatch):
    """One passage in ever different surroundings, cut at many places; brute force over all windows."""
    draw = random.Random(11)
    letters = lambda n: "".join(draw.choices("abcdefgh \n", k=n))
    passage = letters(500)
    texts = [letters(90) + passage[draw.randrange(0, 200):draw.randrange(260, 500)] + letters(300) for _ in range(40)]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    expected = Counter()
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        expected["".join(c for c, g in zip(t, gone) if not g).encode()] += 1
    docs, kept = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), []
    frame = type(docs)
    arrow = frame.mapInArrow

    def noted(self, f, *rest):
        out = arrow(self, f, *rest)
        if f.__name__ == "windows":
            kept.append((self, out := repeats.durable(out)))
        return out

    monkeypatch.setattr(frame, "mapInArrow", noted)
    assert Counter(bytes(r["kept"]) for r in repeats.strip_repeats(docs, hot=0).collect()) == expected
    (segments, rows), = kept
    windows = segments.selectExpr("sum(octet_length(bytes) - 199)").first()[0]
    assert 0 < rows.count() < windows / 2
