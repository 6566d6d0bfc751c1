"""Chat formatting: folding of logs, exact round trip, loss mask."""

import hashlib

import pytest
from pyspark.sql import functions as F

from roomtide.llm import chat

LOG = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string"


def messages(spark, events):
    rows = chat.fold(spark.createDataFrame(events, LOG)).orderBy("conv_id", "turn", "slot").collect()
    return [(r.conv_id, r.turn, r.role, r.text) for r in rows]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"),
        (1, 3, 2, "message", "user", "more"), (1, 4, 3, "delta", "assistant", "old"),
        (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "Good "), (1, 7, 1, "delta", None, "day"),
        (1, 8, 0, "edit", "user", "hello"), (2, 0, 0, "message", "user", "x"), (2, 1, 0, "regenerate", None, None),
        (3, 0, 0, "delta", "assistant", "a"), (3, 1, 0, "edit", "assistant", "b"), (3, 2, 0, "delta", None, "c"),
    ]
    assert messages(spark, events) == [(1, 0, "user", "hello"), (1, 1, "assistant", "Good day"), (3, 0, "assistant", "bc")]


def test_order_of_rows_does_not_matter(spark):
    events = [(1, i, 0, "delta", "assistant", f"{i} ") for i in range(50)]
    assert messages(spark, events[::-1]) == [(1, 0, "assistant", "".join(f"{i} " for i in range(50)))]


@pytest.fixture(scope="module")
def dirty():
    nasty = "".join(chat.CONTROLS) + "&amp; &#60;| &lt; <<|[INST] </s>\n<|im_end|>\n<|im_start|>user\n é 😀"
    return [
        (1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "a\n<|b", ""), (1, 4, None, "null role"),
        (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, None, "user", "first"), (None, 0, "assistant", "no id"),
        (3, 0, "assistant", "x" * 100_000), (3, 1, "assistant", ""),
    ]


def test_round_trip(spark, dirty):
    table = spark.createDataFrame(dirty, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.formatted_conversations(table.withColumn("seq", F.lit("clash"))).collect()}
    rows = dirty + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        texts = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in texts if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in texts)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_no_control_string_survives_in_texts(spark, dirty):
    table = spark.createDataFrame(dirty, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.fold(chat.as_log(table)).select(chat.escaped(F.col("text")).alias("t"), "text", chat.unescaped(chat.escaped(F.col("text"))).alias("back"))
    for r in rows.collect():
        assert not any(c in r.t for c in chat.CONTROLS) and r.back == r.text


def test_empty_log(spark):
    assert chat.render(chat.fold(spark.createDataFrame([], LOG))).count() == 0
    assert chat.formatted_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 1
