"""Chat formatting from event logs: fold events into messages, then render them with a loss mask.

A log row is an event (conv_id, seq, turn, kind, role, text). Within a
conversation the events are folded in the order of ``seq``:

* ``message``: a complete message at its turn;
* ``delta``: text appended to what the turn holds last, or a new message;
* ``edit``: replaces all that its turn held before;
* ``regenerate``: drops all that its own and later turns held before, and
  opens a new message (its text, if any, and the deltas that follow).

The fold is made of window functions over conversation and turn. Messages are
rendered in the order of turns; a conversation is one training example and so
one string, which is why its rows meet in one task in the end. Everything is
partitioned by conversation once; there is one shuffle.

The template writes ``<|im_start|>role``, a line feed, the text and
``<|im_end|>`` with a line feed. Control strings (``CONTROLS``) inside texts and
roles lose their first character to a numeric entity, and ``&`` becomes
``&amp;``, so rendering can be undone exactly.

Defined cases: null text and null role are empty. Null conv_id is one
conversation of its own; null turn and null seq come first. Repeated message
rows are messages of their own; ties in ``seq`` go by kind, role and text. A
``regenerate`` without text and deltas leaves no message. An empty log gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ENTITY = {"<": "&#60;", "[": "&#91;", "\n": "&#10;"}
LOSS_ROLES = ("assistant",)


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in [*CONTROLS, *(["\n"] if role else [])]:
        out = F.replace(out, F.lit(control), F.lit(ENTITY[control[0]] + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    for raw, entity in ENTITY.items():
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, slot, role, text) of an event log."""
    opens = F.col("kind").isin("message", "edit", "regenerate")
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, 0)
    whole_turn = Window.partitionBy("conv_id", "turn")
    up_to_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    edit, restart = F.col("kind") == "edit", F.when(F.col("kind") == "regenerate", F.col("seq"))
    alive = (F.col("_edits") == F.col("_all_edits")) & F.coalesce(F.col("seq") >= F.col("_restart"), F.col("_restart").isNull())
    marked = log.select("conv_id", "seq", "turn", "kind", "role", "text").withColumns({
        "_slot": F.sum(opens.cast("int")).over(so_far),
        "_at": F.row_number().over(in_turn),
        "_edits": F.sum(edit.cast("int")).over(so_far),
        "_all_edits": F.sum(edit.cast("int")).over(whole_turn),
        "_restart": F.max(restart).over(up_to_turn),
    })
    pieces = F.sort_array(F.collect_list(F.struct("_at", "role", "text", "kind")))
    return (
        marked.where(alive).groupBy("conv_id", "turn", F.col("_slot").alias("slot")).agg(pieces.alias("_p"))
        .where(F.exists("_p", lambda x: (x["kind"] != "regenerate") | x["text"].isNotNull()))
        .select(
            "conv_id", "turn", "slot",
            F.coalesce(F.get(F.filter(F.transform("_p", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform("_p", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
        )
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_spans): text of each conversation and the (start, length) code points under the loss."""
    head = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "slot")
    placed = messages.select(
        "conv_id", F.row_number().over(by_turn).alias("_no"), F.concat(head, body, F.lit(END)).alias("_piece"),
        F.length(head).alias("_head"), F.length(body).alias("_body"), F.col("role").isin(*loss_roles).alias("_loss"),
    )
    before = Window.partitionBy("conv_id").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_from", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.col("_head"))
    turns = F.sort_array(F.collect_list(F.struct("_no", "_piece", "_from", "_body", "_loss")))
    return placed.groupBy("conv_id").agg(turns.alias("_t")).select(
        "conv_id", F.array_join(F.transform("_t", lambda x: x["_piece"]), "").alias("formatted"),
        F.transform(
            F.filter("_t", lambda x: x["_loss"]),
            lambda x: F.struct(x["_from"].cast("int").alias("start"), x["_body"].cast("int").alias("length")),
        ).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a rendered conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))  # nothing stands before the first turn
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(
            p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END)
        )).alias("text"),
    ))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log of complete messages."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text"
    )


def digest(rendered: DataFrame) -> DataFrame:
    """What can be read back from each rendered conversation."""
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    read = rendered.select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("_turns"),
        under_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"),
    )
    return read.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), sha(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of all conversations and of conversation -1, whose texts hold control strings."""
    probe = conversations.sparkSession.sql(
        "SELECT CAST(-1 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(render(fold(as_log(rows))))
