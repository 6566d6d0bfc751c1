"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the bag of its byte n-grams (one to four bytes, letters only, with
word borders), each hashed to a row of an embedding table. The mean of the rows
goes through a linear softmax. Table and softmax are learned by stochastic
gradient descent in numpy on at most ``per_language`` different labelled texts of
each language and at most ``sample_bytes`` in all, taken by the hash of the text;
that bound is the only sampling here, and no language is left out. A tenth of them is held back to fit the
softmax temperature and the confidence below which a text is rejected.

Because mean and softmax input are linear, prediction needs only the product of
table and softmax weights: one row of class scores for each n-gram hash.

Defined cases: null text and text without a letter give ``und`` with score 0
and are rejected. Repeated documents get the same answer. Without any labelled
document everything is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomtide.llm.common import LOWER, blocks, byte_set, fresh, named, plainly_named, portable, text_bytes
from roomtide.session import durable

portable(__name__)

UNKNOWN = "und"
PER_LANGUAGE, SAMPLE_BYTES = 400, 256 << 20
BUCKETS, DIMENSION, EPOCHS, RATE = 1 << 15, 16, 6, 0.5
LENGTHS = (1, 2, 3, 4)
ASCII_LETTER = byte_set((0x61, 0x7A))


def plain_letters(buf: np.ndarray) -> np.ndarray:
    """Lower-case letters; every other ASCII byte becomes a blank. Accented capitals of two bytes are lowered, too."""
    out = LOWER[buf]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return np.where(ASCII_LETTER[out] | (out >= 0x80), out, np.uint8(0x20))


def gram_codes(letters: np.ndarray, offsets: np.ndarray, lengths: Sequence[int], buckets: int):
    """For each length: bucket of the n-gram at each byte, and which of them stay within a text and hold a letter."""
    n = len(letters)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    wide = letters.astype(np.uint32)
    code = np.zeros(n, dtype=np.uint32)
    for length in range(1, max(lengths) + 1):
        kept = n - length + 1
        if kept <= 0:
            return
        code = (code[:kept] << np.uint32(8)) | wide[length - 1:]
        if length in lengths:
            usable = (np.arange(length, n + 1) <= doc_end[:kept]) & (code != np.uint32(0x20202020 & ((1 << 8 * length) - 1)))
            z = (code ^ np.uint32(length * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            z = (z ^ (z >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            yield ((z ^ (z >> np.uint32(16))) & np.uint32(buckets - 1)).astype(np.int64), usable


def bags(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text."""
    out = []
    for text in texts:
        buf, offsets = text_bytes(pa.array([text.as_py()], pa.string()))
        letters = plain_letters(buf)
        found = [code[usable] for code, usable in gram_codes(letters, offsets, LENGTHS, buckets)]
        ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        out.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, seed: int = 7):
    """Embedding table times softmax weights, and bias, by plain stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSION, n_classes)).astype(np.float32)
    bias = np.zeros(n_classes, dtype=np.float32)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            ids, share = data[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            mean = share @ table[ids]
            error = softmax(mean @ weights + bias)
            error[labels[k]] -= 1
            to_table = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            # the mean's gradient is spread thinly over many rows, so they move by a larger step
            table[ids] -= (rate * np.float32(20.0)) * share[:, None] * to_table[None, :]
    return table @ weights, bias


def logits(data, scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([share @ scores[ids] + bias for ids, share in data]).reshape(len(data), len(bias))


def calibrate(z: np.ndarray, labels: np.ndarray, keep: float) -> tuple[float, float]:
    """Temperature with the smallest log loss, and the confidence that a share ``keep`` of right answers reaches.

    The bound is set at half the confidence of that quantile: the sample is
    small, and a rejected document is lost.
    """
    if not len(z):
        return 1.0, 0.0
    grid = np.geomspace(1, 20, 40)  # the sample may soften the scores, never sharpen them
    loss = [-np.mean(np.log(softmax(z / t)[np.arange(len(z)), labels] + 1e-12)) for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chance = softmax(z / temperature)
    right = chance.argmax(axis=1) == labels
    if not right.any():
        return temperature, 0.0
    return temperature, float(np.quantile(chance.max(axis=1)[right], 1 - keep)) / 2


class LanguageModel:
    """Languages, class scores of each n-gram bucket, bias, softmax temperature and rejection bound."""

    def __init__(self, languages, scores, bias, temperature, bound):
        self.languages, self.scores, self.bias = languages, scores, bias
        self.temperature, self.bound = temperature, bound


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE,
        sample_bytes: int = SAMPLE_BYTES, keep: float = 0.999) -> LanguageModel:
    """Learn every language from a bounded sample of the rows that have a text and a language.

    A language gives at most ``per_language`` different texts, and no more than
    its share of ``sample_bytes``, but one text at least.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    marked = rows.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")
    )
    first = lambda df, keys: df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
    ).where(F.col("_n") <= per_language)
    # copies have one mark, and the bound counts different texts; the first of each of 64 parts of a language,
    # then of the language: a hot language is no single large task
    texts = marked.select("lang", "mark", F.octet_length("text").cast("bigint").alias("_size")).distinct()
    parted = durable(first(texts.withColumn("_part", F.pmod("mark", F.lit(64))), ["lang", "_part"]))
    share = sample_bytes // max(parted.select("lang").distinct().count(), 1)
    so_far = Window.partitionBy("lang").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    within = first(parted, ["lang"]).withColumn("_bytes", F.sum("_size").over(so_far))
    marks = within.where((F.col("_bytes") <= share) | (F.col("_n") == 1)).groupBy("lang").agg(F.max("mark").alias("last"))
    # one row per language, as many as the model has classes
    chosen = marked.join(F.broadcast(marks), "lang").where(F.col("mark") <= F.col("last")).drop("last")
    sample = chosen.dropDuplicates(["lang", "mark"]).orderBy("mark", "lang").toArrow()
    languages = sorted(set(sample.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([number[x] for x in sample.column("lang").to_pylist()])
    data = bags(sample.column("text").combine_chunks(), BUCKETS)
    held = np.arange(len(data)) % 10 == 9
    scores, bias = train([data[i] for i in np.flatnonzero(~held)], labels[~held], len(languages))
    check = np.flatnonzero(held)
    temperature, bound = calibrate(logits([data[i] for i in check], scores, bias), labels[check], keep)
    return LanguageModel(languages, scores, bias, temperature, bound)


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lowered = LOWER[buf]
    found = np.add.reduceat(np.append(ASCII_LETTER[lowered], False).astype(np.int64), offsets[:-1]) > 0
    found &= np.diff(offsets) > 0
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[d] = any(c.isalpha() for c in buf[offsets[d]:offsets[d + 1]].tobytes().decode("utf-8"))
    return found


def class_sums(letters: np.ndarray, offsets: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed class scores and number of n-grams of each text."""
    docs, classes = len(offsets) - 1, scores.shape[1]
    total, count = np.zeros((docs, classes)), np.zeros(docs)
    for code, usable in gram_codes(letters, offsets, LENGTHS, len(scores) - 1):
        code = np.append(np.where(usable, code, len(scores) - 1), len(scores) - 1)  # the last row is zero
        first = np.minimum(offsets[:-1], len(code) - 1)
        own = (offsets[1:] > offsets[:-1]) & (offsets[:-1] < len(code) - 1)
        ends = np.append(usable, False).astype(np.int64)
        count += np.where(own, np.add.reduceat(ends, first), 0)
        for c in range(classes):
            total[:, c] += np.where(own, np.add.reduceat(scores[:, c][code], first), 0)
    return total, count


def predict(docs: DataFrame, model: LanguageModel, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three more columns: language, calibrated score, accepted."""
    languages, bias, temperature, bound = list(model.languages), model.bias, model.temperature, model.bound
    shared = docs.sparkSession.sparkContext.broadcast(
        np.vstack([model.scores, np.zeros((1, len(languages)))]).astype(np.float32)
    )

    plain, text_at = plainly_named(docs), f"c{docs.columns.index(text_col)}"

    def guess(batches):
        scores = shared.value
        for batch in blocks(batches, text_at):
            buf, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_at)))
            known = has_letter(buf, offsets) if len(languages) else np.zeros(batch.num_rows, dtype=bool)
            best, score = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            if known.any():
                total, count = class_sums(plain_letters(buf), offsets, scores)
                chance = softmax((total / np.maximum(count, 1)[:, None] + bias) / temperature)
                best, score = chance.argmax(axis=1), np.where(known, chance.max(axis=1), 0.0)
            lang = [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known & (score >= bound))],
                names=[*batch.schema.names, "lang", "score", "accepted"],
            )

    schema = plain.select("*", F.lit("x").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema
    for field in schema.fields:
        field.nullable = True
    return plain.mapInArrow(guess, schema).toDF(*docs.columns, *names)


def held_out(doc_id: str) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: predicted language, score and whether the prediction is accepted."""
    model = fit(docs.where(~held_out("doc_id")))
    out = predict(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model, "text",
                  ("lang_pred", "score", "accepted"))
    return out.drop("text")


def keep_recognised(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents whose predicted language is accepted, with their columns."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    names = tuple(fresh(docs, name) for name in ("lang_pred", "score", "accepted"))
    return predict(docs, model, text_col, names).where(F.col(names[2])).select(*[named(c) for c in docs.columns])
