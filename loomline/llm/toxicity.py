"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams, of words and of their stems.

A bounded, documented sample of labelled rows is fitted in one task; L1 leaves few weights, which go to all executors
with the scoring function. Scoring is one pass without a shuffle. A feature that a text has twice or more counts as
another one too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import text as tx
from loomline.session import durable, ship

BITS = 20
_MASK = (1 << BITS) - 1
#: Bytes of a word's beginning that count as a word of their own, so that its endings share what is learned.
STEMS = (4, 5, 6, 7)
#: Labelled rows that are fitted at most, of label 0 and of label 1: the bound of the sample.
PER_CLASS = (6000, 1500)
#: A feature without meaning gathers gradients like a random walk, so L1 is this times the root of the rows fitted.
EPOCHS, ALPHA, BETA, L1_ROOT, L2 = 3, 0.3, 1.0, 0.5, 1.0
THRESHOLD = 0.3
#: ASCII characters other than letters and digits part words.
_PARTS = np.array([not chr(i).isalnum() if i < 128 else False for i in range(256)])


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, not yet distinct, and the number of the text that each belongs to."""
    start, end, first = tx.word_bounds(raw, at, _PARTS)
    c = tx.prefix(tx.lowered(raw))
    words = tx.spans_hash(c, start, end)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    found, owner = [words], [text]
    for k in STEMS:
        long = end - start > k
        found.append(tx.spans_hash(c, start[long], start[long] + k) ^ tx.PLACES[4])
        owner.append(text[long])
    for gap in (1, 2):
        together = text[gap:] == text[:-gap] if len(words) > gap else np.zeros(0, bool)
        found.append(tx.mix(words[: len(together)] * tx.PLACES[2 * gap - 2] + words[gap:] * tx.PLACES[2 * gap - 1])[together])
        owner.append(text[: len(together)][together])
    return (np.concatenate(found) & np.uint64(_MASK)).astype(np.int64), np.concatenate(owner)


@lru_cache(maxsize=1)
def _again() -> np.ndarray:
    """For each feature the one that says that a text has it twice or more: some stems tell only if several words share
    them."""
    return (tx.mix(np.arange(1 << BITS, dtype=np.uint64) * tx.PLACES[3] + tx.PLACES[0]) & np.uint64(_MASK)).astype(np.int64)


def counted(found: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each text's distinct features, those of repeated ones among them, as text << BITS | feature in order."""
    both, n = np.unique(owner << BITS | found, return_counts=True)
    more = both[n > 1]
    return np.unique(np.concatenate([both, more & ~_MASK | _again()[more & _MASK]]))


def _weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(distinct feature numbers, label) in the order of learning -> weights and bias, for the classes as sampled."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    l1 = L1_ROOT * len(rows) ** 0.5
    for _ in range(EPOCHS):
        for x, y in rows:
            w = _weights(z[x], n[x], l1)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - s * w
            n[x] += g * g
            bias_n += g * g
            bias -= g * 0.1 / (BETA + np.sqrt(bias_n))
    return _weights(z, n, l1), float(bias)


def _fit_task(batches):
    rows = []
    for batch, raw, at in tx.blocks(batches, "text"):
        both = counted(*features(raw, at))
        cut = np.searchsorted(both >> BITS, np.arange(len(batch) + 1))
        marks = zip(batch.column("toxic").to_pylist(), batch.column("learned").to_pylist(), strict=True)
        rows += [((both[cut[i] : cut[i + 1]] & _MASK).astype(np.int32), (order, int(y))) for i, (y, order) in enumerate(marks)]
    rows.sort(key=lambda r: r[1])
    w, bias = fit([(x, y) for x, (_, y) in rows])
    del rows
    tx.trim()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w[at].tolist()], pa.float64())], ["feature", "weight"])


def learn(docs: DataFrame, labels: DataFrame, column: str = "text") -> list[tuple[int, float]]:
    """Weights as (feature, weight), the bias under -1 and under -2 what stands for a text without features: the classes'
    shares alone. Up to PER_CLASS labelled documents of each class are fitted, those
    with the lowest hash of doc_id; documents whose crc32(doc_id) mod 4 is 2 are never among them. Of several texts of a
    doc_id the greatest is fitted, of several labels too. The bias is put right for the classes' shares in all labelled
    documents."""
    ship(docs.sparkSession)
    held, (own, toxic) = tx.positional(labels, "doc_id", "toxic")
    marked = held.select(F.col(own).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("learned", F.xxhash64("doc_id"))
    shares = {int(r["toxic"]): r["count"] for r in marked.groupBy("toxic").count().collect()}
    sample = None
    for y in (0, 1):
        part = marked.filter(F.col("toxic") == y).orderBy("learned", "doc_id").limit(PER_CLASS[y])
        sample = part if sample is None else sample.unionByName(part)
    sample = durable(sample, "labelled")
    rows = tx.slim(docs, column).join(F.broadcast(sample), "doc_id")  # sum(PER_CLASS) rows of the sample at most
    rows = rows.groupBy("doc_id", "toxic", "learned").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    fitted = rows.select("text", "toxic", "learned").repartition(1).mapInArrow(_fit_task, "feature long, weight double").collect()
    weights = {r.feature: r.weight for r in fitted}
    used = {y: min(n, PER_CLASS[y]) for y, n in shares.items() if y in (0, 1)}
    if used.get(0) and used.get(1):
        weights[-1] = weights.get(-1, 0.0) + float(np.log(shares[1] / used[1]) - np.log(shares[0] / used[0]))
        weights[-2] = float(np.log(shares[1]) - np.log(shares[0]))
    return sorted(weights.items())


def _score_task(weights: list[tuple[int, float]], column: str):
    at = np.array([k for k, _ in weights if k >= 0], np.int64)
    values = np.array([v for k, v in weights if k >= 0])
    bias = dict(weights).get(-1, 0.0)
    nothing = dict(weights).get(-2, bias)

    def run(batches):
        table = np.zeros(1 << BITS)
        table[at] = values
        heavy = (table != 0) | (table[_again()] != 0)
        for batch, raw, ends in tx.blocks(batches, column):
            f, owner = features(raw, ends)
            some = heavy[f]
            both = counted(f[some], owner[some])
            total = bias + np.bincount(both >> BITS, table[both & _MASK], len(batch))
            total[np.bincount(owner, minlength=len(batch)) == 0] = nothing
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*batch.schema.names, "score"])

    return run


def _scored(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """docs, its columns named by position, with score."""
    held, (text,) = tx.positional(docs, column)
    held = held.withColumn(text, F.col(text).cast("string"))
    return held.mapInArrow(_score_task(learn(docs, labels, column), text), T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, held_out, score, predicted.

    The score is a probability from the text alone. Null text: as an empty one; a text without words gets the share of
    label 1 among the labelled documents. held_out
    says that crc32 of doc_id as text mod 4 is 2 (null doc_id: false). Each row gives a row, repeated ones too; no rows
    give no rows. A very long text is scored as a whole. Without labels of both classes all scores are the bias' alone.
    Other columns are not read, whatever their names.
    """
    slim = tx.slim(docs, column)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = _scored(slim, labels, "text").toDF("doc_id", "text", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...), all columns as they are and whatever their names, without the rows that are predicted
    toxic. Null and empty texts stay unless THRESHOLD of the labelled documents are toxic; repeated rows stay or go
    together; no rows give no rows."""
    return _scored(docs, labels, column).filter(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)
