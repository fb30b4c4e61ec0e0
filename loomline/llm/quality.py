"""Quality rules on documents and their hosts.

Rules judge every document from its whole text. Each rule's failures are counted by host, and each host's rate is shrunk
by a beta prior of the rule's own, fitted to all hosts' rates. A host loses all its documents if, by its posterior, the
rate of a rule is above the rule's limit with 95 % certainty; so a host of few documents is hardly ever rejected. Host
counts are partial sums, so a host with a third of all rows is no one's burden; verdicts are joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import text as tx
from loomline.session import durable, ship

#: A text with fewer words fails, as does one whose repeated words are more than this share, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: For hosts only: a text fails with more symbols than this share of its words, or more repeated lines than this share of
#: its lines with a word, in percent.
MOST_SYMBOLS, MOST_LINES = 10, 30
#: The rules, and the rate of failing documents up to which a host may go.
LIMITS = {"few_words": 0.75, "repeated_words": 0.5, "symbols": 0.5, "repeated_lines": 0.5}
#: Rates of so many hosts, some 20 MB, go to all executors; those of more are exchanged by host, where adaptive execution
#: splits a host that has very many documents.
FEW_HOSTS = 200_000
#: Standard deviations of the posterior that a host's rate must be above a limit: 95 % of one side.
CERTAIN = 1.645
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _repeated(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys stand more than once with their owner."""
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _again(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys stand earlier with their owner."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    k, o = key[order], owner[order]
    out = np.zeros(len(key), bool)
    out[order[1:][(k[1:] == k[:-1]) & (o[1:] == o[:-1])]] = True
    return out


def measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (those with a word) and n_repeat_words of each text."""
    texts = len(at) - 1
    start, end, first = tx.word_bounds(raw, at)
    words = tx.content_hash(raw, start, end)
    owner = np.repeat(np.arange(texts), np.diff(first))
    heads = np.concatenate([[0], np.cumsum(_HEAD[raw])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])

    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) > 2:
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        key = tx.mix(words[:-2] * tx.PLACES[0] + words[1:-1] * tx.PLACES[1] + words[2:] * tx.PLACES[2])[whole]
        hit = whole[_repeated(key, owner[whole])]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1)
    repeat = (np.cumsum(covered)[: len(words)] > 0).astype(np.int64)

    # Lines that can have a word: from the start of a text or after a line feed within it.
    feed = np.flatnonzero(raw == 10)
    inner = feed[feed + 1 < at[np.searchsorted(at, feed, "right")]] + 1
    begin = np.union1d(at[:-1][np.diff(at) > 0], inner)
    line_owner = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(raw))[: len(begin)], at[line_owner + 1])
    stop = stop - (raw[stop - 1] == 10)
    wordy = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, line_owner = begin[wordy], stop[wordy], line_owner[wordy]
    dup = _again(tx.content_hash(raw, begin, stop), line_owner)

    by_word = lambda x: tx.reduce_at(np.add, x.astype(np.int64), first, 0)
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": by_word(heads[end] - heads[start]),
        "n_symbols": (symbols[at[1:]] - symbols[at[:-1]]).astype(np.int64),
        "n_dup_lines": np.bincount(line_owner[dup], minlength=texts).astype(np.int64),
        "n_lines": np.bincount(line_owner, minlength=texts).astype(np.int64),
        "n_repeat_words": by_word(repeat),
    }


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = (*_NAMES, "n_lines")


def _measure_task(batches):
    """(doc_id, host, text) -> doc_id, host and the measures."""
    for batch, raw, at in tx.blocks(batches, "text"):
        found = measure(raw, at)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(found[n], pa.int64()) for n in _MEASURED]], ["doc_id", "host", *_MEASURED])


def rules() -> dict[str, Column]:
    """Whether a document fails each rule."""
    return {
        "few_words": F.col("n_words") < LEAST_WORDS, "repeated_words": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"), "repeated_lines": 100 * F.col("n_dup_lines") > MOST_LINES * F.col("n_lines")}


def priors(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(host, n and each rule's failed documents) -> each rule's (mean, weight): a beta prior with that mean of all
    documents and the weight of so many. The weight comes from the hosts' spread beyond what their counts explain
    (method of moments), from 1 to a million."""
    p = {r: F.col(r) / F.col("n") for r in names}
    sums = [x for r in names for x in (F.sum(r).alias(f"f_{r}"), F.sum(F.col("n") * p[r] * p[r]).alias(f"s_{r}"))]
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), *sums).first()
    out = {}
    for r in names if total.k else ():
        mean = total[f"f_{r}"] / total.n
        inner = total[f"s_{r}"] - total.n * mean * mean  # weighted squares between hosts
        scale = total.n - total.nn / total.n
        between = (inner - (total.k - 1) * mean * (1 - mean)) / scale if scale > 0 else 0.0
        weight = mean * (1 - mean) / between - 1 if between > 0 else 1e6
        out[r] = mean, min(max(weight, 1.0), 1e6)
    return out


def host_rates(judged: DataFrame, names: list[str]) -> DataFrame:
    """(host, a boolean for each rule) -> host, n, and for each rule `<rule>_rate`, the posterior's mean, and
    `<rule>_least`, what the rate is above with 95 % certainty. No hosts give no rows."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names])
    columns = [F.col("host"), F.col("n")]
    for r, (mean, weight) in (priors(hosts, names) or dict.fromkeys(names, (0.0, 1.0))).items():
        rate = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        spread = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1)))
        columns += [rate.alias(f"{r}_rate"), (rate - CERTAIN * spread).alias(f"{r}_least")]
    return hosts.select(*columns)


def judge(docs: DataFrame, host: str = "source", column: str = "text") -> DataFrame:
    """docs(doc_id, column, host, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, host, host_failed (the rules for which the host is rejected, comma-joined), each rule's shrunk
    rate of the host, and host_rate, the greatest of these.

    A null host is a host of its own that is never rejected and has no rates; null text has no words and fails. Each
    row gives a row, repeated ones and null ids too; no rows give no rows. A very long text is measured as a whole.
    Other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    held, (own, named, text) = tx.positional(docs, "doc_id", host, column)
    rows = held.select(F.col(own).cast("long").alias("doc_id"), F.col(named).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_measure_task, "doc_id long, host string, " + ", ".join(f"{n} long" for n in _MEASURED))
    names = list(LIMITS)
    judged = durable(found.withColumns(rules()), "judged")
    rates = durable(host_rates(judged.filter("host is not null"), names).withColumnRenamed("host", "h"), "rates")
    small = rates.count() <= FEW_HOSTS
    out = judged.join(F.broadcast(rates) if small else rates, F.col("host") == F.col("h"), "left")
    base_failed = F.col("few_words") | F.col("repeated_words")
    rejected = F.concat_ws(",", *[F.when(F.col(f"{r}_least") > limit, F.lit(r)) for r, limit in LIMITS.items()])
    kept = ~base_failed & (rejected == "")
    return out.select(
        "doc_id", *_NAMES, base_failed.alias("base_failed"), kept.alias("kept"), "host", rejected.alias("host_failed"),
        *[F.round(f"{r}_rate", 9).alias(f"{r}_rate") for r in names], F.round(F.greatest(*[f"{r}_rate" for r in names]), 9).alias("host_rate"))
