"""Document quality from a linear-chain conditional random field over lines.

Every line with a visible character is labelled good or bad. Its features are counts of its own
characters and words, and the same numbers of the line before and the line behind; a transition
weight ties neighbouring labels. The forward-backward marginals of the good label, weighted by
the lines' lengths, average to the score of the document.

The field is fitted on the driver to a documented, bounded sample: the labelled documents that
come first in the order of a hash of doc_id, at most ``MOST_DOCS`` of them and none of more than
``MOST_LINES`` lines; the lines of a document carry its label. Scores read nothing but texts, in
whole, whatever their length. Each task gets the weights and a table of character classes.
``digest`` and ``keep_good`` store what they find, while texts reach Python by bytes, not by rows.

Defined results: a NULL, empty or blank text scores 0; labels other than 0 and 1 or NULL are
ignored, and of several labels of a document the lowest counts; without labels of both kinds
every text with a visible character scores 1. Result columns replace input columns of the same
name; all other columns are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common
from chaintally.session import stored

common.travels(__name__)

MOST_DOCS = 4000
MOST_LINES = 400
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
#: Characters looked at together, and of the texts scored together.
TOGETHER = 1_000_000
CLASSES = ("other", "lower", "upper", "letter", "digit", "space", "end", "shout", "symbol", "bar", "break")
OWN = 14


def character_classes():
    """The class of every code point."""
    kinds = {"Ll": 1, "Lu": 2, "Lt": 2, "Lo": 3, "Lm": 3, "Mn": 3, "Mc": 3, "Nd": 4, "Zs": 5}
    table = np.array([kinds.get(unicodedata.category(chr(i)), 0) for i in range(0x110000)], np.int8)
    for text, kind in (("\t\r\x0b\x0c", 5), (".,;:?", 6), ("!", 7), ("#*$%&<>@^~=+\\_{}[]", 8), ("|", 9), ("\n", 10)):
        table[[ord(c) for c in text]] = kind
    return table


def features(text, table):
    """(own features of each visible line, its length in characters)."""
    n = text.count("\n") + 1
    counts, base = np.zeros((n, len(CLASSES))), 0
    for i in range(0, len(text), TOGETHER):
        kinds = table[np.frombuffer(text[i:i + TOGETHER].encode("utf-32-le"), np.uint32)]
        breaks = kinds == 10
        line = np.cumsum(breaks) - breaks
        lines = int(line[-1]) + 1 if len(line) else 0
        counts[base:base + lines] += np.bincount(line * len(CLASSES) + kinds, minlength=lines * len(CLASSES)).reshape(lines, -1)
        base += int(breaks.sum())
    visible = np.flatnonzero(counts[:, [0, 1, 2, 3, 4, 6, 7, 8, 9]].sum(1) > 0)
    words, distinct, seen = np.zeros(n), np.zeros(n), np.zeros(n)
    earlier = set()
    for k, line in enumerate(text.split("\n")):
        of = line.split()
        words[k], distinct[k] = len(of), len(set(of))
        key = hash(line)
        seen[k] = key in earlier
        earlier.add(key)
    c, words, distinct, seen = counts[visible], words[visible], distinct[visible], seen[visible]
    length = c[:, :10].sum(1)
    ink = np.maximum(1, length - c[:, 5])
    letters = c[:, 1] + c[:, 2] + c[:, 3]
    per_word = ink / np.maximum(1, words)
    own = np.stack([
        np.log1p(length) / 5, c[:, 2] / np.maximum(1, letters), letters / ink, c[:, 4] / ink, c[:, 6] / ink,
        np.sqrt(c[:, 7] / ink), np.sqrt(c[:, 8] / ink), np.sqrt(c[:, 9] / ink), c[:, 0] / ink,
        np.minimum(per_word, 40) / 10, distinct / np.maximum(1, words), np.minimum(1, words / 20) * (1 - distinct / np.maximum(1, words)),
        (words < 3) * 1.0, seen], 1)
    return own, length


def neighbours(own, starts):
    """Own features, those of the lines before and behind (zero at a document's ends), and a constant."""
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    ends = starts[1:][starts[1:] > starts[:-1]] - 1
    before[starts[:-1][starts[1:] > starts[:-1]]] = 0
    behind[ends] = 0
    return np.concatenate([own, before, behind, np.ones((len(own), 1))], 1)


def messages(odds, starts, move):
    """Log odds of good against bad from the left (own line included) and from the right."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, last, sizes = starts[:-1][order], starts[1:][order] - 1, sizes[order]
    left, right = odds.copy(), np.zeros_like(odds)
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for t in range(1, len(alive)):
        at = first[:alive[t]] + t
        before = left[at - 1]
        left[at] += np.logaddexp(move[0, 1], move[1, 1] + before) - np.logaddexp(move[0, 0], move[1, 0] + before)
        at = last[:alive[t]] - t
        behind = odds[at + 1] + right[at + 1]
        right[at] = np.logaddexp(move[1, 0], move[1, 1] + behind) - np.logaddexp(move[0, 0], move[0, 1] + behind)
    return left, right


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Field:
    weights: np.ndarray
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def marginals(self, own, starts):
        left, right = messages(neighbours(own, starts) @ self.weights, starts, self.move)
        return sigmoid(left + right)


def fit(samples, rounds=60, decay=1e-3):
    """A field from (own features of the lines, label) pairs; None unless both labels occur."""
    if len({label for _, label in samples}) < 2:
        return None
    starts = np.concatenate([[0], np.cumsum([len(own) for own, _ in samples])])
    x = neighbours(np.concatenate([own for own, _ in samples]), starts)
    y = np.repeat([float(label) for _, label in samples], np.diff(starts))
    each = np.repeat(1 / np.maximum(1, np.diff(starts)), np.diff(starts))  # a long document counts like a short one
    scale = np.diag(np.full(x.shape[1], decay * len(samples)))
    w = np.zeros(x.shape[1])
    for _ in range(8):  # independent lines first, by Newton's method
        p = sigmoid(x @ w)
        w += np.linalg.solve(x.T @ (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]) + scale, x.T @ (each * (y - p)) - scale @ w)
    found = Field(w)
    inner = np.ones(len(x), bool)
    inner[starts[1:][np.diff(starts) > 0] - 1] = False
    at = np.flatnonzero(inner)  # lines that have one behind them
    speed, size, step = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0.03
    for r in range(1, rounds + 1):
        odds = x @ found.weights
        left, right = messages(odds, starts, found.move)
        p = sigmoid(left + right)
        # marginals of label pairs, in logs: left of the first, move, own and right of the second
        pair = np.stack([found.move[i, j] + i * left[at] + j * (odds[at + 1] + right[at + 1]) for i in (0, 1) for j in (0, 1)], 1)
        pair = np.exp(pair - np.logaddexp.reduce(pair, 1, keepdims=True))
        seen = np.stack([(y[at] == i) & (y[at + 1] == j) for i in (0, 1) for j in (0, 1)], 1)
        slope = np.concatenate([x.T @ (each * (y - p)) - decay * len(samples) * found.weights,
                                ((seen - pair) * each[at, None]).sum(0) - decay * len(samples) * found.move.ravel()]) / len(samples)
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        change = step * (speed / (1 - 0.9**r)) / (np.sqrt(size / (1 - 0.99**r)) + 1e-8)
        found = Field(found.weights + change[:-4], found.move + change[-4:].reshape(2, 2))
    return found


def sample(docs, labels, most_docs=MOST_DOCS, most_lines=MOST_LINES):
    """(features, label) pairs of the bounded training sample, held-out documents left out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(
        F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    # an aggregate, unlike a filter, is not moved ahead of the join: lines are counted in labelled texts only
    short = F.when(F.regexp_count("text", F.lit("\n")) < most_lines, F.col("text"))
    table = character_classes()

    def run(batches):
        for batch in batches:
            rows = [features(text, table)[0] for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"], pa.array([x.astype(np.float32).tobytes() for x in rows], pa.binary())], ["doc_id", "quality", "own"])

    # of rows that repeat an id, the least text
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(
        F.min(short).alias("text")).filter("text IS NOT NULL").mapInArrow(run, "doc_id bigint, quality int, own binary")
    with common.short_batches(docs.sparkSession):
        rows = {r["doc_id"]: (np.frombuffer(bytes(r["own"]), np.float32).reshape(-1, OWN).astype(float), r["quality"]) for r in found.toLocalIterator()}
    return [rows[k] for k in sorted(rows) if len(rows[k][0])]


def held_out(column):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def score_texts(texts, found, table):
    """The scores of a list of texts."""
    scores, i = [], 0
    while i < len(texts):
        parts, size = [], 0
        while i + len(parts) < len(texts) and size < TOGETHER:
            text = texts[i + len(parts)] or ""
            parts.append(features(text, table))
            size += len(text)
        starts = np.concatenate([[0], np.cumsum([len(own) for own, _ in parts])])
        own, length = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        good = found.marginals(own, starts) if found else np.ones(len(own))
        total = np.concatenate([[0], np.cumsum(length)])
        part = np.concatenate([[0], np.cumsum(good * length)])
        of = total[starts[1:]] - total[starts[:-1]]
        scores.append(np.clip((part[starts[1:]] - part[starts[:-1]]) / np.maximum(1, of), 0, 1))
        i += len(parts)
    return np.concatenate(scores) if scores else np.empty(0)


def score(docs, labels, **bounds):
    """``docs`` with ``score``, the quality of each whole text from 0 to 1."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((fit(sample(docs, labels, **bounds)), character_classes()))

    def run(batches):
        found, table = sent.value
        for batch in batches:
            yield pa.array(score_texts(batch.to_pylist(), found, table), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("score", F.arrow_udf(run, "double")("text"))


def keep_good(docs, labels, accept=ACCEPT, **bounds):
    """The documents that score at least ``accept``, with their own columns, as a stored table."""
    own = docs.columns
    whole = docs.select(F.struct(*own).alias("__own"), "doc_id", "text")
    kept = score(whole, labels, **bounds).filter(F.col("score") >= accept).select("__own.*")
    with common.short_batches(docs.sparkSession):
        return stored(kept, "quality-kept")


def digest(docs, labels):
    """One row per document: doc_id, held_out, score, predicted."""
    found = score(docs.select("doc_id", "text"), labels).select("doc_id", "score")
    with common.short_batches(docs.sparkSession):
        found = stored(found, "quality-scores")
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
