"""Language identification by unigrams over a fixed public vocabulary, all segmentations summed.

Each language has a probability for every piece of the vocabulary. A text's words are scored by
the forward algorithm: the probability of a word is the sum over all ways to cut it into pieces
(characters outside the vocabulary are single pieces of a small fixed probability). Words are
independent, so a text's log probability is the sum over its words; the distinct words of a
batch are scored together in numpy, position by position, and remembered within the task.

The probabilities are fitted by expectation-maximisation on a documented, bounded sample: per
language the words of the training documents that come first in the order of a hash of doc_id,
at most ``MOST_DOCS`` of at most ``MOST_CHARS`` characters; one task per language. Predictions
read nothing but whole texts of any length.

Defined results: a NULL text and one without a letter are `und` with score 0; NULL languages are
never learned; without any training text everything is `und`; equal scores go to the language
that sorts first. Result columns replace input columns of the same name, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from chaintally.llm import common
from chaintally.llm.pieces import PairTable
from chaintally.session import stored

common.travels(__name__)

MOST_DOCS = 300
MOST_CHARS = 20_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
ROUNDS = 4
#: Log probability of a character that the vocabulary lacks, and pseudo-count of each piece.
LOST, ADDED = -16.0, 0.05
#: Letters, and numbers other than decimal digits, which ``has_letter`` tells apart.
LETTER = re.compile(r"[^\W\d_]")
#: Characters of distinct words kept scored by a task, and scored together.
KEPT, TOGETHER = 20_000_000, 400_000
SPACE = "▁"


def has_letter(text):
    """Whether a text holds a character of the Unicode categories L*; number signs such as ½ are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


class Pieces:
    """The vocabulary as a character trie in lookup tables."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        node, piece = {"": 0}, {}
        for k, name in enumerate(names):
            for i in range(1, len(name) + 1):
                node.setdefault(name[:i], len(node))
            piece[node[name]] = k
        moves = [((node[p[:-1]] << 21) | ord(p[-1]), n) for p, n in node.items() if p]
        keys, to = (np.array(x, np.int64) for x in zip(*moves))
        self.next = PairTable(keys, to.astype(np.int32))
        self.piece = np.full(len(node), -1, np.int32)
        self.piece[list(piece)] = list(piece.values())
        self.size = len(names)

    def lattice(self, words):
        """Edges (first position, last position + 1, piece) of all words, positions counted through.

        Word k has the positions ``starts[k]`` to ``starts[k + 1] - 1``, one more than characters.
        A character that is no piece by itself gets an edge of piece -1.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes)) + word  # position of each character
        end = np.repeat(np.cumsum(lengths), lengths)  # characters up to the end of its word
        at, state, step = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found = []
        while len(at):
            state = self.next((state << 21) | codes[at + step]).astype(np.int64)
            alive = state >= 0
            at, state = at[alive], state[alive]
            step += 1
            piece = self.piece[state]
            if step == 1:
                single = np.full(len(codes), -1, np.int32)
                single[at] = piece
                found.append((place, place + 1, single))
            else:
                whole = piece >= 0
                found.append((place[at[whole]], place[at[whole]] + step, piece[whole]))
            more = at + step < end[at]
            at, state = at[more], state[more]
        return starts, *(np.concatenate(x) for x in zip(*found))


def _levels(starts, at):
    """Offsets of positions within their words."""
    return at - starts[np.searchsorted(starts, at, side="right") - 1]


def forward(starts, first, last, weight):
    """Log sums over all paths to each position; ``weight`` has a row per edge, a column per language."""
    total = np.full((starts[-1], weight.shape[1]), -np.inf)
    total[starts[:-1]] = 0
    level = _levels(starts, last)
    order = np.lexsort((last, level))
    first, last, weight, level = first[order], last[order], weight[order], level[order]
    bounds = np.searchsorted(level, np.arange(1, (level[-1] if len(level) else 0) + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        value = total[first[a:b]] + weight[a:b]
        to = np.flatnonzero(np.concatenate([[True], np.diff(last[a:b]) != 0]))
        top = np.maximum.reduceat(value, to)
        spread = np.diff(np.append(to, b - a))
        total[last[a:b][to]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, spread, 0)), to))
    return total


def score_words(pieces, words, logs):
    """The log probability of each word in each language (rows: words)."""
    starts, first, last, piece = pieces.lattice(words)
    weight = np.where((piece >= 0)[:, None], logs[np.maximum(piece, 0)], LOST)
    return forward(starts, first, last, weight)[starts[1:] - 1]


def fit(pieces, words, counts, rounds=ROUNDS):
    """Log probabilities of all pieces by expectation-maximisation over counted words."""
    counts = np.asarray(counts, float)
    groups, size = [[]], 0
    for k, w in enumerate(words):
        size += len(w)
        groups[-1].append(k)
        if size > TOGETHER:
            groups.append([])
            size = 0
    groups = [g for g in groups if g]
    probability = np.full(pieces.size, 1 / pieces.size)
    for _ in range(rounds):
        expected = np.full(pieces.size, ADDED)
        for g in groups:
            starts, first, last, piece = pieces.lattice([words[k] for k in g])
            weight = np.where(piece >= 0, np.log(probability)[np.maximum(piece, 0)], LOST)[:, None]
            ahead = forward(starts, first, last, weight)
            # paths from the right: the same lattice read backwards
            turned = starts[-1] - 1
            behind = forward(turned + 1 - starts[::-1], turned - last, turned - first, weight)[::-1]
            of = np.searchsorted(starts, first, side="right") - 1
            share = np.exp(ahead[first, 0] + weight[:, 0] + behind[last, 0] - ahead[starts[of + 1] - 1, 0])
            known = piece >= 0
            expected += np.bincount(piece[known], (share * counts[g][of])[known], minlength=pieces.size)
        probability = expected / expected.sum()
    return np.log(probability)


def split(text):
    return [SPACE + w for w in text.split()]


class Scorer:
    """Scores texts; remembers words within one task."""

    def __init__(self, pieces, logs):
        self.pieces, self.logs = pieces, logs
        self._forget()

    def _forget(self):
        self.number, self.size, self.rows = {}, 0, np.empty((0, self.logs.shape[1]))

    def _learn(self, words):
        new = score_words(self.pieces, words, self.logs)
        n = len(self.number)
        if n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((len(self.rows) + len(words), self.rows.shape[1]))])
        self.rows[n:n + len(words)] = new
        self.number.update(zip(words, range(n, n + len(words))))
        self.size += sum(map(len, words))

    def score(self, texts):
        """The log probabilities of the texts (rows) in the languages."""
        if self.size > KEPT:
            self._forget()
        out = np.zeros((len(texts), self.logs.shape[1]))
        lines = [split(t) for t in texts]
        new, size = {}, 0
        for words in lines:
            for w in words:
                if w not in self.number and w not in new:
                    new[w] = None
                    size += len(w)
            if size > TOGETHER:
                self._learn(list(new))
                new, size = {}, 0
        if new:
            self._learn(list(new))
        for k, words in enumerate(lines):
            number = self.number
            out[k] = self.rows[[number[w] for w in words]].sum(0)
        return out


def held_out(column):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs, pieces, most_docs=MOST_DOCS, most_chars=MOST_CHARS):
    """(languages in order, log probabilities with a column per language) from the bounded sample."""
    spark = docs.sparkSession
    first = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                        & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = first.select("doc_id", "lang").distinct().withColumn("__place", place).filter(F.col("__place") <= most_docs).select("doc_id", "lang")
    chosen = stored(chosen, "training-documents")  # its size is known when the texts are joined
    sent = spark.sparkContext.broadcast(pieces)

    def learn(key, table):
        counts = {}
        for text in table["text"].to_pylist():
            for w in split(text):
                counts[w] = counts.get(w, 0) + 1
        words = sorted(counts)
        logs = fit(sent.value, words, [counts[w] for w in words])
        return pa.table({"lang": [key[0].as_py()], "logs": [logs.tobytes()]})

    # of rows that repeat an id, the least text, so that the bound holds for rows too
    texts = first.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = texts.groupBy("lang").applyInArrow(learn, "lang string, logs binary").collect()
    found = {r["lang"]: np.frombuffer(bytes(r["logs"])) for r in rows}
    names = sorted(found)
    return names, np.stack([found[k] for k in names], 1) if names else np.zeros((pieces.size, 0))


def predict(docs, path, training=None, **bounds):
    """``docs`` with ``lang_pred`` and ``score``, the share of that language among all learned ones."""
    spark, pieces = docs.sparkSession, Pieces(path)
    names, logs = train(docs if training is None else training, pieces, **bounds)
    sent = spark.sparkContext.broadcast((pieces, names, logs))
    fields = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        pieces, names, logs = sent.value
        scorer = Scorer(pieces, logs)
        for batch in batches:
            texts, langs, shares, i = batch.to_pylist(), [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < 4 * TOGETHER:
                    size += len(texts[j] or "")
                    j += 1
                part = [t if t and names and has_letter(t) else "" for t in texts[i:j]]
                sums = scorer.score(part) if names else np.zeros((len(part), 1))
                best = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                langs += [names[b] if t else UNKNOWN for t, b in zip(part, best)]
                shares += [float(s) if t else 0.0 for t, s in zip(part, share)]
                i = j
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], fields=list(fields))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("__found", F.arrow_udf(run, "lang_pred string, score double")("text")).withColumns(
        {"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def digest(docs, path):
    """One row per document: doc_id, held_out, lang_pred, score."""
    return predict(docs.select("doc_id", "text"), path, training=docs).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
