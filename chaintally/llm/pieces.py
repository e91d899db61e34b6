"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts become words (at most one leading space mark), runs of further space marks, and line
breaks; no piece of a usable vocabulary crosses these borders. The distinct words of a batch
lie in one flat numpy array of symbols. In each round every word looks up its adjacent pairs,
a segmented minimum finds its best rank, the leftmost disjoint pairs of that rank merge at
once and the array is compacted, until no word has a pair left. Merging at once equals merging
one by one unless the new symbol can form a pair of the same or a better rank; such symbols
are marked when the vocabulary is loaded, and of them only the leftmost pair merges in a round.
A word of more than ``LONG`` characters (a base64 block, a page without blanks) has rounds of its
own: its pairs lie in buckets by rank, a round takes the best bucket, merges its leftmost disjoint
pairs and looks up only the pairs next to a merge, so that work follows merges, not rounds times length.

Encoded words are kept for the rest of the task, up to a fixed number of characters. The
vocabulary (some megabytes whatever the corpus) is broadcast. Decoding joins the pieces' bytes.

Defined results: NULL is the empty text; the empty text has no ids and decodes to itself;
characters outside the vocabulary become their UTF-8 bytes; U+2581 reads as a space.
Very long texts and words are encoded whole. Result columns replace input columns of the same
name, all other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common

common.travels(__name__)

SPACE = "▁"
NONE = np.iinfo(np.int32).max
WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Characters of distinct words that a task keeps encoded before it starts anew.
KEPT = 20_000_000
#: Characters of new words that are encoded together.
TOGETHER = 2_000_000
#: Characters of a word above which its pairs are kept in buckets.
LONG = 1024
SHIFT = np.int64(21)


class PairTable:
    """Open-addressing table from an int64 key to an int32 value; lookups of whole arrays."""

    def __init__(self, keys, values):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[left[take]], values[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys):
        """The values, -1 where a key is absent."""
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot_ = slot[open_] = (slot[open_] + 1) & self.mask
            same = self.keys[slot_] == keys[open_]
            found[open_[same]] = self.values[slot_[same]]
            open_ = open_[~same & (self.keys[slot_] != -1)]
        return found


class Vocabulary:
    """Pair ranks and texts of the pieces of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        spaces = [i for i in normal if set(names[i]) == {SPACE} and len(names[i]) > 1]
        words = [i for i in normal if i not in set(spaces)]
        if any(SPACE in names[i][1:] or "\n" in names[i] for i in words):
            raise ValueError("a piece crosses a word's border")
        if spaces and max(map(model.get_score, spaces)) >= min(model.get_score(i) for i in words if len(names[i]) > 1):
            raise ValueError("runs of spaces must merge last")
        #: symbols: pieces, then single characters that only occur inside pieces, then any other character
        known = {names[i]: i for i in words}
        for c in sorted({c for i in words for c in names[i]} - set(known)):
            known[c] = n + len(known) - len(words)
        self.first_other = n + len(known) - len(words)
        self.symbol = np.arange(self.first_other, self.first_other + 0x110000, dtype=np.int32)
        for text, s in known.items():
            if len(text) == 1:
                self.symbol[ord(text)] = s
        score = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs = [(known[p[:k]], known[p[k:]], known[p]) for p in (names[i] for i in words)
                 for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        left, right, piece = (np.array(x, np.int64) for x in zip(*pairs))
        self.rank = rank
        self.pairs = PairTable((left << SHIFT) | right, piece.astype(np.int32))
        self.unsafe = np.zeros(self.first_other, bool)
        for part in (left, right):
            own = part < n
            self.unsafe[part[own & (rank[piece] <= rank[np.minimum(part, n - 1)])]] = True
        #: ids of a symbol as decimal text, their number, and the bytes of each id
        self.byte_ids = [byte[b] for b in range(256)]
        self.id_text = [str(i).encode() for i in range(n)]
        self.id_bytes = [b""] * n
        for i in normal:
            self.id_bytes[i] = names[i].replace(SPACE, " ").encode()
        for b, i in byte.items():
            self.id_bytes[i] = bytes([b])
        self.inner = {s: text for text, s in known.items() if s >= n}
        self.n = n
        self.run = {len(names[i]): i for i in spaces}
        self.run_rank = {len(names[i]): rank[i] for i in spaces}
        self.run_one = known.get(SPACE)

    def ids(self, symbol):
        """The ids of one final symbol."""
        if symbol < self.n:
            return (symbol,)
        text = self.inner.get(symbol) or chr(symbol - self.first_other)
        return tuple(self.byte_ids[b] for b in text.encode())

    def merge(self, words):
        """The final symbols of all words: flat symbols and the first position of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols, word = self.symbol[codes], np.repeat(np.arange(len(words)), lengths)
        done = []
        while len(symbols):
            found = np.full(len(symbols), -1, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            found[inside] = self.pairs((symbols[inside].astype(np.int64) << SHIFT) | symbols[inside + 1])
            rank = np.where(found >= 0, self.rank[found], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == NONE
            if over.any():
                done.append((word[over], symbols[over]))
                keep = ~over
                symbols, word, rank, best, found = symbols[keep], word[keep], rank[keep], best[keep], found[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            # of overlapping pairs every second one, counted from the left
            begins = np.concatenate([[True], np.diff(at) != 1])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            at = at[first | ~self.unsafe[found[at]]]
            symbols[at] = found[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def merge_long(self, word):
        """The final symbols of one long word; the same merges as ``merge``, in the same order of ranks."""
        symbols = self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)  # ``before`` has a place behind the end
        piece, rank = np.full(n, -1, np.int32), np.full(n, NONE, np.int32)
        buckets, order = {}, []

        def look_up(left, right):
            found = self.pairs((left.astype(np.int64) << SHIFT) | right)
            return found, np.where(found >= 0, self.rank[found], NONE)

        def refresh(at):
            """Looks up the pairs that start at these places and puts them into their buckets."""
            rank[at] = NONE
            at = at[after[at] < n]
            piece[at], rank[at] = look_up(symbols[at], symbols[after[at]])
            put(at[rank[at] < NONE])

        def put(at):
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, places in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(at) else (), np.split(at, cuts)):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(order, r)
                buckets[r].append(places)

        refresh(np.arange(n))
        while order:
            best = heapq.heappop(order)
            at = np.unique(np.concatenate(buckets.pop(best)))
            at = at[alive[at] & (rank[at] == best)]
            if not len(at):
                continue
            # of overlapping pairs every second one, counted from the left
            begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            new = piece[at]
            if self.unsafe[new].any():
                # up to the first whose new pairs would come before the pairs right of it
                right, left = after[after[at]], before[at]
                follows = np.concatenate([[False], after[after[at[:-1]]] == at[1:]])
                ahead = np.where(follows, np.concatenate([[0], new[:-1]]), symbols[left])
                soon = (look_up(new, symbols[np.minimum(right, n - 1)])[1] <= best) & (right < n)
                soon |= (look_up(ahead, new)[1] <= best) & (left >= 0)
                stop = int(np.argmax(soon)) + 1 if soon.any() else len(at)
                put(at[stop:])
                at, new = at[:stop], new[:stop]
            gone = after[at]
            symbols[at], alive[gone], rank[gone] = new, False, NONE
            after[at] = after[gone]
            before[after[at]] = at
            refresh(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return symbols[alive]

    def spaces(self, n):
        """The ids of n space marks in a row: the leftmost best pair merges first."""
        run, i = [1] * n, 0
        while True:
            best = min((self.run_rank[a + b] for a, b in zip(run, run[1:]) if a + b in self.run_rank), default=None)
            if best is None:
                break
            if len(set(self.run_rank.values())) > 1:
                i = next(k for k, (a, b) in enumerate(zip(run, run[1:])) if self.run_rank.get(a + b) == best)
                run[i:i + 2] = [run[i] + run[i + 1]]
                continue
            # all ranks are equal: one pass with a stack merges leftmost first
            stack: list[int] = []
            rest = run[::-1]
            while rest:
                stack.append(rest.pop())
                while True:
                    if len(stack) > 1 and stack[-2] + stack[-1] in self.run_rank:
                        stack[-2:] = [stack[-2] + stack[-1]]
                    else:
                        break
            run = stack
        single = self.ids(self.run_one) if self.run_one is not None else tuple(self.byte_ids[b] for b in SPACE.encode())
        return [x for k in run for x in ((self.run[k],) if k > 1 else single)]


class Encoder:
    """Encodes texts; remembers words within one task."""

    def __init__(self, vocabulary):
        self.vocabulary, self.known, self.size = vocabulary, {}, 0

    def _learn(self, words):
        """known[word] = (ids as decimal text, their number, decoded bytes, ids as int32 bytes)."""
        v = self.vocabulary
        plain = [w[max(0, len(w) - len(w.lstrip(SPACE)) - 1):] for w in words]
        symbols, starts = v.merge(["" if len(w) > LONG else w for w in plain])
        symbols, starts = symbols.tolist(), starts.tolist()
        n, one = v.n, v.run_one
        for k, w in enumerate(words):
            of = v.merge_long(plain[k]).tolist() if len(plain[k]) > LONG else symbols[starts[k]:starts[k + 1]]
            spare = len(w) - len(plain[k])
            ids = of if max(of, default=0) < n else [i for s in of for i in v.ids(s)]
            if spare:
                # a lone mark left in front of the word belongs to the run of spaces
                if of[:1] == [one]:
                    ids, spare = ids[len(v.ids(one)):], spare + 1
                ids = v.spaces(spare) + ids
            self.known[w] = (b",".join([v.id_text[i] for i in ids]), len(ids), b"".join([v.id_bytes[i] for i in ids]), array("i", ids).tobytes())
        self.size += sum(map(len, words))

    def words(self, text):
        """The words of a text, space marks in place of spaces; a mark is put in front."""
        if not text:
            return []
        return [w.replace(" ", SPACE) for w in WORDS.findall(" " + text.replace(SPACE, " "))]

    def encode(self, texts):
        """For each text its encoded words."""
        if self.size > KEPT:
            self.known, self.size = {}, 0
        split = [self.words(t) for t in texts]
        new, size = {}, 0
        for ws in split:
            for w in ws:
                if w not in self.known and w not in new:
                    new[w] = None
                    size += len(w)
            if size > TOGETHER:
                self._learn(list(new))
                new, size = {}, 0
        self._learn(list(new))
        known = self.known
        return [[known[w] for w in ws] for ws in split]


def joined(words):
    """(decimal ids joined by commas, number of ids, decoded bytes) of one encoded text."""
    decoded = b"".join([x[2] for x in words])
    return b",".join([x[0] for x in words]), sum([x[1] for x in words]), decoded[1:] if decoded[:1] == b" " else decoded


def decode(vocabulary, ids):
    """The text of a list of ids: the pieces' bytes without the mark that encoding puts in front."""
    data = b"".join([vocabulary.id_bytes[i] for i in ids])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _batched(sent, finish, ddl):
    """An Arrow function over texts; ``finish`` turns a list of encoded texts into one array."""

    def run(batches):
        encoder = Encoder(sent.value)
        for batch in batches:
            texts = batch.to_pylist()
            parts, i = [finish([])], 0
            while i < len(texts):  # so many texts at once that their words fit
                j, size = i, 0
                while j < len(texts) and size < TOGETHER:
                    size += len(texts[j] or "")
                    j += 1
                parts.append(finish(encoder.encode([t or "" for t in texts[i:j]])))
                i = j
            yield pa.concat_arrays(parts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl)


def _lists(texts):
    flat = np.frombuffer(b"".join([x[3] for words in texts for x in words]), np.int32)
    starts = np.concatenate([[0], np.cumsum([sum([x[1] for x in words]) for words in texts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))


def _digests(texts):
    rows = [joined(words) for words in texts]
    return pa.StructArray.from_arrays([
        pa.array([n for _, n, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(ids).hexdigest() for ids, _, _ in rows], pa.string()),
        pa.array([hashlib.sha256(data).hexdigest() for _, _, data in rows], pa.string())],
        names=["n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs, path):
    """``docs`` with ``ids``, the piece numbers of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return docs.withColumn("ids", _batched(sent, _lists, "array<int>")("text"))


def decode_ids(frame, path):
    """``frame`` with ``decoded``, the text of its column ``ids``."""
    sent = frame.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def make():
        vocabulary = sent.value
        return lambda ids: (decode(vocabulary, ids or ()),)

    text = common.struct_udf(make, "decoded string", pa.schema([("decoded", pa.string())]))
    return frame.withColumn("decoded", text("ids")["decoded"])


def digest(docs, path):
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    make = _batched(sent, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", make("text").alias("e")).select("doc_id", "e.*")
