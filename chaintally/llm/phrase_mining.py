"""Collocations per language by partitioned (SON) phrase mining.

Texts are lower-cased (A-Z) and cut at ``[.,;:!?]`` and line ends into pieces, pieces at blanks into
words. A phrase is one to ``LONGEST`` neighbouring words of a piece; it is frequent in a language
if it occurs at least ``support`` times there, overlaps included.

1. Rows are gathered into shards of about ``SHARD`` bytes. A shard with the share w/W of a
   language's bytes is mined completely at the local support t = ceil(support * w / W): words
   become numbers, phrases grow word by word, and only from parts that reach t. A phrase that is
   frequent over all reaches t in some shard. Phrases are reported by hashes of ``HASH`` bits.
2. The locally frequent phrases are united. Shards that did not report a phrase hold at most t - 1
   of it, so its reported counts and that rest bound its total from above; phrases that cannot
   reach the support go. This keeps the candidates few where t is 1 or 2. Phrases that share a
   hash share the bound, which may keep too much and never too little.
3. The texts are read again and all candidates are counted as text, shard by shard, then summed by
   phrase. A Bloom filter of the candidates, at most 2^``BITS`` bits whatever the corpus, tells a
   shard what to count. It may let through too much, which the sum discards, and never too little.

Counts of a shard are summed before they are dealt by phrase, so a frequent phrase reaches its
task once per shard. A shard is a bounded stretch of bytes with about ``DISTINCT`` distinct
words at most, also inside one long text: its last words are carried over, and no phrase is lost
or counted twice. With more shards than ``support`` each t is 1: step 1 then reports every phrase
that it sees, and the results stay exact. So reports travel packed: sorted hashes as differences,
some 3 bytes to a phrase, and texts compressed, many to a row, dealt into buckets by hash. A task
unites one bucket after the other and holds the distinct phrases of one. There are four buckets to
``DEAL`` bytes of text, at most ``BUCKETS``: beyond, they grow with the corpus.

Scores are whole numbers, computed in decimals. Defined results: NULL and empty texts have no
words; a NULL language is ``und``; repeated rows count each time; ties are broken by phrase, so
the order is total; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chaintally.llm import common
from chaintally.llm.common import TEXTS, short_batches  # noqa: F401
from chaintally.session import stored

common.travels(__name__)

LONGEST = 4
#: Bytes of text to a shard at most, and as few as that where cores would stand idle; distinct words that end a shard
#: earlier; places counted at once; bytes of phrases to a batch of rows; greatest size of the filter.
SHARD, SMALL, DISTINCT, TOGETHER, BATCH, BITS = 96_000_000, 4_000_000, 2_000_000, 500_000, 8_000_000, 27
#: Bits of the filter per candidate, and places of a candidate in it.
SPREAD, PLACES = 16, 4
#: Bits of a phrase's hash; the rest of 64 bits is for its count.
HASH, COUNT = 40, 24
#: Bytes of text whose reports one task unites; most buckets; bytes of reports packed, and united, at once.
DEAL, BUCKETS, PACK, FOLD = 48_000_000, 1 << 14, 4_000_000, 32_000_000
#: What separates pieces becomes a line feed; the byte 0xFF, which no text holds, marks them among the words.
PIECES = bytes(10 if c in b".,;:!?\n\x0b\f\r" else c for c in range(256))
CUT = re.compile(rb"[.,;:!?\x09-\x0D ]")
BREAK = b"\xff"
#: How hashes are mixed.
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
DDL = "lang string, phrase string, size int, n bigint"
#: Packed reports of a shard: to the sum of the bucket and language, n; phrases with counts, data.
PACKED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("data", pa.binary())])
PACKED_DDL = "bucket int, lang string, n bigint, data binary"


class Numbers(dict):
    """Words numbered as they come; the break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def words(data: bytes):
    return data.lower().translate(PIECES).replace(b"\n", b" " + BREAK + b" ").split()


class Shard:
    """Numbered words per language, in the order of the texts: a list of one buffer each, which grows and is mined in place."""

    def __init__(self, tails=None):
        self.numbers, self.runs, self.size, self.total, self.lead = Numbers(), {}, {}, 0, {}
        for lang, tail in (tails or {}).items():  # words of a text that goes on from the shard before
            self._run(lang).extend(map(self.numbers.__getitem__, tail))
            self.size[lang], self.lead[lang] = 0, len(tail)

    def _run(self, lang):
        return self.runs.setdefault(lang, [array("i")])[0]

    def add(self, lang, data):
        if found := words(data):
            self._run(lang).extend(map(self.numbers.__getitem__, found))
        self.size[lang] = self.size.get(lang, 0) + len(data)
        self.total += len(data)

    def end_text(self, lang):
        self._run(lang).append(0)

    def take(self, lang):
        """The words of a language, which the shard gives up; not copied."""
        run, = self.runs.pop(lang)
        return np.frombuffer(run, np.int32)

    def by_words(self):
        """The languages, those of fewest words first: what they hold is free when the largest is grown."""
        return sorted(self.runs, key=lambda lang: sum(map(len, self.runs[lang])))

    def tails(self, lang):
        """The last words of an unfinished text that a phrase of the next shard may begin with."""
        if not self.runs.get(lang):
            return {}
        run = np.array(self._run(lang)[1 - LONGEST:], np.int32)
        since = np.flatnonzero(run == 0)
        run = run[since[-1] + 1:] if len(since) else run
        known = list(self.numbers)
        return {lang: [known[i] for i in run.tolist()]}


def shards(rows):
    """Shards of (lang, weight, data) rows, each with the weights of its languages; no text or word is held twice."""
    shard, weights = Shard(), {}
    for lang, weight, data in rows:
        weights[lang] = weight
        for _, piece in common.slices(data, CUT):
            if shard.total >= SHARD or len(shard.numbers) > DISTINCT:
                tails = shard.tails(lang)
                yield shard, weights
                shard, weights = Shard(tails), {lang: weight}
            shard.add(lang, piece)
        shard.end_text(lang)
    if shard.total:
        yield shard, weights


def grow(run, lead, vocabulary, fit):
    """The phrases of a run of numbered words, longer ones from the shorter ones that they begin with.

    Yields (words, counts): the columns of word numbers of distinct phrases that pass, and their occurrences that
    end beyond the first ``lead`` words. ``fit(columns, counts)`` says which phrases may grow; counts given to it
    include the lead. Places are dealt into passes by their first two words, and a pass is grown to the end before the
    next: so beside the run only a byte per place (four, with 128 passes or more) and one pass are held.
    """
    v, counts = np.int64(vocabulary), np.zeros(vocabulary, np.int64)
    for i in range(0, len(run), TOGETHER):  # numpy would widen all numbers at once
        counts += np.bincount(run[i:i + TOGETHER], minlength=vocabulary)
    counts[0] = 0
    single = np.flatnonzero(counts)
    single = single[fit([single], counts[single])]
    yield [single], (counts - np.bincount(run[:lead], minlength=vocabulary))[single]
    del counts
    good, single = np.zeros(vocabulary, bool), single.astype(np.int32)
    good[single] = True
    places = max(0, len(run) - 1)
    passes = -(-places // TOGETHER)
    turn = np.full(places, -1, np.int8 if passes < 128 else np.int32)
    for i in range(0, places, TOGETHER):
        second = run[i + 1:i + 1 + TOGETHER]
        first = run[i:i + len(second)]
        pair = (first * v + second).astype(np.uint64) * MIX >> TURN
        np.copyto(turn[i:i + len(second)], pair % np.uint64(passes), where=good[first] & good[second], casting="unsafe")
    number = np.arange(vocabulary, dtype=np.int32)
    for k in range(passes):
        starts, level = np.flatnonzero(turn == k), [number]
        at = run[starts]  # per place, the phrase of this level that starts there
        for size in range(2, LONGEST + 1):
            if not len(starts):
                break
            keys = at * v + run[starts + size - 1]
            distinct, counts = np.unique(keys, return_counts=True)
            columns = [c[distinct // v] for c in level] + [(distinct % v).astype(np.int32)]
            passed = fit(columns, counts)
            np.subtract.at(counts, np.searchsorted(distinct, keys[starts + size <= lead]), 1)
            level, distinct = [c[passed] for c in columns], distinct[passed]
            yield level, counts[passed]
            if size == LONGEST or not len(distinct):
                break
            at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
            on = (distinct[at] == keys) & (starts + size < len(run))
            on[on] = good[run[starts[on] + size]]
            starts, at = starts[on], at[on]


def listed(lang, known, lengths, columns, counts):
    """Record batches of phrases as text, of bounded bytes."""
    bounds = np.cumsum(sum(lengths[c] for c in columns) + len(columns)) // BATCH
    ends = [*(np.flatnonzero(np.diff(bounds)) + 1), len(counts)] if len(counts) else []
    for begin, end in zip([0, *ends], ends):
        parts = [known.take(pa.array(c[begin:end])) for c in columns]
        text = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        n = end - begin
        yield pa.record_batch([pa.array([lang] * n, pa.string()), text, pa.array(np.full(n, len(columns), np.int32)),
                               pa.array(counts[begin:end].astype(np.int64))], schema=ROWS)


def _rows(batches):
    for batch in batches:
        for lang, weight, data in zip(*(batch.column(c) for c in ("lang", "weight", "data"))):  # one text at a time
            yield lang.as_py(), weight.as_py(), data.as_py()


def _vocabulary(shard):
    """The words by number as text (the break as empty text), their lengths and hashes; empties the shard's."""
    known = list(shard.numbers)
    shard.numbers.clear()
    known[0] = b""
    hashes = np.fromiter(map(name, known), np.uint64, len(known))
    return pa.array(known, pa.binary()).cast(pa.string()), np.fromiter(map(len, known), np.int64, len(known)), hashes


def _one(lang, n):
    return pa.record_batch([pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([n], pa.int64())], schema=ROWS)


def give_back():
    """Memory that a worker freed goes back to the system, where the allocators would keep it beside the next shard."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_text(lang, vocabulary, found, slack):
    """Reports as rows (lang, phrase, size, gain), and one row (lang, NULL, 0, slack)."""
    known, lengths, _ = vocabulary
    yield _one(lang, slack)
    for columns, gains in found:
        yield from listed(lang, known, lengths, columns, gains)


def mine(support, report=as_text):
    """Step 1: per shard and language what ``report`` makes of the phrases, with count - (t - 1) as gain, and of t - 1."""

    def reached(least, phrases):
        for columns, counts in phrases:
            enough = counts >= least
            yield [c[enough] for c in columns], counts[enough] - least + 1

    def mined(shard, weights):
        vocabulary = _vocabulary(shard)
        for lang in shard.by_words():
            numbered = shard.take(lang)
            if not shard.size.get(lang):
                continue
            least = max(1, -(-support * shard.size[lang] // weights[lang]))
            phrases = grow(numbered, shard.lead.get(lang, 0), len(vocabulary[0]), lambda _, n: n >= least)
            yield from report(lang, vocabulary, reached(least, phrases), least - 1)

    def run(batches):
        for shard, weights in shards(_rows(batches)):
            yield from mined(shard, weights)  # what it holds goes before the next shard is read
            give_back()
    return run


# ---- packed reports -----------------------------------------------------------------------------

def mixed(seed, *columns):
    """Hashes of phrases from a seed and the hashes of their words."""
    h = np.full(len(columns[0]), seed, np.uint64)
    for c in columns:
        h = (h ^ c) * MIX
        h ^= h >> TURN
    return h


def name(data: bytes):
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(data))


def phrase_hashes(lang, hashes, columns):
    return mixed(name(lang.encode()), *(hashes[c] for c in columns)) >> np.uint64(64 - HASH)


def bucket_of(h, buckets):
    return (h * np.uint64(buckets) >> np.uint64(HASH)).astype(np.uint16)


def squeeze(numbers, rest=b""):
    """Numbers of 64 bits, the lowest byte of all first, and further bytes, compressed."""
    import zstandard

    planes = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(numbers).to_bytes(8, "little") + planes + rest)


def unsqueeze(data):
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(np.uint64).ravel(), memoryview(data)[8 + 8 * n:]


def pack_hashes(held):
    """Sorted numbers, each a hash above a count: hashes become differences."""
    numbers = held.copy()
    numbers[1:] -= held[:-1] >> np.uint64(COUNT) << np.uint64(COUNT)
    return squeeze(numbers)


def unpack_hashes(data):
    numbers, _ = unsqueeze(data)
    low = np.uint64((1 << COUNT) - 1)
    return np.cumsum(numbers >> np.uint64(COUNT)) << np.uint64(COUNT) | numbers & low


def fold_hashes(parts):
    """One number per hash, with the sum of its counts, which stays at the most that a number can hold."""
    numbers = np.concatenate(parts)
    numbers.sort()
    h, low = numbers >> np.uint64(COUNT), np.uint64((1 << COUNT) - 1)
    starts = np.flatnonzero(np.diff(h, prepend=~h[:1]))
    return h[starts] << np.uint64(COUNT) | np.minimum(np.add.reduceat(numbers & low, starts), low)


def pack_texts(phrases, counts):
    """An array of phrases and their counts in a shard, which is no longer than what Arrow's lengths hold."""
    offsets = np.frombuffer(phrases.buffers()[1], np.int32, len(phrases) + 1, 4 * phrases.offset)
    return squeeze(counts.astype(np.uint64) << np.uint64(32) | np.diff(offsets).astype(np.uint64),
                   phrases.buffers()[2][offsets[0]:offsets[-1]].to_pybytes())


def unpack_texts(data):
    numbers, text = unsqueeze(data)
    offsets = np.concatenate([[0], np.cumsum(numbers & np.uint64(0xFFFFFFFF))]).astype(np.int32)
    phrases = pa.Array.from_buffers(pa.string(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    return pa.table({"phrase": phrases, "n": (numbers >> np.uint64(32)).astype(np.int64)})


def fold_texts(parts):
    return pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])


def units(support):
    """What one in the count of a hash stands for, so that ``COUNT`` bits can reach any support."""
    return 1 + (int(max(support, 0)) >> (COUNT - 4))


def packed(rows, lang):
    buckets, numbers, data = zip(*rows)
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array([lang] * len(buckets), pa.string()), pa.array(numbers, pa.int64()),
                            pa.array(data, pa.binary())], schema=PACKED)


def stretches(buckets):
    """(bucket, begin, end) of equal neighbours."""
    ends = [*(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else []
    return [(int(buckets[i]), i, j) for i, j in zip([0, *ends], ends)]


def as_hashes(support, buckets):
    """Reports as packed hashes; the slack goes to every bucket."""
    unit = units(support)

    def flushed(lang, held):
        numbers = np.concatenate(held)
        held.clear()
        numbers.sort()
        return packed([(b, 0, pack_hashes(numbers[i:j])) for b, i, j in stretches(bucket_of(numbers >> np.uint64(COUNT), buckets))], lang)

    def report(lang, vocabulary, found, slack):
        if slack:
            yield packed([(b, slack, b"") for b in range(buckets)], lang)
        held, size = [], 0
        for columns, gains in found:
            if len(gains):
                counts = np.minimum(-(-gains // unit), (1 << COUNT) - 1).astype(np.uint64)
                held.append(phrase_hashes(lang, vocabulary[2], columns) << np.uint64(COUNT) | counts)
                size += held[-1].nbytes
            if size >= PACK:
                yield flushed(lang, held)
                size = 0
        if held:
            yield flushed(lang, held)
    return report


def as_packed_text(lang, vocabulary, found, words, buckets):
    """Counts as packed texts; the number of words goes to the first bucket."""
    known, lengths, hashes = vocabulary
    yield packed([(0, words, b"")], lang)
    held, size = [], 0

    def flushed():
        into, phrases, counts = (np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        held.clear()
        order = np.argsort(into, kind="stable")
        phrases, counts = phrases.take(pa.array(order)), counts[order]
        return packed([(b, 0, pack_texts(phrases[i:j], counts[i:j])) for b, i, j in stretches(into[order])], lang)

    for columns, counts in found:
        begin, into = 0, bucket_of(phrase_hashes(lang, hashes, columns), buckets)
        for batch in listed(lang, known, lengths, columns, counts):
            held.append((into[begin:begin + len(batch)], batch.column("phrase"), batch.column("n").to_numpy()))
            begin, size = begin + len(batch), size + batch.nbytes
            if size >= PACK:
                yield flushed()
                size = 0
    if held:
        yield flushed()


def gathered(batches, unpack, fold):
    """(bucket, lang, sum of n, folded parts or None) of rows that come by bucket and language.

    Parts are folded when they outgrow what is folded already: little more than the distinct phrases is held.
    """
    rows = (row for batch in batches for row in zip(*(batch.column(c) for c in PACKED.names)))
    for (bucket, lang), group in groupby(rows, lambda row: (row[0].as_py(), row[1].as_py())):
        total, parts, size = 0, [], 0
        for _, _, n, data in group:
            total += n.as_py()
            if data := data.as_py():
                parts.append(unpack(data))
                size += parts[-1].nbytes
                if size > max(FOLD, parts[0].nbytes):
                    parts, size = [fold(parts)], 0
        yield bucket, lang, total, fold(parts) if parts else None


def unite(support):
    """Step 2: the hashes of each bucket whose gains and slack reach the support."""

    def run(batches):
        for _, _, slack, numbers in gathered(batches, unpack_hashes, fold_hashes):
            if numbers is not None:
                gain = (numbers & np.uint64((1 << COUNT) - 1)).astype(np.int64) * units(support)
                h = numbers[gain + slack >= support] >> np.uint64(COUNT)
                yield pa.record_batch([pa.array(h.astype(np.int64))], names=["hash"])
    return run


def total(support):
    """The end of step 3: rows (lang, phrase, size, f) with f >= support, and rows (lang, NULL, 0, words)."""

    def run(batches):
        for bucket, lang, words, found in gathered(batches, unpack_texts, fold_texts):
            if not bucket:
                yield _one(lang, words)
            for batch in (found.filter(pc.field("n") >= support).to_batches(1 << 16) if found else ()):
                size = pc.add(pc.count_substring(batch.column("phrase"), " "), 1).cast(pa.int32())
                yield pa.record_batch([pa.array([lang] * len(batch), pa.string()), batch.column("phrase"), size, batch.column("n")], schema=ROWS)
    return run


# ---- the filter of candidates -------------------------------------------------------------------

def spots(h, bits):
    """Where a filter of 2^bits bits holds each hash: an array of ``PLACES`` rows."""
    h = mixed(bits, h.astype(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(PLACES)]).astype(np.int64)


def candidate_filter(found, count):
    """The bits of the Bloom filter of hashes, and their number as a power of two.

    The bits are set by Spark's bitmap aggregate, 32,768 to a row, so what reaches the driver is the filter itself.
    """
    bits = min(BITS, max(16, (count * SPREAD).bit_length()))

    def place(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(spots(batch.column("hash").to_numpy(), bits).ravel() + 1)], names=["bit"])

    rows = found.mapInArrow(place, "bit bigint").groupBy(
        F.bitmap_bucket_number("bit").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for r in rows.toLocalIterator():
        table[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel(), bits


def count(bitmap, bits, buckets):
    """Step 3: per shard the packed counts of what the filter holds, and its words."""

    def counted(shard, table):
        vocabulary = _vocabulary(shard)
        for lang in shard.by_words():
            numbered, lead = shard.take(lang), shard.lead.get(lang, 0)

            def held(columns, _, lang=lang):
                found = [np.empty(0, bool)]
                for i in range(0, len(columns[0]), 1 << 16):
                    at = spots(phrase_hashes(lang, vocabulary[2], [c[i:i + (1 << 16)] for c in columns]), bits)
                    found.append(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))
                return np.concatenate(found)

            phrases = (([c[counts > 0] for c in columns], counts[counts > 0]) for columns, counts in grow(numbered, lead, len(vocabulary[0]), held))
            yield from as_packed_text(lang, vocabulary, phrases, int(np.count_nonzero(numbered[lead:])), buckets)

    def run(batches):
        for shard, _ in shards(_rows(batches)):
            yield from counted(shard, bitmap.value)
            give_back()
    return run


def frequent(docs, support=30):
    """(lang, phrase, size, f) of all phrases with f >= support, and (lang, n) with all words; both are stored tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), common.as_bytes().alias("data"))
    weights = stored(rows.groupBy("lang").agg(F.sum(F.octet_length("data")).alias("weight")).filter("weight > 0"), "phrase-weights")
    size = weights.agg(F.sum("weight")).first()[0] or 1
    cores = min(spark.sparkContext.defaultParallelism, -(-size // SMALL))
    tasks = max(-(-size // SHARD), cores)  # every core has a shard
    dealt = rows.join(weights, "lang").select("lang", "weight", "data").coalesce(tasks)
    deals = max(-(-size // DEAL), cores)
    buckets = min(4 * deals, BUCKETS)

    def by_bucket(reports):
        return dealt.mapInArrow(reports, PACKED_DDL).repartition(deals, "bucket").sortWithinPartitions("bucket", "lang")

    with short_batches(spark):
        local = stored(by_bucket(mine(support, as_hashes(support, buckets))).mapInArrow(unite(support), "hash bigint"), "phrase-local")
    table, bits = candidate_filter(local, local.count())
    with short_batches(spark):
        counted = stored(by_bucket(count(spark.sparkContext.broadcast(table), bits, buckets)).mapInArrow(total(support), DDL), "phrase-counts")
    return (counted.filter("phrase IS NOT NULL").withColumnRenamed("n", "f"),
            counted.filter("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))


def scored(found):
    """lang, phrase, size, a, l, r, score of every candidate at its lowest-scoring cut."""
    f = found.select("lang", "phrase", "f")
    cuts = found.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.expr(
        "transform(sequence(1, size - 1), k -> named_struct('k', k, 'first', substring_index(phrase, ' ', k), 'rest', substring_index(phrase, ' ', k - size)))")).alias("c"))
    sides = cuts.select("lang", "phrase", "size", "a", "c.*").join(
        f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000BD div (CAST(l AS DECIMAL(20, 0)) + r)")
    return sides.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates, overlap=80):
    """Candidates that no longer candidate with ``overlap`` hundredths of their occurrences contains."""
    inside = candidates.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr(
        """flatten(transform(sequence(2, size - 1), g -> transform(sequence(1, size - g + 1),
           i -> array_join(slice(split(phrase, ' '), i, g), ' '))))""")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(most, ["lang", "phrase"], "left").filter(
        F.expr(f"longer IS NULL OR 100BD * longer < {overlap}BD * a")).drop("longer")


def collocations(docs, support=30, overlap=80, top=2000):
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent(docs, support)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncovered(stored(scored(found), "phrase-scores"), overlap).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(docs):
    return collocations(docs)


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size),
f AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT lang, phrase, w, size, f AS a, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.size, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM k
      JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.w, 1, k), ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.w, k + 1, k.size), ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f AS longer, w, size, g, unnest(range(1, size - g + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS g) WHERE g < size),
most AS (SELECT lang, array_to_string(list_slice(w, i, i + g - 1), ' ') AS phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
