"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is 128 bits of BLAKE2b over the line stripped of blanks with A-Z lower-cased. The
ledger keeps, per key, the exact number of documents that hold it, as batches of signed counts:
an insertion adds, a deletion subtracts. A key with at least ``least`` documents is frequent.
Keys that cross this line in a batch are put into, or taken out of, the cuckoo filter of their
shard; other shards keep their filter. Inserting and deleting the same documents leaves the same
counts and frequent keys, whatever came between.

To clean documents, their distinct keys are dealt to the shards, each shard's filter travels
ahead of them, and only keys that the filter may hold go on to the exact table, which settles
them. A filter never misses a frequent key, so nothing is lost. Keys of a shard that hold many
rows (a line that a third of all documents share) are dealt to several tasks, each with a copy
of the filter. A shard is read as a sorted stream: a task holds one filter and one Arrow batch.

A ledger is a folder: ``manifest`` has one row per finished batch and names its Parquet tables,
so a batch whose job died leaves the ledger as it was. Write from one session at a time.

Defined results: NULL and empty texts are one empty line; a line without a code point left has
no key and always stays; rows are documents, so rows that repeat a doc_id or a text all count;
a key counts once per document; very long texts and lines are read whole (a task holds one text);
an empty table changes nothing and returns no rows; deleting what was never inserted raises and
leaves the ledger as it was; result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chaintally.llm import common
from chaintally.session import shared_folder, stored

common.travels(__name__)

#: Documents that make a line frequent.
LEAST = 10
#: Buckets of a filter segment, and fingerprints to a bucket.
BUCKETS, SLOTS = 4096, 4
#: Frequent keys to a shard when a ledger is begun; fewest and most shards; rows of a shard to a task.
KEYS, FEWEST, MOST, ROWS = 8192, 16, 65536, 100_000
#: Moves of an insertion before a shard gets a further segment.
MOVES = 200
MANIFEST = "batch int, counts string, filters string, shards int, least int"
COUNTS = "k1 bigint, k2 bigint, refs bigint"
FILTERS = "shard int, segments binary"
FLAT = pa.schema([(c, pa.int64()) for c in ("t1", "t2", "k1", "k2")])


def key(line: bytes) -> bytes:
    """16 bytes that name a line, or none where nothing is left of it."""
    line = line.strip().lower()  # on bytes: ASCII blanks and letters only
    return hashlib.blake2b(line, digest_size=16).digest() if line else b""


# ---- cuckoo filters -----------------------------------------------------------------------------

def places(k1, k2):
    """Fingerprint (never 0), bucket and other bucket of keys, as arrays. The low bits of k1 choose the shard."""
    mark = np.asarray(k2).astype(np.uint64) & np.uint64(0xFFFF)
    mark = np.where(mark == 0, np.uint64(1), mark)
    here = (np.asarray(k1).astype(np.uint64) >> np.uint64(20)) & np.uint64(BUCKETS - 1)
    return mark.astype(np.int64), here.astype(np.int64), other(here.astype(np.int64), mark.astype(np.int64))


def other(bucket, mark):
    """The second bucket of a fingerprint in ``bucket``, from either of its two."""
    return bucket ^ ((mark * 0x5BD1 >> 3) & (BUCKETS - 1) | 1)


def load(data):
    """Segments of a filter as one writable array (segment, bucket, slot)."""
    return np.frombuffer(bytearray(data or b""), np.uint16).reshape(-1, BUCKETS, SLOTS)


def put(segments, mark, one, two):
    """The filter with a fingerprint more; a further segment is added where moving others fails."""
    for s in segments:
        for b in (one, two):
            free = np.flatnonzero(s[b] == 0)
            if len(free):
                s[b, free[0]] = mark
                return segments
    if len(segments):
        last, undo, b, m = segments[-1], [], two, mark
        for move in range(MOVES):
            slot = move % SLOTS
            undo.append((b, slot, int(last[b, slot])))
            last[b, slot], m = m, undo[-1][2]
            b = other(b, m)
            free = np.flatnonzero(last[b] == 0)
            if len(free):
                last[b, free[0]] = m
                return segments
        for b, slot, m in reversed(undo):
            last[b, slot] = m
    segments = np.concatenate([segments, np.zeros((1, BUCKETS, SLOTS), np.uint16)])
    segments[-1, one, 0] = mark
    return segments


def take(segments, mark, one, two):
    """Take a fingerprint that was put before out of the filter, in place."""
    for s in reversed(segments):
        for b in (one, two):
            found = np.flatnonzero(s[b] == mark)
            if len(found):
                s[b, found[0]] = 0
                return
    raise ValueError("the filter does not hold this key")


def holds(segments, k1, k2):
    """Whether the filter may hold each key; True for every key that it holds."""
    mark, one, two = places(k1, k2)
    found = np.zeros(len(mark), bool)
    for s in segments:
        found |= ((s[one] == mark[:, None]) | (s[two] == mark[:, None])).any(axis=1)
    return found


# ---- keys of documents ----------------------------------------------------------------------------

def named(docs):
    """``docs`` as one struct column ``own``, with the text and 128 bits that name it."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("own"), text.alias("text"))
    return own.withColumns({f"t{i + 1}": F.conv(F.substring(F.md5(text.cast("binary")), 16 * i + 1, 16), 16, -10).cast("bigint")
                            for i in (0, 1)})


def occurrences(docs):
    """(t1, t2, k1, k2): per document, its text and each distinct key of its lines."""

    def flat(batches):
        for batch in batches:
            keys, counts = [], []
            for data in batch.column("data").to_pylist():
                found = {key(line) for line in data.split(b"\n")} - {b""}
                counts.append(len(found))
                keys += sorted(found)
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            texts = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("t1", "t2")]
            yield pa.record_batch([pa.array(a) for a in (*texts, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))], schema=FLAT)

    rows = named(docs.select("text")).select("t1", "t2", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(flat, "t1 bigint, t2 bigint, k1 bigint, k2 bigint")


# ---- the ledger -----------------------------------------------------------------------------------

class LineLedger:
    """A ledger in a folder that executors share; a new folder is an empty ledger."""

    def __init__(self, spark, path, least=LEAST):
        self.spark, self.path, self.least = spark, path, least
        known = self.batches()
        if known and known[0]["least"] != least:
            raise ValueError(f"this ledger counts from {known[0]['least']} documents")

    def batches(self):
        """The finished batches, oldest first; one small row each."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy("batch").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def shard(self, shards):
        return F.col("k1").bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard")

    def counts(self):
        """(k1, k2, refs): documents that hold each key now."""
        known = [b["counts"] for b in self.batches()]
        if not known:
            return self.spark.createDataFrame([], COUNTS)
        rows = self.spark.read.schema(COUNTS).parquet(*known)
        return (rows if len(known) == 1 else rows.groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))).filter("refs <> 0")

    def frequent(self):
        return self.counts().filter(F.col("refs") >= self.least).select("k1", "k2")

    def filters(self):
        """(shard, segments): the newest filter of each shard that has one."""
        known = [(b["batch"], b["filters"]) for b in self.batches()]
        rows = [self.spark.read.schema(FILTERS).parquet(p).withColumn("batch", F.lit(n)) for n, p in known]
        if not rows:
            return self.spark.createDataFrame([], FILTERS)
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return every.groupBy("shard").agg(F.max_by("segments", "batch").alias("segments"))

    def insert(self, docs):
        return self._change(stored(occurrences(docs), "line-keys"), 1)

    def delete(self, docs):
        """Take back documents, given with the texts that were inserted."""
        return self._change(stored(occurrences(docs), "line-keys"), -1)

    def _change(self, keys, sign):
        """One batch: its signed counts, and the filters of the shards in which a key crosses the line."""
        spark, known = self.spark, self.batches()
        counts, filters = (f"{self.path}/{kind}-{uuid.uuid4().hex[:12]}" for kind in ("counts", "filters"))
        keys.groupBy("k1", "k2").agg((sign * F.count("*")).alias("refs")).write.parquet(counts)
        new = spark.read.schema(COUNTS).parquet(counts)
        both = new.withColumn("new", F.col("refs"))
        if known:
            both = both.unionByName(self.counts().withColumn("new", F.lit(0).cast("bigint"))).groupBy("k1", "k2").agg(
                F.sum("refs").alias("refs"), F.sum("new").alias("new")).filter("new <> 0")
        if sign < 0 and both.filter("refs < 0").head(1):
            raise ValueError("some of these documents are not in the ledger")
        before, now = F.col("refs") - F.col("new") >= self.least, F.col("refs") >= self.least
        crossing = stored(both.filter(before != now).select("k1", "k2", now.alias("up")), "line-crossings")
        n = known[0]["shards"] if known else min(MOST, max(FEWEST, 1 << (crossing.count() // KEYS).bit_length()))
        self._filters(crossing.select(self.shard(n), "k1", "k2", "up"), bool(known)).write.parquet(filters)
        spark.createDataFrame([(len(known), counts, filters, n, self.least)], MANIFEST).coalesce(1).write.mode("append").parquet(
            f"{self.path}/manifest")
        return self

    def _filters(self, crossing, old):
        rows = crossing.withColumn("segments", F.lit(None).cast("binary"))
        if old:  # the filters of shards that change
            rows = rows.unionByName(self.filters().join(crossing.select("shard").distinct(), "shard", "left_semi"), allowMissingColumns=True)

        def change(table):
            kept = [x for x in table.column("segments").to_pylist() if x is not None]
            segments = load(kept[0] if kept else b"")
            moves = table.filter(table.column("up").is_valid()).sort_by([("up", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
            k1, k2 = (moves.column(c).to_numpy() for c in ("k1", "k2"))
            for up, mark, one, two in zip(moves.column("up").to_pylist(), *(x.tolist() for x in places(k1, k2))):
                if up:
                    segments = put(segments, mark, one, two)
                else:
                    take(segments, mark, one, two)
            return pa.table({"shard": table.column("shard")[:1], "segments": pa.array([segments.tobytes()], pa.binary())})

        return rows.groupBy("shard").applyInArrow(change, FILTERS)

    def matches(self, keys):
        """The rows (t1, t2, k1, k2) of ``keys`` whose key is frequent now."""
        known = self.batches()
        if not known:
            return keys.filter("false")
        rows = keys.select("*", self.shard(known[0]["shards"]))
        # one row per shard: how many tasks its rows are dealt to
        spread = rows.groupBy("shard").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("tasks"))
        filters = stored(self.filters().join(spread, "shard"), "line-filters")
        lines = rows.join(F.broadcast(filters.select("shard", "tasks")), "shard").select(
            "shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("tasks")).cast("int").alias("task"),
            F.lit(1).alias("kind"), "t1", "t2", "k1", "k2", F.lit(None).cast("binary").alias("segments"))
        ahead = filters.select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"),
                               "segments")
        dealt = lines.unionByName(ahead, allowMissingColumns=True).repartition("shard", "task").sortWithinPartitions(
            "shard", "task", "kind")

        def probe(batches):
            segments, at = load(b""), None
            for batch in batches:
                shard, task, kind = (batch.column(c).to_numpy() for c in ("shard", "task", "kind"))
                if not len(shard):
                    continue
                ends = np.flatnonzero((np.diff(shard) != 0) | (np.diff(task) != 0)) + 1
                for begin, end in zip([0, *ends], [*ends, len(shard)]):
                    if at != (shard[begin], task[begin]):
                        segments, at = load(batch.column("segments")[int(begin)].as_py()), (shard[begin], task[begin])
                        assert kind[begin] == 0, "a shard's filter comes first"
                        begin += 1
                    part = batch.slice(begin, end - begin).select(FLAT.names)
                    maybe = holds(segments, part.column("k1").to_numpy(zero_copy_only=False), part.column("k2").to_numpy(zero_copy_only=False))
                    yield pa.record_batch([c.filter(pa.array(maybe)) for c in part.columns], schema=FLAT)

        maybe = dealt.mapInArrow(probe, "t1 bigint, t2 bigint, k1 bigint, k2 bigint")
        return maybe.join(self.frequent(), ["k1", "k2"])

    def clean(self, docs):
        """``docs`` with the frequent lines out of ``text``, and n_lines (before), n_dropped."""
        # stored, so that the copies of a text can be split where they meet its one row
        bad = stored(self.matches(stored(occurrences(docs), "line-keys")).groupBy("t1", "t2").agg(
            F.collect_set(F.struct("k1", "k2")).alias("bad")), "line-drops")

        def make():
            def drop(row):
                if row["text"] is None:
                    return None, 0
                gone = {np.array([b["k1"], b["k2"]], "<i8").tobytes() for b in row["bad"]}
                lines = row["text"].encode().split(b"\n")
                left = [line for line in lines if key(line) not in gone]
                return b"\n".join(left).decode(), len(lines) - len(left)
            return drop

        drop = common.struct_udf(make, "kept string, n_dropped bigint", pa.schema([("kept", pa.string()), ("n_dropped", pa.int64())]))
        found = named(docs).join(bad, ["t1", "t2"], "left")
        new = {"text": F.coalesce("done.kept", "text"), "n_lines": F.size(F.split("text", "\n")).cast("bigint"), "n_dropped": F.col("done.n_dropped")}
        own = [c for c in docs.columns if c.lower() not in new]
        return found.withColumn("done", drop(F.struct(F.when(F.col("bad").isNotNull(), F.col("text")).alias("text"), "bad"))).select(
            *[F.col("own")[c].alias(c) for c in own], *[c.alias(k) for k, c in new.items()])


def new_ledger(spark, least=LEAST):
    return LineLedger(spark, f"{shared_folder(spark)}/line-ledger-{uuid.uuid4().hex[:12]}", least)


def digest(docs):
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    return new_ledger(docs.sparkSession).insert(docs).clean(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, i, lines[i] AS line,
             translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT row, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
often AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
k AS (SELECT row, count(often.key) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '') AS kept
      FROM l LEFT JOIN often USING (key) GROUP BY row)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k USING (row)
"""
