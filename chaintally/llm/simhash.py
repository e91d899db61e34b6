"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. Manhattan
distance between embeddings never exceeds the Hamming distance of the fingerprints, so texts
within ``DISTANCE`` bits lie within that range in the embedding. The range join runs on a grid:
the segments form six groups, of which at most three can differ, so any two such points share
a cell of at least one of the twenty grids that three groups span. Cells with more than one
distinct fingerprint are compared in numpy: first the Manhattan bound, then the exact distance.

A segment's count is written in unary (00, 01, 11), so the embedding is one 64-bit number, a
cell is a masked number, and Manhattan distance is a count of differing bits.

Equal fingerprints are one point. A cell gives a spanning forest of its links, never all pairs;
a cell of more than ``MOST`` points is dealt as pairs of blocks to many tasks, so that every pair
still meets in one of them. Components come from the forests.

Defined results: NULL texts count as empty; texts without words have fingerprint zero and are
linked to one another like any others; repeated rows are points of distance zero; a component
is named by its smallest doc_id, NULL if all are NULL; an empty table gives an empty result.
Further columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common
from chaintally.llm.components import components
from chaintally.session import stored

common.travels(__name__)

DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUPS = 6
#: Points of a cell compared in one task; a larger cell is split.
MOST = 2048
#: Cells up to this size are compared together, larger ones one by one.
SMALL = 48
#: Shingles hashed at once.
TOGETHER = 1 << 16


def shingle_hashes(data: bytes, length: int = SHINGLE):
    """Hashes of a text's runs of ``length`` words (of all words, if they are fewer), ``TOGETHER`` at once."""
    import xxhash

    words = data.lower().split()
    if not words:
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    text, n, digest = b" ".join(words), max(1, len(words) - length + 1), xxhash.xxh64_intdigest
    ends = ends[min(length, len(words)) - 1:]
    del words
    for i in range(0, n, TOGETHER):
        j = min(n, i + TOGETHER)
        yield np.array([digest(text[a:b], SEED) for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist())], np.uint64)


def fingerprint(data: bytes) -> int:
    """The signed 64-bit SimHash of a text's bytes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(column="text"):
    def run(batches):
        for batch in batches:
            yield pa.array([fingerprint(x) for x in batch.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(common.as_bytes(column))


def embedding(fp):
    """Segment bit counts in unary."""
    odd = F.lit(0x5555555555555555)
    up, down = F.call_function("shiftrightunsigned", fp, F.lit(1)).bitwiseAND(odd), fp.bitwiseAND(odd)
    return F.call_function("shiftleft", up.bitwiseAND(down), F.lit(1)).bitwiseOR(up.bitwiseOR(down))


def embed(x):
    """``embedding`` for numpy arrays of uint64."""
    odd = np.uint64(0x5555555555555555)
    up, down = (x >> np.uint64(1)) & odd, x & odd
    return ((up & down) << np.uint64(1)) | up | down


def grids(groups=GROUPS, distance=DISTANCE):
    """The masks of all choices of groups that can stay equal, as signed numbers."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]
    chosen = [sum(c) for c in combinations(masks, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def merge_roots(root, a, b):
    """``root`` (smallest node of each node's component) after adding the links a-b."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
    return root


def forest(points, cell, distance=DISTANCE):
    """(point, root) links of all points within the distance in the same cell; cells are runs of ``cell``."""
    embedded = embed(points)
    root = np.arange(len(points))

    def link(a, b):
        near = np.bitwise_count(embedded[a] ^ embedded[b]) <= distance  # the lower bound
        a, b = a[near], b[near]
        near = np.bitwise_count(points[a] ^ points[b]) <= distance
        merge_roots(root, a[near], b[near])

    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    left = np.repeat(sizes, sizes) - (np.arange(len(cell)) - np.repeat(starts, sizes)) - 1  # points behind, same cell
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        a = np.flatnonzero(small & (left >= d))
        if not len(a):
            break
        link(a, a + d)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for i in range(s, s + n, 64):
            a, b = np.arange(i, min(i + 64, s + n)), np.arange(i, s + n)
            near = np.nonzero(np.bitwise_count(embedded[a][:, None] ^ embedded[b][None]) <= distance)
            a, b = a[near[0]], b[near[1]]
            exact = (np.bitwise_count(points[a] ^ points[b]) <= distance) & (a < b)
            merge_roots(root, a[exact], b[exact])
    tied = np.flatnonzero(root != np.arange(len(root)))
    return points[tied], points[root[tied]]


def _compare(batches):
    """Forests of the cells of one sorted partition; a cell may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    points, cell, number = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    last = None

    def links(p, c):
        a, b = forest(p, c)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("grid", "cell", "i", "j")], 1)
        new = np.concatenate([[last is None or (keys[0] != last).any()], (keys[1:] != keys[:-1]).any(1)])
        numbers = number + np.cumsum(new)
        number, last = int(numbers[-1]), keys[-1]
        points = np.concatenate([points, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
        cell = np.concatenate([cell, numbers])
        full = np.searchsorted(cell, number)  # the last cell may go on
        if full:
            yield links(points[:full], cell[:full])
            points, cell = points[full:], cell[full:]
    if len(points):
        yield links(points, cell)


def links(points, most=MOST):
    """Links (a, b) between distinct fingerprints ``points (fp)`` that connect all within the distance."""
    spread = points.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("grid"), embedding(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell"))
        for k, m in enumerate(grids())])).alias("g")).select("g.grid", "g.cell", "fp")
    shared = spread.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / most).cast("int")
    dealt = spread.join(shared, ["grid", "cell"]).withColumns(
        {"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")}
    ).select("grid", "cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "grid", "cell", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    order = ["grid", "cell", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_duplicates(docs):
    """Per document: doc_id, text_hash, fp, root (a fingerprint of its component), component_id."""
    keys = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints().alias("fp")), "fingerprints")
    points = stored(keys.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    tied = components(links(points.select("fp"))).withColumnsRenamed({"a": "fp"})
    named = points.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(least, "root")
    return keys.join(of, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs):
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    return keep_first(docs, stored(near_duplicates(docs), "near-duplicates"))


def keep_first(docs, found):
    """The document with the smallest doc_id of each ``root`` in ``found (doc_id, text_hash, root)``."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    rows = found.groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("__rows"))
    chosen = first.join(rows, (first["root"] == rows["root"]) & first["first.doc_id"].eqNullSafe(rows["doc_id"])
                        & (first["first.text_hash"] == rows["text_hash"])).select(
        F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"), "__rows")
    whole = docs.select(F.struct(*docs.columns).alias("__own"), F.coalesce("doc_id", F.lit(0)).alias("__k"),
                        F.col("doc_id").isNull().alias("__none"), F.xxhash64("text").alias("__hash"))
    chosen = chosen.select(F.coalesce("__id", F.lit(0)).alias("__k"), F.col("__id").isNull().alias("__none"), "__hash", "__rows")
    kept = whole.join(chosen, ["__k", "__none", "__hash"])
    # rows of the same id and text are all chosen; of these few one stays
    twins = kept.filter("__rows > 1").dropDuplicates(["__k", "__none", "__hash"])
    return kept.filter("__rows = 1").unionByName(twins).select("__own.*")


def digest(docs):
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
