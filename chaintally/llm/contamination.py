"""Benchmark decontamination: broadcast windows of test words, scan training windows, verify.

Texts are lower-cased (A-Z) and cut into words. A benchmark item of at least ``size`` words
gives all its windows of ``size`` words; a shorter one is a single window. The distinct windows
become integer rows over the benchmark's own vocabulary with a sorted table of hashes. It is
broadcast only in pieces of at most ``most_windows`` windows: a larger benchmark is scanned in
several passes, each over all documents. Every hash hit is verified word by word.

Defined results: NULL or empty texts have no words and no hits; items without a word are
ignored; repeated items each count; an empty benchmark or table gives no hits or no rows;
result columns replace input columns of the same name, every other column is kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common

common.travels(__name__)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
WINDOW = 10
#: Windows broadcast at once; one takes about 100 bytes.
MOST_WINDOWS = 500_000
#: Benchmark texts are cut into blocks of so many windows before they are dealt to passes.
BLOCK = 10_000

FIELDS = pa.schema([
    ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.int32()))])


def words_of(data: bytes):
    for _, part in common.slices(data, BREAK):
        yield WORD.findall(part.lower())


class Windows:
    """Distinct windows as rows of word numbers, by length, with their owners."""

    def __init__(self, blocks, size):
        self.vocabulary, self.owners, rows = {}, [], {}
        number = {}
        for item, words in blocks:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1):
                window = tuple(ids[i:i + n])
                k = number.get(window)
                if k is None:
                    k = number[window] = len(self.owners)
                    self.owners.append(set())
                    rows.setdefault(n, []).append(k)
                self.owners[k].add(item)
        keys = list(number)
        self.tables = {n: self._table(np.array([keys[k] for k in of], np.int64), np.array(of)) for n, of in rows.items()}

    @staticmethod
    def _table(ids, numbers):
        """Sorted hashes of all rows under the first multiplier that keeps them apart."""
        for seed in range(3, 1000, 2):
            weights = np.cumprod(np.full(ids.shape[1], 0x9E3779B97F4A7C15 + 2 * seed, np.uint64))
            hashes = ((ids + 1).astype(np.uint64) * weights).sum(1)
            order = np.argsort(hashes)
            if len(ids) < 2 or (np.diff(hashes[order]) > 0).all():
                return weights, hashes[order], ids[order], numbers[order]
        raise ValueError("no multiplier separates the windows")

    def scan(self, data: bytes):
        """Number of words, items with a window here, and [first, last + 1] runs of words that are hit."""
        get = self.vocabulary.get
        parts = [np.fromiter([get(w, -1) for w in part], np.int64, len(part)) for part in words_of(data)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        cover, found = np.zeros(len(ids) + 1, np.int64), set()
        for n, (weights, hashes, rows, numbers) in self.tables.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            hash_ = np.zeros(len(at), np.uint64)
            for j in range(n):
                hash_ += (ids[at + j] + 1).astype(np.uint64) * weights[j]
            k = np.minimum(np.searchsorted(hashes, hash_), len(hashes) - 1)
            like = hashes[k] == hash_
            at, k = at[like], k[like]
            same = (rows[k] == ids[at[:, None] + np.arange(n)]).all(1)
            at, k = at[same], k[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            found.update(numbers[k].tolist())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]))) if found else ()
        return len(ids), sorted({item for k in found for item in self.owners[k]}), [int(x) for x in edges]


def _blocks(benchmark, size):
    """(item, part, words): each text in blocks that overlap by a window less one word."""

    def cut(batches):
        for batch in batches:
            out = {"item": [], "part": [], "words": []}
            for item, data in zip(batch["item"].to_pylist(), batch["data"].to_pylist()):
                words = [w for part in words_of(data) for w in part]
                for k, i in enumerate(range(0, max(1, len(words) - size + 1), BLOCK)):
                    if words:
                        out["item"].append(item)
                        out["part"].append(k)
                        out["words"].append(words[i:i + BLOCK + size - 1])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("item", pa.string()), ("part", pa.int32()), ("words", pa.list_(pa.binary()))]))

    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.as_bytes().alias("data")
    ).mapInArrow(cut, "item string, part int, words array<binary>")


def scan(docs, benchmark, size=WINDOW, most_windows=MOST_WINDOWS):
    """``docs`` with n_words, n_hit, items (sorted texts), runs (word ranges hit), contaminated."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, size)
    total = blocks.agg(F.sum(F.greatest(F.lit(1), F.size("words") - size + 1))).first()[0] or 0
    passes = max(1, -(-total // most_windows))
    hits = []
    for k in range(passes):
        mine = blocks.filter(F.pmod(F.xxhash64("item", "part"), F.lit(passes)) == k) if passes > 1 else blocks
        table = Windows([(r["item"], [bytes(w) for w in r["words"]]) for r in mine.toLocalIterator()], size)
        sent = spark.sparkContext.broadcast(table)
        hits.append(common.struct_udf(
            lambda sent=sent: sent.value.scan, "n_words bigint, items array<string>, runs array<int>", FIELDS))
    data = common.as_bytes()
    out = docs.withColumns({f"__hit{k}": found(data) for k, found in enumerate(hits)})
    runs = F.flatten(F.array(*[_pairs(f"__hit{k}.runs") for k in range(passes)]))
    return out.withColumns({
        "n_words": F.col("__hit0.n_words"),
        "items": F.array_sort(F.array_distinct(F.flatten(F.array(*[f"__hit{k}.items" for k in range(passes)])))),
        "runs": _merged(runs) if passes > 1 else runs,
    }).withColumns({
        "n_hit": F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["to"] - r["from"]),
        "contaminated": F.size("runs") > 0,
    }).drop(*[f"__hit{k}" for k in range(passes)])


def _pairs(edges):
    """[from, to, from, to, …] as ranges."""
    n = (F.size(edges) / 2).cast("int")
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get(edges, 2 * i).alias("from"), F.get(edges, 2 * i + 1).alias("to")))


def _merged(runs):
    """Disjoint ranges in order, from the ranges of several passes."""
    empty = F.array().cast("array<struct<from:int,to:int>>")
    return F.aggregate(F.array_sort(runs), empty, lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["to"] >= r["from"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["from"].alias("from"),
            F.greatest(F.element_at(done, -1)["to"], r["to"]).alias("to"))))
    ).otherwise(F.concat(done, F.array(r))))


def remove_documents(docs, benchmark, **options):
    """The documents that no benchmark window touches, with their own columns."""
    own = docs.columns
    marked = scan(docs.withColumn("__own", F.struct(*own)), benchmark, **options)
    return marked.filter(~F.col("contaminated")).select("__own.*")


def remove_spans(docs, benchmark, **options):
    """All documents; the words that a window covers are cut out of the text, with what lies between them."""
    own = docs.columns

    def make():
        def cut(row):
            data, runs = row["data"], row["runs"]
            if not runs:
                return (data,)
            bounds = [(o + m.start(), o + m.end()) for o, part in common.slices(data, BREAK) for m in WORD.finditer(part.lower())]
            kept, last = [], 0
            for run in runs:
                kept.append(data[last:bounds[run["from"]][0]])
                last = bounds[run["to"] - 1][1]
            return (b"".join([*kept, data[last:]]),)
        return cut

    cut = common.struct_udf(make, "data binary", pa.schema([("data", pa.binary())]))
    marked = scan(docs.withColumn("__own", F.struct(*own)), benchmark, **options)
    text = cut(F.struct(common.as_bytes("__own.text").alias("data"), "runs"))["data"].cast("string")
    return marked.select(*[
        F.when(F.size("runs") > 0, text).otherwise(F.col("__own.text")).alias("text") if c == "text" else F.col("__own")[c].alias(c)
        for c in own])


def digest(docs, benchmark):
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.row, dw.i, dw.n, win.item FROM dw JOIN win ON win.n = dw.n AND win.win = list_slice(dw.w, dw.i, dw.i + dw.n - 1)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
