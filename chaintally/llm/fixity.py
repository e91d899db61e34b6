"""Merkle fixity audit of web-archive replicas.

Each page is one response record of a web-archive file; its bytes are hashed once. Records are
grouped into ranges of the file's offsets, a range's hash covers (offset, length, digest) of its
records in order, and every ``2 ** FAN`` neighbouring nodes hash into one above, up to one root
per file. Two replicas are compared from the roots down: a level joins only the children of
nodes that differ, and the records of differing ranges are compared one by one.

Group sizes are bounded: a range holds at most as many records as fit into its bytes, a node has
at most ``2 ** FAN`` children. Payloads are read once, where their digest is made, and no byte of
them is shuffled.

Defined results: a NULL payload is empty; NULL page numbers go to a file of their own; repeated
pages are records of their own, told apart by ``copy``; equal replicas and empty tables give no
rows; a record is `altered` (other bytes), `moved` (same bytes elsewhere), `missing` or `extra`.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from chaintally.session import stored

#: Pages to a file, offset bits of a range, and bits of the fan-out.
PAGES = 1000
RANGE = 16
FAN = 4
KEYS = ("file", "page_id", "copy")


def record_text(payload):
    """The record of a page: header, payload, two line ends."""
    size = F.octet_length(payload).cast("string")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def records(pages, record=None):
    """file, page_id, copy, offset, length, digest of every record; ``record`` is its whole text."""
    record = record_text(F.coalesce("html", F.lit(""))) if record is None else record
    hashed = pages.select(
        F.coalesce(F.floor(F.col("page_id") / PAGES), F.lit(-1)).alias("file"), "page_id",
        F.octet_length(record).cast("bigint").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"))
    order = ("page_id", "digest")
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(
        Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("copy", F.row_number().over(Window.partitionBy("file", "page_id").orderBy("offset")))


def _folded(nodes, bits):
    """Hashes of groups of ordered entries: one level of the tree."""
    entry = F.struct("at", "entry")
    return nodes.groupBy("file", F.call_function("shiftright", F.col("at"), F.lit(bits)).alias("node")).agg(
        F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(
            ":", e["at"].cast("string"), e["entry"]))).cast("binary"), 256).alias("hash"))


def depth(*replicas):
    """Levels above the ranges that give every file of all replicas one root."""
    most = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas)
    levels = 0
    while most >> (RANGE + FAN * levels):
        levels += 1
    return levels


def tree(found, levels):
    """level, file, node, hash of all nodes, stored; level 0 are the offset ranges."""
    nodes = _folded(found.select("file", F.col("offset").alias("at"), F.concat_ws(
        ":", F.col("length").cast("string"), "digest").alias("entry")), RANGE)
    parts = [stored(nodes, "ranges")]
    for _ in range(levels):
        parts.append(stored(_folded(parts[-1].select("file", F.col("node").alias("at"), F.col("hash").alias("entry")), FAN), "nodes"))
    return parts


def _differing(one, two):
    here, there = one.withColumnRenamed("hash", "one"), two.withColumnRenamed("hash", "two")
    return here.join(there, ["file", "node"], "full").filter(~F.col("one").eqNullSafe(F.col("two"))).select("file", "node")


def differing_ranges(one, two):
    """file, node of the offset ranges that differ, found from the roots down."""
    suspects = stored(_differing(one[-1], two[-1]), "suspects")
    for a, b in zip(one[-2::-1], two[-2::-1]):
        def below(level, suspects=suspects):
            return level.withColumn("up", F.call_function("shiftright", F.col("node"), F.lit(FAN))).join(
                suspects.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").select("file", "node", "hash")
        suspects = stored(_differing(below(a), below(b)), "suspects")
    return suspects


def audit(one, two):
    """Every record in which replica ``two`` differs from replica ``one`` (frames like ``records``)."""
    one, two = stored(one, "replica"), stored(two, "replica")
    levels = depth(one, two)
    ranges = differing_ranges(tree(one, levels), tree(two, levels)).withColumnRenamed("node", "__range")

    def inside(replica, suffix):
        at = F.call_function("shiftright", F.col("offset"), F.lit(RANGE)).alias("__range")
        found = replica.select("*", at).join(ranges, ["file", "__range"], "left_semi")
        return found.select(F.coalesce("page_id", F.lit(-1)).alias("__page"), "file", "copy", *[
            F.col(c).alias(f"{c}_{suffix}") for c in ("page_id", "offset", "length", "digest")])

    both = inside(one, "one").join(inside(two, "two"), ["file", "__page", "copy"], "full")
    same = F.col("digest_one") == F.col("digest_two")
    kind = (F.when(F.col("digest_two").isNull(), "missing").when(F.col("digest_one").isNull(), "extra")
            .when(~same, "altered").when(F.col("offset_one") != F.col("offset_two"), "moved"))
    # a moved record's other place may lie in a range that is equal up to it, so both sides are complete:
    # its old range lacks it and its new range has gained it
    return both.withColumn("status", kind).filter(F.col("status").isNotNull()).select(
        "file", F.coalesce("page_id_one", "page_id_two").alias("page_id"), "copy", "status", "offset_one", "offset_two",
        "length_one", "length_two", "digest_one", "digest_two")


#: Which pages of the second replica are damaged, for the registered query.
ROTTEN, ZEROED, LOST = (389, 7), (571, 11), (4093, 13)


def damaged(pages):
    """Records of a replica in which some headers rot, some payloads are zeroed and some records are lost."""
    def hit(rule):
        return F.coalesce(F.pmod("page_id", F.lit(rule[0])) == rule[1], F.lit(False))

    payload = F.coalesce("html", F.lit(""))
    whole = record_text(F.when(hit(ZEROED), F.repeat(F.lit("0"), F.octet_length(payload))).otherwise(payload))
    rotten = F.concat(F.lit("WARC/1.9"), F.substring(whole, 9, 2147483647))
    return records(pages.filter(~hit(LOST)), F.when(hit(ROTTEN), rotten).otherwise(whole))


def digest(pages):
    """Audit of the damaged replica of all pages against the sound one; -1 and "" where a side lacks the record."""
    return audit(records(pages), damaged(pages)).fillna(-1, ["offset_one", "offset_two", "length_one", "length_two"]).fillna(
        "", ["digest_one", "digest_two"])


#: The same result in DuckDB's SQL, by comparing all records.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1) AS file FROM pages),
r AS (SELECT 1 AS replica, file, page_id, url, html AS body, strlen(html) AS size, '0' AS v FROM p
      UNION ALL SELECT 2, file, page_id, url, CASE WHEN page_id % 571 = 11 THEN repeat('0', strlen(html)) ELSE html END, strlen(html),
             CASE WHEN page_id % 389 = 7 THEN '9' ELSE '0' END FROM p WHERE page_id IS NULL OR page_id % 4093 <> 13),
t AS (SELECT replica, file, page_id, 'WARC/1.' || v || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
      || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(size AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || body || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM r),
h AS (SELECT replica, file, page_id, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS digest FROM t),
p2 AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY replica, file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY replica, file, page_id ORDER BY "offset") AS INTEGER) AS copy FROM p2)
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.copy, b.copy) AS copy,
       CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'altered' ELSE 'moved' END AS status,
       coalesce(a."offset", -1) AS offset_one, coalesce(b."offset", -1) AS offset_two, coalesce(a.length, -1) AS length_one,
       coalesce(b.length, -1) AS length_two, coalesce(a.digest, '') AS digest_one, coalesce(b.digest, '') AS digest_two
FROM (SELECT * FROM o WHERE replica = 1) a FULL JOIN (SELECT * FROM o WHERE replica = 2) b
  ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.copy = b.copy
WHERE a.digest IS NULL OR b.digest IS NULL OR a.digest <> b.digest OR a."offset" <> b."offset"
"""
