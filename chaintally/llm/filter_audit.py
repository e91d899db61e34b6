"""Interaction of filters: what each step of every filter order removes, by recursion over mask cells.

Every text is judged once: a document becomes its part (language), one failure bit per filter and
its label flags. The corpus is then reduced to cells, the counts per part and bit mask, at most
2^5 a part; no later step sees a document. A recursive common table expression starts with the
masks that occur and an empty prefix, extends each prefix by every letter that it lacks, and
carries the bits applied so far. Each level emits, per prefix and mask, whether that step keeps,
removes or would have removed the cell; joined with the cells this is the step's metrics.
The recursion has at most 326 prefixes times 32 masks, whatever the corpus, and stays below
Spark's limit of recursive rows; only the cells grow, with the number of parts.

The copies of filter E are found by SHA-256 of the text: rows are counted by (text, part, flags,
doc_id) first, so that a group of copies reaches the task that compares its ids as one row per
task and part.

Defined results: a NULL text is empty, and equal to an empty one; a NULL language is the part '';
rows with a NULL doc_id have no smaller id, never fail E, are no one's original and have no label;
rows that repeat a doc_id all count, and do not make each other copies; a document is good or toxic
if any of its label rows says so, a document without labels is neither; very long texts are judged
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chaintally.session import stored

BLANK = " \t\n\x0b\f\r"
#: Filters in the order of their bits; E is decided over all documents.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")


def judged(docs):
    """doc_id, part, the bits of filters A to D, and the digest that names the text."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim("text", F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    cut = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("words", words)
    n = F.size("words")
    fails = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n,
             F.lit(100).cast("bigint") * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > F.lit(3).cast("bigint") * F.length("text"),
             F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return cut.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs, labels):
    """part, mask and the counts n, good and toxic of the documents that fail just the mask's filters."""
    flags = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    found = stored(judged(docs), "filter-bits").join(flags, "doc_id", "left")
    same = ["digest", "part", "bits", "good", "toxic", "named"]
    slim = found.select("doc_id", "digest", "part", "bits", F.col("doc_id").isNotNull().alias("named"),
                        *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])
    ids = slim.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    copies = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    # of the named rows, those with the least id of the text are originals
    split = copies.withColumn("original", F.when(~F.col("named"), F.col("n")).when(
        F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)).select("part", "bits", "good", "toxic", F.explode(F.array(
            F.struct(F.lit(0).alias("copy"), F.col("original").alias("n")),
            F.struct(F.lit(COPY).alias("copy"), (F.col("n") - F.col("original")).alias("n")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", F.col("bits").bitwiseOR(F.col("x.copy")).alias("mask")).agg(
        F.sum("x.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


_LETTERS = ", ".join(f"named_struct('name', '{c}', 'bit', {1 << i})" for i, c in enumerate(LETTERS))
STEPS = f"""
WITH RECURSIVE steps (prefix, step, applied, mask, kept, removed, redundant, unique_fails) AS (
  SELECT '', 0, 0, mask, true, false, false, false FROM {{masks}}
  UNION ALL
  SELECT concat(prefix, l.name), step + 1, applied | l.bit, mask, mask & (applied | l.bit) = 0,
         mask & l.bit <> 0 AND mask & applied = 0, mask & l.bit <> 0 AND mask & applied <> 0, mask = l.bit
  FROM (SELECT *, explode(filter(array({_LETTERS}), x -> applied & x.bit = 0)) AS l FROM steps WHERE step < {len(LETTERS)})
)
SELECT prefix, step, mask, kept, removed, redundant, unique_fails FROM steps WHERE step > 0
"""


def steps(found):
    """Per prefix of filters and occurring mask: what the last filter of the prefix does to the cell."""
    spark = found.sparkSession
    return spark.sql(STEPS, masks=found.select("mask").distinct())


def audit(found):
    """The metrics of every step of every order, per part, from the cells."""
    plan = stored(steps(found), "filter-steps")  # at most 325 prefixes of 32 masks

    def total(flag, n="n"):
        return F.coalesce(F.sum(F.when(F.col(flag), F.col(n))), F.lit(0)).alias(flag if n == "n" else f"{n}_lost")

    metrics = found.join(F.broadcast(plan), "mask").groupBy("part", "prefix", "step").agg(
        *[total(c) for c in ("kept", "removed", "redundant", "unique_fails")], total("removed", "good"), total("removed", "toxic"))
    orders = plan.filter(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at")).withColumn(
        "prefix", F.expr("left(filter_order, at)")).drop("at")
    rows = metrics.join(F.broadcast(orders), "prefix")
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", F.expr("right(prefix, 1)")))).drop("prefix")


def digest(docs, labels):
    """One row per part, filter_order and step with the contract's counts."""
    return audit(stored(cells(docs, labels), "filter-cells")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE letters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS original FROM t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN original < doc_id THEN 16 ELSE 0 END) AS mask
      FROM w LEFT JOIN l USING (doc_id)),
orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || name FROM orders, letters WHERE position(name IN filter_order) = 0),
s AS (SELECT filter_order, step, name, bit,
             (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE position(x.name IN left(filter_order, step - 1)) > 0) AS before
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5) JOIN letters ON name = filter_order[step]),
m AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, name,
             count(*) FILTER (mask & (CAST(before AS INTEGER) | bit) = 0) AS kept,
             count(*) FILTER (mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0) AS removed,
             count(*) FILTER (mask & bit <> 0 AND mask & CAST(before AS INTEGER) <> 0) AS redundant,
             count(*) FILTER (mask = bit) AS unique_fails,
             count(*) FILTER (mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 AND good) AS good_lost,
             count(*) FILTER (mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 AND toxic) AS toxic_lost
      FROM d, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM m
"""
