"""Who was active on each day, as bitmaps, so that rolling counts of a new day read no old event.

Every key gets a number inside its hash bucket when it is first seen, and keeps it. A day is
then one bitmap per role, bucket and range of 32,768 numbers, built by Spark's bitmap aggregates.
Distinct keys of a window are the bits of the union of its days' bitmaps: exact, and the work
follows days and key ranges, not events. New days add their bitmaps and the numbers of new keys.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F, Window as W

from chaintally.operators.spines import fill_days
from chaintally.session import materialise
from chaintally.sources.layers import StaleLayer, add_row, rows_of

#: Hash buckets, in each of which new keys are numbered by one task.
BUCKETS = 256
MANIFEST = "generation int, opening date, through date, numbers string, days string"
NUMBERS = "bucket int, key string, number bigint"
DAYS = "date date, role string, bucket int, part bigint, bits binary"


class ActivityStore:
    """A folder with the active keys of every day; an empty folder is an empty store.

    Days up to ``through`` are final. A batch counts once its row stands in the manifest.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def generations(self):
        return sorted(rows_of(self.spark, f"{self.path}/manifest", MANIFEST), key=lambda r: r["generation"])

    def _read(self, known, column, schema):
        return self.spark.read.schema(schema).parquet(*[r[column] for r in known]) if known else self.spark.createDataFrame([], schema)

    def append(self, events, keys, through, at="date"):
        """Add the days after the last one, up to ``through``.

        ``events(since)`` gives rows from the day ``since`` on (None: all), ``keys`` maps an output suffix to a
        column of keys, and ``at`` is the column of the time.
        """
        known = self.generations()
        last = known[-1]["through"] if known else None
        if last is not None and through <= last:
            raise StaleLayer(f"the store already knows the days up to {last}")
        since = last + dt.timedelta(days=1) if last else None
        roles = [F.struct(F.lit(s).alias("role"), F.col(c).alias("key")) for s, c in keys.items()]
        seen = events(since).select(F.to_date(at).alias("date"), F.inline(F.array(*roles))).filter(F.col("date") <= F.lit(through))
        if since:
            seen = seen.filter(F.col("date") >= F.lit(since))
        seen = materialise(seen.distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")))
        numbers = self._read(known, "numbers", NUMBERS)
        most = numbers.groupBy("bucket").agg(F.max("number").alias("most"))
        fresh = seen.filter("key IS NOT NULL").select("bucket", "key").distinct().join(numbers, ["bucket", "key"], "left_anti")
        place = F.row_number().over(W.partitionBy("bucket").orderBy("key"))
        new = fresh.withColumn("place", place).join(F.broadcast(most), "bucket", "left").select(
            "bucket", "key", (F.col("place") + F.coalesce("most", F.lit(0))).cast("bigint").alias("number"))
        names = [f"{self.path}/{kind}-{uuid.uuid4().hex[:12]}" for kind in ("numbers", "days")]
        new.write.parquet(names[0])
        numbers = numbers.unionByName(self.spark.read.schema(NUMBERS).parquet(names[0]))
        bits = seen.join(numbers, ["bucket", "key"]).groupBy(
            "date", "role", "bucket", F.bitmap_bucket_number("number").alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        bits.repartition("date").sortWithinPartitions("date").write.parquet(names[1])
        opening = known[-1]["opening"] if known else None
        opening = opening or seen.agg(F.min("date")).first()[0]
        add_row(self.spark, f"{self.path}/manifest", MANIFEST, (len(known), opening, through, *names))
        return self

    def rolling(self, windows, suffixes, as_of, since=None):
        """Distinct keys of trailing windows for every day up to ``as_of``, from ``since`` on if given.

        ``windows`` maps an output prefix to a number of days. A bitmap is united with those of each window it
        belongs to; unions are taken on the map side first.
        """
        known = self.generations()
        if not known or as_of > known[-1]["through"]:
            raise StaleLayer(f"the store does not know {as_of}")
        opening = known[0]["opening"] or known[-1]["opening"]
        rows, first = self._read(known, "days", DAYS), max(since or opening, opening)
        reach = max(windows.values())
        rows = rows.filter(F.col("date").between(F.lit(first - dt.timedelta(days=reach - 1)), F.lit(as_of)))
        spans = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(n).alias("days")) for p, n in windows.items()])
        begin = F.greatest("date", F.lit(first).cast("date"))
        end = F.least(F.date_add("date", F.col("w.days") - 1), F.lit(as_of).cast("date"))
        days = rows.withColumn("w", F.explode(spans)).withColumn("day", F.explode(F.when(begin <= end, F.sequence(begin, end))))
        united = days.groupBy("day", "role", "w.name", "bucket", "part").agg(
            F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        columns = [(p, s, f"{p}_{s}" if s else p) for p in windows for s in suffixes]
        per_day = united.groupBy(F.col("day").alias("date")).agg(*[
            F.sum(F.when((F.col("name") == p) & (F.col("role") == s), F.col("n")).otherwise(0)).alias(c) for p, s, c in columns])
        names = [c for _, _, c in columns]
        start = self.spark.createDataFrame([(first, *[0] * len(names))], "date date, " + ", ".join(f"{c} bigint" for c in names))
        # one row per calendar day: days without an event in any window count zero
        counted = per_day.unionByName(start).groupBy("date").agg(*[F.max(c).alias(c) for c in names])
        return fill_days(counted, F.lit(as_of).cast("date"), on_day=names, absent=dict.fromkeys(names, 0))
