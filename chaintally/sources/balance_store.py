"""Balances of one token as intervals of days, grown by the new days alone.

A balance stands still between two active days of an address, so its history is a list of
intervals ``(address, first, last, balance)``. The store keeps the finished ones, which never
change, and a snapshot of the open ones: one row per address with its latest balance. A new
day's flows meet the snapshot, close the intervals of the addresses they touch and open new
ones; no earlier event and no finished interval is read, and rows of untouched addresses are not
written again.

Finished intervals lie in folders by the blocks of days that they begin and end in, which is the
index: a day is found in the folders whose blocks span it, without expanding anything.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F, Window as W

from chaintally.functions import wide
from chaintally.operators import balances, flows
from chaintally.session import materialise
from chaintally.sources.layers import StaleLayer, add_row, rows_of

#: Days to a block of the index; days that one row expands to in a task; snapshots that are read before they are folded.
BLOCK, PIECE, FOLD = 32, 128, 16
MANIFEST = "generation int, opening date, through date, finished string, open string, since int"
_EPOCH = dt.date(1970, 1, 1)


def _block(day):
    return F.floor(F.datediff(day, F.lit(_EPOCH)) / BLOCK).cast("int")


class BalanceStore:
    """A folder with the balances of a token's addresses; an empty folder is an empty store.

    ``append`` takes the flows of days that the store does not have yet. Days up to ``through``
    are final: events that arrive for them later are not seen, and asking for a later day
    raises ``StaleLayer``. A batch counts once its row stands in the manifest.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def generations(self):
        """One small row per append, oldest first."""
        return sorted(rows_of(self.spark, f"{self.path}/manifest", MANIFEST), key=lambda r: r["generation"])

    @property
    def through(self):
        """The last day that the store knows, or None."""
        known = self.generations()
        return known[-1]["through"] if known else None

    def append(self, legs, through):
        """Add the days after the last one, up to ``through``.

        ``legs(since)`` gives the signed flows (date, address, transfer_amount) from the day ``since`` on
        (None: all of them), so that the cut reaches the scan of the events.
        """
        known = self.generations()
        last = known[-1]["through"] if known else None
        if last is not None and through <= last:
            raise StaleLayer(f"the store already knows the days up to {last}")
        since = last + dt.timedelta(days=1) if last else None
        new = legs(since).filter(F.col("date") <= F.lit(through))
        if since:
            new = new.filter(F.col("date") >= F.lit(since))
        net = materialise(flows.net_flows(new))
        opening = known[-1]["opening"] if known else None
        opening = opening or net.agg(F.min("date")).first()[0]
        names = [f"{self.path}/{kind}-{uuid.uuid4().hex[:12]}" for kind in ("finished", "open")]
        spans = materialise(self._spans(net, opening, known))
        done = spans.filter("last IS NOT NULL").withColumns({"first_block": _block(F.col("first")), "last_block": _block(F.col("last"))})
        done.repartition("first_block", "last_block").write.partitionBy("first_block", "last_block").parquet(names[0])
        changed = spans.filter("last IS NULL").select("address", "first", "balance")
        fold = len(known) - (known[-1]["since"] if known else 0) >= FOLD
        if fold:
            held = self._open()
            changed = held.join(changed.select("address"), "address", "left_anti").unionByName(changed)
        changed.write.parquet(names[1])
        since_generation = len(known) if fold or not known else known[-1]["since"]
        add_row(self.spark, f"{self.path}/manifest", MANIFEST, (len(known), opening, through, *names, since_generation))
        return self

    def _spans(self, net, opening, known):
        """Intervals that the new flows finish, and, without an end, those that they open."""
        active = balances.active_balances(net)
        number = wide.of(active, "balance")
        if known:
            held = self._open().select("address", F.col("first").alias("_since"), F.col("balance").alias("_held"))
            held = held.join(net.select("address").distinct(), "address", "left_semi")
            active = active.join(held, "address", "left")
            for c in ("balance", "prev_balance"):
                active = number.settled(active.withColumn(c, number.plus(c, number.or_zero("_held"))), c)
        else:
            active = active.withColumn("_since", F.lit(None).cast("date"))
        start = F.coalesce("_since", F.lit(opening).cast("date"))
        begins = F.lag("date").over(W.partitionBy("address").orderBy("date")).isNull()
        before = F.struct(start.alias("first"), F.date_sub("date", 1).alias("last"), F.col("prev_balance").alias("balance"))
        now = F.struct(F.col("date").alias("first"), F.date_sub("next_date", 1).alias("last"), F.col("balance"))
        rows = active.withColumn("_x", F.when(begins, F.array(before, now)).otherwise(F.array(now)))
        return rows.select("address", F.inline("_x")).filter("last IS NULL OR first <= last")

    def _open(self):
        """(address, first, balance): the newest open interval of each address."""
        known = self.generations()
        rows = [self.spark.read.parquet(r["open"]).withColumn("_g", F.lit(r["generation"]))
                for r in known[known[-1]["since"]:]]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        if len(rows) == 1:
            return every.drop("_g")
        newest = F.max_by(F.struct("first", "balance"), "_g").alias("_x")
        return every.groupBy("address").agg(newest).select("address", "_x.*")

    def _known(self, day=None):
        known = self.generations()
        if not known:
            raise StaleLayer("the store is empty")
        if day is not None and day > known[-1]["through"]:
            raise StaleLayer(f"the store knows the days up to {known[-1]['through']}, not {day}")
        return known

    def _finished(self, known):
        """Finished intervals of all batches, with the blocks as columns of the folders."""
        kind = self.spark.read.parquet(known[0]["open"]).schema["balance"].dataType.simpleString()
        columns = f"address string, first date, last date, balance {kind}, first_block int, last_block int"
        rows = [self.spark.read.schema(columns).parquet(r["finished"]) for r in known]  # a batch may have finished none
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return every

    def intervals(self, through=None):
        """(address, first, last, balance) up to a day; intervals of an address cover the calendar without overlap."""
        known = self._known(through)
        end = F.lit(through or known[-1]["through"]).cast("date")
        columns = ("address", "first", "last", "balance")
        done = self._finished(known).select(*columns)
        held = self._open().withColumn("last", F.lit(known[-1]["through"]).cast("date")).select(*columns)
        return done.unionByName(held).filter(F.col("first") <= end).withColumn("last", F.least("last", end))

    def on_day(self, day):
        """(address, balance) on one day, from the folders whose blocks span it."""
        known = self._known(day)
        at, block = F.lit(day).cast("date"), (day - _EPOCH).days // BLOCK
        done = self._finished(known).filter((F.col("first_block") <= block) & (F.col("last_block") >= block)
                                            & (F.col("first") <= at) & (F.col("last") >= at))
        held = self._open().filter(F.col("first") <= at)
        return done.select("address", "balance").unionByName(held.select("address", "balance"))

    def daily(self, through=None):
        """(date, address, balance) for every day: the grid. Long intervals are cut and spread over tasks first."""
        rows = self.intervals(through)
        cut = rows.withColumn("_from", F.explode(F.expr(f"sequence(first, last, INTERVAL {PIECE} DAYS)")))
        spread = cut.repartition("address", "_from")
        days = F.sequence("_from", F.least(F.col("last"), F.date_add("_from", PIECE - 1)))
        return spread.select(F.explode(days).alias("date"), "address", "balance")
