"""Orders, tops, shares and classes, without ever sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from chaintally.functions import wide
from chaintally.functions.columns import as_col, ratio
from chaintally.operators.flows import fits_broadcast
from chaintally.session import materialise, ordered


def latest_per_key(df, keys, order="date"):
    """The row with the greatest ``order`` per key (T20), as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_n(df, order, n=10):
    """The first ``n`` rows of an order (T22); each task keeps its own n before the merge."""
    return df.orderBy(*order).limit(n)


def topn_labels(n):
    return lambda rank: F.concat(F.lit("Top"), F.lpad(F.col(rank).cast("string"), len(str(n)), "0"))


def top_ranks(df, measure, part="date", key="address", n=10):
    """The ``n`` largest rows per ``part`` with their rank; ties go to the smaller key."""
    w = W.partitionBy(part).orderBy(F.col(measure).desc_nulls_last(), F.col(key).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def topn_with_others(df, measure, part="date", key="address", n=10, out=None):
    """The ``n`` largest keys per ``part`` under a label each, everything else summed.

    The filter on the rank lets every task cut to n rows per part before the shuffle, and
    the rest is the part's total less its top, so no part is ever gathered in one task.
    Ties go to the smaller key. NULL measures rank last and count as missing.
    """
    number = wide.of(df, measure)
    totals = number.settled(df.groupBy(part).agg(
        F.count(F.lit(1)).alias("_rows"), number.total(measure).alias("_all"),
        F.count(measure).alias("_filled")), "_all")
    return label_tops(top_ranks(df, measure, part, key, n), totals, F.col("_rows"), measure, part,
                      n, None, out)


def label_tops(top, totals, population, measure, part="date", n=10, fill=None, out=None):
    """Spread the top rows and the totals of each part over at most n + 1 labels.

    ``population`` is how many rows a part stands for, which may be more than it has: a dense
    frame would hold a row for every address on every day, most without activity. Those can
    only rank after the others, so they add labels here and no rows before. ``totals`` has
    the sum ``_all`` and the number ``_filled`` of rows that carry a value; ``fill`` is what
    a row without one is worth.
    """
    number = wide.of(top, measure)
    tops = top.groupBy(part).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", measure))).alias("_values"),
        number.total(measure).alias("_top"))
    slots = F.least(population, F.lit(n + 1)).cast("int")
    frame = totals.join(tops, part, "left").withColumn(
        "rank", F.explode(F.when(slots > 0, F.sequence(F.lit(1), slots))))
    frame = number.settled(frame.withColumn("_rest", number.minus("_all", "_top")), "_rest")
    rest = F.when(F.col("_filled") > n, F.col("_rest"))
    named = F.col("rank") <= n
    value = F.when(named, F.try_element_at("_values", "rank")).otherwise(rest)
    if fill is not None:
        value = F.coalesce(value, number.zero if fill == 0 else F.lit(fill))
    return frame.select(part, F.when(named, topn_labels(n)("rank")).otherwise("(Others)")
                        .alias("top10"), value.alias(out or measure))


def share_of_total(df, measure, part=None, out="share"):
    """Fraction of the total, over everything or per ``part``.

    The total is an aggregate with partial sums; a window over everything would bring all
    rows into one task, and one per day would bring all addresses of a day into one.
    """
    if part is None:
        total = df.agg(F.sum(measure).alias("t")).scalar()
        return df.withColumn(out, ratio(F.col(measure), total))
    totals = df.groupBy(part).agg(F.sum(measure).alias("_total"))
    totals = materialise(totals)
    if fits_broadcast(totals):
        totals = F.broadcast(totals)
    return (df.join(totals, part, "left").withColumn(out, ratio(measure, "_total")).drop("_total"))


def hhi(balance, measure="balance", part="date", out="hhi"):
    """Sum of squared shares per day (T24), as sum(b * b) / sum(b) ** 2 in one aggregate."""
    b = F.col(measure).cast("decimal(38,0)")
    square = F.col(measure).cast("double") * F.col(measure).cast("double")  # of any width
    sums = balance.groupBy(part).agg(F.sum(b).alias("_s"), F.sum(square).alias("_q"))
    return sums.select(part, hhi_ratio(F.col("_s"), F.col("_q")).alias(out))


def hhi_ratio(total, squares):
    total = total.cast("double")
    return F.try_divide(squares.cast("double"), total * total)


def global_order(df, order):
    """Rows sorted over the whole cluster, with their chunk and position inside it.

    The range sort samples its bounds, so the result is written to the checkpoint folder
    before anything else reads it: every later use, also after executors are lost, sees the
    same chunks, and in their order. Equal values are split between chunks when ``order`` ends
    in a unique key.
    """
    placed = ordered(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    return (placed.withColumn("_chunk", F.shiftrightunsigned("_place", 33))
            .withColumn("_pos", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("_place"))


def _chunk_offsets(ordered, weight):
    """What lies before each chunk. One row per partition of the sort, whatever the data."""
    sizes = ordered.groupBy("_chunk").agg(F.sum(weight).alias("_w"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("_chunk", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))


def cumulative_position(df, order, out="address_idx", dist="address_idx_cumulative_dist"):
    """Row number over everything and its fraction of the row count (T25), in that order.

    ``order`` must end in a unique key. Row number = rows in earlier chunks + position. The
    frame is sorted and written once, and the rows come out as they were sorted.
    """
    rows = global_order(df, order)
    offsets = _chunk_offsets(rows, F.lit(1).cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = rows.join(F.broadcast(offsets), "_chunk")
    return (placed.withColumn(out, F.col("_before") + F.col("_pos"))
            .withColumn(dist, F.col(out).cast("double") / total.cast("double"))
            .select(dist, out, *df.columns))


def middle(df, part, value, out="median"):
    """The median of ``value`` per ``part``: the least value that half of the rows do not exceed.

    Rows fold to one per part and value, and these are ordered over the whole cluster, so a
    part of any size is spread over as many tasks as it needs. The middle is then found by
    position: rows of the part in earlier chunks, plus a running count inside the chunk.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(part, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = global_order(counted, [F.col(part).asc_nulls_first(), F.col(value).asc()])
    sizes = rows.groupBy(part, "_chunk").agg(F.sum("_n").alias("_w"))
    by_part = W.partitionBy(part).orderBy("_chunk")
    # one row per part and chunk: no more than there are parts and chunks together
    bounds = sizes.select(
        F.col(part).alias("_part"), "_chunk",
        F.coalesce(F.sum("_w").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(W.partitionBy(part)).alias("_all"))
    upto = W.partitionBy("_chunk", part).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("_upto", F.sum("_n").over(upto)).withColumnRenamed("_chunk", "_at")
    found = found.join(F.broadcast(bounds), (found["_at"] == bounds["_chunk"]) & found[part].eqNullSafe(bounds["_part"]))
    place, want = F.col("_before") + F.col("_upto"), F.ceil(F.col("_all") / 2)
    return found.filter((place >= want) & (place - F.col("_n") < want)).select(part, F.col(value).alias(out))


def class_labels(bands=10):
    """'TOP 100%' for the lowest tenth up to 'TOP 10%' for the highest."""
    step = 100 // bands
    return [(i / bands, f"TOP {100 - (i - 1) * step}%") for i in range(1, bands + 1)]


def percentile_class(df, measure, value, key="address", bands=10,
                     names=("value_min", "value_max", "address_cnt")):
    """Bands of equal rank width with the range of ``value`` and the row count.

    Equal measures share a rank, so rows are first folded per distinct measure. A balance
    held by a third of all addresses is then one row, and the cluster-wide order is taken
    over distinct measures only.
    """
    folded = df.groupBy(F.col(measure).alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(key).alias("_keys"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = global_order(folded, [F.col("_m").asc_nulls_last()])
    offsets = _chunk_offsets(rows, F.col("_n"))
    inside = W.partitionBy("_chunk").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    smaller = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    total = rows.agg(F.sum("_n").alias("n")).scalar()
    ranked = (rows.join(F.broadcast(offsets), "_chunk")
              .withColumn("_smaller", smaller)
              .withColumn("_rank", F.when(total > 1, F.col("_smaller").cast("double")
                                          / (total - 1).cast("double")).otherwise(F.lit(0.0))))
    band = F.lit(None).cast("string")
    for edge, label in reversed(class_labels(bands)):
        band = F.when(F.col("_rank") <= edge, label).otherwise(band)
    lo, hi, cnt = names
    return (ranked.groupBy(band.alias("class"))
            .agg(F.min("_lo").alias(lo), F.max("_hi").alias(hi), F.sum("_keys").alias(cnt)))


def descending(column):
    return as_col(column).desc_nulls_last()


def ascending(column):
    return as_col(column).asc_nulls_last()
