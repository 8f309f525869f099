"""Running totals and neighbours along one global order.

A window without a partition key would sort everything in one task. Instead the
ordered values are cut into ranges, each range gets its own window, and the
short table of range totals carries the state from one range to the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.session import durable

Expansion = Callable[[DataFrame, Sequence[str]], DataFrame]


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: increasing with ``order``; equal values share a range.

    The cut points are approximate quantiles found on the executors, so ranges are
    even however the values cluster; there are as many as shuffle partitions, unless
    given. NaN is larger than any number, as in Spark's order, and has the last range
    to itself.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_columns(df, [order], ranges).withColumnRenamed("_range0", "_range")


def cut_columns(df: DataFrame, columns: Sequence[str], ranges: int) -> DataFrame:
    """Add ``_range0``, ``_range1`` ...: the ranges of several columns, cut on their own; null for null."""
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    number = [F.col(c).cast("double") for c in columns]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), steps, 4 * ranges).alias(f"_{i}") for i, c in enumerate(number)]).first()
    cutter = Bucketizer(
        splitsArray=[[-math.inf, *(sorted({c for c in found[i] or [] if math.isfinite(c)}) or [0.0]), math.inf] for i in range(len(columns))],
        inputCols=[f"_order{i}" for i in range(len(columns))], outputCols=[f"_bucket{i}" for i in range(len(columns))], handleInvalid="keep",
    )
    cut = cutter.transform(df.withColumns({f"_order{i}": c for i, c in enumerate(number)}))
    cut = cut.withColumns({f"_range{i}": F.when(F.col(c).isNotNull(), F.col(f"_bucket{i}").cast("int")) for i, c in enumerate(columns)})
    return cut.drop(*[f"{name}{i}" for name in ("_order", "_bucket") for i in range(len(columns))])


#: Ranges that the values of a column are cut into for quantiles of groups, at least.
LEAST_RANGES = 64


def group_statistics(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float], expand: Expansion, weight: str) -> DataFrame:
    """Count, sum, mean, deviation and exact quantiles of several columns for many groups at once.

    ``expand(df, columns)`` gives the rows of the groups: ``keys`` and the columns, a row of ``df``
    being in any number of groups. Gives keys, ``cell`` (the column's place), n, sum, mean, stddev,
    weight (sum of the ``weight`` column over non-null values) and q0, q1 ... for the ``shares``:
    the smallest value that the share of the group's values do not exceed. Null values are left out.

    ``df`` is read three times. Each column is cut into ranges, and the groups' values are reduced to one row per range on the
    map side. Running counts over those rows say which ranges hold the wanted ranks; only their
    values are read again, reduced to distinct ones and ordered within the range. So no group's
    values meet in one task, and no more than a range's distinct values are sorted.
    """
    ranges = max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = cut_columns(df, columns, ranges)
    values = [F.struct(F.col(f"_range{i}").alias("_range"), F.col(c).alias("_v")) for i, c in enumerate(columns)]
    names = [weight, *columns, *[f"_range{i}" for i in range(len(columns))]]
    rows = expand(cut, names).select(*keys, F.col(weight).alias("_weight"), F.posexplode(F.array(*values)).alias("cell", "_value"))
    rows = rows.select(*keys, "cell", "_weight", "_value.*").filter(F.col("_v").isNotNull())
    group = [*keys, "cell"]
    parts = durable(rows.groupBy(*group, "_range").agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var"), F.sum("_weight").alias("_weight"),
    ))
    whole = Window.partitionBy(*group)  # one row per range
    total = F.sum(F.col("_mean") * F.col("_n")).over(whole) / F.sum("_n").over(whole)
    squares = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_total"), 2)))
    statistics = parts.withColumn("_total", total).groupBy(*group).agg(
        F.sum("_n").alias("n"), F.sum("_sum").alias("sum"), F.sum("_weight").alias("weight"),
        F.max("_total").alias("mean"), F.sqrt(F.try_divide(squares, F.sum("_n") - 1)).alias("stddev"),
    )
    upto = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(*[F.struct(F.lit(i).alias("_share"), F.greatest(F.lit(1), F.ceil(F.sum("_n").over(whole) * s)).alias("_rank")) for i, s in enumerate(shares)])
    wanted = parts.select(*group, "_range", "_n", upto.alias("_upto"), wanted.alias("_w")).select("*", F.inline("_w")).drop("_w")
    wanted = wanted.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    wanted = durable(wanted.select(*group, "_range", "_share", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_place")))
    places = wanted.groupBy(*group, "_range").agg(F.collect_list(F.struct("_share", "_place")).alias("_places"))
    if wanted.count() <= BROADCAST_VALUES:
        places = F.broadcast(places)
    # the array of places joins after the counting: with it the rows would be sorted, not hashed
    chosen = rows.select(*group, "_range", "_v").join(places, [*group, "_range"], "left_semi").groupBy(*group, "_range", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = chosen.withColumn("_upto", F.sum("_n").over(inside)).join(places, [*group, "_range"])
    found = counted.select(*group, "_v", "_n", "_upto", F.inline("_places"))
    found = found.filter((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_n")))
    quantiles = found.groupBy(*group).agg(*[F.max(F.when(F.col("_share") == i, F.col("_v"))).alias(f"q{i}") for i in range(len(shares))])
    return statistics.join(quantiles, group)


def running_count(df: DataFrame, order: str, n: str, ranges: int | None = None, name: str = "before") -> DataFrame:
    """Sum of ``n`` over all rows with a smaller ``order`` (one row per value)."""
    cut = with_ranges(df, order, ranges)
    # one row per range
    whole = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_range")
        .agg(F.sum(n).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_range")
    )


def dealt_in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in as many stored ranges of ``order`` as shuffle partitions, numbered by ``_range``.

    Equal values of the first columns may lie in several ranges, so that none is too large.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))


def ranks(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank of rows within their key, of rows dealt by (keys, order).

    Each range numbers its own rows of a key; the counts of earlier ranges are added.
    """
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = dealt.withColumn("_own", F.row_number().over(inside))
    return own.join(bases, [*keys, "_range"]).withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base")


#: Most rows of a table of values that is sent to every executor.
BROADCAST_VALUES = 200_000
#: Beyond it, a value that holds more than one in HOT rows is dealt out to parts of one in HOT rows each.
HOT = 1000


def join_values(df: DataFrame, values: DataFrame, on: str, size: int | None = None) -> DataFrame:
    """Join rows with a table of one row per value; a few values may hold most rows.

    The table's ``size`` is given or counted: up to BROADCAST_VALUES rows are broadcast. A
    larger table is joined on the value and, for the hot values, a salt; there are fewer than
    HOT of them, so their list is broadcast. Either way the result is the same.
    """
    if size is None:
        values = durable(values)
        size = values.count()
    if size <= BROADCAST_VALUES:
        return df.join(F.broadcast(values), on)
    rows = df.groupBy(on).agg(F.count("*").alias("_rows"))
    share = F.col("_rows") * HOT / rows.agg(F.sum("_rows")).scalar()
    hot = durable(rows.withColumn("_salts", F.ceil(share).cast("int")).filter("_salts > 1").select(on, "_salts"))

    def salts(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(hot), on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    dealt = salts(df).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_salts")).cast("int")).drop("_salts")
    copied = salts(values).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(copied, [on, "_salt"]).drop("_salt")
