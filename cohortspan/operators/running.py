"""Totals over date intervals without pairing rows.

A sum over ``[lo, hi]`` is the running total at ``hi`` minus the one on the day
before ``lo``. Running totals are kept per key and calendar day, so even a key
that holds a third of all rows is reduced by the map-side combine to at most one
row per day before its window is sorted. For lookups they are one array per key, the
ledger: each row meets it in one join and finds its days by bisection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(events: DataFrame, at: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str]) -> DataFrame:
    """Inclusive running totals per key on every day of ``at``."""
    # events that come grouped by key and day are not shuffled again for this
    daily = events.groupBy(*keys, day).agg(*[F.sum(m).alias(m) for m in measures]).withColumn("_asked", F.lit(False))
    asked = at.select(*keys, day).distinct().withColumn("_asked", F.lit(True))
    # within a day the question sorts after the events
    upto = Window.partitionBy(*keys).orderBy(day, "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = daily.unionByName(asked, allowMissingColumns=True)
    totals = both.select(*keys, day, "_asked", *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in measures])
    return totals.filter("_asked").drop("_asked")


def with_ledger(df: DataFrame, events: DataFrame, keys: Sequence[str], measures: Sequence[str], day: str = "day") -> DataFrame:
    """Add ``_days`` and ``_ledger``, the key's days in order and their running totals, and ``_steps`` for :func:`entries_upto`.

    ``events`` have about one row per key and day, so a ledger is no longer than the calendar. The rows
    move once, as they are; keys without events have nulls.
    """
    keys = list(keys)
    # rows of one day share their total
    upto = Window.partitionBy(*keys).orderBy(day)
    running = [F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in measures]
    entries = events.filter(F.col(day).isNotNull()).select(*keys, F.struct(F.col(day).alias("day"), *running).alias("_entry"))
    ledgers = entries.groupBy(*keys).agg(F.sort_array(F.collect_list("_entry")).alias("_ledger"))
    steps = F.expr("transform(sequence(length(bin(size(_ledger))) - 1, 0, -1), k -> shiftleft(1, k))")
    ledgers = ledgers.select(*keys, F.col("_ledger.day").alias("_days"), F.transform("_ledger", lambda e: F.struct(*[e[m].alias(m) for m in measures])).alias("_ledger"), steps.alias("_steps"))
    # with a second join key both sides are dealt anew, so that adaptive execution can split the rows of a hot key
    dealt = F.xxhash64(*keys)
    found = df.withColumn("_dealt", dealt).join(ledgers.withColumn("_dealt", dealt), [*keys, "_dealt"], "left")
    return found.select(*df.columns, "_days", "_ledger", "_steps")


def entries_upto(dates: Column) -> Column:
    """The ledger's last entry of a day up to each of the ``dates``, by bisection; null if there is none."""
    days = F.col("_days")

    def entry(date: Column) -> Column:
        place = F.aggregate("_steps", F.lit(-1), lambda at, step: F.when(F.get(days, at + step) <= date, at + step).otherwise(at))
        return F.get("_ledger", place)

    return F.transform(dates, entry)


def totals_at(df: DataFrame, events: DataFrame, keys: Sequence[str], days: dict[str, Column], measures: Sequence[str], day: str = "day") -> DataFrame:
    """Add ``{measure}@{name}``: the running total on each named day of the row; null without a day or key."""
    found = with_ledger(df, events, keys, measures, day)
    dates = F.array(*days.values())
    found = found.select(*df.columns, dates.alias("_dates"), entries_upto(dates).alias("_entries"))

    def total(i: int, m: str) -> Column:
        known = F.col("_dates")[i].isNotNull()
        for key in keys:
            known = known & F.col(key).isNotNull()
        return F.when(known, F.coalesce(F.col("_entries")[i][m], F.lit(0)))

    return found.select(*df.columns, *[total(i, m).alias(f"{m}@{name}") for i, name in enumerate(days) for m in measures])


def between(measure: str, before: str, upto: str) -> Column:
    """Total after the day named ``before`` and up to the day named ``upto``."""
    return F.coalesce(F.col(f"`{measure}@{upto}`") - F.col(f"`{measure}@{before}`"), F.lit(0))


def interval_totals(
    intervals: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    measures: Sequence[str],
    day: str = "day",
) -> DataFrame:
    """Add the event totals of the closed date interval ``[lo, hi]`` to each row; 0 if ``hi`` precedes ``lo``."""
    found = totals_at(intervals, events, keys, {"before": F.date_sub(lo, 1), "upto": F.col(hi)}, measures, day)
    inverted = F.col(hi) < F.col(lo)
    return found.select(*intervals.columns, *[F.when(inverted, 0).otherwise(between(m, "before", "upto")).alias(m) for m in measures])
