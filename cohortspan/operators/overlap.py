"""Overlapping pathways, counted without pairing them.

With running counts of clock starts and clock stops per key and day, the number
of intervals that overlap ``[start, stop]`` is the starts before its stop minus
the stops up to its start. The work grows with rows, not with pairs, and a key
that holds a third of the rows is first reduced to one row per calendar day.
Intervals must have ``start <= stop``; rows with a null date never overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.running import running_totals


def overlap_counts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    start: str = "start_date",
    stop: str = "stop_date",
    closed: bool = False,
    name: str = "overlaps",
) -> DataFrame:
    """Add to each left row the number of right intervals that overlap it.

    Open (default): ``l.start < r.stop and l.stop > r.start``. ``closed`` also
    counts intervals that only touch.
    """
    keys = list(keys)
    valid = right.filter(F.col(start) <= F.col(stop))
    events = valid.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("day"), F.lit(1).alias("_starts"), F.lit(0).alias("_stops"), F.lit(0).alias("_points")),
                F.struct(
                    F.col(stop).alias("day"),
                    F.lit(0).alias("_starts"),
                    F.lit(1).alias("_stops"),
                    (F.col(start) == F.col(stop)).cast("int").alias("_points"),
                ),
            )
        ),
    )
    # last day on which an overlapping interval may start, first day by which
    # an interval that does not overlap must have stopped
    upper = F.col(stop) if closed else F.date_sub(stop, 1)
    lower = F.date_sub(start, 1) if closed else F.col(start)
    asked = left.withColumns({"_upper": upper, "_lower": lower})
    at = asked.select(*keys, F.explode(F.array("_upper", "_lower")).alias("day")).filter(F.col("day").isNotNull())
    counts = running_totals(events, at, keys, "day", ["_starts", "_stops", "_points"])
    at_upper = counts.select(*keys, F.col("day").alias("_upper"), "_starts", F.col("_points").alias("_points_upper"))
    at_lower = counts.select(*keys, F.col("day").alias("_lower"), "_stops", F.col("_points").alias("_points_lower"))
    found = F.col("_starts") - F.col("_stops")
    if not closed:
        # an empty interval overlaps none; undo the points counted on its own day
        same_day = F.col(start) == F.col(stop)
        found = found + F.when(same_day, F.col("_points_lower") - F.col("_points_upper")).otherwise(0)
    return (
        asked.join(at_upper, [*keys, "_upper"], "left")
        .join(at_lower, [*keys, "_lower"], "left")
        .select(*left.columns, F.when(F.col(start) <= F.col(stop), F.coalesce(found, F.lit(0))).otherwise(0).alias(name))
    )


def with_overlaps(
    df: DataFrame, keys: Sequence[str], identity: str | None = "pathway_id", unique: bool = False, name: str = "overlaps"
) -> DataFrame:
    """Overlaps of each row with rows of another identity and the same keys.

    ``unique`` says that no two rows share an identity; the row itself is then
    the only one to leave out. Otherwise the overlaps within the identity are
    counted as well and subtracted.
    """
    counted = overlap_counts(df, df, keys, name="_all")
    if unique or identity is None:
        itself = F.when(F.col("start_date") < F.col("stop_date"), 1).otherwise(0)
        return counted.withColumn(name, F.col("_all") - itself).drop("_all")
    both = overlap_counts(counted, df, [*keys, identity], name="_same")
    return both.withColumn(name, F.col("_all") - F.col("_same")).drop("_all", "_same")


def overlapping(df: DataFrame, keys: Sequence[str], columns: Sequence[str], unique: bool = False) -> DataFrame:
    """Distinct ``columns`` of the rows that overlap another pathway."""
    return with_overlaps(df, keys, unique=unique).filter(F.col("overlaps") > 0).select(*columns).distinct()


def non_overlapping(df: DataFrame, overlapping_patients: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of patients without any overlapping pathway."""
    return df.join(overlapping_patients.select("pid").distinct(), "pid", "left_anti").select(*columns)


def cross_cohort_overlaps(index: DataFrame, others: DataFrame, key: str = "pid") -> DataFrame:
    """Index rows with the number of other-cohort intervals they touch."""
    return overlap_counts(index, others, [key], closed=True)


def overlap_pairs_by(others: DataFrame, index: DataFrame, by: Sequence[str], key: str = "pid") -> DataFrame:
    """Number of (index, other) overlaps by a column of the other cohort."""
    counted = overlap_counts(others, index, [key], closed=True).filter(F.col("overlaps") > 0)
    return counted.groupBy(*by).agg(F.sum("overlaps").alias("pairs"))


def patient_pathway_mix(index: DataFrame, others: DataFrame, key: str = "pid") -> DataFrame:
    """Share of patients with one, with several, and with overlapping pathways."""
    per_patient = (
        cross_cohort_overlaps(index, others, key)
        .groupBy(key)
        .agg(F.count("*").alias("n"), F.max((F.col("overlaps") > 0).cast("int")).alias("overlap"))
    )

    def percent(test: Column) -> Column:
        return F.count_if(test) / F.count("*") * 100

    return per_patient.agg(
        F.count("*").alias("patients"),
        percent(F.col("n") == 1).alias("single_percentage"),
        percent(F.col("n") > 1).alias("multiple_percentage"),
        percent(F.col("overlap") == 1).alias("overlapping_percentage"),
    )


def compare_tables(
    first: DataFrame, second: DataFrame, column: str, names: tuple[str, str], on: Sequence[str] = ("variable", "value")
) -> DataFrame:
    """Two result tables side by side with their difference and its label."""
    a, b = names
    joined = first.select(*on, F.col(column).alias(a)).join(second.select(*on, F.col(column).alias(b)), list(on))
    change = F.round(F.col(b) - F.col(a), 2)
    return joined.withColumn("difference", change).withColumn(
        "change", F.concat(change.cast("string"), F.lit("% improvement"))
    )
