"""Cohort selection: windows, exclusions, groups and their sizes."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATHWAY = ("pid", "tfc", "start_date")


def with_wait(df: DataFrame, start: str = "start_date", stop: str = "stop_date", minimum: int | None = None) -> DataFrame:
    """Wait length in days; ``minimum`` drops shorter ones."""
    out = df.withColumn("wt", F.datediff(stop, start))
    return out if minimum is None else out.filter(F.col("wt") >= minimum)


def cohort_window(
    df: DataFrame,
    started_from: datetime.date,
    stopped_before: datetime.date,
    start: str = "start_date",
    stop: str = "stop_date",
) -> DataFrame:
    """Pathways that start on or after the first day and stop before the last."""
    return df.filter((F.col(start) >= F.lit(started_from)) & (F.col(stop) < F.lit(stopped_before)))


def with_bounds(df: DataFrame, washout: int = 28, follow_up: int | None = None) -> DataFrame:
    """Washout and follow-up ends as dates and as days from clock start."""
    after = F.col("wt") if follow_up is None else F.lit(follow_up)
    return df.withColumns(
        {
            "washout_end": F.date_add("stop_date", washout),
            "follow_up_end": F.date_add(F.date_add("stop_date", washout), after),
            "washout_end_days": F.col("wt") + washout,
            "follow_up_end_days": F.col("wt") + washout + after,
        }
    )


def has_priority(level: str, column: str = "priority") -> Column:
    """Referral priority test, whatever the case of the label; null for no priority."""
    return F.lower(column) == level.lower()


def is_extreme(days: int = 356 * 2) -> Column:
    """Extremely long waits."""
    return F.col("wt") > days


def exclude_priority(df: DataFrame, level: str, column: str = "priority", keep_only: bool = False) -> DataFrame:
    """Drop (or keep only) one referral priority; rows without a priority go too."""
    same = has_priority(level, column)
    return df.filter(same if keep_only else ~same)


def survived(df: DataFrame, exit_date: str = "exit_date", end: str = "follow_up_end") -> DataFrame:
    """Rows without an exit up to the end of follow-up."""
    return df.filter(F.col(exit_date).isNull() | (F.col(exit_date) > F.col(end)))


def exit_exclusion(
    df: DataFrame, keys: Sequence[str] = ("group",), exit_date: str = "exit_date", end: str = "follow_up_end"
) -> DataFrame:
    """Patients excluded for an exit in follow-up and pathways kept, by keys or (no keys) in total."""
    gone = F.coalesce(F.col(exit_date) <= F.col(end), F.lit(False))
    # one row per patient and key first: the distinct counts then add up
    per_patient = df.groupBy(*keys, "pid").agg(F.max(gone.cast("int")).alias("excluded"), F.count_if(~gone).alias("kept"))
    return per_patient.groupBy(*keys).agg(
        F.sum("excluded").alias("excluded_patients"),
        F.sum("kept").alias("kept_pathways"),
        F.count("*").alias("patients"),
    )


def exit_during_wait(df: DataFrame, exit_date: str = "exit_date") -> DataFrame:
    """Pathways whose patient left between clock start and clock stop."""
    return df.filter(F.col(exit_date).between(F.col("start_date"), F.col("stop_date")))


def cohort_sizes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct pathways and patients, over all or per group."""
    return (
        df.groupBy(*keys, *PATHWAY)
        .agg(F.count("*").alias("_rows"))
        .groupBy(*keys, "pid")
        .agg(F.count("*").alias("_pathways"))
        .groupBy(*keys)
        .agg(F.sum("_pathways").alias("pathways"), F.count("*").alias("patients"))
    )


def subgroup_union(df: DataFrame, subgroups: dict[str, Column], label: str = "subsection") -> DataFrame:
    """Rows of every subgroup, labelled; a row may belong to several."""
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in subgroups.items()]))
    return df.withColumn(label, F.explode(labels))


def not_in(df: DataFrame, sample: DataFrame, keys: Sequence[str] = PATHWAY) -> DataFrame:
    """Pathways outside a sample."""
    return df.join(sample.select(*keys), list(keys), "left_anti")


def link(df: DataFrame, other: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """Link by a compound key whose columns are named differently on both sides."""
    renamed = other.withColumnsRenamed({right: left for left, right in on.items()})
    return df.join(renamed, list(on), how)
