"""First contacts, exits, missed contacts and cancellations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.flags import attendance_flags
from cohortspan.operators.tables import quantile

FLAGS = {"is_dna": "dna", "is_patient_canc": "patient_canc", "is_hospital_canc": "hospital_canc"}


def time_to_first_event(
    events: DataFrame, first: Column, start: str, date: str, keys: Sequence[str]
) -> DataFrame:
    """Days from clock start to the first contact: average, median, deviation, quartile range."""
    days = events.filter(first).withColumn("days_between", F.datediff(date, start))
    return days.groupBy(*keys).agg(
        F.avg("days_between").alias("avg_days_between"),
        quantile("days_between", 0.5).cast("int").alias("median_days_between"),
        F.stddev_samp("days_between").alias("stddev_days_between"),
        (quantile("days_between", 0.75) - quantile("days_between", 0.25)).cast("int").alias("iqr_days_between"),
        F.count("*").alias("n"),
    )


def exit_rate(pathways: DataFrame, keys: Sequence[str], exit_date: str = "exit_date", digits: int = 2) -> DataFrame:
    """Pathways with an exit during the wait as a share of all, groups without exits left out."""
    gone = F.col(exit_date).between(F.col("start_date"), F.col("stop_date"))
    counted = pathways.groupBy(*keys).agg(F.count_if(gone).alias("exits"), F.count("*").alias("total"))
    return counted.filter(F.col("exits") > 0).withColumn(
        "exit_percentage", F.round(F.col("exits") / F.col("total") * 100, digits)
    )


def time_to_exit_stats(exited: DataFrame, keys: Sequence[str], exit_date: str = "exit_date") -> DataFrame:
    """Mean, exact quartiles, deviation and range of days from clock start to exit."""
    days = exited.withColumn("time_to_exit", F.datediff(exit_date, "start_date"))
    quartiles = F.percentile("time_to_exit", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return days.groupBy(*keys).agg(
        F.avg("time_to_exit").alias("mean_time_to_exit"),
        quartiles[0].alias("lower_quartile"),
        quartiles[1].alias("median_time_to_exit"),
        quartiles[2].alias("upper_quartile"),
        F.stddev_samp("time_to_exit").alias("stddev_time_to_exit"),
        F.min("time_to_exit").alias("min_time_to_exit"),
        F.max("time_to_exit").alias("max_time_to_exit"),
        F.count("*").alias("n"),
    )


def with_attendance_flags(attendances: DataFrame) -> DataFrame:
    return attendances.withColumns(attendance_flags())


def cancellation_rates(flagged: DataFrame, keys: Sequence[str], pathway: str = "pathway_id") -> DataFrame:
    """Distinct pathways with each flag, their share of all pathways, and mean flag rates per row."""
    per_pathway = flagged.groupBy(*keys, pathway).agg(
        *[F.max(c).alias(c) for c in FLAGS],
        *[F.sum(c).alias(f"_rows_{c}") for c in FLAGS],
        F.count("*").alias("_rows"),
    )
    counted = per_pathway.groupBy(*keys).agg(
        F.count(pathway).alias("unique_pathways"),
        *[F.sum(F.when(F.col(pathway).isNotNull(), F.col(c))).alias(f"{n}_count") for c, n in FLAGS.items()],
        *[(F.sum(f"_rows_{c}") / F.sum("_rows")).alias(f"avg_{n}_rate") for c, n in FLAGS.items()],
    )
    return counted.withColumns(
        {f"{n}_percentage": F.try_divide(F.col(f"{n}_count"), F.col("unique_pathways")) * 100 for n in FLAGS.values()}
    )


def cancellation_monthly(flagged: DataFrame, keys: Sequence[str], date: str = "attendance_date") -> DataFrame:
    """:func:`cancellation_rates` by calendar month."""
    dated = flagged.withColumns({"year": F.year(date), "month": F.month(date)})
    return cancellation_rates(dated, [*keys, "year", "month"])


def cancellation_impact(flagged: DataFrame, keys: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows with each flag as a percentage of all rows; null where there are none."""
    counted = flagged.groupBy(*keys).agg(F.count("*").alias("total_count"), *[F.sum(c).alias(c) for c in FLAGS])
    return counted.select(
        *keys,
        "total_count",
        *[
            F.round(F.when(F.col(c) > 0, F.col(c)) / F.col("total_count") * 100, digits).alias(f"{n}_percentage")
            for c, n in FLAGS.items()
        ],
    )


def patient_starts(df: DataFrame, keys: Sequence[str], length: str = "wt") -> DataFrame:
    """Distinct clock starts and median wait per patient and keys."""
    return df.groupBy(*keys).agg(
        F.count_distinct("start_date").alias("distinct_count"),
        quantile(length, 0.5).cast("int").alias("median_wait_length"),
    )


def multi_start_profile(df: DataFrame, by: str, marked: Column, patient: str = "pid", tfc: str = "tfc") -> DataFrame:
    """Patients with several clock starts per specialty, rows with a mark, and their ratio."""
    starts = df.groupBy(patient, tfc, by, "start_date").agg(F.lit(1).alias("_one"))
    repeated = (
        starts.groupBy(patient, tfc, by)
        .agg(F.count("*").alias("starts"))
        .filter(F.col("starts") > 1)
        .groupBy(by)
        .agg(F.count("*").alias("record_count"))
    )
    marks = df.filter(marked).groupBy(by).agg(F.count("*").alias("marked_count"))
    return (
        repeated.join(marks, by, "left")
        .na.fill(0, ["marked_count"])
        .withColumn("marked_proportion", F.col("marked_count") / F.col("record_count"))
    )


def multiple_of(df: DataFrame, column: str, patient: str = "pid") -> DataFrame:
    """Patients with more than one distinct value of a column."""
    return (
        df.groupBy(patient, column)
        .agg(F.count("*").alias("_rows"))
        .groupBy(patient)
        .agg(F.count(column).alias("distinct_count"))
        .filter(F.col("distinct_count") > 1)
    )
