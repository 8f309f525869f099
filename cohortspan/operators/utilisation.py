"""Health-care use before, during and after the wait."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.operators.ordered import group_statistics
from cohortspan.operators.running import between, entries_upto, interval_totals, totals_at, with_ledger
from cohortspan.operators.tables import unpivot_variables
from cohortspan.session import durable

QUARTER_DAYS = 7 * 13
SUFFIXES = {"3m_before": "3m_before", "while_waiting": "waiting_time", "3m_after": "3m_after"}


def wide_utilisation(
    pathways: DataFrame, activity: DataFrame, measures: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """``{measure}_{period}`` columns for the 13 weeks before, the wait and the 13 weeks after.

    A clock that stops before it starts has no use while waiting.
    """
    days = {
        "early": F.date_sub("start_date", QUARTER_DAYS + 1),
        "start": F.date_sub("start_date", 1),
        "stop": F.col("stop_date"),
        "late": F.date_add("stop_date", QUARTER_DAYS),
    }
    windows = {"3m_before": ("early", "start"), "waiting_time": ("start", "stop"), "3m_after": ("stop", "late")}
    found = totals_at(pathways.select(*keep), activity, ["pid"], days, measures)
    inverted = F.col("stop_date") < F.col("start_date")

    def use(m: str, p: str) -> Column:
        total = between(m, *windows[p])
        return F.when(inverted, 0).otherwise(total) if p == "waiting_time" else total

    return found.select(*keep, *[use(m, p).alias(f"{m}_{p}") for p in windows for m in measures])


def period_stats(
    wide: DataFrame,
    variables: Sequence[str],
    measures: Sequence[str],
    length: str = "wt",
    counted: Sequence[str] = (),
) -> DataFrame:
    """Utilisation statistics by characteristic value, measure and period; quartiles are exact.

    The measures named in ``counted`` take few distinct values, such as numbers of contacts: their
    rows are reduced to counts per value in one pass. The others, such as costs, are cut into
    ranges, and only the ranges with a quartile are read twice (``ordered.group_statistics``).
    """
    wide = durable(wide.select(*variables, length, *[f"{m}_{suffix}" for m in measures for suffix in SUFFIXES.values()]))
    parts = []
    if counted:
        parts.append(_counted_stats(wide, variables, counted, length))
    if rest := [m for m in measures if m not in counted]:
        parts.append(_ranged_stats(wide, variables, rest, length))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _weeks(label: Column, days: Column, n: Column) -> Column:
    return F.when(label == "while_waiting", F.round(days / 7, 2)).otherwise((n * 13).cast("double"))


def _counted_stats(wide: DataFrame, variables: Sequence[str], measures: Sequence[str], length: str) -> DataFrame:
    columns = [(m, label, f"{m}_{suffix}") for m in measures for label, suffix in SUFFIXES.items()]
    group = ["variable", "value", "cell"]
    long = unpivot_variables(wide, variables, [length, *[c for _, _, c in columns]])
    # rows merge on the map side: a cell takes few values
    cells = long.select("variable", "value", length, F.posexplode(F.array(*[F.col(c) for _, _, c in columns])).alias("cell", "v"))
    counts = cells.filter(F.col("v").isNotNull()).groupBy(*group, "v").agg(F.count("*").alias("_n"), F.sum(length).alias("_days"))
    # from here on one row per distinct value of a cell
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole), "_mean": F.sum(F.col("v") * F.col("_n")).over(whole) / F.sum("_n").over(whole)})

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("v")))

    n = F.sum("_n")
    square = F.sum(F.col("_n") * F.pow(F.col("v") - F.col("_mean"), 2))
    names = F.array(*[F.struct(F.lit(m).alias("utilisation_type"), F.lit(label).alias("time_period")) for m, label, _ in columns])
    return ranked.groupBy(*group).agg(
        n.alias("pathway_count"),
        F.sum(F.col("v") * F.col("_n")).alias("sum"),
        F.round(F.sum(F.col("v") * F.col("_n")) / n, 2).alias("mean"),
        quantile(0.5).alias("median"),
        F.round(F.sqrt(F.try_divide(square, n - 1)), 2).alias("stddev"),
        (quantile(0.75) - quantile(0.25)).alias("iqr"),
        F.sum("_days").alias("_days"),
    ).withColumn("_name", names[F.col("cell")]).select("*", "_name.*").select(
        "variable", "value", "utilisation_type", "time_period", "pathway_count", "sum", "mean", "median", "stddev", "iqr",
        _weeks(F.col("time_period"), F.col("_days"), F.col("pathway_count")).alias("pathway_weeks"),
    )


def _ranged_stats(wide: DataFrame, variables: Sequence[str], measures: Sequence[str], length: str) -> DataFrame:
    columns = [(m, label, f"{m}_{suffix}") for m in measures for label, suffix in SUFFIXES.items()]
    used = [c for _, _, c in columns]
    found = group_statistics(
        wide, ["variable", "value"], used, [0.25, 0.5, 0.75], lambda df, names: unpivot_variables(df, variables, names), length
    )
    names = F.array(*[F.struct(F.lit(m).alias("utilisation_type"), F.lit(label).alias("time_period")) for m, label, _ in columns])
    return found.withColumn("_name", names[F.col("cell")]).select("*", "_name.*").select(
        "variable", "value", "utilisation_type", "time_period", F.col("n").alias("pathway_count"), "sum", F.round("mean", 2).alias("mean"), F.col("q1").alias("median"),
        F.round("stddev", 2).alias("stddev"), (F.col("q2") - F.col("q0")).alias("iqr"), _weeks(F.col("time_period"), F.col("weight"), F.col("n")).alias("pathway_weeks"),
    )


def unpivot_utilisation(wide: DataFrame, measures: Sequence[str], keep: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Long form (delivery_point, time_period, healthcare_utilization)."""
    labels = {"3m_before": "3 months before", "waiting_time": "during waiting", "3m_after": "3 months after"}
    cells = F.array(
        *[
            F.struct(
                F.lit((names or {}).get(m, m)).alias("delivery_point"),
                F.lit(label).alias("time_period"),
                F.col(f"{m}_{suffix}").alias("healthcare_utilization"),
            )
            for suffix, label in labels.items()
            for m in measures
        ]
    )
    return wide.select(*keep, F.inline(cells))


def utilisation_rate(
    wide: DataFrame, measures: Sequence[str], keys: Sequence[str], length: str = "wt", names: dict[str, str] | None = None
) -> DataFrame:
    """Totals and rate per 1,000 person-weeks; fixed periods count 13 weeks each.

    Every measure and period is summed side by side, and only the small result is unpivoted.
    """
    labels = {"3m_before": "3 months before", "waiting_time": "during waiting", "3m_after": "3 months after"}
    sums = [F.sum(f"{m}_{p}").alias(f"sum {m}_{p}") for p in labels for m in measures]
    counts = [F.count(f"{m}_{p}").alias(f"n {m}_{p}") for p in labels for m in measures]
    summed = wide.groupBy(*keys).agg(*sums, *counts, F.sum(length).alias("_waited"), F.count("*").alias("_rows"))
    cells = F.array(
        *[
            F.struct(
                F.lit((names or {}).get(m, m)).alias("delivery_point"),
                F.lit(label).alias("time_period"),
                F.col(f"sum {m}_{p}").alias("utilisation"),
                (F.col("_waited") if p == "waiting_time" else F.col("_rows") * QUARTER_DAYS).cast("long").alias("person_days"),
                F.col(f"n {m}_{p}").alias("n"),
            )
            for p, label in labels.items()
            for m in measures
        ]
    )
    return summed.select(*keys, F.inline(cells)).withColumn(
        "rate_per_1000", F.try_divide(F.col("utilisation"), F.col("person_days") / 7) * 1000
    )


def history_windows(recovery: int = 42, baseline: tuple[int, int] = (60, 30)) -> dict[str, tuple[Column, Column]]:
    """Baseline, waiting, washout and post-operation windows of a pathway."""
    far, near = baseline
    return {
        "baseline": (F.date_sub("start_date", far), F.date_sub("start_date", near)),
        "waiting": (F.col("start_date"), F.col("stop_date")),
        "washout": (F.col("stop_date"), F.date_add("stop_date", recovery)),
        "post_operation": (
            F.date_add("stop_date", recovery + 1),
            F.date_add(F.date_add("stop_date", recovery), F.col("wt")),
        ),
    }


def history_totals(
    pathways: DataFrame, activity: DataFrame, measure: str, keep: Sequence[str], observed: tuple[Column, Column]
) -> DataFrame:
    """Use and observed days per pathway and history window."""
    windows = history_windows()
    first, last = observed
    entries = F.array(*[F.struct(F.lit(p).alias("period"), lo.alias("lo"), hi.alias("hi")) for p, (lo, hi) in windows.items()])
    rows = (
        pathways.select(*keep, F.inline(entries))
        .withColumns({"lo": F.greatest("lo", first), "hi": F.least("hi", last)})
        .filter(F.col("lo") <= F.col("hi"))
        .withColumn("days", F.datediff("hi", "lo") + 1)
    )
    return interval_totals(rows, activity, ["pid"], "lo", "hi", [measure])


def period_utilisation(history: DataFrame, measure: str, group: str = "group") -> DataFrame:
    """Use, patients and use per patient by group and window.

    Groups without rows in one of the windows are left out.
    """
    per_patient = history.groupBy(group, "period", "pid").agg(F.sum(measure).alias("use"))
    table = per_patient.groupBy(group, "period").agg(F.sum("use").alias("total_use"), F.count("*").alias("patients"))
    windows = len(history_windows())
    complete = table.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") == windows).select(group)
    return table.join(complete, group, "left_semi").withColumn("per_patient", F.col("total_use") / F.col("patients"))


def person_week_rates(history: DataFrame, measure: str, group: str = "group") -> DataFrame:
    """Weekly use per patient, summed and averaged over the patients of a group."""
    names = list(history_windows())
    patient = history.groupBy(group, "pid").agg(
        *[F.sum(F.when(F.col("period") == p, F.col(measure))).alias(f"{p}_use") for p in names],
        *[F.sum(F.when(F.col("period") == p, F.col("days"))).alias(f"{p}_days") for p in names],
    )
    weekly = patient.select(group, *[F.try_divide(F.col(f"{p}_use"), F.col(f"{p}_days") / 7).alias(p) for p in names])
    summed = weekly.groupBy(group).agg(F.count("*").alias("group_size"), *[F.sum(p).alias(p) for p in names])
    cells = F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("total_weekly_contact")) for p in names])
    return summed.select(group, "group_size", F.inline(cells)).withColumn(
        "avg_weekly_contact_per_person", F.col("total_weekly_contact") / F.col("group_size")
    )


def baseline_use(pathways: DataFrame, activity: DataFrame, measure: str, keep: Sequence[str]) -> DataFrame:
    """Use in the baseline window, summed per patient and joined back to each pathway."""
    lo, hi = history_windows()["baseline"]
    rows = pathways.select("pid", lo.alias("lo"), hi.alias("hi"))
    per_patient = interval_totals(rows, activity, ["pid"], "lo", "hi", [measure]).groupBy("pid").agg(F.sum(measure).alias("baseline_use"))
    return pathways.select(*keep).join(per_patient, "pid", "left")


def binned_activity(
    pathways: DataFrame, activity: DataFrame, measure: str, width: int, last_day: Column, group: str = "group"
) -> DataFrame:
    """Use by group and bin of days since clock start, up to ``last_day`` (a date)."""
    waits = pathways.select("pid", group, "start_date", last_day.alias("_last")).filter(F.col("start_date") <= F.col("_last"))
    found = with_ledger(waits, activity, ["pid"], [measure])
    # neighbouring bins share an edge: it is asked about once, and totals are differences along the edges
    edges = F.expr(f"sequence(-1, cast(datediff(_last, start_date) div {width} as int))")

    ends = F.transform(edges, lambda edge: F.when(edge < 0, F.date_sub("start_date", 1)).otherwise(F.least(F.date_add("start_date", (edge + 1) * width - 1), F.col("_last"))))
    totals = found.select(group, F.transform(entries_upto(ends), lambda entry: F.coalesce(entry[measure], F.lit(0))).alias("_upto"))
    use = F.transform(F.slice("_upto", F.lit(2), F.size("_upto") - 1), lambda total, bin: total - F.get("_upto", bin))
    return totals.select(group, F.posexplode(use).alias("bin", "_use")).groupBy(group, "bin").agg(F.sum("_use").alias("total_use"))
