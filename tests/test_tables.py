"""Report tables, cohort selection, events and utilisation on hand-made frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import cohort, events, ordered, tables, utilisation

D = datetime.date


def day(n):
    return D(2022, 1, 1) + datetime.timedelta(n)


def test_band_distribution_names_nulls_and_sums_to_hundred(spark):
    rows = [("F", 1, "short")] * 3 + [("M", None, "short"), (None, 2, "long"), ("F", 2, "long")]
    df = spark.createDataFrame(rows, "sex string, code int, band string")
    out = tables.band_distribution(df, ["sex", "code"], "band")
    cells = {(r["variable"], r["value"], r["band"]): (r["n"], r["percentage"]) for r in out.collect()}
    assert cells[("sex", "F", "short")] == (3, 75.0)
    assert cells[("code", "unknown", "short")] == (1, 100.0)
    assert cells[("sex", "unknown", "long")] == (1, 100.0)
    sums = out.groupBy("variable", "value").agg(F.sum("percentage")).collect()
    assert all(abs(r[2] - 100) < 0.03 for r in sums)
    by_band = tables.band_distribution(df, ["sex"], "band", "band")
    assert {(r["value"], r["band"]): r["percentage"] for r in by_band.collect()}[("F", "short")] == 75.0
    wide = tables.band_distribution(df, ["sex"], "band", bands=["short", "long", "none"]).filter("value = 'M'").first()
    assert (wide["short_count"], wide["none_count"], wide["none_percentage"], wide["total_count"]) == (1, 0, 0.0, 1)


def test_grain_reduces_rows_first(spark):
    rows = [(1, "F", "a")] * 5 + [(2, "F", "b")]
    df = spark.createDataFrame(rows, "pid int, sex string, band string")
    out = tables.band_distribution(df, ["sex"], "band", grain=["pid"]).collect()
    assert sorted((r["band"], r["n"]) for r in out) == [("a", 1), ("b", 1)]


def test_variable_may_also_be_the_band(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")
    assert {(r["value"], r["v"], r["n"]) for r in tables.band_distribution(df, ["v"], "v").collect()} == {("x", "x", 1), ("y", "y", 2)}


def test_length_stats(spark):
    df = spark.createDataFrame([("a", w) for w in (1, 2, 3, 4, 10)] + [(None, 7)], "g string, wt int")
    got = {r["value"]: r for r in tables.length_stats(df, "wt", ["g"]).collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["sd"], got["a"]["iqr"]) == (4.0, 3.0, 3.54, 2.0)
    assert got["unknown"]["sd"] is None


def test_outcome_table_counts_code_99_twice(spark):
    rows = [(99, None, "week_end_date"), (99, None, "rtt_end_date"), (30, None, None), (30, "IRTT", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "status int, change_type string, end_type string, specialty string")
    r = tables.outcome_table(df, ["specialty"]).first()
    assert (r["total_count"], r["count_null"], r["count_null_imputed_end"], r["percentage_null"]) == (4, 2, 1, 50.0)
    assert (r["count_treatment_admitted"], r["count_treatment_non_admitted"]) == (1, 0)


def test_report_layout_orders_and_heads(spark):
    counts = spark.createDataFrame([("sex", "F", 3), ("sex", "M", 4), ("age", "old", 7)], "variable string, value string, n int")
    out = tables.report_layout(counts, {"sex": ["M", "F", "X"], "age": ["old"]}, ["n"]).orderBy("ord").collect()
    assert [(r["label"], r["n"]) for r in out] == [("sex", None), ("M", 4), ("F", 3), ("age", None), ("old", 7)]


def test_baseline_gap(spark):
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "k string, proportion double")
    out = {r["k"]: r["difference"] for r in tables.baseline_gap(shares, "k", {"a": 0.25}).collect()}
    assert out == {"a": 0.25, "b": None}


PATHWAYS = [
    (1, "t", D(2022, 1, 10), D(2022, 4, 10), 90, "g", None),
    (1, "t", D(2022, 2, 1), D(2022, 5, 1), 89, "g", None),
    (2, "t", D(2022, 1, 1), D(2022, 3, 1), 59, "g", D(2022, 2, 1)),
    (3, "u", D(2022, 1, 1), D(2022, 3, 1), 59, "h", D(2023, 2, 1)),
]
SCHEMA = "pid int, tfc string, start_date date, stop_date date, wt int, group string, exit_date date"


def test_exclusions_and_sizes(spark):
    df = spark.createDataFrame(PATHWAYS, SCHEMA)
    bounded = cohort.with_bounds(df)
    assert cohort.survived(bounded).count() == 3
    out = {r["group"]: r for r in cohort.exit_exclusion(bounded).collect()}
    assert (out["g"]["excluded_patients"], out["g"]["kept_pathways"], out["g"]["patients"]) == (1, 2, 2)
    assert (out["h"]["excluded_patients"], out["h"]["kept_pathways"]) == (0, 1)
    total = cohort.exit_exclusion(bounded, ()).first()
    assert (total["excluded_patients"], total["kept_pathways"], total["patients"]) == (1, 3, 3)
    assert [r["pid"] for r in cohort.exit_during_wait(df).collect()] == [2]
    sizes = {r["group"]: (r["pathways"], r["patients"]) for r in cohort.cohort_sizes(df, ["group"]).collect()}
    assert sizes == {"g": (3, 2), "h": (1, 1)}
    assert cohort.not_in(df, df.filter("pid = 1")).count() == 2
    assert cohort.with_wait(df.drop("wt"), minimum=60).count() == 2


def test_priority(spark):
    df = spark.createDataFrame([("Cancer",), ("cancer",), ("Routine",), (None,)], "priority string")
    assert cohort.exclude_priority(df, "cancer").count() == 1
    assert cohort.exclude_priority(df, "cancer", keep_only=True).count() == 2


def test_subgroups_may_share_rows(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    out = cohort.subgroup_union(df, {"low": F.col("x") < 6, "high": F.col("x") > 3}).collect()
    assert sorted((r["x"], r["subsection"]) for r in out) == [(1, "low"), (5, "high"), (5, "low")]


def test_exit_tables(spark):
    df = spark.createDataFrame(PATHWAYS, SCHEMA)
    rate = events.exit_rate(df, ["tfc"]).collect()
    assert [(r["tfc"], r["exits"], r["total"], r["exit_percentage"]) for r in rate] == [("t", 1, 3, 33.33)]
    stats = events.time_to_exit_stats(cohort.exit_during_wait(df), ["tfc"]).first()
    assert (stats["mean_time_to_exit"], stats["median_time_to_exit"], stats["min_time_to_exit"]) == (31.0, 31.0, 31)


def test_cancellations(spark):
    rows = [("s", "p1", "5 dna"), ("s", "p1", "5 dna"), ("s", "p2", "attended"), ("s", None, "4 cancel(hos)")]
    flagged = events.with_attendance_flags(spark.createDataFrame(rows, "specialty string, pathway_id string, attendance_status string"))
    r = events.cancellation_rates(flagged, ["specialty"]).first()
    assert (r["unique_pathways"], r["dna_count"], r["dna_percentage"], r["avg_dna_rate"]) == (2, 1, 50.0, 0.5)
    assert (r["hospital_canc_count"], r["avg_hospital_canc_rate"]) == (0, 0.25)
    i = events.cancellation_impact(flagged, ["specialty"]).first()
    assert (i["dna_percentage"], i["patient_canc_percentage"]) == (50.0, None)


def test_starts(spark):
    df = spark.createDataFrame(PATHWAYS, SCHEMA).withColumn("mark", F.lit("IRTT"))
    profile = events.multi_start_profile(df, "group", F.col("mark") == "IRTT").collect()
    assert [(r["group"], r["record_count"], r["marked_count"], r["marked_proportion"]) for r in profile] == [("g", 1, 3, 3.0)]
    assert events.multiple_of(df, "tfc").count() == 0
    starts = {r["pid"]: (r["distinct_count"], r["median_wait_length"]) for r in events.patient_starts(df, ["pid"]).collect()}
    assert starts[1] == (2, 89)


def test_utilisation_windows(spark):
    pw = spark.createDataFrame([(1, 1, D(2022, 6, 1), D(2022, 8, 1), 61, "g")], "pathway_id int, pid int, start_date date, stop_date date, wt int, group string")
    days = [D(2022, 3, 1), D(2022, 3, 2), D(2022, 5, 31), D(2022, 6, 1), D(2022, 8, 1), D(2022, 8, 2), D(2022, 10, 31), D(2022, 11, 1)]
    act = spark.createDataFrame([(1, d, 1) for d in days], "pid int, day date, use int")
    wide = utilisation.wide_utilisation(pw, act, ["use"], ["pathway_id", "pid", "start_date", "stop_date", "wt", "group"])
    r = wide.first()
    assert (r["use_3m_before"], r["use_waiting_time"], r["use_3m_after"]) == (2, 2, 2)
    stats = {r["time_period"]: r for r in utilisation.period_stats(wide, ["group"], ["use"]).collect()}
    assert stats["3m_before"]["pathway_weeks"] == 13 and stats["while_waiting"]["pathway_weeks"] == 8.71
    long = utilisation.unpivot_utilisation(wide, ["use"], ["group", "wt"], {"use": "GP"})
    assert {(r["delivery_point"], r["healthcare_utilization"]) for r in long.collect()} == {("GP", 2)}
    rate = {r["time_period"]: r for r in utilisation.utilisation_rate(wide, ["use"], ["group"], names={"use": "GP"}).collect()}
    assert rate["during waiting"]["person_days"] == 61 and rate["3 months after"]["person_days"] == 91
    assert rate["3 months before"]["rate_per_1000"] == pytest.approx(2 / 13 * 1000)
    assert rate["3 months before"]["delivery_point"] == "GP"


def test_history_is_clipped_to_the_observed_days(spark):
    pw = spark.createDataFrame([(1, 1, D(2022, 1, 20), D(2022, 2, 20), 31, "g")], "pathway_id int, pid int, start_date date, stop_date date, wt int, group string")
    act = spark.createDataFrame([(1, D(2022, 1, 20), 2), (1, D(2022, 2, 20), 3)], "pid int, day date, use int")
    seen = (F.lit(D(2022, 1, 1)), F.lit(D(2022, 3, 1)))
    rows = {r["period"]: r for r in utilisation.history_totals(pw, act, "use", ["pathway_id", "pid", "group"], seen).collect()}
    # the stop day counts in the wait and in the washout
    assert {p: (r["use"], r["days"]) for p, r in rows.items()} == {"waiting": (5, 32), "washout": (3, 10)}
    history = utilisation.history_totals(pw, act, "use", ["pathway_id", "pid", "group"], seen)
    assert utilisation.period_utilisation(history, "use").count() == 0
    rates = {r["period"]: r for r in utilisation.person_week_rates(history, "use").collect()}
    assert rates["waiting"]["total_weekly_contact"] == pytest.approx(5 / 32 * 7)
    assert rates["baseline"]["total_weekly_contact"] is None


def test_binned_activity(spark):
    pw = spark.createDataFrame([(1, D(2022, 1, 1), D(2022, 1, 25), "g")], "pid int, start_date date, stop_date date, group string")
    act = spark.createDataFrame([(1, D(2022, 1, d), d) for d in (1, 10, 11, 25, 26)], "pid int, day date, use int")
    out = utilisation.binned_activity(pw, act, "use", 10, F.col("stop_date")).orderBy("bin").collect()
    assert [(r["bin"], r["total_use"]) for r in out] == [(0, 11), (1, 11), (2, 25)]


def test_binned_activity_moves_no_bins(spark):
    """a wait was dealt out by bin, three times; now it moves once, and bins are added up before they move."""
    pw = spark.createDataFrame([(1, "g", day(0), day(25)), (1, "g", day(3), None), (2, "g", day(0), day(4)), (None, "h", day(0), day(9))], "pid int, group string, start_date date, stop_date date")
    act = spark.createDataFrame([(1, day(0), 1), (1, day(9), 2), (1, day(10), 4), (1, day(25), 8), (1, day(26), 16), (2, day(5), 32)], "pid int, day date, use bigint")
    out = utilisation.binned_activity(pw, act, "use", 10, F.col("stop_date"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    assert sorted(map(tuple, out.collect())) == [("g", 0, 3), ("g", 1, 4), ("g", 2, 8), ("h", 0, 0)]


def test_baseline_use_of_equal_windows(spark):
    """no table of distinct windows is held; a patient's equal windows count each time."""
    pw = spark.createDataFrame([(1, 1, day(100)), (2, 1, day(100)), (3, 1, day(101)), (4, 2, day(100)), (5, None, day(100))], "pathway_id int, pid int, start_date date")
    act = spark.createDataFrame([(1, day(39), 1), (1, day(40), 2), (1, day(70), 4), (1, day(71), 8)], "pid int, day date, use bigint")
    out = utilisation.baseline_use(pw, act, "use", ["pathway_id", "pid"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6
    assert sorted((r["pathway_id"], r["baseline_use"]) for r in out.collect()) == [(1, 6 + 6 + 12), (2, 24), (3, 24), (4, 0), (5, None)]


def test_group_statistics_hash_their_counts(spark):
    """the ranges that hold a quartile are counted by hashing; an array among the sums sorted every row before."""
    rows = spark.range(400).selectExpr("cast(id % 3 as string) as g", "cast(id * 37 % 101 as double) as v", "1 as w")
    out = ordered.group_statistics(rows, ["g"], ["v"], [0.25, 0.5, 0.75], lambda df, names: df.select("g", *names), "w")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        values = sorted(float(i * 37 % 101) for i in range(400) if i % 3 == int(r["g"]))
        assert (r["n"], r["q0"], r["q1"], r["q2"]) == (len(values), *[values[-(-len(values) * k // 4) - 1] for k in (1, 2, 3)])
