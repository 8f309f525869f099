"""Interval sums, overlaps and periods against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import did, overlap, periods, running, utilisation

DAY0 = datetime.date(2022, 1, 1)


def day(n):
    return DAY0 + datetime.timedelta(days=n)


def random_spans(seed, n=80, patients=4, horizon=40, ids=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # the first patient holds half of all rows
        pid = 0 if rng.random() < 0.5 else rng.randrange(patients)
        start = rng.randrange(horizon)
        rows.append((i if ids is None else rng.randrange(ids), pid, f"t{rng.randrange(2)}", day(start), day(start + rng.randrange(0, 8))))
    return rows


SCHEMA = "pathway_id int, pid int, tfc string, start_date date, stop_date date"


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_totals_equal_pairwise_sums(spark, seed):
    rng = random.Random(seed)
    spans = random_spans(seed)
    events = [(rng.randrange(4), day(rng.randrange(-5, 55)), rng.randrange(1, 9), float(rng.randrange(20))) for _ in range(300)]
    got = running.interval_totals(
        spark.createDataFrame(spans, SCHEMA),
        spark.createDataFrame(events, "pid int, day date, use int, cost double"),
        ["pid"], "start_date", "stop_date", ["use", "cost"],
    ).collect()
    assert len(got) == len(spans)
    for r in got:
        inside = [e for e in events if e[0] == r["pid"] and r["start_date"] <= e[1] <= r["stop_date"]]
        assert (r["use"], r["cost"]) == (sum(e[2] for e in inside), sum(e[3] for e in inside))


def test_interval_totals_keep_rows_without_dates(spark):
    spans = spark.createDataFrame([(1, 1, day(0), None), (2, None, day(0), day(3))], "id int, pid int, lo date, hi date")
    events = spark.createDataFrame([(1, day(1), 5)], "pid int, day date, use int")
    assert sorted(r["use"] for r in running.interval_totals(spans, events, ["pid"], "lo", "hi", ["use"]).collect()) == [0, 0]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ledgers_of_any_length(spark):
    """Bisection against counting, with keys of 0 to 17 days, days asked before, between and after, null dates and keys."""
    events = [(n, day(3 * k), -1 if k % 5 == 4 else k + 1) for n in range(18) for k in range(n)]
    asked = [(n, day(d)) for n in range(18) for d in range(-2, 56)] + [(5, None), (None, day(3))]
    got = running.totals_at(
        spark.createDataFrame(asked, "pid int, at date"), spark.createDataFrame(events, "pid int, day date, use int"), ["pid"], {"x": F.col("at")}, ["use"]
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        known = r["pid"] is not None and r["at"] is not None
        assert r["use@x"] == (sum(e[2] for e in events if e[0] == r["pid"] and e[1] <= r["at"]) if known else None)


def test_interval_totals_move_their_rows_once(spark):
    """F1, F2, F8, F9, F10: rows and ledgers meet in one join; a row was dealt by day for each of its dates before."""
    rows = spark.createDataFrame([(1, day(0), day(3))], "pid int, lo date, hi date")
    events = spark.createDataFrame([(1, day(1), 5)], "pid int, day date, use int")
    assert exchanges(running.interval_totals(rows, events, ["pid"], "lo", "hi", ["use"])) <= 3


def test_wide_utilisation_keeps_each_row_apart(spark):
    """Rows of one pathway number keep their own windows."""
    pw = spark.createDataFrame([(7, 1, day(100), day(110)), (7, 2, day(100), day(120))], "pathway_id int, pid int, start_date date, stop_date date")
    act = spark.createDataFrame([(1, day(105), 2), (1, day(115), 4), (2, day(115), 8)], "pid int, day date, use int")
    wide = utilisation.wide_utilisation(pw, act, ["use"], pw.columns)
    assert exchanges(wide) <= 3
    assert sorted((r["pid"], r["use_3m_before"], r["use_waiting_time"], r["use_3m_after"]) for r in wide.collect()) == [(1, 0, 2, 4), (2, 0, 8, 0)]


def overlaps(a, b, closed=False):
    if closed:
        return a[3] <= b[4] and a[4] >= b[3]
    return a[3] < b[4] and a[4] > b[3]


@pytest.mark.parametrize("seed, ids", [(3, None), (4, 12), (5, 3)])
def test_overlaps_with_another_pathway(spark, seed, ids):
    """Repeated pathway numbers, empty intervals and a hot patient."""
    rows = [(i, *r) for i, r in enumerate(random_spans(seed, ids=ids))]
    df = spark.createDataFrame(rows, "row int, " + SCHEMA)
    for keys, same in ((["pid"], lambda a, b: a[1] == b[1]), (["pid", "tfc"], lambda a, b: a[1:3] == b[1:3])):
        got = {r["row"]: r["overlaps"] for r in overlap.with_overlaps(df, keys).collect()}
        for i, *a in rows:
            a = tuple(a)
            want = sum(same(a, r[1:]) and a[0] != r[1] and overlaps(a, r[1:]) for r in rows)
            assert got[i] == want
    if ids is None:
        unique = {r["row"]: r["overlaps"] for r in overlap.with_overlaps(df, ["pid"], unique=True).collect()}
        assert unique == {r["row"]: r["overlaps"] for r in overlap.with_overlaps(df, ["pid"]).collect()}


def test_touching_intervals(spark):
    rows = [(1, 1, "a", day(0), day(5)), (2, 1, "a", day(5), day(9))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["overlaps"] for r in overlap.with_overlaps(df, ["pid"]).collect()] == [0, 0]
    assert [r["overlaps"] for r in overlap.overlap_counts(df, df, ["pid"], closed=True).collect()] == [2, 2]


def test_cross_cohort_pairs(spark):
    rows = random_spans(6)
    df = spark.createDataFrame(rows, SCHEMA)
    index, others = df.filter("tfc = 't0'"), df.filter("tfc = 't1'")
    got = {r["pid"]: r["pairs"] for r in overlap.overlap_pairs_by(others, index, ["pid"]).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[2] == "t0" and b[2] == "t1" and a[1] == b[1] and overlaps(a, b, True):
                want[b[1]] = want.get(b[1], 0) + 1
    assert got == want


def test_overlap_relation_is_symmetric(spark):
    df = spark.createDataFrame(random_spans(7), SCHEMA)
    total = overlap.with_overlaps(df, ["pid"]).agg(F.sum("overlaps")).first()[0]
    assert total % 2 == 0


def test_compare_tables(spark):
    a = spark.createDataFrame([("sex", "F", 10.0), ("sex", "M", 20.0)], "variable string, value string, pct double")
    b = spark.createDataFrame([("sex", "F", 12.5)], "variable string, value string, pct double")
    rows = overlap.compare_tables(a, b, "pct", ("yes", "no")).collect()
    assert [(r["value"], r["difference"], r["change"]) for r in rows] == [("F", 2.5, "2.5% improvement")]


# --- periods ------------------------------------------------------------------

PATHWAYS = [(1, 1, "x", day(0), day(80), 80, did.CONTROL), (2, 1, "x", day(10), day(160), 150, "19-30 weeks"), (3, 2, "y", day(5), day(85), 80, did.CONTROL)]
PATHWAY_SCHEMA = "pathway_id int, pid int, tfc string, start_date date, stop_date date, wt int, group string"


def dense(spec_period, until, follow_up):
    """The day-by-day panel: {(pathway, period): days}."""
    out = {}
    for p in PATHWAYS:
        rows = [d for d in range((until - p[3]).days + 1) if d <= follow_up(p)]
        if rows and rows[-1] == follow_up(p):
            for d in rows:
                out.setdefault((p[0], spec_period(p, d)), []).append(p[3] + datetime.timedelta(days=d))
    return out


CASES = {
    "own_wait": (periods.own_wait(), lambda p, d: 1 if d < p[5] else 100 if d < p[5] + 28 else 0, lambda p: 2 * p[5] + 28),
    "half_year": (periods.own_wait(follow_up=180), lambda p, d: 1 if d < p[5] else 100 if d < p[5] + 28 else 0, lambda p: p[5] + 208),
    "fixed": (periods.fixed_cut(126, 28), lambda p, d: 1 if d < 126 else 100 if d < 154 else 0, lambda p: 334),
    "threshold": (
        periods.threshold(85, 100, "pathway"),
        lambda p, d: 0 if d <= min(p[5], 85) else 1,
        lambda p: min(p[5], 85) + 100,
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("until", [day(189), day(338), day(500)])
def test_sparse_periods_equal_the_dense_panel(spark, name, until):
    spec, period, follow_up = CASES[name]
    rng = random.Random(9)
    events = [(rng.randrange(1, 3), day(rng.randrange(0, 420)), 1) for _ in range(400)]
    events = [e for e in events if e[1] <= until]
    sample = periods.assign_periods(spark.createDataFrame(PATHWAYS, PATHWAY_SCHEMA), spec, F.lit(until))
    act = spark.createDataFrame(events, "pid int, day date, use int")
    rows = periods.period_totals(sample, act, ["use"], ["pathway_id", "pid"], (0, 1, 100)).collect()
    got = {(r["pathway_id"], r["time_period"]): (r["use"], (r["hi"] - r["lo"]).days + 1) for r in rows}
    owner = {p[0]: p[1] for p in PATHWAYS}
    want = {}
    for (pathway, code), days in dense(period, until, follow_up).items():
        dates = set(days)
        want[(pathway, code)] = (sum(e[0] == owner[pathway] and e[1] in dates for e in events), len(days))
    assert got == want


def test_washout_boundary_days(spark):
    one = spark.createDataFrame(PATHWAYS[:1], PATHWAY_SCHEMA)
    marks = {79: 1, 80: 100, 107: 100, 108: 0, 188: 0}
    sample = periods.assign_periods(one, periods.own_wait(), F.lit(day(188)))
    assert sample.first()["max_time_covered"] == 188
    for d, code in marks.items():
        act = spark.createDataFrame([(1, day(d), 1)], "pid int, day date, use int")
        rows = periods.period_totals(sample, act, ["use"], ["pathway_id", "pid"], (0, 1, 100)).collect()
        assert [r["time_period"] for r in rows if r["use"]] == [code]
    assert periods.assign_periods(one, periods.own_wait(), F.lit(day(187))).count() == 0


def test_patient_completeness_keeps_all_their_pathways(spark):
    spec = periods.fixed_cut(126, 28, 168, complete="patient")
    pw = spark.createDataFrame(PATHWAYS, PATHWAY_SCHEMA)
    kept = periods.assign_periods(pw, spec, F.lit(day(322))).select("pathway_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2]
