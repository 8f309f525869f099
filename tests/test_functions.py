"""Band edges, outcome rules, suppression and tail values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.functions import flags, tails
from cohortspan.operators import suppress

EDGES = {
    "5": {0: "<= 6 weeks", 72: "<= 6 weeks", 73: "<= 18 weeks", 126: "<= 18 weeks", 127: "19-30 weeks", 210: "19-30 weeks",
          211: "31-42 weeks", 294: "31-42 weeks", 295: "> 42 weeks", None: "unknown"},
    "2": {126: "<= 18 weeks", 127: "> 18 weeks", None: "unknown"},
    "3": {84: "<= 12 weeks", 85: "<= 18 weeks", 126: "<= 18 weeks", 127: "> 18 weeks"},
    "granular": {-1: "unknown", 0: "0-3 weeks", 21: "0-3 weeks", 22: "4-6 weeks", 42: "4-6 weeks", 43: "7-9 weeks", 126: "16-18 weeks",
                 127: "19-21 weeks", 336: "46-48 weeks", 337: "49-51 weeks", 357: "49-51 weeks", 358: "52+ weeks", None: "unknown"},
    "bucket_5": {83: "< 12 weeks", 84: "12-18 weeks", 126: "12-18 weeks", 127: "19-36 weeks", 245: "19-36 weeks", 246: "37-52 weeks",
                 364: "37-52 weeks", 365: "> 52 weeks", None: None},
    "bucket_4": {126: "< 18 weeks", 127: "19-36 weeks", 252: "19-36 weeks", 253: "37-52 weeks", 364: "37-52 weeks", 365: "> 52 weeks"},
    "old_4": {84: "<= 12 weeks", 126: "<= 18 weeks", 252: "19-36 weeks", 253: "> 36 weeks"},
    "6": {84: "<= 12 weeks", 126: "<= 18 weeks", 168: "19-24 weeks", 169: "25-30 weeks", 210: "25-30 weeks", 294: "31-42 weeks", 295: "> 42 weeks"},
}


@pytest.mark.parametrize("scheme", sorted(EDGES))
def test_wait_band_edges(spark, scheme):
    rows = spark.createDataFrame([(k,) for k in EDGES[scheme]], "wt int")
    got = {r["wt"]: r["band"] for r in rows.select("wt", b.band("wt", b.WAIT_BANDS[scheme]).alias("band")).collect()}
    assert got == EDGES[scheme]


def test_characteristic_bands(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (10, 2, 2), (11, 3, 5), (85, -1, None), (None, None, 1)], "age int, ltc int, frail int")
    out = rows.select(b.band("age", b.AGE), b.band("ltc", b.CONDITIONS), b.band("frail", b.FRAILTY)).collect()
    assert [tuple(r) for r in out] == [
        ("unknown", "No LTCs", "Not Frail"),
        ("<= 10", "Single LTC", "Not Frail"),
        ("<= 10", "Comorbidities", "Frail"),
        ("11-17", "Multimorbidities", "Frail"),
        ("84+", "unknown", "Frail"),
        ("unknown", "unknown", "Not Frail"),
    ]


def test_quarter_band(spark):
    days = ["2021-12-31", "2022-01-01", "2022-06-30", "2023-07-01", "2024-03-31", "2024-04-01"]
    rows = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in days], "d date")
    assert [r[0] for r in rows.select(b.quarter_band("d")).collect()] == [None, "mar22", "jun22", "sep23", "mar24", None]


def test_outcome_reason_precedence_and_nulls(spark):
    rows = spark.createDataFrame(
        [(30, "a|IRTT", "x"), (30, "OPRT", "x"), (30, None, "x"), (32, None, None), (99, None, "week_end_date"), (40, None, None), (None, "IRTT", None)],
        "status int, change_type string, end_type string",
    )
    assert [r[0] for r in rows.select(flags.outcome_reason()).collect()] == [
        "treatment_admitted", "treatment_non_admitted", None, "non_treatment_monitoring", "unknown", "non_treatment_other", None,
    ]


def test_attendance_flags(spark):
    rows = spark.createDataFrame([("5 dna",), ("2 cancel(pat)",), ("4 cancel(hos)",), (None,)], "attendance_status string")
    out = rows.withColumns(flags.attendance_flags()).drop("attendance_status").collect()
    assert [tuple(r) for r in out] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_suppression_modes(spark):
    cells = spark.createDataFrame([("a", 4, 40.0, 10), ("b", 5, 4.5, 111), ("c", 3, 100.0, 3)], "v string, n int, pct double, total int")

    def texts(**options):
        out = suppress.suppress(cells, [("n", "pct")], **options).orderBy("v")
        return [(r["n_text"], r["pct_text"]) for r in out.collect()]

    assert texts() == [("<5", "<5"), ("5", "4.5"), ("<5", "<5")]
    assert texts(mode="independent") == [("<5", "40.0"), ("5", "<5"), ("<5", "100.0")]
    assert texts(mode="row", total="total", mark="< 5") == [("< 5", "< 5"), ("5", "4.5"), ("< 5", "< 5")]
    stats = suppress.suppress(cells, stats=["pct"], mode="stat").orderBy("v")
    assert [r["pct_text"] for r in stats.collect()] == ["40.0", "<5", "100.0"]


def test_secondary_suppression(spark):
    cells = spark.createDataFrame([("a", "x", 2), ("a", "y", 9), ("a", "z", 30), ("b", "x", 7), ("b", "y", 8)], "v string, band string, n int")
    out = suppress.secondary_flag(cells, ["v"], tie="band").orderBy("v", "band").collect()
    assert [r["suppressed"] for r in out] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "got, want",
    [
        (tails.chi2_tail(3.841458820694124, 1), 0.05),
        (tails.chi2_tail(18.307038053275146, 10), 0.05),
        (tails.chi2_tail(0.0, 3), 1.0),
        (tails.t_two_sided(2.2281388519649385, 10), 0.05),
        (tails.t_two_sided(12.706204736432095, 1), 0.05),
        (tails.t_two_sided(-1.959963985, 1e9), 0.05),
        (tails.normal_two_sided(1.959963984540054), 0.05),
    ],
)
def test_tail_values(got, want):
    assert math.isclose(got, want, rel_tol=1e-7)


def test_tail_even_dof_closed_form():
    for x in (0.3, 2.0, 9.5, 40.0):
        want = math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)
        assert math.isclose(tails.chi2_tail(x, 6), want, rel_tol=1e-10)


def test_p_columns(spark):
    rows = spark.createDataFrame([(3.841458820694124, 1), (None, 2), (5.0, 0)], "s double, dof int")
    got = [r[0] for r in rows.select(tails.chi2_p("s", "dof")).collect()]
    assert math.isclose(got[0], 0.05, rel_tol=1e-9) and got[1:] == [None, None]
    t = spark.createDataFrame([(2.2281388519649385, 10.0)], "t double, dof double").select(tails.t_p("t", "dof")).first()[0]
    assert math.isclose(t, 0.05, rel_tol=1e-9)
    assert spark.range(1).select(F.lit(1)).count() == 1
