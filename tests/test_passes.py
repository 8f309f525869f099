"""How often rows are read and whether they move, for models of few cells."""

import math

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import matching, regress


@pytest.fixture
def no_size_check(spark):
    """Only hints broadcast, as with tables too large for Catalyst's size check."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    rows = [(f"m{k % 2}", "ab"[k // 2 % 2], "xyz"[k // 4 % 3], None if k == 7 else float(k * k % 23)) for k in range(240)]
    return spark.createDataFrame([*rows, ("m0", "c", "x", None)], "m string, g string, f string, y double")


def _counted(df):
    """The rows, and the number of times they were read so far."""
    seen, n = df.sparkSession.sparkContext.accumulator(0), df.count()

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema), lambda: seen.value / n


def test_a_model_reads_its_rows_twice_and_once_with_a_centre(spark):
    df, reads = _counted(_rows(spark))
    first = regress.ols(df, "y", ["g", "f"], by="m", vcov="HC3")
    assert reads() == 2
    # a level whose only row has no outcome is a dropped term, as ever
    assert {r["term"] for r in first.table().filter("dropped").collect()} == {"g[c]"}
    second = regress.ols(df, "y", ["g", "f"], by="m", vcov="HC3", centre={"m0": 12.0, "m1": -3.0})
    assert reads() == 3
    regress.breusch_pagan(second, regress.influence(second, df, fitted=True))
    assert reads() == 4
    for a, b in zip(first.table().collect(), second.table().collect()):
        assert (a["model"], a["term"], a["dropped"]) == (b["model"], b["term"], b["dropped"])
        assert a["dropped"] or (math.isclose(a["estimate"], b["estimate"], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a["se"], b["se"], rel_tol=1e-9))
    for key in first.fits:
        assert math.isclose(first.fits[key].r_squared, second.fits[key].r_squared, rel_tol=1e-9)


@pytest.mark.parametrize("fitted", [False, True])
def test_influence_leaves_the_rows_where_they_are(spark, no_size_check, fitted):
    df = _rows(spark)
    model = regress.ols(df, "y", ["g", "f"], by="m")
    marked = regress.influence(model, df, fitted=fitted)
    assert "Exchange hashpartitioning" not in _plan(marked)
    assert marked.count() == 239
    want = {(r["model"], r["term"]): r["estimate"] for r in model.table().collect()}
    for r in marked.select("m", "g", "f", "fitted").distinct().collect():
        terms = ["Intercept", *([f"g[{r['g']}]"] if r["g"] != "a" else []), *([f"f[{r['f']}]"] if r["f"] != "x" else [])]
        assert math.isclose(r["fitted"], sum(want[r["m"], t] for t in terms), rel_tol=1e-9)


def _patients(spark):
    rows = [(k, "uvw"[k % 3], "st"[k // 3 % 2], int(k % 5 == 0 or k % 7 == 1)) for k in range(210)]
    return spark.createDataFrame(rows, "pid long, u string, v string, treated int")


def test_scores_of_few_cells_leave_the_rows_where_they_are(spark, no_size_check):
    df = _patients(spark)
    scored = matching.propensity(df, "treated", ["u", "v"])
    assert "Exchange hashpartitioning" not in _plan(scored)
    assert scored.count() == 210 and scored.select("u", "v", "propensity_score").distinct().count() == 6


def test_nearest_match_reads_its_rows_twice(spark):
    rows = [(k, float(k % 17) / 4, int(k % 3 == 0)) for k in range(90)]
    df, reads = _counted(spark.createDataFrame(rows, "pid long, propensity_score double, treated int"))
    got = {r["control_pid"]: (r["score_diff"], r["treated_pid"]) for r in matching.nearest_match(df).collect()}
    assert reads() == 2
    assert got == {p: min((abs(s - t), q) for q, t, on in rows if on) for p, s, on in rows if not on}
