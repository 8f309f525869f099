"""Large means, odd values and absent levels, where sums lose digits or divide by nothing."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.functions import tails
from cohortspan.operators import association, did, ordered, regress, running, survival
from tests.test_models import dummy_twfe, panel_frame


def test_t_tail_at_many_degrees_of_freedom():
    for t in (0.1, 1.0, 2.5):
        for dof in (1e7, 1e9, 1e11, 1e13):
            assert math.isclose(tails.t_two_sided(t, dof), math.erfc(t / math.sqrt(2)), rel_tol=2e-6)
        # both ways agree where they meet
        near = tails.beta_lower(5e5, 0.5, 1e6 / (1e6 + t * t), t * t / (1e6 + t * t))
        assert math.isclose(tails.t_two_sided(t, 1e6 + 1), near, rel_tol=1e-7)
    assert tails.t_two_sided(math.inf, 5) == 0.0


def test_a_fraction_that_does_not_settle_is_an_error(monkeypatch):
    monkeypatch.setattr(tails, "_rounds", lambda size: 2)
    with pytest.raises(ArithmeticError):
        tails.gamma_tail(50.0, 60.0)
    with pytest.raises(ArithmeticError):
        tails.beta_lower(5.0, 7.0, 0.3)


@pytest.mark.parametrize("ranges", [1, 7])
def test_nan_is_the_largest_value(spark, ranges):
    values = [3.0, math.nan, -math.inf, 1.0, math.inf, 2.0, 5.0, 4.0, 0.0]
    df = spark.createDataFrame([(v, 2) for v in values], "v double, n int")
    got = [(r["v"], r["before"]) for r in ordered.running_count(df, "v", "n", ranges).orderBy("v").collect()]
    assert [b for _, b in got] == list(range(0, 18, 2))
    assert math.isnan(got[-1][0])


def test_spearman_with_nan_does_not_depend_on_the_ranges(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 200).astype(float)
    y = x + rng.normal(0, 9, 200)
    y[:7] = math.nan
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    key = "spark.sql.shuffle.partitions"
    before, got = spark.conf.get(key), []
    try:
        for n in ("1", "7"):
            spark.conf.set(key, n)
            got.append(association.spearman(df, "x", "y").first()["rho"])
    finally:
        spark.conf.set(key, before)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    want = np.corrcoef(rank(x), rank(np.where(np.isnan(y), np.inf, y)))[0, 1]
    assert np.allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("vcov", ["iid", "HC1", "CRV1"])
def test_fixed_effects_at_a_large_mean(spark, vcov):
    rows = panel_frame()
    rng = np.random.default_rng(2)
    rows["max_time_covered"] = 70
    rows["use"] = np.round(1e8 + rng.normal(0, 1, len(rows)), 3)
    for r in did.did_twfe(spark.createDataFrame(rows), ["use"], vcov=vcov).collect():
        shifted = rows.assign(use=rows["use"] - 1e8)
        coef, errors = dummy_twfe(shifted, "use", r["comparison"])
        assert math.isclose(r["coef"], coef, rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(r["se"], errors[vcov], rel_tol=1e-4)


def test_numbers_with_a_large_mean_stay_in_the_model(spark):
    rng = np.random.default_rng(3)
    n = 300
    year, g = 1e6 + rng.normal(0, 1, n), rng.integers(0, 2, n)
    y = 5e7 + 3 * (year - 1e6) + 2 * g + 0.5 * g * (year - 1e6) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(float(a), "ab"[b], float(c)) for a, b, c in zip(year, g, y)], "year double, g string, y double")
    x = np.column_stack([np.ones(n), g, year - 1e6, g * (year - 1e6)])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ (y - 5e7)
    e = y - 5e7 - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    meat = (x * (e / (1 - h))[:, None]).T @ (x * (e / (1 - h))[:, None])
    for vcov, cov in (("iid", inverse * (e @ e) / (n - 4)), ("HC3", inverse @ meat @ inverse)):
        model = regress.ols(df, "y", ["g"], ["year"], interactions=[("g", "year")], vcov=vcov)
        got = {r["term"]: r for r in model.table().collect()}
        assert not any(r["dropped"] for r in got.values())
        for term, k in (("year", 2), ("g[b]:year", 3)):
            assert math.isclose(got[term]["estimate"], beta[k], rel_tol=1e-6)
            assert math.isclose(got[term]["se"], math.sqrt(cov[k, k]), rel_tol=1e-5)
    marked = regress.influence(model, df).orderBy("y").toPandas()
    np.testing.assert_allclose(marked["leverage"], h[np.argsort(y)], rtol=1e-6)
    np.testing.assert_allclose(marked["residual"], e[np.argsort(y)], atol=1e-6)
    summary = model.summary().first()
    assert (summary["n"], summary["terms"], summary["dof"]) == (n, 4, n - 4)
    assert math.isclose(summary["r_squared"], 1 - e @ e / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)


def test_a_number_without_its_lower_products_is_only_scaled(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(10, 2, 200), rng.integers(0, 3, 200)
    y = 1 + 2 * x * (g == 1) + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(float(a), str(b), float(c)) for a, b, c in zip(x, g, y)], "x double, g string, y double")
    design = regress.Design({"g": ("0", "1", "2")}, ("x",), (("g", "x"),))
    design = regress.Design({"g": ("0", "1", "2")}, ("x",), (("g", "x"),)) if len(design.columns) == 6 else design
    got = regress.ols(df, "y", (), design=design).table().collect()
    m = np.column_stack([np.ones(200), g == 1, g == 2, x, (g == 1) * x, (g == 2) * x]).astype(float)
    np.testing.assert_allclose([r["estimate"] for r in got], np.linalg.lstsq(m, y, rcond=None)[0], rtol=1e-7)


def test_influence_of_boolean_and_double_factors(spark):
    rows = [(k % 2 == 0, 1e10 if k % 3 else 2.5, float(k % 7) + 2 * (k % 2 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "b boolean, d double, y double")
    model = regress.ols(df, "y", ["b", "d"])
    x = np.array([[1, r[0], r[1] != 2.5] for r in rows], float)
    # levels sort as text: 1.0E10 before 2.5
    x[:, 2] = 1 - x[:, 2]
    y = np.array([r[2] for r in rows])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = sorted((r["b"], r["d"], r["y"], round(r["fitted"], 9)) for r in regress.influence(model, df).collect())
    assert got == sorted((*r, round(f, 9)) for r, f in zip(rows, fitted.tolist()))
    by = regress.ols(df, "y", ["d"], by="b")
    assert regress.drop_influential(by, regress.influence(by, df)).count() <= 60


def test_cox_lists_levels_without_rows_or_events(spark):
    rng = np.random.default_rng(6)
    rows = [(int(t), int(e), g) for t, e, g in zip(rng.integers(1, 30, 200), rng.integers(0, 2, 200), rng.choice(list("ab"), 200))]
    clean = survival.cox_ph(spark.createDataFrame(rows, "t int, e int, g string"), "t", "e", "g", ["a", "b"]).collect()
    more = rows + [(t, 0, "c") for t in range(1, 30)]
    got = survival.cox_ph(spark.createDataFrame(more, "t int, e int, g string"), "t", "e", "g", ["a", "b", "c", "d"]).collect()
    assert [(r["level"], r["dropped"]) for r in got] == [("b", False), ("c", True), ("d", True)]
    assert math.isclose(got[0]["coef"], clean[0]["coef"], rel_tol=1e-9) and got[1]["coef"] is None
    with pytest.raises(ValueError, match="reference"):
        survival.cox_ph(spark.createDataFrame(more, "t int, e int, g string"), "t", "e", "g", ["c", "a", "b"])


def test_cox_likelihood_grows_from_a_far_start(spark):
    """Nearly separated groups: a full step overshoots."""
    rows = [(k, 1, "a") for k in range(1, 40)] + [(k + 38, 1, "b") for k in range(1, 60)]
    got = survival.cox_ph(spark.createDataFrame(rows, "t int, e int, g string"), "t", "e", "g", ["a", "b"]).first()
    assert got["coef"] < -3 and math.isfinite(got["se"])


def test_inverted_intervals_are_empty(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    events = spark.createDataFrame([(1, day(k), 1) for k in range(10)], "pid int, day date, use int")
    rows = spark.createDataFrame([(1, day(6), day(3)), (1, day(3), day(6)), (1, day(4), day(4))], "pid int, lo date, hi date")
    got = running.interval_totals(rows, events, ["pid"], "lo", "hi", ["use"]).collect()
    assert sorted((r["lo"], r["use"]) for r in got) == [(day(3), 4), (day(4), 1), (day(6), 0)]


def test_tie_sums_of_any_length():
    tops = np.array([1.0, 1.5, 40.0, 33.25, 1e9, 5000.5, 120_000.0])
    counts = np.array([1, 1, 40, 3, 7, 5000, 120_000])
    for power in (1, 2):
        want = [np.sum((t - np.arange(d)) ** -float(power)) for t, d in zip(tops, counts)]
        np.testing.assert_allclose(survival._harmonic(tops, counts, power), want, rtol=1e-12)


def test_salted_joins_give_the_same_rows(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id % 7 as v", "id as x")
    values = spark.range(6).selectExpr("id as v", "id * 10 as w")
    want = sorted(map(tuple, ordered.join_values(rows, values, "v").collect()))
    monkeypatch.setattr(ordered, "BROADCAST_VALUES", 0)
    assert sorted(map(tuple, ordered.join_values(rows, values, "v").collect())) == want
    assert len(want) == sum(k % 7 < 6 for k in range(500))


def test_no_row_window_in_one_task(spark):
    rows = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"), F.lit(1).alias("n"))
    plan = ordered.running_count(rows.groupBy("x").agg(F.sum("n").alias("n")), "x", "n")._jdf.queryExecution().executedPlan().toString()
    # the only single-task window is over the sums of ranges
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("_n" in line or "Exchange" in line for line in single)
    assert "hashpartitioning(_range" in plan


def test_group_statistics_equal_sorted_values(spark):
    """Exact quantiles of skewed, tied, null and NaN-free columns, with a group of nearly all rows."""
    rng = random.Random(3)
    rows = [("big" if rng.random() < 0.9 else rng.choice("xyz"), rng.randrange(10**6) if rng.random() < 0.7 else 7, rng.choice([None, rng.randrange(3)]), i % 11) for i in range(3000)]
    rows += [("one", 5, None, 1), ("none", None, None, 1)]
    df = spark.createDataFrame(rows, "g string, a long, b long, w long").repartition(5)
    got = ordered.group_statistics(df, ["g"], ["a", "b"], [0.25, 0.5, 1.0], lambda d, names: d.select("g", *names), "w")
    found = {(r["g"], r["cell"]): r for r in got.collect()}
    want = {}
    for g, *values, w in rows:
        for cell, v in enumerate(values):
            if v is not None:
                want.setdefault((g, cell), []).append((v, w))
    assert found.keys() == want.keys()
    for key, pairs in want.items():
        values, r = sorted(v for v, _ in pairs), found[key]
        n = len(values)
        mean = sum(values) / n
        assert (r["n"], r["sum"], r["weight"]) == (n, sum(values), sum(w for _, w in pairs))
        assert [r["q0"], r["q1"], r["q2"]] == [values[max(1, math.ceil(n * s)) - 1] for s in (0.25, 0.5, 1.0)]
        assert r["mean"] == pytest.approx(mean)
        assert r["stddev"] == (pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))) if n > 1 else None)
    assert ordered.group_statistics(df.limit(0), ["g"], ["a", "b"], [0.5], lambda d, names: d.select("g", *names), "w").count() == 0
