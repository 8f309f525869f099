"""Estimators against direct numpy computations."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import association, did, matching, ordered, regress, survival

# --- two-way fixed effects ----------------------------------------------------

MEASURES = ("use", "cost")


def panel_frame(seed=1, patients=30):
    rng = random.Random(seed)
    groups = (did.CONTROL, *did.INTERVENTIONS[:2])
    rows = []
    for pid in range(patients):
        # patient 0 has many pathways, of every group
        for k in range(25 if pid == 0 else rng.randrange(1, 4)):
            group = groups[rng.randrange(3)]
            wt = rng.randrange(73, 300)
            for period in (0, 1):
                effect = 4 if group != did.CONTROL and period == 1 else 0
                rows.append((pid, f"t{k}", group, 2 * wt + 28, period, rng.randrange(10) + effect, rng.randrange(1000)))
    return pd.DataFrame(rows, columns=["pid", "tfc", "group", "max_time_covered", "time_period", "use", "cost"])


def dummy_twfe(rows, y, comparison):
    """Least squares with a dummy per patient, and three variances."""
    data = rows[rows["group"].isin([did.CONTROL, comparison])].reset_index(drop=True)
    target = (data[y] / data["max_time_covered"] * 7).to_numpy(float)
    d = ((data["group"] != did.CONTROL) & (data["time_period"] == 1)).to_numpy(float)
    p = (data["time_period"] == 1).to_numpy(float)
    dummies = pd.get_dummies(data["pid"]).to_numpy(float)
    x = np.column_stack([d, p, dummies])
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    e = target - x @ beta
    rest = x[:, 1:]
    d_in = d - rest @ np.linalg.lstsq(rest, d, rcond=None)[0]
    dd, n, g = d_in @ d_in, len(data), dummies.shape[1]
    scores = pd.Series(d_in * e).groupby(data["pid"]).sum().to_numpy()
    return beta[0], {
        "iid": math.sqrt(e @ e / (n - g - 2) / dd),
        "HC1": math.sqrt(n / (n - g - 2) * ((d_in * e) @ (d_in * e))) / dd,
        "CRV1": math.sqrt(g / (g - 1) * (n - 1) / (n - 3) * (scores @ scores)) / dd,
    }


@pytest.mark.parametrize("vcov", ["iid", "HC1", "CRV1"])
def test_twfe_equals_dummy_regression(spark, vcov):
    rows = panel_frame()
    got = did.did_twfe(spark.createDataFrame(rows), MEASURES, vcov=vcov).collect()
    assert len(got) == 4
    for r in got:
        coef, errors = dummy_twfe(rows, r["activity"], r["comparison"])
        assert math.isclose(r["coef"], coef, rel_tol=1e-8)
        assert math.isclose(r["se"], errors[vcov], rel_tol=1e-6)
        assert math.isclose(r["ci_high"] - r["ci_low"], 2 * 1.96 * r["se"], rel_tol=1e-9)


def test_twfe_is_zero_for_a_constant(spark):
    rows = panel_frame().assign(use=3, max_time_covered=200)
    got = did.did_twfe(spark.createDataFrame(rows), ("use",)).collect()
    assert all(abs(r["coef"]) < 1e-12 for r in got)


def test_results_agree_with_totals(spark):
    panel = spark.createDataFrame(panel_frame())
    results = {(r["activity"], r["comparison"]): r.asDict() for r in did.did_results(panel, MEASURES).collect()}
    for r in did.did_totals(panel, MEASURES).collect():
        for name, value in r.asDict().items():
            assert results[(r["activity"], r["comparison"])][name] == value
    assert all(0 <= r["p_value"] <= 1 for r in results.values())
    rates = {(r["activity"], r["comparison"]): r for r in did.did_rates(did.did_totals(panel, MEASURES)).collect()}
    for r in did.did_results(panel, MEASURES, "avg_weekly_use").collect():
        assert math.isclose(r["total_excess"], rates[(r["activity"], r["comparison"])]["total_excess"], rel_tol=1e-9)


def test_missing_group_gives_no_comparison(spark):
    panel = panel_frame()
    only = spark.createDataFrame(panel[panel["group"] != did.CONTROL])
    assert did.did_twfe(only, MEASURES).count() == 0
    assert did.did_totals(only, MEASURES).count() == 0


def test_binarise_and_whole_units(spark):
    costs = did.whole_units(spark.createDataFrame([(2.5, 1.2), (-0.4, None)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in costs.collect()] == [(3, 1), (0, None)]
    out = did.binarise(spark.createDataFrame([(3, 0), (0, 7)], "a int, b int"), ["a"]).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 7)]


# --- least squares --------------------------------------------------------------


def regression_frame(seed=2, n=400):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(
        {"g": rng.choice(["a", "b"], n), "f": rng.choice(["x", "y", "z"], n), "age": rng.integers(18, 30, n).astype(float)}
    )
    data["y"] = 1 + (data.g == "b") * 2 + (data.f == "z") * (data.g == "b") + 0.1 * data.age + rng.normal(0, 1 + (data.f == "y"), n)
    return data


def dense_design(data):
    names = ["Intercept", "g[b]", "f[y]", "f[z]", "age", "g[b]:f[y]", "g[b]:f[z]"]
    b, y, z = (data.g == "b").to_numpy(float), (data.f == "y").to_numpy(float), (data.f == "z").to_numpy(float)
    return names, np.column_stack([np.ones(len(data)), b, y, z, data.age, b * y, b * z])


def fit(spark, data, vcov="iid"):
    df = spark.createDataFrame(data).repartition(3)
    return df, regress.ols(df, "y", ["g", "f"], ["age"], [("g", "f")], vcov=vcov)


def test_ols_and_hc3(spark):
    data = regression_frame()
    names, x = dense_design(data)
    y = data.y.to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    meat = (x * (e / (1 - h))[:, None]).T @ (x * (e / (1 - h))[:, None])
    errors = {"iid": inverse * (e @ e) / (len(y) - 7), "HC3": inverse @ meat @ inverse}
    for vcov, cov in errors.items():
        table = {r["term"]: r for r in fit(spark, data, vcov)[1].table().collect()}
        assert list(table) == names
        for i, name in enumerate(names):
            assert math.isclose(table[name]["estimate"], beta[i], rel_tol=1e-8)
            assert math.isclose(table[name]["se"], math.sqrt(cov[i, i]), rel_tol=1e-7)


def test_influence_breusch_pagan_and_vif(spark):
    data = regression_frame()
    names, x = dense_design(data)
    y = data.y.to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    e = y - x @ (inverse @ x.T @ y)
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    cooks = e**2 / (7 * (e @ e) / (len(y) - 7)) * h / (1 - h) ** 2
    df, model = fit(spark, data)
    marked = regress.influence(model, df)
    got = marked.orderBy("y").toPandas()
    order = np.argsort(y)
    np.testing.assert_allclose(got["cooks_d"], cooks[order], rtol=1e-7)
    np.testing.assert_allclose(got["leverage"], h[order], rtol=1e-8)
    assert regress.drop_influential(model, marked).count() == (cooks <= 4 / len(y)).sum()
    u = e**2
    r2 = 1 - ((u - x @ np.linalg.lstsq(x, u, rcond=None)[0]) ** 2).sum() / ((u - u.mean()) ** 2).sum()
    test = regress.breusch_pagan(model, marked).first()
    assert math.isclose(test["statistic"], len(y) * r2, rel_tol=1e-6) and test["dof"] == 6
    for r in regress.vif(model).collect():
        j = names.index(r["variable"])
        others = np.delete(x, j, axis=1)
        rest = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        total = (x[:, j] ** 2).sum() if j == 0 else ((x[:, j] - x[:, j].mean()) ** 2).sum()
        assert math.isclose(r["vif"], total / (rest @ rest), rel_tol=1e-6)


def test_collinear_terms_are_reported_as_dropped(spark):
    data = regression_frame()
    data["copy"] = data["g"].map({"a": "k", "b": "l"})
    model = regress.ols(spark.createDataFrame(data), "y", ["g", "copy"])
    dropped = {r["term"]: r["dropped"] for r in model.table().collect()}
    assert dropped == {"Intercept": False, "g[b]": False, "copy[l]": True}


def test_identifier_is_no_category(spark):
    df = spark.range(1500).selectExpr("cast(id as string) as id", "id % 5 as g", "cast(id as double) as y")
    with pytest.raises(ValueError, match="1500"):
        regress.ols(df, "y", ["g", "id"])
    with pytest.raises(ValueError, match="more than 4"):
        regress.make_design(df, ["g"], max_columns=4)
    assert len(regress.make_design(df, ["g"], max_columns=5).columns) == 5


# --- survival ---------------------------------------------------------------------

TIMES = [(6, 1, "a"), (6, 1, "a"), (6, 1, "a"), (6, 0, "a"), (7, 1, "a"), (9, 0, "b"), (10, 1, "a"), (10, 0, "b"), (11, 0, "b"),
         (13, 1, "b"), (16, 1, "a"), (17, 0, "b"), (19, 0, "b"), (20, 0, "b"), (22, 1, "a"), (23, 1, "b"), (25, 0, "b"), (32, 0, "b")]


def test_kaplan_meier(spark):
    df = spark.createDataFrame(TIMES, "t int, e int, g string")
    got = {r["time"]: r["survival"] for r in survival.kaplan_meier(df, "t", "e").collect()}
    alive = 1.0
    for t in sorted(got):
        n = sum(x[0] >= t for x in TIMES)
        alive *= 1 - sum(x[0] == t and x[1] for x in TIMES) / n
        assert math.isclose(got[t], alive, rel_tol=1e-12)
    all_gone = spark.createDataFrame([(1, 1), (2, 1)], "t int, e int")
    assert [r["survival"] for r in survival.kaplan_meier(all_gone, "t", "e").orderBy("time").collect()] == [0.5, 0.0]


def efron_newton(rows, levels):
    """Row-by-row partial likelihood with Efron ties."""
    beta = np.zeros(len(levels) - 1)
    x = {r: np.array([float(r[2] == level) for level in levels[1:]]) for r in rows}
    for _ in range(30):
        gradient, information = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for t in sorted({r[0] for r in rows if r[1]}):
            risk = [r for r in rows if r[0] >= t]
            dead = [r for r in rows if r[0] == t and r[1]]
            for j in range(len(dead)):
                share = j / len(dead)
                w = lambda group: [(math.exp(x[r] @ beta), x[r]) for r in group]
                s0 = sum(a for a, _ in w(risk)) - share * sum(a for a, _ in w(dead))
                s1 = sum(a * v for a, v in w(risk)) - share * sum(a * v for a, v in w(dead))
                s2 = sum(a * np.outer(v, v) for a, v in w(risk)) - share * sum(a * np.outer(v, v) for a, v in w(dead))
                gradient += x[dead[j]] - s1 / s0
                information += s2 / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(information, gradient)
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def test_cox_efron(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1, 12), int(rng.random() < 0.7), rng.choice("abc")) for _ in range(90)]
    want, errors = efron_newton(rows, "abc")
    got = survival.cox_ph(spark.createDataFrame(rows, "t int, e int, g string"), "t", "e", "g", ["a", "b", "c"]).collect()
    for r, b, s in zip(got, want, errors):
        assert math.isclose(r["coef"], b, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["se"], s, rel_tol=1e-6)


def test_long_tie_sums():
    for top, d in ((5000.5, 5000), (1e7, 100_000), (120_000.0, 120_000)):
        j = np.arange(d)
        for power in (1, 2):
            got = survival._harmonic(np.array([top]), np.array([d]), power)[0]
            assert math.isclose(got, np.sum((top - j) ** -float(power)), rel_tol=1e-10)


def test_log_rank(spark):
    df = spark.createDataFrame(TIMES, "t int, e int, g string")
    got = survival.log_rank(df, "t", "e", "g", ("a", "b")).first()
    o = e = v = 0.0
    for t in {x[0] for x in TIMES if x[1]}:
        risk = [x for x in TIMES if x[0] >= t]
        n, n1 = len(risk), sum(x[2] == "a" for x in risk)
        d = sum(x[0] == t and x[1] for x in TIMES)
        o += sum(x[0] == t and x[1] and x[2] == "a" for x in TIMES)
        e += d * n1 / n
        v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    assert math.isclose(got["statistic"], (o - e) ** 2 / v, rel_tol=1e-10)
    assert math.isclose(got["p_value"], math.erfc(math.sqrt(got["statistic"] / 2)), rel_tol=1e-9)


# --- association ----------------------------------------------------------------------


def test_chi_square_with_and_without_correction(spark):
    cells = {("F", "x"): 10, ("F", "y"): 20, ("M", "x"): 30, ("M", "y"): 5}
    rows = [(s, g, s + str(i % 3)) for (s, g), n in cells.items() for i in range(n)]
    df = spark.createDataFrame(rows, "sex string, group string, other string")
    got = {r["variable"]: r for r in association.chi_square(df, ["sex", "other"], "group", ["x", "y"]).collect()}
    n = 65
    expected = {k: sum(v for q, v in cells.items() if q[0] == k[0]) * sum(v for q, v in cells.items() if q[1] == k[1]) / n for k in cells}
    want = sum((abs(cells[k] - expected[k]) - 0.5) ** 2 / expected[k] for k in cells)
    assert math.isclose(got["sex"]["statistic"], want, rel_tol=1e-12) and got["sex"]["dof"] == 1
    assert math.isclose(got["sex"]["p_value"], math.erfc(math.sqrt(want / 2)), rel_tol=1e-9)
    assert got["other"]["dof"] == 5 and (got["other"]["n_0"], got["other"]["n_1"]) == (40, 25)
    plain = association.chi_square(df, ["sex"], "group", ["x", "y"], yates=False).first()
    assert math.isclose(plain["statistic"], sum((cells[k] - expected[k]) ** 2 / expected[k] for k in cells), rel_tol=1e-12)
    single = association.chi_square(df.filter("sex = 'F'"), ["sex"], "group", ["x", "y"]).first()
    assert single["statistic"] is None and single["p_value"] is None


def test_spearman(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(20), rng.randrange(15)) for _ in range(300)]
    data = pd.DataFrame(rows, columns=["x", "y"])
    got = association.spearman(spark.createDataFrame(data), "x", "y").first()
    assert math.isclose(got["rho"], data.x.rank().corr(data.y.rank()), rel_tol=1e-12)
    assert got["n"] == 300


def test_high_users(spark):
    weekly = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "pid int, weekly_use double")
    out = association.high_users(weekly)
    assert out.filter(F.col("usage_group") == association.TOP).count() == 11


# --- matching --------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 5])
def test_nearest_match_equals_brute_force(spark, ranges):
    rng = random.Random(11)
    rows = [(pid, int(rng.random() < 0.4), rng.randrange(200) / 200) for pid in range(150) for _ in range(rng.randrange(1, 3))]
    df = spark.createDataFrame(rows, "pid int, treated int, propensity_score double")
    got = {r["control_pid"]: (r["score_diff"], r["treated_pid"]) for r in matching.nearest_match(df, ranges=ranges).collect()}
    want = {}
    for pid, flag, score in rows:
        if not flag:
            best = min((abs(score - s), t) for t, f, s in rows if f)
            want[pid] = min(want.get(pid, best), best)
    assert got == want
    near = matching.nearest_match(df, ranges=ranges, caliper=0.0).collect()
    assert {r["control_pid"] for r in near} == {p for p, (d, _) in want.items() if d == 0}


def test_all_treated_scores_in_one_range(spark):
    rows = [(1, 1, 0.01)] + [(10 + i, 0, i / 40) for i in range(40)]
    df = spark.createDataFrame(rows, "pid int, treated int, propensity_score double")
    assert matching.nearest_match(df, ranges=8).filter("treated_pid = 1").count() == 40


def test_weighted_cells_give_the_row_model(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("abc"), rng.choice("xy")) for i in range(200)]
    rows = [(*r, int(rng.random() < (0.7 if r[1] == "a" else 0.3))) for r in rows]
    df = spark.createDataFrame(rows, "pid int, u string, v string, treated int")
    scored = matching.propensity(df, "treated", ["u", "v"], one_hot=True)
    got = {(r["u"], r["v"]): r["propensity_score"] for r in scored.collect()}
    # Newton on the rows themselves
    levels = {"u": sorted({r[1] for r in rows}), "v": sorted({r[2] for r in rows})}
    x = np.array([[1.0, *(r[1] == k for k in levels["u"][1:]), *(r[2] == k for k in levels["v"][1:])] for r in rows])
    y = np.array([r[3] for r in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    for r, p in zip(rows, 1 / (1 + np.exp(-x @ beta))):
        assert math.isclose(got[(r[1], r[2])], p, rel_tol=1e-4)
    matched = matching.matched_cohort(df, matching.nearest_match(scored))
    assert matched.count() > 0 and set(matched.columns) == set(df.columns)


def walked_pairs(units):
    """One-to-one pairs by walking up the scores with a stack, from {pid: (score, treated)}."""
    pairs, stack = [], []
    by_score = {}
    for pid, (score, treated) in units.items():
        by_score.setdefault(score, ([], []))[treated].append(pid)
    for score in sorted(by_score):
        controls, others = (sorted(x) for x in by_score[score])
        n = min(len(controls), len(others))
        pairs += [(c, t, 0.0) for c, t in zip(controls, others)]
        for pid, treated in [(c, 0) for c in controls[n:]] + [(t, 1) for t in others[n:]]:
            if stack and stack[-1][2] != treated:
                other, at, _ = stack.pop()
                pairs.append((other, pid, score - at) if treated else (pid, other, score - at))
            else:
                stack.append((pid, score, treated))
    return sorted(pairs)


@pytest.mark.parametrize("ranges", [1, 3, None])
@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_match_equals_a_walk(spark, ranges, seed):
    rng = random.Random(seed)
    units = {i: (rng.choice([rng.random(), rng.randrange(12) / 12]), int(rng.random() < (0.5, 0.2, 0.7)[seed])) for i in range(150)}
    df = spark.createDataFrame([(p, float(s), t) for p, (s, t) in units.items()], "pid long, propensity_score double, treated int").repartition(3)
    got = sorted(tuple(r) for r in matching.one_to_one_match(df, ranges=ranges).collect())
    assert got == walked_pairs(units)
    sides = [sum(t == side for _, t in units.values()) for side in (0, 1)]
    assert len(got) == min(sides) == len({c for c, _, _ in got}) == len({t for _, t, _ in got})
    near = matching.one_to_one_match(df, ranges=ranges, caliper=0.01).collect()
    assert sorted(tuple(r) for r in near) == [p for p in walked_pairs(units) if p[2] <= 0.01]


def test_one_to_one_match_of_equal_groups_is_the_closest(spark):
    rng = random.Random(9)
    scores = [rng.random() for _ in range(14)]
    df = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate(scores)], "pid long, propensity_score double, treated int")
    total = sum(r["score_diff"] for r in matching.one_to_one_match(df).collect())
    a, b = (sorted(scores[k::2]) for k in (0, 1))
    assert total == pytest.approx(min(sum(abs(x - y) for x, y in zip(a, p)) for p in itertools.permutations(b)))


def test_one_to_one_match_of_odd_rows(spark):
    rows = [(1, 0.5, 0), (1, 0.2, 0), (2, 0.2, 1), (2, 0.9, 0), (3, None, 0), (4, float("nan"), 1), (None, 0.2, 0), (5, 0.3, None)]
    df = spark.createDataFrame(rows, "pid long, propensity_score double, treated int")
    assert [tuple(r) for r in matching.one_to_one_match(df).collect()] == [(1, 2, 0.0)]
    assert matching.one_to_one_match(df.limit(0)).count() == 0
    # one score holds nearly all, and alternating scores stand on one step
    hot = [(i, 0.5, int(i % 3 == 0)) for i in range(300)] + [(300 + i, 1.0 + i, i % 2) for i in range(100)]
    df = spark.createDataFrame(hot, "pid long, propensity_score double, treated int")
    assert sorted(tuple(r) for r in matching.one_to_one_match(df).collect()) == walked_pairs({p: (s, t) for p, s, t in hot})


@pytest.mark.parametrize("seed", range(2))
def test_cox_summary_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(1, 30), int(rng.random() < 0.6), rng.choice("abc")) for _ in range(250)]
    rows += [(rng.randrange(1, 10), 1, "c") for _ in range(60)] + [(5, 0, "none"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "t int, e int, g string")
    got = survival.cox_summary(df, "t", "e", "g", ["a", "b", "c", "none"]).first()
    beta = {"a": 0.0} | {r["level"]: r["coef"] for r in survival.cox_ph(df, "t", "e", "g", ["a", "b", "c"]).collect()}
    data = [(t, e, beta[g]) for t, e, g in rows if t is not None and g in beta]
    counts = [0, 0, 0]
    for t, e, b in data:
        for t2, e2, b2 in data if e else []:
            if t2 > t or (t2 == t and not e2):
                counts[0] += 1
                counts[1] += b > b2
                counts[2] += b == b2
    assert [got[c] for c in ("pairs", "concordant", "tied")] == counts
    assert got["concordance"] == pytest.approx((counts[1] + counts[2] / 2) / counts[0])

    def likelihood(scale):
        total = 0.0
        for time in {t for t, e, _ in data if e}:
            dead = [scale * b for t, e, b in data if t == time and e]
            risk, own = sum(math.exp(scale * b) for t, _, b in data if t >= time), sum(map(math.exp, dead))
            total += sum(dead) - sum(math.log(risk - j / len(dead) * own) for j in range(len(dead)))
        return total

    assert got["log_likelihood"] == pytest.approx(likelihood(1)) and got["null_log_likelihood"] == pytest.approx(likelihood(0))
    assert got["lr_statistic"] == pytest.approx(2 * (likelihood(1) - likelihood(0))) and got["dof"] == 2
    assert got["p_value"] == pytest.approx(math.exp(-got["lr_statistic"] / 2), rel=1e-4)  # two degrees of freedom


def test_cox_summary_without_pairs(spark):
    df = spark.createDataFrame([(3, 1, "a"), (3, 1, "a")], "t int, e int, g string")
    got = survival.cox_summary(df, "t", "e", "g", ["a", "b"]).first()
    assert (got["events"], got["pairs"], got["concordance"], got["dof"], got["lr_statistic"]) == (2, 0, None, 0, 0.0)


def logistic_newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.pinv((x * (mu * (1 - mu))[:, None]).T @ x) @ (x.T @ (y - mu))
    return 1 / (1 + np.exp(-x @ beta))


@pytest.mark.parametrize("one_hot", [False, True])
def test_propensity_equals_newton_over_rows(spark, one_hot):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        u, v = rng.choice(["a", "b", "b", None]), f"v{int(rng.paretovariate(1)) % 9}"
        rows.append((i, u, v, "same", int(rng.random() < (0.7 if u == "b" else 0.3))))
    df = spark.createDataFrame([*rows, (600, "a", "v1", "same", None)], "pid long, u string, v string, w string, treated int")
    got = {r["pid"]: r["propensity_score"] for r in matching.propensity(df, "treated", ["u", "v", "w"], one_hot=one_hot).collect()}
    codes = []
    for place in (1, 2, 3):
        names = ["unknown" if r[place] is None else r[place] for r in rows] + [("a", "v1", "same")[place - 1]]
        ranked = sorted(set(names), key=lambda n: (-names.count(n), n))
        codes.append([ranked.index(n) for n in names[:-1]])
    columns = [np.ones(len(rows))]
    for code in codes:
        columns += [np.equal(code, k).astype(float) for k in range(max(code))] if one_hot else [np.array(code, float)]
    want = logistic_newton(np.column_stack(columns), np.array([r[4] for r in rows], float))
    assert len(got) == 601 and all(abs(got[i] - w) < 1e-7 for i, w in enumerate(want))


def test_propensity_of_odd_data(spark):
    separated = spark.createDataFrame([(i, "ab"[i % 2], i % 2) for i in range(40)], "pid long, u string, treated int")
    got = {r["u"]: r["propensity_score"] for r in matching.propensity(separated, "treated", ["u"]).collect()}
    assert got["a"] < 1e-6 and got["b"] > 1 - 1e-6
    assert matching.propensity(separated.limit(0), "treated", ["u"]).count() == 0
    with pytest.raises(ValueError):
        matching.propensity(separated, "treated", ["u"], one_hot=True, max_columns=1)
    # many levels, none of them on the driver when their numbers enter as they are
    many = spark.range(5000).selectExpr("id as pid", "concat('level ', id) as u", "cast(id % 3 = 0 as int) as treated")
    assert matching.propensity(many, "treated", ["u"]).count() == 5000
