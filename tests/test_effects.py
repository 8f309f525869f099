"""Two-way effects by alternating projections against a regression with dummies."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from cohortspan.operators import did, effects
from tests.test_models import MEASURES, panel_frame


def unbalanced(seed=3, entities=40, periods=4):
    """Some entities miss periods, some have several rows in one; entity 0 has very many."""
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        level = rng.random() * 1000
        for t in range(periods):
            for _ in range(200 if e == 0 else rng.randrange(3)):
                x = rng.randrange(4)
                rows.append((e, f"p{t}", float(x), level + 7 * t + 2.5 * x + rng.random(), rng.random()))
    return pd.DataFrame(rows, columns=["e", "t", "x", "y", "z"])


def dummies(data, y):
    p = pd.get_dummies(data["t"]).to_numpy(float)
    rest = np.column_stack([pd.get_dummies(data["e"]).to_numpy(float), p[:, 1:]])
    free = lambda v: v - rest @ np.linalg.lstsq(rest, v, rcond=None)[0]
    x, target = free(data["x"].to_numpy(float)), free(data[y].to_numpy(float))
    coef = x @ target / (x @ x)
    scores = pd.Series(x * (target - coef * x)).groupby(data["e"].to_numpy()).sum().to_numpy()
    g, n = data["e"].nunique(), len(data)
    return coef, math.sqrt(g / (g - 1) * (n - 1) / (n - p.shape[1] - 1) * (scores @ scores)) / (x @ x)


@pytest.mark.parametrize("periods", [1, 2, 4, 9])
def test_equals_dummy_regression(spark, periods):
    data = unbalanced(periods=periods)
    got = {r["outcome"]: r for r in effects.two_way_effects(spark.createDataFrame(data), ["y", "z"], "x", "e", "t").collect()}
    for y in ("y", "z"):
        coef, se = dummies(data, y)
        assert math.isclose(got[y]["coef"], coef, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(got[y]["se"], se, rel_tol=1e-6)
        assert (got[y]["n_obs"], got[y]["n_entities"], got[y]["n_periods"]) == (len(data), data["e"].nunique(), periods)


def test_two_periods_equal_the_closed_form(spark):
    rows = spark.createDataFrame(panel_frame())
    want = {r["activity"]: r for r in did.did_twfe(rows, MEASURES).filter("comparison = '19-30 weeks'").collect()}
    chosen = rows.filter(rows["group"].isin(did.CONTROL, "19-30 weeks")).selectExpr(
        "pid", "time_period", f"int(group <> '{did.CONTROL}') * time_period as d", *[f"{c} / max_time_covered * 7 as {c}" for c in MEASURES]
    )
    for r in effects.two_way_effects(chosen, MEASURES, "d").collect():
        assert math.isclose(r["coef"], want[r["outcome"]]["coef"], rel_tol=1e-9)
        assert math.isclose(r["se"], want[r["outcome"]]["se"], rel_tol=1e-9)


def test_nulls_empty_and_explained_regressors(spark):
    data = unbalanced()
    frame = spark.createDataFrame(data)
    plain = effects.two_way_effects(frame, ["y"], "x", "e", "t").first()
    holes = spark.createDataFrame([(1, "p0", None, 3.0, 1.0), (None, "p1", 1.0, 3.0, 1.0), (1, None, 1.0, 3.0, 1.0)], frame.schema)
    again = effects.two_way_effects(frame.union(holes), ["y"], "x", "e", "t").first()
    assert math.isclose(plain["coef"], again["coef"], rel_tol=1e-12) and plain["n_obs"] == again["n_obs"]
    assert effects.two_way_effects(frame.limit(0), ["y"], "x", "e", "t").count() == 0
    fixed = effects.two_way_effects(frame.withColumn("x", frame["e"] * 1.0), ["y"], "x", "e", "t").first()
    assert fixed["coef"] is None and fixed["se"] is None


def test_limits_are_errors(spark):
    frame = spark.createDataFrame(unbalanced())
    with pytest.raises(ValueError, match="periods"):
        effects.two_way_effects(frame, ["y"], "x", "e", "t", max_periods=3)
    with pytest.raises(ArithmeticError):
        effects.two_way_effects(frame, ["y"], "x", "e", "t", max_rounds=1)


def test_a_round_moves_one_row_per_period_and_task(spark):
    cells = effects.period_cells(spark.createDataFrame(unbalanced()), ["y"], "x", "e", "t")
    entities = effects.durable(effects.entity_rows(cells, ["p0", "p1", "p2", "p3"]))
    _, rounds = effects.period_effects(entities, 2, 4)
    assert 1 < rounds < 200
    plan = entities._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
