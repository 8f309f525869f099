import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.llm import negatives

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, uid string, id string, dim string, q string, slot string, known string"


def brute(rows, positives=5, negatives=10):
    """All rows by the contract, from (vec_id, vector, label)."""
    def order(x):
        return -x[0], x[1] is None, x[1] or 0

    sound = []
    for own, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if own is not None and own % 7 == 0:
            label = (label + 1) % 10
        sound.append((own, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, (a, va, la) in enumerate(sound):
        if a is None or a % 100:
            continue
        scored = [(sum(map(int.__mul__, va, v)), own, label) for k, (own, v, label) in enumerate(sound) if k != i and len(v) == len(va)]
        for ps, p, _ in sorted((x for x in scored if x[2] == la), key=order)[:positives]:
            fits = sorted((x for x in scored if x[2] != la and 30 * ps <= 100 * x[0] <= 90 * ps), key=order)[:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows):
    table = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r[n] for n in NAMES) for r in negatives.mine(table).collect()), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[rng.randrange(4)]], rng.randrange(3)) for i in range(1, 900)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v = [0.5, 0.25, -0.125]
    rows = [(100, v, 1), (100, v, 1), (100, [0.4, 0.3, 0.0], 1), (None, v, 1), (None, [0.3, 0.25, 0.0], 2), (None, [0.3, 0.25, 0.0], 2)]
    rows += [(i, [0.3, 0.25, 0.0], 2) for i in (3, 3, 9, 8)] + [(i, v, 1) for i in (5, 4, 6, 4)]
    rows += [(1, None, 1), (2, v, None), (10, [0.5, None, 0.1], 2), (11, [float("nan"), 0.1, 0.1], 2), (12, [float("inf"), 0.1, 0.1], 2)]
    rows += [(200, [], 1), (201, [], 1), (202, [], 2), (300, [0.5, 0.25], 1), (301, [0.5, 0.25], 1), (302, [0.25, 0.25], 2), (400, [1.0] * 5, 3)]
    rows += [(500, [0.0, 0.0, 0.0], 4), (501, [0.0, 0.0, 0.0], 4), (600, [-0.5, 0.0, 0.0], 5), (601, [0.5, 0.0, 0.0], 5)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {r[3] for r in got} >= {None, 3, 8} and any(r[1] is None for r in mined(spark, rows[:4] + rows[6:9]))


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(100 * i, [rng.uniform(1e5, 1e7), rng.uniform(0, 1e7), 0.3], i % 3) for i in range(12)]
    assert mined(spark, rows) == brute(rows)
    huge = [(100, [1e30, 0.0], 1), (1, [1e30, 0.0], 1), (2, [1e12, 0.0], 2)]
    # scores end at the limit of 64 bits
    assert mined(spark, huge) == [] and negatives.scores(np.array([[1e30]]), np.array([[1e30]]))[0, 0] == 2**63 - 1


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.1], 1)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    members = np.floor(256 * (rng.normal(size=5) + rng.normal(scale=0.2, size=(20, 5))))
    members[0] = 0
    cands = np.vstack([np.floor(256 * rng.normal(size=(300, 5))), np.zeros((1, 5)), members])
    most = negatives.bounds(members, cands) * np.linalg.norm(members, axis=1)[:, None]
    assert (members @ cands.T <= most + 1).all()


def test_walk_stops_where_the_bound_certifies_it():
    """Close members and a long tail of distant candidates: the tail is not scored."""
    rng = np.random.default_rng(1)
    members = np.floor(256 * (np.array([1.0, 0, 0]) + rng.normal(scale=0.02, size=(30, 3))))
    near = np.floor(256 * (np.array([1.0, 0, 0]) + rng.normal(scale=0.05, size=(200, 3))))
    far = np.floor(256 * (np.array([-1.0, 0, 0]) + rng.normal(scale=0.3, size=(20_000, 3))))
    cands = np.vstack([near, far])
    asks = negatives.Asks(np.arange(30), np.full(30, negatives._NONE), np.full(30, negatives._LIMIT), 5)
    ones, uids = np.ones(len(cands), np.int64), np.arange(len(cands)) + 100
    walked = negatives.walk(asks, members, np.ones(30, np.int64), np.arange(30), cands, ones, uids, True)
    assert walked < 1000
    want = np.sort(members @ cands.T, axis=1)[:, ::-1][:, :5]
    assert (asks.score.reshape(30, 5) == want).all()


@pytest.mark.parametrize("clusters,group,slot", [(1, 4, 50), (5, 16, 200)])
def test_many_groups_and_slots(spark, monkeypatch, clusters, group, slot):
    for name, value in (("CLUSTERS", clusters), ("GROUP", group), ("SHELF", 2), ("SLOT", slot), ("LEAST_SLOT", 10)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(11)
    rows = [(100 * i if i % 3 else i, [rng.gauss(0.2, 0.3) for _ in range(4)], rng.randrange(2)) for i in range(1, 300)]
    assert mined(spark, rows) == brute(rows)


def test_other_conditions(spark):
    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(table, F.col("id") < 3, F.col("label"), positives=2, negatives=3, low=0, high=100).collect()
    assert {r["anchor_id"] for r in got} == {0, 1, 2} and max(r["rank"] for r in got) == 3
