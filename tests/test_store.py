"""Stored tables, checked text files and two-way suppression."""

import itertools
import uuid

import numpy as np
import pytest

from cohortspan.operators import regress, suppress
from cohortspan.plans import stores
from cohortspan.sources import store, tables

# --- fact store ---------------------------------------------------------------


@pytest.fixture
def facts(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    rows = [(i % 7 if i % 3 else 0, i, m) for i in range(60) for m in ("a", "b")]
    store.create_store(spark.createDataFrame(rows, "pid int, n int, metric string"), name, str(tmp_path / "t"), "pid", 4, ["metric"])
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_a_rerun_replaces_its_partitions_only(spark, facts):
    before = spark.conf.get(store._DYNAMIC)
    new = spark.createDataFrame([("b", 1, 5), ("c", 2, 6)], "metric string, pid int, n int")
    got = {(r["metric"], r["pid"], r["n"]) for r in store.replace_partitions(new, facts, "pid").collect()}
    assert {g for g in got if g[0] != "a"} == {("b", 1, 5), ("c", 2, 6)} and sum(g[0] == "a" for g in got) == 60
    assert spark.conf.get(store._DYNAMIC) == before and store.buckets_of(spark, facts) == 4
    with pytest.raises(ValueError, match="missing"):
        store.replace_partitions(new.drop("n"), facts, "pid")
    assert spark.table(facts).count() == 62
    store.replace_partitions(new.limit(0), facts, "pid")
    assert spark.table(facts).count() == 62


def test_joins_by_key_move_nothing(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        left, right = stores.stored_facts(spark, "/root/testdata/sf0.001")
        joined = left.join(right, "pid").groupBy("pid").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        only = left.filter("metric = 'use_r'")
        assert {r["n"] for r in only.collect()} == {1}
        assert "PartitionFilters: [isnotnull(metric" in only._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


# --- checked text files -------------------------------------------------------

LINES = ["id,d,v", "1,2022-01-01,2.5", "2,yesterday,1", "3,2022-01-03", "4,2022-01-04,1,9", "5,,", "x,2022-01-05,1", '6,2022-01-06,"7"', "1,2022-01-01,2.5"]


def test_rejected_lines_are_kept_and_counts_add_up(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\n".join(LINES) + "\n")
    good, bad = tables.read_csv_checked(spark, str(tmp_path / "f.csv"), "id int, d date, v double")
    assert sorted(r["record"] for r in bad.collect()) == sorted(["2,yesterday,1", "3,2022-01-03", "4,2022-01-04,1,9", "x,2022-01-05,1"])
    assert sorted(r["id"] for r in good.collect()) == [1, 1, 5, 6] and good.columns == ["id", "d", "v"]
    # the split does not depend on the columns that are read
    assert good.select("id").distinct().count() == 3 and good.count() + bad.count() == len(LINES) - 1
    with pytest.raises(ValueError, match="record"):
        tables.read_csv_checked(spark, str(tmp_path / "f.csv"), "id int, Record string")
    (tmp_path / "e.csv").write_text("id,d,v\n")
    good, bad = tables.read_csv_checked(spark, str(tmp_path / "e.csv"), "id int, d date, v double")
    assert good.count() == bad.count() == 0


# --- suppression in both directions -------------------------------------------


def known(cells):
    """Hidden cells that totals and published cells give away, by trying units around every closed walk."""
    hidden = {(r, c): n for (r, c), (n, off) in cells.items() if off}
    rows, columns = sorted({r for r, _ in hidden}), sorted({c for _, c in hidden})
    names = list(hidden)
    a = np.zeros((len(rows) + len(columns), len(names)))
    for i, (r, c) in enumerate(names):
        a[rows.index(r), i] = a[len(rows) + columns.index(c), i] = 1
    free = set()
    # every other table with the same totals that differs by a unit on some cells
    for signs in itertools.product((-1, 0, 1), repeat=len(names)):
        step = np.array(signs)
        if step.any() and not (a @ step).any() and all(hidden[x] + s >= 0 for x, s in zip(names, signs)):
            free |= {x for x, s in zip(names, signs) if s}
    return set(names) - free


TABLES = [
    [[1, 30, 40], [50, 60, 70], [80, 90, 20]],
    [[0, 30, 9], [50, 8, 70], [7, 9, 2]],
    [[3, 4, 40], [50, 60, 70], [80, 90, 20]],
    [[9, 9], [9, 1]],
]


@pytest.mark.parametrize("values", TABLES)
def test_no_total_gives_a_hidden_cell_back(spark, values):
    rows = [("t", r, c, n) for r, line in enumerate(values) for c, n in enumerate(line)]
    frame = spark.createDataFrame(rows, "tab string, r int, c int, n int")
    got = suppress.closed_flag(frame, ["tab"], "r", "c").collect()
    assert len(got) == len(rows) and not any(r["open"] for r in got)
    assert all(r["suppressed"] for r in got if r["n"] < 5)
    assert known({(r["r"], r["c"]): (r["n"], r["suppressed"]) for r in got}) == set()


def test_the_cheapest_rectangle_is_taken(spark):
    rows = [(None, r, c, n) for r, line in enumerate(TABLES[0]) for c, n in enumerate(line)]
    got = suppress.closed_flag(spark.createDataFrame(rows, "tab string, r int, c int, n int"), ["tab"], "r", "c").collect()
    # 1 with 40 in its row, 80 in its column and 20 where they cross: 140, as with 30, 50 and 60; the smaller row wins
    assert {(r["r"], r["c"]) for r in got if r["suppressed"]} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_cells_without_a_rectangle_are_named(spark):
    rows = [("a", 0, 0, 2), ("a", 0, 1, 9), ("b", None, 0, None), ("b", None, 1, 9), ("b", 1, 0, 9), ("b", 1, 1, 9)]
    frame = spark.createDataFrame(rows, "tab string, r int, c int, n int")
    got = {(r["tab"], r["r"], r["c"]): (r["small"], r["suppressed"], r["open"]) for r in suppress.closed_flag(frame, ["tab"], "r", "c").collect()}
    assert got["a", 0, 0] == (True, True, True) and got["a", 0, 1] == (False, False, False)
    assert all(v[1] and not v[2] for k, v in got.items() if k[0] == "b")
    assert suppress.closed_flag(frame.limit(0), ["tab"], "r", "c").count() == 0
    assert suppress.closed_flag(frame.filter("tab = 'b'"), [], "r", "c").filter("suppressed").count() == 4


# --- sums in a tree -----------------------------------------------------------


def test_levels_of_the_tree():
    assert [regress._levels(n) for n in (1, 32, 33, 1000, 1024, 1025, 10_000)] == [1, 1, 2, 2, 2, 3, 3]


def test_vectors_meet_by_the_fan_in(spark, monkeypatch):
    """A thousand partitions: the sums are right and no task adds up more than 32 vectors."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    frame = spark.range(5000, numPartitions=1000).selectExpr("if(id % 3 = 0, 'a', 'b') as _model", "double(id) as x")
    spark.conf.set(key, "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        got = regress._summed(frame, lambda _, rows: np.array([len(rows), rows["x"].sum()]))
    finally:
        spark.conf.set(key, before)
    ids = np.arange(5000)
    assert got["a"].tolist() == [(ids % 3 == 0).sum(), ids[ids % 3 == 0].sum()]
    assert got["b"].tolist() == [(ids % 3 != 0).sum(), ids[ids % 3 != 0].sum()]
