import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import mixing
from tests.llm.conftest import ODD, make


def brute_targets(sizes, repeats=3):
    """Share by weight, cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > repeats * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
        free -= above
    return target


def sizes_of(rows):
    return [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[3]) for r in rows]


def check(rows, got):
    sized = sizes_of(rows)
    totals = {}
    for _, n, s in sized:
        totals[s] = totals.get(s, 0) + n
    want = brute_targets(totals)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source_size"], round(r["target"], 5)) for r in got) == sorted(
        (i is None, i or 0, n, totals[s], round(want[s], 5)) for i, n, s in sized
    )
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["uses"] * r["size"] for r in got)
    # per source: the words taken miss the target by half a document at most
    source = {i: s for i, _, s in sized}
    for s in totals:
        own = [r for r in got if source[r["doc_id"]] == s and r["doc_id"] is not None]
        if own and all(i is not None for i, _, t in sized if t == s):
            assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)


def test_documents(docs, corpus):
    got = mixing.mix_report(docs).collect()
    check(corpus, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    places = [r["position"] for r in got if r["uses"]]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1


def test_excess_is_reshared(spark):
    rows = [(i, "w " * (i % 7 + 1), None, s) for i, s in enumerate(["a"] * 30 + ["b"] * 2 + [None] * 1 + ["d"] * 9 + [""] * 1)]
    check(rows, mixing.mix_report(make(spark, rows)).collect())


@pytest.mark.parametrize("at", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_position_inverts_the_demand(spark, at):
    """Two stretches of different slope: the demand up to the position is the demand asked for."""
    knots = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.0)]
    frame = spark.createDataFrame([(knots, 1000.0)], "knots array<struct<t:double,w:double>>, target double")
    demand = 1000.0 * at
    t = frame.select(mixing.position(mixing.segments(F.col("knots"), F.col("target")), F.lit(demand)).alias("t")).first()["t"]
    area = lambda x: x + 4 * x * x if x <= 0.25 else 0.5 + (3 + (3 - 4 * (x - 0.25))) / 2 * (x - 0.25)
    assert area(t) / area(1.0) * 1000.0 == pytest.approx(demand, abs=1e-6)


def test_rising_sources_come_later(spark):
    rows = [(i, "one two three", None, "abc"[i % 3]) for i in range(600)]
    got = mixing.mixed(make(spark, rows)).collect()
    place = {s: [k for k, r in enumerate(got) if r["source"] == s] for s in "abc"}
    mean = {s: sum(p) / len(p) for s, p in place.items()}
    assert mean["a"] < mean["b"] < mean["c"]
    assert len(place["c"]) == pytest.approx(300, abs=2) and len(place["a"]) == pytest.approx(100, abs=2)


def test_one_range_or_many_make_no_difference(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_report(docs).collect()))
    from cohortspan.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == want


def test_odd_rows(odd, empty):
    got = mixing.mix_report(odd).collect()
    assert len(got) == len(ODD)
    totals = {}
    for _, n, s in sizes_of(ODD):
        totals[s] = totals.get(s, 0) + n
    want = brute_targets(totals)
    assert {round(r["target"], 5) for r in got} == {round(t, 5) for t in want.values()}
    used = mixing.mixed(odd)
    assert used.columns == odd.columns
    assert used.count() == sum(r["uses"] for r in got)
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert hashlib.md5(b"").hexdigest()[:15] == "d41d8cd98f00b20"
