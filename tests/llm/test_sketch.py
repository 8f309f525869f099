import hashlib
import random

import numpy as np
import pytest
import xxhash

from cohortspan.llm import sketch
from tests.llm.conftest import ODD, make


def shingles(text):
    words = text.split(" ")
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}


def texts(seed, shared):
    rng = random.Random(seed)
    a = [str(rng.random()) for _ in range(3000)]
    b = [w if i < 3000 * shared else str(rng.random()) for i, w in enumerate(a)]
    return " ".join(a), " ".join(b)


@pytest.mark.parametrize("shared", [0.0, 0.3, 0.8, 1.0])
def test_estimates(shared):
    got = []
    for seed in range(12):
        a, b = texts(seed, shared)
        sa, sb = shingles(a), shingles(b)
        ka, kb = sketch.sketch(a), sketch.sketch(b)
        got.append((
            sketch.resemblance(ka, kb) - len(sa & sb) / len(sa | sb), sketch.containment(ka, kb) - len(sa & sb) / len(sa),
            sketch.distinct_shingles(ka) / len(sa) - 1,
        ))
    assert np.abs(np.mean(got, axis=0)).max() < 0.05


def test_sketches_merge():
    a, b = texts(1, 0.4)
    union = sketch.merged(sketch.sketch(a), sketch.sketch(b))
    want = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(a) | shingles(b)]
    want = np.unique(np.array(want, np.uint64))[: sketch.K]
    assert union.tolist() == want.tolist()
    assert sketch.from_text(sketch.to_text(union)).tolist() == union.tolist()


def test_merge_over_rows(spark):
    a, b = texts(2, 0.5)
    rows = [("x", int(h.view(np.int64))) for t in (a, b) for h in sketch.sketch(t)] + [("y", -1), ("y", -1), ("y", 3)]
    merged = sketch.merge(spark.createDataFrame(rows, "part string, hash long"), "part", "hash").collect()
    of = lambda p: sorted(r["hash"] & (1 << 64) - 1 for r in merged if r["part"] == p)
    assert of("x") == sketch.merged(sketch.sketch(a), sketch.sketch(b)).tolist()
    assert of("y") == [3, (1 << 64) - 1]


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        prints = [sketch.sketch(t) for t in (text, edited, following)]
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.to_text(prints[0]), sketch.to_text(prints[1]),
            sketch.resemblance(prints[0], prints[1]), sketch.resemblance(prints[0], prints[2]), sketch.distinct_shingles(prints[0]),
            sketch.containment(prints[0], prints[1]), sketch.containment(prints[0], prints[2]), sketch.distinct_shingles(sketch.merged(prints[0], prints[2])),
        ))
    return sorted(out, key=repr)


def test_documents(docs, corpus):
    got = sorted(map(tuple, sketch.with_edits(docs).collect()), key=repr)
    assert got == brute([(i, t) for i, t, *_ in corpus])
    long = [r for r in got if r[1] > 2000]
    assert np.mean([r[5] for r in long]) > 0.4 > np.mean([r[6] for r in long])


def test_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, sketch.with_edits(odd).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in ODD])
    assert sketch.with_edits(empty).count() == 0
    one = sketch.with_edits(make(spark, [(3, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_resemblance_of_empty_sketches():
    none, some = sketch.sketch(None), sketch.sketch("a")
    assert sketch.resemblance(none, none) == 1.0 and sketch.resemblance(none, some) == 0.0
    assert sketch.containment(none, some) == 1.0 and sketch.containment(some, none) == 0.0


def test_containment_of_very_different_lengths():
    rng = random.Random(4)
    words = [str(rng.random()) for _ in range(20_000)]
    long = sketch.sketch(" ".join(words))
    got = [sketch.containment(sketch.sketch(" ".join(words[i:i + 54])), long) for i in range(0, 19_000, 100)]
    # an extract is wholly inside, or its sketch says nothing
    assert set(got) == {None, 1.0}
    apart = [sketch.containment(sketch.sketch(" ".join(str(rng.random()) for _ in range(54))), long) for _ in range(190)]
    assert set(apart) == {None, 0.0}
    assert sketch.containment(long, sketch.sketch(" ".join(words[:10_000]))) == pytest.approx(0.5, abs=0.15)


def test_parts_are_dealt_one_to_a_task(spark, docs):
    placed = sketch.with_next(docs, "text", "doc_id").selectExpr("part", "spark_partition_id() as task").distinct().collect()
    assert len(placed) > 1 and len({r["task"] for r in placed}) == len(placed) == len({r["part"] for r in placed})
