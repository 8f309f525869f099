import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspan.llm import simhash
from cohortspan.llm.graph import components
from tests.llm.conftest import ODD, make


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    """Smallest index reachable, by comparing all pairs."""
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@given(st.text(alphabet="aBcÉ \t\n\x1c.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) & (1 << 64) - 1 == brute_print(text)


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{i * i % 1009}" for i in range(70_000))
    assert simhash.simhash(text.encode()) & (1 << 64) - 1 == brute_print(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_one_segment_differs_by_one_bit_at_most(distance):
    parts = simhash.segments(distance)
    assert sum(bits for _, bits in parts) == 64
    # the pigeonhole: more than one bit in every segment needs more bits than allowed
    assert 2 * len(parts) > distance


def test_spanning_forest_joins_what_is_close():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = sorted({signed(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 8])))) for _ in range(120)})
    nodes, roots = simhash.spanning(np.array(prints, np.int64), 3)
    assert len(nodes) < len(prints)
    where = {p: r for p, r in zip(nodes, roots)}
    want = brute_components([p & (1 << 64) - 1 for p in prints])
    assert [where.get(p, p) for p in prints] == [prints[k] for k in want]


@pytest.mark.parametrize("block", [4096, 5])
def test_links_of_dense_and_sparse_groups(spark, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):  # dense groups, one of them a chain
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(40)}
    chain = rng.getrandbits(64)
    for k in range(10):
        chain ^= 0b111 << (6 * k)
        prints.add(chain)
    prints = sorted(prints)
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), 3, block)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    groups = {}
    for k, p in zip(brute_components(prints), prints):
        groups.setdefault(k, set()).add(signed(p))
    for group in groups.values():
        assert {roots.get(p, p) for p in group} == ({min(group)})


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_documents_against_all_pairs(docs, corpus):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(text) for _, text, *_ in corpus]
    low = brute_components(prints)
    assert got == {corpus[i][0]: (f"{p:016x}", corpus[low[i]][0]) for i, p in enumerate(prints)}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted({c for _, c in got.values()})


def test_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] == by_id[7]["fingerprint"] == "0" * 16
    assert by_id[7]["component_id"] == 5
    assert by_id[None]["component_id"] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"][:9] if r["text"] else "") for r in kept.collect() if r["doc_id"] != 8) == [
        (False, 5, ""), (False, 9, "another t"), (False, 9, "same row "), (False, 10, "été 😀 naï"), (False, 11, "12345 !!!"), (False, 2**60, "big id"), (True, None, "no id her"),
    ]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_null_ids_do_not_merge_components(spark):
    rows = make(spark, [(None, "one two three four"), (None, "five six seven eight nine"), (3, "one two three four")])
    assert simhash.keep_one(rows).count() == 2
