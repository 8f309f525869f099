import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortspan.llm import packing
from cohortspan.llm.tokens import END_ID, tokenizer_path
from tests.llm.conftest import LONG, ODD, make


def used(config):
    return sum(length * n for length, n in config)


def fullest(counts: dict[int, int], capacity: int) -> dict:
    """Another plan to compare with: sequences from the longest piece down, each filled as far as any choice of the rest can.

    The sums that the rest can reach are the bits of one whole number. Of equal sums the one
    of longer pieces is taken, as often as there are pieces for it.
    """
    left = {k: n for k, n in counts.items() if n}
    out: dict = Counter()
    while left:
        longest = max(left)
        room = capacity - longest
        items: list[tuple[int, int]] = []
        reach = [1]
        for length in sorted((k for k in left if k <= room), reverse=True):
            limit, bundle = min(left[length] - (length == longest), room // length), 1
            while limit > 0:
                n = min(bundle, limit)
                items.append((length, n))
                reach.append((reach[-1] | reach[-1] << n * length) & ((2 << room) - 1))
                limit -= n
                bundle *= 2
            if reach[-1] >> room:
                break
        total, chosen = reach[-1].bit_length() - 1, Counter({longest: 1})
        for (length, n), before in zip(reversed(items), reversed(reach[:-1])):
            if not before >> total & 1:
                chosen[length] += n
                total -= n * length
        times = min(left[length] // n for length, n in chosen.items())
        out[tuple(sorted(chosen.items()))] += times
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return dict(out)


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 15, 4))
        values = np.full(21, -np.inf)
        values[lengths] = rng.random(len(lengths))
        best, first = packing.knapsack(values)
        for room in range(21):
            most = max((values[lengths] @ c for c in itertools.product(*[range(room // n + 1) for n in lengths]) if np.dot(c, lengths) <= room), default=0)
            at, total = room, 0.0
            while at:
                total += values[first[at]] if first[at] else 0
                at -= int(first[at]) or 1
            assert at == 0 and best[room] == pytest.approx(most) and total == pytest.approx(most)


def random_counts(n, seed=1):
    rng = np.random.default_rng(seed)
    return Counter(np.clip(np.exp(rng.normal(6.6, 1.0, n)).astype(int), 1, 4096).tolist())


@pytest.mark.parametrize("n", [1, 50, 3000, 100_000])
def test_plans_hold_every_piece_once(n):
    counts = random_counts(n)
    plan = packing.solve(counts)
    lengths = np.concatenate([np.full(c, k) for k, c in counts.items()])
    numbers = np.concatenate([np.arange(c) for c in counts.values()])
    sequences, offsets = plan.place(lengths, numbers)
    order = np.lexsort((offsets, sequences))
    s, o, m = sequences[order], offsets[order], lengths[order]
    new = np.r_[True, s[1:] != s[:-1]]
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + m)[:-1][~new[1:]]).all()  # gapless
    assert (o + m).max() <= 4096 and s.max() + 1 == plan.count == new.sum()
    least = -(-int(lengths.sum()) // 4096)
    assert plan.count <= least * 1.002 + 2


def test_configurations_beat_best_fit_where_nothing_fills_gaps():
    counts = Counter(np.random.default_rng(1).integers(1300, 2200, 30_000).tolist())
    assert packing.solve(counts).count < sum(packing.best_fit(counts, 4096).values())


def test_fractional_uses_cover_and_round():
    counts = {1500: 4000, 1100: 4000, 2596: 2000, 900: 2000}
    uses = packing.fractional(counts, 4096)
    covered = Counter()
    for config, n in uses.items():
        assert used(config) <= 4096
        for length, c in config:
            covered[length] += n * c
    assert all(covered[k] == pytest.approx(n, rel=1e-6) for k, n in counts.items())
    whole, left = packing.rounded(uses, counts)
    for length, n in counts.items():
        assert sum(dict(c).get(length, 0) * k for c, k in whole.items()) + left.get(length, 0) == n


@pytest.mark.parametrize("most", [5, 400])
def test_a_full_histogram_is_covered_and_packed(most):
    lengths = np.arange(257, 4096)
    counts = dict(zip(lengths.tolist(), np.random.default_rng(1).integers(4, most, len(lengths)).tolist()))
    covered = Counter()
    for config, n in packing.fractional(counts, 4096).items():
        assert used(config) <= 4096
        for length, c in config:
            covered[length] += n * c
    assert all(covered[k] >= n * (1 - 1e-6) for k, n in counts.items())
    least = max(-(-sum(k * n for k, n in counts.items()) // 4096), sum(n for k, n in counts.items() if k > 2048))
    assert least <= packing.least(counts, 4096)
    others = [sum(plan.values()) for plan in (packing.best_fit(counts, 4096), fullest(counts, 4096))]
    assert packing.solve(counts).count <= min(packing.least(counts, 4096) * (1.01 if most < 100 else 1.005), *others)


def test_the_bound_holds():
    """No plan is below it: against the best of all plans of few pieces."""
    rng = np.random.default_rng(4)

    def fewest(pieces, rooms):
        if not pieces:
            return len(rooms)
        head, *rest = pieces
        tries = [fewest(rest, [*rooms, 20 - head])]
        for room in {r for r in rooms if r >= head}:
            now = list(rooms)
            now.remove(room)
            tries.append(fewest(rest, [*now, room - head]))
        return min(tries)

    for _ in range(30):
        pieces = sorted(rng.integers(2, 20, 7).tolist(), reverse=True)
        assert packing.least(Counter(pieces), 20) <= fewest(pieces, []) <= packing.solve(Counter(pieces), 20).count
    assert packing.least({}, 20) == 0


def test_fullest_sequences_hold_every_piece_once():
    rng = np.random.default_rng(5)
    for capacity, n in [(20, 12), (100, 80), (4096, 3000)] * 5:
        counts = Counter(rng.integers(1, capacity + 1, n).tolist())
        bins = fullest(counts, capacity)
        assert Counter({k: sum(dict(c).get(k, 0) * m for c, m in bins.items()) for k in counts}) == counts
        assert all(0 < used(c) <= capacity for c in bins) and min(bins.values()) > 0
        # the first sequence is as full as any choice beside the longest piece can make it
        longest, sums = max(counts), {0}
        for length in (counts - Counter([longest])).elements():
            sums |= {x + length for x in sums if x + length <= capacity - longest}
        assert used(next(iter(bins))) == longest + max(sums)


def test_best_fit_on_groups_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(1, 60, 80).tolist())
        bins = packing.best_fit(counts, 100)
        assert Counter({k: sum(dict(c).get(k, 0) * n for c, n in bins.items()) for k in counts}) == counts
        assert all(used(c) <= 100 for c in bins)
        rooms = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(100 - length)
        assert sum(bins.values()) <= len(rooms) + 1


def check(rows, got):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")
        want += [(doc_id, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    least = -(-sum(w[3] for w in want) // 4096)
    assert len(by) <= least * 1.01 + 1


def test_documents(docs, corpus):
    check([(i, t) for i, t, *_ in corpus], packing.packed(docs).collect())


def test_odd_rows(spark, odd, empty):
    check([(r[0], r[1]) for r in ODD], packing.packed(odd).collect())
    check([(1, LONG), (2, None)] + [(3, "full " * 4095)] * 3, packing.packed(make(spark, [(1, LONG), (2, None)] + [(3, "full " * 4095)] * 3)).collect())
    assert packing.packed(empty).count() == 0
