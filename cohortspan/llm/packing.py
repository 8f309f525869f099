"""Packing pieces into fixed-length sequences.

The number of sequences is the value of a linear program over configurations (how
many pieces of each length one sequence takes) that must cover the histogram of
lengths. Multiplicative weights cover it whole: lengths that are covered least weigh most,
and a knapsack by dynamic programming, over all open lengths at once, finds for every
length the configuration with it that is worth most. The program is over lengths of more
than a sixteenth of a sequence; whole uses of its configurations are taken, and the pieces
that remain, with all shorter ones, fill gaps and further sequences by best fit.
The histogram has at most one entry per length, whatever the input's size;
pieces are then numbered within their length and looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import ORDER_BITS, durable, quoted, running
from cohortspan.llm.tokens import CHUNKS, PIECES, encoder, tokenizer_path

CAPACITY = 4096
#: Pieces of up to this share of the capacity are kept to fill gaps.
SMALL = 1 / 16
#: Rounds in which the program covers equal shares of all that it is to cover, and sharpness of the weights.
PHASES = 20
#: Rounds in all in which a configuration with a used-up partner waits for new prices.
WAITING = 200
RATE = 0.05
#: How much more a token of a piece of full length is worth than one of the shortest.
FAVOUR = 1.0
_BIG = 1 << 48

#: A configuration: sorted ((length, copies), ...).
Config = tuple[tuple[int, int], ...]


def knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every room the largest value that fits, and a length to take first (0: one token stays free).

    ``values`` has the value of each length by its number, -inf where there is none; copies are
    not limited. Rooms closer than the shortest length do not depend on each other and are
    compared with all lengths at once.
    """
    lengths = np.flatnonzero(np.isfinite(values))
    best, first = np.zeros(len(values)), np.zeros(len(values), np.int64)
    start = int(lengths[0]) if len(lengths) else len(values)
    while start < len(values):
        rooms = np.arange(start, min(start + int(lengths[0]), len(values)))
        fits = lengths[:np.searchsorted(lengths, rooms[-1], "right")]
        rest = rooms[:, None] - fits
        worth = np.where(rest >= 0, best[rest] + values[fits], -np.inf)
        k = worth.argmax(axis=1)
        top = worth[np.arange(len(rooms)), k]
        before = np.maximum.accumulate(np.concatenate([[best[start - 1]], top[:-1]]))
        better = top > before
        best[rooms], first[rooms] = np.where(better, top, before), np.where(better, fits[k], 0)
        start = int(rooms[-1]) + 1
    return best, first


def prices(lengths: np.ndarray, open_: np.ndarray, capacity: int) -> np.ndarray:
    """What a piece of each length is worth, by the share of its pieces that is ``open_``; -inf without any.

    A token of a longer piece, which fits less often, is worth a little more, and so is one
    of a length that is covered less than others.
    """
    values = np.full(capacity + 1, -np.inf)
    some = open_ > 0
    sizes = lengths[some] / capacity
    values[lengths[some]] = sizes * (1 + FAVOUR * sizes) * np.exp(RATE * (open_[some] - open_.max()))
    return values


def fractional(counts: dict[int, int], capacity: int) -> dict[Config, float]:
    """Fractional uses of configurations that cover the whole histogram.

    Every phase covers an equal share of each length, the longest first, by the configuration
    with it that is worth most. A configuration whose partner is used up waits for the next
    prices, also after the last phase; after WAITING rounds the partner that is worth most of
    those left takes its place instead, so the whole histogram is covered in any case.
    """
    lengths = np.array(sorted(counts))
    demand, left = np.zeros(capacity + 1), np.zeros(capacity + 1)
    demand[lengths] = left[lengths] = [counts[n] for n in lengths.tolist()]
    uses: dict[Config, float] = defaultdict(float)
    phase = 0
    while left.any():
        goal = left * (1 - 1 / max(1, PHASES - phase))
        phase += 1
        values = prices(lengths, left[lengths] / demand[lengths], capacity)
        best, first = knapsack(values)
        for length in np.flatnonzero(left)[::-1].tolist():
            while left[length] > goal[length]:
                config, room = Counter({length: 1}), capacity - length
                while room:
                    step = int(first[room])
                    if step and not left[step] and phase > WAITING:
                        worth = values[1:room + 1] + best[room - 1::-1]
                        step = int(worth.argmax()) + 1
                        if not np.isfinite(worth[step - 1]):
                            break
                    if step:
                        config[step] += 1
                    room -= step or 1
                amount = min(min(left[k] / n for k, n in config.items()), (left[length] - goal[length]) / config[length])
                if amount <= 0:
                    break
                for k, n in config.items():
                    rest = left[k] - amount * n
                    left[k] = rest if rest > 1e-9 * demand[k] else 0
                    if not left[k]:
                        values[k] = -np.inf
                uses[tuple(sorted(config.items()))] += amount
                if left[length] - goal[length] <= 1e-9 * demand[length]:
                    break
    return uses


def least(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that no plan goes below, from the program's dual.

    Any prices under which no configuration is worth more than one sequence give such a bound:
    the pieces' worth. Tried are one for each piece of more than half a sequence, the lengths with
    every threshold up to which pieces count nothing, and the prices that the weights start from.
    """
    lengths = np.array(sorted(counts))
    if not len(lengths):
        return 0
    demand = np.array([counts[n] for n in lengths.tolist()], float)
    # below a threshold pieces are worth nothing, above its complement a sequence, and between by length
    limits = np.arange(capacity // 2 + 1)
    full = demand @ (lengths[:, None] > capacity - limits)
    between = demand * lengths @ ((lengths[:, None] >= limits) & (lengths[:, None] <= capacity - limits)) / capacity
    bounds = [float(demand[2 * lengths > capacity].sum()), float((full + between).max())]
    values = prices(lengths, np.ones(len(lengths)), capacity)
    bounds.append(float(demand @ values[lengths] / knapsack(values)[0][capacity]))
    return int(np.ceil(max(bounds) - 1e-6))


def rounded(uses: dict[Config, float], counts: dict[int, int]) -> tuple[dict[Config, int], dict[int, int]]:
    """Whole uses that the histogram still has pieces for, and the pieces that remain."""
    left = dict(counts)
    whole: dict[Config, int] = {}
    for config, amount in sorted(uses.items(), key=lambda u: (-u[1], u[0])):
        n = min(int(amount + 0.5), min(left[length] // c for length, c in config))
        if n > 0:
            whole[config] = n
            for length, c in config:
                left[length] -= n * c
    return whole, {k: n for k, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int, begun: dict[Config, int] | None = None) -> dict[Config, int]:
    """Best fit by falling length, on groups of like sequences instead of single ones.

    ``begun`` are sequences that already hold something.
    """
    groups: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def add(room: int, held: Config, n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room][held] += n

    for config, n in (begun or {}).items():
        add(capacity - sum(length * c for length, c in config), config, n)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                whole, rest = divmod(n, each)
                for copies, times in ((each, whole), (rest, 1)):
                    if copies and times:
                        add(capacity - copies * length, ((length, copies),), times)
                break
            room = rooms[k]
            held, times = next(iter(groups[room].items()))
            each = min(room // length, n)
            used = min(times, n // each)
            groups[room][held] -= used
            if not groups[room][held]:
                del groups[room][held]
            if not groups[room]:
                rooms.pop(k)
            more = tuple(sorted((Counter(dict(held)) + Counter({length: each})).items()))
            add(room - each * length, more, used)
            n -= used * each
    out: dict[Config, int] = Counter()
    for room in groups.values():
        for held, n in room.items():
            out[held] += n
    return dict(out)


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, by their number within the length.

    ``keys`` are length * 2^48 + first number, sorted; the other arrays belong to them.
    """

    keys: np.ndarray
    copies: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    count: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = lengths * _BIG + numbers
        k = np.searchsorted(self.keys, at, side="right") - 1
        nth, slot = np.divmod(at - self.keys[k], self.copies[k])
        return self.sequences[k] + nth, self.offsets[k] + slot * lengths


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations for a histogram of lengths (1 to capacity) and the plan to fill them."""
    large = {k: n for k, n in counts.items() if capacity * SMALL < k < capacity}
    whole, left = rounded(fractional(large, capacity), large) if large else ({}, {})
    left |= {k: n for k, n in counts.items() if k <= capacity * SMALL}
    configs = list(best_fit(left, capacity, whole).items())
    if counts.get(capacity):
        configs.append((((capacity, 1),), counts[capacity]))
    rows, numbers, sequence = [], Counter(), 0
    for config, n in configs:
        offset = 0
        for length, copies in config:
            rows.append((length * _BIG + numbers[length], copies, sequence, offset))
            numbers[length] += n * copies
            offset += copies * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(4)), sequence)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", cache: tuple[int, int] = (CHUNKS, PIECES)
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the token pieces of every row.

    ``cache`` bounds what a worker remembers of the tokenizer; smaller takes less memory and more time.
    """
    rows = docs.select(quoted(doc_id).cast("string").alias("doc_id"), quoted(text).cast("binary").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_text = encoder(tokenizer, *cache).encode
        for batch in batches:
            out = []
            for key, value in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(encode_text(value))
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    cut_rows = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def packed(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", cache: tuple[int, int] = (CHUNKS, PIECES)
) -> DataFrame:
    """Pieces of every row with their sequence_id and offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like
    any other; other columns are ignored; an empty table gives no rows.
    """
    cut = pieces(docs, tokenizer or tokenizer_path(), capacity, text, doc_id, cache)
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 64 - ORDER_BITS)
    slim = durable(cut.withColumn("order", order).withColumn("one", F.lit(1).cast("long")))
    histogram = slim.groupBy("length").agg(F.count("*").alias("n")).collect()
    plan = docs.sparkSession.sparkContext.broadcast(solve({r["length"]: r["n"] for r in histogram}, capacity))
    numbered = running(slim, "length", "order", ["doc_id", "piece", "ids_crc32"], "one", sum(r["n"] for r in histogram))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sequences, offsets = plan.value.place(lengths.to_numpy(), numbers.to_numpy())
        return pd.DataFrame({"sequence_id": sequences, "offset": offsets})

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*kept, place("length", "before").alias("at")).select(*kept, "at.sequence_id", "at.offset")
