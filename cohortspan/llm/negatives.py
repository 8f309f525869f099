"""Hard-negative mining over anchor-clustered shared lists.

Anchors are clustered by direction. All members of a group of a cluster share one list of
candidates, sorted once by the largest inner product that any direction inside the group's
cone allows: norm times the cosine of the angle to the centre less the cone's half angle.
Each member walks the list and stops where the bound certifies that nothing further down
can enter its answer. Lists are cut by a hash into slots that one task holds, and the
answers of the slots are merged.

Scores are inner products of whole numbers and exact: in doubles as long as they stay below
2**53, then in 64-bit integers, then in unlimited ones; beyond 64 bits they end at the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortspan.llm.common import durable, look_up, quoted, shuffle_width

#: Anchors that share a list, about; groups of anchors whose lists one task makes.
GROUP = 256
SHELF = 16
#: Candidates of one slot, about, and the fewest for which a slot is opened.
SLOT = 1 << 14
LEAST_SLOT = 512
#: Anchors that the cluster centres are fitted on, and the most clusters.
SAMPLE = 8192
CLUSTERS = 256
_ITERATIONS = 8
#: First and largest number of list entries scored at once.
_STEP, _MOST_STEP = 64, 2048
_LIMIT = (1 << 63) - 1
_NONE = -_LIMIT - 1
#: What rounding may add to an angle (radians) and, relatively, to a bound.
_ANGLE_SLACK, _BOUND_SLACK = 1e-6, 1e-9


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as packed doubles.

    The floor is taken in Python, since that of the database ends at 64 bits.
    """

    @F.pandas_udf("binary")
    def of(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.floor(scale * np.asarray(v, np.float64)).astype("<f8").tobytes() for v in vectors], dtype=object)

    return of(vector.cast("array<double>"))


def unpacked(values: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), dim)


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as 64-bit integers."""
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(c).max())
    if most < 2**53:
        return (a @ c.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ c.astype(np.int64).T
    whole_a, whole_c = ([[int(x) for x in row] for row in m] for m in (a, c))
    return np.array([[max(-_LIMIT, min(_LIMIT, sum(map(int.__mul__, x, y)))) for y in whole_c] for x in whole_a], np.int64)


def _directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(m, axis=1)
    return m / np.where(norms > 0, norms, 1)[:, None], norms


def fit_centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Centres of direction, by spherical k-means from the first rows."""
    unit, _ = _directions(sample)
    centres = unit[:clusters].copy()
    for _ in range(_ITERATIONS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        sums, norms = _directions(sums)
        centres = np.where(norms[:, None] > 0, sums, centres)
    return centres


def bounds(members: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each candidate the largest inner product with a member, per unit of the member's norm."""
    unit, norms = _directions(members)
    centre, length = _directions(unit.sum(axis=0, keepdims=True))
    own, sizes = _directions(candidates)
    if not length[0]:
        return sizes
    inside = (unit @ centre[0])[norms > 0]
    cone = np.arccos(np.clip(inside.min(), -1, 1))
    away = np.arccos(np.clip(own @ centre[0], -1, 1)) - cone - _ANGLE_SLACK
    return sizes * np.cos(np.clip(away, 0, np.pi))


class Asks:
    """What the members of a group look for: the ``k`` best candidates each, with scores between two limits."""

    def __init__(self, member: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.member, self.low, self.high, self.k = member, low, high, k
        self.last = np.full(len(member), _NONE)  # score of the k-th best so far
        self.ask = self.score = self.place = np.zeros(0, np.int64)

    def add(self, ask: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        """``place`` numbers the candidates in the order that decides ties."""
        ask, score, place = (np.concatenate(x) for x in ((self.ask, ask), (self.score, score), (self.place, place)))
        order = np.lexsort((place, -score, ask))
        ask, score, place = ask[order], score[order], place[order]
        starts = np.searchsorted(ask, ask, "left")
        rank = np.arange(len(ask)) - starts
        full = rank == self.k - 1
        self.last[ask[full]] = score[full]
        keep = rank < self.k
        self.ask, self.score, self.place = ask[keep], score[keep], place[keep]


def walk(asks: Asks, members: np.ndarray, labels: np.ndarray, uids: np.ndarray, cands: np.ndarray, cand_labels: np.ndarray, cand_uids: np.ndarray, same: bool) -> int:
    """Answer all asks of a group from one shared list; the entries walked.

    Candidates come in the order that decides ties. ``same``: of the member's label, but
    not itself; else of other labels.
    """
    bound = bounds(members, cands)
    listed = np.argsort(-bound, kind="stable")
    norms = np.linalg.norm(members, axis=1)
    at, step = 0, _STEP
    while at < len(listed):
        most = bound[listed[at]] * norms[asks.member] * (1 + _BOUND_SLACK) + 1
        going = np.flatnonzero(~((asks.last > most) | (asks.low > most)))
        if not len(going):
            break
        part = listed[at:at + step]
        rows, own = np.unique(asks.member[going], return_inverse=True)
        found = scores(members[rows], cands[part])
        if same:
            fits = (labels[rows][:, None] == cand_labels[part]) & (uids[rows][:, None] != cand_uids[part])
        else:
            fits = labels[rows][:, None] != cand_labels[part]
        value = found[own]
        low = np.maximum(asks.low, asks.last)[going]
        a, c = np.nonzero(fits[own] & (value >= low[:, None]) & (value <= asks.high[going][:, None]))
        asks.add(going[a], value[a, c], part[c])
        at, step = at + step, min(2 * step, _MOST_STEP)
    return min(at, len(listed))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest whole score from low to high hundredths of the positive's."""
    return max(_NONE, -(-low * positive // 100)), min(_LIMIT, high * positive // 100)


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(uid, id, known, label, dim, q) of the rows that take part, stored.

    A null vec_id is not ``known`` and has the largest number as id.
    """
    v, own = quoted(vector), quoted(vec_id).cast("long")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(v.isNotNull() & label.isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(own, F.lit(_LIMIT)).alias("id"), own.isNotNull().alias("known"),
        label.cast("long").alias("label"), F.size(v).alias("dim"), whole(v).alias("q"),
    )
    return durable(rows)


def grouped(anchors: DataFrame) -> DataFrame:
    """Anchors with the shelf and the group that they share a list with."""
    sample = anchors.select("dim", "q", "uid").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toPandas()
    centres = {
        dim: fit_centres(unpacked(part["q"], dim), max(1, min(CLUSTERS, len(part) // 32)))
        for dim, part in sample.groupby("dim", sort=True) if dim
    }

    @F.pandas_udf("int")
    def nearest(dims: pd.Series, packed: pd.Series) -> pd.Series:
        out = pd.Series(0, index=dims.index, dtype="int32")
        for dim, part in packed.groupby(dims.to_numpy()):
            if dim in centres:
                out[part.index] = (_directions(unpacked(part, dim))[0] @ centres[dim].T).argmax(axis=1).astype("int32")
        return out

    marked = durable(anchors.withColumn("cluster", nearest("dim", "q")))
    sizes = marked.groupBy("dim", "cluster").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / GROUP))
    before = W.partitionBy("dim").orderBy("cluster").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    number = F.col("base") + F.pmod(F.xxhash64("uid"), F.col("parts"))
    placed = look_up(marked, bases, ["dim", "cluster"]).withColumn("group", number.cast("long"))
    return placed.withColumn("shelf", F.floor(F.col("group") / SHELF)).drop("cluster", "parts", "base")


_FOUND = "anchor_uid long, anchor_id long, positive_score long, id long, known boolean, uid long, score long"


def _answers(cells_of: DataFrame, candidates: DataFrame, k: int, low: int, high: int, same: bool) -> DataFrame:
    """The best ``k`` of each slot for each anchor (and positive score)."""

    def answer(key: tuple, anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        dim, found = int(key[0]), []
        if len(anchors) and len(cands):
            # ties go to the smaller id, null ones last
            cands = cands.sort_values(["known", "id", "uid"], ascending=[False, True, True], ignore_index=True)
            matrix = unpacked(cands["q"], dim)
            labels, uids, ids, known = (cands[c].to_numpy() for c in ("label", "uid", "id", "known"))
            for _, group in anchors.groupby("group", sort=True):
                if same:
                    member = np.arange(len(group))
                    of = np.full(len(group), _NONE)
                    lows, highs = np.full(len(group), _NONE), np.full(len(group), _LIMIT)
                else:
                    flat = [(i, s, *window(int(s), low, high)) for i, given in enumerate(group["given"]) for s in given]
                    member, of, lows, highs = (np.array(x, np.int64) for x in zip(*flat))
                asks = Asks(member, lows, highs, k)
                walk(asks, unpacked(group["q"], dim), group["label"].to_numpy(), group["uid"].to_numpy(), matrix, labels, uids, same)
                who = member[asks.ask]
                found.append(pd.DataFrame({
                    "anchor_uid": group["uid"].to_numpy()[who], "anchor_id": group["id"].to_numpy()[who], "positive_score": of[asks.ask],
                    "id": ids[asks.place], "known": known[asks.place], "uid": uids[asks.place], "score": asks.score,
                }))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])

    keys = ["dim", "shelf", "slot"]
    own = cells_of.select(*[F.col(c).alias(c) for c in cells_of.columns])  # of the same table as the candidates
    found = own.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(answer, _FOUND)
    best = W.partitionBy("anchor_uid", "positive_score").orderBy(F.desc("score"), F.desc("known"), "id", "uid")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumn("id", F.when(F.col("known"), F.col("id")))


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` is a condition on ``id``, the vec_id; ``label`` an expression on the input. Each
    anchor's positives are its best ``positives`` other rows of its label; for each of them come
    the best ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the
    positive. Rows with a null label, a null vector, or a null or non-finite component take no
    part. Vectors of unlike length have no inner product and are never compared; empty vectors
    score 0 with each other. A null vec_id is no anchor and comes last among ties. Rows that
    repeat a vec_id count as rows of their own; a positive without negatives has no row.
    """
    rows = prepared(vectors, vec_id, vector, label)
    width = shuffle_width(vectors.sparkSession)
    wanted = durable(grouped(rows.where(F.col("known") & anchor)))
    shelves = wanted.groupBy("dim").agg((F.max("shelf") + 1).alias("shelves"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).join(shelves, "dim")
    slots = F.greatest(F.ceil(F.col("n") / SLOT), F.least(F.lit(width), F.ceil(F.col("n") / LEAST_SLOT))).cast("int")
    sizes = durable(sizes.select("dim", "n", "shelves", slots.alias("slots")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    candidates = look_up(rows, sizes, ["dim"]).withColumn("slot", F.pmod(F.xxhash64("uid"), F.col("slots")).cast("long"))
    candidates = candidates.withColumn("shelf", numbers("shelves")).drop("slots", "shelves")
    cells = look_up(wanted, sizes, ["dim"]).withColumn("slot", numbers("slots")).drop("slots", "shelves")
    chosen = durable(_answers(cells, candidates, positives, 0, 0, True))
    chosen = chosen.select("anchor_uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    given = chosen.groupBy("anchor_uid").agg(F.collect_set("positive_score").alias("given")).withColumnRenamed("anchor_uid", "uid")
    found = _answers(cells.join(given, "uid"), candidates, negatives, low, high, False)
    found = found.select("anchor_uid", "anchor_id", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(chosen, ["anchor_uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100, after every seventh label has moved on."""
    own, kind = quoted(vec_id), quoted(label).cast("long")
    moved = F.when(own % 7 == 0, (kind + 1) % 10).otherwise(kind)
    return hard_negatives(vectors, F.col("id") % 100 == 0, moved, vec_id, vector)
