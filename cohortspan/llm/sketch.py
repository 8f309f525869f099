"""Bottom-k sketches of word shingles.

The k smallest distinct hashes of a text's shingles estimate resemblance,
containment and the number of distinct shingles; the sketch of a union is made from
the sketches of its parts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortspan.llm.common import quoted, shuffle_width

K = 128
WIDTH = 5
SEED = 42


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """Sorted unsigned hashes; empty for a text without words. Fewer words than the
    width are one shingle."""
    words = text.encode().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64)
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two texts' shingles."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of shared to all shingles; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float | None:
    """Estimate of the share of a's shingles that b has; 1 for an empty a.

    Of a's hashes those count that b's sketch would hold if b had them, all of them where b's sketch
    is not full. None where there is no such hash: a short text and a far longer one give no evidence.
    """
    if not len(a):
        return 1.0
    seen = a if len(b) < k else a[a <= b[k - 1]]
    return float(np.isin(seen, b, assume_unique=True).mean()) if len(seen) else None


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k, else from the density of the k smallest hashes."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value), ">u8").astype(np.uint64)


def merge(hashes: DataFrame, key: str, value: str, k: int = K) -> DataFrame:
    """Sketch of each key's union from rows (key, one hash as long), as unsigned-sorted rows.

    Hashes are made distinct and cut to the k smallest per key before the shuffle, so a
    hot key moves k rows per task at most.
    """
    rows = hashes.select(quoted(key).alias(key), quoted(value).alias(value)).distinct()
    unsigned = F.col(value).bitwiseXOR(F.lit(-(1 << 63)))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(unsigned)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def _ranges(ids: DataFrame, width: int) -> tuple[list[int], dict[int, int]]:
    """Cuts of the id's range into parts, and the part that ends before each part's first id.

    At most ``width`` cuts, parts and first ids reach the driver.
    """
    shares = [i / width for i in range(1, width)] or [0.5]
    found = ids.agg(F.percentile_approx("key", shares, 4 * width).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    firsts = ids.select(F.col("key"), _part(cuts)(F.col("key")).alias("part")).groupBy("part").agg(F.min("key").alias("low")).orderBy("part").collect()
    # the first document follows the last one of the last part
    before = {row["low"]: firsts[k - 1]["part"] for k, row in enumerate(firsts)}
    return cuts, before


def _part(cuts: list[int]):
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return of


def with_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows (part, guest, key, is_null, id, text) sorted within parts; guests are the next part's first rows."""
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(
        F.coalesce(quoted(doc_id).cast("long"), lowest).alias("key"), quoted(doc_id).isNotNull().alias("known"), F.coalesce(quoted(text), F.lit("")).alias("text")
    )
    width = shuffle_width(docs.sparkSession)
    cuts, before = _ranges(rows.select("key"), width)
    lows = np.array(sorted(before), np.int64)
    hosts = np.array([before[k] for k in sorted(before)], np.int32)
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.int64)
        own = np.searchsorted(edges, values, side="right")
        k = np.searchsorted(lows, values)
        first = (k < len(lows)) & (lows[np.minimum(k, len(lows) - 1)] == values) if len(lows) else np.zeros(len(values), bool)
        # a guest's part is stored as its complement, below zero
        return pd.Series([[int(p), ~int(hosts[j])] if f else [int(p)] for p, f, j in zip(own, first, k)])

    placed = rows.withColumn("place", F.explode(places("key")))
    part = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    placed = placed.select(part.alias("part"), (F.col("place") < 0).cast("int").alias("guest"), "key", "known", "text")
    return placed.repartitionById(width, F.col("part")).sortWithinPartitions("part", "guest", "key", "known", "text")


def with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    ``kept_edited`` and ``kept_next`` are the shares of the text's shingles that the edited and the next
    text have (null without evidence), ``distinct_with_next`` the shingles of the text and its next together.

    The edit puts the start of the next document, by ascending doc_id, in place of the
    last quarter. Null ids come first, equal ids are ordered by text; a null text is
    empty. The last document's next is the first. Other columns are ignored.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # part, key, known, text, sketch of the row that waits for its next
        for batch in batches:
            out = []
            for part, guest, key, known, value in zip(batch["part"].tolist(), batch["guest"].tolist(), batch["key"].tolist(), batch["known"].tolist(), batch["text"].tolist()):
                own = None
                if held is not None and held[0] == part:
                    own = sketch(value, k, width)
                    _, last, last_known, before, print_ = held
                    cut = len(before) // 4
                    edited = before[: len(before) - cut] + value[:cut]
                    other = sketch(edited, k, width)
                    out.append((
                        str(last) if last_known else None, len(before), hashlib.sha256(edited.encode()).hexdigest(),
                        to_text(print_), to_text(other), resemblance(print_, other, k), resemblance(print_, own, k), distinct_shingles(print_, k),
                        containment(print_, other, k), containment(print_, own, k), distinct_shingles(merged(print_, own, k), k),
                    ))
                held = None if guest else (part, key, known, value, sketch(value, k, width) if own is None else own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "kept_edited", "kept_next", "distinct_with_next"])

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, kept_edited double, kept_next double, distinct_with_next double"
    found = with_next(docs, text, doc_id).mapInPandas(compare, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
