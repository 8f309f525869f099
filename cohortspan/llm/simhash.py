"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
the allowed distance differ by at most one bit in one of them. Every segment is
indexed as it is and once with each bit left out; fingerprints that share an
entry are candidates and their distance is counted. An entry with many
fingerprints is cut into blocks, and each pair of blocks returns a spanning
forest of its true links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import durable, long_schema, pack, quoted, runs, shuffle_width, unpack
from cohortspan.llm.graph import components

BITS = 64
SEED = 42
#: Most fingerprints of one index entry that one task compares (two blocks).
BLOCK = 4096
_HASHES = 1 << 16


def simhash(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint; 0 for a text without words.

    A bit is set if it is set in over half of the shingle hashes. ``text`` is
    UTF-8; A-Z are lower-cased, words lie between ASCII white space.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _HASHES], ends[at:at + _HASHES])], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint column (long) of a text column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of segments of which one differs by one bit at most."""
    n = distance // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, distance: int) -> DataFrame:
    """Index rows (slot, value, fp) of distinct fingerprints.

    ``slot`` names the segment and the bit left out (none: the first slot of a
    segment), ``value`` is what remains of the segment.
    """
    entries = []
    for k, (shift, bits) in enumerate(segments(distance)):
        mask = (1 << bits) - 1 if bits < BITS else -1
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask).cast("long"))
        for b in range(bits + 1):
            keep = ~(1 << (b - 1)) if b else -1
            keep -= (1 << BITS) if keep >= 1 << 63 else 0
            entries.append(F.struct(F.lit(k * (BITS + 1) + b).alias("slot"), segment.bitwiseAND(F.lit(keep).cast("long")).alias("value")))
    return prints.select("fp", F.inline(F.array(*entries))).select("slot", "value", "fp")


def spanning(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Nodes and their roots: a spanning forest of the links within ``distance``."""
    nodes: list[int] = []
    roots: list[int] = []
    rest = prints.view(np.uint64)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        root = int(front[0].view(np.int64))
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                nodes += found.view(np.int64).tolist()
                roots += [root] * len(found)
                front += list(found)
    return nodes, roots


def links(prints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within ``distance``.

    Not every close pair is a row, but the pairs left out are connected through
    others: within an index entry a spanning forest stands for all its links.
    """
    width = shuffle_width(prints.sparkSession)
    # dealt out first: a few tasks would otherwise make all index rows of what small files hold
    index = variants(prints.repartition(width), distance).repartition(width, "slot", "value")
    skipped = F.col("slot") % (BITS + 1)
    shift = F.element_at(F.array(*[F.lit(s) for s, _ in segments(distance)]), (F.col("slot") / (BITS + 1)).cast("int") + 1) + skipped - 1
    bit = F.when(skipped > 0, F.expr("shiftrightunsigned(fp, shift)").bitwiseAND(F.lit(1).cast("long")))
    entries = (
        index.withColumn("shift", shift.cast("int")).withColumn("bit", bit).groupBy("slot", "value")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("bit").alias("b0"), F.max("bit").alias("b1"))
        # without a difference in the bit left out, the whole segment is equal and its own entry links it
        .where("n > 1 and (b0 is null or b0 <> b1)")
    )
    close = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= distance
    pairs = entries.where("n = 2").where(close).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    large = (
        index.join(entries.where("n > 2").select("slot", "value", blocks.cast("int").alias("blocks")), ["slot", "value"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("slot", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    keys = ["slot", "value", "a", "b"]

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, keys):
            nodes, roots = spanning(run["fp"].to_numpy(), distance)
            if nodes:
                yield pd.DataFrame({"u": nodes, "v": roots})

    forest = large.repartition(width, *keys).sortWithinPartitions(*keys, "fp").mapInPandas(forests, long_schema("u", "v"))
    return pairs.unionAll(forest)


def classes(slim: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, first_id, root, component_id) of every distinct fingerprint of (doc_id, fp)."""
    firsts = durable(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    members = durable(components(links(firsts.select("fp"), distance))).withColumnRenamed("node", "fp")
    lows = members.join(firsts, "fp").groupBy("root").agg(F.min("first_id").alias("low"))
    named = members.join(lows, "root").select("fp", "root", "low")
    root, low = F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("low"))
    return firsts.join(named, "fp", "left").select("fp", "first_id", root, low.alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts, or texts of white space only, have fingerprint zero and
    are linked like any other. Rows that repeat a doc_id are kept; a null doc_id
    counts only where a component has no other. Other columns are ignored.
    """
    slim = durable(docs.select(quoted(doc_id).alias("doc_id"), fingerprint(quoted(text), width).alias("fp")))
    named = classes(slim, distance)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return slim.join(named.select("fp", "component_id"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with the input's columns.

    The row with the smallest doc_id stays (null ones last, then the smallest
    hash of the text).
    """
    own = quoted(doc_id)
    # texts are hashed once; rows are found again by id and the hash of the text
    slim = durable(docs.select(fingerprint(quoted(text), width).alias("fp"), own.alias("doc_id"), F.xxhash64(quoted(text)).alias("h")))
    named = classes(slim.select("doc_id", "fp"), distance)
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("fp"))
    keepers = named.groupBy("root").agg(F.min(order).alias("low")).select("low.fp")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    first = slim.groupBy("fp").agg(F.min(rank).alias("first"))
    name = lambda of: F.coalesce(of.cast("string"), F.lit(""))
    keys = ["none", "key", "h"]
    kept = keepers.join(first, "fp").select("first.none", name(F.col("first.id")).alias("key"), "first.h")
    rows = pack(docs, none=own.isNull(), key=name(own), h=F.xxhash64(quoted(text)))
    # rows that repeat both are one
    return unpack(rows.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row")))
