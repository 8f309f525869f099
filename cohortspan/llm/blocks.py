"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks; equal blocks get one whole number as name, by
sorting, never by a hash alone. Neighbouring names are paired and the pairs named again,
until each text has one name. Texts with the same number of blocks and the same name
are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from cohortspan.llm.common import SPACE, durable, quoted, scratch

#: Bytes of a block.
BLOCK = 1 << 14
_CELLS = "uid long, row long, doc_id string, sha string, blocks long, place long, run long, block binary"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _cells(docs: DataFrame, text: str, doc_id: str, block: int) -> DataFrame:
    """One row per block, stored. Blocks are sorted within each input partition; the
    first of equal ones carries the bytes, all carry the number of their run."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).cast("string").alias("doc_id"), normalised(quoted(text)).alias("text"))
    rows = rows.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("text").cast("binary").alias("data"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("long")
    cells = rows.withColumn("blocks", blocks).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = F.col("place") == 0
    cells = cells.select(
        "row", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "blocks", "place",
        F.expr(f"substring(data, cast(place * {block} + 1 as int), {block})").alias("block"),
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        seen, last, run = 0, None, -1
        for batch in batches:
            values = batch["block"].tolist()
            changed = np.array([a != b for a, b in zip(values, [last, *values[:-1]])], bool)
            yield batch.assign(uid=base + seen + np.arange(len(values)), run=base + run + np.cumsum(changed), block=[v if c else None for v, c in zip(values, changed)])
            if values:
                run, last, seen = run + int(changed.sum()), values[-1], seen + len(values)

    path = scratch(docs.sparkSession, "blocks")
    cells.sortWithinPartitions("block").mapInPandas(number, _CELLS).write.parquet(path)
    return docs.sparkSession.read.schema(_CELLS).parquet(path)


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(row, doc_id as text, sha, blocks, name) of every row: equal blocks and name, equal text.

    Only one copy of a block leaves an input partition. A pair is named by the smallest
    number of the places where it stands, found by a map-side aggregate, so neither
    hot blocks nor hot pairs meet in one task.
    """
    cells = _cells(docs, text, doc_id, block)
    same = W.partitionBy("block")
    names = durable(cells.where("block is not null").select("run", F.min("run").over(same).alias("name")))
    units = durable(cells.drop("block").join(names, "run").select("uid", "row", "doc_id", "sha", "blocks", "place", "name"))
    done = units.where("blocks = 1")
    heads = units.where("place = 0 and blocks > 1").select("row", "doc_id", "sha", "blocks")
    units = units.where("blocks > 1").select("uid", "row", "place", "name")
    left = cells.agg(F.max("blocks")).first()[0] or 1
    while left > 1:
        even = F.col("place") % 2 == 0
        pairs = units.groupBy("row", F.shiftright("place", 1).alias("half")).agg(
            F.max(F.when(even, F.col("uid"))).alias("uid"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        # a text that is one unit already keeps being named alone, which changes no equality
        pairs = durable(pairs)
        named = pairs.groupBy("a", "b").agg(F.min("uid").alias("name"))
        units = durable(pairs.join(named, ["a", "b"]).select("uid", "row", F.col("half").alias("place"), "name"))
        left = (left + 1) // 2
    joined = heads.join(units.select("row", "name"), "row")
    columns = ["row", "doc_id", "sha", "blocks", "name"]
    return done.select(*columns).unionAll(joined.select(*columns))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Of equal texts the row with the smallest doc_id stays (null ones last); of rows that
    repeat it, exactly one. Null and empty texts are equal; white space alone is one
    space. Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    rows = durable(identities(docs, text, doc_id, block).withColumn("doc_id", F.col("doc_id").cast(kind)))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = rows.groupBy("blocks", "name").agg(F.min(rank).alias("low"), F.count("*").alias("group_size"))
    kept = groups.select("blocks", "name", F.col("low.doc_id").alias("keep_id"), F.col("low.row").alias("keep_row"), "group_size")
    return rows.join(kept, ["blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
