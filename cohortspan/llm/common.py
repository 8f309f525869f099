"""What the text operators share: session limits, row packing, word patterns."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortspan.session import adapt, durable

#: Fixed values of the contracts: ASCII white space and words between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch hands to Python, so that long texts
#: cannot pile up in a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Skew handling on, Arrow batches small."""
    adapt(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, _keep: Sequence[str] | None = None, **more: Column) -> DataFrame:
    """The row as one struct ``_row`` next to computed columns.

    Whatever the input's columns are called, they cannot clash with an operator's own.
    """
    kept = df.columns if _keep is None else _keep
    row = (F.struct(*[quoted(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))).alias("_row")
    return df.select(row, *[c.alias(k) for k, c in more.items()])


def unpack(df: DataFrame, *more: str) -> DataFrame:
    """Columns of the packed row again, then the named computed ones."""
    return df.select("_row.*", *more)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def runs(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, of batches sorted by them."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        new = (batch[list(keys)] != batch[list(keys)].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for start, end in zip(new, new[1:]):
            yield batch.iloc[start:end]
        held = batch.iloc[new[-1]:]
    if held is not None and len(held):
        yield held


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; it goes when the application ends.

    That folder is ``spark.checkpoint.dir``. Only a local session without it gets a
    temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortspan-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    return path.toString()


#: Rows of a key that one task sums up in order, about.
BUCKET_ROWS = 4096
#: Bits of the order column of ``running``.
ORDER_BITS = 60


def running(df: DataFrame, key: str, order: str, ties: Sequence[str], weight: str, rows: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over earlier rows of the same key.

    ``order`` is an evenly spread whole number of ORDER_BITS bits. It is cut into
    ranges of about BUCKET_ROWS rows (from the number of ``rows``, which does not
    change the result), sums of the ranges are added up, and only rows of one key
    and range meet in a task; so no key is too large for one.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
    cut = df.withColumn("_range", F.shiftright(order, ORDER_BITS - bits) if bits else F.lit(0).cast("long"))
    sums = cut.groupBy(key, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy(key, "_range").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    before = F.col("_base") + F.sum(weight).over(within) - F.col(weight)
    return cut.join(bases, [key, "_range"]).withColumn("before", before).drop("_range", "_base")


#: Rows from which a key's rows are looked up map-side, and the most such keys.
HOT_ROWS = 1000
HOT_KEYS = 10_000


def look_up(rows: DataFrame, answers: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``answers``, which has one row per key; others go.

    ``count`` of ``answers`` is the number of rows of the key. Keys of many rows are few by
    definition (HOT_KEYS at most) and are broadcast, so that their rows do not move and never
    meet in one task; the rest meet by key. ``rows`` is read twice.
    """
    total = answers.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = answers.where(F.col(count) >= least).drop(count)
    cold = answers.where(F.col(count) < least).drop(count)
    moved = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(moved)
