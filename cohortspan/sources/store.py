"""Fact tables stored by key: joins on the key move nothing, a rerun replaces single partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def create_store(df: DataFrame, name: str, path: str, key: str, buckets: int, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as table ``name`` at ``path``, in ``buckets`` files per partition by ``key``, each sorted by it.

    Tables of the same key and number of buckets join without an exchange. Rows are dealt out as the
    buckets are, so that every task writes one file per partition. An existing table of the name is an error.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort_by).option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def replace_partitions(df: DataFrame, name: str, key: str) -> DataFrame:
    """Overwrite the partitions of table ``name`` that ``df`` has rows for; the others stay as they are.

    ``df`` may not read the table it replaces. Columns are matched by name; a missing one is an error.
    """
    spark = df.sparkSession
    table = spark.table(name)
    missing = {c.lower() for c in table.columns} - {c.lower() for c in df.columns}
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    before = spark.conf.get(_DYNAMIC)
    spark.conf.set(_DYNAMIC, "dynamic")
    try:
        df.select(*table.columns).repartition(buckets_of(spark, name), key).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_DYNAMIC, before)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    """Number of buckets of a stored table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"table {name!r} has no buckets")
    return int(rows[0]["data_type"])
