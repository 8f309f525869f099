"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.session import durable


def read_parquet(spark: SparkSession, path: str, fill: float | None = None) -> DataFrame:
    """Parquet scan; ``fill`` replaces nulls of the numeric columns."""
    df = spark.read.parquet(path)
    return df if fill is None else df.na.fill(fill)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Delimited input with a header and a declared schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Delimited input split in accepted rows and the ``record`` texts of rejected lines.

    A line is rejected when it has more or fewer fields than the schema or a field that its type cannot read; an empty
    field is null. The lines are parsed once, with all columns whatever is read later, and stored, so the
    two outputs add up to the lines of the file.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if record.lower() in (f.name.lower() for f in fields):
        raise ValueError(f"the schema has a column {record!r}")
    parsed = spark.read.csv(
        path, header=True, schema=T.StructType([*fields, T.StructField(record, T.StringType())]), mode="PERMISSIVE", columnNameOfCorruptRecord=record
    )
    stored = durable(parsed)
    bad = F.col(record).isNotNull()
    return stored.filter(~bad).drop(record), stored.filter(bad).select(record)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early when a column is missing (names compare without case)."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a result table; one table partitioned by metric replaces many paths."""
    writer = df.write.mode("overwrite").option("overwriteSchema", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited export of a result table."""
    df.write.mode("overwrite").csv(path, header=True)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a frame to SQL."""
    df.createOrReplaceTempView(name)
    return df


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every fractional column of a result."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, fractional) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
