"""Report tables: distributions, length statistics, outcomes, profiles.

The characteristics are unpivoted once and counted in one pass; shares come from
a window over the counted table, which has one row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.functions.bands import null_to_unknown
from cohortspan.functions.flags import outcome_conditions


def unpivot_variables(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (variable, value) of the characteristics, nulls as "unknown"."""
    # text copies under their own names: a variable may also be kept as it is
    texts = {v: f"_text_{i}" for i, v in enumerate(variables)}
    cells = ", ".join(f"'{v}', `{t}`" for v, t in texts.items())
    return df.select(*keep, *[null_to_unknown(v).alias(t) for v, t in texts.items()]).select(
        *keep, F.expr(f"stack({len(texts)}, {cells}) as (variable, value)")
    )


def share(df: DataFrame, n: str, within: Sequence[str], digits: int | None = 2, percent: bool = True) -> Column:
    """Share of ``n`` in its parent cells, as a column over a counted table."""
    total = F.sum(n).over(Window.partitionBy(*within))
    ratio = F.col(n) / total * 100 if percent else F.col(n) / total
    return ratio if digits is None else F.round(ratio, digits)


def pivot_bands(df: DataFrame, keys: Sequence[str], band: str, bands: Sequence[str], cells: dict[str, str]) -> DataFrame:
    """One column per band and cell; bands are given, so the schema is stable."""
    aggregates = [F.first(cell).alias(name) for name, cell in cells.items()]
    return df.groupBy(*keys).pivot(band, list(bands)).agg(*aggregates)


def band_distribution(
    df: DataFrame,
    variables: Sequence[str],
    band: str,
    denominator: str = "value",
    grain: Sequence[str] = (),
    bands: Sequence[str] | None = None,
    digits: int = 2,
) -> DataFrame:
    """Counts and percentages by characteristic value and band.

    ``denominator``: "value" (row percentages), "band" (column percentages) or
    "all". ``grain`` first reduces the input to one row per grain, value
    combination and band. ``bands`` pivots the result.
    """
    if grain:
        df = df.groupBy(*dict.fromkeys([*variables, *grain, band])).agg(F.count("*").alias("_rows"))
    counted = (
        unpivot_variables(df, variables, [band])
        .groupBy("variable", "value", band)
        .agg(F.count("*").alias("n"))
    )
    within = {"value": ["variable", "value"], "band": ["variable", band], "all": ["variable"]}[denominator]
    total = Window.partitionBy(*within)
    long = counted.withColumn("total_count", F.sum("n").over(total)).withColumn(
        "percentage", F.round(F.col("n") / F.col("total_count") * 100, digits)
    )
    if bands is None:
        return long
    keys = ["variable", "value"] + (["total_count"] if denominator == "value" else [])
    wide = pivot_bands(long, keys, band, bands, {"count": "n", "percentage": "percentage"})
    return wide.na.fill(0, [f"{b}_{cell}" for b in bands for cell in ("count", "percentage")])


def cross_distribution(df: DataFrame, pairs: Sequence[tuple[str, str]], band: str, digits: int = 2) -> DataFrame:
    """As :func:`band_distribution` for pairs of characteristics, in one pass."""
    names = list(dict.fromkeys(v for pair in pairs for v in pair))
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("first_variable"),
                F.lit(c).alias("second_variable"),
                null_to_unknown(a).alias("first_value"),
                null_to_unknown(c).alias("second_value"),
            )
            for a, c in pairs
        ]
    )
    keys = ["first_variable", "second_variable", "first_value", "second_value"]
    counted = (
        df.select(*dict.fromkeys([*names, band]))
        .select(F.inline(entries), F.col(band))
        .groupBy(*keys, band)
        .agg(F.count("*").alias("n"))
    )
    total = Window.partitionBy(*keys)
    return counted.withColumn("total_count", F.sum("n").over(total)).withColumn(
        "percentage", F.round(F.col("n") / F.col("total_count") * 100, digits)
    )


def quantile(value: str, p: float, accuracy: int | None = None) -> Column:
    """Smallest value with at least a share ``p`` of the rows at or below it.

    The exact form (no ``accuracy``) keeps one count per distinct value, which
    the calendar bounds for day counts; give an accuracy for money.
    """
    if accuracy is None:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return F.percentile_approx(value, p, accuracy)


def _length_aggregates(length: str, accuracy: int | None, digits: int) -> list[Column]:
    spread = quantile(length, 0.75, accuracy) - quantile(length, 0.25, accuracy)
    return [
        F.round(F.avg(length), digits).alias("mean"),
        F.round(quantile(length, 0.5, accuracy), digits).cast("double").alias("median"),
        F.round(F.stddev_samp(length), digits).alias("sd"),
        F.round(spread, digits).cast("double").alias("iqr"),
    ]


def length_stats(
    df: DataFrame, length: str, variables: Sequence[str], accuracy: int | None = None, digits: int = 2
) -> DataFrame:
    """Mean, median, sample deviation and quartile range of the wait by value."""
    return (
        unpivot_variables(df, variables, [length])
        .groupBy("variable", "value")
        .agg(*_length_aggregates(length, accuracy, digits))
    )


def length_stats_by(
    df: DataFrame, length: str, keys: Sequence[str], accuracy: int | None = None, digits: int = 2
) -> DataFrame:
    """As :func:`length_stats` for a combination of keys."""
    named = df.select(length, *[null_to_unknown(k).alias(k) for k in keys])
    return named.groupBy(*keys).agg(*_length_aggregates(length, accuracy, digits))


def median_by(df: DataFrame, value: str, keys: Sequence[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Median by keys, exact for day counts; use the approximate form for money."""
    middle = F.median(value) if exact else F.percentile_approx(value, 0.5, accuracy).cast("double")
    return df.groupBy(*keys).agg(middle.alias("median"), F.count(value).alias("n"))


def outcome_table(df: DataFrame, variables: Sequence[str], digits: int = 2) -> DataFrame:
    """Ten independent outcome counts and their share by characteristic value."""
    tests = outcome_conditions()
    # code 99 counts both as missing and, with an imputed end, once more
    names = {"unknown": "null", "unknown_imputed_end": "null_imputed_end"}
    labels = [names.get(label, label) for label in tests]
    flagged = df.select(
        *variables, *[F.coalesce(t, F.lit(False)).cast("int").alias(f"_{n}") for n, t in zip(labels, tests.values())]
    )
    counted = (
        unpivot_variables(flagged, variables, [f"_{n}" for n in labels])
        .groupBy("variable", "value")
        .agg(F.count("*").alias("total_count"), *[F.sum(f"_{n}").alias(f"count_{n}") for n in labels])
    )
    return counted.withColumns(
        {f"percentage_{n}": F.round(F.col(f"count_{n}") / F.col("total_count") * 100, digits) for n in labels}
    )


def band_report(df: DataFrame, band: str, grain: Sequence[str], digits: int = 2) -> DataFrame:
    """Counts per band over the whole table with the grand total."""
    counted = (
        df.groupBy(*grain, band)
        .agg(F.count("*").alias("_rows"))
        .groupBy(null_to_unknown(band).alias(band))
        .agg(F.count("*").alias("n"))
    )
    # the counted table has one row per band
    whole = Window.partitionBy(F.lit(1))
    return counted.withColumn("total_count", F.sum("n").over(whole)).withColumn(
        "percentage", F.round(F.col("n") / F.col("total_count") * 100, digits)
    )


def proportion_by(df: DataFrame, keys: Sequence[str], within: Sequence[str], digits: int | None = None) -> DataFrame:
    """Count per key combination and its share of the parent keys."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    parent = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    ratio = F.col("n") / F.col("total_count")
    return counted.withColumn("total_count", F.sum("n").over(parent)).withColumn(
        "proportion", ratio if digits is None else F.round(ratio, digits)
    )


def baseline_gap(proportions: DataFrame, key: str, baseline: dict[str, float]) -> DataFrame:
    """Difference between a share and a fixed reference share."""
    pairs = [F.lit(x) for item in baseline.items() for x in item]
    reference = F.try_element_at(F.create_map(*pairs), F.col(key))
    return proportions.withColumn("baseline", reference).withColumn("difference", F.col("proportion") - reference)


def report_layout(counts: DataFrame, categories: dict[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Rows of a report in a fixed order, with one header row per category."""
    lines: list[tuple] = []
    for variable, values in categories.items():
        lines += [(variable, None, variable), *((variable, value, value) for value in values)]
    rows = [(i, *line) for i, line in enumerate(lines)]
    frame = counts.sparkSession.createDataFrame(rows, "ord int, variable string, value string, label string")
    return (
        frame.join(counts.select("variable", "value", *keep), ["variable", "value"], "left")
        .filter(F.col("value").isNull() | F.col(keep[0]).isNotNull())
        .select("ord", "variable", "label", *keep)
    )
