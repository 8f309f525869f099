"""High users, chi-square test and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.functions.tails import chi2_p
from cohortspan.operators.ordered import join_values, running_count
from cohortspan.operators.tables import unpivot_variables
from cohortspan.session import durable

TOP, REST = "Top 10%", "Bottom 90%"


def weekly_use(totals: DataFrame, measure: str, keys: Sequence[str], days: str = "wt") -> DataFrame:
    """Use per week of the wait, one row per key combination."""
    return (
        totals.groupBy(*keys, days)
        .agg(F.sum(measure).alias("use"))
        .withColumn("weekly_use", F.col("use") / (F.col(days) / 7))
    )


def high_users(weekly: DataFrame, share: float = 0.9, accuracy: int | None = None, name: str = "usage_group") -> DataFrame:
    """Label the units at or above the quantile of weekly use.

    The threshold is exact, from counts of distinct values along ranges, or with
    ``accuracy`` a sketch of that size.
    """
    if accuracy is None:
        weekly = durable(weekly)
        values = weekly.filter(F.col("weekly_use").isNotNull()).groupBy("weekly_use").agg(F.count("*").alias("_n"))
        upto = running_count(values, "weekly_use", "_n", name="_before").filter(
            F.col("_before") + F.col("_n") >= F.ceil(values.agg(F.sum("_n")).scalar() * share)
        )
        cut = upto.agg(F.min("weekly_use")).scalar()
    else:
        cut = weekly.agg(F.percentile_approx("weekly_use", share, accuracy)).scalar()
    return weekly.withColumn(name, F.when(F.col("weekly_use") >= cut, TOP).otherwise(REST))


def high_user_table(labelled: DataFrame, variables: Sequence[str], name: str = "usage_group") -> DataFrame:
    """Counts and percentages of both groups by characteristic value."""
    counted = (
        unpivot_variables(labelled, variables, [name])
        .groupBy("variable", "value")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col(name) == REST).alias("bottom_90"),
            F.count_if(F.col(name) == TOP).alias("top_10"),
        )
    )
    return counted.withColumns(
        {
            "bottom_90_percentage": F.col("bottom_90") / F.col("total") * 100,
            "top_10_percentage": F.col("top_10") / F.col("total") * 100,
        }
    )


def chi_square(
    df: DataFrame,
    variables: Sequence[str],
    group: str,
    groups: Sequence[str],
    yates: bool = True,
    p_values: bool = True,
) -> DataFrame:
    """Independence of each variable and the group: statistic, dof and p-value.

    With one degree of freedom the continuity correction applies: the
    differences shrink by half a unit, but not past zero.
    """
    counted = (
        unpivot_variables(df.filter(F.col(group).isin(*groups)), variables, [group])
        .groupBy("variable", "value")
        .agg(*[F.count_if(F.col(group) == g).alias(f"g{i}") for i, g in enumerate(groups)])
    )
    cells = F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"g{i}").alias("n")) for i, g in enumerate(groups)])
    variable = Window.partitionBy("variable")
    table = (
        counted.select("variable", "value", F.inline(cells))
        .withColumns(
            {
                "row_total": F.sum("n").over(Window.partitionBy("variable", "value")),
                "column_total": F.sum("n").over(Window.partitionBy("variable", "group")),
                "total": F.sum("n").over(variable),
            }
        )
        # an empty column is no column of the contingency table
        .filter(F.col("column_total") > 0)
        .withColumn("expected", F.col("row_total").cast("double") * F.col("column_total") / F.col("total"))
    )
    sizes = table.groupBy("variable").agg(
        F.count_distinct("value").alias("rows"), F.count_distinct("group").alias("columns")
    )
    shaped = table.join(sizes, "variable").withColumn("dof", ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("int"))
    gap = F.abs(F.col("n") - F.col("expected"))
    corrected = F.when((F.col("dof") == 1) & F.lit(yates), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = shaped.groupBy("variable", "dof").agg(
        F.sum(corrected * corrected / F.col("expected")).alias("statistic"),
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("group") == g, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, g in enumerate(groups)],
    )
    # one value or one group leaves nothing to test
    out = out.withColumn("statistic", F.when(F.col("dof") > 0, F.col("statistic")))
    return out.withColumn("p_value", chi2_p("statistic", "dof")) if p_values else out


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    The pairs are first counted, ranks belong to distinct values, and the
    correlation is weighted by the counts.
    """
    counted = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    # both rankings, the total and the sums read the counts
    pairs = durable(counted)

    def ranks(column: str, name: str) -> DataFrame:
        values = pairs.groupBy(column).agg(F.sum("n").alias("_n"))
        before = running_count(values, column, "_n", name="_before")
        return before.select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))

    sizes = pairs.agg(F.sum("n").alias("n"), F.approx_count_distinct(x).alias("x"), F.approx_count_distinct(y).alias("y")).first()
    ranked = join_values(join_values(pairs, ranks(x, "_rx"), x, sizes["x"]), ranks(y, "_ry"), y, sizes["y"])
    n = F.col("n")
    # ranks centre on (N + 1) / 2; centring first keeps the sums small
    total = F.lit(sizes["n"])
    rx, ry = F.col("_rx") - (total + 1) / 2, F.col("_ry") - (total + 1) / 2
    sums = ranked.agg(
        F.sum(n).alias("n"),
        F.sum(n * rx * ry).alias("xy"),
        F.sum(n * rx * rx).alias("xx"),
        F.sum(n * ry * ry).alias("yy"),
    )
    return sums.select("n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("rho"))
