"""Two-way fixed effects for any number of periods, by alternating projections.

The regressor and every outcome are freed of entity and period means in turn until the
period effects stand still; the slope is then a ratio of two sums. Rows are reduced to
cells of entity and period once. An entity is one row with its cells in an array (never
more than there are periods), so a round reads stored rows, moves one row per period and
task, and needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.session import durable

MAX_PERIODS = 10_000


def period_cells(rows: DataFrame, outcomes: Sequence[str], regressor: str, entity: str, period: str) -> DataFrame:
    """One row per entity and period: ``n`` rows, sums and products.

    ``v[0]`` and ``xv[0]`` belong to the regressor, the others to the outcomes in order.
    """
    names = [f"_v{i}" for i in range(1 + len(outcomes))]
    values = rows.select(
        F.col(entity).alias("entity"), F.col(period).alias("period"), *[F.col(c).cast("double").alias(v) for c, v in zip([regressor, *outcomes], names)]
    ).na.drop()
    sums = values.groupBy("entity", "period").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(v) for v in names], *[F.sum(F.col("_v0") * F.col(v)).alias(f"x{v}") for v in names]
    )
    return sums.select("entity", "period", "n", F.array(*names).alias("v"), F.array(*[f"x{v}" for v in names]).alias("xv"))


def entity_rows(cells: DataFrame, periods: Sequence) -> DataFrame:
    """One row per entity: ``n`` rows and ``cells``, with the place ``t`` of each period from 1."""
    place = F.array_position(F.array(*[F.lit(p) for p in periods]), F.col("period")).cast("int")
    return cells.groupBy("entity").agg(F.sum("n").alias("n"), F.collect_list(F.struct(place.alias("t"), "n", "v", "xv")).alias("cells"))


def _literal(values: np.ndarray) -> Column:
    return F.lit(np.ascontiguousarray(values, np.float64))


def _entity_effects(gammas: np.ndarray) -> list[Column]:
    """Mean of each variable over an entity's rows, after the period effects are taken off."""
    def mean(k: int) -> Column:
        effect = _literal(gammas[k])
        return F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["v"][k] - c["n"] * F.get(effect, c["t"] - 1)) / F.col("n")

    return [mean(k) for k in range(len(gammas))]


def period_effects(entities: DataFrame, variables: int, periods: int, tolerance: float = 1e-10, max_rounds: int = 2000) -> tuple[np.ndarray, int]:
    """Period effects (variables x periods) at which both projections leave the variables alone, and the rounds taken.

    A round is one pass over the entities; ``periods`` rows reach the driver. A variable has settled
    when no effect moves by more than ``tolerance`` times the size of its largest.
    """
    gammas = np.zeros((variables, periods))
    for turn in range(1, max_rounds + 1):
        freed = entities.select("cells", F.array(*_entity_effects(gammas)).alias("a")).select("a", F.inline("cells"))
        sums = freed.groupBy("t").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("v")[k] - F.col("n") * F.col("a")[k]).alias(f"s{k}") for k in range(variables)]
        )
        after = np.zeros_like(gammas)
        for row in sums.collect():
            after[:, row["t"] - 1] = [row[f"s{k}"] / row["n"] for k in range(variables)]
        moved, size = np.abs(after - gammas).max(axis=1, initial=0), np.abs(after).max(axis=1, initial=0)
        gammas = after
        if (moved <= tolerance * np.maximum(size, 1e-300)).all():
            return gammas, turn
    raise ArithmeticError(f"period effects still move after {max_rounds} rounds")


def two_way_effects(
    rows: DataFrame,
    outcomes: Sequence[str],
    regressor: str,
    entity: str = "pid",
    period: str = "time_period",
    tolerance: float = 1e-10,
    max_rounds: int = 2000,
    max_periods: int = MAX_PERIODS,
) -> DataFrame:
    """Slope of each outcome on ``regressor`` with entity and period effects, standard errors clustered by entity.

    The panel may be unbalanced and hold several rows per entity and period. Rows with a null in any of
    the columns are left out; without rows the result is empty; a regressor that the effects explain
    wholly has null estimates. The factor is G/(G-1) * (N-1)/(N-T-1) with T periods.
    ``max_periods`` bounds what the driver holds and is an error beyond.
    """
    stored = durable(period_cells(rows, outcomes, regressor, entity, period))
    listed = [r["period"] for r in stored.select("period").distinct().orderBy("period").limit(max_periods + 1).collect()]
    if len(listed) > max_periods:
        raise ValueError(f"more than {max_periods} periods")
    schema = "outcome string, coef double, se double, t_value double, n_obs long, n_entities long, n_periods int, rounds int"
    if not listed:
        return rows.sparkSession.createDataFrame([], schema)
    entities = durable(entity_rows(stored, listed))
    gammas, rounds = period_effects(entities, 1 + len(outcomes), len(listed), tolerance, max_rounds)

    def product(k: int) -> Column:
        """Sum over an entity's rows of the freed regressor times variable k, before the entity's means come off."""
        gx, gy = _literal(gammas[0]), _literal(gammas[k])

        def cell(total: Column, c: Column) -> Column:
            ex, ey = F.get(gx, c["t"] - 1), F.get(gy, c["t"] - 1)
            return total + c["xv"][k] - ex * c["v"][k] - ey * c["v"][0] + c["n"] * ex * ey

        return F.aggregate("cells", F.lit(0.0), cell)

    spread = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["xv"][0])
    means = _entity_effects(gammas)
    freed = entities.select(
        "n", spread.alias("raw"), *[(product(k) - F.col("n") * means[0] * means[k]).alias(f"xy{k}") for k in range(len(means))]
    ).withColumnRenamed("xy0", "xx")
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"xy{k}").alias("xy")) for k, o in enumerate(outcomes, 1)])
    sums = freed.select("n", "xx", "raw", F.inline(cells)).groupBy("outcome").agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_entities"), F.sum("xx").alias("xx"), F.sum("raw").alias("raw"), F.sum("xy").alias("xy"),
        # the score of an entity is xy - coef * xx: its square is known from three sums
        F.sum(F.expr("xy * xy")).alias("m_yy"), F.sum(F.expr("xy * xx")).alias("m_yx"), F.sum(F.expr("xx * xx")).alias("m_xx"),
    )
    terms = len(listed)
    return (
        sums.withColumn("coef", F.expr("if(xx > 1e-9 * raw, xy / xx, null)"))
        .withColumn("factor", F.expr(f"try_divide(n_entities, n_entities - 1) * try_divide(n_obs - 1, n_obs - {terms} - 1)"))
        .withColumn("se", F.expr("if(coef is null, null, try_divide(sqrt(factor * greatest(m_yy - 2 * coef * m_yx + coef * coef * m_xx, 0D)), xx))"))
        .withColumns({"t_value": F.expr("try_divide(coef, se)"), "n_periods": F.lit(terms), "rounds": F.lit(rounds)})
        .select("outcome", "coef", "se", "t_value", "n_obs", "n_entities", "n_periods", "rounds")
    )
