"""Propensity scores and nearest-neighbour matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.functions.bands import null_to_unknown
from cohortspan.operators.ordered import BROADCAST_VALUES, dealt_in_order, join_values, ranks, running_count, with_ranges
from cohortspan.operators.tables import unpivot_variables
from cohortspan.session import durable


def _numbered_levels(named: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """(variable, level, number, levels): numbers from 0, most frequent first, then by name."""
    counts = unpivot_variables(named, covariates).groupBy("variable", "value").agg((-F.count("*")).alias("_minus"))
    numbered = ranks(dealt_in_order(counts, ["variable", "_minus", "value"]), ["variable"], ["_minus", "value"], "_rank")
    sizes = counts.groupBy("variable").agg(F.count("*").alias("levels"))
    return numbered.join(F.broadcast(sizes), "variable").select("variable", F.col("value").alias("level"), (F.col("_rank") - 1).alias("number"), "levels")


def _logistic(cells: DataFrame, p: int, tolerance: float, rounds: int) -> np.ndarray:
    """Coefficients of a weighted logistic model by Newton steps.

    ``cells`` has ``x``, an array of (column, value) of the columns that are not 0, the number ``w``
    of rows and ``k`` of them with the outcome. Each step is one job that adds up the likelihood, its
    gradient and the information over the cells; a step that lowers the likelihood is halved. With
    separated outcomes there is no finite maximum: the steps end when the likelihood has settled.
    """

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        weights = F.array(*[F.lit(float(b)) for b in beta])
        eta = F.aggregate("x", F.lit(0.0), lambda total, e: total + e["value"] * F.element_at(weights, e["column"] + 1))
        value = F.col("k") * F.col("eta") - F.col("w") * (F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))))
        rows = cells.withColumn("eta", eta).withColumn("mu", 1 / (1 + F.exp(-F.col("eta"))))
        entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
        spread = F.col("w") * F.col("mu") * (1 - F.col("mu"))
        alone = F.array(entry(F.lit(-1), F.lit(-1), value))
        gradient = F.transform("x", lambda e: entry(e["column"], F.lit(-1), e["value"] * (F.col("k") - F.col("w") * F.col("mu"))))
        information = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: entry(a["column"], b["column"], a["value"] * b["value"] * spread))))
        found = rows.select(F.inline(F.concat(alone, gradient, information))).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        first, second = np.zeros(p), np.zeros((p, p))
        total = 0.0
        for i, j, v in found:
            if i < 0:
                total = v
            elif j < 0:
                first[i] = v
            else:
                second[i, j] = v
        return total, first, second

    beta = np.zeros(p)
    value, gradient, information = sums(beta)
    for _ in range(rounds):
        # scaled to a unit diagonal, so that columns of large numbers do not hide the others
        scale = 1 / np.sqrt(np.maximum(np.diag(information), 1e-300))
        step = scale * np.linalg.lstsq(information * scale[:, None] * scale, gradient * scale, rcond=1e-12)[0]
        new = sums(beta + step)
        while not new[0] >= value - 1e-12 * abs(value):
            step = step / 2
            if not np.any(np.abs(step) > 1e-12):
                return beta
            new = sums(beta + step)
        gain = new[0] - value
        beta, (value, gradient, information) = beta + step, new
        if gain <= tolerance * abs(value):
            return beta
    return beta


def propensity(
    df: DataFrame,
    treated: str,
    covariates: Sequence[str],
    one_hot: bool = False,
    name: str = "propensity_score",
    max_columns: int = 1000,
    tolerance: float = 1e-14,
    rounds: int = 100,
) -> DataFrame:
    """Logistic probability of treatment from categorical covariates, any number of levels.

    Levels are numbered by frequency (then by name) on the executors, and their numbers enter as
    they are, unless ``one_hot`` gives each level but a covariate's last a column of its own; then
    the model has at most ``max_columns`` columns, and more are refused. The model is fitted on
    counted covariate cells, so a step costs a pass over cells, not over rows, and only sums by
    column reach the driver. Cells are scored and joined back. Rows with a null treatment are
    scored but not fitted; null covariates are "unknown".
    """
    named = df.withColumns({c: null_to_unknown(c) for c in covariates})
    levels = durable(_numbered_levels(named, covariates))
    counted = named.groupBy(*covariates).agg(F.count(treated).cast("double").alias("_w"), F.coalesce(F.sum(F.col(treated).cast("double")), F.lit(0.0)).alias("_k"))
    columns, p = [], 1
    if one_hot:
        sizes = {r["variable"]: r["levels"] for r in levels.select("variable", "levels").distinct().collect()}
        if 1 + sum(n - 1 for n in sizes.values()) > max_columns:
            raise ValueError(f"more than {max_columns} columns: {sizes}")
    cells = counted
    size = levels.count()
    for i, c in enumerate(covariates):
        numbers = levels.filter(F.col("variable") == c).select(F.col("level").alias(c), F.col("number").alias(f"_n{i}"))
        cells = join_values(cells, numbers, c, size)
        if one_hot:
            shown = F.array(F.struct((F.col(f"_n{i}") + p).cast("int").alias("column"), F.lit(1.0).alias("value")))
            columns.append(F.when(F.col(f"_n{i}") < sizes.get(c, 1) - 1, shown).otherwise(F.array_remove(shown, shown[0])))
            p += sizes.get(c, 1) - 1
        else:
            columns.append(F.array(F.struct(F.lit(p).alias("column"), F.col(f"_n{i}").cast("double").alias("value"))))
            p += 1
    x = F.concat(F.array(F.struct(F.lit(0).alias("column"), F.lit(1.0).alias("value"))), *columns)
    cells = durable(cells.select(*covariates, "_w", "_k", x.alias("_x")))
    beta = _logistic(cells.filter("_w > 0").select(F.col("_x").alias("x"), F.col("_w").alias("w"), F.col("_k").alias("k")), p, tolerance, rounds)
    weights = F.array(*[F.lit(float(b)) for b in beta])
    eta = F.aggregate("_x", F.lit(0.0), lambda total, e: total + e["value"] * F.element_at(weights, e["column"] + 1))
    scores = cells.select(*[F.col(c).alias(f"_cell_{c}") for c in covariates], (1 / (1 + F.exp(-eta))).alias(name))
    if cells.count() <= BROADCAST_VALUES:
        scores = F.broadcast(scores)
    rows = df.withColumns({f"_cell_{c}": null_to_unknown(c) for c in covariates})
    return rows.join(scores, [f"_cell_{c}" for c in covariates]).select(*df.columns, name)


def nearest_match(
    scored: DataFrame,
    score: str = "propensity_score",
    treated: str = "treated",
    patient: str = "pid",
    caliper: float | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """For each control patient the treated patient with the closest score.

    Treated patients may serve several controls. Equal distances go to the
    smallest patient number. Scores are matched as distinct values along the
    number line: the nearest treated score is either the last one at or below
    or the first one above, so no pairs are formed. Null and NaN scores match nothing.
    """
    flag = F.col(treated) == 1
    values = durable(
        scored.filter(F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(F.col(score).alias("_score"))
        .agg(F.min(F.when(flag, F.col(patient))).alias("_treated"), F.max((~flag).cast("int")).alias("_control"))
    )
    entry = F.when(F.col("_treated").isNotNull(), F.struct("_score", "_treated"))
    cut = with_ranges(values, "_score", ranges)
    ordered = Window.partitionBy("_range").orderBy("_score")
    sought = {
        "_below": F.last(entry, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "_above": F.first(entry, ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing)),
    }
    # nearest treated score of the ranges before and after: one row per range
    ends = cut.groupBy("_range").agg(F.max(entry).alias("_high"), F.min(entry).alias("_low"))
    whole = Window.partitionBy(F.lit(1)).orderBy("_range")
    carried = ends.select(
        "_range",
        F.last("_high", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_low", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    found = (
        cut.withColumns(sought)
        .filter(F.col("_control") == 1)
        .join(F.broadcast(carried), "_range")
        .withColumns({"_below": F.coalesce("_below", "_before"), "_above": F.coalesce("_above", "_after")})
    )

    def candidate(column: str):
        distance = F.abs(F.col("_score") - F.col(f"{column}._score"))
        return F.when(
            F.col(column).isNotNull(), F.struct(distance.alias("distance"), F.col(f"{column}._treated").alias("match"))
        )

    neighbours = found.select(
        "_score", F.array_min(F.array_compact(F.array(candidate("_below"), candidate("_above")))).alias("_best")
    )
    controls = (
        scored.filter(~flag & F.col(score).isNotNull() & ~F.isnan(score))
        .select(F.col(patient).alias("control_pid"), F.col(score).alias("_score"))
        .distinct()
    )
    best = (
        join_values(controls, neighbours, "_score")
        .groupBy("control_pid")
        .agg(F.min("_best").alias("_best"))
        .filter(F.col("_best").isNotNull())
        .select("control_pid", F.col("_best.match").alias("treated_pid"), F.col("_best.distance").alias("score_diff"))
    )
    return best if caliper is None else best.filter(F.col("score_diff") <= caliper)


def one_to_one_match(
    scored: DataFrame,
    score: str = "propensity_score",
    treated: str = "treated",
    patient: str = "pid",
    caliper: float | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Pairs of a control and a treated patient, each patient in one pair at most.

    Patients of one score pair first, in the order of their numbers. The rest is paired on the way
    up the scores: each patient takes the open patient of the other group met last, or stays open.
    As many pairs as possible come about, and with groups of one size the sum of their distances is
    the least possible. A ``caliper`` leaves out the pairs further apart.

    The walk is never made: the running difference of the groups' counts says between which two
    levels a patient stands, and partners are neighbours on the same step between levels. Ranges of
    the scores pair within themselves; each leaves at most one open patient a step and carries it on.

    A patient with treated rows counts as treated, and of several scores the smallest counts. Null
    and NaN scores match nothing.
    """
    units = (
        scored.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(patient).isNotNull())
        .groupBy(F.col(patient).alias("_pid"))
        .agg(F.min(score).alias("_score"), F.max((F.col(treated) == 1).cast("int")).alias("_treated"))
        .withColumn("_treated", F.coalesce("_treated", F.lit(0)))
    )
    dealt = dealt_in_order(units, ["_score", "_treated", "_pid"])
    ranked = durable(ranks(dealt, ["_score", "_treated"], ["_pid"], "_rank"))
    counts = ranked.groupBy("_score").agg(F.count_if(F.col("_treated") == 0).alias("_c"), F.count_if(F.col("_treated") == 1).alias("_t"))
    counts = durable(counts.withColumns({"_pairs": F.least("_c", "_t"), "_rest": F.col("_c") - F.col("_t")}))
    levels = durable(running_count(counts, "_score", "_rest", ranges, "_level").select("_score", "_pairs", "_level"))
    placed = join_values(ranked, levels, "_score", levels.count())

    equal = placed.filter(F.col("_rank") <= F.col("_pairs"))
    pid = lambda side: F.max(F.when(F.col("_treated") == side, F.col("_pid")))
    pairs = equal.groupBy("_score", "_rank").agg(pid(0).alias("control_pid"), pid(1).alias("treated_pid"))
    pairs = pairs.select("control_pid", "treated_pid", F.lit(0.0).alias("score_diff"))

    # the k-th left at a score goes from level to level: up for controls, down for treated
    k = F.col("_rank") - F.col("_pairs")
    step = F.when(F.col("_treated") == 0, F.col("_level") + k - 1).otherwise(F.col("_level") - k)
    left = placed.filter(F.col("_rank") > F.col("_pairs")).withColumn("_step", step)
    # above level 0 controls open a pair, below it treated do
    opens = (F.col("_treated") == 0) == (F.col("_step") >= 0)
    unit = F.struct("_score", "_treated", "_pid")

    def partners(rows: DataFrame, *cut: str) -> DataFrame:
        walk = Window.partitionBy("_step", *cut).orderBy("_score")
        return rows.withColumns({"_opens": opens, "_before": F.lag(unit).over(walk), "_after": F.lead(unit).over(walk)})

    inside = durable(partners(left, "_range"))
    carried = inside.filter(F.when(F.col("_opens"), F.col("_after").isNull()).otherwise(F.col("_before").isNull()))
    met = inside.unionByName(partners(carried.drop("_opens", "_before", "_after"))).filter(~F.col("_opens") & F.col("_before").isNotNull())
    is_control = F.col("_treated") == 0
    walked = met.select(
        F.when(is_control, F.col("_pid")).otherwise(F.col("_before._pid")).alias("control_pid"),
        F.when(is_control, F.col("_before._pid")).otherwise(F.col("_pid")).alias("treated_pid"),
        (F.col("_score") - F.col("_before._score")).cast("double").alias("score_diff"),
    )
    found = pairs.unionByName(walked)
    return found if caliper is None else found.filter(F.col("score_diff") <= caliper)


def matched_cohort(df: DataFrame, matches: DataFrame, patient: str = "pid") -> DataFrame:
    """Rows of all matched patients, treated and control."""
    ids = matches.select(F.explode(F.array("control_pid", "treated_pid")).alias(patient)).distinct()
    return df.join(ids, patient, "left_semi")
