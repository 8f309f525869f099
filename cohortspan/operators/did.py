"""Difference-in-differences: panel, totals, rates and two-way fixed effects.

All activities and all comparisons are computed together. The panel stays one
row per pathway and period with a column per activity; it becomes long only
after it has been reduced to patients or to groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.tails import t_p
from cohortspan.operators.periods import AFTER, WAITING, PeriodSpec, assign_periods, period_totals

CONTROL = "<= 18 weeks"
INTERVENTIONS = ("19-30 weeks", "31-42 weeks", "> 42 weeks")
MONTH_WEEKS = 4.3
PANEL_KEYS = ("pid", "tfc", "start_date", "group", "max_time_covered")


def binarise(activity: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Presence per day in place of counts, for the named activities only."""
    return activity.withColumns({m: F.when(F.col(m) > 0, 1).otherwise(0) for m in measures})


def whole_units(activity: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Costs rounded half up to whole units."""
    return activity.withColumns({c: F.round(c).cast("long") for c in costs})


def did_sample(
    pathways: DataFrame,
    spec: PeriodSpec,
    observed_until: Column,
    groups: Sequence[str] | None = (CONTROL, *INTERVENTIONS),
) -> DataFrame:
    """Pathways of the compared groups that were followed to the end."""
    chosen = pathways if groups is None else pathways.filter(F.col("group").isin(*groups))
    return assign_periods(chosen, spec, observed_until)


def did_panel(
    sample: DataFrame,
    activity: DataFrame,
    measures: Sequence[str],
    keep: Sequence[str] = PANEL_KEYS,
    control: str = CONTROL,
) -> DataFrame:
    """One row per pathway and period, a total per activity, treated 0/1."""
    totals = period_totals(sample, activity, measures, keep, (WAITING, AFTER))
    totals = totals.withColumn("period_days", F.datediff("hi", "lo") + 1).drop("lo", "hi")
    return totals.withColumn("treated", F.when(F.col("group") == control, 0).otherwise(1))


def long_panel(
    panel: DataFrame, measures: Sequence[str], keep: Sequence[str] = PANEL_KEYS, days: str = "max_time_covered", denominator: str = "covered"
) -> DataFrame:
    """Long form with total and weekly use per activity.

    ``denominator``: "covered" divides both periods by the whole follow-up, the column
    ``days``; "period" divides each by its own days, the column ``period_days``.
    """
    if denominator not in ("covered", "period"):
        raise ValueError(f"unknown denominator {denominator!r}")
    if denominator == "period":
        days = "period_days"
    cells = F.array(*[F.struct(F.lit(m).alias("activity"), F.col(m).alias("total_hc_use")) for m in measures])
    return panel.select(*dict.fromkeys([*keep, "time_period", "treated", days]), F.inline(cells)).withColumn(
        "avg_weekly_use", F.col("total_hc_use") / F.col(days).cast("double") * 7
    )


def _comparisons(group: str, control: str, interventions: Sequence[str]) -> Column:
    """Every comparison a row takes part in: all of them for controls."""
    every = F.array(*[F.lit(i) for i in interventions])
    return F.when(F.col(group) == control, every).otherwise(F.array(F.col(group)))


def did_totals(
    panel: DataFrame,
    measures: Sequence[str],
    control: str = CONTROL,
    interventions: Sequence[str] = INTERVENTIONS,
) -> DataFrame:
    """Use of both groups in both periods, excess, person-weeks and patients.

    The reference period (0) is the time after the wait, the intervention
    period (1) the wait itself.
    """
    # patients first, so that the distinct count adds up and each shuffle row is small
    patient = panel.groupBy("group", "time_period", "pid").agg(
        *[F.sum(m).alias(m) for m in measures], F.sum("max_time_covered").alias("days")
    )
    group = patient.groupBy("group", "time_period").agg(
        *[F.sum(m).alias(m) for m in measures], F.sum("days").alias("days"), F.count("*").alias("patients")
    )
    cells = F.array(*[F.struct(F.lit(m).alias("activity"), F.col(m).cast("double").alias("use")) for m in measures])
    long = group.select(
        "group", "time_period", "days", "patients", F.explode(_comparisons("group", control, interventions)).alias("comparison"), cells.alias("_c")
    ).select("group", "time_period", "days", "patients", "comparison", F.inline("_c"))
    is_control = F.col("group") == control

    def cell(value: str, of_control: bool, period: int) -> Column:
        side = is_control if of_control else ~is_control
        return F.max(F.when(side & (F.col("time_period") == period), F.col(value)))

    return (
        long.groupBy("activity", "comparison")
        .agg(
            cell("use", True, AFTER).alias("control_reference_use"),
            cell("use", True, WAITING).alias("control_intervention_use"),
            cell("use", False, AFTER).alias("treated_reference_use"),
            cell("use", False, WAITING).alias("treated_intervention_use"),
            (cell("days", True, AFTER) / 7).alias("control_person_weeks"),
            (cell("days", False, AFTER) / 7).alias("treated_person_weeks"),
            cell("patients", True, AFTER).alias("control_patients"),
            cell("patients", False, AFTER).alias("treated_patients"),
        )
        # a comparison needs both groups
        .filter(F.col("control_patients").isNotNull() & F.col("treated_patients").isNotNull())
        .withColumn(
            "control_excess", F.col("control_intervention_use") - F.col("control_reference_use")
        )
        .withColumn(
            "total_excess",
            F.col("treated_intervention_use") - F.col("treated_reference_use") - F.col("control_excess"),
        )
    )


def did_rates(totals: DataFrame) -> DataFrame:
    """:func:`did_totals` per person-week, and the excess per 100 patients and month."""
    out = totals
    for side in ("control", "treated"):
        for period in ("reference", "intervention"):
            c = f"{side}_{period}_use"
            out = out.withColumn(c, F.try_divide(F.col(c), F.col(f"{side}_person_weeks")))
    out = out.withColumn("control_excess", F.col("control_intervention_use") - F.col("control_reference_use"))
    out = out.withColumn(
        "total_excess", F.col("treated_intervention_use") - F.col("treated_reference_use") - F.col("control_excess")
    )
    return out.withColumn("excess_per_100_month", F.col("total_excess") * 100 * MONTH_WEEKS)


# cells of a comparison: (treated, period)
_CELLS = ("00", "01", "10", "11")
# within-entity cross products of d = treated x period, p = period and y
_WITHIN = {
    "dd": "nd - nd * nd / n",
    "dp": "nd - nd * np / n",
    "pp": "np - np * np / n",
    "dy": "s11 - nd * s / n",
    "py": "sp - np * s / n",
}


def entity_cells(
    panel: DataFrame,
    measures: Sequence[str],
    outcome: str = "avg_weekly_use",
    entity: str = "pid",
    control: str = CONTROL,
    interventions: Sequence[str] = INTERVENTIONS,
    centre: bool = False,
) -> DataFrame:
    """Per activity, comparison and entity: counts, days, use, sum and squares per cell.

    These are all that the totals, the within estimator and its standard errors
    need: no row-level window, no join of means back to rows.
    """
    y = "cast({m} as double) / max_time_covered * 7" if outcome == "avg_weekly_use" else "cast({m} as double)"
    if centre:
        # the entity effects absorb a constant; without it the squares keep their digits
        means = panel.agg(*[F.expr(f"coalesce(avg({y.format(m=m)}), 0) as `{m}`") for m in measures]).first()
        y = {m: f"({y.format(m=m)} - {means[m]!r}D)" for m in measures}
    else:
        y = {m: y.format(m=m) for m in measures}
    reduced = panel.groupBy(entity, "group", "time_period").agg(
        F.expr("count(*) as n"),
        F.expr("sum(max_time_covered) as days"),
        *[F.expr(f"sum({m}) as u_{m}") for m in measures],
        *[F.expr(f"sum({y[m]}) as s_{m}") for m in measures],
        *[F.expr(f"sum(pow({y[m]}, 2)) as q_{m}") for m in measures],
    )
    cells = ", ".join(f"named_struct('activity', '{m}', 'u', u_{m}, 's', s_{m}, 'q', q_{m})" for m in measures)
    # dealt out by entity before it grows by activity and comparison: the long rows of an
    # entity are made and added up in one place, and only sums of models move after that
    long = reduced.withColumnRenamed(entity, "entity").repartition("entity").select(
        "entity",
        F.when(F.col("group") == control, "0").otherwise("1").alias("treated"),
        "time_period",
        "n",
        "days",
        F.explode(_comparisons("group", control, interventions)).alias("comparison"),
        F.expr(f"array({cells}) as _c"),
    ).selectExpr("entity", "concat(treated, time_period) as cell", "n", "days", "comparison", "inline(_c)")
    return long.groupBy("activity", "comparison", "entity").agg(
        *[F.expr(f"sum(if(cell = '{c}', {v}, 0)) as {v}{c}") for v in ("n", "days", "u", "s", "q") for c in _CELLS]
    )


def _model_sums(cells: DataFrame) -> DataFrame:
    """Totals, normal equations and score products per activity and comparison, in one pass."""
    # counts as doubles: their products may pass the range of a long
    entities = cells.selectExpr(
        "*",
        "cast(n00 + n01 + n10 + n11 as double) as n",
        "cast(n01 + n11 as double) as np",
        "cast(n11 as double) as nd",
        "s00 + s01 + s10 + s11 as s",
        "q00 + q01 + q10 + q11 as q",
        "s01 + s11 as sp",
    ).selectExpr("*", "q - s * s / n as yy", *[f"{expr} as {name}" for name, expr in _WITHIN.items()])
    names = list(_WITHIN)
    products = [(a, c) for i, a in enumerate(names) for c in names[i:]]
    return entities.groupBy("activity", "comparison").agg(
        F.expr("cast(sum(n) as bigint) as n_obs"),
        F.expr("count(*) as n_entities"),
        F.expr("sum(yy) as t_yy"),
        *[F.expr(f"sum({name}) as t_{name}") for name in names],
        *[F.expr(f"sum({a} * {c}) as m_{a}_{c}") for a, c in products],
        *[F.expr(f"sum({v}{c}) as {v}{c}") for v in ("u", "days") for c in _CELLS],
        F.expr("count_if(n00 > 0) as control_patients"),
        F.expr("count_if(n10 > 0) as treated_patients"),
        F.expr("count_if(n01 > 0) as control_waiting"),
        F.expr("count_if(n11 > 0) as treated_waiting"),
    ).filter("control_patients + control_waiting > 0 AND treated_patients + treated_waiting > 0")


def _estimate(sums: DataFrame) -> DataFrame:
    """Coefficient of d after partialling out p; ``slope`` takes p out of d."""
    return (
        sums.withColumn("coef", F.expr("try_divide(t_dy * t_pp - t_py * t_dp, t_dd * t_pp - t_dp * t_dp)"))
        .withColumn("period_effect", F.expr("try_divide(t_py - coef * t_dp, t_pp)"))
        .withColumn("slope", F.expr("try_divide(t_dp, t_pp)"))
        .withColumn("d_d", F.expr("t_dd - slope * t_dp"))
    )


def _clustered(model: DataFrame) -> DataFrame:
    """Meat of the clustered variance.

    The score of an entity is linear in its cross products, with weights that
    are known once the model is solved, so its square sums up from products.
    """
    weights = {
        "dy": "1",
        "dd": "-coef",
        "dp": "(slope * coef - period_effect)",
        "py": "-slope",
        "pp": "(slope * period_effect)",
    }
    names = list(_WITHIN)
    terms = [
        f"{1 if a == c else 2} * {weights[a]} * {weights[c]} * m_{a}_{c}" for i, a in enumerate(names) for c in names[i:]
    ]
    return model.withColumns(
        {
            "meat": F.expr(" + ".join(terms)),
            "factor": F.expr("try_divide(n_entities, n_entities - 1) * try_divide(n_obs - 1, n_obs - 3)"),
            "dof": F.expr("cast(n_entities - 1 as double)"),
        }
    )


def _robust(model: DataFrame, cells: DataFrame) -> DataFrame:
    """Meat of the heteroscedasticity-robust variance, a second pass over the cells."""
    # one row per activity and comparison on the small side
    solved = F.broadcast(model.select("activity", "comparison", "coef", "period_effect", "slope"))
    rows = cells.join(solved, ["activity", "comparison"]).selectExpr(
        "*",
        "cast(n00 + n01 + n10 + n11 as double) as n",
        "cast(n01 + n11 as double) as np",
        "cast(n11 as double) as nd",
        "s00 + s01 + s10 + s11 as s",
    )
    parts = []
    for cell in _CELLS:
        t, p = int(cell[0]), int(cell[1])
        d_in, p_in = f"({t * p} - nd / n)", f"({p} - np / n)"
        centre = f"(s / n + coef * {d_in} + period_effect * {p_in})"
        parts.append(
            f"pow({d_in} - slope * {p_in}, 2) * (q{cell} - 2 * {centre} * s{cell} + n{cell} * pow({centre}, 2))"
        )
    meat = rows.groupBy("activity", "comparison").agg(F.expr(f"sum({' + '.join(parts)}) as meat"))
    return model.join(F.broadcast(meat), ["activity", "comparison"]).withColumns(
        {
            "factor": F.expr("try_divide(n_obs, n_obs - n_entities - 2)"),
            "dof": F.expr("cast(n_obs - n_entities - 2 as double)"),
        }
    )


def _solve(cells: DataFrame, vcov: str) -> DataFrame:
    if vcov not in ("iid", "HC1", "CRV1"):
        raise ValueError(f"unknown vcov {vcov!r}")
    model = _estimate(_model_sums(cells))
    if vcov == "iid":
        rss = "t_yy - coef * t_dy - period_effect * t_py"
        fitted = model.withColumn("dof", F.expr("cast(n_obs - n_entities - 2 as double)")).withColumn(
            "variance", F.expr(f"try_divide(if({rss} >= 0, {rss}, null), dof) / d_d")
        )
    else:
        fitted = _clustered(model) if vcov == "CRV1" else _robust(model, cells)
        fitted = fitted.withColumn("variance", F.expr("factor * if(meat >= 0, meat, null) / (d_d * d_d)"))
    return (
        fitted.withColumn("se", F.sqrt("variance"))
        .withColumn("t_value", F.expr("try_divide(coef, se)"))
        .withColumns({"ci_low": F.expr("coef - 1.96 * se"), "ci_high": F.expr("coef + 1.96 * se")})
    )


_ESTIMATE = ("coef", "se", "t_value", "dof", "n_obs", "n_entities", "ci_low", "ci_high")


def did_twfe(
    panel: DataFrame,
    measures: Sequence[str],
    outcome: str = "avg_weekly_use",
    entity: str = "pid",
    vcov: str = "CRV1",
    control: str = CONTROL,
    interventions: Sequence[str] = INTERVENTIONS,
) -> DataFrame:
    """Two-way fixed effects: outcome on treated x period, entity and period effects.

    ``vcov``: "iid", "HC1" or "CRV1" (clustered by entity). Small-sample factors:
    iid sigma^2 with N - G - 2 degrees; HC1 N / (N - G - 2); CRV1
    G/(G-1) * (N-1)/(N-3), the entity effects being nested in the clusters.
    """
    cells = entity_cells(panel, measures, outcome, entity, control, interventions, centre=vcov != "CRV1")
    return _solve(cells, vcov).select("activity", "comparison", *_ESTIMATE)


_TOTALS = {
    "control_reference_use": "cast(u00 as double)",
    "control_intervention_use": "cast(u01 as double)",
    "treated_reference_use": "cast(u10 as double)",
    "treated_intervention_use": "cast(u11 as double)",
    "control_person_weeks": "days00 / 7",
    "treated_person_weeks": "days10 / 7",
}


def did_results(
    panel: DataFrame,
    measures: Sequence[str],
    outcome: str = "total_hc_use",
    vcov: str = "CRV1",
    p_values: bool = True,
    control: str = CONTROL,
    interventions: Sequence[str] = INTERVENTIONS,
) -> DataFrame:
    """One row per activity and comparison: totals (or rates), estimate, standard error, p-value.

    Patients are the entities, so totals and estimates share one aggregation.
    """
    solved = _solve(entity_cells(panel, measures, outcome, "pid", control, interventions), vcov)
    table = solved.selectExpr(
        "activity", "comparison", "control_patients", "treated_patients", *[f"{e} as {n}" for n, e in _TOTALS.items()], *_ESTIMATE
    ).withColumn("control_excess", F.expr("control_intervention_use - control_reference_use"))
    table = table.withColumn("total_excess", F.expr("treated_intervention_use - treated_reference_use - control_excess"))
    if outcome == "avg_weekly_use":
        table = did_rates(table)
    return table.withColumn("p_value", t_p("t_value", "dof")) if p_values else table


def result_matrix(results: DataFrame, value: str, columns: Sequence[str] = INTERVENTIONS) -> DataFrame:
    """Activities by comparison."""
    return results.groupBy("activity").pivot("comparison", list(columns)).agg(F.avg(value))


def did_ols_panel(
    sample: DataFrame,
    activity: DataFrame,
    measures: Sequence[str],
    covariates: Sequence[str],
    divisors: tuple[float, float],
    grain: Sequence[str] = ("pid",),
    control: str = CONTROL,
) -> DataFrame:
    """Long regression panel: weekly use per unit, period and covariates.

    ``divisors`` are the days of period 0 and period 1; ``grain`` names the unit.
    """
    keep = list(dict.fromkeys([*grain, "group", *covariates]))
    rows = period_totals(sample, activity, measures, list(dict.fromkeys(["pid", *keep])), (0, 1))
    reduced = rows.groupBy(*keep, "time_period").agg(*[F.sum(m).alias(m) for m in measures])
    cells = F.array(*[F.struct(F.lit(m).alias("activity"), F.col(m).alias("total_hc_use")) for m in measures])
    days = F.when(F.col("time_period") == 0, float(divisors[0])).otherwise(float(divisors[1]))
    return reduced.select(*keep, "time_period", F.inline(cells)).withColumns(
        {
            "treated": F.when(F.col("group") == control, 0).otherwise(1),
            "avg_weekly_use": F.col("total_hc_use") / days * 7,
        }
    )


def excess_usage(panel: DataFrame, measures: Sequence[str], control: str = CONTROL, interventions: Sequence[str] = INTERVENTIONS) -> DataFrame:
    """Waiting difference minus after difference between intervention and control."""
    totals = did_totals(panel, measures, control, interventions)
    return totals.select(
        "activity",
        "comparison",
        (F.col("treated_reference_use") - F.col("control_reference_use")).alias("after_difference"),
        (F.col("treated_intervention_use") - F.col("control_intervention_use")).alias("waiting_difference"),
        F.col("total_excess").alias("excess_usage"),
    )


def placebo_panel(sample: DataFrame, activity: DataFrame, measures: Sequence[str], control: str = CONTROL) -> DataFrame:
    """Use per patient in the two halves of the after period."""
    keep = ("pid", "group", "max_time_covered")
    rows = period_totals(sample, activity, measures, keep, (0, 1))
    return (
        rows.groupBy(*keep, F.col("time_period").alias("placebo_period"))
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("treated", F.when(F.col("group") == control, 0).otherwise(1))
    )
