"""Survival curves, log-rank test and proportional hazards.

Rows are first counted per group and day. What follows works on that table,
whose size is bounded by the calendar and not by the number of pathways.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions.bands import null_to_unknown
from cohortspan.functions.tails import chi2_p, normal_two_sided
from cohortspan.session import durable


_Z = 1.959963984540054


def _whole(df: DataFrame, time: str) -> None:
    """The calendar bounds the risk table only if times are whole numbers."""
    if not isinstance(df.schema[time].dataType, T.IntegralType):
        raise ValueError(f"{time!r} must be a whole number of days")


def risk_table(df: DataFrame, time: str, event: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per group and time: events, censored, and the number at risk.

    Times are whole units (days), so a group has at most one row per unit of the calendar.
    """
    _whole(df, time)
    counted = (
        df.filter(F.col(time).isNotNull())
        .groupBy(*groups, F.col(time).alias("time"))
        .agg(F.count("*").alias("removed"), F.sum(F.col(event).cast("long")).alias("events"))
    )
    keys = list(groups) or [F.lit(1)]
    later = Window.partitionBy(*keys).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("at_risk", F.sum("removed").over(later))


def kaplan_meier(df: DataFrame, time: str, event: str, groups: Sequence[str] = ()) -> DataFrame:
    """Product-limit survival after each observed time, with a 95 % interval.

    ``std_error`` is Greenwood's; the interval is that of log(-log S), which stays between 0
    and 1, and is null where the curve is at 1 or 0.
    """
    risk = risk_table(df, time, event, groups)
    keys = list(groups) or [F.lit(1)]
    upto = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    all_gone = F.col("events") == F.col("at_risk")
    step = F.when(all_gone, 0.0).otherwise(F.log1p(-F.col("events") / F.col("at_risk")))
    left = F.col("at_risk") - F.col("events")
    part = F.when(~all_gone, F.col("events") / (F.col("at_risk").cast("double") * left))
    curve = risk.withColumns(
        {
            "survival": F.when(F.max(all_gone.cast("int")).over(upto) == 1, 0.0).otherwise(F.exp(F.sum(step).over(upto))),
            "_greenwood": F.sum(part).over(upto),
        }
    )
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    spread = F.when(inside, _Z * F.sqrt("_greenwood") / F.log("survival"))
    return curve.withColumns(
        {
            "std_error": F.when(F.col("survival") > 0, F.col("survival") * F.sqrt("_greenwood")),
            "ci_low": F.pow("survival", F.exp(-spread)),
            "ci_high": F.pow("survival", F.exp(spread)),
        }
    ).drop("_greenwood")


def median_survival(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """First time at which the curve is at or below one half; null if it stays above."""
    return curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, group: str, pair: tuple[str, str], p_values: bool = True) -> DataFrame:
    """Two-sample log-rank test of the first against the second group."""
    _whole(df, time)
    first, second = pair
    chosen = df.filter(F.col(group).isin(first, second) & F.col(time).isNotNull())
    is_first = F.col(group) == first
    counted = chosen.groupBy(F.col(time).alias("time")).agg(
        F.count("*").alias("n"),
        F.count_if(is_first).alias("n1"),
        F.sum(F.col(event).cast("long")).alias("d"),
        F.sum(F.when(is_first, F.col(event)).otherwise(0).cast("long")).alias("d1"),
    )
    # one row per day
    later = Window.partitionBy(F.lit(1)).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at_risk = counted.withColumns({"n": F.sum("n").over(later).cast("double"), "n1": F.sum("n1").over(later).cast("double")})
    expected = F.col("d") * F.col("n1") / F.col("n")
    variance = F.when(
        F.col("n") > 1,
        F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1),
    ).otherwise(0.0)
    out = (
        at_risk.filter(F.col("d") > 0)
        .agg(F.sum("d1").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
        .withColumn("statistic", F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("variance")))
        .withColumn("dof", F.lit(1))
    )
    return out.withColumn("p_value", chi2_p("statistic", "dof")) if p_values else out


_DIRECT = 32


def _harmonic(top: np.ndarray, count: np.ndarray, power: int) -> np.ndarray:
    """Sum of 1 / (top - j)^power for j = 0 .. count - 1, at any count.

    The smallest denominators are added one by one; the others, all above them,
    follow from the midpoint form of the integral with its first corrections.
    """
    direct = np.minimum(count, _DIRECT)
    j = np.arange(_DIRECT)
    small = (top - count + 1)[:, None] + j
    out = np.where(j < direct[:, None], np.where(j < direct[:, None], small, 1.0) ** -float(power), 0.0).sum(axis=1)
    rest = count - direct
    lo = np.where(rest > 0, top - count + 0.5 + direct, 1.0)
    hi = lo + rest
    if power == 1:
        return out + np.log1p(rest / lo) - (lo**-2 - hi**-2) / 24 + 7 * (lo**-4 - hi**-4) / 960 - 31 * (lo**-6 - hi**-6) / 8064
    return out + rest / (lo * hi) - (lo**-3 - hi**-3) / 12 + 7 * (lo**-5 - hi**-5) / 240 - 31 * (lo**-7 - hi**-7) / 1344


def _efron_terms(table: pd.DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log, gradient and information of the partial likelihood over risk-table rows."""
    levels = len(beta) + 1
    weight = np.exp(np.concatenate([[0.0], beta]))
    risk = table[[f"n{i}" for i in range(levels)]].to_numpy(float) * weight
    dead_counts = table[[f"d{i}" for i in range(levels)]].to_numpy(float)
    dead = dead_counts * weight
    d = dead_counts.sum(axis=1)
    s0, d0 = risk.sum(axis=1), dead.sum(axis=1)
    # tie j: phi_j = s0 - (j / d) d0, z_j = risk - (j / d) dead; with
    # top = s0 d / d0 the weights 1 / phi_j are (d / d0) / (top - j)
    top, ratio = s0 * d / d0, d / d0
    h1, h2 = _harmonic(top, d, 1), _harmonic(top, d, 2)
    inverse, inverse2 = ratio * h1, ratio**2 * h2
    # j / d = (top - (top - j)) / d turns the sums with j into the same two
    j_inverse = ratio * (top * h1 - d) / d
    j_inverse2 = ratio**2 * (top * h2 - h1) / d
    jj_inverse2 = ratio**2 * (top**2 * h2 - 2 * top * h1 + d) / d**2
    r, e = risk[:, 1:], dead[:, 1:]
    gradient = (dead_counts[:, 1:] - r * inverse[:, None] + e * j_inverse[:, None]).sum(axis=0)
    diagonal = np.diag((r * inverse[:, None] - e * j_inverse[:, None]).sum(axis=0))
    cross = (r * inverse2[:, None]).T @ r - (r * j_inverse2[:, None]).T @ e
    cross += -(e * j_inverse2[:, None]).T @ r + (e * jj_inverse2[:, None]).T @ e
    # the product of all phi_j of a time is (d0 / d)^d times a falling factorial
    falling = [math.lgamma(t + 1) - math.lgamma(t - n + 1) for t, n in zip(top.tolist(), d.tolist())]
    value = float((dead_counts[:, 1:] @ beta - d * np.log(d0 / d) - falling).sum())
    return value, gradient, diagonal - cross


@dataclass(frozen=True)
class CoxFit:
    """A fitted model: levels with events, estimates of all but the first, and the risk table."""

    kept: list[str]
    beta: np.ndarray
    information: np.ndarray
    null: float  # log partial likelihood without the factor
    value: float
    table: DataFrame  # per event time, n0 .. at risk and d0 .. events by level


def _cox_fit(df: DataFrame, time: str, event: str, factor: str, levels: Sequence[str], tolerance: float, rounds: int) -> CoxFit:
    _whole(df, time)
    label = null_to_unknown(factor)
    found = df.filter(label.isin(*levels) & F.col(time).isNotNull()).groupBy(label.alias("level")).agg(F.sum(F.col(event).cast("long")).alias("events")).collect()
    events = {r["level"]: r["events"] or 0 for r in found}
    if not events.get(levels[0]):
        raise ValueError(f"the reference {levels[0]!r} has no events")
    kept = [level for level in levels if events.get(level)]
    chosen = df.filter(label.isin(*kept) & F.col(time).isNotNull())
    counted = chosen.groupBy(F.col(time).alias("time")).agg(
        *[F.count_if(label == level).alias(f"n{i}") for i, level in enumerate(kept)],
        *[
            F.sum(F.when(label == level, F.col(event).cast("long")).otherwise(0)).alias(f"d{i}")
            for i, level in enumerate(kept)
        ],
    )
    later = Window.partitionBy(F.lit(1)).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    died = " + ".join(f"d{i}" for i in range(len(kept)))
    table = durable(
        counted.withColumns({f"n{i}": F.sum(f"n{i}").over(later) for i in range(len(kept))}).filter(f"{died} > 0")
    )
    p = len(kept) - 1
    beta = np.zeros(p)

    def newton_sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def partial(batches):
            for batch in batches:
                if len(batch):
                    value, gradient, information = _efron_terms(batch, at)
                    values = np.concatenate([[value], gradient, information.ravel()])
                    yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        rows = table.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(1 + p + p * p)
        for row in rows:
            flat[row["i"]] = row["v"]
        return flat[0], flat[1:1 + p], flat[1 + p:].reshape(p, p)

    value, gradient, information = newton_sums(beta)
    null = value
    for _ in range(rounds if p else 0):
        step = np.linalg.lstsq(information, gradient, rcond=None)[0]
        # settled before the last digits of the sums decide
        small = np.max(np.abs(step)) < tolerance
        new = newton_sums(beta + step)
        while not small and not new[0] >= value - 1e-9 * abs(value):
            step = step / 2
            new = newton_sums(beta + step)
        beta, (value, gradient, information) = beta + step, new
        if small:
            break
    else:
        if p:
            raise ArithmeticError("the partial likelihood did not converge")
    return CoxFit(kept, beta, information, null, value, table)


def cox_ph(
    df: DataFrame, time: str, event: str, factor: str, levels: Sequence[str], tolerance: float = 1e-9, rounds: int = 50
) -> DataFrame:
    """Proportional hazards for one factor, Efron ties; the first level is the reference.

    The risk table has one row per event time and is checkpointed. Each Newton
    step is a Spark job over it; only the likelihood, its gradient and the information
    matrix of (levels - 1) entries come back. A step that lowers the likelihood is halved.

    A level without events has no finite estimate, and in the limit its rows leave the
    estimates of the others alone: it is listed as dropped and its rows are left out. The
    reference must have events.
    """
    fit = _cox_fit(df, time, event, factor, levels, tolerance, rounds)
    se = np.sqrt(np.diag(np.linalg.pinv(fit.information)))
    estimates = {
        level: (float(b), float(math.exp(b)), float(s), float(b / s), normal_two_sided(b / s), float(math.exp(b - 1.96 * s)), float(math.exp(b + 1.96 * s)), False)
        for level, b, s in zip(fit.kept[1:], fit.beta, se)
    }
    rows = [(level, *estimates.get(level, (None,) * 7 + (True,))) for level in list(levels)[1:]]
    schema = "level string, coef double, hazard_ratio double, se double, z double, p_value double, hr_low double, hr_high double, dropped boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def cox_summary(
    df: DataFrame, time: str, event: str, factor: str, levels: Sequence[str], tolerance: float = 1e-9, rounds: int = 50, p_values: bool = True
) -> DataFrame:
    """One row on a proportional-hazards model: likelihood-ratio test and Harrell's concordance.

    ``log_likelihood`` and ``null_log_likelihood`` (without the factor) are partial ones with Efron
    ties; ``lr_statistic`` is twice their difference on ``dof`` degrees of freedom.

    A pair of rows can be compared if one has its event while the other is still at risk and does
    not have its own at the same time. ``concordant`` counts the pairs in which the one with the
    event has the higher estimated hazard, ``tied`` those with equal ones, and ``concordance`` is
    (concordant + tied / 2) / pairs, null without pairs. No pair is formed: at each event time the
    events of a level meet the rows of every level that go on, so counts of the risk table are
    multiplied and added up. Rows of levels that ``cox_ph`` drops take no part.
    """
    fit = _cox_fit(df, time, event, factor, levels, tolerance, rounds)
    beta = [0.0, *fit.beta.tolist()]

    def counted(chosen: Callable[[float, float], bool]) -> Column:
        terms = [F.col(f"d{i}") * (F.col(f"n{j}") - F.col(f"d{j}")) for i in range(len(beta)) for j in range(len(beta)) if chosen(beta[i], beta[j])]
        # whole numbers beyond 64 bits stay whole
        return F.coalesce(F.sum(reduce(Column.__add__, [t.cast("decimal(38,0)") for t in terms])) if terms else F.lit(0), F.lit(0)).cast("decimal(38,0)")

    statistic, dof = 2 * (fit.value - fit.null), len(fit.beta)
    sums = fit.table.agg(
        F.sum(reduce(Column.__add__, [F.col(f"d{i}") for i in range(len(beta))])).alias("events"),
        counted(lambda a, b: True).alias("pairs"), counted(lambda a, b: a > b).alias("concordant"), counted(lambda a, b: a == b).alias("tied"),
    )
    out = sums.select(
        "events", F.lit(fit.value).alias("log_likelihood"), F.lit(fit.null).alias("null_log_likelihood"),
        F.lit(statistic).alias("statistic"), F.lit(dof).alias("dof"), "pairs", "concordant", "tied",
        F.try_divide(F.col("concordant").cast("double") + F.col("tied").cast("double") / 2, F.col("pairs").cast("double")).alias("concordance"),
    )
    out = out.withColumn("p_value", chi2_p("statistic", "dof")) if p_values else out
    return out.withColumnRenamed("statistic", "lr_statistic")
