"""Least squares from sufficient statistics.

Rows are first counted per distinct combination of regressors (a cell), and the cells are
stored: levels, sums and lookups come from them. Then every partition adds up its share of X'X and X'y as one array per model, and the arrays
are added in two steps. Only one p x p sum per model reaches the driver, which
solves it. Several outcomes (``by``) are fitted in one pass.

Numbers are centred and scaled and outcomes are centred before anything is squared,
so that a large mean costs no digits; coefficients are turned back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from cohortspan.functions.tails import chi2_tail, normal_two_sided, t_two_sided
from cohortspan.operators.ordered import BROADCAST_VALUES
from cohortspan.session import durable
from cohortspan.sources.tables import require_columns

#: Default bound on the columns of X, whose square reaches the driver per model.
MAX_COLUMNS = 1000
_PIVOT = 1e-10
#: Tasks that add up the partitions' arrays of a model before one adds theirs.
_FAN_IN = 32


@dataclass(frozen=True)
class Design:
    """Columns of X: an intercept, treatment-coded levels, numbers, interactions.

    A column is a product of factors (variable, level); level ``None`` is the
    number itself, less its mean and over its deviation (``scale``). The first level
    in sort order is the reference.
    """

    levels: dict[str, tuple[str, ...]]
    numeric: tuple[str, ...] = ()
    interactions: tuple[tuple[str, ...], ...] = ()
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    columns: tuple[tuple[tuple[str, str | None], ...], ...] = field(init=False)

    def __post_init__(self):
        def factors(variable: str) -> list[tuple[str, str | None]]:
            if variable in self.numeric:
                return [(variable, None)]
            return [(variable, level) for level in self.levels[variable][1:]]

        columns: list[tuple] = [()]
        for variable in [*self.levels, *self.numeric]:
            columns += [(f,) for f in factors(variable)]
        for group in self.interactions:
            products: list[tuple] = [()]
            for variable in group:
                products = [(*have, f) for have in products for f in factors(variable)]
            columns += products
        object.__setattr__(self, "columns", tuple(dict.fromkeys(columns)))

    @property
    def variables(self) -> list[str]:
        return [*self.levels, *self.numeric]

    @property
    def names(self) -> list[str]:
        def one(variable: str, level: str | None) -> str:
            return variable if level is None else f"{variable}[{level}]"

        return [":".join(one(*f) for f in column) or "Intercept" for column in self.columns]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Dense design rows of one Arrow batch."""
        out = np.ones((len(rows), len(self.columns)))
        known: dict[tuple, np.ndarray] = {}
        for i, column in enumerate(self.columns):
            for factor in column:
                if factor not in known:
                    variable, level = factor
                    values = rows[variable]
                    if level is None:
                        mean, deviation = self.scale.get(variable, (0.0, 1.0))
                        known[factor] = (values.to_numpy(float) - mean) / deviation
                    else:
                        known[factor] = (values == level).to_numpy(float)
                out[:, i] *= known[factor]
        return out

    def scaled(self, scale: dict[str, tuple[float, float]]) -> Design:
        """The design with centred and scaled numbers.

        A product with a number expands into lower products when the number is moved;
        where the design lacks one of them, that number is scaled but not moved.
        """
        have = {frozenset(c) for c in self.columns}
        fixed = {
            v: (mean if all(frozenset(f for f in c if f != (v, None)) in have for c in self.columns if (v, None) in c) else 0.0, deviation)
            for v, (mean, deviation) in scale.items()
        }
        return Design(self.levels, self.numeric, self.interactions, fixed)

    def expansion(self) -> np.ndarray:
        """A with X = Z A: the plain columns in terms of the scaled ones."""
        place = {frozenset(c): i for i, c in enumerate(self.columns)}
        out = np.zeros((len(self.columns), len(self.columns)))
        for j, column in enumerate(self.columns):
            terms: dict[tuple, float] = {(): 1.0}
            for factor in column:
                mean, deviation = self.scale.get(factor[0], (0.0, 1.0)) if factor[1] is None else (0.0, 1.0)
                grown: dict[tuple, float] = {}
                for term, value in terms.items():
                    grown[(*term, factor)] = value * deviation
                    if mean:
                        grown[term] = value * mean
                terms = grown
            for term, value in terms.items():
                out[place[frozenset(term)], j] += value
        return out


def make_design(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str] = (),
    interactions: Sequence[Sequence[str]] = (),
    max_columns: int = MAX_COLUMNS,
) -> Design:
    """Find the levels of the categorical variables; more than ``max_columns`` columns are refused."""
    require_columns(df, [*categorical, *numeric])
    found: dict[str, list[str]] = {v: [] for v in categorical}
    if categorical:
        counts = df.agg(*[F.count_distinct(F.col(v).cast("string")).alias(v) for v in categorical]).first().asDict()
        size = {**{v: max(0, n - 1) for v, n in counts.items()}, **{v: 1 for v in numeric}}
        columns = 1 + sum(size.values()) + sum(math.prod(size[v] for v in group) for group in interactions)
        if columns > max_columns:
            raise ValueError(f"{columns} columns of regressors, more than {max_columns}; levels: {counts}")
        cells = ", ".join(f"'{v}', cast(`{v}` as string)" for v in categorical)
        for row in df.select(F.expr(f"stack({len(found)}, {cells}) as (variable, level)")).distinct().collect():
            if row["level"] is not None:
                found[row["variable"]].append(row["level"])
    return Design(
        {v: tuple(sorted(levels)) for v, levels in found.items()},
        tuple(numeric),
        tuple(tuple(i) for i in interactions),
    )


@dataclass(frozen=True)
class Fit:
    """One fitted outcome; dropped columns have no coefficient.

    Coefficients, inverse and covariance belong to the scaled columns and the outcome
    less ``mean``, a number near its mean; ``plain`` turns scaled coefficients into those of plain columns.
    """

    kept: tuple[int, ...]
    beta: np.ndarray
    inverse: np.ndarray
    cov: np.ndarray
    plain: np.ndarray
    mean: float
    n: float
    rss: float
    tss: float
    column_ss: np.ndarray
    robust: bool

    @property
    def dof(self) -> float:
        return self.n - len(self.kept)

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else math.nan

    def coefficients(self) -> np.ndarray:
        """Of plain columns and the plain outcome."""
        out = self.plain @ self.beta
        if self.kept and self.kept[0] == 0:
            out[0] += self.mean
        return out


@dataclass(frozen=True)
class Model:
    spark: SparkSession
    design: Design
    y: str
    by: str | None
    fits: dict[str, Fit]
    cells: DataFrame  # _model and the variables of the design, one row per combination

    def table(self) -> DataFrame:
        """Term, estimate, standard error, test, interval; dropped terms are listed without."""
        rows = []
        for key, fit in sorted(self.fits.items()):
            position = {c: i for i, c in enumerate(fit.kept)}
            beta, cov = fit.coefficients(), fit.plain @ fit.cov @ fit.plain.T
            for c, name in enumerate(self.design.names):
                if c not in position:
                    rows.append((key, name, None, None, None, None, None, None, True))
                    continue
                b = float(beta[position[c]])
                se = float(math.sqrt(max(cov[position[c], position[c]], 0.0)))
                t = b / se if se > 0 else math.nan
                p = normal_two_sided(t) if fit.robust else t_two_sided(t, float(fit.dof))
                rows.append((key, name, b, se, t, float(p), b - 1.96 * se, b + 1.96 * se, False))
        schema = (
            "model string, term string, estimate double, se double, t_value double, p_value double,"
            " ci_low double, ci_high double, dropped boolean"
        )
        return self.spark.createDataFrame(rows, schema)

    def summary(self) -> DataFrame:
        """One row per model: observations, columns, degrees of freedom, R^2, adjusted R^2, residual error."""
        rows = []
        for key, fit in sorted(self.fits.items()):
            dof = float(fit.dof)
            adjusted = 1 - (1 - fit.r_squared) * (fit.n - 1) / dof if dof > 0 else math.nan
            error = math.sqrt(fit.rss / dof) if dof > 0 else math.nan
            rows.append((key, int(fit.n), len(fit.kept), int(dof), float(fit.r_squared), float(adjusted), float(error)))
        schema = "model string, n bigint, terms int, dof bigint, r_squared double, adjusted_r_squared double, residual_error double"
        return self.spark.createDataFrame(rows, schema)


def _outcomes(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], y: str, by: str | None) -> DataFrame:
    """Model, outcome (null for NaN) and regressors, categorical variables as text."""
    columns = [F.col(v).cast("string").alias(v) for v in categorical] + [F.col(v).cast("double").alias(v) for v in numeric]
    model = F.col(by).cast("string") if by else F.lit("")
    outcome = F.col(y).cast("double")
    return df.select(model.alias("_model"), F.when(~F.isnan(outcome), outcome).alias("_y"), *columns)


def _summed(cells: DataFrame, partial) -> dict[str, np.ndarray]:
    """Add up the vectors that ``partial`` returns per model and partition; one row per model comes back.

    ``cells`` come out of an aggregation, so they have no more partitions than shuffles have.
    """
    schema = "_model string, part int, v array<double>"

    def run(batches):
        part, totals = TaskContext.get().partitionId() // _FAN_IN, {}
        for batch in batches:
            for key, rows in batch.groupby("_model", sort=False):
                vector = partial(key, rows)
                totals[key] = totals[key] + vector if key in totals else vector
        for key, vector in totals.items():
            yield pd.DataFrame({"_model": [key], "part": [part], "v": [vector.tolist()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.array(rows["v"].iat[0], np.float64)
        for vector in rows["v"].iloc[1:]:
            total += vector
        return pd.DataFrame({"_model": [key[0]], "part": [key[1] // _FAN_IN], "v": [total.tolist()]})

    added = cells.mapInPandas(run, schema)
    for _ in range(_levels(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))):
        added = added.groupBy("_model", "part").applyInPandas(add, schema)
    return {row["_model"]: np.array(row["v"]) for row in added.collect()}


def _levels(partitions: int) -> int:
    """Levels of a tree in which ``_FAN_IN`` vectors meet at a time until one is left."""
    levels = 1
    while partitions > _FAN_IN:
        partitions = -(-partitions // _FAN_IN)
        levels += 1
    return levels


def independent_columns(gram: np.ndarray) -> list[int]:
    """Columns that are no linear combination of earlier ones."""
    kept: list[int] = []
    for j in range(len(gram)):
        rest = own = gram[j, j]
        if kept and own > 0:
            cross = gram[kept, j]
            rest = own - cross @ np.linalg.solve(gram[np.ix_(kept, kept)], cross)
        if own > 0 and rest > _PIVOT * own:
            kept.append(j)
    return kept


def ols(
    df: DataFrame,
    y: str,
    categorical: Sequence[str],
    numeric: Sequence[str] = (),
    interactions: Sequence[Sequence[str]] = (),
    by: str | None = None,
    vcov: str = "iid",
    design: Design | None = None,
    centre: dict[str, float] | None = None,
) -> Model:
    """Ordinary least squares with classical or HC3 standard errors.

    ``centre`` has a number near each model's mean outcome; without it the means take a pass over the rows.
    """
    if vcov not in ("iid", "HC3"):
        raise ValueError(f"unknown vcov {vcov!r}")
    if design is None:
        require_columns(df, [*categorical, *numeric])
    else:
        categorical, numeric = list(design.levels), design.numeric
    outcomes = _outcomes(df, categorical, numeric, y, by)
    if centre is None:
        centre = {r["_model"]: r["_y"] for r in outcomes.na.drop().groupBy("_model").agg(F.avg("_y").alias("_y")).collect()}
    if centre:
        shift = F.create_map(*[F.lit(x) for pair in centre.items() for x in pair])
        outcomes = outcomes.withColumn("_y", F.col("_y") - F.coalesce(shift[F.col("_model")], F.lit(0.0)))
    # with the cells of nulls, whose levels are columns too
    every = durable(
        outcomes
        .groupBy("_model", *categorical, *numeric)
        .agg(
            F.count("_y").cast("double").alias("_n"),
            F.sum("_y").alias("_s"),
            F.sum(F.col("_y") * F.col("_y")).alias("_q"),
        )
    )
    design = design or make_design(every, categorical, numeric, interactions)
    p = len(design.columns)
    cells = every.filter("_n > 0").na.drop(subset=["_model", *design.variables])
    design = design.scaled(_scale(cells, design.numeric))
    expansion = design.expansion()

    def gram(_, rows: pd.DataFrame) -> np.ndarray:
        x = design.matrix(rows)
        n, s = rows["_n"].to_numpy(), rows["_s"].to_numpy()
        return np.concatenate([(x.T @ (x * n[:, None])).ravel(), x.T @ s, [rows["_q"].sum()]])

    solved = {}
    for key, flat in _summed(cells, gram).items():
        xx, xy, yy = flat[: p * p].reshape(p, p), flat[p * p : p * p + p], flat[-1]
        kept = independent_columns(xx)
        inverse = np.linalg.inv(xx[np.ix_(kept, kept)])
        beta = inverse @ xy[kept]
        n = xx[0, 0]
        rss = max(yy - beta @ xy[kept], 0.0)
        centred = xx - np.outer(xx[0], xx[0]) / n
        own = np.einsum("ij,ik,kj->j", expansion, centred, expansion)
        solved[key] = (kept, beta, inverse, n, rss, yy - xy[0] ** 2 / n, own)

    def meat(key: str, rows: pd.DataFrame) -> np.ndarray:
        kept, beta, inverse = solved[key][:3]
        x = design.matrix(rows)[:, kept]
        n, s, q = (rows[c].to_numpy() for c in ("_n", "_s", "_q"))
        fitted = x @ beta
        squares = q - 2 * fitted * s + n * fitted**2
        room = 1 - np.einsum("ij,jk,ik->i", x, inverse, x)
        # a row that is fitted exactly has no residual to weigh
        weight = np.where(room > 1e-12, squares / np.where(room > 1e-12, room, 1.0) ** 2, 0.0)
        return (x.T @ (x * weight[:, None])).ravel()

    meats = _summed(cells, meat) if vcov == "HC3" else {}
    fits = {}
    for key, (kept, beta, inverse, n, rss, tss, column_ss) in solved.items():
        if vcov == "HC3":
            cov = inverse @ meats[key].reshape(len(kept), len(kept)) @ inverse
        else:
            cov = inverse * (rss / (n - len(kept)) if n > len(kept) else math.nan)
        plain = np.linalg.inv(expansion[np.ix_(kept, kept)])
        fits[key] = Fit(tuple(kept), beta, inverse, cov, plain, centre.get(key, 0.0), n, rss, tss, column_ss, vcov == "HC3")
    return Model(df.sparkSession, design, y, by, fits, cells.select("_model", *design.variables))


def _scale(cells: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of numbers over all rows of the cells."""

    def average(values: dict) -> dict:
        found = cells.agg(*[F.try_divide(F.sum(F.col("_n") * x), F.sum("_n")).alias(v) for v, x in values.items()]).first()
        return {v: found[v] or 0.0 for v in values}

    if not numeric:
        return {}
    means = average({v: F.col(v) for v in numeric})
    spreads = average({v: F.pow(F.col(v) - means[v], 2) for v in numeric})
    return {v: (means[v], math.sqrt(spreads[v]) or 1.0) for v in numeric}


def influence(model: Model, df: DataFrame, fitted: bool = False) -> DataFrame:
    """Add fitted value, residual, leverage and Cook's distance to each row.

    Rows with a null outcome or regressor were not fitted and are left out. Fitted value and
    leverage depend on the regressors alone: they are computed once per cell and joined back; up to
    BROADCAST_VALUES cells go to every executor, so that the rows stay where they are.
    A row that is fitted exactly has a null distance. ``fitted``: the rows are the model's own or
    some of them, so that no pass is needed to find their cells.
    """
    design, y, by, fits = model.design, model.y, model.by, model.fits
    usable = df.na.drop(subset=[*design.variables, y] + ([by] if by else []))
    names = [f"_x{i}" for i in range(len(design.variables))]
    text = {n: F.col(v).cast("string" if v in design.levels else "double") for n, v in zip(names, design.variables)}
    keyed = usable.withColumns({"_model": F.col(by).cast("string") if by else F.lit(""), **text})
    cells = model.cells.toDF("_model", *names) if fitted else keyed.select("_model", *names).distinct()

    def run(batches):
        for batch in batches:
            rows = batch.rename(columns=dict(zip(names, design.variables)))
            for key, index in batch.groupby("_model", sort=False).groups.items():
                fit = fits[key]
                x = design.matrix(rows.loc[index])[:, list(fit.kept)]
                leverage = np.einsum("ij,jk,ik->i", x, fit.inverse, x)
                yield batch.loc[index].assign(fitted=x @ fit.beta + fit.mean, leverage=leverage)

    schema = ", ".join(["_model string", *(f"{n} {keyed.schema[n].dataType.simpleString()}" for n in names), "fitted double", "leverage double"])
    scale = F.create_map(*[F.lit(x) for key, fit in fits.items() for x in (key, float(len(fit.kept) * fit.rss / fit.dof) if fit.dof > 0 else math.nan)])
    known = durable(cells.mapInPandas(run, schema))
    if known.count() <= BROADCAST_VALUES:
        known = F.broadcast(known)
    found = keyed.join(known, ["_model", *names]).withColumn("residual", F.col(y).cast("double") - F.col("fitted"))
    room = 1 - F.col("leverage")
    cooks = F.when(room > 1e-12, F.try_divide(F.col("residual") * F.col("residual"), scale[F.col("_model")]) * F.col("leverage") / (room * room))
    return found.select(*usable.columns, "fitted", "residual", "leverage", cooks.alias("cooks_d"))


def breusch_pagan(model: Model, with_residuals: DataFrame) -> DataFrame:
    """Studentised test of constant variance: n R^2 of squared residuals on X."""
    squared = with_residuals.withColumn("_e2", F.col("residual") * F.col("residual"))
    plain = Design(model.design.levels, model.design.numeric, model.design.interactions)
    centre = {key: float(fit.rss / fit.n) for key, fit in model.fits.items()}
    auxiliary = ols(squared, "_e2", (), by=model.by, design=plain, centre=centre)
    rows = []
    for key, fit in sorted(auxiliary.fits.items()):
        statistic, dof = fit.n * fit.r_squared, len(fit.kept) - 1
        rows.append((key, float(statistic), int(dof), float(chi2_tail(statistic, dof))))
    return model.spark.createDataFrame(rows, "model string, statistic double, dof int, p_value double")


def drop_influential(model: Model, with_influence: DataFrame) -> DataFrame:
    """Rows whose Cook's distance is at most 4 / n of their model."""
    limit = F.lit(None).cast("double")
    for key, fit in model.fits.items():
        same = F.lit(True) if model.by is None else F.col(model.by).cast("string") == key
        limit = F.when(same, 4 / fit.n).otherwise(limit)
    return with_influence.filter(F.coalesce(F.col("cooks_d") <= limit, F.lit(True)))


def vif(model: Model) -> DataFrame:
    """Variance inflation per column: own sum of squares times the inverse's diagonal."""
    rows = []
    for key, fit in sorted(model.fits.items()):
        for position, c in enumerate(fit.kept):
            own = fit.n if c == 0 else fit.column_ss[c]
            inverse = fit.plain @ fit.inverse @ fit.plain.T
            rows.append((key, model.design.names[c], float(own * inverse[position, position])))
    return model.spark.createDataFrame(rows, "model string, variable string, vif double")
