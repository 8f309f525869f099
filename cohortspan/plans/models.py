"""Tests, survival, regression and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.operators import association, cohort, did, matching, regress, survival
from cohortspan.plans import solve, use
from cohortspan.plans.base import case_sql, chi2_p_sql, query, unpivot_sql, with_ctes
from cohortspan.session import durable, stored
from cohortspan.sources import mapping as m

SIX = m.CHARACTERISTICS[1:]


def _short_p(df):
    return df.withColumn("p_value", F.round("p_value", 5))


# --- chi-square and rank correlation -----------------------------------------

_CHI = """SELECT variable, total, CAST(dof AS INTEGER) AS dof, n_0, n_1, round(sum(pow(gap - least(0.5 * CAST(dof = 1 AS INTEGER), gap), 2) / expected), 6) AS statistic
FROM (SELECT *, abs(n - expected) AS gap, (nr - 1) * (nc - 1) AS dof FROM (
  SELECT *, row_total * column_total / total AS expected FROM (
    SELECT g.variable, g.value, k.kind, coalesce(c.n, 0) AS n,
      sum(coalesce(c.n, 0)) OVER (PARTITION BY g.variable, g.value) AS row_total,
      sum(coalesce(c.n, 0)) OVER (PARTITION BY g.variable, k.kind) AS column_total,
      sum(coalesce(c.n, 0)) OVER (PARTITION BY g.variable)::BIGINT AS total,
      (sum(coalesce(c.n, 0)) FILTER (k.kind = '{first}') OVER (PARTITION BY g.variable))::BIGINT AS n_0,
      (sum(coalesce(c.n, 0)) FILTER (k.kind = '{second}') OVER (PARTITION BY g.variable))::BIGINT AS n_1,
      count(*) OVER (PARTITION BY g.variable, k.kind) AS nr, count(*) OVER (PARTITION BY g.variable, g.value) AS nc
    FROM (SELECT DISTINCT variable, value FROM cells) g CROSS JOIN (SELECT DISTINCT kind FROM cells) k
    LEFT JOIN cells c ON c.variable = g.variable AND c.value = g.value AND c.kind = k.kind)))
GROUP BY ALL"""


@query(
    "chi_square",
    with_ctes(
        "pathways",
        f"SELECT *, round({chi2_p_sql('statistic', 'dof')}, 5) AS p_value FROM ({_CHI.format(first='<= 18 weeks', second='> 42 weeks')})",
        "cells AS (SELECT variable, value, kind, count(*) AS n FROM ("
        + unpivot_sql(
            f"(SELECT DISTINCT {', '.join(SIX)}, pid, \"group\" AS kind FROM pathways WHERE \"group\" IN ('<= 18 weeks', '> 42 weeks'))", SIX, "kind"
        )
        + ") GROUP BY 1, 2, 3)",
    ),
)
def chi_square(spark, sf_dir):
    """Characteristics against two wait groups, one row per patient and group."""
    groups = ("<= 18 weeks", "> 42 weeks")
    grain = m.pathways(spark, sf_dir).filter(F.col("group").isin(*groups)).groupBy(*SIX, "pid", "group").agg(F.count("*").alias("_rows"))
    return _short_p(association.chi_square(grain, SIX, "group", groups))


@query(
    "high_users_chi_square",
    with_ctes(
        use.PANEL_PARTS,
        f"SELECT *, round({chi2_p_sql('statistic', 'dof')}, 5) AS p_value FROM ({_CHI.format(first='Bottom 90%', second='Top 10%')})",
        use._SAMPLE + ",\n" + use._WEEKLY + ",\ncells AS (SELECT variable, value, kind, count(*) AS n FROM ("
        + unpivot_sql("(SELECT *, usage_group AS kind FROM labelled)", use.FIVE, "kind")
        + ") GROUP BY 1, 2, 3)",
    ),
)
def high_users_chi_square(spark, sf_dir):
    groups = (association.REST, association.TOP)
    return _short_p(association.chi_square(use.labelled_users(spark, sf_dir), use.FIVE, "usage_group", groups))


_EXITED = """exited AS (SELECT spans.*, CAST(exit_date - start_date AS INTEGER) AS time_to_exit
  FROM spans JOIN exits ON exits.pid = spans.pid WHERE exit_date BETWEEN start_date AND stop_date)"""


def exited(spark, sf_dir):


    gone = cohort.exit_during_wait(m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid"))
    return gone.withColumn("time_to_exit", F.datediff("exit_date", "start_date"))


def _spearman_sql(x: str, y: str, source: str) -> str:
    return f"""SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
  SELECT (rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) AS rx,
    (rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2) AS ry FROM {source})"""


@query("spearman", with_ctes("spans exits", _spearman_sql("wt", "time_to_exit", "exited"), _EXITED))
def spearman(spark, sf_dir):
    return association.spearman(exited(spark, sf_dir), "wt", "time_to_exit")


@query(
    "spearman_price",
    "SELECT * FROM (" + _spearman_sql("l_quantity", "l_extendedprice", "lineitem") + ")",
)
def spearman_price(spark, sf_dir):
    """Rank correlation of quantity and price over all line items."""
    rows = m.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return association.spearman(rows, "l_quantity", "l_extendedprice")


# --- survival ------------------------------------------------------------------

_RISK = """SELECT {keys} wt AS time, count(*) AS removed, sum(event)::BIGINT AS events,
    (sum(count(*)) OVER ({part} ORDER BY wt DESC))::BIGINT AS at_risk FROM {source} GROUP BY {group} wt"""


@query(
    "kaplan_meier",
    with_ctes(
        "pathways",
        """SELECT bucket, CAST(time AS INTEGER) AS time, removed, events, at_risk,
  round(CASE WHEN bool_or(events = at_risk) OVER w THEN 0 ELSE product(CASE WHEN events = at_risk THEN 1 ELSE 1 - events / at_risk END) OVER w END, 6) AS survival
FROM ("""
        + _RISK.format(keys="bucket,", part="PARTITION BY bucket", source="buckets", group="bucket,")
        + ") WINDOW w AS (PARTITION BY bucket ORDER BY time)",
        f"buckets AS (SELECT wt, event, {case_sql('age', b.Bands((17, 64), ('child', 'adult', 'older')))} AS bucket FROM pathways)",
    ),
)
def kaplan_meier(spark, sf_dir):
    """Time to an outcome by age bucket, pathways without the event censored."""
    bucket = b.band("age", b.Bands((17, 64), ("child", "adult", "older")))
    rows = m.pathways(spark, sf_dir).select("wt", "event", bucket.alias("bucket"))
    return survival.kaplan_meier(rows, "wt", "event", ["bucket"]).drop("std_error", "ci_low", "ci_high")


_CURVE = """curve AS (SELECT *, (wt)::INTEGER AS time, product(1 - d / n) OVER w AS s, sum(d / (n * (n - d))) OVER w AS g FROM (
  SELECT priority, wt, sum(event)::DOUBLE AS d, (sum(count(*)) OVER (PARTITION BY priority ORDER BY wt DESC))::DOUBLE AS n
  FROM spans WHERE priority IN ('Urgent', 'Routine') GROUP BY 1, 2) WINDOW w AS (PARTITION BY priority ORDER BY wt))"""


def _curve(spark, sf_dir):
    rows = m.spans(spark, sf_dir).select("wt", "event", "priority").filter(F.col("priority").isin("Urgent", "Routine"))
    return survival.kaplan_meier(rows, "wt", "event", ["priority"])


@query(
    "kaplan_meier_interval",
    with_ctes(
        "spans",
        """SELECT priority, time, round(s, 6) AS survival, round(s * sqrt(g), 6) AS std_error,
  round(CASE WHEN s < 1 THEN pow(s, exp(-1.959963984540054 * sqrt(g) / ln(s))) END, 6) AS ci_low,
  round(CASE WHEN s < 1 THEN pow(s, exp(1.959963984540054 * sqrt(g) / ln(s))) END, 6) AS ci_high FROM curve WHERE s > 0 AND n > d""",
        _CURVE,
    ),
)
def kaplan_meier_interval(spark, sf_dir):
    """Curves of urgent and routine pathways with Greenwood errors and intervals, as long as anyone is left.

    Other priorities ('Cancer', null) are left out, as in the log-rank test.
    """
    return _curve(spark, sf_dir).filter("survival > 0").select("priority", "time", "survival", "std_error", "ci_low", "ci_high")


@query(
    "kaplan_meier_median",
    with_ctes("spans", "SELECT priority, min(time) FILTER (s <= 0.5) AS median FROM curve GROUP BY 1", _CURVE),
)
def kaplan_meier_median(spark, sf_dir):
    """Median waits of urgent and routine pathways; other priorities ('Cancer', null) are left out."""
    return survival.median_survival(_curve(spark, sf_dir), ["priority"])


@query(
    "kaplan_meier_overall",
    with_ctes(
        "spans exits",
        """SELECT CAST(time AS INTEGER) AS time, removed, events, at_risk,
  round(CASE WHEN bool_or(events = at_risk) OVER w THEN 0 ELSE product(CASE WHEN events = at_risk THEN 1 ELSE 1 - events / at_risk END) OVER w END, 6) AS survival
FROM (SELECT time, count(*) AS removed, sum(event)::BIGINT AS events, (sum(count(*)) OVER (ORDER BY time DESC))::BIGINT AS at_risk
  FROM (SELECT CAST(least(coalesce(exit_date, stop_date), stop_date) - start_date AS INTEGER) AS time,
          CAST(coalesce(exit_date <= stop_date, false) AS INTEGER) AS event
        FROM spans LEFT JOIN exits ON exits.pid = spans.pid WHERE exit_date IS NULL OR exit_date >= start_date) GROUP BY 1)
WINDOW w AS (ORDER BY time)""",
    ),
)
def kaplan_meier_overall(spark, sf_dir):
    """Survival on the waiting list: exits are events, clock stops are censored."""
    linked = m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid", "left").filter("exit_date IS NULL OR exit_date >= start_date")
    rows = linked.selectExpr(
        "datediff(least(coalesce(exit_date, stop_date), stop_date), start_date) as time",
        "cast(coalesce(exit_date <= stop_date, false) as int) as event",
    )
    return survival.kaplan_meier(rows, "time", "event").drop("std_error", "ci_low", "ci_high")


@query(
    "log_rank",
    with_ctes(
        "spans",
        f"""SELECT observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(pow(observed - expected, 2) / variance, 6) AS statistic,
  1 AS dof, round({chi2_p_sql("(pow(observed - expected, 2) / variance)", "1")}, 5) AS p_value FROM (
  SELECT sum(d1)::BIGINT AS observed, sum(d * n1 / n) AS expected,
    sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance
  FROM (SELECT wt, sum(event)::DOUBLE AS d, sum(event) FILTER (priority = 'Urgent') AS d1,
      sum(count(*)) OVER (ORDER BY wt DESC)::DOUBLE AS n,
      sum(count(*) FILTER (priority = 'Urgent')) OVER (ORDER BY wt DESC)::DOUBLE AS n1
    FROM spans WHERE priority IN ('Urgent', 'Routine') GROUP BY wt) WHERE d > 0)""",
    ),
)
def log_rank(spark, sf_dir):
    rows = m.spans(spark, sf_dir).select("wt", "event", "priority")
    return _short_p(survival.log_rank(rows, "wt", "event", "priority", ("Urgent", "Routine")))


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(
    "cox_ph",
    with_ctes(
        "pathways",
        f"""SELECT level, round(beta, 5) AS coef, round(exp(beta), 5) AS hazard_ratio, round(se, 5) AS se, round(beta / se, 3) AS z,
  round({chi2_p_sql("pow(beta / se, 2)", "1")}, 4) AS p_value, round(exp(beta - 1.96 * se), 5) AS hr_low, round(exp(beta + 1.96 * se), 5) AS hr_high, false AS dropped
FROM (SELECT *, sqrt(variance) AS se FROM cox_beta) JOIN (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(_REGIONS[1:]))}) t(i, level) USING (i)""",
        solve.cox("cox", "pathways", "wt", "event", "region", _REGIONS),
    ),
)
def cox_ph(spark, sf_dir):
    rows = m.pathways(spark, sf_dir).select("wt", "event", "region")
    fit = survival.cox_ph(rows, "wt", "event", "region", _REGIONS)
    return fit.withColumns({c: F.round(c, 5) for c in ("coef", "hazard_ratio", "se", "hr_low", "hr_high")} | {"z": F.round("z", 3), "p_value": F.round("p_value", 4)})


# --- regression -------------------------------------------------------------------


def _ols_rows(panel, *covariates):
    """Outcome and regressors of a panel, stored."""
    rows = panel.withColumn("time_period", F.col("time_period").cast("string"))
    return stored(rows.select("activity", "group", "time_period", *covariates, "avg_weekly_use"), "panel")


_MEANS = """means AS (SELECT activity, avg(y) FILTER (g = 0 AND t = 0) AS a, avg(y) FILTER (g = 0 AND t = 1) AS b,
    avg(y) FILTER (g = 1 AND t = 0) AS c, avg(y) FILTER (g = 1 AND t = 1) AS d,
    count(*) AS n, count(*) FILTER (g = 0 AND t = 0) AS na, count(*) FILTER (g = 0 AND t = 1) AS nb, count(*) FILTER (g = 1 AND t = 0) AS nc,
    count(*) FILTER (g = 1 AND t = 1) AS nd
  FROM (SELECT activity, avg_weekly_use AS y, CAST("group" <> '<= 18 weeks' AS INTEGER) AS g, time_period AS t FROM ols_panel) GROUP BY 1),
spread AS (SELECT activity, sum(pow(avg_weekly_use - CASE WHEN "group" = '<= 18 weeks' THEN CASE time_period WHEN 0 THEN a ELSE b END
    ELSE CASE time_period WHEN 0 THEN c ELSE d END END, 2)) / (any_value(n) - 4) AS s2 FROM ols_panel JOIN means USING (activity) GROUP BY 1),
terms AS (
  SELECT activity, 'Intercept' AS term, a AS estimate, 1 / na AS v FROM means
  UNION ALL SELECT activity, 'group[> 18 weeks]', c - a, 1 / na + 1 / nc FROM means
  UNION ALL SELECT activity, 'time_period[1]', b - a, 1 / na + 1 / nb FROM means
  UNION ALL SELECT activity, 'group[> 18 weeks]:time_period[1]', d - c - b + a, 1 / na + 1 / nb + 1 / nc + 1 / nd FROM means)"""


@query(
    "did_ols_base",
    with_ctes(
        "pathways activity observed",
        """SELECT activity AS model, term, round(estimate, 6) AS estimate, round(sqrt(s2 * v), 6) AS se
FROM terms JOIN spread USING (activity)""",
        use._OLS_PANEL + ",\n" + _MEANS,
    ),
)
def did_ols_base(spark, sf_dir):
    """Saturated group x period regression: differences of the four cell means."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir))
    fit = regress.ols(rows, "avg_weekly_use", ["group", "time_period"], interactions=[("group", "time_period")], by="activity")
    return fit.table().select("model", "term", "estimate", "se")


COVARIATES = ("ltc", "region", "sex")
INTERACTIONS = (("group", "time_period"),)

# levels in sort order; the first of each is the reference
_LEVELS = {
    "group": ("<= 18 weeks", "> 18 weeks"),
    "time_period": ("0", "1"),
    "ltc": tuple(sorted(b.CONDITIONS.labels)),
    "region": _REGIONS,
    "sex": ("F", "M"),
}


def _design(interactions, numbers=(), factors=("group", "time_period", *COVARIATES)):
    """Names of the terms and the SQL of their columns."""

    def one(variable):
        return [(f"{variable}[{level}]", f"(CAST(\"{variable}\" AS VARCHAR) = '{level}')::INTEGER") for level in _LEVELS[variable][1:]]

    terms = [("Intercept", "1"), *[t for f in factors for t in one(f)], *[(v, v) for v in numbers]]
    for u, v in interactions:
        terms += [(f"{a}:{c}", f"{x} * {y}") for a, x in one(u) for c, y in one(v)]
    return [t for t, _ in terms], [c for _, c in terms]


_PLAIN_DESIGN = _design(INTERACTIONS)
_FULL_PAIRS = (("group", "time_period"), *(("group", c) for c in COVARIATES))
_FULL_DESIGN = _design(_FULL_PAIRS)
_EXPLICIT_DESIGN = _design((), ("post", "treated", "post_treatment"), COVARIATES)


def _rounded(table):
    return table.withColumns({"t_value": F.round("t_value", 4), "p_value": F.round("p_value", 5)})


@query(
    "did_ols",
    with_ctes(
        "pathways activity observed",
        solve.coefficients("fit", _PLAIN_DESIGN[0], robust=False),
        use._OLS_PANEL + ",\n" + solve.least_squares("fit", "ols_panel", _PLAIN_DESIGN[1], "avg_weekly_use", "activity"),
    ),
)
def did_ols(spark, sf_dir):
    """Group x period with covariates, classical errors, all activities."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir), *COVARIATES)
    return _rounded(regress.ols(rows, "avg_weekly_use", ["group", "time_period", *COVARIATES], interactions=INTERACTIONS, by="activity").table())


@query(
    "did_ols_summary",
    with_ctes(
        "pathways activity observed",
        """SELECT model, CAST(n AS BIGINT) AS n, CAST(p AS INTEGER) AS terms, CAST(n - p AS BIGINT) AS dof, round(r2, 6) AS r_squared,
  round(1 - (1 - r2) * (n - 1) / (n - p), 6) AS adjusted_r_squared, round(sqrt(rss / (n - p)), 6) AS residual_error
FROM (SELECT m.*, 1 - rss / t.tss AS r2 FROM fit_model m JOIN (SELECT activity, var_pop(avg_weekly_use) * count(*) AS tss FROM ols_panel GROUP BY 1) t ON t.activity = m.model)""",
        use._OLS_PANEL + ",\n" + solve.least_squares("fit", "ols_panel", _PLAIN_DESIGN[1], "avg_weekly_use", "activity"),
    ),
)
def did_ols_summary(spark, sf_dir):
    """Observations, degrees of freedom and explained variance of each model."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir), *COVARIATES)
    return regress.ols(rows, "avg_weekly_use", ["group", "time_period", *COVARIATES], interactions=INTERACTIONS, by="activity").summary()


@query(
    "did_ols_explicit",
    with_ctes(
        "pathways activity observed",
        solve.coefficients("fit", _EXPLICIT_DESIGN[0], robust=False),
        use._OLS_PANEL
        + """,
explicit AS (SELECT *, time_period AS post, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated, time_period * CAST("group" <> '<= 18 weeks' AS INTEGER) AS post_treatment FROM ols_panel),
"""
        + solve.least_squares("fit", "explicit", _EXPLICIT_DESIGN[1], "avg_weekly_use", "activity"),
    ),
)
def did_ols_explicit(spark, sf_dir):
    """The same with explicit post, treated and product columns as numbers."""
    panel = durable(use.ols_panel(spark, sf_dir).withColumns({"post": F.col("time_period"), "post_treatment": F.col("time_period") * F.col("treated")}))
    return _rounded(regress.ols(panel, "avg_weekly_use", COVARIATES, ["post", "treated", "post_treatment"], by="activity").table())


def _interacted(rows, centre=None):
    return regress.ols(
        rows, "avg_weekly_use", ["group", "time_period", *COVARIATES], interactions=_FULL_PAIRS, by="activity", vcov="HC3", centre=centre
    )


@query(
    "did_ols_hc3",
    with_ctes(
        "pathways activity observed",
        solve.coefficients("fit", _FULL_DESIGN[0], robust=True),
        use._OLS_PANEL + ",\n" + solve.least_squares("fit", "ols_panel", _FULL_DESIGN[1], "avg_weekly_use", "activity"),
    ),
)
def did_ols_hc3(spark, sf_dir):
    """Group interacted with period and covariates, HC3 errors."""
    return _rounded(_interacted(_ols_rows(use.ols_panel(spark, sf_dir), *COVARIATES)).table())


_TERM_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_PLAIN_DESIGN[0]))


@query(
    "vif",
    with_ctes(
        "pathways activity observed",
        f"""SELECT '' AS model, term AS variable, round(own * v, 6) AS vif FROM fit_inverse f
JOIN (SELECT i, CASE WHEN i = 0 THEN sum(n) ELSE sum(n * x[i + 1] * x[i + 1]) - pow(sum(n * x[i + 1]), 2) / sum(n) END AS own
  FROM fit_cells, range({len(_PLAIN_DESIGN[1])}) a(i) GROUP BY 1) o ON o.i = f.i
JOIN (VALUES {_TERM_VALUES}) t(i, term) ON t.i = f.i WHERE f.i = f.j""",
        use._OLS_PANEL + ",\n" + solve.least_squares("fit", "ols_panel", _PLAIN_DESIGN[1], "total_hc_use * 0", "0"),
    ),
)
def vif(spark, sf_dir):
    """All activities share the regressors, so all rows go into one design."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir), *COVARIATES)
    return regress.vif(regress.ols(rows, "avg_weekly_use", ["group", "time_period", *COVARIATES], interactions=INTERACTIONS))


def _refit_sql(source):
    """First fit, rows with a small distance, second fit."""
    columns = _FULL_DESIGN[1]
    return ",\n".join([
        solve.least_squares("first", source, columns, "avg_weekly_use", "activity"),
        solve.influence("first", source, columns, "avg_weekly_use", "activity"),
        "kept AS MATERIALIZED (SELECT * EXCLUDE (model, x, e, h, cooks, most) FROM first_marked WHERE cooks <= most)",
        solve.least_squares("second", "kept", columns, "avg_weekly_use", "activity"),
        solve.influence("second", "kept", columns, "avg_weekly_use", "activity"),
    ])


def _refit(rows):
    """Fit, drop influential rows, fit again: the first model with its residuals, the second with its rows.

    Marks need only the row and its cell, so they are made anew where they are read.
    """
    first = _interacted(rows)
    marked = regress.influence(first, rows, fitted=True)
    kept = regress.drop_influential(first, marked).drop("fitted", "residual", "leverage", "cooks_d")
    return first, marked, kept, _interacted(kept, {key: fit.mean for key, fit in first.fits.items()})


@query(
    "ols_influence",
    with_ctes(
        "pathways activity observed",
        f"""SELECT 'all rows' AS stage, * FROM ({solve.breusch_pagan("first")})
UNION ALL SELECT 'without influential', * FROM ({solve.breusch_pagan("second")})""",
        use._OLS_PANEL + ",\n" + _refit_sql("ols_panel"),
    ),
)
def ols_influence(spark, sf_dir):
    """Breusch-Pagan test before and after dropping rows with a large Cook's distance."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir), *COVARIATES)
    first, marked, kept, second = _refit(rows)
    before = regress.breusch_pagan(first, marked).withColumn("stage", F.lit("all rows"))
    after = regress.breusch_pagan(second, regress.influence(second, kept, fitted=True)).withColumn("stage", F.lit("without influential"))
    sizes = {"all rows": first, "without influential": second}
    counts = spark.createDataFrame([(s, k, int(f.n)) for s, mod in sizes.items() for k, f in mod.fits.items()], "stage string, model string, n bigint")
    tests = before.unionByName(after).join(F.broadcast(counts), ["stage", "model"])
    return tests.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 5)})


# --- matching ----------------------------------------------------------------------


def _units(spark, sf_dir, chosen=None):
    """One row per pathway of the threshold design, treated when over 18 weeks."""
    chosen = use.threshold_sample(spark, sf_dir) if chosen is None else chosen
    return chosen.select(
        "pathway_id", "pid", "group", *COVARIATES, "quintile", "balance", (F.col("group") != did.CONTROL).cast("int").alias("treated")
    )


_CELL = (*COVARIATES, "quintile")
# index of each level: most frequent first, then by name
_SCORES = (
    use._OVER
    + """,
units AS (SELECT *, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated FROM over),
"""
    + ",\n".join(f"level_{c} AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i_{c} FROM units GROUP BY 1)" for c in _CELL)
    + f""",
counted AS MATERIALIZED (SELECT {", ".join(_CELL)}, {", ".join(f"any_value(i_{c}) AS i_{c}" for c in _CELL)}, count(*) AS w, sum(treated) AS k
  FROM units {" ".join(f"JOIN level_{c} USING ({c})" for c in _CELL)} GROUP BY {", ".join(_CELL)}),
"""
    + solve.logistic("score", "counted", ["1", *[f"i_{c}" for c in _CELL]])
    + f""",
scores AS MATERIALIZED (SELECT {", ".join(_CELL)}, w, k, 1 / (1 + exp(-sum(beta * CASE i WHEN 0 THEN 1 {" ".join(f"WHEN {n + 1} THEN i_{c}" for n, c in enumerate(_CELL))} END))) AS score
  FROM counted, score_beta GROUP BY ALL)"""
)


@query(
    "propensity",
    with_ctes(
        "pathways observed",
        f"SELECT {', '.join(_CELL)}, round(score, 5) AS propensity_score, w AS n, CAST(k AS BIGINT) AS treated FROM scores",
        _SCORES,
    ),
)
def propensity(spark, sf_dir):
    """Score per pathway, reduced to the distinct covariate cells."""
    scored = matching.propensity(_units(spark, sf_dir), "treated", _CELL)
    return scored.groupBy(*_CELL).agg(
        F.round(F.max("propensity_score"), 5).alias("propensity_score"), F.count("*").alias("n"), F.sum("treated").alias("treated")
    )


@query(
    "psm_match",
    with_ctes(
        "pathways observed",
        """SELECT control_pid, treated_pid, round(score_diff, 6) AS score_diff FROM (
  SELECT c.pid AS control_pid, t.pid AS treated_pid, abs(c.balance - t.balance) AS score_diff,
    row_number() OVER (PARTITION BY c.pid ORDER BY abs(c.balance - t.balance), t.pid) AS rn
  FROM (SELECT DISTINCT pid, balance FROM over WHERE "group" = '<= 18 weeks') c
  CROSS JOIN (SELECT DISTINCT pid, balance FROM over WHERE "group" <> '<= 18 weeks') t) WHERE rn = 1""",
        use._OVER,
    ),
)
def psm_match(spark, sf_dir):
    """Nearest treated patient by a given score, here the account balance."""
    return matching.nearest_match(_units(spark, sf_dir), score="balance")


@query(
    "psm_match_cells",
    with_ctes(
        "pathways observed",
        """SELECT control_pid, treated_pid, round(score_diff, 6) AS score_diff FROM (
  SELECT c.pid AS control_pid, t.pid AS treated_pid, abs(c.score - t.score) AS score_diff,
    row_number() OVER (PARTITION BY c.pid ORDER BY abs(c.score - t.score), t.pid) AS rn
  FROM (SELECT DISTINCT pid, score FROM scored WHERE treated = 0) c
  CROSS JOIN (SELECT score, min(pid) AS pid FROM scored WHERE treated = 1 GROUP BY score) t) WHERE rn = 1""",
        use._OVER
        + """,
units AS (SELECT *, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated FROM over),
scored AS (SELECT units.pid, treated, score FROM units JOIN (
  SELECT ltc, region, sex, quintile, sum(treated) / count(*) AS score FROM units GROUP BY 1, 2, 3, 4) USING (ltc, region, sex, quintile))""",
    ),
)
def psm_match_cells(spark, sf_dir):
    """Nearest match on the treated share of the covariate cell, with many ties."""
    units = _units(spark, sf_dir)
    cells = [*COVARIATES, "quintile"]
    shares = units.groupBy(*cells).agg((F.sum("treated") / F.count("*")).alias("propensity_score"))
    return matching.nearest_match(units.join(shares, cells))


def _one_to_one_sql(units: str) -> str:
    """Pairs of (pid, score, treated): equal scores first, then neighbours on the same step of the walk up the scores."""
    return f"""
people AS (SELECT pid, min(score) AS score, max(treated) AS treated FROM ({units}) GROUP BY pid),
placed AS (SELECT *, row_number() OVER (PARTITION BY score, treated ORDER BY pid) AS k,
    count(*) FILTER (treated = 0) OVER (PARTITION BY score) AS c, count(*) FILTER (treated = 1) OVER (PARTITION BY score) AS t FROM people),
levels AS (SELECT score, sum(c - t) OVER (ORDER BY score) - (c - t) AS level FROM (SELECT DISTINCT score, c, t FROM placed)),
left_over AS (SELECT pid, score, treated, CASE treated WHEN 0 THEN level + k - least(c, t) - 1 ELSE level - k + least(c, t) END AS step
  FROM placed JOIN levels USING (score) WHERE k > least(c, t)),
walked AS (SELECT *, lag(pid) OVER w AS other, lag(score) OVER w AS other_score FROM left_over WINDOW w AS (PARTITION BY step ORDER BY score)),
pairs AS (
  SELECT a.pid AS control_pid, b.pid AS treated_pid, 0.0::DOUBLE AS score_diff
  FROM placed a JOIN placed b ON a.score = b.score AND a.k = b.k WHERE a.treated = 0 AND b.treated = 1
  UNION ALL
  SELECT CASE treated WHEN 0 THEN pid ELSE other END, CASE treated WHEN 0 THEN other ELSE pid END, score - other_score
  FROM walked WHERE other IS NOT NULL AND (treated = 1) = (step >= 0))"""


@query(
    "psm_match_one_to_one",
    with_ctes(
        "pathways observed",
        "SELECT control_pid, treated_pid, round(score_diff, 6) AS score_diff FROM pairs",
        use._OVER + "," + _one_to_one_sql(
            """SELECT pathway_id AS pid, o_totalprice AS score, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated FROM over JOIN orders ON o_orderkey = pathway_id"""
        ),
    ),
)
def psm_match_one_to_one(spark, sf_dir):
    """Pairs of pathways without replacement along a given score, here the order's price."""
    prices = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pathway_id"), F.col("o_totalprice").alias("price"))
    return matching.one_to_one_match(_units(spark, sf_dir).join(prices, "pathway_id"), score="price", patient="pathway_id")


_CALIPER = 0.05


@query(
    "psm_match_one_to_one_cells",
    with_ctes(
        "pathways observed",
        f"SELECT control_pid, treated_pid, round(score_diff, 6) AS score_diff FROM pairs WHERE score_diff <= {_CALIPER}",
        use._OVER
        + """,
units AS (SELECT *, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated FROM over),"""
        + _one_to_one_sql("""SELECT units.pathway_id AS pid, treated, score FROM units JOIN (
  SELECT ltc, region, sex, quintile, sum(treated) / count(*) AS score FROM units GROUP BY 1, 2, 3, 4) USING (ltc, region, sex, quintile)"""),
    ),
)
def psm_match_one_to_one_cells(spark, sf_dir):
    """Pairs of pathways without replacement, within a caliper, on the treated share of the covariate cell, with many ties."""
    units = _units(spark, sf_dir)
    cells = [*COVARIATES, "quintile"]
    shares = units.groupBy(*cells).agg((F.sum("treated") / F.count("*")).alias("propensity_score"))
    return matching.one_to_one_match(units.join(shares, cells), patient="pathway_id", caliper=_CALIPER)


# scores that agree to nine digits are one score, whoever solved for them
_MATCHED = (
    _SCORES
    + f""",
scored AS MATERIALIZED (SELECT units.pid, treated, round(score, 9) AS score FROM units JOIN scores USING ({", ".join(_CELL)})),
matches AS MATERIALIZED (SELECT control_pid, treated_pid FROM (
  SELECT c.pid AS control_pid, t.pid AS treated_pid, row_number() OVER (PARTITION BY c.pid ORDER BY abs(c.score - t.score), t.pid) AS rn
  FROM (SELECT DISTINCT pid, score FROM scored WHERE treated = 0) c
  CROSS JOIN (SELECT score, min(pid) AS pid FROM scored WHERE treated = 1 GROUP BY score) t) WHERE rn = 1),
{use._OLS_PANEL.removeprefix(use._OVER + ",")},
matched AS MATERIALIZED (SELECT * FROM ols_panel WHERE pid IN (SELECT control_pid FROM matches UNION SELECT treated_pid FROM matches)),
"""
)


@query(
    "matched_did",
    with_ctes("pathways activity observed", solve.coefficients("second", _FULL_DESIGN[0], robust=True), _MATCHED + _refit_sql("matched")),
)
def matched_did(spark, sf_dir):
    """Propensity score, match, matched cohort, HC3 regression without influential rows."""
    facts = m.facts(spark, sf_dir)
    chosen = use.threshold_sample(spark, sf_dir, facts)
    scored = matching.propensity(_units(spark, sf_dir, chosen), "treated", _CELL)
    matches = durable(matching.nearest_match(scored.withColumn("propensity_score", F.round("propensity_score", 9))))
    # pathways and facts of matched patients, before they grow by period and activity
    panel = use.ols_panel(spark, sf_dir, matching.matched_cohort(facts, matches), matching.matched_cohort(chosen, matches))
    return _rounded(_refit(_ols_rows(panel, *COVARIATES))[3].table())


# --- special cases with a closed form, so that SQL can check the solvers ------------


@query(
    "cox_ph_two_groups",
    with_ctes(
        "pathways",
        """SELECT 'M' AS level, round(max_by(beta, step), 5) AS coef, round(1 / sqrt(max_by(information, step)), 5) AS se FROM newton""",
        """risk AS (SELECT wt, sum(event)::INTEGER AS d, coalesce(sum(event) FILTER (sex = 'M'), 0)::DOUBLE AS d1,
    sum(count(*)) OVER (ORDER BY wt DESC)::DOUBLE AS n, sum(count(*) FILTER (sex = 'M')) OVER (ORDER BY wt DESC)::DOUBLE AS n1
  FROM pathways GROUP BY wt),
ties AS (SELECT wt, d1 / d AS x, n - n1 - j / d * (d - d1) AS w0, n1 - j / d * d1 AS w1
  FROM (SELECT *, unnest(range(d)) AS j FROM risk WHERE d > 0)),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS beta, 1.0::DOUBLE AS information
  UNION ALL
  SELECT step + 1, beta + gradient / info, info FROM (
    SELECT any_value(step) AS step, any_value(beta) AS beta, sum(x - share) AS gradient, sum(share * (1 - share)) AS info
    FROM (SELECT step, beta, x, w1 * exp(beta) / (w0 + w1 * exp(beta)) AS share FROM ties, newton WHERE step < 8)
    HAVING count(*) > 0))""",
    ).replace("WITH spans", "WITH RECURSIVE spans"),
)
def cox_ph_two_groups(spark, sf_dir):
    rows = m.pathways(spark, sf_dir).select("wt", "event", "sex")
    fit = survival.cox_ph(rows, "wt", "event", "sex", ("F", "M"))
    return fit.select("level", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"))


_TWO_GROUPS = """risk AS (SELECT wt, sum(event)::INTEGER AS d, coalesce(sum(event) FILTER (sex = 'M'), 0)::DOUBLE AS d1,
    sum(count(*)) OVER (ORDER BY wt DESC)::DOUBLE AS n, sum(count(*) FILTER (sex = 'M')) OVER (ORDER BY wt DESC)::DOUBLE AS n1
  FROM rows GROUP BY wt),
ties AS (SELECT wt, d1 / d AS x, n - n1 - j / d * (d - d1) AS w0, n1 - j / d * d1 AS w1
  FROM (SELECT *, unnest(range(d)) AS j FROM risk WHERE d > 0)),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS beta, 1.0::DOUBLE AS information
  UNION ALL
  SELECT step + 1, beta + gradient / info, info FROM (
    SELECT any_value(step) AS step, any_value(beta) AS beta, sum(x - share) AS gradient, sum(share * (1 - share)) AS info
    FROM (SELECT step, beta, x, w1 * exp(beta) / (w0 + w1 * exp(beta)) AS share FROM ties, newton WHERE step < 8)
    HAVING count(*) > 0)),
likelihoods AS (SELECT step, beta, sum(x * beta - ln(w0 + w1 * exp(beta))) AS value FROM ties, newton WHERE step IN (0, 8) GROUP BY 1, 2),
fitted AS (SELECT max(beta) FILTER (step = 8) AS beta, max(value) FILTER (step = 8) AS value, max(value) FILTER (step = 0) AS start FROM likelihoods),
kinds AS (SELECT wt, event, CASE sex WHEN 'M' THEN beta ELSE 0 END AS hazard FROM rows, fitted),
pairs AS (
  SELECT count(*) AS pairs, count(*) FILTER (a.hazard > b.hazard) AS concordant, count(*) FILTER (a.hazard = b.hazard) AS tied
  FROM (SELECT * FROM kinds WHERE event = 1) a JOIN kinds b ON b.wt > a.wt OR (b.wt = a.wt AND b.event = 0))"""


@query(
    "cox_summary",
    with_ctes(
        "pathways",
        """SELECT (SELECT sum(d) FROM risk)::BIGINT AS events, round(value, 4) AS log_likelihood, round(start, 4) AS null_log_likelihood,
  round(2 * (value - start), 4) AS lr_statistic, 1 AS dof, pairs::DOUBLE AS pairs, concordant::DOUBLE AS concordant, tied::DOUBLE AS tied,
  round((concordant + tied / 2) / pairs, 6) AS concordance FROM fitted, pairs""",
        "rows AS (SELECT wt, CAST(event AS INTEGER) AS event, sex FROM pathways WHERE sex IN ('F', 'M')),\n" + _TWO_GROUPS,
    ).replace("WITH spans", "WITH RECURSIVE spans"),
)
def cox_summary(spark, sf_dir):
    """Likelihood-ratio test and concordance of the hazards of two groups."""
    rows = m.pathways(spark, sf_dir).select("wt", "event", "sex")
    found = survival.cox_summary(rows, "wt", "event", "sex", ("F", "M"), p_values=False)
    exact = ("log_likelihood", "null_log_likelihood", "lr_statistic")
    return found.withColumns({c: F.round(c, 4) for c in exact} | {c: F.col(c).cast("double") for c in ("pairs", "concordant", "tied")})


@query(
    "propensity_one_factor",
    with_ctes(
        "pathways observed",
        """SELECT region, round(avg(CAST("group" <> '<= 18 weeks' AS INTEGER)), 6) AS propensity_score, count(*) AS n FROM over GROUP BY 1""",
        use._OVER,
    ),
)
def propensity_one_factor(spark, sf_dir):
    """With one encoded factor the fitted score is the treated share of its level."""
    scored = matching.propensity(_units(spark, sf_dir), "treated", ["region"], one_hot=True)
    return scored.groupBy("region").agg(
        F.max("propensity_score").alias("propensity_score"), F.count("*").alias("n")
    )


_CELL_ERRORS = """cells AS (SELECT activity, "group", time_period, count(*) AS n, avg(avg_weekly_use) AS mean FROM ols_panel GROUP BY 1, 2, 3),
errors AS (SELECT p.activity, p."group", p.time_period, c.n, avg_weekly_use - mean AS e, 1 / c.n AS h
  FROM ols_panel p JOIN cells c ON c.activity = p.activity AND c."group" = p."group" AND c.time_period = p.time_period)"""


@query(
    "did_ols_hc3_base",
    with_ctes(
        "pathways activity observed",
        """SELECT activity AS model, term, round(sqrt(sum(v)), 6) AS se FROM (
  SELECT activity, "group" <> '<= 18 weeks' AS g, time_period = 1 AS t, sum(pow(e / (1 - h), 2)) / pow(any_value(n), 2) AS v
  FROM errors GROUP BY 1, 2, 3)
JOIN (VALUES ('Intercept', false, false), ('group[> 18 weeks]', true, false), ('time_period[1]', false, true),
  ('group[> 18 weeks]:time_period[1]', true, true)) terms(term, of_group, of_time) ON (of_group OR NOT g) AND (of_time OR NOT t)
GROUP BY 1, 2""",
        use._OLS_PANEL + ",\n" + _CELL_ERRORS,
    ),
)
def did_ols_hc3_base(spark, sf_dir):
    """HC3 errors of the saturated group x period regression."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir))
    fit = regress.ols(
        rows, "avg_weekly_use", ["group", "time_period"], interactions=[("group", "time_period")], by="activity", vcov="HC3"
    )
    return fit.table().select("model", "term", "se")


@query(
    "ols_influence_base",
    with_ctes(
        "pathways activity observed",
        """SELECT activity AS model, count(*) AS n, count(*) FILTER (cooks > 4 / total) AS influential, round(max(cooks), 6) AS largest,
  round(any_value(total) * (1 - sum(pow(e * e - cell_square, 2)) / sum(pow(e * e - all_square, 2))), 4) AS statistic, 3 AS dof
FROM (SELECT *, count(*) OVER a AS total, e * e / (4 * (sum(e * e) OVER a / (count(*) OVER a - 4))) * h / pow(1 - h, 2) AS cooks,
    avg(e * e) OVER (PARTITION BY activity, "group", time_period) AS cell_square, avg(e * e) OVER a AS all_square
  FROM errors WINDOW a AS (PARTITION BY activity)) GROUP BY 1""",
        use._OLS_PANEL + ",\n" + _CELL_ERRORS,
    ),
)
def ols_influence_base(spark, sf_dir):
    """Cook's distances and the Breusch-Pagan test of the saturated regression."""
    rows = _ols_rows(use.ols_panel(spark, sf_dir))
    model = regress.ols(rows, "avg_weekly_use", ["group", "time_period"], interactions=[("group", "time_period")], by="activity")
    marked = durable(regress.influence(model, rows, fitted=True))
    kept = regress.drop_influential(model, marked).groupBy("activity").agg(F.count("*").alias("kept"))
    counts = marked.groupBy("activity").agg(F.count("*").alias("n"), F.max("cooks_d").alias("largest")).join(kept, "activity")
    tests = regress.breusch_pagan(model, marked).select("model", F.round("statistic", 4).alias("statistic"), "dof")
    return tests.join(counts.withColumnRenamed("activity", "model"), "model").select(
        "model", "n", (F.col("n") - F.col("kept")).alias("influential"), "largest", "statistic", "dof"
    )


@query(
    "vif_pair",
    with_ctes(
        "pathways",
        """SELECT variable, round(vif, 6) AS vif FROM (
  SELECT count(*) AS n, sum(x)::DOUBLE AS sx, sum(wt)::DOUBLE AS sz, sum(x * x)::DOUBLE AS xx, sum(wt * wt)::DOUBLE AS zz, sum(x * wt)::DOUBLE AS xz,
    1 / (1 - pow(corr(x, wt), 2)) AS v
  FROM (SELECT CAST(sex = 'M' AS INTEGER) AS x, CAST(wt AS BIGINT) AS wt FROM pathways)),
LATERAL (VALUES ('Intercept', n * (xx * zz - xz * xz) / (n * (xx * zz - xz * xz) - sx * (sx * zz - xz * sz) + sz * (sx * xz - xx * sz))),
  ('sex[M]', v), ('wt', v)) t(variable, vif)""",
    ),
)
def vif_pair(spark, sf_dir):
    """Two regressors: one over one minus their squared correlation."""
    rows = durable(m.pathways(spark, sf_dir).select("sex", "wt", "event"))
    return regress.vif(regress.ols(rows, "event", ["sex"], ["wt"])).select("variable", "vif")


def _solve_sql() -> str:
    """Least squares of y on two dummies by Cramer's rule."""
    det = "(n * (gg * ss - gs * gs) - sg * (sg * ss - gs * sm) + sm * (sg * gs - gg * sm))"
    a = "(sy * (gg * ss - gs * gs) - sg * (gy * ss - gs * my) + sm * (gy * gs - gg * my))"
    g = "(n * (gy * ss - gs * my) - sy * (sg * ss - gs * sm) + sm * (sg * my - gy * sm))"
    s = "(n * (gg * my - gs * gy) - sg * (sg * my - gy * sm) + sy * (sg * gs - gg * sm))"
    return f"""SELECT activity AS model, term, round(estimate, 6) AS estimate FROM (
  SELECT activity, count(*)::DOUBLE AS n, sum(g) AS sg, sum(s) AS sm, sum(g * g) AS gg, sum(s * s) AS ss, sum(g * s) AS gs,
    sum(y) AS sy, sum(g * y) AS gy, sum(s * y) AS my
  FROM (SELECT activity, avg_weekly_use AS y, CAST("group" <> '<= 18 weeks' AS DOUBLE) AS g, CAST(sex = 'M' AS DOUBLE) AS s FROM ols_panel) GROUP BY 1),
LATERAL (VALUES ('Intercept', {a} / {det}), ('group[> 18 weeks]', {g} / {det}), ('sex[M]', {s} / {det})) t(term, estimate)"""


@query("ols_two_factors", with_ctes("pathways activity observed", _solve_sql(), use._OLS_PANEL))
def ols_two_factors(spark, sf_dir):
    """Additive regression on group and sex, not saturated."""
    rows = durable(use.ols_panel(spark, sf_dir).select("activity", "group", "sex", "avg_weekly_use"))
    return regress.ols(rows, "avg_weekly_use", ["group", "sex"], by="activity").table().select("model", "term", "estimate")
