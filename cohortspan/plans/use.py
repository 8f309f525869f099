"""Activity before, during and after the wait; difference-in-differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.functions.tails import t_p
from cohortspan.operators import association, cohort, did, effects, periods, utilisation
from cohortspan.plans import solve
from cohortspan.plans.base import query, t_p_sql, unpivot_sql, with_ctes
from cohortspan.session import durable
from cohortspan.sources import mapping as m

SEVEN = m.CHARACTERISTICS
FIVE = ("sex", "age_band", "quintile", "region", "ltc")
MEASURES = m.MEASURES
stack = " UNION ALL ".join
FOUR = "('<= 18 weeks', '19-30 weeks', '31-42 weeks', '> 42 weeks')"
PERIODS = {"3m_before": ("start_date - 91", "start_date - 1"), "waiting_time": ("start_date", "stop_date"), "3m_after": ("stop_date + 1", "stop_date + 91")}


# --- wide utilisation -------------------------------------------------------

_WIDE = (
    "wide AS (SELECT p.*, "
    + ", ".join(f"coalesce({c}_{name}, 0)::BIGINT AS {c}_{name}" for name in PERIODS for c in MEASURES)
    + " FROM pathways p LEFT JOIN (SELECT pathway_id, "
    + ", ".join(
        f"sum({c}) FILTER (day BETWEEN {lo} AND {hi}) AS {c}_{name}" for name, (lo, hi) in PERIODS.items() for c in MEASURES
    )
    + " FROM spans JOIN activity ON activity.pid = spans.pid GROUP BY 1) t ON t.pathway_id = p.pathway_id)"
)
WIDE_KEEP = ("pathway_id", "pid", "start_date", "stop_date", "wt", "group", *SEVEN)


def wide(spark, sf_dir, measures=MEASURES):
    pw = durable(m.pathways(spark, sf_dir).select(*WIDE_KEEP))
    return utilisation.wide_utilisation(pw, m.activity(spark, sf_dir), measures, WIDE_KEEP)


@query(
    "wide_utilisation",
    with_ctes("pathways activity", "SELECT pathway_id, " + ", ".join(f"{c}_{n}" for n in PERIODS for c in MEASURES) + " FROM wide", _WIDE),
)
def wide_utilisation(spark, sf_dir):
    """Use in the 13 weeks before, the wait, the 13 weeks after."""
    return wide(spark, sf_dir).select("pathway_id", *[f"{c}_{n}" for n in PERIODS for c in MEASURES])


_LABELS = {"3m_before": "3m_before", "waiting_time": "while_waiting", "3m_after": "3m_after"}


def _period_stats_sql(table: str) -> str:
    return """SELECT variable, value, utilisation_type, time_period, count(v) AS pathway_count, sum(v)::BIGINT AS sum,
  round(avg(v), 2) AS mean, quantile_disc(v, 0.5) AS median, round(stddev_samp(v), 2) AS stddev,
  quantile_disc(v, 0.75) - quantile_disc(v, 0.25) AS iqr,
  CASE WHEN time_period = 'while_waiting' THEN round(sum(wt) / 7, 2) ELSE CAST(count(v) * 13 AS DOUBLE) END AS pathway_weeks
FROM (""" + stack(
        f"SELECT variable, value, '{c}' AS utilisation_type, '{label}' AS time_period, {c}_{name} AS v, wt FROM {table}"
        for name, label in _LABELS.items()
        for c in MEASURES
    ) + ") GROUP BY 1, 2, 3, 4"


@query(
    "period_stats",
    with_ctes(
        "pathways activity", _period_stats_sql("long"), _WIDE + ",\nlong AS (" + unpivot_sql("wide", SEVEN, "wide.* EXCLUDE (" + ", ".join(SEVEN) + ")") + ")"
    ),
)
def period_stats(spark, sf_dir):
    return utilisation.period_stats(wide(spark, sf_dir), SEVEN, MEASURES, counted=m.USES)


@query(
    "period_stats_by_band",
    with_ctes("pathways activity", _period_stats_sql("long"), _WIDE + ",\nlong AS (" + unpivot_sql("wide", ["group"], "wide.* EXCLUDE (\"group\")").replace("CAST(group", 'CAST("group"') + ")"),
)
def period_stats_by_band(spark, sf_dir):
    """The same statistics by wait band."""
    return utilisation.period_stats(wide(spark, sf_dir), ["group"], MEASURES, counted=m.USES)


_RATE_LABELS = {"3m_before": "3 months before", "waiting_time": "during waiting", "3m_after": "3 months after"}
_LONG_USE = stack(
    f"""SELECT pathway_id, "group", wt, '{c}' AS delivery_point, '{label}' AS time_period, {c}_{name} AS healthcare_utilization FROM wide"""
    for name, label in _RATE_LABELS.items()
    for c in m.USES
)


@query(
    "unpivot_utilisation",
    with_ctes(
        "pathways activity",
        f"SELECT pathway_id, delivery_point, time_period, healthcare_utilization FROM ({_LONG_USE})",
        _WIDE,
    ),
)
def unpivot_utilisation(spark, sf_dir):
    return utilisation.unpivot_utilisation(wide(spark, sf_dir, m.USES), m.USES, ["pathway_id"])


@query(
    "utilisation_rate",
    with_ctes(
        "pathways activity",
        f"""SELECT delivery_point, time_period, "group", sum(healthcare_utilization)::BIGINT AS utilisation,
  sum(days)::BIGINT AS person_days, count(healthcare_utilization) AS n,
  round(sum(healthcare_utilization) / (sum(days) / 7) * 1000, 6) AS rate_per_1000
FROM (SELECT *, CASE WHEN time_period = 'during waiting' THEN wt ELSE 91 END AS days FROM ({_LONG_USE})) GROUP BY 1, 2, 3""",
        _WIDE,
    ),
)
def utilisation_rate(spark, sf_dir):
    return utilisation.utilisation_rate(wide(spark, sf_dir, m.USES), m.USES, ["group"])


# --- samples ----------------------------------------------------------------

_LEFT_OUT = """alive AS (SELECT pathways.* FROM pathways LEFT JOIN exits ON exits.pid = pathways.pid
  WHERE wt > 72 AND (exit_date IS NULL OR exit_date > stop_date + 28 + wt))"""
_SAMPLE = (
    _LEFT_OUT
    + """,
sample AS (SELECT alive.*, wt + 28 + wt AS max_time_covered, stop_date + 28 + wt AS follow_up_end
  FROM alive, observed WHERE stop_date + 28 + wt <= last_day)"""
)
SAMPLE_PARTS = "pathways exits observed"


def alive(spark, sf_dir, facts):
    """Waits over 72 days without an exit up to the end of follow-up."""
    waits = cohort.with_bounds(m.pathways(spark, sf_dir).filter("wt > 72"))
    linked = waits.join(m.exits(spark, sf_dir, facts), "pid", "left")
    return cohort.survived(linked).drop("washout_end", "follow_up_end", "washout_end_days", "follow_up_end_days", "exit_date")


def sample(spark, sf_dir, facts):
    return did.did_sample(alive(spark, sf_dir, facts), periods.own_wait(), m.observed_until(spark, sf_dir, facts))


def panel(spark, sf_dir, keep=did.PANEL_KEYS):
    facts = m.facts(spark, sf_dir)
    # the sample feeds both the days asked for and the rows that ask
    chosen = durable(sample(spark, sf_dir, facts).select(*keep, "periods"))
    return did.did_panel(chosen, facts, MEASURES, keep)


@query(
    "did_sample",
    with_ctes(
        SAMPLE_PARTS,
        """SELECT pathway_id, pid, tfc, "group", wt, max_time_covered, CAST(follow_up_end AS VARCHAR) AS follow_up_end FROM sample
WHERE "group" IN ('<= 18 weeks', '19-30 weeks')""",
        _SAMPLE,
    ),
)
def did_sample(spark, sf_dir):
    """One comparison: the control group and one intervention group."""
    facts = m.facts(spark, sf_dir)
    one = did.did_sample(
        alive(spark, sf_dir, facts), periods.own_wait(), m.observed_until(spark, sf_dir, facts), (did.CONTROL, did.INTERVENTIONS[0])
    )
    return one.select("pathway_id", "pid", "tfc", "group", "wt", "max_time_covered", "follow_up_end")


@query(
    "did_sample_all",
    with_ctes(
        SAMPLE_PARTS,
        """SELECT "group", count(*) AS pathways, count(DISTINCT pid) AS patients, sum(max_time_covered)::BIGINT AS days FROM sample GROUP BY 1""",
        _SAMPLE,
    ),
)
def did_sample_all(spark, sf_dir):
    return sample(spark, sf_dir, m.facts(spark, sf_dir)).groupBy("group").agg(
        F.count("*").alias("pathways"), F.count_distinct("pid").alias("patients"), F.sum("max_time_covered").alias("days")
    )


@query(
    "not_in_did",
    with_ctes(
        SAMPLE_PARTS,
        """SELECT "group", count(*) AS pathways, min(wt) AS shortest, max(wt) AS longest FROM alive ANTI JOIN sample USING (pid, tfc, start_date) GROUP BY 1""",
        _SAMPLE,
    ),
)
def not_in_did(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    rows = durable(alive(spark, sf_dir, facts))
    rest = cohort.not_in(rows, did.did_sample(rows, periods.own_wait(), m.observed_until(spark, sf_dir, facts)))
    return rest.groupBy("group").agg(F.count("*").alias("pathways"), F.min("wt").alias("shortest"), F.max("wt").alias("longest"))


def _long_periods(spec_sql: str, measures=MEASURES) -> str:
    """Totals per pathway and period from a plain range join."""
    sums = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in measures)
    return f"""SELECT s.pathway_id, s.time_period, {sums} FROM ({spec_sql}) s
  LEFT JOIN activity a ON a.pid = s.pid AND a.day BETWEEN s.lo AND s.hi WHERE s.lo <= s.hi GROUP BY 1, 2"""


_FIXED = {
    # days after clock start: (procedure, recovery, follow-up, end of waiting, completeness)
    "fixed": (126, 28, 180, 126, "pathway"),
    "fixed_waiting": (210, 28, 168, 126, "patient"),
}


def _fixed_sql(name: str) -> str:
    procedure, recovery, follow_up, waiting, complete = _FIXED[name]
    end = procedure + recovery + follow_up
    keep = (
        f"start_date + {end} <= last_day"
        if complete == "pathway"
        else f"pid IN (SELECT pid FROM pathways, observed WHERE \"group\" IN {FOUR} AND start_date + {end} <= last_day)"
    )
    base = f"(SELECT pathways.* FROM pathways, observed WHERE \"group\" IN {FOUR} AND {keep})"
    spec = f"""SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, start_date + {waiting - 1} AS hi FROM {base}
  UNION ALL SELECT pathway_id, pid, 100, start_date + {waiting}, start_date + {procedure + recovery - 1} FROM {base}
  UNION ALL SELECT pathway_id, pid, 0, start_date + {max(waiting, procedure + recovery)}, start_date + {end} FROM {base}"""
    return f"SELECT '{name}' AS design, * FROM ({_long_periods(spec, ('use_a', 'cost_a'))})"


_STOP_SQL = f"""SELECT 'stop_date' AS design, * FROM ({_long_periods(f'''
  SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, least(stop_date - 1, start_date + 406) AS hi FROM cut
  UNION ALL SELECT pathway_id, pid, 100, stop_date, least(stop_date + 27, start_date + 406) FROM cut
  UNION ALL SELECT pathway_id, pid, 0, stop_date + 28, start_date + 406 FROM cut''', ('use_a', 'cost_a'))})"""
_INCLUSIVE_SQL = f"""SELECT 'inclusive' AS design, * FROM ({_long_periods(f'''
  SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, stop_date AS hi FROM pathways WHERE "group" IN {FOUR}
  UNION ALL SELECT pathway_id, pid, 100, stop_date + 1, stop_date + 27 FROM pathways WHERE "group" IN {FOUR}
  UNION ALL SELECT pathway_id, pid, 0, stop_date + 28, stop_date + 28 + wt FROM pathways WHERE "group" IN {FOUR}''', ('use_a', 'cost_a'))})"""
_CUT = f"""cut AS (SELECT pathways.* FROM pathways WHERE "group" IN {FOUR} AND pid IN (
  SELECT pid FROM pathways, observed WHERE "group" IN {FOUR} AND start_date + 406 <= last_day))"""


@query(
    "did_sample_fixed",
    with_ctes("pathways activity observed", " UNION ALL ".join([_fixed_sql("fixed"), _fixed_sql("fixed_waiting"), _STOP_SQL, _INCLUSIVE_SQL]), _CUT),
)
def did_sample_fixed(spark, sf_dir):
    """Use per pathway and period in the fixed-cut, stop-date and inclusive designs."""
    specs = {
        name: periods.fixed_cut(procedure, recovery, follow_up, waiting, complete)
        for name, (procedure, recovery, follow_up, waiting, complete) in _FIXED.items()
    }
    specs["stop_date"] = periods.stop_date_cut(210, 28, 168)
    specs["inclusive"] = periods.own_wait_inclusive(28)
    pw = durable(m.pathways(spark, sf_dir).select("pathway_id", "pid", "start_date", "stop_date", "wt", "group"))
    act = m.facts(spark, sf_dir)
    until = m.observed_until(spark, sf_dir, act)
    rows = None
    for name, spec in specs.items():
        part = periods.explode_periods(did.did_sample(pw, spec, until), ["pathway_id", "pid"]).withColumn("design", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    # the designs share one pass over the activity
    totals = periods.interval_totals(rows, act, ["pid"], "lo", "hi", ["use_a", "cost_a"])
    return totals.select("design", "pathway_id", "time_period", "use_a", "cost_a")


_THRESHOLD_SPEC = """SELECT pathway_id, pid, 0 AS time_period, start_date AS lo, least(stop_date, start_date + 85) AS hi FROM over
  UNION ALL SELECT pathway_id, pid, 1, least(stop_date, start_date + 85) + 1, least(stop_date, start_date + 85) + 360 FROM over"""
_OVER = """over AS (SELECT pathways.* EXCLUDE ("group"), CASE WHEN wt <= 126 THEN '<= 18 weeks' ELSE '> 18 weeks' END AS "group"
  FROM pathways, observed WHERE wt > 84 AND least(stop_date, start_date + 85) + 360 <= last_day)"""


def threshold_sample(spark, sf_dir, facts=None, follow_up=360):
    pw = m.pathways(spark, sf_dir).filter("wt > 84").withColumn("group", b.band("wt", b.WAIT_2))
    spec = periods.threshold(85, follow_up, complete="pathway")
    chosen = did.did_sample(pw, spec, m.observed_until(spark, sf_dir, facts), (did.CONTROL, "> 18 weeks"))
    return durable(chosen.select("pathway_id", "pid", "group", "wt", "sex", "region", "ltc", "quintile", "balance", "periods"))


@query(
    "did_sample_threshold",
    with_ctes("pathways activity observed", _long_periods(_THRESHOLD_SPEC), _OVER),
)
def did_sample_threshold(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    rows = periods.period_totals(threshold_sample(spark, sf_dir, facts), facts, MEASURES, ["pathway_id", "pid"])
    return rows.select("pathway_id", "time_period", *MEASURES)


_OLS_PANEL = (
    _OVER
    + f""",
ols_panel AS (SELECT pid, "group", sex, region, ltc, time_period, activity, total_hc_use,
    total_hc_use / 372.0::DOUBLE * 7 AS avg_weekly_use FROM (
  UNPIVOT (SELECT pid, "group", sex, region, ltc, time_period, {', '.join(f'sum({c})::BIGINT AS {c}' for c in MEASURES)}
    FROM ({_long_periods(_THRESHOLD_SPEC)}) t JOIN over USING (pathway_id) GROUP BY 1, 2, 3, 4, 5, 6)
  ON {', '.join(MEASURES)} INTO NAME activity VALUE total_hc_use))"""
)


def ols_panel(spark, sf_dir, facts=None, chosen=None):
    """Of the pathways ``chosen``, or of the whole threshold sample."""
    facts = m.facts(spark, sf_dir) if facts is None else facts
    chosen = threshold_sample(spark, sf_dir, facts) if chosen is None else chosen
    return did.did_ols_panel(chosen, facts, MEASURES, ["sex", "region", "ltc"], (372, 372))


@query(
    "did_ols_panel",
    with_ctes(
        "pathways activity observed",
        """SELECT pid, "group", sex, region, ltc, CAST(time_period AS INTEGER) AS time_period, activity, total_hc_use,
  CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated, round(avg_weekly_use, 6) AS avg_weekly_use FROM ols_panel""",
        _OLS_PANEL,
    ),
)
def did_ols_panel(spark, sf_dir):
    return ols_panel(spark, sf_dir)


# --- panel, totals, estimates ------------------------------------------------

_OWN = """SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, stop_date - 1 AS hi FROM sample
  UNION ALL SELECT pathway_id, pid, 0, stop_date + 28, follow_up_end FROM sample"""
_PANEL = (
    _SAMPLE
    + f""",
panel AS (SELECT pid, tfc, start_date, "group", max_time_covered, t.* FROM ({_long_periods(_OWN)}) t JOIN sample USING (pathway_id)),
long_panel AS (SELECT pid, tfc, start_date, "group", max_time_covered, time_period, activity, v AS total_hc_use,
    v / CAST(max_time_covered AS DOUBLE) * 7 AS avg_weekly_use
  FROM (UNPIVOT panel ON {', '.join(MEASURES)} INTO NAME activity VALUE v)),
compared AS (SELECT c.comparison, long_panel.*, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated FROM long_panel
  JOIN (VALUES ('19-30 weeks'), ('31-42 weeks'), ('> 42 weeks')) c(comparison) ON "group" IN ('<= 18 weeks', c.comparison))"""
)
PANEL_PARTS = SAMPLE_PARTS + " activity"


@query(
    "did_panel",
    with_ctes(
        PANEL_PARTS,
        """SELECT pid, tfc, CAST(start_date AS VARCHAR) AS start_date, "group", max_time_covered, CAST(time_period AS INTEGER) AS time_period,
  CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated, activity, total_hc_use, round(avg_weekly_use, 6) AS avg_weekly_use FROM long_panel""",
        _PANEL,
    ),
)
def did_panel(spark, sf_dir):
    return did.long_panel(panel(spark, sf_dir), MEASURES)


def _totals_sql(rate: bool) -> str:
    def use(treated: int, period: int) -> str:
        return f"sum(total_hc_use) FILTER (treated = {treated} AND time_period = {period})::DOUBLE"

    def weeks(treated: int) -> str:
        return f"(sum(max_time_covered) FILTER (treated = {treated} AND time_period = 0) / 7)"

    def cell(treated: int, period: int) -> str:
        return f"{use(treated, period)} / {weeks(treated)}" if rate else use(treated, period)

    excess = f"({cell(1, 1)} - {cell(1, 0)}) - ({cell(0, 1)} - {cell(0, 0)})"
    return f"""SELECT activity, comparison, round({cell(0, 0)}, 6) AS control_reference_use, round({cell(0, 1)}, 6) AS control_intervention_use,
  round({cell(1, 0)}, 6) AS treated_reference_use, round({cell(1, 1)}, 6) AS treated_intervention_use,
  round({weeks(0)}, 6) AS control_person_weeks, round({weeks(1)}, 6) AS treated_person_weeks,
  count(DISTINCT pid) FILTER (treated = 0 AND time_period = 0) AS control_patients,
  count(DISTINCT pid) FILTER (treated = 1 AND time_period = 0) AS treated_patients,
  round({cell(0, 1)} - {cell(0, 0)}, 6) AS control_excess, round({excess}, 6) AS total_excess
  {f', round(({excess}) * 100 * 4.3, 6) AS excess_per_100_month' if rate else ''}
FROM compared GROUP BY 1, 2"""


@query("did_totals", with_ctes(PANEL_PARTS, _totals_sql(False), _PANEL))
def did_totals(spark, sf_dir):
    return did.did_totals(panel(spark, sf_dir), MEASURES)


@query("did_rates", with_ctes(PANEL_PARTS, _totals_sql(True), _PANEL))
def did_rates(spark, sf_dir):
    return did.did_rates(did.did_totals(panel(spark, sf_dir), MEASURES))


_TWFE = """demeaned AS (SELECT activity, comparison, pid, {y} AS y0,
    {y} - avg({y}) OVER e AS y, treated * time_period - avg(treated * time_period) OVER e AS d, time_period - avg(time_period) OVER e AS p
  FROM compared WINDOW e AS (PARTITION BY activity, comparison, pid)),
sums AS (SELECT activity, comparison, sum(d * d) AS dd, sum(d * p) AS dp, sum(p * p) AS pp, sum(d * y) AS dy, sum(p * y) AS py,
    count(*) AS n_obs, count(DISTINCT pid) AS n_entities FROM demeaned GROUP BY 1, 2),
model AS (SELECT *, (dy * pp - py * dp) / (dd * pp - dp * dp) AS coef, dp / pp AS slope, dd - dp * dp / pp AS d_d FROM sums),
scores AS (SELECT activity, comparison, pid, sum((d - slope * p) * (y - coef * d - (py - coef * dp) / pp * p)) AS score
  FROM demeaned JOIN model USING (activity, comparison) GROUP BY 1, 2, 3),
twfe AS (SELECT activity, comparison, coef, sqrt(n_entities / (n_entities - 1) * ((n_obs - 1) / (n_obs - 3)) * meat) / d_d AS se,
    n_obs, n_entities
  FROM model JOIN (SELECT activity, comparison, sum(score * score) AS meat FROM scores GROUP BY 1, 2) USING (activity, comparison))"""


@query(
    "did_twfe",
    with_ctes(
        PANEL_PARTS,
        """SELECT activity, comparison, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 4) AS t_value,
  round(coef - 1.96 * se, 6) AS ci_low, round(coef + 1.96 * se, 6) AS ci_high, CAST(n_entities - 1 AS DOUBLE) AS dof, n_obs, n_entities,
  round(""" + t_p_sql("coef / se", "(n_entities - 1)") + """, 5) AS p_value FROM twfe""",
        _PANEL + ",\n" + _TWFE.format(y="avg_weekly_use"),
    ),
)
def did_twfe(spark, sf_dir):
    """Weekly use on treated x period with patient and period effects, clustered by patient."""
    fit = did.did_twfe(panel(spark, sf_dir), MEASURES).withColumn("p_value", t_p("t_value", "dof"))
    return fit.withColumns({"t_value": F.round("t_value", 4), "p_value": F.round("p_value", 5)})


@query(
    "did_results",
    with_ctes(
        PANEL_PARTS,
        """SELECT activity, comparison, control_patients, treated_patients, control_reference_use, treated_reference_use,
  control_intervention_use, treated_intervention_use, control_person_weeks, treated_person_weeks, total_excess,
  round(coef, 4) AS coef, round(se, 4) AS se, round(""" + t_p_sql("coef / se", "(n_entities - 1)") + """, 5) AS p_value
FROM totals JOIN twfe USING (activity, comparison)""",
        _PANEL + ",\n" + _TWFE.format(y="total_hc_use") + f",\ntotals AS ({_totals_sql(False)})",
    ),
)
def did_results(spark, sf_dir):
    """The flagship table: all activities and comparisons in one pass."""
    results = did.did_results(panel(spark, sf_dir), MEASURES)
    return results.select(
        "activity", "comparison", "control_patients", "treated_patients", "control_reference_use", "treated_reference_use",
        "control_intervention_use", "treated_intervention_use", "control_person_weeks", "treated_person_weeks", "total_excess",
        F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"), F.round("p_value", 5).alias("p_value"),
    )


@query(
    "did_result_matrix",
    with_ctes(
        PANEL_PARTS,
        "SELECT activity, "
        + ", ".join(f"max(excess_per_100_month) FILTER (comparison = '{c}') AS \"{c}\"" for c in did.INTERVENTIONS)
        + f" FROM ({_totals_sql(True)}) GROUP BY 1",
        _PANEL,
    ),
)
def did_result_matrix(spark, sf_dir):
    return did.result_matrix(did.did_rates(did.did_totals(panel(spark, sf_dir), MEASURES)), "excess_per_100_month")


_BINARY = f"""days AS (SELECT pid, day, {', '.join(f'CAST({c} > 0 AS INTEGER) AS {c}' for c in m.USES)} FROM activity),
half_year AS (SELECT pathways.*, wt + 208 AS covered, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated
  FROM pathways LEFT JOIN exits ON exits.pid = pathways.pid, observed
  WHERE wt > 72 AND (exit_date IS NULL OR exit_date > stop_date + 208) AND stop_date + 208 <= last_day),
compared AS (SELECT comparison, half_year.pid, treated, covered AS max_time_covered, time_period, activity, total_hc_use
  FROM (UNPIVOT ({{totals}}) ON {', '.join(m.USES)} INTO NAME activity VALUE total_hc_use) JOIN half_year USING (pathway_id)
  JOIN (VALUES ('19-30 weeks'), ('31-42 weeks'), ('> 42 weeks')) c(comparison) ON "group" IN ('<= 18 weeks', c.comparison))"""
_BINARY_TOTALS = _long_periods(
    """SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, stop_date - 1 AS hi FROM half_year
  UNION ALL SELECT pathway_id, pid, 0, stop_date + 28, stop_date + 208 FROM half_year""",
    m.USES,
).replace("JOIN activity a", "JOIN days a")


@query("did_binary", with_ctes(PANEL_PARTS, _totals_sql(False), _BINARY.format(totals=_BINARY_TOTALS)))
def did_binary(spark, sf_dir):
    """Six months of follow-up after the washout; days with any use instead of counts."""
    return did.did_totals(binary_panel(spark, sf_dir), m.USES)


def binary_panel(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    spec = periods.own_wait(follow_up=180)
    waits = cohort.with_bounds(m.pathways(spark, sf_dir).filter("wt > 72"), follow_up=180)
    kept = cohort.survived(waits.join(m.exits(spark, sf_dir, facts), "pid", "left")).drop("washout_end", "follow_up_end", "exit_date")
    chosen = durable(did.did_sample(kept, spec, m.observed_until(spark, sf_dir, facts)).select(*did.PANEL_KEYS, "periods"))
    return did.did_panel(chosen, did.binarise(facts, m.USES), m.USES)


_TWO = """two AS (SELECT panel.* EXCLUDE ("group"), CASE WHEN max_time_covered <= 2 * 126 + 28 THEN '<= 18 weeks' ELSE '> 18 weeks' END AS "group"
  FROM panel)"""
_TWO_PARTS = (
    _PANEL.replace("compared AS", "compared_three AS")
    + ",\n"
    + _TWO
    + f""",
compared AS (SELECT '> 18 weeks' AS comparison, activity, pid, max_time_covered, time_period, CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated,
    v AS total_hc_use, v / CAST(max_time_covered AS DOUBLE) * 7 AS avg_weekly_use
  FROM (UNPIVOT two ON {', '.join(MEASURES)} INTO NAME activity VALUE v)),
"""
    + _TWFE.format(y="avg_weekly_use")
    + f",\ntotals AS ({_totals_sql(True)})"
)


@query(
    "did_results_two_groups",
    with_ctes(
        PANEL_PARTS,
        """SELECT activity, comparison, control_patients, treated_patients, control_person_weeks, treated_person_weeks, total_excess,
  excess_per_100_month, round(coef, 5) AS coef, round(se, 5) AS se FROM totals JOIN twfe USING (activity, comparison)""",
        _TWO_PARTS,
    ),
)
def did_results_two_groups(spark, sf_dir):
    """Up to against over 18 weeks, weekly use."""
    results = did.did_results(two_group_panel(spark, sf_dir), MEASURES, "avg_weekly_use", p_values=False, interventions=("> 18 weeks",))
    return results.select(
        "activity", "comparison", "control_patients", "treated_patients", "control_person_weeks", "treated_person_weeks", "total_excess",
        "excess_per_100_month", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"),
    )


def two_group_panel(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    pw = alive(spark, sf_dir, facts).withColumn("group", b.band("wt", b.WAIT_2))
    chosen = did.did_sample(pw, periods.own_wait(), m.observed_until(spark, sf_dir, facts), groups=None)
    return did.did_panel(durable(chosen.select(*did.PANEL_KEYS, "periods")), facts, MEASURES)


_RESULT_COLUMNS = """activity, comparison, control_patients, treated_patients, control_reference_use, treated_reference_use,
  control_intervention_use, treated_intervention_use, control_person_weeks, treated_person_weeks, total_excess"""


def _result_table(results, digits, *more):
    named = [c.strip() for c in _RESULT_COLUMNS.split(",")]
    return results.select(*named, *more, F.round("coef", digits).alias("coef"), F.round("se", digits).alias("se"))


@query(
    "did_results_averages",
    with_ctes(
        PANEL_PARTS,
        f"""SELECT {_RESULT_COLUMNS}, excess_per_100_month, round(coef, 5) AS coef, round(se, 5) AS se
FROM totals JOIN twfe USING (activity, comparison)""",
        _PANEL + ",\n" + _TWFE.format(y="avg_weekly_use") + f",\ntotals AS ({_totals_sql(True)})",
    ),
)
def did_results_averages(spark, sf_dir):
    """Use per person-week of the three comparisons, with estimates of weekly use."""
    results = did.did_results(panel(spark, sf_dir), MEASURES, "avg_weekly_use", p_values=False)
    return _result_table(results, 5, "excess_per_100_month")


@query(
    "did_results_binary",
    with_ctes(
        PANEL_PARTS,
        f"""SELECT {_RESULT_COLUMNS}, round(coef, 4) AS coef, round(se, 4) AS se FROM totals JOIN twfe USING (activity, comparison)""",
        _BINARY.format(totals=_BINARY_TOTALS) + ",\n" + _TWFE.format(y="total_hc_use") + f",\ntotals AS ({_totals_sql(False)})",
    ),
)
def did_results_binary(spark, sf_dir):
    """Days with any use, six months of follow-up, totals with estimates."""
    return _result_table(did.did_results(binary_panel(spark, sf_dir), m.USES, p_values=False), 4)


@query(
    "did_results_two_groups_totals",
    with_ctes(
        PANEL_PARTS,
        f"""SELECT {_RESULT_COLUMNS}, round(coef, 4) AS coef, round(se, 4) AS se FROM totals JOIN twfe USING (activity, comparison)""",
        _TWO_PARTS.replace(_TWFE.format(y="avg_weekly_use"), _TWFE.format(y="total_hc_use")).replace(_totals_sql(True), _totals_sql(False)),
    ),
)
def did_results_two_groups_totals(spark, sf_dir):
    """Up to against over 18 weeks, totals with estimates."""
    return _result_table(did.did_results(two_group_panel(spark, sf_dir), MEASURES, p_values=False, interventions=("> 18 weeks",)), 4)


_ERRORS = """rows AS (SELECT demeaned.*, model.coef, (py - coef * dp) / pp AS gamma, slope, d_d, n_obs, n_entities
  FROM demeaned JOIN model USING (activity, comparison))"""


def _twfe_error_sql(variance: str) -> str:
    return f"""SELECT activity, comparison, round(any_value(coef), 6) AS coef, round(sqrt({variance}), 6) AS se FROM rows GROUP BY 1, 2"""


@query(
    "did_twfe_iid",
    with_ctes(
        PANEL_PARTS,
        _twfe_error_sql("sum(pow(y - coef * d - gamma * p, 2)) / (any_value(n_obs) - any_value(n_entities) - 2) / any_value(d_d)"),
        _PANEL + ",\n" + _TWFE.format(y="avg_weekly_use") + ",\n" + _ERRORS,
    ),
)
def did_twfe_iid(spark, sf_dir):
    """The estimate with classical errors."""
    return did.did_twfe(panel(spark, sf_dir), MEASURES, vcov="iid").select("activity", "comparison", "coef", "se")


@query(
    "did_twfe_hc1",
    with_ctes(
        PANEL_PARTS,
        _twfe_error_sql(
            "any_value(n_obs) / (any_value(n_obs) - any_value(n_entities) - 2)"
            " * sum(pow((d - slope * p) * (y - coef * d - gamma * p), 2)) / pow(any_value(d_d), 2)"
        ),
        _PANEL + ",\n" + _TWFE.format(y="avg_weekly_use") + ",\n" + _ERRORS,
    ),
)
def did_twfe_hc1(spark, sf_dir):
    """The estimate with heteroscedasticity-robust errors."""
    return did.did_twfe(panel(spark, sf_dir), MEASURES, vcov="HC1").select("activity", "comparison", "coef", "se")


@query(
    "did_panel_own_period",
    with_ctes(
        PANEL_PARTS,
        """SELECT pid, tfc, CAST(start_date AS VARCHAR) AS start_date, CAST(time_period AS INTEGER) AS time_period, activity,
  round(total_hc_use / CAST(CASE WHEN time_period = 1 THEN max_time_covered - wt - 28 ELSE wt + 1 END AS DOUBLE) * 7, 6) AS avg_weekly_use
FROM (SELECT long_panel.*, (max_time_covered - 28) // 2 AS wt FROM long_panel)""",
        _PANEL,
    ),
)
def did_panel_own_period(spark, sf_dir):
    """Weekly use with each period divided by its own days."""
    long = did.long_panel(panel(spark, sf_dir, (*did.PANEL_KEYS,)), MEASURES, denominator="period")
    return long.select("pid", "tfc", "start_date", "time_period", "activity", "avg_weekly_use")


@query(
    "did_ols_panel_pathway",
    with_ctes(
        "pathways activity observed",
        f"""SELECT pathway_id, "group", sex, region, CAST(time_period AS INTEGER) AS time_period, activity, v AS total_hc_use,
  CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated, round(v / CASE WHEN time_period = 0 THEN 85.0::DOUBLE ELSE 600.0::DOUBLE END * 7, 6) AS avg_weekly_use
FROM (UNPIVOT ({_long_periods(_THRESHOLD_SPEC.replace("360", "600"))}) ON {', '.join(MEASURES)} INTO NAME activity VALUE v)
JOIN (SELECT pathway_id, "group", sex, region FROM over) USING (pathway_id)""",
        _OVER.replace("360", "600"),
    ),
)
def did_ols_panel_pathway(spark, sf_dir):
    """Pathway grain, 600 days after the threshold, each period over its own days."""
    facts = m.facts(spark, sf_dir)
    return did.did_ols_panel(
        threshold_sample(spark, sf_dir, facts, 600), facts, MEASURES, ["sex", "region"], (85, 600), grain=["pathway_id"]
    )


@query(
    "excess_usage",
    with_ctes(
        "pathways activity",
        "SELECT activity, comparison, "
        + ", ".join(
            f"{expr} AS {name}"
            for name, expr in {
                "after_difference": "t0 - c0",
                "waiting_difference": "t1 - c1",
                "excess_usage": "t1 - c1 - (t0 - c0)",
            }.items()
        )
        + """ FROM (SELECT activity, comparison, """
        + ", ".join(
            f"(sum(v) FILTER (\"group\" {op} '<= 18 weeks' AND time_period = {p}))::DOUBLE AS {s}{p}"
            for s, op in (("c", "="), ("t", "<>"))
            for p in (0, 1)
        )
        + f""" FROM (UNPIVOT (SELECT * FROM ({_long_periods(f'''
  SELECT pathway_id, pid, 1 AS time_period, start_date AS lo, stop_date AS hi FROM pathways WHERE "group" IN {FOUR}
  UNION ALL SELECT pathway_id, pid, 0, stop_date + 28, stop_date + 28 + wt FROM pathways WHERE "group" IN {FOUR}''')}))
  ON {', '.join(MEASURES)} INTO NAME activity VALUE v) JOIN (SELECT pathway_id, "group" FROM pathways) USING (pathway_id)
  JOIN (VALUES ('19-30 weeks'), ('31-42 weeks'), ('> 42 weeks')) c(comparison) ON "group" IN ('<= 18 weeks', c.comparison)
  GROUP BY 1, 2)""",
    ),
)
def excess_usage(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    chosen = did.did_sample(m.pathways(spark, sf_dir), periods.own_wait_inclusive(), m.observed_until(spark, sf_dir, facts))
    chosen = durable(chosen.select(*did.PANEL_KEYS, "periods"))
    return did.excess_usage(did.did_panel(chosen, facts, MEASURES), MEASURES)


_HISTORY = f"""history AS (SELECT s."group", s.pid, s.period, s.pathway_id, CAST(s.hi - s.lo + 1 AS BIGINT) AS days, coalesce(sum(use_a), 0)::BIGINT AS use_a
  FROM (SELECT pathway_id, "group", pid, period, greatest(lo, first_day) AS lo, least(hi, last_day) AS hi FROM (
      SELECT pathway_id, "group", pid, 'baseline' AS period, start_date - 60 AS lo, start_date - 30 AS hi FROM pathways
      UNION ALL SELECT pathway_id, "group", pid, 'waiting', start_date, stop_date FROM pathways
      UNION ALL SELECT pathway_id, "group", pid, 'washout', stop_date, stop_date + 42 FROM pathways
      UNION ALL SELECT pathway_id, "group", pid, 'post_operation', stop_date + 43, stop_date + 42 + wt FROM pathways), observed) s
  LEFT JOIN activity a ON a.pid = s.pid AND a.day BETWEEN s.lo AND s.hi WHERE s.lo <= s.hi GROUP BY ALL)"""


def history(spark, sf_dir, measure="use_a"):
    facts = m.facts(spark, sf_dir)
    seen = (m.observed_from(spark, sf_dir, facts), m.observed_until(spark, sf_dir, facts))
    pw = durable(m.pathways(spark, sf_dir).select("pathway_id", "pid", "group", "start_date", "stop_date", "wt"))
    return utilisation.history_totals(pw, facts, measure, ["pathway_id", "pid", "group"], seen)


def per_measure(name, parts, body, more=""):
    """Register a query for the first measure and, with the suffix ``_second``, for another."""

    def add(run):
        for suffix, measure in (("", "use_a"), ("_second", "use_n")):
            sql = with_ctes(parts, body.replace("use_a", measure), more.replace("use_a", measure))
            query(name + suffix, sql)(lambda spark, sf_dir, measure=measure: run(spark, sf_dir, measure))
        return run

    return add


@per_measure(
    "period_utilisation",
    "pathways activity observed",
    """SELECT "group", period, sum(use_a)::BIGINT AS total_use, count(DISTINCT pid) AS patients,
  round(sum(use_a) / count(DISTINCT pid), 6) AS per_patient FROM history GROUP BY 1, 2""",
    _HISTORY,
)
def period_utilisation(spark, sf_dir, measure):
    return utilisation.period_utilisation(history(spark, sf_dir, measure), measure)


@per_measure(
    "person_week_rates",
    "pathways activity observed",
    """SELECT "group", period, group_size, round(total, 6) AS total_weekly_contact, round(total / group_size, 6) AS avg_weekly_contact_per_person
FROM (SELECT "group", period, sum(weekly) AS total FROM (
    SELECT "group", pid, period, sum(use_a) / (sum(days) / 7) AS weekly FROM history GROUP BY 1, 2, 3) GROUP BY 1, 2)
JOIN (SELECT "group", count(DISTINCT pid) AS group_size FROM history GROUP BY 1) USING ("group")""",
    _HISTORY,
)
def person_week_rates(spark, sf_dir, measure):
    return utilisation.person_week_rates(history(spark, sf_dir, measure), measure)


@per_measure(
    "baseline_use",
    "spans activity",
    """SELECT pathway_id, pid, baseline_use FROM spans JOIN (
  SELECT s.pid, coalesce(sum(use_a), 0)::BIGINT AS baseline_use FROM spans s
  LEFT JOIN activity a ON a.pid = s.pid AND a.day BETWEEN s.start_date - 60 AND s.start_date - 30 GROUP BY 1) USING (pid)""",
)
def baseline_use(spark, sf_dir, measure):
    rows = durable(m.spans(spark, sf_dir).select("pathway_id", "pid", "start_date"))
    return utilisation.baseline_use(rows, m.activity(spark, sf_dir), measure, ["pathway_id", "pid"])


@per_measure(
    "binned_activity",
    "pathways activity",
    """SELECT "group", CAST(bin AS INTEGER) AS bin, sum(coalesce(use_a, 0))::BIGINT AS total_use FROM (
  SELECT p."group", p.pid, p.start_date, p.stop_date, b.bin FROM pathways p, range(0, 200) b(bin) WHERE b.bin * 30 <= p.wt) s
LEFT JOIN activity a ON a.pid = s.pid AND a.day BETWEEN start_date AND stop_date AND (a.day - start_date) // 30 = bin GROUP BY 1, 2""",
)
def binned_activity(spark, sf_dir, measure):
    """Use during the wait in bins of 30 days."""
    pw = durable(m.pathways(spark, sf_dir).select("pid", "group", "start_date", "stop_date"))
    return utilisation.binned_activity(pw, m.activity(spark, sf_dir), measure, 30, F.col("stop_date"))


@query(
    "placebo_panel",
    with_ctes(
        PANEL_PARTS,
        f"""SELECT pid, "group", max_time_covered, CAST(placebo_period AS INTEGER) AS placebo_period, {', '.join(f'sum({c})::BIGINT AS {c}' for c in MEASURES)},
  CAST("group" <> '<= 18 weeks' AS INTEGER) AS treated
FROM (SELECT pathway_id, time_period AS placebo_period, {', '.join(MEASURES)} FROM ({_long_periods('''
    SELECT pathway_id, pid, 0 AS time_period, stop_date + 28 AS lo, start_date + CAST(floor(wt * 1.5) AS INTEGER) AS hi FROM sample
    UNION ALL SELECT pathway_id, pid, 1, start_date + CAST(floor(wt * 1.5) AS INTEGER) + 1, follow_up_end FROM sample''')})) t
JOIN (SELECT pathway_id, pid, "group", max_time_covered FROM sample) USING (pathway_id) GROUP BY 1, 2, 3, 4""",
        _SAMPLE,
    ),
)
def placebo_panel(spark, sf_dir):
    facts = m.facts(spark, sf_dir)
    chosen = did.did_sample(alive(spark, sf_dir, facts), periods.placebo(), m.observed_until(spark, sf_dir, facts))
    chosen = durable(chosen.select("pid", "group", "max_time_covered", "periods"))
    return did.placebo_panel(chosen, facts, MEASURES)


def _weekly_sql(measure: str, lo: str, days: str) -> str:
    return f"""weekly AS (SELECT *, use / ({days} / 7) AS weekly_use FROM (
  SELECT sex, age_band, quintile, region, ltc, s.pid, tfc, start_date, wt, coalesce(sum({measure}), 0)::BIGINT AS use FROM sample s
  LEFT JOIN activity a ON a.pid = s.pid AND a.day BETWEEN {lo} AND follow_up_end GROUP BY ALL)),
labelled AS (SELECT *, CASE WHEN weekly_use >= (SELECT quantile_disc(weekly_use, 0.9) FROM weekly) THEN 'Top 10%' ELSE 'Bottom 90%' END AS usage_group
  FROM weekly)"""


_WEEKLY = _weekly_sql("use_a", "start_date", "wt")
_HIGH = f"""SELECT variable, value, count(*) AS total, count(*) FILTER (usage_group = 'Bottom 90%') AS bottom_90,
  count(*) FILTER (usage_group = 'Top 10%') AS top_10,
  round(count(*) FILTER (usage_group = 'Bottom 90%') / count(*) * 100, 6) AS bottom_90_percentage,
  round(count(*) FILTER (usage_group = 'Top 10%') / count(*) * 100, 6) AS top_10_percentage
FROM ({unpivot_sql('labelled', FIVE, 'usage_group')}) GROUP BY 1, 2"""


def labelled_users(spark, sf_dir, measure="use_a", after=False):
    """Weekly use over wait, washout and after period, or the after period alone; the top tenth labelled."""
    facts = m.facts(spark, sf_dir)
    keep = [*FIVE, "pid", "tfc", "start_date", "wt"]
    lo = F.date_add("stop_date", 28) if after else F.col("start_date")
    rows = durable(sample(spark, sf_dir, facts).select(*keep, lo.alias("lo"), F.col("follow_up_end").alias("hi")))
    totals = periods.interval_totals(rows, facts, ["pid"], "lo", "hi", [measure])
    return association.high_users(association.weekly_use(totals, measure, [k for k in keep if k != "wt"]))


@query("high_users", with_ctes(PANEL_PARTS, _HIGH, _SAMPLE + ",\n" + _WEEKLY))
def high_users(spark, sf_dir):
    return association.high_user_table(labelled_users(spark, sf_dir), FIVE)


@query("high_users_second_measure", with_ctes(PANEL_PARTS, _HIGH, _SAMPLE + ",\n" + _weekly_sql("use_n", "start_date", "wt")))
def high_users_second_measure(spark, sf_dir):
    return association.high_user_table(labelled_users(spark, sf_dir, "use_n"), FIVE)


@query("high_users_after", with_ctes(PANEL_PARTS, _HIGH, _SAMPLE + ",\n" + _weekly_sql("use_a", "stop_date + 28", "wt")))
def high_users_after(spark, sf_dir):
    """Weekly use in the after period alone, which is as long as the wait."""
    return association.high_user_table(labelled_users(spark, sf_dir, after=True), FIVE)


# --- two-way effects by alternating projections -------------------------------


@query(
    "did_projections",
    with_ctes(
        PANEL_PARTS,
        """SELECT activity AS outcome, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 4) AS t_value, n_obs, n_entities, 2 AS n_periods
FROM twfe WHERE comparison = '> 42 weeks'""",
        _PANEL + ",\n" + _TWFE.format(y="avg_weekly_use"),
    ),
)
def did_projections(spark, sf_dir):
    """The estimate of the longest waits a second way; :func:`did_twfe` has the closed form of two periods."""
    rows = panel(spark, sf_dir).filter(F.col("group").isin(did.CONTROL, "> 42 weeks"))
    weekly = {c: F.col(c).cast("double") / F.col("max_time_covered") * 7 for c in MEASURES}
    rows = rows.withColumns({**weekly, "d": F.col("treated") * F.col("time_period")})
    return effects.two_way_effects(rows, MEASURES, "d").drop("rounds").withColumn("t_value", F.round("t_value", 4))


_YEARS = range(1996, 2002)
_YEARLY = """yearly AS (SELECT pid, year(day) AS y, sum(use_a) AS use_a, sum(use_n) AS use_n, sum(use_r) AS use_r FROM activity GROUP BY 1, 2),
started AS (SELECT pid, year(start_date) AS y, count(*) AS started FROM spans GROUP BY 1, 2),
patient_years AS (SELECT yearly.*, coalesce(started, 0) AS started FROM yearly LEFT JOIN started ON started.pid = yearly.pid AND started.y = yearly.y),
outcomes AS (""" + stack(
    f"SELECT '{c}' AS outcome, pid, y, started::DOUBLE AS x, {c}::DOUBLE AS use FROM patient_years" for c in m.USES
) + """),
freed AS MATERIALIZED (SELECT outcome, pid, x - avg(x) OVER e AS x, use - avg(use) OVER e AS use, """ + ", ".join(
    f"(y = {y})::DOUBLE - avg((y = {y})::DOUBLE) OVER e AS d{y}" for y in _YEARS
) + " FROM outcomes WINDOW e AS (PARTITION BY outcome, pid)),\n"
_FREED = ["x", *[f"d{y}" for y in _YEARS]]


@query(
    "use_by_year_effects",
    with_ctes(
        "spans activity",
        f"""SELECT outcome, round(coef, 6) AS coef, round(sqrt(n_entities / (n_entities - 1) * (n_obs - 1) / (n_obs - n_periods - 1) * meat), 6) AS se,
  n_obs, n_entities, n_periods
FROM (SELECT model AS outcome, beta AS coef FROM f_beta WHERE i = 0)
JOIN (SELECT outcome, count(*) AS n_obs, count(DISTINCT pid) AS n_entities, CAST(count(DISTINCT y) AS INTEGER) AS n_periods FROM outcomes GROUP BY 1) USING (outcome)
JOIN (SELECT outcome, sum(score * score) AS meat FROM (
  SELECT r.outcome, r.pid, sum(z.z * (r.use - f.fitted)) AS score FROM freed r
  JOIN f_fit f ON f.model = r.outcome AND f.x = [{", ".join(f"r.{c}" for c in _FREED)}]
  JOIN f_z z ON z.model = f.model AND z.x = f.x AND z.i = 0 GROUP BY 1, 2) GROUP BY 1) USING (outcome)""",
        _YEARLY + solve.least_squares("f", "freed", _FREED, "use", "outcome"),
    ),
)
def use_by_year_effects(spark, sf_dir):
    """Use in a calendar year on the pathways started in it, with patient and year effects; years without use are absent."""
    yearly = m.activity(spark, sf_dir).groupBy("pid", F.year("day").alias("y")).agg(*[F.sum(c).alias(c) for c in m.USES])
    started = m.spans(spark, sf_dir).groupBy("pid", F.year("start_date").alias("y")).agg(F.count("*").alias("started"))
    rows = yearly.join(started, ["pid", "y"], "left").na.fill(0, ["started"])
    return effects.two_way_effects(rows, m.USES, "started", period="y").drop("rounds", "t_value")
