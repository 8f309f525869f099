"""Distribution, length, outcome and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.operators import cohort, events, suppress, tables
from cohortspan.plans.base import case_sql, query, unpivot_sql, with_ctes
from cohortspan.sources import mapping as m

SEVEN = m.CHARACTERISTICS
SIX = SEVEN[1:]
WAIT_LABELS = b.WAIT_4.labels
GROUP_LABELS = b.WAIT_5.labels
PAIRS = (
    ("specialty", "sex"),
    ("specialty", "age_band"),
    ("specialty", "quintile"),
    ("specialty", "region"),
    ("sex", "age_band"),
    ("age_band", "quintile"),
    ("region", "quintile"),
    ("frailty", "ltc"),
)
PCT = "round(n / total_count * 100, 2) AS percentage"


def _distribution_sql(grain: str, band: str, within: str, source: str = "pathways") -> str:
    """Counts and percentages after an optional reduction to distinct rows."""
    variables = SEVEN if not grain else SIX
    base = source if not grain else f"(SELECT DISTINCT {', '.join(variables)}, {grain}, {band} FROM {source})"
    return f"""SELECT variable, value, {band}, n, total_count, {PCT} FROM (
  SELECT variable, value, {band}, count(*) AS n, sum(count(*)) OVER (PARTITION BY {within})::BIGINT AS total_count
  FROM ({unpivot_sql(base, variables, band)}) GROUP BY 1, 2, 3)"""


@query("band_distribution", with_ctes("pathways", _distribution_sql("", "wait_band", "variable, value")))
def band_distribution(spark, sf_dir):
    return tables.band_distribution(m.pathways(spark, sf_dir), SEVEN, "wait_band")


def _wide_sql() -> str:
    cells = ", ".join(
        f"""coalesce(max(n) FILTER (wait_band = '{label}'), 0)::BIGINT AS "{label}_count",
  coalesce(max(percentage) FILTER (wait_band = '{label}'), 0) AS "{label}_percentage\""""
        for label in WAIT_LABELS
    )
    return f"SELECT variable, value, total_count, {cells} FROM ({_distribution_sql('', 'wait_band', 'variable, value')}) GROUP BY 1, 2, 3"


@query("band_distribution_wide", with_ctes("pathways", _wide_sql()))
def band_distribution_wide(spark, sf_dir):
    return tables.band_distribution(m.pathways(spark, sf_dir), SEVEN, "wait_band", bands=WAIT_LABELS)


@query(
    "band_distribution_cross",
    with_ctes(
        "pathways",
        f"""SELECT *, {PCT} FROM (SELECT first_variable, second_variable, first_value, second_value, wait_band, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY first_variable, second_variable, first_value, second_value)::BIGINT AS total_count FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{x}' AS first_variable, '{y}' AS second_variable, coalesce({x}, 'unknown') AS first_value,
  coalesce({y}, 'unknown') AS second_value, wait_band FROM pathways"""
            for x, y in PAIRS
        )
        + ") GROUP BY 1, 2, 3, 4, 5)",
    ),
)
def band_distribution_cross(spark, sf_dir):
    return tables.cross_distribution(m.pathways(spark, sf_dir), PAIRS, "wait_band")


_LENGTH = """round(avg(wt), 2) AS mean, CAST(quantile_disc(wt, 0.5) AS DOUBLE) AS median, round(stddev_samp(wt), 2) AS sd,
  CAST(quantile_disc(wt, 0.75) - quantile_disc(wt, 0.25) AS DOUBLE) AS iqr"""


@query(
    "length_stats",
    with_ctes("pathways", f"SELECT variable, value, {_LENGTH} FROM ({unpivot_sql('pathways', SEVEN, 'wt')}) GROUP BY 1, 2"),
)
def length_stats(spark, sf_dir):
    return tables.length_stats(m.pathways(spark, sf_dir), "wt", SEVEN)


@query(
    "length_stats_cross",
    with_ctes(
        "pathways",
        f"""SELECT specialty, age_band, mean, median, sd, iqr, CASE WHEN mean < 5 THEN NULL ELSE mean END AS mean_shown FROM (
  SELECT specialty, coalesce(age_band, 'unknown') AS age_band, {_LENGTH} FROM pathways GROUP BY 1, 2)""",
    ),
)
def length_stats_cross(spark, sf_dir):
    stats = tables.length_stats_by(m.pathways(spark, sf_dir), "wt", ["specialty", "age_band"])
    shown = suppress.suppress(stats, stats=["mean"], mode="stat")
    return shown.select(
        "specialty", "age_band", "mean", "median", "sd", "iqr",
        F.expr("try_cast(mean_text as double)").alias("mean_shown"),
    )


_TESTS = {
    "treatment_admitted": "status = 30 AND contains(change_type, 'IRTT')",
    "treatment_non_admitted": "status = 30 AND NOT contains(change_type, 'IRTT')",
    "non_treatment_monitoring": "status IN (31, 32)",
    "non_treatment_patient_declines": "status = 35",
    "non_treatment_decision_not_to_treat": "status = 34",
    "non_treatment_dna": "status = 33",
    "non_treatment_other": "status NOT IN (30, 31, 32, 33, 34, 35, 36, 99)",
    "non_treatment_death": "status = 36",
    "null": "status = 99",
    "null_imputed_end": "status = 99 AND end_type = 'week_end_date'",
}


@query(
    "outcome_table",
    with_ctes(
        "pathways",
        "SELECT variable, value, count(*) AS total_count, "
        + ", ".join(
            f"count(*) FILTER ({t}) AS count_{n}, round(count(*) FILTER ({t}) / count(*) * 100, 2) AS percentage_{n}"
            for n, t in _TESTS.items()
        )
        + f" FROM ({unpivot_sql('pathways', SEVEN, 'status, change_type, end_type')}) GROUP BY 1, 2",
    ),
)
def outcome_table(spark, sf_dir):
    return tables.outcome_table(m.pathways(spark, sf_dir), SEVEN)


@query(
    "characteristics_row_pct",
    with_ctes("pathways", _distribution_sql("pid, tfc, start_date", '"group"', "variable, value")),
)
def characteristics_row_pct(spark, sf_dir):
    return tables.band_distribution(m.pathways(spark, sf_dir), SIX, "group", "value", grain=cohort.PATHWAY)


@query("characteristics_col_pct", with_ctes("pathways", _distribution_sql("pid", '"group"', 'variable, "group"')))
def characteristics_col_pct(spark, sf_dir):
    return tables.band_distribution(m.pathways(spark, sf_dir), SIX, "group", "band", grain=["pid"])


@query(
    "characteristics_pathway_col_pct",
    with_ctes("pathways", _distribution_sql("pid, tfc, start_date", '"group"', 'variable, "group"')),
)
def characteristics_pathway_col_pct(spark, sf_dir):
    return tables.band_distribution(m.pathways(spark, sf_dir), SIX, "group", "band", grain=cohort.PATHWAY)


@query(
    "band_report",
    with_ctes(
        "spans",
        f"""SELECT band, n, total_count, {PCT}, CASE WHEN n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS n_text FROM (
  SELECT {case_sql('wt', b.WAIT_GRANULAR)} AS band, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total_count
  FROM (SELECT DISTINCT pid, tfc, start_date, wt FROM spans) GROUP BY 1)""",
    ),
)
def band_report(spark, sf_dir):
    banded = m.spans(spark, sf_dir).withColumn("band", b.band("wt", b.WAIT_GRANULAR))
    report = tables.band_report(banded, "band", ["pid", "tfc", "start_date", "wt"])
    return suppress.suppress(report, [("n", "percentage")]).drop("percentage_text")


_SUPPRESSED = f"""SELECT specialty, age_band, band, n, total_count, {PCT} FROM (
  SELECT specialty, age_band, {case_sql('wt', b.WAIT_GRANULAR)} AS band, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY specialty, age_band)::BIGINT AS total_count FROM pathways GROUP BY 1, 2, 3)"""


@query(
    "suppressed_table",
    with_ctes(
        "pathways",
        f"""SELECT specialty, age_band, band, n, total_count, percentage, (n < 5) AS small,
  CASE WHEN n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS n_text, CASE WHEN percentage < 5 THEN NULL ELSE percentage END AS percentage_shown,
  (n < 5) OR (sum(CAST(n < 5 AS INTEGER)) OVER (PARTITION BY specialty, age_band) = 1
    AND row_number() OVER (PARTITION BY specialty, age_band ORDER BY n, band) = 2) AS suppressed
FROM ({_SUPPRESSED})""",
    ),
)
def suppressed_table(spark, sf_dir):
    banded = m.pathways(spark, sf_dir).withColumn("band", b.band("wt", b.WAIT_GRANULAR))
    cells = tables.proportion_by(banded, ["specialty", "age_band", "band"], ["specialty", "age_band"]).withColumn(
        "percentage", F.round(F.col("proportion") * 100, 2)
    )
    flagged = suppress.secondary_flag(cells, ["specialty", "age_band"], tie="band")
    shown = suppress.suppress(flagged, [("n", "percentage")], mode="independent")
    return shown.select(
        "specialty", "age_band", "band", "n", "total_count", "percentage", "n_text", "suppressed",
        (F.col("n_text") == "<5").alias("small"), F.expr("try_cast(percentage_text as double)").alias("percentage_shown"),
    )


@query(
    "suppressed_rows",
    with_ctes(
        "pathways",
        f"""SELECT specialty, age_band, band, CASE WHEN total_count < 25 OR n < 25 THEN '<25' ELSE CAST(n AS VARCHAR) END AS n_text,
  CASE WHEN total_count < 25 OR n < 25 THEN NULL ELSE percentage END AS percentage_shown,
  CASE WHEN total_count < 25 THEN '<25' ELSE CAST(total_count AS VARCHAR) END AS total_count_text
FROM ({_SUPPRESSED})""",
    ),
)
def suppressed_rows(spark, sf_dir):
    """A small row total hides its whole row."""
    banded = m.pathways(spark, sf_dir).withColumn("band", b.band("wt", b.WAIT_GRANULAR))
    cells = tables.proportion_by(banded, ["specialty", "age_band", "band"], ["specialty", "age_band"]).withColumn(
        "percentage", F.round(F.col("proportion") * 100, 2)
    )
    shown = suppress.suppress(cells, [("n", "percentage")], k=25, mode="row", total="total_count")
    return shown.select(
        "specialty", "age_band", "band", "n_text", F.expr("try_cast(percentage_text as double)").alias("percentage_shown"), "total_count_text"
    )


_LAYOUT = {
    "sex": ("M", "F"),
    "age_band": ("11-17", "18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75-84", "84+"),
    "quintile": ("1", "2", "3", "4", "5", "unknown"),
    "frailty": ("Fit", "Mild", "Moderate", "Severe", "unknown"),
    "ltc": ("No LTCs", "Single LTC", "Comorbidities", "Multimorbidities", "unknown"),
}
_LAYOUT_ROWS = []
for _variable, _values in _LAYOUT.items():
    _LAYOUT_ROWS += [(_variable, None), *((_variable, v) for v in _values)]
_FOUR = GROUP_LABELS[1:]


@query(
    "report_layout",
    with_ctes(
        "pathways",
        """SELECT ord, variable, coalesce(value, variable) AS label, coalesce(CAST(total AS VARCHAR), '') AS total, """
        + ", ".join(f"coalesce(CAST(g{i} AS VARCHAR), '') AS g{i}" for i in range(4))
        + " FROM layout LEFT JOIN (SELECT variable, value, count(*) AS total, "
        + ", ".join(f"count(*) FILTER (\"group\" = '{g}') AS g{i}" for i, g in enumerate(_FOUR))
        + " FROM ("
        + unpivot_sql("(SELECT * FROM pathways WHERE wt > 72)", tuple(_LAYOUT), '"group"')
        + ") GROUP BY 1, 2) USING (variable, value) WHERE value IS NULL OR total IS NOT NULL",
        "layout(ord, variable, value) AS (VALUES "
        + ", ".join(f"({i}, '{v}', {'NULL' if x is None else chr(39) + x + chr(39)})" for i, (v, x) in enumerate(_LAYOUT_ROWS))
        + ")",
    ),
)
def report_layout(spark, sf_dir):
    long = tables.unpivot_variables(m.pathways(spark, sf_dir).filter("wt > 72"), tuple(_LAYOUT), ["group"])
    counted = long.groupBy("variable", "value").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("group") == g).alias(f"g{i}") for i, g in enumerate(_FOUR)]
    )
    cells = ["total", "g0", "g1", "g2", "g3"]
    laid_out = tables.report_layout(counted, _LAYOUT, cells)
    return laid_out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells})


@query(
    "unpivot_characteristics",
    with_ctes(
        "pathways",
        f"SELECT variable, value, count(*) AS n, count(DISTINCT pathway_id) AS pathways FROM ({unpivot_sql('pathways', SEVEN, 'pathway_id')}) GROUP BY 1, 2",
    ),
)
def unpivot_characteristics(spark, sf_dir):
    long = tables.unpivot_variables(m.pathways(spark, sf_dir), SEVEN, ["pathway_id"])
    return long.groupBy("variable", "value").agg(F.count("*").alias("n"), F.count_distinct("pathway_id").alias("pathways"))


@query(
    "time_to_first_event",
    with_ctes(
        "spans",
        """SELECT specialty, priority, round(avg(days), 6) AS avg_days_between, quantile_disc(days, 0.5) AS median_days_between,
  round(stddev_samp(days), 6) AS stddev_days_between, quantile_disc(days, 0.75) - quantile_disc(days, 0.25) AS iqr_days_between,
  count(*) AS n
FROM (SELECT specialty, priority, CAST(CAST(l_shipdate AS DATE) - start_date AS INTEGER) AS days
      FROM lineitem JOIN spans ON pathway_id = l_orderkey WHERE l_linenumber = 1) GROUP BY 1, 2""",
    ),
)
def time_to_first_event(spark, sf_dir):
    """Line number one is the first contact of a pathway."""
    contacts = m.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pathway_id"), F.col("l_linenumber").alias("sequence"), F.col("l_shipdate").cast("date").alias("day")
    )
    rows = contacts.join(m.spans(spark, sf_dir).select("pathway_id", "specialty", "priority", "start_date"), "pathway_id")
    return events.time_to_first_event(rows, F.col("sequence") == 1, "start_date", "day", ["specialty", "priority"])


@query(
    "exit_rate",
    with_ctes(
        "spans exits",
        f"""SELECT specialty, bucket, exits, total, round(exits / total * 100, 2) AS exit_percentage FROM (
  SELECT specialty, {case_sql('wt', b.WAIT_BUCKET_5)} AS bucket,
    count(*) FILTER (exit_date BETWEEN start_date AND stop_date) AS exits, count(*) AS total
  FROM spans LEFT JOIN exits ON exits.pid = spans.pid GROUP BY 1, 2) WHERE exits > 0""",
    ),
)
def exit_rate(spark, sf_dir):
    linked = m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid", "left")
    return events.exit_rate(linked.withColumn("bucket", b.band("wt", b.WAIT_BUCKET_5)), ["specialty", "bucket"])


@query(
    "exit_share",
    with_ctes(
        "spans exits",
        f"""SELECT specialty, bucket, count(*) AS n, sum(count(*)) OVER (PARTITION BY specialty)::BIGINT AS total_count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY specialty), 6) AS proportion
FROM (SELECT specialty, {case_sql('wt', b.WAIT_BUCKET_5)} AS bucket FROM spans JOIN exits ON exits.pid = spans.pid
      WHERE exit_date BETWEEN start_date AND stop_date) GROUP BY 1, 2""",
    ),
)
def exit_share(spark, sf_dir):
    """Exits during the wait by bucket as a share of the specialty's exits."""
    gone = cohort.exit_during_wait(m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid"))
    return tables.proportion_by(gone.withColumn("bucket", b.band("wt", b.WAIT_BUCKET_5)), ["specialty", "bucket"], ["specialty"])


def _exit_stats_sql(keys: str) -> str:
    listed, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {listed}round(avg(days), 6) AS mean_time_to_exit, median(days) AS median_time_to_exit,
  round(quantile_cont(days, 0.25), 6) AS lower_quartile, round(quantile_cont(days, 0.75), 6) AS upper_quartile,
  round(stddev_samp(days), 6) AS stddev_time_to_exit, min(days) AS min_time_to_exit, max(days) AS max_time_to_exit, count(*) AS n
FROM (SELECT specialty, setting, CAST(exit_date - start_date AS INTEGER) AS days FROM spans JOIN exits ON exits.pid = spans.pid
      WHERE exit_date BETWEEN start_date AND stop_date) {group}"""


def _exit_stats(spark, sf_dir, keys):
    gone = cohort.exit_during_wait(m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid"))
    return events.time_to_exit_stats(gone, keys)


@query("time_to_exit_stats", with_ctes("spans exits", _exit_stats_sql("specialty")))
def time_to_exit_stats(spark, sf_dir):
    return _exit_stats(spark, sf_dir, ["specialty"])


@query("time_to_exit_overall", with_ctes("spans exits", _exit_stats_sql("")))
def time_to_exit_overall(spark, sf_dir):
    return _exit_stats(spark, sf_dir, [])


@query("time_to_exit_two_keys", with_ctes("spans exits", _exit_stats_sql("specialty, setting")))
def time_to_exit_two_keys(spark, sf_dir):
    return _exit_stats(spark, sf_dir, ["specialty", "setting"])


_NAMES = ("dna", "patient_canc", "hospital_canc")
_RATES = (
    "count(DISTINCT pathway_id) AS unique_pathways, "
    + ", ".join(f"count(DISTINCT pathway_id) FILTER (is_{n} = 1) AS {n}_count" for n in _NAMES)
    + ", "
    + ", ".join(f"round(avg(is_{n}), 6) AS avg_{n}_rate" for n in _NAMES)
    + ", "
    + ", ".join(
        f"round(count(DISTINCT pathway_id) FILTER (is_{n} = 1) / count(DISTINCT pathway_id) * 100, 6) AS {n}_percentage" for n in _NAMES
    )
)


@query("cancellation_rates", with_ctes("attendances", f"SELECT specialty, {_RATES} FROM attendances GROUP BY 1"))
def cancellation_rates(spark, sf_dir):
    return events.cancellation_rates(events.with_attendance_flags(m.attendances(spark, sf_dir)), ["specialty"])


@query(
    "cancellation_monthly",
    with_ctes(
        "attendances",
        f"""SELECT specialty, CAST(year(attendance_date) AS INTEGER) AS year, CAST(month(attendance_date) AS INTEGER) AS month, {_RATES}
FROM attendances GROUP BY 1, 2, 3""",
    ),
)
def cancellation_monthly(spark, sf_dir):
    return events.cancellation_monthly(events.with_attendance_flags(m.attendances(spark, sf_dir)), ["specialty"])


_VALUE_BUCKET = b.Bands((10, 25, 50), ("<= 10", "11-25", "26-50", "> 50"))


@query(
    "cancellation_impact",
    with_ctes(
        "attendances",
        f"""SELECT bucket, specialty, count(*) AS total_count, """
        + ", ".join(f"round(nullif(sum(is_{n}), 0) / count(*) * 100, 2) AS {n}_percentage" for n in _NAMES)
        + f" FROM (SELECT *, {case_sql('value', _VALUE_BUCKET)} AS bucket FROM attendances) GROUP BY 1, 2",
    ),
)
def cancellation_impact(spark, sf_dir):
    flagged = events.with_attendance_flags(m.attendances(spark, sf_dir))
    return events.cancellation_impact(flagged.withColumn("bucket", b.band("value", _VALUE_BUCKET)), ["bucket", "specialty"])
