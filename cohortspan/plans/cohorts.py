"""Waits, bands, exclusions and cohort sizes."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.functions import flags
from cohortspan.operators import cohort, events, tables
from cohortspan.plans.base import FRAILTY_LEVELS, case_sql, query, with_ctes
from cohortspan.sources import mapping as m
from cohortspan.sources.lookups import CENSUS_SHARE, SPECIALTY_ROWS, specialty_lookup
from cohortspan.sources.tables import read_parquet

KEY = ("pathway_id", "pid")
DATES = "CAST(start_date AS VARCHAR) AS start_date, CAST(stop_date AS VARCHAR) AS stop_date"


@query("pathway_wait", with_ctes("spans", f"SELECT pathway_id, pid, tfc, {DATES}, wt FROM spans"))
def pathway_wait(spark, sf_dir):
    return cohort.with_wait(m.spans(spark, sf_dir).drop("wt"), minimum=1).select(*KEY, "tfc", "start_date", "stop_date", "wt")


@query(
    "wait_band_5",
    with_ctes("spans", f'SELECT {case_sql("wt", b.WAIT_5)} AS band, count(*) AS n, min(wt) AS lowest, max(wt) AS highest FROM spans GROUP BY 1'),
)
def wait_band_5(spark, sf_dir):
    banded = m.spans(spark, sf_dir).select(b.band("wt", b.WAIT_5).alias("band"), "wt")
    return banded.groupBy("band").agg(F.count("*").alias("n"), F.min("wt").alias("lowest"), F.max("wt").alias("highest"))


@query("wait_band_granular", with_ctes("spans", f"SELECT pathway_id, wt, {case_sql('wt', b.WAIT_GRANULAR)} AS band FROM spans"))
def wait_band_granular(spark, sf_dir):
    return m.spans(spark, sf_dir).select("pathway_id", "wt", b.band("wt", b.WAIT_GRANULAR).alias("band"))


_SCHEMES = {f"band_{name}": bands for name, bands in b.WAIT_BANDS.items()}


# the edges once more, on their own, so that a wrong one in the bands shows
_EDGES = {
    "band_2": "CASE WHEN wt <= 126 THEN '<= 18 weeks' ELSE '> 18 weeks' END",
    "band_3": "CASE WHEN wt <= 84 THEN '<= 12 weeks' WHEN wt <= 126 THEN '<= 18 weeks' ELSE '> 18 weeks' END",
    "band_4": "CASE WHEN wt <= 126 THEN '<= 18 weeks' WHEN wt <= 252 THEN '> 18 weeks' WHEN wt <= 364 THEN '> 36 weeks' ELSE '> 52 weeks' END",
    "band_5": "CASE WHEN wt <= 72 THEN '<= 6 weeks' WHEN wt <= 126 THEN '<= 18 weeks' WHEN wt <= 210 THEN '19-30 weeks'"
    " WHEN wt <= 294 THEN '31-42 weeks' ELSE '> 42 weeks' END",
    "band_6": "CASE WHEN wt <= 84 THEN '<= 12 weeks' WHEN wt <= 126 THEN '<= 18 weeks' WHEN wt <= 168 THEN '19-24 weeks'"
    " WHEN wt <= 210 THEN '25-30 weeks' WHEN wt <= 294 THEN '31-42 weeks' ELSE '> 42 weeks' END",
    "band_old_4": "CASE WHEN wt <= 84 THEN '<= 12 weeks' WHEN wt <= 126 THEN '<= 18 weeks' WHEN wt <= 252 THEN '19-36 weeks' ELSE '> 36 weeks' END",
    "band_bucket_5": "CASE WHEN wt < 84 THEN '< 12 weeks' WHEN wt <= 126 THEN '12-18 weeks' WHEN wt <= 245 THEN '19-36 weeks'"
    " WHEN wt <= 364 THEN '37-52 weeks' ELSE '> 52 weeks' END",
    "band_bucket_4": "CASE WHEN wt <= 126 THEN '< 18 weeks' WHEN wt <= 252 THEN '19-36 weeks' WHEN wt <= 364 THEN '37-52 weeks' ELSE '> 52 weeks' END",
    "band_granular": "CASE WHEN wt <= 21 THEN '0-3 weeks' WHEN wt <= 357 THEN ((wt - 1) // 21 * 3 + 1) || '-' || ((wt - 1) // 21 * 3 + 3) || ' weeks'"
    " ELSE '52+ weeks' END",
}


@query(
    "wait_band_schemes",
    with_ctes("spans", "SELECT pathway_id, " + ", ".join(f"{_EDGES[n]} AS {n}" for n in _SCHEMES) + " FROM spans"),
)
def wait_band_schemes(spark, sf_dir):
    return m.spans(spark, sf_dir).select("pathway_id", *[b.band("wt", s).alias(n) for n, s in _SCHEMES.items()])


@query(
    "characteristic_bands",
    with_ctes(
        "patients",
        f"""SELECT pid, age_band, ltc, {case_sql('frailty_index', b.FRAILTY)} AS frail, frailty FROM patients""",
    ),
)
def characteristic_bands(spark, sf_dir):
    return m.patients(spark, sf_dir).select(
        "pid",
        b.band("age", b.AGE).alias("age_band"),
        b.band("ltc_count", b.CONDITIONS).alias("ltc"),
        b.band("frailty_index", b.FRAILTY).alias("frail"),
        b.band("frailty_index", FRAILTY_LEVELS).alias("frailty"),
    )


_FIRST, _LAST = datetime.date(1997, 1, 1), datetime.date(1999, 3, 31)


@query(
    "quarter_band",
    with_ctes(
        "spans",
        f"""SELECT band, count(*) AS n, count(DISTINCT pid) AS patients FROM (
  SELECT pid, CASE quarter(start_date) WHEN 1 THEN 'mar' WHEN 2 THEN 'jun' WHEN 3 THEN 'sep' ELSE 'dec' END
    || strftime(start_date, '%y') AS band
  FROM spans WHERE start_date BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}') GROUP BY band""",
    ),
)
def quarter_band(spark, sf_dir):
    banded = m.spans(spark, sf_dir).select("pid", b.quarter_band("start_date", _FIRST, _LAST).alias("band"))
    return banded.filter(F.col("band").isNotNull()).groupBy("band").agg(
        F.count("*").alias("n"), F.count_distinct("pid").alias("patients")
    )


OUTCOME_SQL = """CASE WHEN status = 30 AND contains(change_type, 'IRTT') THEN 'treatment_admitted'
  WHEN status = 30 AND NOT contains(change_type, 'IRTT') THEN 'treatment_non_admitted'
  WHEN status IN (31, 32) THEN 'non_treatment_monitoring' WHEN status = 35 THEN 'non_treatment_patient_declines'
  WHEN status = 34 THEN 'non_treatment_decision_not_to_treat' WHEN status = 33 THEN 'non_treatment_dna'
  WHEN status NOT IN (30, 31, 32, 33, 34, 35, 36, 99) THEN 'non_treatment_other'
  WHEN status = 36 THEN 'non_treatment_death' WHEN status = 99 THEN 'unknown' END"""


@query(
    "outcome_reason",
    with_ctes(
        "spans",
        f"""SELECT reason, count(*) AS n, CAST(quantile_disc(wt, 0.5) FILTER (end_type = 'rtt_end_date') AS INTEGER) AS median_wait
FROM (SELECT *, {OUTCOME_SQL} AS reason FROM spans) GROUP BY reason""",
    ),
)
def outcome_reason(spark, sf_dir):
    """Outcome counts and the median wait of pathways with a recorded end."""
    named = m.spans(spark, sf_dir).withColumn("reason", flags.outcome_reason())
    recorded = F.when(F.col("end_type") == "rtt_end_date", F.col("wt"))
    return named.withColumn("recorded", recorded).groupBy("reason").agg(
        F.count("*").alias("n"), tables.quantile("recorded", 0.5).cast("int").alias("median_wait")
    )


@query(
    "attendance_flags",
    with_ctes(
        "attendances",
        """SELECT specialty, event_source, count(*) AS n, CAST(sum(is_dna) AS BIGINT) AS is_dna,
  CAST(sum(is_patient_canc) AS BIGINT) AS is_patient_canc, CAST(sum(is_hospital_canc) AS BIGINT) AS is_hospital_canc
FROM attendances WHERE event_source LIKE 'hospital\\_%' ESCAPE '\\' GROUP BY 1, 2""",
    ),
)
def attendance_flags(spark, sf_dir):
    flagged = events.with_attendance_flags(m.attendances(spark, sf_dir).filter(F.col("event_source").startswith("hospital_contact")))
    return flagged.groupBy("specialty", "event_source").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in events.FLAGS]
    )


@query(
    "period_bounds",
    with_ctes(
        "spans",
        """SELECT pathway_id, CAST(stop_date + 28 AS VARCHAR) AS washout_end, CAST(stop_date + 28 + wt AS VARCHAR) AS follow_up_end,
  wt + 28 AS washout_end_days, wt + 28 + wt AS follow_up_end_days,
  CAST(stop_date + 28 + 180 AS VARCHAR) AS fixed_follow_up_end, wt + 28 + 180 AS fixed_follow_up_end_days
FROM spans WHERE wt > 72""",
    ),
)
def period_bounds(spark, sf_dir):
    waits = m.spans(spark, sf_dir).filter("wt > 72")
    own = cohort.with_bounds(waits)
    fixed = F.date_add("washout_end", 180)
    return own.select(
        "pathway_id",
        "washout_end",
        "follow_up_end",
        "washout_end_days",
        "follow_up_end_days",
        fixed.alias("fixed_follow_up_end"),
        (F.col("washout_end_days") + 180).alias("fixed_follow_up_end_days"),
    )


@query(
    "exit_exclusion",
    with_ctes(
        "pathways exits",
        """SELECT "group", count(DISTINCT pid) FILTER (gone) AS excluded_patients,
  count(*) FILTER (NOT gone) AS kept_pathways, count(DISTINCT pid) AS patients
FROM (SELECT pathways.*, coalesce(exit_date <= stop_date + 28 + wt, false) AS gone
      FROM pathways LEFT JOIN exits ON exits.pid = pathways.pid WHERE wt > 72) GROUP BY 1""",
    ),
)
def exit_exclusion(spark, sf_dir):
    waits = cohort.with_bounds(m.pathways(spark, sf_dir).filter("wt > 72"))
    return cohort.exit_exclusion(waits.join(m.exits(spark, sf_dir), "pid", "left")).select(
        "group", "excluded_patients", "kept_pathways", "patients"
    )


@query(
    "exit_during_wait",
    with_ctes(
        "spans exits",
        f"""SELECT pathway_id, spans.pid AS pid, tfc, {DATES}, CAST(exit_date AS VARCHAR) AS exit_date
FROM spans JOIN exits ON exits.pid = spans.pid WHERE exit_date BETWEEN start_date AND stop_date""",
    ),
)
def exit_during_wait(spark, sf_dir):
    linked = m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid")
    return cohort.exit_during_wait(linked).select(*KEY, "tfc", "start_date", "stop_date", "exit_date")


@query(
    "cohort_window",
    with_ctes(
        "spans",
        """SELECT tfc, count(*) AS n, CAST(min(start_date) AS VARCHAR) AS first_start, CAST(max(stop_date) AS VARCHAR) AS last_stop
FROM spans WHERE start_date >= DATE '1996-04-01' AND stop_date < DATE '1998-03-31' GROUP BY 1""",
    ),
)
def cohort_window(spark, sf_dir):
    window = cohort.cohort_window(m.spans(spark, sf_dir), datetime.date(1996, 4, 1), datetime.date(1998, 3, 31))
    return window.groupBy("tfc").agg(
        F.count("*").alias("n"), F.min("start_date").alias("first_start"), F.max("stop_date").alias("last_stop")
    )


@query(
    "priority_selection",
    with_ctes(
        "pathways",
        """SELECT "group", count(*) FILTER (lower(priority) <> 'cancer') AS not_cancer,
  count(*) FILTER (lower(priority) = 'cancer') AS only_cancer, count(*) FILTER (wt > 712) AS extreme
FROM pathways GROUP BY 1""",
    ),
)
def priority_selection(spark, sf_dir):
    """Cohorts without a priority, with only that priority, and the extreme waiters."""
    cancer = cohort.has_priority("cancer")
    return m.pathways(spark, sf_dir).groupBy("group").agg(
        F.count_if(~cancer).alias("not_cancer"),
        F.count_if(cancer).alias("only_cancer"),
        F.count_if(cohort.is_extreme()).alias("extreme"),
    )


@query(
    "wait_band_by_setting",
    with_ctes(
        "pathways",
        """SELECT setting, wait_band, count(*) AS n, sum(count(*)) OVER (PARTITION BY setting)::BIGINT AS total_count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY setting), 6) AS proportion FROM pathways GROUP BY 1, 2""",
    ),
)
def wait_band_by_setting(spark, sf_dir):
    return tables.proportion_by(m.pathways(spark, sf_dir), ["setting", "wait_band"], ["setting"])


@query(
    "subgroup_compare",
    with_ctes(
        "pathways",
        """SELECT subsection, distinct_count, count(*) AS patients, round(avg(median_wait), 6) AS mean_of_medians FROM (
  SELECT subsection, pid, count(DISTINCT start_date) AS distinct_count, quantile_disc(wt, 0.5) AS median_wait FROM (
    SELECT 'Fit, Age < 61, No LTCs' AS subsection, * FROM pathways WHERE frailty = 'Fit' AND age < 61 AND ltc = 'No LTCs'
    UNION ALL
    SELECT 'Severe/Moderate, Age > 60, any LTC', * FROM pathways
    WHERE frailty IN ('Severe', 'Moderate') AND age > 60 AND ltc IN ('Comorbidities', 'Multimorbidities', 'Single LTC'))
  GROUP BY 1, 2) GROUP BY 1, 2""",
    ),
)
def subgroup_compare(spark, sf_dir):
    some = F.col("ltc").isin("Comorbidities", "Multimorbidities", "Single LTC")
    subgroups = {
        "Fit, Age < 61, No LTCs": (F.col("frailty") == "Fit") & (F.col("age") < 61) & (F.col("ltc") == "No LTCs"),
        "Severe/Moderate, Age > 60, any LTC": F.col("frailty").isin("Severe", "Moderate") & (F.col("age") > 60) & some,
    }
    rows = cohort.subgroup_union(m.pathways(spark, sf_dir), subgroups)
    starts = events.patient_starts(rows, ["subsection", "pid"])
    return starts.groupBy("subsection", "distinct_count").agg(
        F.count("*").alias("patients"), F.avg("median_wait_length").alias("mean_of_medians")
    )


@query(
    "cohort_sizes",
    with_ctes(
        "pathways",
        """SELECT "group", count(DISTINCT (pid, tfc, start_date)) AS pathways, count(DISTINCT pid) AS patients FROM pathways GROUP BY 1""",
    ),
)
def cohort_sizes(spark, sf_dir):
    return cohort.cohort_sizes(m.pathways(spark, sf_dir), ["group"])


@query(
    "specialty_lookup",
    "WITH lookup(specialty_code, specialty, tfc) AS (VALUES "
    + ", ".join(f"('{code}', '{name}', {'NULL' if tfc is None else tfc})" for code, name, tfc in SPECIALTY_ROWS)
    + """)
SELECT specialty_code, specialty, count(*) AS n, count(DISTINCT l_partkey) AS codes,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DOUBLE) AS cost
FROM lineitem JOIN lookup ON tfc = l_partkey GROUP BY 1, 2""",
)
def specialty_lookup_query(spark, sf_dir):
    """Activity by specialty; part numbers stand for treatment-function codes."""
    rows = m.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("tfc"), F.col("l_extendedprice").cast("decimal(15,2)").alias("price")
    )
    # few codes: reduce to codes before the lookup and before the distinct count
    per_code = rows.groupBy("tfc").agg(F.count("*").alias("n"), F.sum("price").alias("cost"))
    named = per_code.join(F.broadcast(specialty_lookup(spark)), "tfc")
    return named.groupBy("specialty_code", "specialty").agg(
        F.sum("n").alias("n"), F.count("*").alias("codes"), F.sum("cost").alias("cost")
    )


@query(
    "proportion_by",
    with_ctes(
        "pathways",
        """SELECT provider_category, wait_band_category, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY provider_category)::BIGINT AS total_count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY provider_category), 6) AS proportion
FROM (SELECT CASE WHEN contains(provider, 'HOUSE') THEN 'Contains HOUSE' ELSE 'Does not contain HOUSE' END AS provider_category,
        CASE WHEN wait_band = '<= 18 weeks' THEN 'Less than 18 weeks' ELSE 'More than 18 weeks' END AS wait_band_category
      FROM pathways) GROUP BY 1, 2""",
    ),
)
def proportion_by(spark, sf_dir):
    named = m.pathways(spark, sf_dir).select(
        flags.contains_label("provider", "HOUSE").alias("provider_category"),
        b.level_recode("wait_band", "<= 18 weeks", "Less than 18 weeks", "More than 18 weeks").alias("wait_band_category"),
    )
    return tables.proportion_by(named, ["provider_category", "wait_band_category"], ["provider_category"])


@query(
    "share_by_group",
    with_ctes(
        "pathways",
        """SELECT "group", coalesce(priority, 'Unknown') AS priority, count(*) AS n,
  sum(count(*)) OVER ()::BIGINT AS total_count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion
FROM (SELECT DISTINCT pid, tfc, start_date, priority, wt, "group" FROM pathways) GROUP BY 1, 2""",
    ),
)
def share_by_group(spark, sf_dir):
    named = m.pathways(spark, sf_dir).na.fill({"priority": "Unknown"})
    grain = named.groupBy("pid", "tfc", "start_date", "priority", "wt", "group").agg(F.count("*").alias("_rows"))
    return tables.proportion_by(grain, ["group", "priority"], [])


_CENSUS = {region: share for region, share in zip(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), CENSUS_SHARE.values())}


@query(
    "baseline_gap",
    with_ctes(
        "pathways",
        """SELECT specialty, region, n, total_count, round(n / total_count, 6) AS proportion, baseline,
  round(n / total_count - baseline, 6) AS difference
FROM (SELECT specialty, region, count(*) AS n, sum(count(*)) OVER (PARTITION BY specialty)::BIGINT AS total_count
      FROM pathways GROUP BY 1, 2) JOIN reference USING (region)""",
        "reference(region, baseline) AS (VALUES " + ", ".join(f"('{r}', {s}::DOUBLE)" for r, s in _CENSUS.items()) + ")",
    ),
)
def baseline_gap(spark, sf_dir):
    shares = tables.proportion_by(m.pathways(spark, sf_dir), ["specialty", "region"], ["specialty"])
    return tables.baseline_gap(shares, "region", _CENSUS)


@query(
    "median_by",
    with_ctes(
        "pathways",
        "SELECT ltc, specialty, median(wt) AS median, count(wt) AS n FROM pathways WHERE age_band <> 'unknown' GROUP BY 1, 2",
    ),
)
def median_by(spark, sf_dir):
    return tables.median_by(m.pathways(spark, sf_dir).filter("age_band <> 'unknown'"), "wt", ["ltc", "specialty"])


@query(
    "patient_starts_median",
    with_ctes(
        "pathways",
        """SELECT specialty, pid, frailty, count(DISTINCT start_date) AS distinct_count, quantile_disc(wt, 0.5) AS median_wait_length
FROM pathways GROUP BY 1, 2, 3""",
    ),
)
def patient_starts_median(spark, sf_dir):
    return events.patient_starts(m.pathways(spark, sf_dir), ["specialty", "pid", "frailty"])


@query(
    "multi_start_profile",
    with_ctes(
        "spans",
        """SELECT specialty, record_count, coalesce(marked_count, 0) AS marked_count,
  round(coalesce(marked_count, 0) / record_count, 6) AS marked_proportion
FROM (SELECT specialty, count(*) AS record_count FROM (
        SELECT pid, tfc, specialty FROM spans GROUP BY ALL HAVING count(DISTINCT start_date) > 1) GROUP BY 1)
LEFT JOIN (SELECT specialty, count(*) AS marked_count FROM spans WHERE contains(change_type, 'IRTT') GROUP BY 1) USING (specialty)""",
    ),
)
def multi_start_profile(spark, sf_dir):
    return events.multi_start_profile(m.spans(spark, sf_dir), "specialty", F.col("change_type").contains(flags.ADMITTED_MARK))


@query(
    "multi_start_rows",
    with_ctes(
        "spans",
        """SELECT tfc, count(*) AS group_frequency FROM spans SEMI JOIN (
  SELECT pid, tfc FROM spans GROUP BY ALL HAVING count(DISTINCT start_date) > 1) USING (pid, tfc)
WHERE setting = 'inpatient' GROUP BY 1""",
    ),
)
def multi_start_rows(spark, sf_dir):
    """Rows of one setting whose patient and specialty have several clock starts."""
    rows = m.spans(spark, sf_dir)
    repeated = (
        rows.groupBy("pid", "tfc").agg(F.count_distinct("start_date").alias("starts")).filter("starts > 1").select("pid", "tfc")
    )
    joined = rows.filter("setting = 'inpatient'").join(repeated, ["pid", "tfc"])
    return joined.groupBy("tfc").agg(F.count("*").alias("group_frequency"))


@query(
    "multi_tfc",
    with_ctes("spans", "SELECT pid, count(DISTINCT tfc) AS distinct_count FROM spans GROUP BY 1 HAVING count(DISTINCT tfc) > 1"),
)
def multi_tfc(spark, sf_dir):
    return events.multiple_of(m.spans(spark, sf_dir), "tfc")


@query(
    "cohort_link",
    with_ctes(
        "spans exits patients",
        f"""SELECT pathway_id, linked.pid, cohort_band, age_band, sex, region FROM (
  SELECT pathway_id, spans.pid AS pid, CASE quarter(start_date) WHEN 1 THEN 'mar' WHEN 2 THEN 'jun' WHEN 3 THEN 'sep' ELSE 'dec' END
    || strftime(start_date, '%y') AS cohort_band
  FROM spans JOIN exits ON exits.pid = spans.pid
  WHERE exit_date BETWEEN start_date AND stop_date AND start_date BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}') linked
LEFT JOIN (SELECT 'mar' || lpad(CAST(96 + pid % 3 AS VARCHAR), 2, '0') AS band, pid, age_band, sex, region FROM patients) p
  ON p.band = cohort_band AND p.pid = linked.pid""",
    ),
)
def cohort_link(spark, sf_dir):
    """Exits during the wait linked to demographics by quarter and patient."""
    gone = cohort.exit_during_wait(m.spans(spark, sf_dir).join(m.exits(spark, sf_dir), "pid"))
    banded = gone.withColumn("cohort_band", b.quarter_band("start_date", _FIRST, _LAST)).filter(F.col("cohort_band").isNotNull())
    people = m.patients(spark, sf_dir).select(
        F.concat(F.lit("mar"), (96 + F.col("pid") % 3).cast("string")).alias("band"),
        F.col("pid").alias("patient_id"),
        "age_band",
        "sex",
        "region",
    )
    linked = cohort.link(banded, people, {"cohort_band": "band", "pid": "patient_id"})
    return linked.select("pathway_id", "pid", "cohort_band", "age_band", "sex", "region")


@query(
    "list_type",
    with_ctes("spans", "SELECT list, count(*) AS n FROM (SELECT CASE WHEN contains(change_type, 'IRTT') THEN 'in' ELSE 'op' END AS list FROM spans) GROUP BY 1"),
)
def list_type(spark, sf_dir):
    """Pathways that reached the admitted list, and the others."""
    return m.spans(spark, sf_dir).groupBy(flags.list_type().alias("list")).agg(F.count("*").alias("n"))


@query(
    "priority_exclusion",
    with_ctes("spans", "SELECT priority, count(*) AS pathways, count(DISTINCT pid) AS patients FROM spans WHERE lower(priority) <> 'cancer' GROUP BY 1"),
)
def priority_exclusion(spark, sf_dir):
    """The cohort without one referral priority; rows without a priority go too."""
    kept = cohort.exclude_priority(m.spans(spark, sf_dir), "cancer")
    return kept.groupBy("priority").agg(F.count("*").alias("pathways"), F.count_distinct("pid").alias("patients"))


@query(
    "filled_scan",
    "SELECT event_type, round(sum(coalesce(value, 0)), 4) AS total, count(*) AS n, count(coalesce(value, 0)) AS filled FROM events GROUP BY 1",
)
def filled_scan(spark, sf_dir):
    """A scan whose numeric nulls are zeros."""
    rows = read_parquet(spark, f"{sf_dir}/events.parquet", fill=0)
    return rows.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.count("value").alias("filled"))
