"""Overlapping pathways."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.operators import overlap, tables
from cohortspan.plans.base import query, unpivot_sql, with_ctes
from cohortspan.session import durable
from cohortspan.sources import mapping as m

SIX = m.CHARACTERISTICS[1:]
COLUMNS = ("pid", "wait_band", *SIX)
INDEX = "1-URGENT"

_OVERLAP = """EXISTS (SELECT 1 FROM spans b WHERE b.pid = a.pid {same}
  AND a.start_date < b.stop_date AND a.stop_date > b.start_date AND a.pathway_id <> b.pathway_id)"""
_ANY = _OVERLAP.format(same="")
_OVERLAPPING = f"overlapping AS (SELECT DISTINCT {', '.join(COLUMNS)} FROM pathways a WHERE {_ANY})"
_NON = f"""non_overlapping AS (SELECT {', '.join(COLUMNS)} FROM pathways WHERE pid NOT IN (SELECT pid FROM overlapping))"""


def _rows(spark, sf_dir, *extra):
    # the rows are read as events, as days asked for and as the rows that ask
    return durable(m.spans(spark, sf_dir).select("pathway_id", "pid", "tfc", "start_date", "stop_date", *extra))


@query(
    "overlap_same_specialty",
    with_ctes("spans", f"SELECT DISTINCT pid FROM spans a WHERE {_OVERLAP.format(same='AND b.tfc = a.tfc')}"),
)
def overlap_same_specialty(spark, sf_dir):
    return overlap.overlapping(_rows(spark, sf_dir), ["pid", "tfc"], ["pid"], unique=True)


def _both(spark, sf_dir):
    pw = durable(m.pathways(spark, sf_dir).select("pathway_id", "start_date", "stop_date", *COLUMNS))
    yes = overlap.overlapping(pw, ["pid"], COLUMNS, unique=True)
    return yes, overlap.non_overlapping(pw, yes, COLUMNS)


@query("overlap_any", with_ctes("pathways", "SELECT * FROM overlapping", _OVERLAPPING))
def overlap_any(spark, sf_dir):
    return _both(spark, sf_dir)[0]


@query(
    "overlap_counts",
    with_ctes(
        "spans",
        """SELECT a.pathway_id, count(b.pathway_id) AS overlaps FROM spans a LEFT JOIN spans b
  ON b.pid = a.pid AND a.start_date < b.stop_date AND a.stop_date > b.start_date AND a.pathway_id <> b.pathway_id
GROUP BY 1""",
    ),
)
def overlap_counts(spark, sf_dir):
    """Number of overlapping pathways of the same patient, per pathway."""
    rows = _rows(spark, sf_dir).drop("tfc")
    return overlap.with_overlaps(rows, ["pid"]).select("pathway_id", "overlaps")


@query(
    "non_overlap",
    with_ctes("pathways", "SELECT * FROM non_overlapping", f"{_OVERLAPPING},\n{_NON}"),
)
def non_overlap(spark, sf_dir):
    return _both(spark, sf_dir)[1]


@query(
    "overlap_treated",
    with_ctes(
        "spans",
        """SELECT status_group, count(*) AS patients FROM (
  SELECT DISTINCT a.pid, a.status = 30 AS status_group FROM spans a JOIN spans b
    ON b.pid = a.pid AND (a.status = 30) = (b.status = 30) AND a.start_date < b.stop_date AND a.stop_date > b.start_date
    AND a.pathway_id <> b.pathway_id) GROUP BY 1""",
    ),
)
def overlap_treated(spark, sf_dir):
    """Patients with overlaps within the treated and within the untreated pathways."""
    rows = _rows(spark, sf_dir, (F.col("status") == 30).alias("status_group"))
    found = overlap.overlapping(rows, ["pid", "status_group"], ["pid", "status_group"], unique=True)
    return found.groupBy("status_group").agg(F.count("*").alias("patients"))


def _share(table: str) -> str:
    return f"""SELECT variable, value, wait_band, round(n / sum(n) OVER (PARTITION BY variable, value) * 100, 2) AS pct
  FROM (SELECT variable, value, wait_band, count(*) AS n
        FROM ({unpivot_sql(f"(SELECT DISTINCT {', '.join(COLUMNS)} FROM {table})", SIX, 'wait_band')}) GROUP BY 1, 2, 3)"""


@query(
    "overlap_compare",
    with_ctes(
        "pathways",
        f"""SELECT variable, value, wait_band, o.pct AS overlapping, n.pct AS non_overlapping,
  round(round(n.pct - o.pct, 2), 4) AS difference, round(n.pct - o.pct, 2) AS change
FROM ({_share('overlapping')}) o JOIN ({_share('non_overlapping')}) n USING (variable, value, wait_band)""",
        f"{_OVERLAPPING},\n{_NON}",
    ),
)
def overlap_compare(spark, sf_dir):
    """Row percentages of overlapping against non-overlapping patients."""
    yes, no = (
        tables.band_distribution(part, SIX, "wait_band", "value", grain=["pid"]) for part in _both(spark, sf_dir)
    )
    compared = overlap.compare_tables(yes, no, "percentage", ("overlapping", "non_overlapping"), ["variable", "value", "wait_band"])
    # the label's number, so that both engines' texts of a number compare
    label = F.expr("try_cast(replace(change, '% improvement', '') as double)")
    return compared.withColumns({"difference": F.round("difference", 4), "change": F.round(label, 2)})


_CLOSED = """b.pid = a.pid AND ((a.start_date <= b.start_date AND a.start_date + a.wt >= b.start_date)
  OR (a.start_date >= b.start_date AND a.start_date <= b.start_date + b.wt))"""


@query(
    "overlap_cross_cohort",
    with_ctes(
        "spans",
        f"""SELECT b.tfc AS tfc, count(*) AS pairs FROM spans a JOIN spans b ON {_CLOSED}
WHERE a.tfc = '{INDEX}' AND b.tfc <> '{INDEX}' GROUP BY 1""",
    ),
)
def overlap_cross_cohort(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    index, others = rows.filter(F.col("tfc") == INDEX), rows.filter(F.col("tfc") != INDEX)
    return overlap.overlap_pairs_by(others, index, ["tfc"])


@query(
    "patient_pathway_mix",
    with_ctes(
        "spans",
        f"""SELECT count(*) AS patients, round(count(*) FILTER (n = 1) / count(*) * 100, 6) AS single_percentage,
  round(count(*) FILTER (n > 1) / count(*) * 100, 6) AS multiple_percentage,
  round(count(*) FILTER (hit) / count(*) * 100, 6) AS overlapping_percentage
FROM (SELECT a.pid, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM spans b WHERE b.tfc <> '{INDEX}' AND {_CLOSED})) AS hit
      FROM spans a WHERE a.tfc = '{INDEX}' GROUP BY 1)""",
    ),
)
def patient_pathway_mix(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return overlap.patient_pathway_mix(rows.filter(F.col("tfc") == INDEX), rows.filter(F.col("tfc") != INDEX))
