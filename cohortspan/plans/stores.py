"""Stored tables, delimited files and suppressed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.operators import suppress, tables
from cohortspan.plans.base import case_sql, query, with_ctes
from cohortspan.session import scratch
from cohortspan.sources import mapping as m
from cohortspan.sources import store
from cohortspan.sources import tables as files

BUCKETS = 8


# --- fact store ---------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT pid, day, '{c}' AS metric, {c} AS n FROM activity WHERE {c} > 0" for c in m.USES)


def stored_facts(spark, sf_dir):
    """Activity by metric and patients by region, both stored by patient; the last metric is replaced by presence per day."""
    tag = uuid.uuid4().hex
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in m.USES])
    facts = m.activity(spark, sf_dir).select("pid", "day", F.inline(cells)).filter("n > 0")
    kept = store.create_store(facts, f"facts_{tag}", scratch(spark, "facts"), "pid", BUCKETS, ["metric"], ["day"])
    people = m.patients(spark, sf_dir).select("pid", "region")
    people = store.create_store(people, f"people_{tag}", scratch(spark, "people"), "pid", BUCKETS)
    again = facts.filter(F.col("metric") == m.USES[-1]).withColumn("n", F.lit(1).cast("long"))
    kept = store.replace_partitions(again, f"facts_{tag}", "pid")
    return kept, people


@query(
    "fact_store",
    with_ctes(
        "activity patients",
        f"""SELECT metric, region, count(*) AS days, sum(CASE WHEN metric = '{m.USES[-1]}' THEN 1 ELSE n END)::BIGINT AS n, count(DISTINCT pid) AS patients
FROM ({_LONG}) JOIN patients USING (pid) GROUP BY 1, 2""",
    ),
)
def fact_store(spark, sf_dir):
    """Write, replace one partition, read back joined by patient."""
    facts, people = stored_facts(spark, sf_dir)
    by_patient = facts.join(people, "pid").groupBy("metric", "region", "pid").agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    return by_patient.groupBy("metric", "region").agg(F.sum("days").alias("days"), F.sum("n").alias("n"), F.count("*").alias("patients"))


# --- delimited files ----------------------------------------------------------

CSV_SCHEMA = "pathway_id long, status string, start_date date, price decimal(15, 2)"
_LINES = """lines AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) END AS price FROM orders)"""


def checked_orders(spark, sf_dir):
    """Orders written as delimited text, some dates and prices unreadable, and read back."""
    orders = m.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pathway_id"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 97 == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("start_date"),
        F.when(F.col("o_orderkey") % 89 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(15, 2)").cast("string")).alias("price"),
    )
    path = scratch(spark, "orders-csv")
    files.write_csv(orders, path)
    return files.read_csv_checked(spark, path, CSV_SCHEMA)


@query(
    "csv_accepted",
    with_ctes(
        "",
        """SELECT status, count(*) AS n, sum(CAST(price AS DECIMAL(15, 2)))::DOUBLE AS price, CAST(min(day) AS VARCHAR) AS first_day
FROM lines WHERE day <> 'unknown' AND price <> 'n/a' GROUP BY 1""",
        _LINES,
    ),
)
def csv_accepted(spark, sf_dir):
    accepted, _ = checked_orders(spark, sf_dir)
    return accepted.groupBy("status").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.min("start_date").alias("first_day"))


@query(
    "csv_rejected",
    with_ctes("", "SELECT concat_ws(',', o_orderkey, status, day, price) AS record FROM lines WHERE day = 'unknown' OR price = 'n/a'", _LINES),
)
def csv_rejected(spark, sf_dir):
    return checked_orders(spark, sf_dir)[1]


# --- suppression in both directions -------------------------------------------

_CROSS = f"""cells AS (SELECT specialty, age_band, {case_sql('wt', b.WAIT_GRANULAR)} AS band, count(*) AS n, count(*) < 25 AS small FROM pathways GROUP BY 1, 2, 3),
costs AS (SELECT *, CASE WHEN small THEN 0 ELSE n END AS cost FROM cells WHERE n >= 1),
corners AS (SELECT a.specialty, a.age_band, a.band, d.age_band AS other_row, d.band AS other_column,
    row_number() OVER (PARTITION BY a.specialty, a.age_band, a.band ORDER BY b.cost + c.cost + d.cost, d.age_band, d.band) AS place
  FROM cells a JOIN costs b ON b.specialty = a.specialty AND b.age_band = a.age_band AND b.band <> a.band
  JOIN costs c ON c.specialty = a.specialty AND c.band = a.band AND c.age_band <> a.age_band
  JOIN costs d ON d.specialty = a.specialty AND d.age_band = c.age_band AND d.band = b.band WHERE a.small),
hidden AS (SELECT specialty, age_band, band, bool_or(own) AS own FROM (
  SELECT specialty, age_band, band, true AS own FROM corners WHERE place = 1 UNION ALL SELECT specialty, age_band, other_column, false FROM corners WHERE place = 1
  UNION ALL SELECT specialty, other_row, band, false FROM corners WHERE place = 1 UNION ALL SELECT specialty, other_row, other_column, false FROM corners WHERE place = 1)
  GROUP BY 1, 2, 3)"""


@query(
    "suppressed_both_ways",
    with_ctes(
        "pathways",
        """SELECT specialty, age_band, band, n, small, small OR own IS NOT NULL AS suppressed, small AND NOT coalesce(own, false) AS "open"
FROM cells LEFT JOIN hidden USING (specialty, age_band, band)""",
        _CROSS,
    ),
)
def suppressed_both_ways(spark, sf_dir):
    """Age by wait for every specialty, with cells hidden so that no total gives a small one back."""
    banded = m.pathways(spark, sf_dir).withColumn("band", b.band("wt", b.WAIT_GRANULAR))
    cells = tables.proportion_by(banded, ["specialty", "age_band", "band"], ["specialty", "age_band"]).select("specialty", "age_band", "band", "n")
    return suppress.closed_flag(cells, ["specialty"], "age_band", "band", k=25)
