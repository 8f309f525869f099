"""Cohort inputs derived from the driver's tables.

A patient is a customer, a pathway is an order: the clock starts on the order
date and stops with the last line item shipped. Line items are the sparse
activity record. See FIXTURES.md for the table of correspondences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.functions import bands as b
from cohortspan.session import durable

USES = ("use_a", "use_n", "use_r")
COSTS = ("cost_a", "cost_n", "cost_r")
MEASURES = USES + COSTS
CHARACTERISTICS = ("specialty", "sex", "age_band", "quintile", "region", "frailty", "ltc")
PATHWAY_KEY = ("pid", "tfc", "start_date")
FRAILTY_LEVELS = b.Bands((1, 3, 4), ("Fit", "Mild", "Moderate", "Severe"))


# declared schemas: no footer is read to plan a query
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed pathways with dates and the columns the order itself carries."""
    stops = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.expr("cast(max(l_shipdate) as date) as stop_date"))
        .withColumnRenamed("l_orderkey", "pathway_id")
    )
    started = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pathway_id",
        "o_custkey as pid",
        "o_orderpriority as tfc",
        "o_orderpriority as specialty",
        "cast(o_orderdate as date) as start_date",
        "cast(case when o_orderkey % 9 < 7 then 30 + o_orderkey % 9 when o_orderkey % 9 = 7 then 99 else 40 end as int) as status",
        "case o_orderstatus when 'F' then 'OPRT|IRTT' when 'O' then 'OPRT' end as change_type",
        "if(o_orderkey % 2 = 0, 'rtt_end_date', 'week_end_date') as end_type",
        "if(o_orderstatus = 'F', 'inpatient', 'outpatient') as setting",
        "case when o_totalprice < 100000 then 'Urgent' when o_totalprice < 350000 then 'Routine'"
        " when o_totalprice < 450000 then 'Cancer' end as priority",
        "cast(o_orderstatus = 'F' as int) as event",
    )
    return started.join(stops, "pathway_id").filter("stop_date > start_date").withColumn("wt", F.datediff("stop_date", "start_date"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient with the characteristics of the report tables."""
    # nation and region have a fixed number of rows
    places = (
        table(spark, sf_dir, "nation")
        .join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
        .selectExpr("n_nationkey as c_nationkey", "r_name as region")
    )
    raw = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(places), "c_nationkey")
        .selectExpr(
            "c_custkey as pid",
            "c_mktsegment as provider",
            "c_acctbal as balance",
            "if(c_custkey % 2 = 0, 'F', 'M') as sex",
            "if(c_acctbal >= -900, cast(floor((c_acctbal + 1000) / 110) as int), null) as age",
            "cast(c_nationkey div 5 + 1 as string) as quintile",
            "region",
            "cast(c_custkey % 5 as int) as ltc_count",
            "cast(c_custkey % 6 as int) as frailty_index",
        )
    )
    return raw.withColumns(
        {
            "age_band": b.band("age", b.AGE),
            "ltc": b.band("ltc_count", b.CONDITIONS),
            "frailty": b.band("frailty_index", FRAILTY_LEVELS),
        }
    )


def pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pathways with patient characteristics and the wait-band group."""
    return (
        spans(spark, sf_dir)
        .join(patients(spark, sf_dir), "pid")
        .withColumns({"group": b.band("wt", b.WAIT_5), "wait_band": b.band("wt", b.WAIT_4)})
    )


def line_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with patient and day, before any grouping."""
    owner = table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey as pid")
    return (
        table(spark, sf_dir, "lineitem")
        .join(owner, "l_orderkey")
        .selectExpr(
            "pid",
            "cast(l_shipdate as date) as day",
            "lower(l_returnflag) as kind",
            # whole hundredths add up exactly and cheaply
            "cast(round(l_extendedprice * 100) as bigint) as cents",
        )
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse activity: one row per patient and active day, one column per measure.

    Costs are rounded to whole units per day.
    """
    kinds = ("a", "n", "r")
    return (
        line_activity(spark, sf_dir)
        .groupBy("pid", "day")
        .agg(
            *[F.expr(f"count_if(kind = '{k}') as use_{k}") for k in kinds],
            *[F.expr(f"sum(if(kind = '{k}', cents, 0)) as cost_{k}") for k in kinds],
        )
        .selectExpr("pid", "day", *USES, *[f"({c} + 50) div 100 as {c}" for c in COSTS])
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`activity`, stored: what a query reads of it, and the exits and observed days that
    follow from it, come from one pass over the line items."""
    return durable(activity(spark, sf_dir))


def _days(spark: SparkSession, sf_dir: str, facts: DataFrame | None) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")) if facts is None else facts


def observed_until(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> Column:
    """Last observed day as a scalar subquery; of ``facts`` where a query has them."""
    return _days(spark, sf_dir, facts).agg(F.max("day")).scalar()


def observed_from(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> Column:
    """First observed day as a scalar subquery."""
    return _days(spark, sf_dir, facts).agg(F.min("day")).scalar()


def exits(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Exit ("death") date: the last activity of customers with a negative balance."""
    leavers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").selectExpr("c_custkey as pid")
    days = line_activity(spark, sf_dir) if facts is None else facts
    return days.join(leavers, "pid", "left_semi").groupBy("pid").agg(F.max("day").alias("exit_date"))


def attendances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows read as attendances of a daily episode."""
    owners = table(spark, sf_dir, "customer").selectExpr("c_custkey as pid", "c_mktsegment as specialty")
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "user_id as pid",
            "concat_ws('-', user_id, date_format(cast(ts as date), 'yyyyMMdd')) as pathway_id",
            "if(event_type = 'click', 'other_contact', 'hospital_contact') as event_source",
            "case event_type when 'error' then '5 dna' when 'signup' then '2 cancel(pat)'"
            " when 'purchase' then '4 cancel(hos)' when 'view' then 'attended' end as attendance_status",
            "cast(ts as date) as attendance_date",
            "value",
        )
        .join(owners, "pid")
    )
