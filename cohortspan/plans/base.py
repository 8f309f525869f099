"""Registry of queries and the shared parts of their checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions import bands as b
from cohortspan.session import adapt
from cohortspan.sources.mapping import FRAILTY_LEVELS

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query; ``sql`` is its check, or None where SQL cannot say it."""

    def add(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: plain(run(adapt(spark), sf_dir)), sql)
        return run

    return add


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable cells: fractions rounded, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def case_sql(value: str, bands: b.Bands) -> str:
    """A band as a CASE expression."""
    null = "NULL" if bands.null_label is None else f"'{bands.null_label}'"
    tests = f"WHEN {value} IS NULL THEN {null} "
    if bands.lower is not None:
        tests += f"WHEN {value} < {bands.lower} THEN {null} "
    tests += " ".join(f"WHEN {value} <= {u} THEN '{label}'" for u, label in zip(bands.uppers, bands.labels))
    return f"CASE {tests} ELSE '{bands.labels[-1]}' END"


def unpivot_sql(table: str, variables: Sequence[str], keep: str = "") -> str:
    """Long form of characteristics as a UNION ALL."""
    tail = f", {keep}" if keep else ""
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, COALESCE(CAST({v} AS VARCHAR), 'unknown') AS value{tail} FROM {table}"
        for v in variables
    )


_STEPS = 4000
_SIMPSON = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _integral_sql(upper: str, value: str) -> str:
    """Simpson's rule from 0 to ``upper``; ``{u}`` in ``value`` is the point."""
    point = value.replace("{u}", f"(i * ({upper}) / {_STEPS})")
    return f"(({upper}) / {3 * _STEPS}.0 * list_sum(list_transform(range({_STEPS + 1}), lambda i: ({_SIMPSON}) * {point})))"


def chi2_p_sql(statistic: str, dof: str) -> str:
    """Tail of a chi-square statistic by integration over its square root."""
    density = f"pow({{u}}, {dof} - 1) * exp(-{{u}} * {{u}} / 2)"
    return f"1 - exp((1 - {dof} / 2.0) * ln(2) - lgamma({dof} / 2.0)) * {_integral_sql(f'sqrt({statistic})', density)}"


def t_p_sql(t: str, dof: str) -> str:
    """Two-sided tail of a t statistic by integration."""
    factor = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"1 - 2 * {factor} * {_integral_sql(f'abs({t})', f'pow(1 + {{u}} * {{u}} / ({dof}), -({dof} + 1) / 2.0)')}"


CTES = {
    "spans": """spans AS (
  SELECT o_orderkey AS pathway_id, o_custkey AS pid, o_orderpriority AS tfc, o_orderpriority AS specialty,
    CAST(o_orderdate AS DATE) AS start_date, stop_date,
    CAST(CASE WHEN o_orderkey % 9 < 7 THEN 30 + o_orderkey % 9 WHEN o_orderkey % 9 = 7 THEN 99 ELSE 40 END AS INTEGER) AS status,
    CASE o_orderstatus WHEN 'F' THEN 'OPRT|IRTT' WHEN 'O' THEN 'OPRT' END AS change_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'rtt_end_date' ELSE 'week_end_date' END AS end_type,
    CASE WHEN o_orderstatus = 'F' THEN 'inpatient' ELSE 'outpatient' END AS setting,
    CASE WHEN o_totalprice < 100000 THEN 'Urgent' WHEN o_totalprice < 350000 THEN 'Routine'
         WHEN o_totalprice < 450000 THEN 'Cancer' END AS priority,
    CAST(o_orderstatus = 'F' AS INTEGER) AS event,
    CAST(stop_date - CAST(o_orderdate AS DATE) AS INTEGER) AS wt
  FROM orders JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS stop_date FROM lineitem GROUP BY l_orderkey)
    ON l_orderkey = o_orderkey
  WHERE stop_date > CAST(o_orderdate AS DATE))""",
    "patients": f"""patients AS (
  SELECT c_custkey AS pid, c_mktsegment AS provider, c_acctbal AS balance,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    age, CAST(c_nationkey // 5 + 1 AS VARCHAR) AS quintile, r_name AS region,
    CAST(c_custkey % 5 AS INTEGER) AS ltc_count, CAST(c_custkey % 6 AS INTEGER) AS frailty_index,
    {case_sql('age', b.AGE)} AS age_band, {case_sql('c_custkey % 5', b.CONDITIONS)} AS ltc,
    {case_sql('c_custkey % 6', FRAILTY_LEVELS)} AS frailty
  FROM (SELECT *, CASE WHEN c_acctbal >= -900 THEN CAST(floor((c_acctbal + 1000) / 110) AS INTEGER) END AS age FROM customer)
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)""",
    "pathways": f"""pathways AS (
  SELECT spans.*, patients.* EXCLUDE (pid), {case_sql('wt', b.WAIT_5)} AS "group", {case_sql('wt', b.WAIT_4)} AS wait_band
  FROM spans JOIN patients ON patients.pid = spans.pid)""",
    "activity": """activity AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS day,
    count(*) FILTER (l_returnflag = 'A') AS use_a, count(*) FILTER (l_returnflag = 'N') AS use_n,
    count(*) FILTER (l_returnflag = 'R') AS use_r,
    CAST(round(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) FILTER (l_returnflag = 'A'), 0)) AS BIGINT) AS cost_a,
    CAST(round(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) FILTER (l_returnflag = 'N'), 0)) AS BIGINT) AS cost_n,
    CAST(round(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) FILTER (l_returnflag = 'R'), 0)) AS BIGINT) AS cost_r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "observed": """observed AS (
  SELECT CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem)""",
    "exits": """exits AS (
  SELECT o_custkey AS pid, CAST(max(l_shipdate) AS DATE) AS exit_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE c_acctbal < 0 GROUP BY 1)""",
    "attendances": """attendances AS (
  SELECT user_id AS pid, user_id || '-' || strftime(CAST(ts AS DATE), '%Y%m%d') AS pathway_id,
    CASE WHEN event_type = 'click' THEN 'other_contact' ELSE 'hospital_contact' END AS event_source,
    CAST(event_type = 'error' AS INTEGER) AS is_dna, CAST(event_type = 'signup' AS INTEGER) AS is_patient_canc,
    CAST(event_type = 'purchase' AS INTEGER) AS is_hospital_canc, CAST(ts AS DATE) AS attendance_date, value,
    c_mktsegment AS specialty, event_type
  FROM events JOIN customer ON c_custkey = user_id)""",
}
NEEDS = {"pathways": ("spans", "patients")}


def with_ctes(names: str, body: str, more: str = "") -> str:
    """``WITH`` the named parts (and what they need) in front of a query body."""
    chosen: list[str] = []
    for name in names.split():
        for part in (*NEEDS.get(name, ()), name):
            if part not in chosen:
                chosen.append(part)
    parts = [CTES[c] for c in chosen] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + body
