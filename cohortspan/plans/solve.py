"""Least squares and Newton steps in SQL, for the checks of the model queries.

Matrices are tables (model, i, j, v). Gauss-Jordan elimination is written out, one
step per common table expression; a column whose pivot vanishes is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from cohortspan.plans.base import chi2_p_sql, t_p_sql

_PIVOT = 1e-9


def eliminate(name: str, p: int) -> str:
    """Steps ``name0`` (given, with p columns and whatever is augmented) to ``name{p}``."""
    steps = []
    for k in range(p):
        g = f"{name}{k}"
        steps.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT m.model, m.i, m.j, CASE WHEN pv.v IS NULL THEN m.v WHEN m.i = {k} THEN m.v / pv.v ELSE m.v - c.v * r.v / pv.v END AS v
  FROM {g} m
  LEFT JOIN (SELECT g.model, g.v FROM {g} g JOIN {name}0 o USING (model, i, j) WHERE g.i = {k} AND g.j = {k} AND g.v > {_PIVOT} * o.v AND o.v > 0) pv
    ON pv.model = m.model
  JOIN (SELECT model, j, v FROM {g} WHERE i = {k}) r ON r.model = m.model AND r.j = m.j
  JOIN (SELECT model, i, v FROM {g} WHERE j = {k}) c ON c.model = m.model AND c.i = m.i)""")
    kept = " UNION ALL ".join(
        f"SELECT g.model, {k} AS i FROM {name}{k} g JOIN {name}0 o USING (model, i, j) WHERE g.i = {k} AND g.j = {k} AND g.v > {_PIVOT} * o.v AND o.v > 0"
        for k in range(p)
    )
    return ",\n".join([*steps, f"{name}_kept AS MATERIALIZED ({kept})"])


def least_squares(name: str, source: str, columns: Sequence[str], y: str, model: str) -> str:
    """Tables ``{name}_cells``, ``_beta``, ``_inverse``, ``_kept``, ``_fit`` (per cell) and ``_model``."""
    p = len(columns)
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    return f"""{name}_rows AS (SELECT {model} AS model, {x} AS x, CAST({y} AS DOUBLE) AS y FROM {source}),
{name}_cells AS MATERIALIZED (SELECT model, x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM {name}_rows GROUP BY 1, 2),
{name}0 AS MATERIALIZED (
  SELECT model, i, j, sum(n * x[i + 1] * x[j + 1]) AS v FROM {name}_cells, range({p}) a(i), range({p}) b(j) GROUP BY 1, 2, 3
  UNION ALL SELECT model, i, {p}, sum(s * x[i + 1]) FROM {name}_cells, range({p}) a(i) GROUP BY 1, 2
  UNION ALL SELECT model, i, {p + 1} + j, CAST(i = j AS DOUBLE) FROM (SELECT DISTINCT model FROM {name}_cells), range({p}) a(i), range({p}) b(j)),
{eliminate(name, p)},
{name}_beta AS MATERIALIZED (SELECT g.model, g.i, g.v AS beta FROM {name}{p} g JOIN {name}_kept k USING (model, i) WHERE g.j = {p}),
{name}_inverse AS MATERIALIZED (
  SELECT g.model, g.i, g.j - {p + 1} AS j, g.v FROM {name}{p} g JOIN {name}_kept k USING (model, i)
  JOIN {name}_kept l ON l.model = g.model AND l.i = g.j - {p + 1}),
{name}_z AS MATERIALIZED (
  SELECT c.model, c.x, v.i, sum(v.v * c.x[v.j + 1]) AS z FROM {name}_cells c JOIN {name}_inverse v ON v.model = c.model GROUP BY 1, 2, 3),
{name}_fit AS MATERIALIZED (
  SELECT c.model, c.x, any_value(c.n) AS n, any_value(c.s) AS s, any_value(c.q) AS q, sum(b.beta * c.x[b.i + 1]) AS fitted, sum(z.z * c.x[z.i + 1]) AS h
  FROM {name}_cells c JOIN {name}_beta b ON b.model = c.model JOIN {name}_z z ON z.model = c.model AND z.x = c.x AND z.i = b.i GROUP BY 1, 2),
{name}_model AS MATERIALIZED (
  SELECT model, sum(n) AS n, sum(q - 2 * fitted * s + n * fitted * fitted) AS rss, (SELECT count(*) FROM {name}_kept k WHERE k.model = f.model) AS p
  FROM {name}_fit f GROUP BY 1)"""


def coefficients(name: str, terms: Sequence[str], robust: bool) -> str:
    """The whole coefficient table, dropped terms without numbers."""
    named = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    if robust:
        variance = f"""SELECT z.model, z.i, sum(z.z * z.z * CASE WHEN 1 - f.h > 1e-12 THEN (f.q - 2 * f.fitted * f.s + f.n * f.fitted * f.fitted) / pow(1 - f.h, 2) ELSE 0 END) AS v
  FROM {name}_z z JOIN {name}_fit f ON f.model = z.model AND f.x = z.x GROUP BY 1, 2"""
        p_value = chi2_p_sql("pow(estimate / se, 2)", "1")
    else:
        variance = f"SELECT v.model, v.i, v.v * m.rss / (m.n - m.p) AS v FROM {name}_inverse v JOIN {name}_model m USING (model) WHERE v.i = v.j"
        p_value = t_p_sql("estimate / se", "dof")
    return f"""SELECT model, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 4) AS t_value,
  round({p_value}, 5) AS p_value, round(estimate - 1.96 * se, 6) AS ci_low, round(estimate + 1.96 * se, 6) AS ci_high, dropped
FROM (SELECT m.model, t.term, b.beta AS estimate, sqrt(s.v) AS se, m.n - m.p AS dof, b.beta IS NULL AS dropped
  FROM {name}_model m CROSS JOIN (VALUES {named}) t(i, term)
  LEFT JOIN {name}_beta b ON b.model = m.model AND b.i = t.i
  LEFT JOIN ({variance}) s ON s.model = m.model AND s.i = t.i)"""


def influence(name: str, source: str, columns: Sequence[str], y: str, model: str) -> str:
    """``{name}_marked``: source rows with model, residual e, leverage h and Cook's distance."""
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    return f"""{name}_marked AS MATERIALIZED (
  SELECT r.*, e * e / (m.p * m.rss / (m.n - m.p)) * h / pow(1 - h, 2) AS cooks, 4 / m.n AS most
  FROM (SELECT s.*, f.model, f.x, CAST(s.{y} AS DOUBLE) - f.fitted AS e, f.h FROM {source} s
    JOIN {name}_fit f ON f.model = s.{model} AND f.x = {x}) r JOIN {name}_model m USING (model))"""


def breusch_pagan(name: str) -> str:
    """model, statistic, dof, p_value and n of the squared residuals of ``{name}_marked`` on the design."""
    return f"""SELECT model, round(statistic, 4) AS statistic, CAST(dof AS INTEGER) AS dof, round({chi2_p_sql('statistic', 'dof')}, 5) AS p_value, n FROM (
  SELECT t.model, t.n * (1 - (t.uu - e.explained) / (t.uu - t.u * t.u / t.n)) AS statistic, m.p - 1 AS dof, CAST(t.n AS BIGINT) AS n
  FROM (SELECT model, count(*) AS n, sum(e * e) AS u, sum(pow(e, 4)) AS uu FROM {name}_marked GROUP BY 1) t
  JOIN {name}_model m USING (model)
  JOIN (SELECT a.model, sum(a.b * v.v * c.b) AS explained
    FROM (SELECT model, i, sum(e * e * x[i + 1]) AS b FROM {name}_marked, range(64) r(i) WHERE i < len(x) GROUP BY 1, 2) a
    JOIN {name}_inverse v ON v.model = a.model AND v.i = a.i
    JOIN (SELECT model, i, sum(e * e * x[i + 1]) AS b FROM {name}_marked, range(64) r(i) WHERE i < len(x) GROUP BY 1, 2) c
      ON c.model = v.model AND c.i = v.j GROUP BY 1) e USING (model))"""


def logistic(name: str, cells: str, columns: Sequence[str], rounds: int = 9) -> str:
    """Newton steps of a logistic model on cells (columns, w rows, k of them treated): ``{name}_beta``."""
    p = len(columns)
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    parts = [f"{name}_b0 AS (SELECT i, 0.0::DOUBLE AS beta FROM range({p}) a(i))"]
    for r in range(rounds):
        step = f"{name}_s{r}_"
        parts.append(f"""{name}_p{r} AS MATERIALIZED (
  SELECT x, w, k, 1 / (1 + exp(-sum(x[i + 1] * beta))) AS p FROM (SELECT {x} AS x, w::DOUBLE AS w, k::DOUBLE AS k FROM {cells}), {name}_b{r} GROUP BY ALL),
{step}0 AS MATERIALIZED (
  SELECT 0 AS model, i, j, sum(w * p * (1 - p) * x[i + 1] * x[j + 1]) AS v FROM {name}_p{r}, range({p}) a(i), range({p}) b(j) GROUP BY 2, 3
  UNION ALL SELECT 0, i, {p}, sum((k - w * p) * x[i + 1]) FROM {name}_p{r}, range({p}) a(i) GROUP BY 2),
{eliminate(step, p)},
{name}_b{r + 1} AS MATERIALIZED (SELECT b.i, beta + g.v AS beta FROM {name}_b{r} b JOIN {step}{p} g ON g.i = b.i AND g.j = {p})""")
    parts.append(f"{name}_beta AS (SELECT * FROM {name}_b{rounds})")
    return ",\n".join(parts)


def cox(name: str, source: str, time: str, event: str, factor: str, levels: Sequence[str], rounds: int = 8) -> str:
    """Newton steps of proportional hazards with Efron ties: ``{name}_beta`` (i, beta, variance)."""
    p = len(levels) - 1
    counts = ", ".join(
        f"sum(count(*) FILTER ({factor} = '{level}')) OVER (ORDER BY {time} DESC)::DOUBLE AS n{i}, coalesce(sum({event}) FILTER ({factor} = '{level}'), 0)::DOUBLE AS d{i}"
        for i, level in enumerate(levels)
    )
    listed = ", ".join(f"'{level}'" for level in levels)
    n, d = ("[" + ", ".join(f"{c}{i}" for i in range(p + 1)) + "]" for c in "nd")
    parts = [f"""{name}_ties AS MATERIALIZED (
  SELECT {time} AS t, n, d, list_sum(d) AS dead, unnest(range(CAST(list_sum(d) AS BIGINT))) AS j
  FROM (SELECT {time}, {n} AS n, {d} AS d FROM (SELECT {time}, {counts} FROM {source} WHERE {factor} IN ({listed}) GROUP BY {time})) WHERE list_sum(d) > 0),
{name}_b0 AS (SELECT i, 0.0::DOUBLE AS beta FROM range({p}) a(i))"""]
    for r in range(rounds):
        step = f"{name}_s{r}_"
        parts.append(f"""{name}_w{r} AS MATERIALIZED (
  SELECT t, j, dead, d, list_transform(range({p + 1}), lambda k: (n[k + 1] - j / dead * d[k + 1]) * w[k + 1]) AS r
  FROM {name}_ties, (SELECT list_concat([1.0::DOUBLE], list(exp(beta) ORDER BY i)) AS w FROM {name}_b{r})),
{step}0 AS MATERIALIZED (
  SELECT 0 AS model, i, j, v FROM (
    SELECT a.i, b.j, sum(CASE WHEN a.i = b.j THEN r[a.i + 2] / list_sum(r) ELSE 0 END - r[a.i + 2] * r[b.j + 2] / pow(list_sum(r), 2)) AS v
    FROM {name}_w{r}, range({p}) a(i), range({p}) b(j) GROUP BY 1, 2)
  UNION ALL SELECT 0, i, {p}, sum(d[i + 2] / dead - r[i + 2] / list_sum(r)) FROM {name}_w{r}, range({p}) a(i) GROUP BY 2
  UNION ALL SELECT 0, i, {p + 1} + j, CAST(i = j AS DOUBLE) FROM range({p}) a(i), range({p}) b(j)),
{eliminate(step, p)},
{name}_b{r + 1} AS MATERIALIZED (SELECT b.i, beta + g.v AS beta FROM {name}_b{r} b JOIN {step}{p} g ON g.i = b.i AND g.j = {p})""")
    last = f"{name}_s{rounds - 1}_{p}"
    parts.append(f"""{name}_beta AS (SELECT b.i, b.beta, g.v AS variance FROM {name}_b{rounds} b JOIN {last} g ON g.i = b.i AND g.j = {p + 1} + b.i)""")
    return ",\n".join(parts)
