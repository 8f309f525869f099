"""Small-number suppression.

The numeric cells stay as they are; the report text is a separate column, so
that totals never add up strings. Modes:

``count``        a small count hides the count and its percentage
``independent``  count and percentage are tested one by one
``stat``         every listed statistic is tested by itself
``row``          a small row total hides the whole row, else as ``count``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(column: str, hidden: Column, mark: str) -> Column:
    return F.when(hidden, F.lit(mark)).otherwise(F.col(column).cast("string"))


def suppress(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] = (),
    stats: Sequence[str] = (),
    k: int = 5,
    mode: str = "count",
    total: str | None = None,
    mark: str | None = None,
    suffix: str = "_text",
) -> DataFrame:
    """Add a text column per cell, small cells replaced by ``<k``."""
    mark = mark or f"<{k}"
    small = {c: F.col(c) < k for pair in pairs for c in pair} | {c: F.col(c) < k for c in stats}
    out: dict[str, Column] = {}
    for n, pct in pairs:
        if mode == "independent":
            out[n + suffix], out[pct + suffix] = _text(n, small[n], mark), _text(pct, small[pct], mark)
        elif mode == "count":
            out[n + suffix], out[pct + suffix] = _text(n, small[n], mark), _text(pct, small[n], mark)
        elif mode == "row":
            if total is None:
                raise ValueError("mode 'row' needs the total column")
            hidden = (F.col(total) < k) | small[n]
            out[n + suffix], out[pct + suffix] = _text(n, hidden, mark), _text(pct, hidden, mark)
        else:
            raise ValueError(f"unknown mode {mode!r}")
    if mode == "row" and total is not None:
        out[total + suffix] = _text(total, F.col(total) < k, mark)
    for c in stats:
        out[c + suffix] = _text(c, small[c], mark)
    return df.withColumns(out)


def secondary_flag(df: DataFrame, row_keys: Sequence[str], n: str = "n", k: int = 5, tie: str | None = None) -> DataFrame:
    """Flag cells to hide so that a single small cell cannot be worked out.

    When exactly one cell of a row is small, the next smallest is flagged too.
    ``df`` is a result table: a row has as many cells as there are bands. ``tie``
    orders cells of equal size.
    """
    row = Window.partitionBy(*row_keys)
    order = row.orderBy(*[c for c in (n, tie) if c])
    few = F.sum((F.col(n) < k).cast("int")).over(row)
    rank = F.row_number().over(order)
    return df.withColumn("suppressed", (F.col(n) < k) | ((few == 1) & (rank == 2)))


def closed_flag(df: DataFrame, table_keys: Sequence[str], row: str, column: str, n: str = "n", k: int = 5) -> DataFrame:
    """Flag cells to hide so that neither row nor column totals give a hidden cell back.

    Every small cell becomes a corner of a rectangle of hidden cells: its row and its column each lose
    another cell, and so does the place where those two cross. The other three corners hold at least one
    unit each, so a unit can go round the rectangle with all totals kept, and no cell of it is known. Of all
    rectangles the one that hides the fewest units beyond the small cells is taken (ties by row, then
    column). Adds ``small``, ``suppressed`` and ``open``: a small cell without a rectangle, whose totals
    must be hidden too. ``df`` is a result table, one row per cell; cells that are absent are not published.
    A null row or column is a value of its own, a null count is small but no corner.
    """
    keys = [*table_keys]
    cells = df.select(
        *keys, F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(n).alias("_n"), F.coalesce(F.col(n) < k, F.lit(True)).alias("_small")
    )

    def named(prefix: str) -> DataFrame:
        chosen = cells.select(
            *[F.col(c).alias(f"{prefix}_k{i}") for i, c in enumerate(keys)], F.col("_r").alias(f"{prefix}_r"), F.col("_c").alias(f"{prefix}_c"),
            F.col("_n").alias(f"{prefix}_n"), F.when(F.col("_small"), 0).otherwise(F.col("_n")).alias(f"{prefix}_cost"), F.col("_small").alias(f"{prefix}_small"),
        )
        return chosen if prefix == "a" else chosen.filter(F.col(f"{prefix}_n") >= 1)

    def same(left: str, right: str, *more: str) -> str:
        return " AND ".join(f"{left}_{c} <=> {right}_{c}" for c in [*[f"k{i}" for i in range(len(keys))], *more])

    corners = (
        named("a").filter("a_small")
        .join(named("b"), F.expr(same("a", "b", "r") + " AND NOT a_c <=> b_c"))
        .join(named("c"), F.expr(same("a", "c", "c") + " AND NOT a_r <=> c_r"))
        .join(named("d"), F.expr(" AND ".join(filter(None, [same("a", "d"), same("c", "d", "r"), same("b", "d", "c")]))))
    )
    own = [f"a_k{i}" for i in range(len(keys))]
    # a null sorts first, as in an ascending order
    order = F.struct((F.expr("b_cost + c_cost + d_cost")).alias("cost"), F.col("c_r").alias("row"), F.col("b_c").alias("column"))
    chosen = corners.groupBy(*own, "a_r", "a_c").agg(F.min(order).alias("best"))
    hidden = chosen.select(
        *[F.col(c).alias(k_) for c, k_ in zip(own, [f"h_k{i}" for i in range(len(keys))])],
        F.inline(F.array(*[
            F.struct(F.col(r).alias("h_r"), F.col(c).alias("h_c"), F.lit(first).alias("h_first"))
            for r, c, first in (("a_r", "a_c", True), ("a_r", "best.column", False), ("best.row", "a_c", False), ("best.row", "best.column", False))
        ])),
    )
    hidden = hidden.groupBy(*[f"h_k{i}" for i in range(len(keys))], "h_r", "h_c").agg(F.max("h_first").alias("h_first"))
    match = [F.col(c).eqNullSafe(F.col(f"h_k{i}")) for i, c in enumerate(keys)] + [F.col(row).eqNullSafe(F.col("h_r")), F.col(column).eqNullSafe(F.col("h_c"))]
    small = F.coalesce(F.col(n) < k, F.lit(True))
    on = match[0]
    for part in match[1:]:
        on = on & part
    flagged = df.join(hidden, on, "left").withColumns(
        {"small": small, "suppressed": small | F.col("h_first").isNotNull(), "open": small & ~F.coalesce(F.col("h_first"), F.lit(False))}
    )
    return flagged.drop(*[f"h_k{i}" for i in range(len(keys))], "h_r", "h_c", "h_first")
