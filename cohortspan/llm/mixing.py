"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time 0 to 1, linear between
knots. Its integral, scaled to the source's target, is the source's cumulative
demand. Documents of a source are put in a fixed random order and fill that demand
end to end; the demand's inverse at a document's middle is its training position.
Rows are sorted by position with a range shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortspan.llm.common import durable, pack, quoted, running, unpack, word_count

#: Most times a document is used.
REPEATS = 3
#: Relative weight at the start and end of training of the sources that weigh 1, 2 and 3.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def cycled(sources: DataFrame) -> DataFrame:
    """Adds weight (1, 2, 3, repeating, by code point, null last) and the schedule's knots."""
    rank = F.row_number().over(W.orderBy(F.col("is_null"), F.col("source")))
    place = (rank - 1) % len(RAMPS)
    knots = F.element_at(F.array(*[F.array(F.struct(F.lit(0.0).alias("t"), F.lit(a).alias("w")), F.struct(F.lit(1.0).alias("t"), F.lit(b).alias("w"))) for a, b in RAMPS]), place + 1)
    return sources.withColumn("place", place).select("*", (F.col("place") + 1).alias("weight"), knots.alias("knots")).drop("place")


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, at most ``repeats`` times a source's size.

    What is above goes to the others by weight until none is above. Sorted by the
    ratio of limit to weight, the sources at their limit come first, and the level that
    the others share follows from running sums. One row per source in one task: the
    table of sources, not of documents.
    """
    every = W.partitionBy()
    limit = F.col("source_size") * repeats
    ratio = F.col("limit") / F.col("weight")
    order = W.orderBy("ratio", "is_null", "source")
    level = (F.col("total") - F.col("limits")) / F.col("weights")
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("limits", "ratio", "level"))).over(every)
    return (
        sources.withColumn("total", F.sum("source_size").over(every)).withColumn("limit", limit).withColumn("ratio", ratio)
        .withColumn("limits", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", level).withColumn("shared", first["level"])
        .withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("shared")))
        .drop("total", "limit", "ratio", "limits", "weights", "level", "shared")
    )


def segments(knots: Column, target: Column) -> Column:
    """Stretches of the schedule with their demand: (t, span, w, slope, start, end), scaled to the target."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("b")),
    )
    areas = F.transform(pairs, lambda p: (p["a"]["w"] + p["b"]["w"]) * (p["b"]["t"] - p["a"]["t"]) / 2)
    whole = F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)
    scale = target / whole
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            p["a"]["t"].alias("t"),
            (p["b"]["t"] - p["a"]["t"]).alias("span"),
            (p["a"]["w"] * scale).alias("w"),
            ((p["b"]["w"] - p["a"]["w"]) * scale / (p["b"]["t"] - p["a"]["t"])).alias("slope"),
            (F.aggregate(F.slice(areas, 1, i), F.lit(0.0), lambda s, x: s + x) * scale).alias("start"),
            (F.aggregate(F.slice(areas, 1, i + 1), F.lit(0.0), lambda s, x: s + x) * scale).alias("end"),
        ),
    )


def position(stretches: Column, demand: Column) -> Column:
    """Time at which the cumulative demand reaches ``demand``: the root of a quadratic."""
    at = F.coalesce(F.get(F.filter(stretches, lambda s: demand < s["end"]), F.lit(0)), F.element_at(stretches, -1))

    def invert(s: Column) -> Column:
        q = F.greatest(demand - s["start"], F.lit(0.0))
        root = F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * q, F.lit(0.0)))
        return F.least(s["t"] + s["span"], s["t"] + F.when(q == 0, F.lit(0.0)).otherwise(2 * q / (s["w"] + root)))

    return F.transform(F.array(at), invert)[0]


def schedule(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weigh=cycled, repeats: int = REPEATS, slim: bool = False) -> DataFrame:
    """Packed rows (``slim``: of the id alone) with id, size, source_size, target and the positions of their uses.

    ``weigh`` adds weight and knots to the table of sources. The order within a
    source is a hash of the doc_id (a null id counts as empty), then the id and size. A document's
    e-th use is taken if its middle lies below the target. Null and empty texts
    have size 0 and are used once at most. A null source is a source of its own.
    """
    rows = pack(
        docs,
        [doc_id] if slim else None,
        source=F.coalesce(quoted(source).cast("string"), F.lit("")),
        is_null=quoted(source).isNull(),
        size=word_count(quoted(text)),
        id=quoted(doc_id),
    )
    rows = rows.withColumn("order", F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"))
    # sources by a name that a null and an empty one do not share
    rows = rows.withColumn("key", F.concat(F.when(F.col("is_null"), "n").otherwise("s"), "source")).drop("is_null", "source")
    if slim:
        rows = durable(rows)
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    sources = sizes.select("key", "source_size", F.expr("substring(key, 2)").alias("source"), (F.substring("key", 1, 1) == "n").alias("is_null"))
    planned = targets(weigh(sources), repeats).select("key", "source_size", "target", segments(F.col("knots"), F.col("target")).alias("stretches"))
    placed = running(rows, "key", "order", ["id", "size"], "size", n).join(planned, "key")
    uses = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda e: e * F.col("source_size") + F.col("before") + F.col("size") / 2,
    )
    taken = F.filter(uses, lambda q: q < F.col("target"))
    placed = placed.withColumn("uses", F.when(F.col("size") > 0, taken).otherwise(F.slice(taken, 1, 1)))
    return placed.select("_row", "id", "size", "source_size", "target", F.transform("uses", lambda q: position(F.col("stretches"), q)).alias("positions"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training order: each row once per use, sorted by position, with the input's columns."""
    plan = schedule(docs, **options)
    used = plan.select("_row", "id", F.explode("positions").alias("position"))
    return unpack(used.orderBy("position", "id"))


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, uses and first position of every row.

    In training order; unused rows come last with a null position. An empty table gives no rows.
    """
    plan = schedule(docs, text, source, doc_id, slim=True, **options)
    uses = F.size("positions")
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * uses).alias("taken"),
        uses.alias("uses"), F.get("positions", F.lit(0)).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")
