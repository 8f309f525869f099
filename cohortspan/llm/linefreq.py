"""Line dedup by frequency within a site.

A line is boilerplate on a site if more than a share of the site's pages contain it.
Lines are compared without white space around them; blank lines are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import pack, quoted

#: Share of a site's pages above which a line is dropped, and the least number of such
#: pages, so that a site of one or two pages keeps its text.
MAX_RATIO = 0.1
MIN_PAGES = 3
#: Seed of the second of two independent hashes.
_SEED = 7


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _name(line: Column) -> Column:
    """128-bit identity of a trimmed line, null for a blank one; texts of lines need not move."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(_SEED), bare).alias("b")))


def boilerplate(docs: DataFrame, text: str = "text", site: str | Column = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, name, pages, ratio) of the lines to drop.

    A page counts once for each of its different lines. Counts are summed before the
    shuffle, by site and line, so neither a large site nor a common line meets in one task.
    """
    of = quoted(site) if isinstance(site, str) else site
    rows = docs.select(of.alias("site"), quoted(text).alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("total"))
    names = F.array_distinct(F.transform(lines_of(F.col("text")), _name))
    counts = rows.select("site", F.explode(names).alias("name")).where("name is not null").groupBy("site", "name").agg(F.count("*").alias("pages"))
    counts = counts.where(F.col("pages") >= min_pages).withColumnRenamed("site", "_site")
    ratio = (F.col("pages") / F.col("total")).alias("ratio")
    return counts.join(totals, F.col("_site").eqNullSafe(F.col("site"))).select("site", "name", "pages", ratio).where(F.col("ratio") > max_ratio)


def cleaned(
    docs: DataFrame, keep: list[str], text: str = "text", site: str | Column = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Packed rows (``keep``; without the text), text and ``drop``, the places of the lines to drop.

    Rows of one site and text lose the same lines, so the drops are found once per site and
    text and come back by that key; no row number is needed that a lost task might deal anew.
    """
    of = quoted(site) if isinstance(site, str) else site
    bad = boilerplate(docs, text, site, max_ratio, min_pages)
    key = F.struct(F.xxhash64(quoted(text)).alias("a"), F.xxhash64(F.lit(_SEED), quoted(text)).alias("b"))
    own = F.struct(of.isNull().alias("none"), F.coalesce(of.cast("string"), F.lit("")).alias("site"))
    rows = docs.select(own.alias("own"), key.alias("key"), F.posexplode(F.transform(lines_of(quoted(text)), _name)).alias("place", "name")).where("name is not null")
    bad = bad.select(F.struct(F.col("site").isNull().alias("none"), F.coalesce(F.col("site").cast("string"), F.lit("")).alias("site")).alias("own"), "name")
    drops = rows.join(bad, ["own", "name"]).groupBy("own", "key").agg(F.collect_set("place").alias("drop"))
    kept = pack(docs, keep, own=own, key=key, text=quoted(text))
    return kept.join(drops, ["own", "key"], "left").select("_row", "text", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))


def _without(text: Column, drop: Column) -> Column:
    left = F.filter(lines_of(text), lambda line, k: ~F.array_contains(drop, k))
    return F.when(F.size(drop) == 0, text).otherwise(F.array_join(left, "\n"))


def drop_lines(docs: DataFrame, text: str = "text", site: str | Column = "source", **options) -> DataFrame:
    """The rows without boilerplate lines, with the input's columns.

    A null text stays null, a text whose lines all go becomes empty. Rows with a null site form a
    site of their own. Repeated rows count as pages and lose the same lines.
    """
    others = [c for c in docs.columns if c != text]
    rows = cleaned(docs, others, text, site, **options)
    left = _without(F.col("text"), F.col("drop"))
    return rows.select(*[left.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, text: str = "text", site: str | Column = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and text_sha256 of what stays (null: as empty) of every row."""
    rows = cleaned(docs, [doc_id], text, site, **options)
    left = _without(F.coalesce("text", F.lit("")), F.col("drop"))
    return rows.select(
        F.col("_row")[doc_id].alias("doc_id"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"), F.sha2(left.cast("binary"), 256).alias("text_sha256"),
    )
