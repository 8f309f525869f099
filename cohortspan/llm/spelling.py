"""Spelling variants: frequent words one edit apart, found by FM-index search schemes.

The vocabulary is cut by word length, and each length by a hash into parts that one task can
index. Words are searched in the parts of their own length (a replaced code point) and of the
next (an inserted one); a deletion is an insertion seen from the other word. Every word follows
its commonest near word, if that is common enough, to the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import durable, look_up, quoted
from cohortspan.llm.fmindex import Index

#: Fixed values of the contract: letters of a run, and which of them are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of an index part, about.
PART = 1 << 20
#: Code points of words searched at once, about.
BATCH = 1 << 17
#: Words follow each other by a factor of at least two, so chains of 64-bit counts are short.
_ROUNDS = 8


def runs_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: str = RUN) -> DataFrame:
    """(doc_id, run) of every run of letters of every text, A-Z lower-cased."""
    run = F.explode(F.regexp_extract_all(quoted(text), F.lit(letters), F.lit(0)))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    return docs.select(quoted(doc_id).alias("doc_id"), run.alias("run")).select("doc_id", low.alias("run"))


def with_slips(runs: DataFrame, every: int = 199) -> DataFrame:
    """(word): runs of which about one in ``every`` has lost a code point.

    Which ones, and where, follows from the crc32 of ``<doc_id>:<run>``; a null doc_id is empty there.
    """
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    slip = F.concat(
        F.substring("run", F.lit(1), F.pmod("h", F.length("run")).cast("int")),
        F.substring("run", (F.pmod("h", F.length("run")) + 2).cast("int"), F.length("run")),
    )
    hashed = runs.select("run", F.crc32(named.cast("binary")).alias("h"))
    return hashed.select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of words of at least ``length`` code points that occur at least ``least`` times."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _targets(steps: tuple[int, ...]) -> Column:
    """Cells of a word: the parts of the other role at lengths that differ by ``steps``."""
    some = []
    for step in steps:
        length, parts = F.col("len") + step, F.col(f"parts{step}")
        cells = F.transform(F.sequence(F.lit(1), parts), lambda part: F.struct(length.alias("to_len"), part.alias("to_part")))  # noqa: B023
        some.append(F.when(parts > 0, cells).otherwise(F.array().cast("array<struct<to_len:int,to_part:int>>")))
    return F.inline(F.concat(*some))


def near_pairs(vocab: DataFrame, part: int | None = None) -> DataFrame:
    """(word, other, other_n): every ordered pair of words of (word, n) one edit apart, once."""
    part = part or PART
    vocab = vocab.withColumn("len", F.length("word"))
    sizes = vocab.groupBy("len").agg(F.count("*").alias("n"))
    sizes = durable(sizes.withColumn("parts0", F.ceil(F.col("n") * F.col("len") / part).cast("int")))
    for step in (-1, 1):
        there = sizes.select((F.col("len") - step).alias("len"), F.col("parts0").alias(f"parts{step}"))
        sizes = sizes.join(there, "len", "left").fillna(0, [f"parts{step}"])
    numbers = vocab.select("word", F.col("n").alias("count"), "len")
    own = durable(look_up(numbers, sizes, ["len"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts0")).cast("int") + 1))
    cell = ["index_len", "index_part", "query_len", "query_part"]
    indexed = own.select("word", "count", "len", "part", _targets((0, -1))).select(
        "word", "count", F.col("len").alias(cell[0]), F.col("part").alias(cell[1]), F.col("to_len").alias(cell[2]), F.col("to_part").alias(cell[3]))
    asked = own.select("word", "count", "len", "part", _targets((0, 1))).select(
        F.col("word").alias("word"), F.col("count").alias("count"), F.col("to_len").alias(cell[0]), F.col("to_part").alias(cell[1]), F.col("len").alias(cell[2]), F.col("part").alias(cell[3]))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # of the same table as the indexed

    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"word": [], "n": [], "other": [], "other_n": []}).astype({"n": "int64", "other_n": "int64"})]
        if len(index) and len(queries):
            index = index.sort_values("word", ignore_index=True)
            words, counts = index["word"].to_numpy(object), index["count"].to_numpy()
            fm, insert = Index(list(words)), bool(key[0] > key[2])
            batch = max(1, BATCH // int(key[2]))
            for at in range(0, len(queries), batch):
                names = queries["word"].iloc[at:at + batch].to_numpy(object)
                own = queries["count"].iloc[at:at + batch].to_numpy()
                points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").reshape(len(names), -1)
                rows, hits = fm.one_error(fm.codes(points), insert)
                found.append(pd.DataFrame({"word": names[rows], "n": own[rows], "other": words[hits], "other_n": counts[hits]}))
        return pd.concat(found, ignore_index=True)

    pairs = indexed.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(search, "word string, n long, other string, other_n long")
    # replacements are found from both words, insertions from the shorter one
    longer = F.length("other") > F.length("word")
    both = F.when(longer, F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(F.inline(both.otherwise(F.array(F.struct("word", "other", "other_n")))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling the steps."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(_ROUNDS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward.select("root"), "root", "left_semi").isEmpty():
            return now
        now = durable(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    raise RuntimeError("forms did not settle")


def grouped(vocab: DataFrame, ratio: int = 5, part: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (word, n).

    The form is the near word of largest n (ties: smallest), if it occurs at least ``ratio``
    times as often, two at least; the root is the last of the forms from the word on.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    vocab = durable(vocab)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = near_pairs(vocab, part).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    rows = durable(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
    ))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near and form_n of the frequent words of all texts, slips included.

    A null text has no words; rows that repeat a doc_id count as rows of their own. Other columns
    are ignored.
    """
    return grouped(vocabulary(with_slips(runs_of(docs, text, doc_id))))
