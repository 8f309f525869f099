"""Secrets: fixed patterns, and strings that look random to character Markov models.

Two models of neighbouring characters are counted, one on random strings (the values
that the patterns find) and one on ordinary identifiers of the same documents. A
candidate is a secret when the log-likelihood ratio of the two is high. Everything runs
as DataFrame functions; only the table of character pairs, of fixed size, passes through
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import quoted

#: Fixed patterns of the contract, in its order, with the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: The same kinds where a match that is too short cannot hide another.
QUICK = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: Strings that the models judge, from 16 characters on (of digits alone, such as card numbers, from 20),
#: and words that they learn as ordinary.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]{20,}+|(?![0-9]++(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}+)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Sizes that one block of a running sum holds.
BLOCK = 64
#: Documents that the models learn from, about; chosen by a hash.
TRAIN_DOCS = 10_000
#: Pairs that a row of the random model, and of the ordinary one, has seen beforehand, and the share of
#: the random model that is any letter or digit alike, for alphabets the samples lack.
RANDOM_PRIOR, ORDINARY_PRIOR, ANY = 62.0, 20.0, 0.5
#: Log-likelihood ratio above which a candidate is a secret.
THRESHOLD = 10.0


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _before(sizes: Column) -> Column:
    """For each of an array of sizes the sum of those before it.

    Sums run within blocks, then over the blocks, so the work does not grow with the square of the number.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def blocks(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int") - 1))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)), start, add))

    def joined(parts: Column) -> Column:
        bases = F.aggregate(F.transform(parts, lambda b: b["at"]), start, add, lambda s: s["out"])
        return F.flatten(F.zip_with(parts, bases, lambda b, base: F.transform(b["out"], lambda x: x + base)))

    return _bound(sizes, lambda all_: _bound(blocks(all_), joined))


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches (start, end, value) whose ``group`` is long enough, in code points.

    The texts between matches come from a split, the matches from an extraction; their
    lengths add up to the places.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(hits, counted, lambda h, c: F.struct(h.alias("value"), (F.length(c) >= least).alias("counts")))
    parts = _bound(pairs, lambda all_: F.zip_with(
        F.slice(gaps, F.lit(1), F.size(all_)), all_, lambda g, h: F.struct(F.length(g).alias("gap"), h["value"].alias("value"), h["counts"].alias("counts"))
    ))

    def placed(all_: Column) -> Column:
        before = _before(F.transform(all_, lambda p: p["gap"] + F.length(p["value"])))
        whole = F.zip_with(all_, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["value"])).alias("end"), p["value"].alias("value"), p["counts"].alias("counts")
        ))
        kept = F.filter(whole, lambda x: x["counts"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return _bound(parts, placed)


def _apart(spans: Column, others: Column) -> Column:
    """Of spans that do not meet each other those that meet none of ``others``.

    All edges are sorted by place, and running counts of the others' edges are compared: a span
    meets none if as many others end up to its start as start before its end.
    """
    edge = lambda at, kind, start, end: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    edges = F.array_sort(F.concat(
        F.transform(others, lambda b: edge(b["end"], 0, 0, 1)), F.transform(spans, lambda c: edge(c["end"], 1, 0, 0)),
        F.transform(others, lambda b: edge(b["start"], 3, 1, 0)), F.transform(spans, lambda c: edge(c["start"], 2, 0, 0)),
    ))

    def counted(all_: Column) -> Column:
        sums = F.arrays_zip(
            F.transform(all_, lambda e: e["kind"]).alias("kind"),
            _before(F.transform(all_, lambda e: e["start"])).alias("starts"), _before(F.transform(all_, lambda e: e["end"])).alias("ends"),
        )
        return _bound(sums, lambda known: F.zip_with(
            F.filter(known, lambda e: e["kind"] == 2), F.filter(known, lambda e: e["kind"] == 1), lambda start, end: start["ends"] == end["starts"]
        ))

    free = _bound(edges, counted)
    marked = F.zip_with(spans, free, lambda c, alone: F.struct(c.alias("span"), alone.alias("alone")))
    return F.transform(F.filter(marked, lambda m: m["alone"]), lambda m: m["span"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _pairs(token: Column) -> Column:
    """Index of each neighbouring pair of characters; what is not in the alphabet, and the start, is 0."""
    places = F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    before = F.slice(F.concat(F.array(F.lit(0)), places), F.lit(1), F.size(places))
    return F.zip_with(before, places, lambda a, b: a * (len(ALPHABET) + 1) + b)


def sample(docs: DataFrame, text: str, doc_id: str, train_docs: int) -> DataFrame:
    """About ``train_docs`` of the distinct (id, text) of a table, as (h, text), chosen by their hash."""
    scale = 1 << 30
    share = min(scale, scale * train_docs // max(1, docs.count()))
    rows = docs.select(F.xxhash64(quoted(doc_id), quoted(text)).alias("h"), quoted(text).alias("text")).where("text is not null")
    return rows.where(F.pmod("h", F.lit(scale)) < share).groupBy("h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> list[float]:
    """Log-likelihood ratio of every character pair, random over ordinary.

    Learns from about ``train_docs`` documents, chosen by a hash of id and text, so that of equal
    texts under many ids as many are taken as of others; rows equal in both count once. The patterns
    label the samples: the distinct values of 16 characters or more that they find are random, the
    shorter identifiers outside of them ordinary. Without samples all ratios are near 0.
    """
    rows = sample(docs, text, doc_id, train_docs)
    t = F.col("text")
    found = [F.regexp_extract_all(t, F.lit(QUICK[kind]), F.lit(group)) for kind, _, group, _ in KINDS]
    random = F.filter(F.concat(*found), lambda v: F.length(v) >= 16)
    rest = F.regexp_replace(t, "|".join(QUICK.values()), " ")
    # a string long enough to be judged is no sample of what is ordinary
    words = F.regexp_extract_all(F.regexp_replace(rest, CANDIDATE, " "), F.lit(IDENTIFIER), F.lit(0))
    label = lambda k: lambda v: F.struct(F.lit(k).alias("random"), v.alias("token"))
    samples = rows.select(F.inline(F.concat(F.transform(random, label(1)), F.transform(words, label(0)))))
    weighed = samples.groupBy("random", "token").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("random") == 1, 1).otherwise(F.col("n")))
    counted = weighed.select("random", "n", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = {(r["random"], r["pair"]): r["n"] for r in counted.collect()}
    return ratios(counts)


def ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    """Ratios from the counts of (class, pair).

    A row of the ordinary model backs off to how often its characters are used at all, a row of the
    random model to all letters and digits alike. Characters that join words say nothing.
    """
    size, told = len(ALPHABET) + 1, len(ALPHABET.rstrip("+/_=-"))
    rows = {k: [[counts.get((k, a * size + b), 0) for b in range(size)] for a in range(size)] for k in (0, 1)}
    used = [sum(rows[0][a][b] for a in range(size)) + 0.5 for b in range(1, told + 1)]
    out = [0.0] * (size * size)
    for a in range(size):
        for b in range(1, told + 1):
            ordinary = (rows[0][a][b] + ORDINARY_PRIOR * used[b - 1] / sum(used)) / (sum(rows[0][a]) + ORDINARY_PRIOR)
            random = (rows[1][a][b] + RANDOM_PRIOR / told) / (sum(rows[1][a]) + RANDOM_PRIOR)
            out[a * size + b] = math.log((ANY / told + (1 - ANY) * random) / ordinary)
    return out


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256, all spans and n_random of every row.

    Spans of the models (kind ``random``) are added where they meet none of the patterns'. Null and
    empty texts have no spans, and the hash of the empty string. Repeated rows give equal results;
    other columns are ignored.
    """
    table = F.split(F.lit(",".join(map(repr, train(docs, text, doc_id, train_docs)))), ",").cast("array<double>")
    t = F.col("text")
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    names = [kind for kind, *_ in KINDS]
    searched = [
        F.when(t.rlike(QUICK[kind]), _spans(t, QUICK[kind], group, least)).otherwise(_none()).alias(kind) for kind, _, group, least in KINDS
    ]
    judged = F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, 0, 0)).otherwise(_none()).alias("judged")
    rows = rows.select("doc_id", *searched, judged)

    def ratio(token: Column) -> Column:
        return F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.element_at(table, p + 1))

    # the expensive comparison of edges only where there is something to compare
    rows = rows.withColumn("likely", F.filter("judged", lambda c: ratio(c["value"]) > threshold))
    base = F.concat(*names)
    met = (F.size("likely") > 0) & (F.size(base) > 0)
    rows = rows.withColumn("random", F.when(met, _apart(F.col("likely"), base)).otherwise(F.col("likely")))

    def listed(kinds: list[str]) -> Column:
        def tag(k: int, kind: str) -> Column:
            return F.transform(kind, lambda s: F.struct(s["start"], F.lit(k).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))

        tagged = [tag(k, kind) for k, kind in enumerate(kinds)]
        return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: s["text"]), ",")

    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in names]
    return rows.select(
        "doc_id", *counts, F.sha2(listed(names).cast("binary"), 256).alias("base_sha256"),
        listed([*names, "random"]).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
