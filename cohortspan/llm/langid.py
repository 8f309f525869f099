"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import pack, quoted, unpack

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Documents per language that the model learns from, about; chosen by a hash.
PER_LANGUAGE = 1500
#: The model is a matrix of BUCKETS x languages, so their number has a bound.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
#: Likeness to the labelled sample (0: no n-gram of it, 1: its own mean) below which a text is in none of
#: its languages. Documents of sf0.1 have 0.848 and more, random Latin letters 0.5, other scripts 0.1.
MIN_LIKENESS = 0.6
#: n-grams and labelled rows a language must have for its likeness to say anything; a few texts are
#: unlike any other text of their language.
LEAST_GRAMS, LEAST_ROWS = BUCKETS, 20
#: Code points scored at once.
SLICE = 1 << 18
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; ASCII other than letters counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, _FOLD[np.minimum(points, 127)], points)


def gram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point but the last ones."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        mixed = (mixed ^ points[k:k + n]) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.int64)


def slices(points: np.ndarray, order: int) -> Iterator[np.ndarray]:
    for at in range(0, max(1, len(points) - order + 1), SLICE):
        yield points[at:at + SLICE + order - 1]


@dataclass(frozen=True)
class Model:
    """Languages in code point order, log-probabilities (BUCKETS x languages), log-priors.

    ``usual`` is the mean log-probability of an n-gram in each language's sample, NaN for a small one.
    """

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray
    usual: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-posterior up to a constant, one row per text.

        The batch is one sparse matrix of n-gram occurrences: its rows are stretches of
        one bucket array, and the product with the weights sums up each stretch.
        """
        out = np.tile(self.priors, (len(texts), 1))
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            points = code_points(text)
            for order in ORDERS:
                for part in slices(points, order):
                    buckets = gram_buckets(part, order)
                    if len(buckets):
                        held.append((i, buckets))
                        size += len(buckets)
                    if size >= SLICE:
                        self._add(out, held)
                        held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        if held:
            starts = np.cumsum([0] + [len(b) for _, b in held[:-1]])
            terms = self.weights.take(np.concatenate([b for _, b in held]), axis=0)
            np.add.at(out, [i for i, _ in held], np.add.reduceat(terms, starts, axis=0, dtype=np.float64))

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        return self._predict(list(texts))[:2]

    def judged(self, texts: Iterable[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The predictions and how like each text is to the sample of its language, per n-gram.

        A posterior only compares languages and is near 1 for any text of some length;
        likeness does not grow with length. It is 1 where the sample is too small to say.
        """
        texts = list(texts)
        names, best, rows, scores = self._predict(texts)
        like = [0.0] * len(texts)
        if rows:
            least = self.weights.min(axis=0)
            usual = np.full(len(self.languages), np.nan) if self.usual is None else self.usual
            top = scores.argmax(axis=1)
            sizes = [len(texts[i].lower()) for i in rows]
            grams = np.array([sum(max(0, n - order + 1) for order in ORDERS) for n in sizes])
            mean = (scores.max(axis=1) - self.priors[top]) / grams
            for i, x in zip(rows, ((mean - least[top]) / (usual - least)[top]).tolist()):
                like[i] = 1.0 if np.isnan(x) else x
        return names, best, like

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int], np.ndarray]:
        """Predictions, and places and scores of the texts with a letter."""
        names, best = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages or not rows:
            return names, best, [], np.zeros((0, 0))
        scores = self.scores([texts[i] for i in rows])
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, k, p in zip(rows, scores.argmax(axis=1).tolist(), odds.max(axis=1).tolist()):
            names[i], best[i] = self.languages[k], p
        return names, best, rows, scores


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, text: str, label: str, doc_id: str, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of id and text.

    Rows with a null text or label are no labelled rows. Without any, the model is
    empty and knows no language.
    """
    rows = labelled.select(quoted(label).alias("label"), quoted(text).alias("text"), quoted(doc_id).alias("id")).where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    languages = tuple(sorted(counts))
    scale = 1 << 30
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, scale * per_language // n))])
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < shares[F.col("label")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch["label"], batch["text"]):
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                points = code_points(value)
                for order in ORDERS:
                    for part in slices(points, order):
                        total += np.bincount(gram_buckets(part, order), minlength=BUCKETS)
        for name, total in sums.items():
            used = total.nonzero()[0]
            yield pd.DataFrame({"label": name, "bucket": used, "n": total[used]})

    # few tasks on purpose: the sample is bounded, and each task returns one row per language and bucket
    grams = chosen.repartition(8, F.xxhash64("id", "text")).mapInPandas(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.full((BUCKETS, len(languages)), SMOOTHING)
    if len(grams):
        np.add.at(totals, (grams["bucket"].to_numpy(), np.searchsorted(languages, grams["label"].to_numpy(dtype=object))), grams["n"].to_numpy())
    weights = np.log(totals) - np.log(totals.sum(axis=0))
    seen = totals - SMOOTHING
    sizes = np.array([counts[k] for k in languages], float)
    enough = (seen.sum(axis=0) >= LEAST_GRAMS) & (sizes >= LEAST_ROWS)
    usual = np.where(enough, (seen * weights).sum(axis=0) / np.maximum(1, seen.sum(axis=0)), np.nan)
    return Model(languages, weights.astype(np.float32), np.log(sizes / sizes.sum()), usual)


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """Struct (lang, score) of a text column; the model travels as a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, best = shared.value.predict(texts)
        return pd.DataFrame({"lang": names, "score": best})

    return of(text)


def identify(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior of the prediction) of every row.

    Learns from rows that are not held out and have text and label. A null text, one
    without a letter, or any text when nothing was learned is ``und`` with score 0.
    Repeated rows are predicted alike; other columns are ignored.
    """
    model = train(docs.where(~held_out(quoted(doc_id))), text, label, doc_id)
    found = predicted(docs, model, quoted(text))
    return docs.select(quoted(doc_id).alias("doc_id"), held_out(quoted(doc_id)).alias("held_out"), found.alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def keep_identified(
    docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", min_score: float = 0.5, min_likeness: float = MIN_LIKENESS
) -> DataFrame:
    """The rows whose language is known, with the input's columns.

    Rejects null texts, texts without a letter, texts whose best language has a
    posterior below ``min_score`` and texts less than ``min_likeness`` like that language's
    sample, such as those in a script that no language of the sample uses. With no labelled
    row there is nothing to compare with, and only texts without a letter go.
    """
    model = train(docs.where(~held_out(quoted(doc_id))), text, label, doc_id)
    if not model.languages:
        model = Model(("any",), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        judged = zip(*shared.value.judged(texts))
        return pd.Series([name != UNKNOWN and score >= min_score and like >= min_likeness for name, score, like in judged], dtype=bool)

    rows = pack(docs, known=known(quoted(text)))
    return unpack(rows.where("known"))
