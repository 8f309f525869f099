"""Turn numbers and dates into ordered report labels."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Bands:
    """Labels for ``value <= uppers[0] < value <= uppers[1] ...`` and one open end.

    Values below ``lower`` and nulls take ``null_label``; ``None`` keeps them null.
    """

    uppers: tuple[int, ...]
    labels: tuple[str, ...]
    lower: int | None = None
    null_label: str | None = UNKNOWN

    def __post_init__(self):
        if len(self.labels) != len(self.uppers) + 1:
            raise ValueError("one label more than edges is needed")
        if list(self.uppers) != sorted(set(self.uppers)):
            raise ValueError("edges must increase")


def _text(label: str | None) -> str:
    return "NULL" if label is None else "'" + label.replace("'", "\\'") + "'"


def band(value: str, bands: Bands) -> Column:
    """Label of the band that holds ``value``, a column name or SQL expression.

    One SQL expression instead of a chain of column calls keeps plan building
    short: each call would be a round trip to the JVM.
    """
    missing = f"({value}) IS NULL" + ("" if bands.lower is None else f" OR ({value}) < {bands.lower}")
    steps = " ".join(f"WHEN ({value}) <= {upper} THEN {_text(label)}" for upper, label in zip(bands.uppers, bands.labels))
    return F.expr(f"CASE WHEN {missing} THEN {_text(bands.null_label)} {steps} ELSE {_text(bands.labels[-1])} END")


def null_to_unknown(column: Column | str) -> Column:
    """Text of a characteristic, nulls named so that they keep their own row."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


# --- fixed values: wait bands in days (upper edges are inclusive) and labels ---
WAIT_2 = Bands((126,), ("<= 18 weeks", "> 18 weeks"))
WAIT_3 = Bands((84, 126), ("<= 12 weeks", "<= 18 weeks", "> 18 weeks"))
WAIT_4 = Bands((126, 252, 364), ("<= 18 weeks", "> 18 weeks", "> 36 weeks", "> 52 weeks"))
# the first label covers up to 72 days, so that controls start at 73 days
WAIT_5 = Bands((72, 126, 210, 294), ("<= 6 weeks", "<= 18 weeks", "19-30 weeks", "31-42 weeks", "> 42 weeks"))
WAIT_6 = Bands(
    (84, 126, 168, 210, 294),
    ("<= 12 weeks", "<= 18 weeks", "19-24 weeks", "25-30 weeks", "31-42 weeks", "> 42 weeks"),
)
WAIT_OLD_4 = Bands((84, 126, 252), ("<= 12 weeks", "<= 18 weeks", "19-36 weeks", "> 36 weeks"))
WAIT_BUCKET_5 = Bands(
    (83, 126, 245, 364),
    ("< 12 weeks", "12-18 weeks", "19-36 weeks", "37-52 weeks", "> 52 weeks"),
    null_label=None,
)
WAIT_BUCKET_4 = Bands((126, 252, 364), ("< 18 weeks", "19-36 weeks", "37-52 weeks", "> 52 weeks"))
WAIT_GRANULAR = Bands(
    tuple(range(21, 358, 21)),
    ("0-3 weeks", *(f"{w}-{w + 2} weeks" for w in range(4, 52, 3)), "52+ weeks"),
    lower=0,
)
AGE = Bands(
    (10, 17, 24, 34, 44, 54, 64, 74, 84),
    ("<= 10", "11-17", "18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75-84", "84+"),
    lower=1,
)
CONDITIONS = Bands((0, 1, 2), ("No LTCs", "Single LTC", "Comorbidities", "Multimorbidities"), lower=0)
FRAILTY = Bands((1,), ("Not Frail", "Frail"), null_label="Frail")
# --- end of fixed values ---

WAIT_BANDS = {
    "2": WAIT_2,
    "3": WAIT_3,
    "4": WAIT_4,
    "5": WAIT_5,
    "6": WAIT_6,
    "old_4": WAIT_OLD_4,
    "bucket_5": WAIT_BUCKET_5,
    "bucket_4": WAIT_BUCKET_4,
    "granular": WAIT_GRANULAR,
}


def quarter_band(
    date: Column | str,
    first: datetime.date = datetime.date(2022, 1, 1),
    last: datetime.date = datetime.date(2024, 3, 31),
    month_names: Sequence[str] = ("mar", "jun", "sep", "dec"),
) -> Column:
    """``mar22`` for a date in January to March 2022; null outside the range."""
    date = F.col(date) if isinstance(date, str) else date
    name = F.element_at(F.array(*[F.lit(m) for m in month_names]), F.quarter(date))
    return F.when(
        date.between(F.lit(first), F.lit(last)),
        F.concat(name, F.lpad((F.year(date) % 100).cast("string"), 2, "0")),
    )


def level_recode(column: Column | str, level: str, same: str, other: str) -> Column:
    """Two labels: the given level against all the rest (nulls count as the rest)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column == level, same).otherwise(other)
