"""Split each pathway into waiting, washout and after periods.

A :class:`PeriodSpec` names closed date intervals per period code: 1 is the
wait, 100 the washout, 0 the time after it (the threshold design counts the
other way round). Nothing is expanded to days; activity is summed by
:func:`cohortspan.operators.running.interval_totals`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.running import interval_totals

WAITING, AFTER, WASHOUT = 1, 0, 100

Interval = tuple[int, Column, Column]


@dataclass(frozen=True)
class PeriodSpec:
    """Intervals per period code, end of follow-up and the completeness rule.

    ``complete``: "pathway" keeps pathways observed to the end of follow-up,
    "patient" keeps all pathways of a patient with one such pathway, ``None``
    keeps everything.
    """

    intervals: Callable[[], list[Interval]]
    follow_up_end: Callable[[], Column]
    complete: str | None = "pathway"


def _days(date: str | Column, days: int | Column | str) -> Column:
    return F.date_add(date, F.col(days) if isinstance(days, str) else days)


def own_wait(washout: int = 28, follow_up: int | None = None) -> PeriodSpec:
    """Wait, washout, then as many days as the wait (or ``follow_up`` days)."""

    def resume() -> Column:
        return _days("stop_date", washout)

    def end() -> Column:
        return _days(resume(), "wt" if follow_up is None else follow_up)

    return PeriodSpec(
        lambda: [
            (WAITING, F.col("start_date"), _days("stop_date", -1)),
            (WASHOUT, F.col("stop_date"), _days("stop_date", washout - 1)),
            (AFTER, resume(), end()),
        ],
        end,
    )


def fixed_cut(
    procedure: int, recovery: int, follow_up: int = 180, waiting: int | None = None, complete: str = "pathway"
) -> PeriodSpec:
    """Same cut in days for everyone: wait up to ``waiting`` (default ``procedure``)."""
    cut = procedure if waiting is None else waiting
    resume, end = procedure + recovery, procedure + recovery + follow_up
    return PeriodSpec(
        lambda: [
            (WAITING, F.col("start_date"), _days("start_date", cut - 1)),
            (WASHOUT, _days("start_date", cut), _days("start_date", resume - 1)),
            (AFTER, _days("start_date", max(cut, resume)), _days("start_date", end)),
        ],
        lambda: _days("start_date", end),
        complete,
    )


def stop_date_cut(procedure: int, recovery: int, follow_up: int = 168) -> PeriodSpec:
    """Own clock stop splits the time, the end of follow-up is fixed in days."""
    end = procedure + recovery + follow_up

    def last() -> Column:
        return _days("start_date", end)

    return PeriodSpec(
        lambda: [
            (WAITING, F.col("start_date"), F.least(_days("stop_date", -1), last())),
            (WASHOUT, F.col("stop_date"), F.least(_days("stop_date", recovery - 1), last())),
            (AFTER, _days("stop_date", recovery), last()),
        ],
        last,
        "patient",
    )


def own_wait_inclusive(recovery: int = 28) -> PeriodSpec:
    """As :func:`own_wait`, the stop day belongs to the wait; no completeness test."""

    def resume() -> Column:
        return _days("stop_date", recovery)

    return PeriodSpec(
        lambda: [
            (WAITING, F.col("start_date"), F.col("stop_date")),
            (WASHOUT, _days("stop_date", 1), _days("stop_date", recovery - 1)),
            (AFTER, resume(), _days(resume(), "wt")),
        ],
        lambda: _days(resume(), "wt"),
        None,
    )


def threshold(days: int = 85, follow_up: int = 360, complete: str | None = None) -> PeriodSpec:
    """Period 0 runs to the stop or to ``days``, whichever is first; period 1 follows."""

    def turn() -> Column:
        return F.least(F.col("stop_date"), _days("start_date", days))

    return PeriodSpec(
        lambda: [
            (0, F.col("start_date"), turn()),
            (1, _days(turn(), 1), _days(turn(), follow_up)),
        ],
        lambda: _days(turn(), follow_up),
        complete,
    )


def placebo(washout: int = 28) -> PeriodSpec:
    """After-period of :func:`own_wait`, cut again at one and a half waits."""

    def middle() -> Column:
        return _days("start_date", F.floor(F.col("wt") * 1.5).cast("int"))

    def resume() -> Column:
        return _days("stop_date", washout)

    def end() -> Column:
        return _days(resume(), "wt")

    return PeriodSpec(
        lambda: [(0, resume(), F.least(middle(), end())), (1, F.greatest(_days(middle(), 1), resume()), end())],
        end,
    )


def assign_periods(pathways: DataFrame, spec: PeriodSpec, observed_until: Column) -> DataFrame:
    """Pathways that meet the completeness rule, with their period intervals.

    Adds ``follow_up_end``, ``max_time_covered`` (days from clock start) and
    ``periods``, an array of (time_period, lo, hi).
    """
    intervals = F.array(
        *[
            F.struct(F.lit(code).alias("time_period"), lo.alias("lo"), hi.alias("hi"))
            for code, lo, hi in spec.intervals()
        ]
    )
    spanned = pathways.withColumns(
        {
            "follow_up_end": spec.follow_up_end(),
            "max_time_covered": F.datediff(spec.follow_up_end(), F.col("start_date")),
        }
    )
    if spec.complete == "pathway":
        spanned = spanned.filter(F.col("follow_up_end") <= observed_until)
    elif spec.complete == "patient":
        followed = (
            spanned.filter(F.col("follow_up_end") <= observed_until).select("pid").groupBy("pid").agg(F.count("*").alias("_n"))
        )
        spanned = spanned.join(followed, "pid", "left_semi")
    return spanned.withColumn("periods", intervals)


def explode_periods(sample: DataFrame, keep: Sequence[str], codes: Sequence[int] | None = None) -> DataFrame:
    """One row per pathway and non-empty period."""
    rows = sample.select(*keep, F.inline("periods")).filter(F.col("lo") <= F.col("hi"))
    return rows if codes is None else rows.filter(F.col("time_period").isin(*codes))


def period_totals(
    sample: DataFrame,
    activity: DataFrame,
    measures: Sequence[str],
    keep: Sequence[str],
    codes: Sequence[int] = (WAITING, AFTER),
    patient: str = "pid",
) -> DataFrame:
    """Activity totals per pathway and period, one column per measure."""
    rows = explode_periods(sample, keep, codes)
    return interval_totals(rows, activity, [patient], "lo", "hi", measures)
