"""Outcome reasons and attendance flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: status codes, code lists and text marks ---
ADMITTED_MARK = "IRTT"
IMPUTED_END = "week_end_date"
KNOWN_STATUS = (30, 31, 32, 33, 34, 35, 36, 99)
MISSED_MARK = "dna"
PATIENT_CANCEL_MARK = "cancel(pat)"
HOSPITAL_CANCEL_MARK = "cancel(hos)"
OUTCOMES = (
    "treatment_admitted",
    "treatment_non_admitted",
    "non_treatment_monitoring",
    "non_treatment_patient_declines",
    "non_treatment_decision_not_to_treat",
    "non_treatment_dna",
    "non_treatment_other",
    "non_treatment_death",
    "unknown",
    "unknown_imputed_end",
)
# --- end of fixed values ---


def outcome_conditions(status: str = "status", change_type: str = "change_type", end_type: str = "end_type") -> dict[str, Column]:
    """The ten outcome tests in the order of precedence.

    A null ``change_type`` makes both admission tests null, so such treated
    rows fall in neither of the two.
    """
    code = F.col(status)
    admitted = F.col(change_type).contains(ADMITTED_MARK)
    tests = (
        (code == 30) & admitted,
        (code == 30) & ~admitted,
        code.isin(31, 32),
        code == 35,
        code == 34,
        code == 33,
        ~code.isin(*KNOWN_STATUS),
        code == 36,
        code == 99,
        (code == 99) & (F.col(end_type) == IMPUTED_END),
    )
    return dict(zip(OUTCOMES, tests, strict=True))


def outcome_reason(**columns: str) -> Column:
    """First outcome that holds; null when none does."""
    return F.coalesce(*[F.when(test, F.lit(label)) for label, test in outcome_conditions(**columns).items()])


def attendance_flags(status: str = "attendance_status") -> dict[str, Column]:
    """0/1 marks for a missed contact and for the two kinds of cancellation."""
    marks = {
        "is_dna": MISSED_MARK,
        "is_patient_canc": PATIENT_CANCEL_MARK,
        "is_hospital_canc": HOSPITAL_CANCEL_MARK,
    }
    return {name: F.when(F.col(status).contains(mark), 1).otherwise(0) for name, mark in marks.items()}


def list_type(change_type: str = "change_type") -> Column:
    """``in`` for pathways that reached the admitted list, else ``op``."""
    return F.when(F.col(change_type).contains(ADMITTED_MARK), "in").otherwise("op")


def contains_label(column: str, mark: str) -> Column:
    """Readable two-way split on a text mark."""
    return F.when(F.col(column).contains(mark), f"Contains {mark}").otherwise(f"Does not contain {mark}")
