"""Scalar derivations. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from trialspark import schema as S
from trialspark.functions.missing import holds, indicator, yn_flag

__all__ = [
    "build_usubjid", "band", "recode", "bmi", "clamp", "compliance_flag", "response_flag",
    "normalise_term", "iso_date", "iso_text", "shift_days", "treatment_emergent",
    "time_to_event", "risk_tier", "predicted_label", "adverse_event_propensity",
    "dropout_rule_score", "result_text", "severity_code", "severity_text", "visit_text",
    "padded", "arm_text", "drug_label",
]


def padded(number: Column, width: int = 3) -> Column:
    """Zero-padded number; longer numbers keep all their digits."""
    return F.format_string(f"%0{width}d", number)


def build_usubjid(study: Column | str, site: Column, number: Column) -> Column:
    """STUDY-SITE-NNN."""
    study = F.lit(study) if isinstance(study, str) else study
    return F.concat_ws("-", study, site.cast("string"), padded(number))


def band(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-open band holding the value; null stays null."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("band needs one label more than breaks")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, label in zip(breaks, labels):
        out = out.when(value < F.lit(upper), label)
    return out.otherwise(labels[-1])


def recode(value: Column, mapping: Mapping, default=None) -> Column:
    """Replace values by a mapping; anything else, null included, becomes the default."""
    out = None
    for source, target in mapping.items():
        hit = value == F.lit(source)
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Body-mass index to one decimal."""
    metres = height_cm / F.lit(100.0)
    return F.round(weight_kg / (metres * metres), 1)


def clamp(value: Column, low, high) -> Column:
    """Value bounded to [low, high]; null stays null."""
    bounded = F.greatest(F.least(value, F.lit(high)), F.lit(low))
    return F.when(value.isNotNull(), bounded)


def compliance_flag(percent: Column, threshold: float = 80) -> Column:
    """Compliant at or above the threshold; a missing percentage counts as 100."""
    return F.when(F.coalesce(percent, F.lit(100.0)) >= threshold, "Compliant").otherwise(
        "Non-Compliant"
    )


def response_flag(change: Column, threshold: float = -1.2) -> Column:
    """RESPONDER where the change from baseline is below the threshold; UNKNOWN without a change."""
    return F.when(change.isNull(), "UNKNOWN").when(change < threshold, "RESPONDER").otherwise(
        "NON-RESPONDER"
    )


def normalise_term(term: Column) -> Column:
    return F.translate(term, "_", " ")


def iso_date(text: Column) -> Column:
    """Date of an ISO text, null when it is not one."""
    return F.try_to_date(text, "yyyy-MM-dd")


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def shift_days(date: Column, days) -> Column:
    return F.date_add(date, days)


def treatment_emergent(start: Column, reference: Column) -> Column:
    """'Y' where the event starts on or after the reference date (both ISO text).

    A missing reference date is earlier than any start, so the event is emergent; an event without
    a start date is not.
    """
    began, since = iso_date(start), iso_date(reference)
    return yn_flag(began.isNotNull() & (since.isNull() | (began >= since)))


def time_to_event(start: Column, end: Column, horizon: int = 168) -> Column:
    """Days from start to end (ISO text) within [0, horizon].

    A blank end gives the horizon; a difference that cannot be formed counts as day 0.
    """
    days = F.datediff(iso_date(end), iso_date(start))
    inside = F.least(F.lit(horizon), F.greatest(F.lit(0), days))
    return F.when(end.isNull() | (F.trim(end) == ""), F.lit(horizon)).otherwise(inside)


def risk_tier(probability: Column, high: float = 0.60, moderate: float = 0.35) -> Column:
    return (
        F.when(probability.isNull(), "Unknown")
        .when(probability >= high, "High Risk")
        .when(probability >= moderate, "Moderate Risk")
        .otherwise("Low Risk")
    )


def predicted_label(probability: Column, threshold: float = 0.5) -> Column:
    """1 where dropout is predicted, 0 where not, null without a probability."""
    return (probability >= threshold).cast("int")


def severity_code(severity: Column) -> Column:
    return recode(severity, S.SEVERITY_CODE, S.SEVERITY_CODE_OTHER)


def severity_text(code: Column) -> Column:
    return recode(code, S.SEVERITY_TEXT)


def visit_text(visit_number: Column, weeks: int = 4) -> Column:
    """SCREENING for visit 0, else WEEK n."""
    week = F.concat(F.lit("WEEK "), (visit_number * weeks).cast("string"))
    return F.when(visit_number == 0, "SCREENING").otherwise(week)


def arm_text(arm_number: Column, drug: str) -> Column:
    return recode(arm_number, {0: "Placebo", 1: f"{drug} 100mg", 2: f"{drug} 200mg"})


def drug_label(arm_number: Column, drug: str) -> Column:
    return recode(arm_number, {0: "PLACEBO", 1: f"{drug} 100mg", 2: f"{drug} 200mg"})


def result_text(value: Column, decimals: int = 1) -> Column:
    """Character form of a numeric result."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))


def adverse_event_propensity(
    base: Column, arm: Column, age: Column, das28: Column, cap: float = 0.60
) -> Column:
    """Base probability raised by dose arm, age over 45 and disease activity over 4.5."""
    older = F.greatest(F.lit(0.0), (age - 45) * 0.008)
    sicker = F.greatest(F.lit(0.0), (das28 - 4.5) * 0.06)
    return F.least(F.lit(cap), base * (1 + arm * 0.18) * (1 + older) * (1 + sicker))


def dropout_rule_score(
    events: Column,
    serious: Column,
    max_severity: Column,
    compliance: Column,
    site: Column,
    arm: Column,
    remote_sites: Sequence[str] = ("107", "108"),
    cap: float = 0.65,
) -> Column:
    """Additive dropout score.

    The weights are whole hundredths and are summed as integers, so the score does not depend
    on the order of addition.
    """
    # Weights in hundredths.
    terms = [
        (events > 2, 10),
        (events > 4, 8),
        (max_severity == 3, 18),
        (serious >= 1, 8),
        (holds(compliance < 80), 9),
        (site.cast("string").isin(*remote_sites), 5),
        (arm == 2, 3),
    ]
    points = F.lit(5)
    for condition, weight in terms:
        points = points + indicator(condition) * weight
    return F.least(F.lit(cap), points / F.lit(100.0))
