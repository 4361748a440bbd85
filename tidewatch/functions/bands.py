"""Status names and severity scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORED = ["open", "triage", "contained", "closed", "false_positive"]
ACTIVE = ["open", "triage", "contained"]


def status_to_stored(status: str) -> str:
    s = (status or "").strip().lower()
    return "closed" if s == "resolved" else s if s in STORED else "open"


def stored_status(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s == "resolved", "closed").when(s.isin(STORED), s).otherwise("open")


def shown_status(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s == "closed", "resolved").when(s == "false_positive", s).otherwise("open")


def _ladder(value: Column, steps: list[tuple[int, str]], rest: str) -> Column:
    out = F.lit(rest)
    for floor, name in reversed(steps):
        out = F.when(value >= floor, name).otherwise(out)
    return out


def alert_label(severity: Column) -> Column:
    return _ladder(severity, [(25, "Crítica"), (18, "Alta"), (10, "Media"), (4, "Baja")], "Info")


def alert_level(severity: Column) -> Column:
    return _ladder(severity, [(18, "high"), (10, "medium"), (4, "low")], "info")


# Severity range of each alert filter name.
ALERT_RANGES = {"high": (18, 30), "medium": (10, 17), "low": (4, 9), "info": (0, 3)}


def score_badge(score: Column) -> Column:
    """Incident badge by score."""
    return _ladder(score, [(61, "high"), (31, "medium")], "low")


def incident_level(severity: Column) -> Column:
    """Incident level by severity."""
    return _ladder(severity, [(85, "high"), (60, "medium")], "low")


def level_label(level: Column) -> Column:
    return F.when(level == "high", "Alta").when(level == "medium", "Media").otherwise("Baja")


def entity_bucket(severity: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return F.when(s.isin("critical", "high"), "high").when(s.isin("medium", "low"), s).otherwise("info")


def kpi_floor(severity: str | None) -> int | None:
    """Least alert severity of a dashboard filter."""
    return {"high": 10, "medium": 6, "low": 1}.get((severity or "").strip().lower())
