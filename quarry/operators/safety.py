"""Injected instructions and personal data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENTITIES

# Suspicious phrases, without regard to case.
INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"disregard\s+(the\s+)?(above|previous)",
    r"you\s+are\s+now\s+",
    r"system\s*:\s*",
    r"new\s+instructions?\s*:",
    r"reveal\s+(your\s+)?(system\s+)?prompt",
    r"act\s+as\s+(if\s+you\s+are\s+)?",
]
# Kinds of personal data by priority, with scores. Phone and name are rules of this engine.
PII = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),
    "NEPAL_PAN": (r"\b\d{9}\b", 0.5),
    "PHONE_NUMBER": (r"\b9[678]\d{8}\b|\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}\b", 0.4),
    "PERSON": (r"(?:(?<=Employee: )|(?<=Name: ))[A-Z][a-z]+(?: [A-Z][a-z]+)+", 0.85),
}


def injections(text) -> Column:
    """The first match of each pattern that has one, in the patterns' order. None found does not mean safe."""
    return F.array_compact(F.array(*[F.nullif(F.regexp_extract(text, f"(?iU){p}", 0), F.lit("")) for p in INJECTIONS]))


def pii_count(text, kind: str) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + PII[kind][0]))


def redact(text) -> Column:
    """Each find gives way to its kind, kinds in order of priority."""
    for kind, (pattern, _) in PII.items():
        text = F.regexp_replace(text, "(?U)" + pattern, f"<{kind}>")
    return text


def may_hold_pii(text) -> Column:
    """Whether any pattern occurs; told without Python, so that ``entities`` need see no other rows."""
    return F.coalesce(F.greatest(*[F.col(text).rlike(pattern) if isinstance(text, str) else text.rlike(pattern) for pattern, _ in PII.values()]), F.lit(False))


def _finds(text: str | None) -> list[dict]:
    taken, out = [], []
    for kind, (pattern, score) in PII.items():
        for m in re.finditer(pattern, text or ""):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append({"entity_type": kind, "start": m.start(), "end": m.end(), "score": score, "text": m[0]})
    return sorted(out, key=lambda e: e["start"])


def entities(text) -> Column:
    """All finds with their offsets, in order; of overlapping ones that of higher priority. (Spark has no function for match offsets.)"""

    @F.pandas_udf(ENTITIES)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(_finds)

    return find(text)
