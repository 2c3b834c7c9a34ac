"""Column functions over text and speakers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.vocab import ROLES, SPEAKERS

#: An utterance: text up to the end of a sentence or line.
SEGMENT = r"[^.!?\n]+[.!?]*"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def segments(text: Column) -> Column:
    """Utterances of a turn, in order; no empty ones. Null gives null."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), 0), strip)
    return F.filter(parts, lambda x: x != "")


def ingest_speaker(role: Column) -> Column:
    """counsellor, client or, for everything else, unknown."""
    return F.coalesce(literal_map({**ROLES, "counsellor": "counsellor", "counselor": "counsellor", "therapist": "counsellor", "client": "client"})[F.lower(role)], F.lit("unknown"))


def normal_speaker(speaker: Column) -> Column:
    """Synonyms mapped; what is not one stays, trimmed and in lower case."""
    name = F.lower(strip(speaker))
    return F.coalesce(literal_map(SPEAKERS)[name], name)


def model_slug(model: Column) -> Column:
    return F.substring_index(model, "/", -1)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, or 0 where bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
