"""Reading, checking and mapping of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import literal_map, strip
from parley.vocab import ALIASES, CLIENT_REDUCED, CLIENT_T1, COUNSELLOR_REDUCED, T1_GROUPS, THIRD_PARTY_T1, THIRD_PARTY_T2, VOCABULARY

UNKNOWN = "UNKNOWN"
# What separates tokens, a label field, and the marks around a token. Fixed values.
SPLIT = r"[\s,;.\n]+"
FIELD = r"(?i)label[\"']?\s*[:=]\s*[\"']?([A-Za-z][A-Za-z0-9+\-]*)"

MARKS = "`*_:()\\[\\]"
BRACES = "{}"
QUOTES = "\"' \\t"


def array_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def clean_token(token: Column, braces: bool = False, trailing: bool = True) -> Column:
    """A token without mark-up around it and, if ``trailing``, without punctuation at its end."""
    marks = MARKS + (BRACES if braces else "") + (QUOTES if trailing else "")
    out = strip(F.regexp_replace(token, f"^[{marks}]+|[{marks}]+$", ""))
    return F.regexp_replace(out, r"[.,;:]+$", "") if trailing else out


def resolve(token: Column, allowed: Column) -> Column:
    """The code a clean token stands for, an alias's code, or null."""
    other = literal_map(ALIASES)[token]
    return F.when(F.array_contains(allowed, token), token).when(F.array_contains(allowed, other), other)


def _first(candidates: Column) -> Column:
    return F.get(F.filter(candidates, lambda x: x.isNotNull()), F.lit(0))


def parse_head(text: Column, allowed: Column) -> Column:
    """The first word if it is a code, else the first code met; UNKNOWN if there is none."""
    text = strip(text)
    read = lambda t: resolve(clean_token(t), allowed)
    return F.coalesce(read(F.get(F.split(text, r"\s+"), F.lit(0))), _first(F.transform(F.split(text, SPLIT), read)), F.lit(UNKNOWN))


def parse_field(text: Column, allowed: Column) -> Column:
    """The last label field, else the first word, else the last code met; UNKNOWN if there is none."""
    text = strip(text)
    read = lambda t: resolve(clean_token(t, braces=True), allowed)
    tokens = F.filter(F.split(text, SPLIT), lambda t: t != "")
    fields = F.reverse(F.regexp_extract_all(text, F.lit(FIELD), 1))
    return F.coalesce(_first(F.transform(fields, read)), read(F.get(tokens, F.lit(0))), _first(F.reverse(F.transform(tokens, read))), F.lit(UNKNOWN))


def parse_lenient(text: Column, allowed: Column) -> Column:
    """The first code met, trailing punctuation kept on tokens; UNKNOWN if there is none."""
    read = lambda t: resolve(clean_token(t, trailing=False), allowed)
    return F.coalesce(_first(F.transform(F.split(strip(text), SPLIT), read)), F.lit(UNKNOWN))


def allowed_codes(speaker: Column, tier: str) -> Column:
    """The codes of a speaker in a tier; null for other speakers."""
    return F.when(speaker == "counsellor", array_of(VOCABULARY["counsellor", tier])).when(speaker == "client", array_of(VOCABULARY["client", tier]))


def allowed_in_group(speaker: Column, t1: Column) -> Column:
    """Second-tier codes under a first-tier code of the speaker; the speaker's full set where that is none."""
    groups = F.create_map(*[x for k, v in T1_GROUPS.items() for x in (F.lit(k), array_of(v))])
    own = F.array_contains(allowed_codes(speaker, "t1"), t1)
    return F.coalesce(F.when(own, groups[t1]), allowed_codes(speaker, "t2"))


def is_valid(label: Column, speaker: Column, tier: str) -> Column:
    return F.coalesce(F.array_contains(allowed_codes(speaker, tier), strip(label)), F.lit(False))


def first_label(raw: Column) -> Column:
    """First code of a list literal, or the bare code; an empty list gives null."""
    text = strip(raw)
    return F.when(text.startswith("["), F.get(F.from_json(text, "array<string>"), F.lit(0))).otherwise(text)


def third_party_t1(code: Column, speaker: Column) -> Column:
    """First tier of a third party's code: the counsellor's by table, of others the client codes as they are."""
    return F.when(speaker == "counsellor", literal_map(THIRD_PARTY_T1)[code]).when(code.isin(CLIENT_T1), code)


def third_party_t2(code: Column, speaker: Column) -> Column:
    """Second tier, which only the counsellor's codes have."""
    return F.when(speaker == "counsellor", literal_map(THIRD_PARTY_T2)[code])


def reduced(code: Column, speaker: Column) -> Column:
    """A code in the third party's scheme; null where it has none."""
    return F.when(speaker == "client", literal_map(CLIENT_REDUCED)[code]).otherwise(literal_map(COUNSELLOR_REDUCED)[code])


def flag_codes() -> Column:
    """Distinct codes, sorted, of a row with the third party's existence flags and subtypes."""
    sub = lambda c: F.lower(F.col(c))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    pick = lambda on, column, codes: [F.when(on & (sub(column) == k), F.lit(v)) for k, v in codes.items()]
    none = ~has("therapist_input_exists") & ~has("reflection_exists") & ~has("question_exists")
    found = [
        *pick(has("therapist_input_exists"), "therapist_input_subtype", {"information": "GI", "advice": "ADVI", "options": "OPTI", "negotiation": "NEGO"}),
        *pick(has("reflection_exists"), "reflection_subtype", {"simple": "SR", "complex": "CR"}),
        *pick(has("question_exists"), "question_subtype", {"open": "OQ", "closed": "CQ"}),
        *pick(none, "main_therapist_behaviour", {"other": "O"}),
        *pick(F.lit(True), "client_talk_type", {"change": "C", "sustain": "S", "neutral": "N"}),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
