"""Small text and number rules: money, portal status words, work keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorlens.functions.dates import strip

# Keyword lists.
ROOF_WORDS = ("roof", "reroof", "reshingle")
ROOF_INSTALL_WORDS = ("replacement", "reroof", "re-roof", "reshingle", "new roof")
ROOF_DISQUALIFIERS = ("repair", "partial", "porch", "deck", "addition", "accessory", "solar")
EXTERIOR_WORDS = ("siding", "roof", "window", "facade", "paint", "stucco")
EXPLICIT_ROOF = (
    r"(?i)(?:^|[^A-Z])(?:RE[- ]?ROOF|ROOF(?:ING|TOP)?|SHINGL(?:E|ES|ING)|ICE SHIELD)(?:[^A-Z]|$)"
)
NON_QUALIFYING = ("voided", "abandoned", "denied", "expired", "administrative")
AMENDMENT_TYPES = ("amendment", "supplement", "supplemental")


def text_or_blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def money(value: Column) -> Column:
    """The first number in a text, thousands commas dropped; NULL when there is none."""
    run = F.regexp_extract(F.coalesce(value, F.lit("")), r"[-+]?\d[\d,]*\.?\d*", 0)
    return F.replace(run, F.lit(","), F.lit("")).try_cast("double")


def contains_any(text: Column, words) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def is_roof_record(description: Column) -> Column:
    return contains_any(description, ROOF_WORDS)


def is_roof_install(description: Column) -> Column:
    return (
        is_roof_record(description)
        & contains_any(description, ROOF_INSTALL_WORDS)
        & ~contains_any(description, ROOF_DISQUALIFIERS)
    )


def is_exterior(description: Column) -> Column:
    return contains_any(description, EXTERIOR_WORDS)


def is_amendment(work_type: Column) -> Column:
    return F.lower(strip(F.coalesce(work_type, F.lit("")))).isin(*AMENDMENT_TYPES)


def portal_disposition(status: Column) -> Column:
    """What a displayed portal status means for a permit's life; NULL while it is open."""
    word = F.lower(strip(F.coalesce(status, F.lit(""))))
    done = word.contains("close date issued") | (word == "closed with date") | word.startswith("certificate (ca)")
    rule = F.when(done, "completed")
    for terminal in ("voided", "abandoned", "denied", "expired"):
        rule = rule.when(word.contains(terminal), terminal)
    return rule.when(word == "stale", "expired")


def roof_evidence(*fields: Column) -> Column:
    """The first field that names roofing as a whole word, or NULL."""
    return F.coalesce(*[F.when(F.coalesce(field, F.lit("")).rlike(EXPLICIT_ROOF), field) for field in fields])


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """A ratio that is 0.0 over nothing."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)
