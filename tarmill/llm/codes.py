"""Clean spellings of the coded columns that several problems share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of gender.
FEMALE = ["f", "female", "fem", "woman", "w", "mot", "moteris", "moter", "moteriska"]
MALE = ["m", "male", "man", "vyr", "vyras", "vyriska"]
# Letters with accents and their plain forms.
ACCENTED = "ąčęėįšųūž"
PLAIN = "aceeisuuz"

_EDGE = r"^[\s  -  　]+|[\s  -  　]+$"


def trimmed(c: Column) -> Column:
    """c without blanks and line ends around it."""
    return F.regexp_replace(c, _EDGE, "")


def code(c: Column) -> Column:
    """A speaker code as it is compared: no blanks around, upper case; null where nothing is left."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def gender(c: Column) -> Column:
    """female, male or null."""
    w = F.translate(F.regexp_replace(F.lower(c), r"[^\p{L}]", ""), ACCENTED, PLAIN)
    return F.when(w.isin(FEMALE), "female").when(w.isin(MALE), "male")


def age_group(c: Column) -> Column:
    """0-17, 18-60, 60+ or null, from any dashes, blanks and signs around the numbers."""
    w = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s  -  　]+", ""), "[‐-―−]", "-")
    return (
        F.when(w.isin("0-17", "<18", "<=17", "under18", "iki18"), "0-17")
        .when(w.isin("18-60", "18-59"), "18-60")
        .when(w.isin("60+", ">60", ">=60", "+60", "60plus", "over60", "virš60"), "60+")
    )


def region(c: Column) -> Column:
    """A region as its lower-case name without accents, composed or not, and blanks; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.translate(F.lower(trimmed(c)), ACCENTED, PLAIN), r"\p{M}+", ""), F.lit(""))


def side(role: Column) -> Column:
    """train (roles train and seen), dev, test or null."""
    r = F.lower(trimmed(role))
    return F.when(r.isin("train", "seen"), "train").when(r.isin("dev", "test"), r)
