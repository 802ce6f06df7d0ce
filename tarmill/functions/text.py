"""Text expressions: normal form, words, keys carried by ids, hashes of ids, tags of word changes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Letters whose marks are dropped where spellings are compared, and what they become.
MARKED = "ąčęėįšųūž"
UNMARKED = "aceeisuuz"
# Nasal vowels and the plain vowels they are confused with.
NASAL = "ąęįųū"
ORAL = "aeiuu"
# Fixed value: a word in standard spelling, or two that a plus sign joins.
STANDARD_WORD = r"^[a-ząčęėįšųūž]+(\+[a-ząčęėįšųūž]+)?$"


@F.pandas_udf(StringType())
def _nfc_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Precomposed form. Only texts with a character above U+02FF may change; only those leave the JVM."""
    odd = c.rlike("[\\u0300-\\uffff]")
    return F.when(odd, _nfc_udf(F.when(odd, c))).otherwise(c)


def normalise(c: Column) -> Column:
    """Precomposed, lower case, punctuation and underscores as spaces, single spaces; null as empty."""
    t = F.regexp_replace(F.lower(nfc(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(t)


def normalise_each(c: Column) -> Column:
    """normalise() of every string of an array, null strings as empty; they are joined for the one part that isn't JVM-side."""
    whole = nfc(F.array_join(F.transform(c, lambda t: F.coalesce(t, F.lit(""))), "\u001e"))
    each = F.transform(F.split(whole, "\u001e"), lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")))
    return F.when(F.size(c) > 0, each).when(c.isNotNull(), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """The words of a normalised text; none of an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """What white space separates; null gives null."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def fold(c: Column) -> Column:
    """Without the marks of the alphabet's letters."""
    return F.translate(c, MARKED, UNMARKED)


def is_dialect_id(c: Column) -> Column:
    return c.contains("-")


def region_of(c: Column) -> Column:
    return F.substring(c, 1, 1)


def speaker_of(c: Column) -> Column:
    return F.substring(c, 1, 7)


def session_of(c: Column) -> Column:
    return F.substring(c, 1, 9)


def sha1_mod(c: Column, m: int) -> Column:
    """The 160-bit SHA-1 of a string, modulo m, folded over its hexadecimal digits in chunks that a long holds."""
    digest = F.sha1(c)
    rest = F.lit(0).cast("long")
    for k in range(0, 40, 8):
        rest = (rest * F.lit(pow(16, 8, m)) + F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")) % m
    return rest


def published_split(c: Column) -> Column:
    """The published side of an id: test, dev or train."""
    b = sha1_mod(c, 100)
    return F.when(b == 0, "test").when(b == 1, "dev").otherwise("train")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def length_bin(c: Column, edges: list[float]) -> Column:
    """Number of the half-open interval [edges[k], edges[k+1]) that holds c; -1 below the first."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c)) - 1


def integer_answers(c: Column) -> Column:
    """The whole numbers by whole number of the first flat JSON object in a text, after its last `</think>`; an empty map where
    there is none or a key or value is no number. Of repeated keys the last counts; fractions are cut."""
    m = F.from_json(F.regexp_extract(F.element_at(F.split(c, "</think>"), -1), r"\{[^{}]*\}", 0), "map<string,string>")
    e = F.transform(F.map_entries(m), lambda x: F.struct(F.trim(x["key"]).try_cast("int").alias("key"), F.trim(x["value"]).try_cast("double").cast("int").alias("value")))
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda z: z["key"] == x["key"]))
    good = F.forall(e, lambda x: x["key"].isNotNull() & x["value"].isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), F.map_from_entries(last)).otherwise(F.create_map().cast("map<int,int>"))


def minute(c: Column) -> Column:
    """A time as it stands in ledgers, to the minute."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


@F.pandas_udf(DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 1.0 if x == y else SequenceMatcher(None, x, y, autojunk=False).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Gestalt similarity: twice the characters in matching blocks over all characters."""
    return _ratio_udf(a, b)


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("left", "old", "new", "right")])))
def edits_in_context(a: pd.Series, b: pd.Series) -> pd.Series:
    """The changes that turn one word into another, each with a character of context; ^ and $ stand at the ends."""

    def one(x: str | None, y: str | None) -> list[dict[str, str]] | None:
        if x is None or y is None:
            return None
        x, y = f"^{x}$", f"^{y}$"
        ops = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [{"left": x[max(i - 1, 0) : i], "old": x[i:j], "new": y[k:m], "right": x[j : j + 1]} for op, i, j, k, m in ops if op != "equal"]

    return pd.Series([one(x, y) for x, y in zip(a, b)])
