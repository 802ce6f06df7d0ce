"""Problem 1: one consistent form for text that looks the same.

Method: confusables skeleton. A word is decomposed, every character is replaced by its prototype from the public look-alike
table of Unicode, which Spark's own library carries, and the result is decomposed again; originals with equal skeletons look
alike. The consistent form respells a word, letter by letter, with the letter of one alphabet that has the same prototype and
case, so it has the word's skeleton and is a function of the skeleton and the alphabet.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import pyspark
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Look-alikes that the public table lacks or shows otherwise.
MORE = {"Ԛ": "Q", "յ": "j", "Լ": "L", "ӏ": "l"}
# Dashes that stand for a plain hyphen.
HYPHENS = "‐‑‒–—―−﹘﹣－⁃֊"

HOME = "LATIN"
_TABLE = "com/ibm/icu/impl/data/icudata/confusables.cfu"
_TOGETHER = dict.fromkeys(["CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC"], "EAST ASIAN")  # written in one word
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠ឴឵ㅤﾠ]+|(?![\t-\r\x1c-\x1f\x85])\p{Cc}+")
_SPACE = regex.compile(r"\s+")
_TO_HYPHEN = {ord(c): "-" for c in HYPHENS}
#: A text in which this finds nothing is in the consistent form already; most texts are, and never leave the JVM.
_SUSPECT = r"[^ -~ĄČĘĖĮŠŲŪŽąčęėįšųūž]|  |^ | $"


@lru_cache(1 << 16)
def _script(ch: str) -> str:
    """The alphabet of a letter, as its name begins; empty for what is no letter of an alphabet."""
    if ch < "\x80":
        return HOME if ch.isalpha() else ""
    if unicodedata.category(ch) not in ("Ll", "Lu", "Lt", "Lo"):
        return ""
    first = unicodedata.name(ch, "").split(" ")[0].split("-")[0]
    return _TOGETHER.get(first, first)


def _resource() -> bytes:
    """The table as the library keeps it: from its archive beside the Python package, else through the session's own classes."""
    for jar in glob.glob(os.path.join(pyspark.__path__[0], "jars", "icu4j-*.jar")):
        with zipfile.ZipFile(jar) as z:
            return z.read(_TABLE)
    jvm = SparkSession.active()._jvm
    return bytes(jvm.Thread.currentThread().getContextClassLoader().getResourceAsStream(_TABLE).readAllBytes())


def _prototypes(raw: bytes) -> dict[str, str]:
    """The table: keys hold a character and the length of its prototype, values the prototype or its place among the strings."""
    order = ">" if raw[8] else "<"
    body = raw[struct.unpack(order + "H", raw[:2])[0] :]
    keys, n, values, _, strings, size = struct.unpack(order + "6I", body[12:36])
    unit = lambda at, k: struct.unpack(f"{order}{k}H", body[at : at + 2 * k])
    chars = unit(strings, size)
    out = {}
    for k, v in zip(struct.unpack(f"{order}{n}I", body[keys : keys + 4 * n]), unit(values, n)):
        length = (k >> 24) + 1
        made = (v,) if length == 1 else chars[v : v + length]
        out[chr(k & 0xFFFFFF)] = struct.pack(f"<{length}H", *made).decode("utf-16-le")
    return out


class Lookalikes:
    """Prototypes of characters, and the letters of each alphabet by prototype and case."""

    def __init__(self, prototypes: dict[str, str]) -> None:
        self.prototypes = prototypes | MORE
        self.letters: dict[tuple[str, bool, str], str] = {}
        known = {*self.prototypes, *self.prototypes.values(), *map(chr, range(128))}
        for c in sorted(c for c in known if len(c) == 1 and _script(c)):  # basic letters come first
            if unicodedata.normalize("NFKD", c) == c and (c < "\x80" or _script(c) != HOME):  # of the home alphabet plain letters only
                self.letters.setdefault((_script(c), c.isupper(), self.prototypes.get(c, c)), c)
        self._words: dict[str, tuple[str, bool]] = {}

    def twin(self, c: str, alphabet: str) -> str | None:
        """The letter of an alphabet that looks like c; None if it has none."""
        if _script(c) == alphabet and (alphabet != HOME or c < "\x80"):
            return c
        return self._like(c, alphabet) or (c if _script(c) == alphabet else None)

    def _like(self, c: str, alphabet: str) -> str | None:
        """The letter of an alphabet with the prototype and the case of c; of either case if c has none."""
        made = self.prototypes.get(c, c)
        found = self.letters.get((alphabet, c.isupper(), made))
        return found or (self.letters.get((alphabet, True, made)) if c.lower() == c.upper() else None)

    def skeleton(self, text: str) -> str:
        """Decompose what is shown, replace each character by its prototype, decompose again.

        Plain letters, digits and signs are prototypes of themselves, as no reader takes one for another in a word; other
        characters have the plain letter of their case with the same prototype, else the table's prototype.
        """
        one = lambda c: c if c < "\x80" else (_script(c) and self._like(c, HOME)) or self.prototypes.get(c, c)
        return unicodedata.normalize("NFD", "".join(map(one, unicodedata.normalize("NFD", _shown(text)))))

    def word(self, word: str) -> str:
        """The one form of all words that look like this one.

        A word all of whose letters the home alphabet (Latin) has is spelled in it; else one of several alphabets in that which
        has all its letters and at least half of them already. If there is none, the word stays as it is, see mixed().
        """
        return self._known(word)[0]

    def _known(self, word: str) -> tuple[str, bool]:
        """The form of a word, and whether it mixes alphabets."""
        known = self._words.get(word)
        if known is None:
            if len(self._words) > 1 << 17:
                self._words.clear()
            form = self._respelled(word)
            known = self._words[word] = form, mixed(form)
        return known

    def _respelled(self, word: str) -> str:
        chars = unicodedata.normalize("NFD", word)
        of = [s for c in chars if (s := _script(c))]
        for alphabet in (HOME, *sorted(set(of) - {HOME}, key=lambda s: (-of.count(s), s))):
            if alphabet != HOME and (len(set(of)) == 1 or 2 * of.count(alphabet) < len(of)):
                continue
            spelled = [self.twin(c, alphabet) if _script(c) else c for c in chars]
            if None not in spelled:
                return unicodedata.normalize("NFC", "".join(spelled))
        return unicodedata.normalize("NFC", word)

    def consistent(self, text: str | None) -> str | None:
        """The consistent form of a text: precomposed letters, ordinary widths and shapes, plain hyphens, single plain spaces
        between words and none around them, nothing invisible, each word in one alphabet where it can be spelled in one. Null
        stays null, empty stays empty."""
        if text is None:
            return None
        if text.isascii() and "  " not in text and text.isprintable() and text == text.strip():
            return text
        t = _SPACE.sub(" ", _shown(text)).strip()
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m[0]), t))

    def is_consistent(self, text: str | None) -> bool:
        """Whether a text is in its consistent form and no word of it mixes alphabets."""
        return text is None or (self.consistent(text) == text and (text.isascii() or not any(self._known(w)[1] for w in _WORD.findall(text))))


def mixed(word: str) -> bool:
    """Whether the letters of a word are from several alphabets."""
    return not word.isascii() and len({s for c in word if (s := _script(c))}) > 1


@cache
def lookalikes() -> Lookalikes:
    return Lookalikes(_prototypes(_resource()))


def consistent(text: str | None) -> str | None:
    return lookalikes().consistent(text)


def skeleton(text: str) -> str:
    return lookalikes().skeleton(text)


def _shown(text: str) -> str:
    """The text without what is invisible, with ordinary widths and shapes and plain hyphens."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text).translate(_TO_HYPHEN)).translate(_TO_HYPHEN)
    return _INVISIBLE.sub("", t)


def _mapped(method: str, kind: StringType | BooleanType):  # noqa: ANN202
    """A UDF of a method of the look-alikes; the table, 6,000 short strings, travels with it."""
    known = lookalikes()

    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = getattr(known, method)
        for s in texts:
            yield s.map(one, na_action="ignore")

    return run


def suspect(text: Column) -> Column:
    """True where a text may differ from its consistent form; tested in the JVM. Null for null."""
    return text.rlike(_SUSPECT)


def to_consistent(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the consistent form of column text in a new column out (replaced if it is there).

    Only suspect texts are sent to Python. Null gives null, an empty or blank text an empty one; repeated rows stay.
    """
    t = F.col(text)
    sent = _mapped("consistent", StringType())(F.when(suspect(t), t))
    return df.withColumn(out, F.when(suspect(t), sent).otherwise(t))


def long_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text) with a row for each of the named text columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p")
    return df.select(F.col(key).alias("id"), pairs).select("id", "p.field", "p.text")


def inconsistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field) once for each text that is not in its consistent form, or of which a word mixes alphabets and can't be spelled in
    one. Null and empty texts are never listed."""
    x = long_fields(df, key, fields).where(suspect(F.col("text")))
    return x.where(~_mapped("is_consistent", BooleanType())("text")).select("id", "field").distinct()


def word_groups(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Words that look alike but differ in their characters.

    (skeleton, form, originals array<struct<word, uses>>, uses): the words of all texts are counted first, which leaves one
    row for each different word; those are grouped by equal skeleton, and groups of a single original are left out. Words
    are what spaces of any kind separate. Only words with an unusual character need the Python skeleton.
    """
    words = (
        long_fields(df, key, fields)
        .select(F.explode(F.split("text", r"[\s  -  　]+")).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    odd = F.col("word").rlike(r"[^ -~]")
    w = words.withColumn("skeleton", F.when(odd, _mapped("skeleton", StringType())(F.when(odd, F.col("word")))).otherwise(F.col("word")))
    g = w.groupBy("skeleton").agg(F.sort_array(F.collect_list(F.struct("word", "uses"))).alias("originals"), F.sum("uses").alias("uses"))
    g = g.where(F.size("originals") > 1)
    return g.withColumn("form", _mapped("consistent", StringType())(F.element_at("originals", 1)["word"])).select("skeleton", "form", "originals", "uses")
