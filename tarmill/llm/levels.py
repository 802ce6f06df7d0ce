"""Problem 8: reading level of each document.

Method: regularised ordinal regression over lexical diversity, word rarity, connectives, clause depth and lengths, calibrated
to the graded documents. Word counts come from all documents in a hashed table of fixed size. Features are medians over the
words or over stretches of words of a document, so that a quoted passage of another level, or marks of transcription, don't
move them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 5
LEAST_WORDS = 30
STRETCH = 25
LONGEST_SENTENCE = 60  # beyond it stops are taken to be missing
BUCKETS = 1 << 18
MAX_LABELLED = 20_000

# Connectives of Lithuanian and English subordinate and argumentative prose.
CONNECTIVES = frozenset(
    """kadangi kuomet vadinasi todėl nors jeigu tačiau taigi nebent tarsi idant užuot kuris kuri kurio kurios kuriuo atžvilgiu tarpu
    whereas whereby albeit although notwithstanding insofar provided given which hence thus therefore moreover furthermore
    nevertheless unless whether thereby wherein despite consequently""".split()
)
# Frequent English words that show a text's language.
ENGLISH = frozenset("the of and to in a is that it for was on with as are by this at from but not have had his her they be an or which you she he we its their".split())

_TAG = re.compile(r"<[^<>\n]{1,60}>|&\w{2,8};")
_BRACKET = re.compile(r"\[[^\]\n]{0,30}\]")
_NUMBER = re.compile(r"(?<!\w)[^\W\d]*\d[\w-]*:?")
_LABEL = re.compile(r"(?<!\w)[^\W\d_]:(?=\s)")
_DIGIT, _SIGNS = re.compile(r"\d"), re.compile(r"[#*_`>|]")
_SIGN = str.maketrans(dict.fromkeys("#*_`>|", " "))
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?…]+(?=\s|$)|[,;()–—]")
NAMES = ["length", "long", "longer", "rarity", "rare", "diversity", "connectives", "depth", "sentence", "unstopped", "english"]


def tokens(text: str | None) -> list[str]:
    """Words and marks of a text in lower case, without markup, time codes, clip ids, speaker labels and numbers."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _BRACKET.sub(" ", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub(" ", text)
    if ":" in text:
        text = _LABEL.sub(" ", text)
    return _TOKEN.findall(text.translate(_SIGN).lower() if _SIGNS.search(text) else text.lower())


def buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).astype(np.int64) & (BUCKETS - 1)


def _medians(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The median of x in each group; group is in order, and no group is empty."""
    x = x[np.lexsort((x, group))]
    n = np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    return (x[first + (n - 1) // 2] + x[first + n // 2]) / 2


def _weighted_medians(x: np.ndarray, weight: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The least x at which half the weight of its group is reached; group is in order, no group is empty."""
    o = np.lexsort((x, group))
    reached = np.cumsum(weight[o])
    whole = np.bincount(group, weight, minlength=groups)
    before = np.cumsum(whole) - whole
    return x[o][np.searchsorted(reached, before + whole / 2, "left")]


def measure(docs: list[list[str]], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, features): the number of words and the features, in the order of NAMES, of each tokenised document; rows of NaN
    for those without words. bits: the rarity of each hash bucket. A whole batch is computed at once."""
    vocabulary = list(set().union(*docs)) if docs else []
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flag = lambda test: np.fromiter(map(test, vocabulary), bool, len(vocabulary))[ids]
    word, stop = flag(lambda t: t[0].isalpha()), flag(lambda t: t[0] in ".!?…")
    sentence = np.cumsum(stop) + doc  # a document begins a new one
    per = np.bincount(sentence[word], minlength=int(sentence[-1]) + 1 if len(sentence) else 1)
    inner = np.bincount(sentence[~word & ~stop], minlength=len(per))
    n = np.bincount(doc[word], minlength=len(docs))
    out = np.full((len(docs), len(NAMES)), np.nan)
    full = np.flatnonzero(n)
    if not len(full):
        return n, out
    link, english = flag(CONNECTIVES.__contains__)[word], flag(ENGLISH.__contains__)[word]
    size = np.fromiter(map(len, vocabulary), float, len(vocabulary))[ids][word]
    rare = bits[buckets(vocabulary)][ids][word]
    own, at = doc[word], sentence[word]
    own = np.searchsorted(full, own)  # documents with words, numbered
    m = n[full]
    stretches = np.maximum(1, np.rint(m / STRETCH).astype(np.int64))
    place = np.arange(len(own)) - (np.cumsum(m) - m)[own]
    part = place * stretches[own] // m[own] + (np.cumsum(stretches) - stretches)[own]
    parts = np.repeat(np.arange(len(full)), stretches)
    width = np.bincount(part)
    kinds = np.sort(part << 32 | ids[word])
    different = np.bincount(kinds[np.diff(kinds, prepend=-1) > 0] >> 32)
    typical = lambda x: _medians(np.bincount(part, x) / width, parts, len(full))
    real = np.flatnonzero(per)  # sentences with words; each counts by its words
    of = np.zeros(len(per), np.int64)
    of[at] = own
    long = _weighted_medians(per[real].astype(float), per[real], of[real], len(full))
    depth = _weighted_medians(inner[real] / per[real], per[real], of[real], len(full))
    unstopped = long > LONGEST_SENTENCE
    out[full] = np.stack([
        typical(size), typical(size >= 10), typical(size >= 13), typical(rare), typical(rare > 14),
        _medians(different / width, parts, len(full)), typical(link), np.where(unstopped, 0, depth),
        np.where(unstopped, 0, np.log1p(long)), unstopped, typical(english),
    ], 1)
    return n, out


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Uses of the words of all documents by hash bucket; at most BUCKETS rows reach the driver, at any corpus size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            seen: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
            words = list(seen)
            np.add.at(total, buckets(words), np.fromiter(seen.values(), np.int64, len(words)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words int, one double column for each of NAMES) of every document; nulls for one without words."""
    counts = word_counts(docs, text)
    bits = np.log2(max(counts.sum(), 1)) - np.log2(np.maximum(counts, 1))
    shared = docs.sparkSession.sparkContext.broadcast(bits.astype(np.float32))
    src = docs.select(key, text)
    kind = dict(src.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x = measure([tokens(t) for t in b.column(1).to_pylist()], shared.value)
            cols = [pa.array(c, pa.float64(), from_pandas=True) for c in x.T]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), *cols], [key, "words", *NAMES])

    return src.mapInArrow(run, f"`{key}` {kind}, words int, " + ", ".join(f"{c} double" for c in NAMES))


@dataclass
class Scale:
    """A fitted scale: level > k where weights . design + cuts[k-1] > 0."""

    weights: np.ndarray
    cuts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def design(x: np.ndarray) -> np.ndarray:
    """Features, and their products with the language share and with missing stops."""
    i, u = NAMES.index("english"), NAMES.index("unstopped")
    return np.hstack([x, x[:, :u] * x[:, [i]], x[:, :6] * x[:, [u]]])


def fit(x: np.ndarray, above: np.ndarray, weight: np.ndarray, penalty: float = 3.0, steps: int = 25) -> Scale:
    """Ordinal regression with one slope for all cuts and a ridge penalty, by Newton's method.

    above[:, k]: the share of a document's raters who put it above level k + 1.
    """
    z = design(x)
    mean, spread = z.mean(0), z.std(0)
    spread[spread < 1e-9] = 1
    z = (z - mean) / spread
    n, p = z.shape
    k = above.shape[1]
    share = np.clip((weight @ above) / weight.sum(), 0.01, 0.99)
    theta = np.concatenate([np.zeros(p), np.log(share / (1 - share))])
    ridge = np.concatenate([np.full(p, penalty), np.full(k, 1e-3)])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ theta[:p, None] + theta[p:], -30, 30)))
        e, v = (above - q) * weight[:, None], np.maximum(q * (1 - q), 1e-6) * weight[:, None]
        g = np.concatenate([z.T @ e.sum(1), e.sum(0)]) - ridge * theta
        h = np.zeros((p + k, p + k))
        h[:p, :p] = (z * v.sum(1)[:, None]).T @ z
        h[:p, p:] = z.T @ v
        h[p:, :p] = h[:p, p:].T
        h[p:, p:] = np.diag(v.sum(0))
        step = np.linalg.solve(h + np.diag(ridge), g)
        theta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return Scale(theta[:p], np.minimum.accumulate(theta[p:]), mean, spread)


def _score(s: Scale) -> Column:
    """The linear score as an expression over the feature columns."""
    w = s.weights / s.spread
    i, u = NAMES.index("english"), NAMES.index("unstopped")
    terms = [F.col(c) for c in NAMES] + [F.col(c) * F.col(NAMES[i]) for c in NAMES[:u]] + [F.col(c) * F.col(NAMES[u]) for c in NAMES[:6]]
    total = F.lit(float(-(w @ s.mean)))
    for a, t in zip(w, terms):
        total = total + F.lit(float(a)) * t
    return total


def graded(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(key, words, score, level) of every document; level 1 for a document of fewer than 30 words and for null texts.

    grades: (key, level, rater), repeated rows counting once, null and unknown levels not at all. The scale is fitted on at
    most max_labelled graded documents, the first in the order of a hash; everything else covers all documents. Without any
    usable grade, score and level are null.
    """
    from tarmill.runtime import cut

    x = cut(features(docs, key, text), "features")
    g = grades.select(F.col(key).alias("__k"), F.col("level").cast("int").alias("level"), "rater").where(F.col("level").between(1, LEVELS)).distinct()
    above = [F.avg((F.col("level") > k).cast("double")).alias(f"above{k}") for k in range(1, LEVELS)]
    g = g.groupBy("__k").agg(F.count(F.lit(1)).cast("double").alias("raters"), *above)
    lab = x.where(F.col("words") >= LEAST_WORDS).join(g, F.col(key) == F.col("__k")).orderBy(F.xxhash64("__k")).limit(max_labelled).toPandas()
    if lab.empty:
        return x.select(key, "words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"))
    s = fit(lab[NAMES].to_numpy(), lab[[f"above{k}" for k in range(1, LEVELS)]].to_numpy(), lab["raters"].to_numpy())
    level = F.lit(1)
    for c in s.cuts:
        level = level + (F.col("score") > -float(c)).cast("int")
    level = F.when((F.col("words") < LEAST_WORDS) | F.col("score").isNull(), F.lit(1)).otherwise(level)
    return x.withColumn("score", _score(s)).select(key, "words", "score", level.alias("level"))
