"""Problem 7: held-out passages inside a corpus.

Method: winnowing. Both sides keep the least k-gram hash of each sliding window, which guarantees that every shared run of
at least window + k - 1 words shares a fingerprint; corpus fingerprints are joined with those of the held-out texts, and
hits are extended to a passage that keeps the error rate. A passage of 24 words and more falls into two of at least 12, one of
which keeps the rate too, so passages of 12 to 23 words decide. With one error in six each of those has an unbroken run of
four words (ten words in three runs at twelve), so k = 3 and windows of two suffice, and only the surroundings of a hit are
looked at, however long the texts are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmill.runtime import cut

K, WINDOW = 3, 2
RUN = K + WINDOW - 1
LEAST_WORDS, WORDS_PER_ERROR = 12, 6
#: Characters of held-out text that are broadcast, with their fingerprints; more of it is joined by fingerprint.
BROADCAST_CHARS = 4_000_000
#: Slots of the bitmap that keeps fingerprints no held-out text has out of the join; its size, 8 MB, doesn't grow.
SLOTS = 1 << 26
BLOCK = 1 << 20  # hits looked at together
SALT = 16  # parts of each fingerprint in the join

_LONGEST = 2 * LEAST_WORDS - 1  # words of the passages that decide
_ERRORS = _LONGEST // WORDS_PER_ERROR
_REACH = 24  # hits so near to each other on a diagonal are extended together
_TAG = re.compile(r"</?[a-z!][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_WORD = re.compile(r"[^\W_]+")


def _shows_nothing(c: str) -> bool:
    """Marks, format signs, controls other than line ends and tabs, and letters that show nothing."""
    kind = unicodedata.category(c)
    return kind[0] == "M" or kind == "Cf" or c in "\u115f\u1160\u3164\uffa0" or (kind == "Cc" and not c.isspace())


_BASIC = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(1 << 16)) if _shows_nothing(c)) + "]+")  # a bitmap to the library
_HIGH = re.compile("[\U00010000-\U0010ffff]")


def words(text: str | None) -> list[str]:
    """The words of a text that are compared: lower case, no accents, punctuation, markup, invisible or wide characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    t = _BASIC.sub("", text.lower())
    if _HIGH.search(t):
        t = _HIGH.sub(lambda m: "" if _shows_nothing(m[0]) else m[0], t)
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    return _WORD.findall(t)


class Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        if len(self) > 1 << 20:
            self.clear()
        return np.array([self[w] for w in ws], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def winnow(ids: np.ndarray, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen k-grams of a row of word hashes; none of texts that hold no whole window. end: True where a text ends, so that several texts may
    follow each other in one row; no k-gram and no window goes over an end."""
    n = len(ids) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(K):
        gram = gram * np.uint64(0x100000001B3) + ids[j : n + j]
    h = _mix(gram)
    whole = np.ones(n, bool)
    if end is not None:
        for j in range(K - 1):  # a text may end with a k-gram's last word
            whole &= ~end[j : n + j]
    take, m = np.zeros(n, bool), n - WINDOW + 1
    if m > 0:
        least = np.minimum.reduce([h[i : m + i] for i in range(WINDOW)])
        inside = np.logical_and.reduce([whole[i : m + i] for i in range(WINDOW)])
        for j in range(WINDOW):  # chosen if it is the least of some window
            take[j : m + j] |= inside & (h[j : m + j] == least)
    at = np.flatnonzero(take)
    return at, h[at]


def runs(ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints with one more word on either side: a run of RUN words shares one of them."""
    left, right = at[at > 0], at + K < len(ids)
    a = _mix(h[at > 0] ^ _mix(ids[left - 1]))
    b = _mix(h[right] + ids[at[right] + K])
    return np.concatenate([left, at[right]]), np.concatenate([a, b])


@dataclass
class HeldOut:
    """Items as word hashes, and their fingerprints in order of hash."""

    ids: list[int]
    flat: np.ndarray
    start: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> HeldOut:
        hashes = Hashes()
        kept = [(i, w) for i, t in items if len(w := words(t)) >= LEAST_WORDS]
        text = [hashes.of(w) for _, w in kept]
        got = [winnow(t) for t in text]
        h = np.concatenate([x for _, x in got]) if got else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(got)), [len(x) for x, _ in got])
        place = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.int64)
        o = np.argsort(h, kind="stable")
        flat = np.concatenate(text) if text else np.zeros(1, np.uint64)
        return cls([i for i, _ in kept], flat, np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64), h[o], item[o].astype(np.int64), place[o])

    def find(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(number of the document, item) of every passage."""
        size = np.array([len(x) for x in docs])
        start = np.concatenate([[0], np.cumsum(size)])
        row = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        end = np.zeros(len(row), bool)
        end[start[1:][size > 0] - 1] = True
        at, h = winnow(row, end)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = hi > lo
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        edge, total = np.searchsorted(at, start), np.concatenate([[0], np.cumsum(n)])  # hits of each document
        x = 0
        while x < len(docs):  # blocks of whole documents, however often common fingerprints hit
            y = max(x + 1, int(np.searchsorted(total[edge], total[edge[x]] + BLOCK, "right")) - 1)
            i, j = edge[x], edge[y]
            which = np.repeat(lo[i:j] - np.cumsum(n[i:j]) + n[i:j], n[i:j]) + np.arange(n[i:j].sum())
            place, item, here = self.place[which], self.item[which], np.repeat(at[i:j], n[i:j])
            doc = np.searchsorted(start, here, "right") - 1
            there, stop = self.start[item] + place, self.start[item + 1]
            before = (here > start[doc]) & (place > 0) & (row[here - 1] == self.flat[there - 1])
            after = (here + K < start[doc + 1]) & (there + K < stop)
            after &= row[np.minimum(here + K, len(row) - 1)] == self.flat[np.minimum(there + K, len(self.flat) - 1)]
            run = np.flatnonzero(before | after)
            yield from self._extended(row, start, doc[run], item[run], here[run], place[run])
            x = y

    def _extended(self, row: np.ndarray, start: np.ndarray, doc: np.ndarray, item: np.ndarray, here: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) where hits extend to a passage."""
        order = np.lexsort((here, place, item, doc))
        doc, item, here, place = doc[order], item[order], here[order] - start[doc[order]], place[order]
        edge = np.concatenate([np.flatnonzero(np.diff(doc << 32 | item, prepend=-1)), [len(item)]])
        wide = _LONGEST + 2 * _ERRORS
        for lo, hi in zip(edge[:-1], edge[1:]):
            t, ids = self.flat[self.start[item[lo]] : self.start[item[lo] + 1]], row[start[doc[lo]] : start[doc[lo] + 1]]
            done: list[tuple[int, int]] = []  # (place in the item, diagonal) of hits that were extended in vain
            for p, q in zip(here[lo:hi].tolist(), place[lo:hi].tolist()):
                if any(0 <= q - r <= _REACH and abs(p - q - g) <= _ERRORS for r, g in done[-8:]):
                    continue
                if passage(t[max(0, q - _LONGEST) : q + _REACH + _LONGEST + K], ids[max(0, p - wide) : p + _REACH + wide + K]):
                    yield int(doc[lo]), self.ids[item[lo]]
                    break
                done.append((q, p - q))


def passage(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether doc holds a passage of at least LEAST_WORDS successive words of item with one error in WORDS_PER_ERROR at most.

    best[c] holds, for each place in doc, the best of (words - WORDS_PER_ERROR x errors) over alignments that end there and
    have passed c words of the item (LEAST_WORDS stands for that many or more).
    """
    c, n = LEAST_WORDS, len(doc)
    low = -1e9
    best = np.full((c + 1, n + 1), low)
    ramp = WORDS_PER_ERROR * np.arange(n + 1)
    miss = 1 - WORDS_PER_ERROR
    for w in item:
        best[0] = 0
        new = np.full((c + 1, n + 1), low)
        step = np.where(doc == w, 1, miss)
        down = best[:, :-1] + step
        new[1:, 1:] = down[:-1]
        new[c, 1:] = np.maximum(new[c, 1:], down[c])
        gone = best + miss
        new[1:] = np.maximum(new[1:], gone[:-1])
        new[c] = np.maximum(new[c], gone[c])
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        if new[c].max() >= 0:
            return True
        best = new
    return False


def _kind(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def _searched(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """leaked() for held-out text of bounded size: it is broadcast, and the corpus passes once, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(HeldOut.of([(r[0], r[1]) for r in items.select(item_key, item_text).collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            found = list(shared.value.find([hashes.of(words(t)) for t in b.column(1).to_pylist()]))
            keys = pa.array([d for d, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keys), pa.array([i for _, i in found], pa.int64())], [key, item_key])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {_kind(docs, key)}, `{item_key}` long")


def _prints(df: DataFrame, key: str, text: str, out: str, least: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """(h, out) once for each text and run hash; texts of fewer than `least` words have none. Hashes that are not in the bitmap,
    if one is given, are left out."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            rows, got = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                if len(w := words(t)) >= least:
                    ids = hashes.of(w)
                    h = np.unique(runs(ids, *winnow(ids))[1])
                    if shared is not None:
                        slot = h % np.uint64(SLOTS)
                        h = h[shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0]
                    rows.append(np.full(len(h), r)), got.append(h)
            at = pa.array(np.concatenate(rows) if rows else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(got) if got else np.zeros(0, np.uint64)).view(np.int64)), b.column(0).take(at)], ["h", out])

    return df.select(key, text).mapInArrow(run, f"h long, `{out}` {_kind(df, key)}")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which hashes modulo SLOTS occur. What reaches the driver is bounded by SLOTS, not by the texts."""
    slot = F.pmod(F.col("h"), F.lit(SLOTS))  # SLOTS divides 2^64, so the sign doesn't matter
    bits = prints.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod(slot, F.lit(32))).cast("long")).alias("bits")).toPandas()
    out = np.zeros(SLOTS // 32, np.uint32)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _joined(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """leaked() for held-out text of any size: fingerprints of both sides are joined, then the texts of the pairs that share one.

    A fingerprint is spread over SALT parts on the corpus side, so that one that a third of all documents hold is no single
    task, and held-out fingerprints go to each part. Only documents with a hit take part in the second join.
    """
    held = cut(_prints(items, item_key, item_text, "__i", LEAST_WORDS), "held")
    mine = _prints(docs, key, text, "__d", RUN, _bitmap(held)).withColumn("__s", F.pmod(F.xxhash64("h", "__d"), F.lit(SALT)))
    theirs = held.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    pairs = cut(mine.join(theirs.hint("shuffle_hash"), ["h", "__s"]).select("__d", "__i").distinct(), "pairs")
    x = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(pairs, F.col("__k").eqNullSafe(F.col("__d")))
    x = x.join(items.select(F.col(item_key).alias("__j"), F.col(item_text).alias("__u")), F.col("__i") == F.col("__j")).select("__k", "__t", "__i", "__u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            item, doc = b.column(3).to_pylist(), b.column(1).to_pylist()
            hit = [r for r in range(b.num_rows) if any(HeldOut.of([(0, item[r])]).find([hashes.of(words(doc[r]))]))]
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at)], [key, item_key])

    return x.mapInArrow(run, f"`{key}` {_kind(docs, key)}, `{item_key}` long")


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(key, item_key) for each document that holds a passage of an item: at least 12 successive words of the item with at
    most one in six changed, added or missing. Words at the ends of a passage may be the changed ones.

    Null and empty texts hold nothing; items of fewer than 12 words are never found, nor are null item keys; repeated documents
    each count, repeated items once a copy. Held-out text of up to broadcast_chars is broadcast, more of it is joined by
    fingerprint; both give the same rows.
    """
    it = items.select(item_key, item_text).where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).withColumn(item_key, F.col(item_key).cast("long"))
    total = it.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    way = _searched if total <= broadcast_chars else _joined
    return way(docs, key, text, it, item_key, item_text)
