"""Edit counts over words and alignment against alternative spellings, computed for whole Arrow batches at once.

Words become numbers, texts become rows of padded arrays of like sizes, and each step of a table takes one word of every text.
A row of a table is kept less the cost of getting there by insertions alone, so that insertions are a running minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

EDITS = StructType([StructField(n, LongType()) for n in ("e_dial", "sub", "del", "ins", "e_std", "e_either")] + [StructField("per", ArrayType(IntegerType()))])
CELLS = 1 << 22  # cells of the tables of one group of texts, and of the states kept at once for tracing back
_NO_REF, _NO_HYP = -1, -2  # stand after the ends of texts, equal to no word and not to each other


@dataclass
class Ragged:
    """Rows of numbers of any lengths: row r is flat[start[r]:start[r + 1]]."""

    flat: np.ndarray
    start: np.ndarray

    @cached_property
    def size(self) -> np.ndarray:
        return np.diff(self.start)

    def padded(self, rows: np.ndarray, width: int, pad: int) -> np.ndarray:
        """(rows, width) with the given number after the ends."""
        at = np.arange(width)
        inside = at < self.size[rows][:, None]
        out = np.full(inside.shape, pad, np.int64)
        out[inside] = self.flat[(self.start[rows][:, None] + at)[inside]]
        return out

    @classmethod
    def starts(cls, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _alike(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups whose sizes differ by a quarter at most, so that padding costs little, and that fit CELLS."""
    step = lambda x: np.where(x < 16, x, 16 + np.ceil(np.log(np.maximum(x, 16) / 16) / np.log(1.25))).astype(np.int64)
    kind = step(n) << 32 | step(m)
    order = np.lexsort((n, kind))
    edge = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
    for lo, hi in zip(edge[:-1], edge[1:]):
        most = max(1, CELLS // ((int(m[order[lo:hi]].max()) + 1) * (int(n[order[lo:hi]].max()) + 1)))
        for at in range(lo, hi, most):
            yield order[at : min(hi, at + most)]


def edit_counts(refs: Ragged, hyps: Ragged) -> np.ndarray:
    """(rows, 4): cost, substitutions, deletions and insertions of each pair; of alignments of least cost, the one with the
    fewest substitutions. The lengths and these two numbers give the other two, so a state is cost and substitutions."""
    n, m = refs.size, hyps.size
    out = np.zeros((len(n), 4), np.int64)
    for rows in _alike(n, m):
        width, height = int(m[rows].max()), int(n[rows].max())
        small = width + height < 1 << 15
        kind, shift = (np.int32, 15) if small else (np.int64, 31)
        gap, swap = 1 << shift, (1 << shift) + 1
        a, b = refs.padded(rows, height, _NO_REF), hyps.padded(rows, width, _NO_HYP)
        state = np.zeros((len(rows), width + 1), kind)
        last = state[:, 0].copy()
        for i in range(height):
            new = state + kind(gap)
            np.minimum(new[:, 1:], state[:, :-1] + np.where(a[:, [i]] == b, kind(-gap), kind(swap - gap)), out=new[:, 1:])
            state = np.minimum.accumulate(new, axis=1)
            ends = np.flatnonzero(n[rows] == i + 1)
            last[ends] = state[ends, m[rows][ends]]
        cost, sub = (last >> shift) + m[rows], last & (gap - 1)
        lost = (cost - sub + n[rows] - m[rows]) // 2
        out[rows] = np.stack([cost, sub, lost, cost - sub - lost], 1)
    return out


def either(slots: Ragged, options: Ragged, words: Ragged, hyps: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """(cost of each row, errors of each slot) of the best alignment of a text with one option of every slot.

    Row r has the slots slots.start[r] to slots.start[r + 1], slot s the options options.start[s] to options.start[s + 1],
    option o the words words.flat[words.start[o]:words.start[o + 1]]. A slot takes a run of the text; its errors are the least
    edits between the run and an option. Ties go to the shortest run, and to the earliest end of the last one; words before
    the first run count for the first slot, words after the last for the last.
    """
    n, m = slots.size, hyps.size
    cost, errors = m.copy(), np.zeros(int(slots.start[-1]), np.int64)
    many = _different(options, words)
    for rows in _alike(n, m):
        if n[rows].max():
            cost[rows] = _either_group(rows, n[rows], m[rows], slots.start[rows], options, many, words, hyps, errors)
    return cost, errors


def _different(options: Ragged, words: Ragged) -> np.ndarray:
    """Options of each slot that need a look: one where there are two of the same single word."""
    many = options.size.copy()
    two = np.flatnonzero(many == 2)
    o = options.start[two]
    single = (words.size[o] == 1) & (words.size[o + 1] == 1)
    o, two = o[single], two[single]
    many[two[words.flat[words.start[o]] == words.flat[words.start[o + 1]]]] = 1
    return many


def _either_group(rows: np.ndarray, n: np.ndarray, m: np.ndarray, first: np.ndarray, options: Ragged, many: np.ndarray, words: Ragged, hyps: Ragged, errors: np.ndarray) -> np.ndarray:
    """Costs of rows of like sizes; the errors of their slots are written to errors."""
    width, height = int(m.max()), int(n.max())
    hyp, at = hyps.padded(rows, width, _NO_HYP), np.arange(width + 1)
    every = np.arange(len(rows))
    block = max(1, CELLS // (len(rows) * (width + 1)))

    def run(best: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(costs, where the run of slot i begins) for each end of the run, from the costs before the slot."""
        low = _run_states(best * (width + 1) + width - at, i, first, n, options, many, words, hyp, width)
        return low // (width + 1), width - low % (width + 1)

    best = np.zeros((len(rows), width + 1), np.int64)  # costs less the words passed
    kept, total, end = [], m.copy(), np.zeros(len(rows), np.int64)
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(height):
        if i % block == 0:
            kept.append(best)
            trail = []
        before, (best, begin) = best, run(best, i)
        trail.append(tuple(x.astype(np.int32) for x in (before, best, begin)))
        ends = np.flatnonzero(n == i + 1)
        if len(ends):
            least = best[ends, m[ends]]
            total[ends] = least + m[ends]
            end[ends] = (best[ends] == least[:, None]).argmax(1)
            errors[first[ends] + i] = m[ends] - end[ends]
    place = end
    for b in range(len(kept) - 1, -1, -1):
        if b < len(kept) - 1:  # long texts: the states of a block are computed again from its first costs
            best, trail = kept[b], []
            for i in range(b * block, (b + 1) * block):
                before, (best, begin) = best, run(best, i)
                trail.append((before, best, begin))
        for k in range(len(trail) - 1, -1, -1):
            i = b * block + k
            own = every[n > i]
            before, after, begin = (x[own] for x in trail[k])
            to = place[own]
            line = np.arange(len(own))
            start = begin[line, to]
            errors[first[own] + i] += after[line, to] + to - (before[line, start] + start) + (start if i == 0 else 0)
            place[own] = start
    return total


def _run_states(fresh: np.ndarray, i: int, first: np.ndarray, n: np.ndarray, options: Ragged, many: np.ndarray, words: Ragged, hyp: np.ndarray, width: int) -> np.ndarray:
    """The least states after slot i of each row: cost, then the latest begin of the run. Rows without that slot keep none."""
    gap = width + 1
    own = np.flatnonzero(n > i)
    o, k = options.start[first[own] + i], many[first[own] + i]
    low = fresh.copy()
    low[own[k > 0]] = np.iinfo(np.int64).max
    for a in range(int(k.max(initial=0))):
        has, option = own[k > a], o[k > a] + a
        state, size = fresh[has], words.size[option]
        for t in range(int(size.max(initial=0))):
            go = np.flatnonzero(size > t)
            x, w = state[go], words.flat[words.start[option[go]] + t]
            new = x + gap
            np.minimum(new[:, 1:], x[:, :-1] + np.where(w[:, None] == hyp[has[go]], -gap, 0), out=new[:, 1:])
            state[go] = np.minimum.accumulate(new, axis=1)
        low[has] = np.minimum(low[has], state)
    return low


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, or most + 1 if there are more; bit-parallel over the characters of a."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for j, c in enumerate(b):
        eq = peq.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = minus | (~(d | plus) & full), plus & d
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (~(d | up) & full), up & d
    return score


@F.pandas_udf(LongType())
def _chars_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y, max(len(x), len(y))) for x, y in zip(a, b)], dtype="Int64")


def _rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes of the lists, a null one empty, and what they hold."""
    return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), lists.flatten()


@F.arrow_udf(EDITS)
def _edits_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for dial, std, slots, hyp in batches:
        (nd, d), (ns, s), (nh, h), (n, inner) = _rows(dial), _rows(std), _rows(hyp), _rows(slots)
        k, inner = _rows(inner)
        size, w = _rows(inner)
        flat = pc.fill_null(pa.concat_arrays([x.cast(pa.string()) for x in (d, s, h, w)]), "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        d, s, h, w = np.split(flat.astype(np.int64), np.cumsum([len(d), len(s), len(h)]))
        hyps = Ragged(h, Ragged.starts(nh))
        ed, es = edit_counts(Ragged(d, Ragged.starts(nd)), hyps), edit_counts(Ragged(s, Ragged.starts(ns)), hyps)
        starts = Ragged.starts(n)
        cost, errors = either(Ragged(np.zeros(0), starts), Ragged(np.zeros(0), Ragged.starts(k)), Ragged(w, Ragged.starts(size)), hyps)
        per = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(errors, pa.int32()))
        yield pa.StructArray.from_arrays([*[pa.array(x) for x in (*ed.T, es[:, 0], cost)], per], EDITS.names)


def clip_edits(dial: Column, std: Column, slots: Column, hyp: Column) -> Column:
    """struct(e_dial, sub, del, ins, e_std, e_either, per) of word arrays dial and std and an array of slots (arrays of options,
    arrays of words) against the word array hyp, in one pass; a null array counts as empty."""
    return _edits_udf(dial, std, slots, hyp)


def char_edits(a: Column, b: Column, long: int = 400) -> Column:
    """Edit distance in characters: built in for short texts, bit-parallel for long ones."""
    short = (F.length(a) <= long) & (F.length(b) <= long)
    return F.when(short, F.levenshtein(a, b).cast("long")).otherwise(_chars_udf(F.when(~short, a), F.when(~short, b)))
