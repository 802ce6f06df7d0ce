"""Naive Bayes over the contexts of words: neighbours of each word, and the label that the examples of its form make likeliest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmill.functions import text

# Features of a word: b (always there), the word before and its last two letters, the word after, its last two and its last, the
# word after that, and the place in the line.
BEFORE, BEFORE_2, AFTER, AFTER_2, AFTER_1, SECOND, PLACE = (k << 40 for k in range(7))
FEATURES = 8
PART = 1_000_000  # rows of a form in one task
FEW = 32  # labels that are scored without bounds
CELLS = 300_000  # scores of a task at once
NEAR = 1e-7  # far above what rounding does to a score


def neighbours(rows: DataFrame, key: list[str], left: str = "dial", right: str = "std") -> DataFrame:
    """(key, pos, left word, right word, prev, next, next2) of two texts word by word, as far as the shorter goes. The neighbours
    are left words, null beyond the ends. Null texts give no rows.

    Repeated rows count once. Where a key has several texts, the words that they share (pos, left and right word) count once, with
    the least of their contexts. Texts are shuffled once by the key, and words not at all.
    """
    x = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).repartition(*key)
    x = x.select(*key, text.tokens(F.col(left)).alias("__a"), text.tokens(F.col(right)).alias("__b"))
    n = F.least(F.size("__a"), F.size("__b"))
    x = x.select(*key, F.slice("__a", F.lit(1), n).alias("__a"), "__b", n.alias("__n"))
    z = F.arrays_zip(
        F.col("__a").alias("a"), F.slice("__b", F.lit(1), F.col("__n")).alias("b"), F.slice(F.concat(F.array(F.lit(None).cast("string")), "__a"), F.lit(1), F.col("__n")).alias("prev"),
        F.slice("__a", F.lit(2), F.col("__n")).alias("next"), F.slice("__a", F.lit(3), F.col("__n")).alias("next2"),
    )
    x = x.select(*key, F.posexplode(z).alias("pos", "z")).select(*key, "pos", F.col("z.a").alias(left), F.col("z.b").alias(right), F.struct("z.prev", "z.next", "z.next2").alias("c"))
    return x.groupBy(*key, "pos", left, right).agg(F.min("c").alias("c")).select(*key, "pos", left, right, "c.prev", "c.next", "c.next2")


class Numbers:
    """Numbers of strings, in the order in which they come."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.names: list[str] = []

    def number(self, s: str) -> int:
        k = self.of.setdefault(s, len(self.names))
        if k == len(self.names):
            self.names.append(s)
        return k

    def column(self, column: pa.Array, null: str | None = None, ends: tuple[int, ...] = (0,)) -> list[np.ndarray]:
        """For each end the numbers of the last so many letters, of whole strings for 0; of -1 for null, unless it has a name."""
        d = column.dictionary_encode()
        at = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
        values = [*d.dictionary.to_pylist(), null]
        return [np.array([-1 if v is None else self.number(v[-e:] if e else v) for v in values], np.int64)[at] for e in ends]


def context_keys(words: Numbers, prev: pa.Array, nxt: pa.Array, nxt2: pa.Array) -> np.ndarray:
    """The features of each row, without b, as numbers."""
    p, p2 = words.column(prev, "<s>", (0, 2))
    n, n2, n1 = words.column(nxt, "</s>", (0, 2, 1))
    (m,) = words.column(nxt2, "</s>")
    first, last = (c.is_null().to_numpy(zero_copy_only=False) for c in (prev, nxt))
    place = np.where(first, 0, np.where(last, 1, 2))
    return np.column_stack([p + BEFORE, p2 + BEFORE_2, n + AFTER, n2 + AFTER_2, n1 + AFTER_1, m + SECOND, place + PLACE])


class ContextModel:
    """Counts of one form's examples: of labels (prior), of the features of each label, and of different features (v).

    A label's score is the log of its share of the examples and, for each of the eight features, that of
    (c + 0.5) / (8 prior + 0.5 v), c being the label's examples with the feature. Without any shared feature it is known from the
    prior alone, so only features that a label has are looked up. Labels are classed by the power of two of their prior: what the
    class could reach at most, with the greatest counts that any of its labels has, tells whether it is scored at all. So the
    best label is exact, and rare labels, of which there may be very many, cost little.
    """

    def __init__(self, keys: np.ndarray, labels: np.ndarray, names: list[str]) -> None:
        ids, y = np.unique(labels, return_inverse=True)
        order = np.array(sorted(range(len(ids)), key=lambda k: names[ids[k]]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids, y = ids[order], rank[y]
        prior = np.bincount(y)
        self.features, f = np.unique(keys, return_inverse=True)
        v = len(self.features) + 1
        base = np.log(prior / len(y)) - FEATURES * np.log(FEATURES * prior + 0.5 * v) + np.log(prior + 0.5) + (FEATURES - 1) * np.log(0.5)
        pairs, c = np.unique(f.reshape(-1) * len(ids) + np.repeat(y, keys.shape[1]), return_counts=True)
        f, y, gain = pairs // len(ids), pairs % len(ids), np.log(c + 0.5) - np.log(0.5)
        power = np.log2(prior).astype(np.int64) if len(ids) > FEW else np.zeros(len(ids), np.int64)
        self.classes = []
        for k in np.unique(power)[::-1]:
            own, held = np.flatnonzero(power == k), power[y] == k
            starts = np.concatenate([[0], np.cumsum(np.bincount(f[held], minlength=v))])
            most = np.zeros(v)  # the last stands for features that no example has
            np.maximum.at(most, f[held], gain[held])
            self.classes.append((own, base[own], base[own].max(), most, starts, np.searchsorted(own, y[held]), gain[held]))

    def best(self, keys: np.ndarray) -> np.ndarray:
        """The number of the best label of each row, of equal ones the greatest string."""
        at = np.searchsorted(self.features, keys)
        f = np.where(self.features[np.minimum(at, len(self.features) - 1)] == keys, at, len(self.features))
        score, label = np.full(len(keys), -np.inf), np.full(len(keys), -1)
        for own, base, top, most, starts, held, gain in self.classes:
            rows = np.flatnonzero(top + most[f].sum(axis=1) >= score - NEAR)
            step = max(1, CELLS // len(own))
            for r in (rows[k : k + step] for k in range(0, len(rows), step)):
                g = f[r].reshape(-1)
                n = starts[g + 1] - starts[g]
                hits = np.arange(n.sum()) + np.repeat(starts[g] - np.cumsum(n) + n, n)
                cells = np.repeat(np.arange(len(r)) * len(own), n.reshape(len(r), -1).sum(axis=1)) + held[hits]
                s = np.round(np.bincount(cells, gain[hits], len(r) * len(own)).reshape(len(r), -1) + base, 9)
                j = len(own) - 1 - s[:, ::-1].argmax(axis=1)
                s, j = s[np.arange(len(r)), j], own[j]
                better = (s > score[r]) | (s == score[r]) & (j > label[r])
                score[r[better]], label[r[better]] = s[better], j[better]
        return self.ids[label]


def predict(rows: DataFrame, examples: DataFrame, forms: DataFrame, sizes: DataFrame, form: str = "dial", label: str = "std", least: int = 8) -> DataFrame:
    """rows of the stated forms with `majority` and `predicted`, the likeliest label of each in its context; null where its form
    has fewer than `least` examples.

    rows and examples: (form, label, prev, next, next2), words without blanks, neighbours null beyond the ends; rows may have more
    columns. forms: (form, majority), once each; sizes: (form, n), about how many rows each form has.

    All three meet by form in one shuffle, the only one of words; a task holds the counts of one form and streams its rows. Forms
    of more than PART rows are spread over several tasks, to each of which their examples go.
    """
    parts = F.broadcast(sizes.where(F.col("n") > PART).select(form, F.ceil(F.col("n") / PART).cast("int").alias("__parts")))  # at most one for PART rows
    fields = [label, "prev", "next", "next2"]
    more = [c for c in rows.columns if c not in [form, *fields]]
    n = F.coalesce("__parts", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), n - 1))

    def sent(df: DataFrame, kind: int, words: list[str], part: Column) -> DataFrame:
        packed = F.concat_ws(" ", *[F.coalesce(w, F.lit("")) for w in words])  # one string takes less room than four
        return df.join(parts, form, "left").select(form, part.alias("__part"), F.lit(kind).alias("__kind"), packed.alias("__w"), *[F.col(c) if kind == 2 else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in more])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, usual, seen, model, words, labels = None, -1, [], None, Numbers(), Numbers()
        for b in batches:
            if not b.num_rows:
                continue
            column = {c: b.column(c) for c in b.schema.names}
            encoded = column[form].dictionary_encode()
            f, part, kind = encoded.indices.to_numpy(), column["__part"].to_numpy(), column["__kind"].to_numpy()
            if (encoded.dictionary[f[0]].as_py(), part[0]) != now:
                words, labels = Numbers(), Numbers()  # no counts refer to them
            keys = context_keys(words, column["prev"], column["next"], column["next2"])
            (y,) = labels.column(column[label])
            majority, got = np.full(b.num_rows, -1), np.full(b.num_rows, -1)
            cuts = [0, *(np.flatnonzero((np.diff(f) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if (at := (encoded.dictionary[f[start]].as_py(), part[start])) != now:
                    now, usual, seen, model = at, -1, [], None
                if kind[start] == 0:
                    usual = y[start]
                elif usual < 0:
                    continue
                elif kind[start] == 1:
                    seen.append((keys[start:stop], y[start:stop]))
                else:
                    if seen:
                        k, v = (np.concatenate(z) for z in zip(*seen))
                        seen, model = [], ContextModel(k, v, labels.names) if len(v) >= least else None
                    majority[start:stop] = usual
                    if model:
                        got[start:stop] = model.best(keys[start:stop])
            names = pa.array(labels.names, pa.string())
            made = [names.take(pa.array(k, mask=k < 0)) for k in (majority, got)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in given), *made], names=[*given, "majority", "predicted"]).filter(pa.array((kind == 2) & (majority >= 0)))

    given = rows.columns
    x = sent(forms, 0, ["majority"], every).unionByName(sent(examples, 1, fields, every)).unionByName(sent(rows, 2, fields, F.pmod(F.xxhash64(*given), n).cast("int")))
    x = x.repartition(form, "__part").sortWithinPartitions(form, "__part", "__kind").withColumn("__w", F.split("__w", " "))
    x = x.select(form, "__part", "__kind", *[F.nullif(F.get("__w", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(fields)], *more)
    none = F.lit(None).cast("string")
    return x.mapInArrow(labelled, rows.withColumns({"majority": none, "predicted": none}).schema)
