"""Numbered and packed batches, token windows, neighbours, block samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmill.operators.splits import shuffled
from tarmill.runtime import cut


def numbered(df: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """df with its place (from 0) in a total order, without a window over all rows in one task.

    Rows are range-partitioned and sorted; the counts of the partitions, one number each, give each its first place.
    """
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    w = Window.partitionBy("__p").orderBy(*order)
    return x.join(F.broadcast(base), "__p").select(*df.columns, (F.col("__base") + F.row_number().over(w) - 1).alias(name))


def fixed(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch, from 1, of `size` rows in order; the last may be smaller."""
    return numbered(df, order, "__at").withColumn("batch", (F.floor(F.col("__at") / size) + 1).cast("long")).drop("__at")


def greedy(df: DataFrame, key: str, order: str, weight: str, most_rows: int, most_weight: int) -> DataFrame:
    """(key, order, chunk) by filling chunks in order: a new one begins when the current is not empty and would exceed
    most_rows or most_weight. Null weights are 0.

    Rows stream past in order, whatever a key holds; only the current chunk's number, rows and weight are kept.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = pack  # no key
        chunk = n = total = 0
        for b in batches:
            out = []
            for k, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                w = w or 0
                if k != now:
                    now, chunk, n, total = k, 1, 0, 0
                elif n >= most_rows or total + w > most_weight:
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + w
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], [key, order, "chunk"])

    t = dict(df.dtypes)
    x = df.select(key, order, weight).repartition(key).sortWithinPartitions(key, order)
    return x.mapInArrow(pack, f"`{key}` {t[key]}, `{order}` {t[order]}, chunk long")


def neighbours(df: DataFrame, chunk: list[str], order: str, same: str, line: str, before: int = 3, after: int = 2) -> DataFrame:
    """df with the lines just before and after each row in its chunk that have the same value of `same`."""
    w = Window.partitionBy(*chunk).orderBy(order)
    item = F.struct(F.col(same).alias("s"), F.col(line).alias("l"))
    pick = lambda c: F.transform(F.filter(c, lambda x: x["s"].eqNullSafe(F.col(same))), lambda x: x["l"])
    x = df.withColumns({"__b": F.collect_list(item).over(w.rowsBetween(-before, -1)), "__a": F.collect_list(item).over(w.rowsBetween(1, after))})
    return x.withColumns({"before": pick(F.col("__b")), "after": pick(F.col("__a"))}).drop("__b", "__a")


def window(words: Column, at: Column, k: int) -> Column:
    """Up to k words on either side of the word at place `at` (from 0), with ellipses where words are left out."""
    first = F.greatest(F.lit(0), at - k)
    body = F.slice(words, first + 1, at - first + k + 1)
    return F.concat(F.when(first > 0, "… ").otherwise(""), F.array_join(body, " "), F.when(at + k + 1 < F.size(words), " …").otherwise(""))


def marked(words: Column, at: Column) -> Column:
    """The words as one text, those at the places `at` (from 0) in angle brackets; a null list marks none."""
    places = F.coalesce(at, F.array().cast("array<int>"))
    return F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(places, i.cast("int")), F.concat(F.lit("⟨"), w, F.lit("⟩"))).otherwise(w)), " ")


def choices(words: Column, options: Column) -> Column:
    """The words as one text in which each word with several options is replaced by a numbered placeholder, [1], [2], ...

    options: an array of arrays as long as words; one option or none leaves the word.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("line"))

    def add(acc: Column, z: Column) -> Column:
        n = acc["n"] + (F.size(z["o"]) > 1).cast("int")
        w = F.when(F.size(z["o"]) > 1, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(z["w"])
        return F.struct(n.alias("n"), F.concat(acc["line"], F.when(acc["line"] == "", "").otherwise(" "), w).alias("line"))

    return F.aggregate(F.zip_with(words, options, lambda w, o: F.struct(w.alias("w"), o.alias("o"))), start, add, lambda acc: acc["line"])


def block_sample(df: DataFrame, order: str, session: Column, block: int, seed: int = 2026) -> DataFrame:
    """(session, block_no, picked, ids) of unbroken runs of `block` rows of one session that do not overlap, in seeded order.

    Sessions are cut at multiples of `block` from a seeded offset, so runs can be chosen independently of each other.
    """
    x = df.withColumn("session", session).withColumn("__at", F.row_number().over(Window.partitionBy("session").orderBy(order)) - 1)
    x = x.withColumn("block_no", F.floor((F.col("__at") + shuffled("session", seed=seed) % block) / block))
    g = x.groupBy("session", "block_no").agg(F.array_sort(F.collect_list(order)).alias("ids")).where(F.size("ids") == block)
    return g.withColumn("picked", shuffled("session", "block_no", seed=seed))
