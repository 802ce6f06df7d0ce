"""Readers for the file forms that corpora come in."""

from __future__ import annotations

import io
import os
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; all columns are strings unless a schema is given."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated values; quotes are ordinary characters."""
    r = spark.read.option("sep", "\t").option("header", header).option("quote", "")
    return (r.schema(schema) if schema else r).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): what white space separates in a text file."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''")


def split_file(folder: str, split_id: str) -> str:
    """The list file of a split, whose id ends in a version: dial.test.v1 is dial.test.txt."""
    return os.path.join(folder, re.sub(r"\.v[^.]*$", "", split_id) + ".txt")


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a pattern in order of name, on any file system that Spark reads; none if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    got = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in got or [])


def place() -> Column:
    """Where a row of files read by Spark stands: file, split of the file, and a number that rises within the split. Rows in the
    order of this are in the order of file names and lines, however Spark packs splits into tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def with_line(df: DataFrame) -> DataFrame:
    """Rows of files with their place, a struct that orders them by file name and line."""
    return df.withColumn("place", place())


def jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines; with a key, the last line of each key, of the last file by name. Lines that aren't JSON keep nulls and their text in `_corrupt_record`
    if the schema has that column."""
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if key is None:
        return df
    cols = [c for c in df.columns if c != key]
    x = df.withColumn("__n", place())
    return x.groupBy(key).agg(F.max_by(F.struct(*cols), "__n").alias("r")).select(key, "r.*")


LAYER = "id string, split string, tier string, text string, dial string, std string, speaker string, alignment array<array<string>>, unsure array<int>"


def layer(spark: SparkSession, path: str) -> DataFrame:
    """A reference layer by id: one with `text` only serves as both dialect and standard; alignments become structs."""
    x = jsonl(spark, path, LAYER, "id")
    fallback = F.coalesce("text", F.lit(""))
    a = F.transform("alignment", lambda z: F.struct(z[0].alias("dial"), z[1].alias("std"), z[2].alias("tag"), F.get(z, 3).alias("src")))
    return x.withColumns({"std": F.when(F.col("dial").isNull(), fallback).otherwise(F.col("std")), "dial": F.coalesce("dial", fallback), "alignment": a}).drop("text")


def corpus(spark: SparkSession, pattern: str, schema: str, exclude: DataFrame | None = None) -> DataFrame:
    """JSON lines of all files of a pattern with their place, see with_line(), without the ids in exclude."""
    x = with_line(spark.read.schema(schema).json(found(spark, pattern)))
    return x if exclude is None else x.join(exclude.select("id"), "id", "left_anti")


def first_delimiter(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """(head, tail) of lines cut at the first delimiter; the tail may hold more of them."""
    parts = F.split("value", re.escape(delimiter), 2)
    return spark.read.text(path).select(parts[0].alias("head"), F.coalesce(F.get(parts, 1), F.lit("")).alias("tail"))


def parquet(spark: SparkSession, path: str, *columns: str, merge: bool = False) -> DataFrame:
    """Only the named columns of Parquet files; merge joins differing schemas, absent columns as null."""
    return spark.read.option("mergeSchema", merge).parquet(path).select(*columns)


def enumerated(df: DataFrame, order: list[str], prefix: str, digits: int = 4) -> DataFrame:
    """df with an id made of a prefix and the row's place, from 0, in a given order."""
    from tarmill.operators.batches import numbered

    return numbered(df, order, "__at").withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col("__at").cast("string"), digits, "0"))).drop("__at")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in tar archives; one archive is read by one task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, data in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [os.path.basename(at)], "name": [os.path.basename(m.name)], "content": [t.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, content binary")


def spoken_pairs(spark: SparkSession, tar: str, table: str) -> DataFrame:
    """(id, content, sentence, speaker) of archive members that a table lists; client ids are hashed."""
    t = tsv(spark, table).select(F.col("path").alias("name"), "sentence", F.substring(F.sha2("client_id", 256), 1, 12).alias("speaker"))
    return tar_members(spark, tar).join(t, "name").select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), "content", "sentence", "speaker")


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(sha256, name) of manifest lines."""
    x = spark.read.text(found(spark, pattern))
    parts = F.split(F.trim("value"), r"\s+", 2)
    return x.where(F.trim("value") != "").select(parts[0].alias("sha256"), parts[1].alias("name"))


def verify(spark: SparkSession, pattern: str, folder: str) -> DataFrame:
    """(name, status) of manifest files that are changed or absent; no rows if all is well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("now"))
    x = manifest(spark, pattern).join(have, "name", "left")
    return x.select("name", F.when(F.col("now").isNull(), "absent").when(F.col("now") != F.col("sha256"), "changed").alias("status")).where("status is not null")


def document(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.option("multiLine", True).json(path)


def parts_or_whole(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A file if it is there, else its numbered parts path.p00, path.p01, ..., with the place of each row, else None."""
    files = found(spark, path) or found(spark, path + ".p[0-9][0-9]")
    return with_line(spark.read.schema(schema).json(files)) if files else None


def probed(df: DataFrame, content: str, out: str = "duration") -> DataFrame:
    """df with the seconds of PCM WAV data in a new column; null where the header can't be read."""
    import struct

    @F.pandas_udf("double")
    def seconds(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> float | None:
            try:
                if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
                    return None
                at, rate = 12, None
                while at + 8 <= len(b):
                    name, n = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
                    if name == b"fmt ":
                        rate = struct.unpack("<I", b[at + 16 : at + 20])[0]
                    if name == b"data":
                        return n / rate if rate else None
                    at += 8 + n + (n & 1)
            except (TypeError, struct.error):
                pass
            return None

        return pd.Series([one(x) for x in s], dtype="float64")

    return df.withColumn(out, seconds(content))


def served(df: DataFrame, key: str, ask, schema: str, tries: int = 4, wait: float = 5.0) -> DataFrame:
    """Answers of an external service, (key, ...) by schema: ask(row dict) -> dict, repeated with growing pauses; a row whose
    service keeps failing has nulls. The client is whatever the caller passes; it is called from the tasks."""
    import time

    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                got = {}
                for k in range(tries):
                    try:
                        got = ask(row)
                        break
                    except Exception:  # noqa: BLE001
                        if k + 1 < tries:
                            time.sleep(wait * (k + 1))
                out.append(dict.fromkeys(names) | {key: row[key], **got})
            yield pd.DataFrame({n: pd.Series([r[n] for r in out], dtype=object) for n in names})

    return df.mapInPandas(run, schema)


def last_line_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
