"""Writers: sorted lists, JSON lines, tables with a checked schema, manifests, resumable shards."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_ids(df: DataFrame, path: str, column: str = "id") -> str:
    """Different ids in order, one a line, in one file whose bytes depend on nothing else; its SHA-256 is returned. The rows
    stream through the driver partition by partition."""
    h = hashlib.sha256()
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8", newline="\n") as f:
        for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).toLocalIterator():
            f.write(r[0] + "\n")
            h.update((r[0] + "\n").encode())
    os.replace(tmp, path)
    return h.hexdigest()


#: Values as they are: blanks around them stay, a null differs from an empty text.
EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""', "nullValue": ""}


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, letters as they are, null fields left out."""
    df.write.mode("overwrite").json(path)


def tsv(df: DataFrame, path: str) -> None:
    """A table with tabs and no quotes, in which nulls and empty texts are the same."""
    df.write.mode("overwrite").options(**EXACT | {"emptyValue": ""}).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header; texts may hold quotes and line ends."""
    df.write.mode("overwrite").options(**EXACT).option("header", True).option("escape", '"').csv(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Append to a Parquet table; columns it doesn't have are refused, columns that df lacks become null."""
    have = df.sparkSession.read.parquet(path).schema
    extra = sorted(set(df.columns) - set(have.names))
    if extra:
        raise ValueError(f"unknown columns: {extra}")
    df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have]).write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> dict:
    """A one-row result as a JSON document."""
    row = json.loads(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).first()[0])
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=1)
    os.replace(f"{path}.tmp", path)
    return row


def table(df: DataFrame, name: str) -> None:
    """Replace a managed table."""
    df.write.mode("overwrite").saveAsTable(name)


def unfinished(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows whose key isn't in the Parquet files at path yet: work that a stopped run left."""
    try:
        done = df.sparkSession.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return df
        raise
    return df.join(done.distinct(), key, "left_anti")


def resume(df: DataFrame, path: str, key: str = "id") -> None:
    """Append the unfinished rows; Spark's commit makes the rows of a task appear at once or not at all."""
    unfinished(df, path, key).write.mode("append").parquet(path)


def manifest(paths: list[str], out: str, append: bool = False) -> None:
    """`sha256  name` lines of files."""
    with open(out, "a" if append else "w", encoding="utf-8") as f:
        for p in paths:
            h = hashlib.sha256()
            with open(p, "rb") as g:
                while block := g.read(1 << 20):
                    h.update(block)
            f.write(f"{h.hexdigest()}  {os.path.basename(p)}\n")
