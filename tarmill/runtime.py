"""Session, table access, lineage cuts and order-exact ranking without oversized groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: list[str] = []


def session(app: str = "tarmill", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tarmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: later stages never recompute what came before, even if executors are lost."""
    at = fresh(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ranked(df: DataFrame, keys: list[str], order: Column, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """row_number over keys in the order of a hash, with no task that holds a whole group.

    order must be a 64-bit integer column that is close to uniform, such as xxhash64. Rows of a key are cut into buckets by
    the high bits of order; only the counts by (key, bucket) meet in one window, so a key holding most rows is spread over
    the buckets; there are four for each shuffle partition, so the rows of one fall as a job is given more partitions. Rows of equal order within a key are numbered in no fixed order; make order unique where that matters.
    """
    o, b = f"__o_{name}", f"__b_{name}"
    buckets = buckets or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = (1 << 63) // buckets * 2
    x = df.withColumn(o, order).withColumn(b, F.floor(F.col(o) / F.lit(float(width))).cast("int"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n")).select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = x.alias("x").join(base.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col(f"x.{b}") == F.col(f"y.{b}")])
    inner = Window.partitionBy(*[f"x.{k}" for k in keys], f"x.{b}").orderBy(f"x.{o}")
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.row_number().over(inner) + F.col("__base")).alias(name))


def running(df: DataFrame, keys: list[str], order: Column, ties: list[str], amount: str, name: str) -> DataFrame:
    """df with the sum of amount over the rows before each in its key, in the order of a hash below 2^60 and of ties, with no
    task that holds a whole key: sums by (key, bucket of the hash) meet in one window, and rows are ordered within a bucket."""
    buckets = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = df.withColumn("__o", order).withColumn("__b", F.floor(F.col("__o") / F.lit(float((1 << 60) // buckets))).cast("int"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*keys, "__b").agg(F.sum(amount).alias("__n")).select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = x.alias("x").join(base.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "__b"]])
    inner = Window.partitionBy(*[f"x.{k}" for k in [*keys, "__b"]]).orderBy("x.__o", *[f"x.{t}" for t in ties]).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.coalesce(F.sum(f"x.{amount}").over(inner), F.lit(0)) + F.col("__base")).alias(name))
