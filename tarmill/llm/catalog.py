"""The pN_ queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.llm import encoding, forms, leaks, levels, overlap, packing, quotas, together
from tarmill.llm.sql import SQL
from tarmill.runtime import table

LAYER_FIELDS = ["dial", "std"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.inconsistent(table(spark, d, "layers").select("id", *LAYER_FIELDS), "id", LAYER_FIELDS)


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every layer row with both texts in the consistent form."""
    x = table(spark, d, "layers").select("id", "split", "tier", *LAYER_FIELDS)
    return forms.to_consistent(forms.to_consistent(x, "dial", "dial"), "std", "std")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Words of the layers that look alike, grouped by skeleton."""
    return forms.word_groups(table(spark, d, "layers"), "id", LAYER_FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quotas.allocation(table(spark, d, "sample_targets"), table(spark, d, "dial_speakers")).where("short").select("plan_id", "gender", "age_group")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Quota, supply and allocation of every target."""
    return quotas.allocation(table(spark, d, "sample_targets"), table(spark, d, "dial_speakers"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The speakers drawn for every plan."""
    return quotas.draw(table(spark, d, "sample_targets"), table(spark, d, "dial_speakers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_records(p3_chunks(spark, d))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk of every record or part of one."""
    return packing.pack(table(spark, d, "std_queue"), table(spark, d, "chunk_limits"))[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks of each list, and the least possible."""
    return packing.pack(table(spark, d, "std_queue"), table(spark, d, "chunk_limits"))[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return together.torn(table(spark, d, "speakers"), table(spark, d, "speaker_links"))


def p4_sides(spark: SparkSession, d: str) -> DataFrame:
    """New sides of all speakers; the weight of a speaker is their number of different clips."""
    w = table(spark, d, "clips").select("speaker_id", "id").where("speaker_id is not null").distinct().groupBy("speaker_id").agg(F.count(F.lit(1)).alias("weight"))
    return together.assign(table(spark, d, "dial_speakers"), table(spark, d, "speaker_links"), w)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "clips"), table(spark, d, "split_ids"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping clips of each evaluation list and dataset."""
    return overlap.report(table(spark, d, "clips"), table(spark, d, "split_ids"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, decoded from its ids."""
    return encoding.decode(p6_ids(spark, d), "doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source hold passages of each evaluation split's items, and how many items those are."""
    at = table(spark, d, "documents").select("doc_id", "source")
    of = table(spark, d, "eval_items").select("item_id", "split_id")
    x = p7_found(spark, d).join(F.broadcast(of), "item_id").join(at, "doc_id")
    return x.groupBy("split_id", "source").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level and score of every document."""
    return levels.graded(table(spark, d, "documents"), table(spark, d, "doc_levels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
