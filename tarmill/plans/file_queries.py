"""Queries over files that sinks write and readers read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.plans import split_queries, text_queries
from tarmill.plans.registry import query
from tarmill.plans.score_sql import REFERENCES
from tarmill.runtime import fresh, table
from tarmill.sources import readers, sinks


@query("select distinct speaker_id, region, gender, age_group, clips, minutes, sessions from dial_speakers")
def csv_file(spark: SparkSession, d: str) -> DataFrame:
    """Speakers written to a CSV file and read by its schema: blanks, nulls and signs as they were."""
    x, at = table(spark, d, "dial_speakers").distinct(), fresh(spark, "csv")
    sinks.csv(x, at)
    return readers.csv(spark, at, "speaker_id string, region string, gender string, age_group string, clips int, minutes double, sessions int")


@query("select distinct speaker_id, nullif(region, '') as region, nullif(role, '') as role, minutes from speakers")
def tsv_file(spark: SparkSession, d: str) -> DataFrame:
    """Speakers written with tabs and read back."""
    x, at = table(spark, d, "speakers").select("speaker_id", "region", "role", "minutes").distinct(), fresh(spark, "tsv")
    sinks.tsv(x, at)
    return readers.tsv(spark, at, "speaker_id string, region string, role string, minutes double")


@query(f"""with {REFERENCES}
select id, coalesce(dial, '') as dial, case when dial is null then '' else std end as std, len(alignment) as words, list_reduce(list_prepend('', list_transform(alignment, lambda z: z.tag)), lambda a, b: a || ' ' || b) as tags from refs""")
def layer_file(spark: SparkSession, d: str) -> DataFrame:
    """References written as JSON lines and read as a layer."""
    x, at = text_queries.references(spark, d), fresh(spark, "layer")
    a = F.transform("alignment", lambda z: F.array(z["dial"], z["std"], z["tag"], z["src"]))
    sinks.jsonl(x.select("id", "dial", "std", a.alias("alignment")), at)
    y = readers.layer(spark, at)
    return y.select("id", "dial", "std", F.size("alignment").cast("long").alias("words"), F.array_join(F.concat(F.array(F.lit("")), F.transform("alignment", lambda z: z["tag"])), " ").alias("tags"))


@query(f"""select id, dataset_id, text_normalized from {split_queries.CLIPS_SQL} where id not in (select id from {split_queries.IDS_SQL} where split_id = 'dial.excluded.v1' and id is not null)""")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """Clips written as JSON lines in a folder for each dataset, and read by a pattern without the excluded ids."""
    x, at = split_queries.clips(spark, d).select("id", "dataset_id", "text_normalized"), fresh(spark, "corpus")
    x.withColumn("of", F.col("dataset_id")).write.partitionBy("of").json(at)
    drop = split_queries.lists(spark, d).where("split_id = 'dial.excluded.v1'")
    return readers.corpus(spark, f"{at}/of=*/*.json", "id string, dataset_id string, text_normalized string", drop).drop("place")


@query(f"""select id, max(rank) as last from (select id, case tier when 'silver' then 0 when 'perclip' then 1 else 2 end as rank from layers where id is not null) group by id""")
def last_line(spark: SparkSession, d: str) -> DataFrame:
    """Layers written to a file for each tier, of uneven size, and read by id: the last file by name wins."""
    at = fresh(spark, "tiers")
    rank = F.when(F.col("tier") == "silver", 0).when(F.col("tier") == "perclip", 1).otherwise(2)
    x = table(spark, d, "layers").where("id is not null").select("id", rank.alias("last"), rank.alias("of"))
    x.write.partitionBy("of").json(at)
    return readers.jsonl(spark, f"{at}/of=*", "id string, last int", "id")
