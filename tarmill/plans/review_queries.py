"""Queries over reviews and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.functions import text
from tarmill.operators import lexicon, review
from tarmill.plans.registry import query
from tarmill.plans.text_queries import LEXICON_SQL, MAPS_SQL, WORDS_SQL, _maps, clip_lexicon, word_pairs
from tarmill.runtime import table


@query(f"with {MAPS_SQL} select dial as word, count(*) as n from {WORDS_SQL} where dial not in (select word from rv) and dial not in (select word from lv) and dial not in (select word from {LEXICON_SQL} where read >= 3) group by 1")
def unmapped_forms(spark: SparkSession, d: str) -> DataFrame:
    """Dialect words that no map and no lexicon knows."""
    reviewed, learned = _maps(spark, d)
    return review.unmapped(word_pairs(spark, d).select(F.col("dial").alias("word")), reviewed, learned, clip_lexicon(spark, d).where("read >= 3"))


@query(rf"""
with {MAPS_SQL}, x as (select word, case when len(c) > 1 then 'ctx' when c[1] = word then 'keep' when contains(c[1], '+') then 'merge' else 'std' end as decision, case when len(c) = 1 then c[1] else '' end as std, len(c) as n from rv),
  e as (select word, case when decision = 'std' and (not regexp_matches(std, '{text.STANDARD_WORD}') or contains(std, '+')) then 'bad_std' when decision = 'merge' and not regexp_matches(std, '{text.STANDARD_WORD}') then 'bad_merge' end as error from x)
select * from e where error is not null""")
def decision_errors(spark: SparkSession, d: str) -> DataFrame:
    """Gold decisions that break the decision schema."""
    v = lexicon.variants(word_pairs(spark, d).where("tier = 'gold'")).withColumnRenamed("form", "word")
    return review.decision_errors(v.withColumn("decision", F.when((F.col("decision") == "std") & F.col("std").contains("+"), "merge").otherwise(F.col("decision"))))


@query(f"""
with {MAPS_SQL}, w as (select distinct id, pos, dial, std from {WORDS_SQL} where tier = 'silver')
select dial <> coalesce(ls.std, dial) as changed, coalesce(ls.std, dial) = w.std as correct, count(*) as n from w left join lv ls on ls.word = dial group by 1, 2""")
def verdict_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Learned forms on silver words: changed or not, right or not."""
    _, learned = _maps(spark, d)
    w = word_pairs(spark, d).where("tier = 'silver'").select("id", "pos", "dial", "std").distinct()
    x = w.join(learned.select(F.col("word").alias("dial"), F.col("std").alias("new")), "dial", "left").withColumn("new", F.coalesce("new", "dial"))
    return review.confusion(x.select((F.col("dial") != F.col("new")).alias("changed"), (F.col("new") == F.col("std")).alias("correct")), "changed", "correct")


@query("""with q as (select distinct id, spk from std_queue), l as (select distinct id from layers where std is not null)
select spk, count(*) as queued, count(l.id) as done, round(count(l.id) / count(*), 6) as share from q left join l using (id) group by spk""")
def queue_progress(spark: SparkSession, d: str) -> DataFrame:
    """How much of each speaker's queue has a standard text."""
    return review.progress(table(spark, d, "std_queue"), table(spark, d, "layers").where("std is not null"), "spk")
