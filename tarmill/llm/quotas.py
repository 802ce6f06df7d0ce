"""Problem 2: a sample with given shares of each category.

Method: hierarchical top-down allocation. The categories form a tree (plan, gender, age group). Quotas are set at the leaves;
what a leaf can't supply is passed to its siblings (same gender), then to its cousins (the other gender) of the same plan.
Leaves are drawn by a permuted dense rank: speakers in the order of a hash that is seeded by plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmill.llm import codes
from tarmill.operators.splits import shuffled
from tarmill.runtime import ranked

LEAF = ["gender", "age_group"]


def population(speakers: DataFrame) -> DataFrame:
    """(speaker_id, gender, age_group) once for each speaker with both known, in clean spelling.

    A speaker's several rows count as one; a value that one row lacks is taken from another.
    """
    x = speakers.select(codes.code(F.col("speaker_id")).alias("speaker_id"), codes.gender(F.col("gender")).alias("gender"), codes.age_group(F.col("age_group")).alias("age_group"))
    one = x.where("speaker_id is not null").groupBy("speaker_id").agg(F.max("gender").alias("gender"), F.max("age_group").alias("age_group"))
    return one.where("gender is not null and age_group is not null")


def _exact(c: Column) -> Column:
    """A share as a decimal: 0.29 x 100 is 29, not a hair less."""
    return c.cast("decimal(18,8)")


def allocation(targets: DataFrame, speakers: DataFrame) -> DataFrame:
    """One row for each target: plan_id, gender, age_group, sample_size, quota, available, own, to_siblings, to_cousins, taken, short.

    quota is the larger of min_count and target_share x sample size, rounded up; own is what the leaf itself supplies, taken
    what it supplies in all, having stood in for others. short is true where available < quota. Targets with a null plan or
    category are left out; a repeated target counts once. An empty population makes every positive quota short.
    """
    pop = population(speakers)
    have = pop.groupBy(*LEAF).agg(F.count(F.lit(1)).alias("available"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n"))
    t = targets.select("plan_id", *LEAF, "sample_fraction", "target_share", "min_count").dropna(subset=["plan_id", *LEAF]).distinct()
    t = t.crossJoin(F.broadcast(total))  # one row
    size = F.floor(_exact(F.coalesce("sample_fraction", F.lit(0.0))) * F.col("n").cast("decimal(18,0)"))
    t = t.withColumn("sample_size", size.cast("long"))
    share = F.ceil(_exact(F.coalesce("target_share", F.lit(0.0))) * F.col("sample_size").cast("decimal(18,0)")).cast("long")
    t = t.withColumn("quota", F.greatest(F.coalesce(F.col("min_count"), F.lit(0)).cast("long"), share))
    t = t.join(have, LEAF, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    t = t.withColumn("own", F.least("quota", "available")).withColumn("left", F.col("available") - F.col("own"))
    unmet = F.col("quota") - F.col("own")

    def pass_on(x: DataFrame, keys: list[str], owed: Column, out: str) -> DataFrame:
        """Leaves with members left take the owed rows of their branch, those with most left first."""
        branch = Window.partitionBy(*keys)
        order = branch.orderBy(F.desc("left"), *LEAF).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("__owed", F.sum(owed).over(branch)).withColumn("__before", F.coalesce(F.sum("left").over(order), F.lit(0)))
        x = x.withColumn(out, F.greatest(F.lit(0), F.least(F.col("left"), F.col("__owed") - F.col("__before"))))
        x = x.withColumn("__still", F.col("__owed") - F.sum(out).over(branch))
        return x.withColumn("left", F.col("left") - F.col(out))

    t = pass_on(t, ["plan_id", "gender"], unmet, "to_siblings")
    first = F.row_number().over(Window.partitionBy("plan_id", "gender").orderBy("age_group")) == 1
    t = t.withColumn("__up", F.when(first, F.col("__still")).otherwise(0))
    t = pass_on(t, ["plan_id"], F.col("__up"), "to_cousins")
    return t.select(
        "plan_id", *LEAF, "sample_size", "quota", "available", "own", "to_siblings", "to_cousins",
        (F.col("own") + F.col("to_siblings") + F.col("to_cousins")).alias("taken"),
        (F.col("available") < F.col("quota")).alias("short"),
    )


def draw(targets: DataFrame, speakers: DataFrame, seed: int = 2026) -> DataFrame:
    """(plan_id, speaker_id, gender, age_group): the speakers drawn for each plan, the same at every run.

    The rank within a leaf is computed in buckets of the hash, so no task holds a whole leaf.
    """
    plan = allocation(targets, speakers).where("taken > 0").select("plan_id", *LEAF, "taken")
    x = population(speakers).join(F.broadcast(plan), LEAF)  # a row for each target: bounded by the plans
    order = (shuffled("plan_id", "speaker_id", seed=seed) - (1 << 59)) * 16  # all 64 bits are used
    r = ranked(x, ["plan_id", *LEAF], order)
    return r.where("rank <= taken").select("plan_id", "speaker_id", *LEAF)
