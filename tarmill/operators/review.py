"""Reviews and queues: decision checks, open forms, confusion of verdicts, progress, set contracts, coded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmill.functions import text


class ContractError(Exception):
    """Two sets that should agree, or one that should hold the other, do not."""


def require_subset(part: DataFrame, whole: DataFrame, key: str) -> None:
    """Raise ContractError with up to three keys of part that whole lacks."""
    lost = part.select(key).distinct().join(whole.select(key).distinct(), key, "left_anti").limit(3).collect()
    if lost:
        raise ContractError(f"not contained: {[r[0] for r in lost]}")


def require_unique(df: DataFrame, *keys: str) -> None:
    """Raise ContractError with up to three repeated keys."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(3).collect()
    if twice:
        raise ContractError(f"repeated: {[tuple(r)[:-1] for r in twice]}")


def require_equal(a: DataFrame, b: DataFrame) -> None:
    """Raise ContractError unless a and b hold the same rows equally often."""
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ContractError("different rows")


def decision_errors(decisions: DataFrame) -> DataFrame:
    """(word, error) of reviewed decisions (word, decision, std, cands) that break their schema.

    keep needs no form, std one well-formed word, merge two that a plus sign joins, ctx at least two different candidates;
    repeated words are an error too. A decision that is none of these is `unknown`.
    """
    d, s = F.col("decision"), F.coalesce("std", F.lit(""))
    n = F.size(F.array_distinct(F.coalesce("cands", F.array().cast("array<string>"))))
    good = s.rlike(text.STANDARD_WORD)
    error = (
        F.when(~F.coalesce(d.isin("keep", "std", "merge", "ctx"), F.lit(False)), "unknown")
        .when((d == "std") & (~good | s.contains("+")), "bad_std").when((d == "merge") & ~(good & s.contains("+")), "bad_merge").when((d == "ctx") & (n < 2), "few_candidates")
    )
    twice = decisions.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word", F.lit("repeated").alias("error"))
    return decisions.select("word", error.alias("error")).where("error is not null").unionByName(twice)


def unmapped(words: DataFrame, *maps: DataFrame) -> DataFrame:
    """(word, n) of the words (one row a use) that none of the maps (word) knows."""
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    for m in maps:
        n = n.join(m.select("word").distinct(), "word", "left_anti")
    return n


def confusion(rows: DataFrame, *flags: str) -> DataFrame:
    """(flags, n): how often each combination of verdicts occurs."""
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def progress(queue: DataFrame, done: DataFrame, group: str) -> DataFrame:
    """(group, queued, done, share) of a work queue (id, group); done: (id). Repeated ids count once."""
    x = queue.select("id", group).distinct().join(done.select("id").distinct().withColumn("__d", F.lit(1)), "id", "left")
    g = x.groupBy(group).agg(F.count(F.lit(1)).alias("queued"), F.count("__d").alias("done"))
    return g.withColumn("share", F.round(F.col("done") / F.col("queued"), 6))


def path_codes(path: Column, genders: dict[str, str], ages: dict[str, str], sources: dict[str, str], prefix: tuple[str, ...] = ("spon", "S")) -> Column:
    """struct(gender, age_group, source) from a path prefix/source letter/code/..., or null if the path has fewer than five
    parts, another prefix or unknown letters. The code's first letter is the gender, its second the age."""
    p = F.split(path, "/")
    look = lambda table, c: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), c)
    k = len(prefix)
    code = F.get(p, k + 1)
    s = F.struct(look(genders, F.substring(code, 1, 1)).alias("gender"), look(ages, F.substring(code, 2, 1)).alias("age_group"), look(sources, F.get(p, k)).alias("source"))
    fits = F.size(p) >= 5
    for i, part in enumerate(prefix):
        fits = fits & (F.get(p, i) == part)
    return F.when(fits & s["gender"].isNotNull() & s["age_group"].isNotNull() & s["source"].isNotNull(), s)
