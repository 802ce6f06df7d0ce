"""Joins with a contract: strict, defaulted, guarding, prioritised, positional, reconciling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmill.functions import text


class LeakageError(Exception):
    """Held-out records or speakers among training records."""


class MissingKeyError(Exception):
    """Keys that a strict join didn't find."""


def strict(left: DataFrame, right: DataFrame, on: str, examples: int = 3) -> DataFrame:
    """Inner join in which every left key must be found; raises MissingKeyError with a few examples otherwise."""
    lost = left.select(on).join(right.select(on), on, "left_anti").limit(examples).collect()
    if lost:
        raise MissingKeyError(f"no row for {[r[0] for r in lost]}")
    return left.join(right, on)


def coverage(lists: DataFrame, records: DataFrame, key: str, group: str) -> DataFrame:
    """(group, listed, found, missing) of the keys of each list. records may repeat keys; null keys are never found."""
    known = records.select(key).distinct().withColumn("__hit", F.lit(1))
    x = lists.select(group, key).distinct().join(known, key, "left")
    return x.groupBy(group).agg(F.count(F.lit(1)).alias("listed"), F.count("__hit").alias("found"), F.count_if(F.col("__hit").isNull()).alias("missing"))


def leaks(train: DataFrame, held: DataFrame, held_speakers: DataFrame) -> DataFrame:
    """(id, why) of training ids that are held out, or whose speaker is: `id`, `speaker`, or both rows.

    train, held: (id); held_speakers: (speaker_id). Two semi-joins, never one on either condition, so both are equi-joins.
    """
    t = train.select("id").distinct().withColumn("speaker_id", text.speaker_of(F.col("id")))
    a = t.join(held.select("id").distinct(), "id", "left_semi").select("id", F.lit("id").alias("why"))
    b = t.where(text.is_dialect_id(F.col("id"))).join(held_speakers.select("speaker_id").distinct(), "speaker_id", "left_semi").select("id", F.lit("speaker").alias("why"))
    return a.unionByName(b)


def guard(train: DataFrame, held: DataFrame, held_speakers: DataFrame) -> int:
    """Number of different training ids, or LeakageError with up to three ids and ten speakers."""
    bad = leaks(train, held, held_speakers)
    n = {r["why"]: r["n"] for r in bad.groupBy("why").agg(F.count(F.lit(1)).alias("n")).collect()}
    if n:
        ids = [r[0] for r in bad.where("why = 'id'").select("id").limit(3).collect()]
        speakers = sorted(r[0] for r in bad.where("why = 'speaker'").select(text.speaker_of(F.col("id"))).distinct().limit(10).collect())
        raise LeakageError(f"{n.get('id', 0)} held-out records (e.g. {ids}), held-out speakers {speakers}")
    return train.select("id").distinct().count()


def exclude_repeats(rows: DataFrame, side: str, media: str, words: str, least: int = 6) -> DataFrame:
    """rows with a new column placed: a train row becomes `excluded` if its media hash, or its text of at least `least` words,
    occurs on another side; other rows keep their side.

    Each condition is a join of its own on one key, so repeats of a hot text are no more than a flag.
    """
    held = rows.where(F.col(side) != "train")
    long = F.when(F.size(text.tokens(F.col(words))) >= least, F.array_join(text.tokens(F.col(words)), " "))
    a = held.select(F.col(media).alias("__m")).where("__m is not null").distinct().withColumn("__a", F.lit(True))
    b = held.select(long.alias("__w")).where("__w is not null").distinct().withColumn("__b", F.lit(True))
    x = rows.withColumns({"__m": F.col(media), "__w": long}).join(a, "__m", "left").join(b, "__w", "left")
    hit = (F.col(side) == "train") & (F.coalesce("__a", F.lit(False)) | F.coalesce("__b", F.lit(False)))
    return x.withColumn("placed", F.when(hit, "excluded").otherwise(F.col(side))).drop("__m", "__w", "__a", "__b")


def lookup_chain(words: DataFrame, reviewed: DataFrame, learned: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word) with std and src by the first source that knows the word.

    reviewed: (word, decision, std, cands); learned: (word, decision, std); lexicon: (word, read). Sources: R reviewed, r
    reviewed but open, M learned, C learned but depending on context, N a nasal spelling five times as frequent, S known as
    it stands, U unknown. Each source has one row a word, so every join is an equi-join that AQE may broadcast.
    """
    w = F.col("word")
    last = F.right(w, F.lit(1))
    nasal = F.when(last.isin(*text.ORAL[:3], "u"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.translate(last, "aeiu", "ąęįų")))
    x = words.join(reviewed.select("word", F.col("decision").alias("rd"), F.col("std").alias("rs"), F.col("cands").alias("rc")), "word", "left")
    x = x.join(learned.select("word", F.col("decision").alias("ld"), F.col("std").alias("ls")), "word", "left")
    x = x.withColumn("__n", nasal).join(lexicon.select("word", F.col("read").alias("wr")), "word", "left")
    x = x.join(lexicon.select(F.col("word").alias("__n"), F.col("read").alias("nr")), "__n", "left")
    read, nread = F.coalesce("wr", F.lit(0)), F.coalesce("nr", F.lit(0))
    better = (read >= 3) & (nread >= 5 * F.greatest(F.lit(1), read))
    std = (
        F.when(F.col("rd").isin("std", "merge"), F.col("rs")).when(F.col("rd") == "ctx", F.coalesce(F.try_element_at("rc", F.lit(1)), w)).when(F.col("rd").isNotNull(), w)
        .when(F.col("ld").isNotNull(), F.col("ls")).when(better, F.col("__n")).otherwise(w)
    )
    src = (
        F.when(F.col("rd") == "ctx", "r").when(F.col("rd").isNotNull(), "R").when(F.col("ld") == "ctx", "C").when(F.col("ld").isNotNull(), "M")
        .when(better, "N").when(read >= 3, "S").otherwise("U")
    )
    return x.select(*words.columns, std.alias("std"), src.alias("src"))


def positional(rows: DataFrame, key: list[str], left: str, right: str, names: tuple[str, str] = ("dial", "std")) -> DataFrame:
    """(key, pos, left word, right word) of two texts word by word, as far as the shorter goes. Null texts give no rows."""
    a, b = text.tokens(F.col(left)), text.tokens(F.col(right))
    n = F.least(F.size(a), F.size(b))
    z = F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))
    x = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*key, F.posexplode(z).alias("pos", "z"))
    return x.select(*key, "pos", F.col("z.a").alias(names[0]), F.col("z.b").alias(names[1]))


def disordered(given: DataFrame, got: DataFrame, key: str, given_order: list[str], got_order: list[str]) -> DataFrame:
    """(key, given_at, got_at) of keys that are once on both sides and stand at different places, from 0, of what both share."""
    from tarmill.operators.batches import numbered

    single = lambda x: x.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(key)
    both = single(given).join(single(got), key)
    a = numbered(given.join(both, key).select(key, *[c for c in given_order if c != key]), given_order, "given_at").select(key, "given_at")
    b = numbered(got.join(both, key).select(key, *[c for c in got_order if c != key]), got_order, "got_at").select(key, "got_at")
    return a.join(b, key).where("given_at <> got_at").select(key, "given_at", "got_at")


def reconcile(given: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, status) of every key that is not once on both sides: missing, extra, or duplicate (more often among got than
    given). A null key is compared like any other."""
    a = given.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = got.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("b"))
    x = a.join(b, F.col(key).eqNullSafe(F.col("__k")), "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("b") > F.col("a"), "duplicate")
    return x.select(F.coalesce(F.col(key), F.col("__k")).alias(key), status.alias("status")).where("status is not null")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two standardisations of the same records, (id, dial, std) each with one row an id, compared word by word.

    One row: records, words, agree, exact (records that agree in every word), changed (words that either side changed) and
    changed_agree. Only records on both sides with equally many words count.
    """
    x = a.select("id", text.tokens(F.col("dial")).alias("d"), text.tokens(F.col("std")).alias("s")).join(b.select("id", text.tokens(F.col("std")).alias("t")), "id")
    x = x.where((F.size("s") == F.size("t")) & (F.size("s") == F.size("d")))
    same = F.zip_with("s", "t", lambda p, q: p == q)
    x = x.withColumns({"same": same, "changed": F.zip_with("d", F.zip_with("s", "t", lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda w, z: (w != z["p"]) | (w != z["q"]))})
    ones = lambda c: F.size(F.filter(c, lambda v: v))
    return x.agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("s")).alias("words"), F.sum(ones("same")).alias("agree"),
        F.count_if(F.forall("same", lambda v: v)).alias("exact"), F.sum(ones("changed")).alias("changed"),
        F.sum(ones(F.zip_with("changed", "same", lambda c, v: c & v))).alias("changed_agree"),
    )
