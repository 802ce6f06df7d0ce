"""Error rates of hypotheses against two references, pooled, by group and by tag, with cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmill.functions import align, text
from tarmill.operators import batches
from tarmill.runtime import cut

COUNTERS = ["n", "n_std", "e_dial", "e_std", "e_either", "sub", "del", "ins", "chars", "e_char"]


def percent(a: Column, b: Column, places: int = 3) -> Column:
    """100 a / b, rounded; null where b is 0."""
    return F.round(100 * a / F.nullif(b, F.lit(0)), places)


def slots(alignment: Column, dial: Column) -> Column:
    """Alternatives of each aligned word: its dialect and its standard words, a plus sign separating merged ones. Without an
    alignment, or with an empty one, every dialect word is a slot of its own."""
    alignment = F.when(F.size(alignment) > 0, alignment)
    a = text.normalise_each(F.transform(alignment, lambda a: a["dial"]))
    b = text.normalise_each(F.transform(alignment, lambda a: a["std"]))  # a plus sign becomes a space like other signs
    given = F.zip_with(a, b, lambda x, y: F.array(text.words(x), text.words(y)))
    return F.coalesce(given, F.transform(dial, lambda w: F.array(F.array(w), F.array(w))))


def clip_scores(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """One row for each reference: id, spk, the counters, tags array<struct<tag, err>>, missing.

    refs: (id, dial, std, alignment); hyps: (id, hyp), one row an id. A reference without a hypothesis scores as empty and is
    flagged; null texts count as empty. spk is the speaker part of a dialect id, else the id itself.
    """
    # a stated number of partitions: alignment costs far more than the rows' bytes let the optimizer expect
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = refs.repartition(n, "id").join(hyps.select("id", "hyp").repartition(n, "id"), "id", "left")
    x = x.select(
        "id", F.col("hyp").isNull().alias("missing"), "alignment",
        text.normalise(F.col("dial")).alias("d"), text.normalise(F.col("std")).alias("s"), text.normalise(F.col("hyp")).alias("h"),
    )
    x = x.withColumns({k + "w": text.words(F.col(k)) for k in "dsh"})
    x = x.withColumn("slots", slots(F.col("alignment"), F.col("dw")))
    x = x.withColumn("e", align.clip_edits(F.col("dw"), F.col("sw"), F.col("slots"), F.col("hw")))
    tag = F.coalesce(F.transform(F.when(F.size("alignment") > 0, F.col("alignment")), lambda a: a["tag"]), F.transform("dw", lambda w: F.lit("same")))
    return x.select(
        "id", F.when(text.is_dialect_id(F.col("id")), text.speaker_of(F.col("id"))).otherwise(F.col("id")).alias("spk"),
        F.size("dw").cast("long").alias("n"), F.size("sw").cast("long").alias("n_std"), *[F.col(f"e.{c}").alias(c) for c in ("e_dial", "e_std", "e_either", "sub", "del", "ins")],
        F.length("d").cast("long").alias("chars"), align.char_edits(F.col("d"), F.col("h")).alias("e_char"),
        F.transform(F.arrays_zip(tag.alias("tag"), F.col("e.per").alias("err")), lambda z: F.struct(z["tag"].alias("tag"), z["err"].alias("err"))).alias("tags"), "missing",
    )


def totals(scores: DataFrame, *keys: str) -> DataFrame:
    """Sums of all counters and the error rates in percent, for each value of keys (or overall)."""
    g = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("clips"), *[F.sum(c).alias(c) for c in COUNTERS], F.count_if("missing").alias("missing_hyps"))
    return g.select(
        *keys, "clips", F.col("n").alias("words"), F.col("n_std").alias("words_standard"), percent(F.col("e_dial"), F.col("n")).alias("wer_dialect"),
        percent(F.col("e_std"), F.col("n_std")).alias("wer_standard"), percent(F.col("e_either"), F.col("n")).alias("wer_either"),
        percent(F.col("e_char"), F.col("chars")).alias("cer_dialect"), "sub", "del", "ins", "missing_hyps",
    )


def by_speaker(scores: DataFrame) -> DataFrame:
    """(spk, n, e_dial, n_std, e_std, e_either): partial sums that everything by speaker starts from."""
    return scores.groupBy("spk").agg(*[F.sum(c).alias(c) for c in ("n", "e_dial", "n_std", "e_std", "e_either")])


def by_region(speakers: DataFrame) -> DataFrame:
    """(region, wer_dialect) from sums by speaker; the region is the first letter of the speaker code."""
    g = speakers.groupBy(F.substring("spk", 1, 1).alias("region")).agg(F.sum("e_dial").alias("e"), F.sum("n").alias("n"))
    return g.select("region", percent(F.col("e"), F.col("n")).alias("wer_dialect"))


def mean_over_speakers(speakers: DataFrame) -> DataFrame:
    """(wer_mean_over_speakers): speakers without words add nothing to the sum, but count as speakers."""
    share = F.sum(F.when(F.col("n") > 0, 100 * F.col("e_dial") / F.col("n")))
    return speakers.agg(F.round(F.coalesce(share, F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("wer_mean_over_speakers"))


def by_tag(scores: DataFrame) -> DataFrame:
    """(tag, slots, errors, err_pct) of the either-form alignment."""
    x = scores.select(F.explode("tags").alias("t")).groupBy("t.tag").agg(F.count(F.lit(1)).alias("slots"), F.sum("t.err").alias("errors"))
    return x.withColumn("err_pct", percent(F.col("errors"), F.col("slots")))


def resample(clusters: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """(rep, key, times): how often each cluster is drawn in each resample of as many draws as there are clusters.

    Draws 2 k and 2 k + 1 of a resample take the clusters whose numbers, in the order of key, are the halves of a hash of (seed,
    rep, k) modulo their count, so any system that has the hash draws the same. Clusters are numbered without a window over
    all of them, and the hashes are one range over all tasks.
    """
    numbered = cut(batches.numbered(clusters.select(key), [key]), "clusters")
    n = numbered.count()
    half = max((n + 1) // 2, 1)
    rep, k = F.floor(F.col("id") / half), F.col("id") % half
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), rep.cast("string"), k.cast("string")))
    draws = clusters.sparkSession.range(reps * half if n else 0).select(rep.alias("rep"), k.alias("k"), digest.alias("h"))
    draws = draws.select("rep", F.explode(F.array(F.substring("h", 1, 15), F.when(2 * F.col("k") + 1 < n, F.substring("h", 17, 15)))).alias("h")).where("h is not null")
    h = F.conv("h", 16, 10).cast("long")
    counted = draws.select("rep", (h % max(n, 1)).alias("at")).groupBy("rep", "at").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(numbered, "at").select("rep", key, "times")


def bootstrap(speakers: DataFrame, error: str = "e_either", words: str = "n", other: DataFrame | None = None, reps: int = 1000, seed: int = 2026) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percent points of the error rate, or of its difference to that of other, over resamples of
    whole speakers. Speakers are summed before they are resampled, so the work is reps x speakers, not clips."""
    a = speakers.select("spk", F.col(error).alias("e"), F.col(words).alias("w"))
    if other is None:
        a = a.withColumns({"e2": F.lit(None).cast("long"), "w2": F.lit(None).cast("long")})
    else:
        a = a.join(other.select("spk", F.col(error).alias("e2"), F.col(words).alias("w2")), "spk")
    a = cut(a, "speakers")
    r = resample(a, "spk", reps, seed).join(a, "spk").groupBy("rep").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("e", "w", "e2", "w2")])
    rate = 100 * F.col("e") / F.nullif(F.col("w"), F.lit(0))
    if other is not None:
        rate = rate - 100 * F.col("e2") / F.nullif(F.col("w2"), F.lit(0))
    v = r.select(rate.alias("v")).agg(F.sort_array(F.collect_list("v")).alias("v"))  # reps numbers
    at = lambda q: F.round(F.element_at("v", F.least(F.size("v"), F.floor(F.lit(q) * F.size("v")).cast("int") + 1)), 3)
    return v.where(F.size("v") > 0).select(at(0.025).alias("low"), at(0.975).alias("high"))
