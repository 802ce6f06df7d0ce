"""Split building: held-out picks, contiguous blocks, dose order, quotas, back-fill, length bins, cluster draws.

Random choices are orders of a seeded hash, so they are the same at every run and on every partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmill.runtime import cut, running

# Borders of the length bins, in seconds.
EDGES = [0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30.001]


def shuffled(*keys: str | Column, seed: int = 2026) -> Column:
    """A seeded random order: the first 15 hexadecimal digits of a hash, the same in any system that has MD5."""
    parts = [k if isinstance(k, Column) else F.col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def clean_clips(clips: DataFrame) -> DataFrame:
    """One row a clip id, the last loaded, with duration null where it was unreadable."""
    one = clips.groupBy("id").agg(F.max_by(F.struct("dataset_id", "speaker_id", "region", "gender", "age_group", "duration", "text_normalized", "recorded_at"), "loaded_at").alias("c"))
    return one.select("id", "c.*").withColumn("duration", F.when(F.col("duration") >= 0, F.col("duration")))


def speaker_facts(clips: DataFrame) -> DataFrame:
    """(speaker_id, region, gender, age_group, clips, sec) of speakers with clips; of differing facts the least is taken."""
    x = clips.where("speaker_id is not null").groupBy("speaker_id")
    return x.agg(*[F.min(c).alias(c) for c in ("region", "gender", "age_group")], F.count(F.lit(1)).alias("clips"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("sec"))


def held_out_pick(speakers: DataFrame, n: int, least_sec: float, seed: int = 2026) -> DataFrame:
    """(speaker_id, region) of n speakers a region of at least least_sec: first one of each gender and of the two adult age
    groups, as far as n goes and the region has them, then whoever comes next in the seeded order.

    Ranks are windows over the speakers of a region; a speaker row is a few numbers.
    """
    x = speakers.where(F.col("sec") >= least_sec).withColumn("__o", shuffled("speaker_id", seed=seed))
    by = Window.partitionBy("region").orderBy("__o", "speaker_id")
    first = lambda cond: F.when(cond, F.row_number().over(Window.partitionBy("region", cond).orderBy("__o", "speaker_id")))
    needs = [F.col("gender") == "male", F.col("gender") == "female", F.col("age_group") == "18-60", F.col("age_group") == "60+"]
    x = x.withColumns({f"__n{k}": first(c) for k, c in enumerate(needs)})
    rank = F.coalesce(*[F.when(F.col(f"__n{k}") == 1, F.lit(k)) for k in range(2)])
    # a speaker that meets a gender need may meet an age need too; a later need counts only if no earlier pick meets it
    x = x.withColumn("__g", rank)
    met = {k: F.max((F.col("__g").isNotNull() & needs[k]).cast("int")).over(Window.partitionBy("region")) for k in (2, 3)}
    x = x.withColumns({f"__met{k}": v for k, v in met.items()})
    late = F.coalesce(*[F.when((F.col(f"__n{k}") == 1) & (F.coalesce(F.col(f"__met{k}"), F.lit(0)) == 0), F.lit(k)) for k in (2, 3)])
    x = x.withColumn("__pri", F.coalesce("__g", late, F.lit(9))).withColumn("__at", F.row_number().over(Window.partitionBy("region").orderBy("__pri", "__o", "speaker_id")))
    return x.where(F.col("__at") <= n).select("speaker_id", "region")


def contiguous_block(clips: DataFrame, seconds: float, seed: int = 2026) -> DataFrame:
    """The clips (id, speaker_id, duration) of one unbroken run of each speaker, from a random start that leaves enough, until
    it lasts `seconds`; all clips of a speaker with no more than that. The crossing clip is included; null durations are 0."""
    d = F.coalesce("duration", F.lit(0.0))
    w = Window.partitionBy("speaker_id").orderBy("id")
    x = clips.withColumns({"__d": d, "__cum": F.sum(d).over(w) - d, "__total": F.sum(d).over(Window.partitionBy("speaker_id"))})
    starts = x.where(F.col("__total") - F.col("__cum") >= seconds)
    pick = starts.groupBy("speaker_id").agg(F.min_by("__cum", F.struct(shuffled("id", seed=seed), "id")).alias("__start"))
    y = x.join(pick, "speaker_id", "left")
    inside = (F.col("__cum") - F.col("__start") >= 0) & (F.col("__cum") - F.col("__start") < seconds)
    return y.where((F.col("__total") <= seconds) | inside).select(*clips.columns)


def dose_order(speakers: DataFrame, hours: str = "hours", seed: int = 2026) -> DataFrame:
    """(speaker_id, region, round, place, cum_hours): speakers in turns, one a region, each region in its seeded order, with
    running hours. One row a speaker meets in the final window."""
    r = F.row_number().over(Window.partitionBy("region").orderBy(shuffled("speaker_id", seed=seed), "speaker_id"))
    order = Window.orderBy("round", "region")
    x = speakers.withColumn("round", r)
    return x.select("speaker_id", "region", "round", F.row_number().over(order).alias("place"), F.round(F.sum(hours).over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cum_hours"))


def dose_prefix(order: DataFrame, doses: list[float]) -> DataFrame:
    """(dose, speakers, hours): the shortest prefix of the order that reaches each dose; doses beyond the total have no row."""
    hit = order.withColumn("dose", F.explode(F.array(*[F.lit(float(x)) for x in doses]))).where(F.col("cum_hours") >= F.col("dose"))
    return hit.groupBy("dose").agg(F.min("place").alias("speakers"), F.min_by("cum_hours", "place").alias("hours"))


def quota_fill(candidates: DataFrame, targets: DataFrame, cell: list[str], amount: str, seed: int = 2026) -> DataFrame:
    """candidates taken in random order while their cell's quota isn't reached; the row that crosses it is taken too.

    candidates: (id, cell columns, amount); targets: (cell columns, target). Running sums go over buckets of a cell, so cells
    may be few and large.
    """
    x = candidates.join(F.broadcast(targets.select(*cell, "target")), cell)  # a row for each cell
    x = running(x, cell, shuffled("id", seed=seed), ["id"], amount, "__before")
    return x.where(F.col("__before") < F.col("target")).select(*candidates.columns)


def shortfall(targets: DataFrame, taken: DataFrame, cell: list[str], amount: str) -> DataFrame:
    """(cell, missing) of the cells whose quota was not reached."""
    got = taken.groupBy(*cell).agg(F.sum(amount).alias("__got"))
    x = targets.join(got, cell, "left").withColumn("missing", F.col("target") - F.coalesce("__got", F.lit(0.0)))
    return x.where("missing > 0").select(*cell, F.round("missing", 3).alias("missing"))


def back_fill(spares: DataFrame, missing: DataFrame, group: list[str], bin_: str, amount: str, seed: int = 2026) -> DataFrame:
    """Spares that fill short bins, bin by bin, nearest bin first; a spare is used once.

    One group (a category) is one task: what a bin takes depends on the bins before it. Only as many spares of each bin as
    could ever be used are sent: those within the group's whole shortfall, in seeded order.
    """
    missing = cut(missing, "missing")
    need = missing.groupBy(*group).agg(F.sum("missing").alias("__need"))
    w = Window.partitionBy(*group, bin_).orderBy(shuffled("id", seed=seed), "id").rowsBetween(Window.unboundedPreceding, -1)
    x = spares.join(F.broadcast(need), group).withColumn("__b", F.coalesce(F.sum(amount).over(w), F.lit(0.0))).where(F.col("__b") < F.col("__need"))
    x = x.select("id", *group, bin_, amount, shuffled("id", seed=seed).alias("__o"))

    def fill(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pool = a.sort_values(["__o", "id"], kind="stable")
        out = []
        for want in b.sort_values(bin_).itertuples():
            left = want.missing
            near = (pool[bin_] - getattr(want, bin_)).abs().sort_values(kind="stable").index
            used = []
            for i in near:
                if left <= 0:
                    break
                used.append(i)
                left -= pool.at[i, amount]
            out += [(pool.at[i, "id"], getattr(want, bin_)) for i in used]
            pool = pool.drop(index=used)
        return pd.DataFrame(out, columns=["id", "for_bin"])

    x = cut(x, "spares")
    return x.groupBy(*group).cogroup(missing.groupBy(*group)).applyInPandas(fill, f"id {dict(spares.dtypes)['id']}, for_bin int")


def cluster_draw(rows: DataFrame, cluster: str, share: float, cap: int | None = None, cap_share: float | None = None, seed: int = 2026) -> DataFrame:
    """(cluster, size) of clusters drawn in seeded order until their rows reach the share of all. Clusters of more than cap rows,
    or of more than cap_share of all rows, are passed over; only the latter means the same at every size of the table. The
    window holds a row for each cluster."""
    size = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = F.broadcast(size.agg(F.sum("size").alias("__all")))  # one row
    x = (size.where(F.col("size") <= cap) if cap is not None else size).crossJoin(total)
    x = x.where(F.col("size") <= cap_share * F.col("__all")) if cap_share is not None else x
    w = Window.orderBy(shuffled(cluster, seed=seed), cluster).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("__b", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("__b") < share * F.col("__all")).select(cluster, "size")
