"""Problem 4: splits that keep all records of one person on one side.

Method: after connected components, the components of a region are combined into many nearly equal bins by repeatedly
joining the extreme weights (largest differencing); whole bins then go to the splits by target proportion.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmill.llm import codes
from tarmill.operators.components import components
from tarmill.operators.splits import shuffled
from tarmill.runtime import cut, running

SPLITS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def persons(links: DataFrame, known: DataFrame) -> DataFrame:
    """(speaker_id, person) for every code of links and known (a speaker_id column); person is the least of its linked codes.

    Codes are compared without blanks around them and in upper case; null and blank codes are left out.
    """
    e = links.select(codes.code(F.col("speaker_id")).alias("u"), codes.code(F.col("same_as")).alias("v"))
    c = cut(components(e), "persons")
    k = known.select(codes.code(F.col("speaker_id")).alias("speaker_id")).where("speaker_id is not null")
    every = k.union(c.select("node")).distinct()
    return every.join(c.withColumnRenamed("node", "speaker_id"), "speaker_id", "left").select("speaker_id", F.coalesce("component", "speaker_id").alias("person"))


def torn(roles: DataFrame, links: DataFrame) -> DataFrame:
    """(speaker_id): every code in roles of a person whom the rows of roles put on two or three sides.

    Unknown and null roles put a code on no side, but such a code is listed if its person is torn by other rows.
    """
    s = roles.select(codes.code(F.col("speaker_id")).alias("speaker_id"), codes.side(F.col("role")).alias("side")).where("speaker_id is not null").distinct()
    p = s.join(persons(links, roles), "speaker_id")
    bad = p.groupBy("person").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a < b").select("person")
    return p.join(bad, "person", "left_semi").select("speaker_id").distinct()


def differenced(weights: list[float], bins: int) -> list[int]:
    """The bin of each weight after largest differencing into `bins` bins of nearly equal sum."""
    if not weights:
        return []
    heap: list[tuple[float, int, list[tuple[float, list[int]]]]] = []
    for i, w in enumerate(weights):
        sums = [(0.0, [])] * (bins - 1) + [(w, [i])]
        heap.append((-w, i, sums))
    heapq.heapify(heap)
    n = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, p + q if len(p) >= len(q) else q + p) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda s: s[0])
        low = joined[0][0]
        joined = [(s - low, m) for s, m in joined]
        n += 1
        heapq.heappush(heap, (-joined[-1][0], n, joined))
    out = [0] * len(weights)
    for k, (_, members) in enumerate(heap[0][2]):
        for i in members:
            out[i] = k
    return out


def evened(placed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """placed (person, region, weight, side) with persons moved from sides above their share of a region to sides below it.

    How much goes where is settled for each region from one sum a side; persons go in the order of a hash as long as they fit,
    by sums over buckets, so no task holds a side.
    """

    def wanted(pdf: pd.DataFrame) -> pd.DataFrame:
        have = dict.fromkeys(shares, 0.0) | dict(zip(pdf["side"], pdf["have"]))
        over = {k: have[k] - shares[k] * sum(have.values()) for k in shares}
        takers = {k: -v for k, v in over.items() if v < 0}
        out = []
        for side, give in over.items():
            low = 0.0
            for to in takers:
                part = min(give - low, takers[to])
                if part > 0:
                    out.append((pdf["region"].iloc[0], side, to, low, low + part))
                    low, takers[to] = low + part, takers[to] - part
        return pd.DataFrame(out, columns=["region", "side", "to", "low", "high"])

    sums = placed.groupBy("region", "side").agg(F.sum("weight").alias("have"))
    moves = cut(sums.groupBy("region").applyInPandas(wanted, "region string, side string, to string, low double, high double"), "moves")  # a few rows a region
    most = moves.groupBy("region", "side").agg(F.max("high").alias("most"))
    light = placed.join(F.broadcast(most), ["region", "side"]).where(F.col("weight") <= F.col("most")).drop("most")
    light = running(light, ["region", "side"], shuffled("person"), ["person"], "weight", "before")
    fits = (F.col("before") >= F.col("low")) & (F.col("before") + F.col("weight") <= F.col("high"))
    to = light.join(F.broadcast(moves), ["region", "side"]).where(fits).select("person", "to")
    return placed.join(to, "person", "left").select("person", "region", "weight", F.coalesce("to", "side").alias("side"))


def assign(speakers: DataFrame, links: DataFrame, weights: DataFrame, splits: dict[str, float] | None = None, bins: int = 40, group: int = 4000) -> DataFrame:
    """(speaker_id, person, region, side) for each speaker of speakers, stratified by region.

    weights: (speaker_id, weight), at most one row a code; codes without a row weigh 1. A person's region is the one
    of most of their weight, the first by name on a tie; unknown regions form a stratum of their own. Persons of a region
    are spread over groups of about `group` by a hash, so no task holds a whole region; each group is differenced into
    bins, and the bins of a region go, heaviest first, to the split that is furthest below its share. What whole bins leave
    uneven, single persons even out.
    """
    shares = splits or SPLITS
    s = speakers.select(codes.code(F.col("speaker_id")).alias("speaker_id"), F.coalesce(codes.region(F.col("region")), F.lit("?")).alias("region")).where("speaker_id is not null")
    s = s.groupBy("speaker_id").agg(F.min(F.when(F.col("region") != "?", F.col("region"))).alias("region"))
    w = weights.select(codes.code(F.col("speaker_id")).alias("speaker_id"), "weight").where("speaker_id is not null").groupBy("speaker_id").agg(F.sum("weight").alias("weight"))
    x = s.join(w, "speaker_id", "left").join(persons(links, speakers), "speaker_id")
    x = cut(x.select("speaker_id", "person", F.coalesce("region", F.lit("?")).alias("region"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")), "weighed")
    by = x.groupBy("person", "region").agg(F.sum("weight").alias("w"))
    p = by.groupBy("person").agg(F.max_by("region", F.struct(F.col("w"), -F.ascii("region"), F.xxhash64("region"))).alias("region"), F.sum("w").alias("weight"))
    size = p.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(F.broadcast(size), "region")  # a row for each region
    p = p.withColumn("g", F.pmod(F.xxhash64("person"), F.ceil(F.col("n") / group).cast("long")))

    def into_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "person"], ascending=[False, True], kind="stable")
        return pdf.assign(bin=differenced(pdf["weight"].tolist(), bins))[["person", "region", "g", "weight", "bin"]]

    binned = cut(p.select("person", "region", "g", "weight").groupBy("region", "g").applyInPandas(into_bins, "person string, region string, g long, weight double, bin int"), "bins")

    def allocate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "g", "bin"], ascending=[False, True, True], kind="stable")
        total, have, sides = pdf["weight"].sum(), dict.fromkeys(shares, 0.0), []
        for weight in pdf["weight"]:
            best = max(shares, key=lambda k: (shares[k] * total - have[k], shares[k]))
            have[best] += weight
            sides.append(best)
        return pdf.assign(side=sides)[["region", "g", "bin", "side"]]

    sides = binned.groupBy("region", "g", "bin").agg(F.sum("weight").alias("weight")).groupBy("region").applyInPandas(allocate, "region string, g long, bin int, side string")
    placed = evened(cut(binned.join(sides, ["region", "g", "bin"]).select("person", "region", "weight", "side"), "placed"), shares)
    placed = placed.select("person", F.col("region").alias("stratum"), "side")
    return x.select("speaker_id", "person").join(placed, "person").select("speaker_id", "person", F.col("stratum").alias("region"), "side")
