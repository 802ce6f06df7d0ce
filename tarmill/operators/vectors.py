"""Nearest neighbours, clusters of embeddings, purity and leakage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmill.runtime import cut, ranked

#: Bytes of vectors that one broadcast block of the query side may hold.
BLOCK_BYTES = 64_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def normal(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 1, exclude_same: bool = True) -> DataFrame:
    """(key, nth, other, sim): for each query, its k nearest rows by cosine, in order; ties go to the lesser key.

    The stated queries are searched against all rows in blocks of bounded size: each block is broadcast, every task
    multiplies its rows with it and keeps k candidates for each query, and the candidates are merged by a window over
    k x tasks rows a query. Null and empty vectors are left out.
    """
    spark = rows.sparkSession
    q = queries.where(F.size(vector) > 0).select(F.col(key).cast("string"), F.transform(vector, lambda x: x.cast("double")))
    width = q.select(F.size(q.columns[1])).first()
    if width is None:
        return spark.createDataFrame([], f"{key} string, nth int, other string, sim double")
    blocks = max(1, -(-q.count() * width[0] * 8 // BLOCK_BYTES))
    r = rows.where(F.size(vector) > 0).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector"))
    out = None
    for b in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        got = own.collect()
        keys = np.array([x[0] for x in got], object)
        m = np.array([x[1] for x in got], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((keys, m))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, mat = shared.value
            best = [[] for _ in names]
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.array(pdf["vector"].tolist(), np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own_keys = pdf["key"].to_numpy()
                sims = mat @ v.T
                for i in range(len(names)):
                    s = sims[i]
                    take = np.argpartition(-s, min(k + 1, len(s) - 1))[: k + 2] if len(s) > k + 2 else np.arange(len(s))
                    edge = s[take].min()
                    take = np.flatnonzero(s >= edge)  # ties at the edge
                    best[i] += [(-float(s[j]), own_keys[j]) for j in take if not (exclude_same and own_keys[j] == names[i])]
                    best[i] = sorted(best[i])[:k]
            yield pd.DataFrame([(n, o, -s) for n, c in zip(names, best) for s, o in c], columns=["key", "other", "sim"])

        found = r.mapInPandas(search, "key string, other string, sim double")
        out = found if out is None else out.unionByName(found)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "other"))
    return out.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("key").alias(key), "nth", "other", "sim")


def most_similar(rows: DataFrame, held: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, sim): for each row, its greatest cosine with any held vector. Held vectors are broadcast in blocks of bounded size,
    one pass over the rows for each; the maxima of the passes are combined by key."""
    spark = rows.sparkSession
    h = held.where(F.size(vector) > 0).select(F.transform(vector, lambda x: x.cast("double")).alias("v"), F.xxhash64(key).alias("k"))
    first = h.select(F.size("v")).first()
    r = rows.where(F.size(vector) > 0).select(F.col(key), F.col(vector).alias("vector"))
    if first is None:
        return r.select(key, F.lit(-1.0).alias("sim"))
    blocks = max(1, -(-h.count() * first[0] * 8 // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        m = np.array([x[0] for x in h.where(F.pmod("k", F.lit(blocks)) == b).select("v").collect()], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast(m)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v = np.array(pdf["vector"].tolist(), np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    yield pd.DataFrame({key: pdf[key], "sim": (v @ shared.value.T).max(1)})

        got = r.mapInPandas(search, f"{key} {dict(rows.dtypes)[key]}, sim double")
        out = got if out is None else out.unionByName(got)
    return out if blocks == 1 else out.groupBy(key).agg(F.max("sim").alias("sim"))


def purity(pairs: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: purity (share of rows in the most frequent label of their cluster), inverse purity, clusters, rows."""
    c = pairs.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg(F.sum("top").alias("a"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"))
    b = c.groupBy(label).agg(F.max("n").alias("top")).agg(F.sum("top").alias("b"))
    return a.crossJoin(b).select((F.col("a") / F.col("n")).alias("purity"), (F.col("b") / F.col("n")).alias("inverse_purity"), "clusters", F.col("n").alias("rows"))


def leakage(rows: DataFrame, held: DataFrame, cluster: str, speaker: str) -> DataFrame:
    """One row: leak_any and leak_mass over the held-out rows (those of the clusters in held): the share whose speaker stays in
    training, and the mean share of their speaker's rows that stay."""
    x = rows.join(held.select(cluster).distinct().withColumn("__h", F.lit(1)), cluster, "left")
    s = x.groupBy(speaker).agg(F.count(F.lit(1)).alias("n"), F.count("__h").alias("h"))
    stay = F.col("n") - F.col("h")
    return s.where("h > 0").agg(
        (F.sum(F.when(stay > 0, F.col("h")).otherwise(0)) / F.sum("h")).alias("leak_any"), (F.sum(F.col("h") * stay / F.col("n")) / F.sum("h")).alias("leak_mass"), F.sum("h").alias("held")
    )


def guarded(rest: DataFrame, held: DataFrame, rows: DataFrame, speaker: str, limits: list[float]) -> DataFrame:
    """(tau, leak_mass, leak_any, dropped): leakage of the held-out rows' speakers into the training rows (rest, with their
    greatest similarity to a held-out row in sim) that lie below each limit, and the share of training rows beyond it."""
    tau = F.explode(F.array(*[F.lit(float(v)) for v in limits])).alias("tau")
    left = rest.select(speaker, "sim", tau).groupBy("tau", speaker).agg(F.count_if(F.col("sim") < F.col("tau")).alias("stay"), F.count(F.lit(1)).alias("rest"))
    n = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("n")).join(held.groupBy(speaker).agg(F.count(F.lit(1)).alias("held")), speaker, "left").na.fill(0, ["held"])
    x = n.select("*", tau).join(left, ["tau", speaker], "left").na.fill(0, ["stay", "rest"])
    mean = lambda c: F.round(F.sum(c) / F.sum("held"), 6)
    return x.groupBy("tau").agg(
        mean(F.col("held") * F.col("stay") / F.col("n")).alias("leak_mass"), mean(F.when(F.col("stay") > 0, F.col("held")).otherwise(0)).alias("leak_any"),
        F.round(1 - F.sum("stay") / F.sum("rest"), 6).alias("dropped"),
    )


def closest(v: np.ndarray, c: np.ndarray, rows: int = 1024, block: int = 4096) -> np.ndarray:
    """The centroid of greatest product with each vector, the first of equals, in blocks of bounded size."""
    out = np.zeros(len(v), np.int64)
    for i in range(0, len(v), rows):
        part, best = v[i : i + rows], np.full(min(rows, len(v) - i), -np.inf)
        for j in range(0, len(c), block):
            sims = part @ c[j : j + block].T
            at = sims.argmax(1)
            top = sims[np.arange(len(at)), at]
            better = top > best
            best[better], out[i : i + rows][better] = top[better], at[better] + j
    return out


def average_linkage(c: np.ndarray, threshold: float) -> np.ndarray:
    """Labels after joining the nearest groups of unit vectors, by mean cosine distance, until none is nearer than the threshold.

    The mean distance of two groups is that of their mean vectors, so chains of nearest neighbours need no matrix of all
    pairs. Joining others never brings a group nearer, so one whose nearest is beyond the threshold is complete.
    """
    mean, size, up = np.array(c, np.float64), np.ones(len(c)), np.arange(len(c))
    live, chain, start = np.ones(len(c), bool), [], 0
    while True:
        if not chain:
            while start < len(c) and not live[start]:
                start += 1
            if start == len(c):
                break
            chain.append(start)
        i = chain[-1]
        sim = np.where(live, mean @ mean[i], -np.inf)
        sim[i] = -np.inf
        j = int(sim.argmax())
        if len(chain) > 1 and sim[chain[-2]] >= sim[j] - 1e-12:  # equals must not lead round in a circle
            j = chain[-2]
        if 1 - sim[j] > threshold:
            live[chain.pop()] = False
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            size[i] += size[j]
            live[j], up[j] = False, i
        else:
            chain.append(j)
    for i in range(len(c)):  # a group bears the number of its least member
        up[i] = up[up[i]]
    return np.unique(up, return_inverse=True)[1]


#: Unit vectors are summed as whole multiples of this part, so that sums are the same in any order.
_PART = 1 << 36


def micro_clusters(x: DataFrame, micro: int, rounds: int = 25) -> dict[str, np.ndarray]:
    """Unit centroids of each bucket: spherical k-means over all rows (__b, __o, __v of length one) with k = rows // micro, at
    least two, begun with the first k rows in the order of the hash __o.

    Each round sends the centroids to the tasks, which place their rows and add them up; sums meet by centroid. Rounds end
    early once no centroid moves. Empty clusters are dropped. The driver holds the centroids.
    """
    spark = x.sparkSession
    sizes = {r["__b"]: r["count"] for r in x.groupBy("__b").count().collect()}
    if not sizes:
        return {}
    k = F.greatest(F.lit(2), F.floor(F.col("__n") / micro))
    first = ranked(x, ["__b"], F.col("__o")).join(F.broadcast(x.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))), "__b").where(F.col("rank") <= k)

    def by_bucket(found: DataFrame) -> dict[str, np.ndarray]:
        t = found.toArrow()
        b, at = np.array(t["b"].to_pylist(), object), t["at"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        out = {}
        for name in sizes:
            own = np.flatnonzero(b == name)
            m = v[own[np.argsort(at[own], kind="stable")]].astype(np.float64)
            out[name] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return out

    c = by_bucket(first.select(F.col("__b").alias("b"), F.col("rank").cast("long").alias("at"), F.col("__v").alias("v")))
    width = next(iter(c.values())).shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for pdf in batches:
                for name, g in pdf.groupby("__b"):
                    v = np.array(g["__v"].tolist())
                    whole = np.rint(v * _PART).astype(np.int64)
                    for i, j in enumerate(closest(v, shared.value[name])):
                        if (old := sums.get((name, j))) is None:
                            sums[name, j] = whole[i].copy()
                        else:
                            old += whole[i]
            yield pd.DataFrame({"b": [n for n, _ in sums], "at": [j for _, j in sums], "v": list(sums.values())})

        parts = x.select("__b", "__v").mapInPandas(add, "b string, at long, v array<long>")
        total = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0).cast("long"), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
        old, c = c, by_bucket(parts.groupBy("b", "at").agg(total.alias("v")))  # at most one part a task meets in a list
        shared.destroy()
        if all(np.array_equal(old[n], c[n]) for n in c):
            break
    return c


def cluster(rows: DataFrame, key: str, vector: str, bucket: str, micro: int = 5, threshold: float = 0.3) -> DataFrame:
    """(key, cluster) by micro-clusters and average linkage within each bucket, labelled bucket-00000.

    All rows take part: the micro-clusters of a bucket are a micro-th of its rows, whatever their number, and every row is in
    the cluster of its nearest centroid. So the work grows as the square of a bucket's rows, and the centroids of all buckets
    must fit a task and the driver.
    """
    x = rows.where(F.size(vector) > 0).select(F.col(key), F.col(bucket).cast("string").alias("__b"), F.xxhash64(key).alias("__o"), normal(F.col(vector)).alias("__v"))
    x = cut(x.where("__b is not null"), "vectors")
    spark = rows.sparkSession
    c = micro_clusters(x, micro)
    shared = spark.sparkContext.broadcast(c)
    names = sorted(c)
    joined = dict(spark.sparkContext.parallelize(names, max(1, len(names))).map(lambda n: (n, average_linkage(shared.value[n], threshold))).collect())
    labels = spark.sparkContext.broadcast(joined)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, g in pdf.groupby("__b"):
                at = labels.value[name][closest(np.array(g["__v"].tolist()), shared.value[name])]
                yield pd.DataFrame({key: g[key], "cluster": [f"{name}-{i:05d}" for i in at]})

    return x.select(key, "__b", "__v").mapInPandas(place, f"{key} {dict(rows.dtypes)[key]}, cluster string")
