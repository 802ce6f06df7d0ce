import random

import pytest
from pyspark.sql import functions as F

from tarmill import runtime
from tarmill.operators import batches, joins, lexicon, splits, standardise, tables, vectors
from tarmill.operators.components import components
from tarmill.runtime import ranked


def slow_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randint(0, 80):02d}", f"n{rnd.randint(0, 80):02d}") for _ in range(55)] + [("hub", f"n{k:02d}") for k in range(0, 20)]
    df = spark.createDataFrame([*edges, ("solo", "solo"), (None, "x")], "u string, v string")
    assert {r["node"]: r["component"] for r in components(df).collect()} == slow_components([*edges, ("solo", "solo")])
    assert components(df.limit(0)).count() == 0


def test_ranked_is_a_permutation(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("k"), "id")
    r = ranked(df, ["k"], F.xxhash64("id")).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    assert all(x["n"] == x["d"] == x["b"] and x["a"] == 1 for x in r)


def test_numbered_and_greedy(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("w"))
    assert [r["n"] for r in batches.numbered(df, ["o"], "n").orderBy("o").collect()] == list(range(1000))
    assert sorted({r["batch"] for r in batches.fixed(df, ["o"], 265).collect()}) == [1, 2, 3, 4]
    chunk, n, total = 1, 0, 0
    want = []
    for k in range(1000):
        if n and (n >= 20 or total + k % 7 > 40):
            chunk, n, total = chunk + 1, 0, 0
        n, total = n + 1, total + k % 7
        want.append(chunk)
    assert [r["chunk"] for r in batches.greedy(df, "k", "o", "w", 20, 40).orderBy("o").collect()] == want


def test_guard(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sp = spark.createDataFrame([("A000009",)], "speaker_id string")
    assert joins.guard(ids("A00000101-1", "B00000101-1"), ids("x"), sp) == 2
    with pytest.raises(joins.LeakageError, match="1 held-out"):
        joins.guard(ids("A00000101-1", "x"), ids("x"), sp)
    with pytest.raises(joins.LeakageError, match="A000009"):
        joins.guard(ids("A00000901-1"), ids("x"), sp)
    with pytest.raises(joins.MissingKeyError):
        joins.strict(ids("a", "b"), ids("a"), "id")


def test_votes_and_variants(spark):
    p = spark.createDataFrame([("a", "a")] * 9 + [("a", "b")] + [("c", "d")] * 3 + [("e", "f"), ("e", "g")], "dial string, std string")
    v = {r["form"]: (r["decision"], r["std"]) for r in lexicon.vote(p).collect()}
    assert v == {"a": ("keep", "a"), "c": ("std", "d"), "e": ("ctx", "f")}
    w = {r["form"]: (r["decision"], r["std"], r["cands"]) for r in lexicon.variants(p).collect()}
    assert w == {"a": ("ctx", None, ["a", "b"]), "c": ("std", "d", None), "e": ("ctx", None, ["f", "g"])}
    assert lexicon.vote(p.limit(0)).count() == 0


def test_rules_and_rewrites(spark):
    pairs = spark.createDataFrame([("namuos", "namus"), ("laukuos", "laukus"), ("miškuos", "miškus")], "form string, std string")
    r = lexicon.rules(pairs)
    lex = spark.createDataFrame([("kelmus", 30, 0), ("kelmuos", 1, 0)], "word string, read long, spon long")
    got = lexicon.rewrite(spark.createDataFrame([("kelmuos",)], "word string"), r, lex)
    assert [x["candidate"] for x in lexicon.confident(got).collect()] == ["kelmus"]


def test_standardise(spark):
    w = spark.createDataFrame([("r", 0, "nu", "nu", False), ("r", 1, "kap", "kap", True), ("r", 2, "kap", "kas", False)], "id string, pos int, dial string, std string, unsure boolean")
    got = standardise.ordered(w, standardise.word_rules([("nu", ["nu"], "na"), ("kap", None, "kaip")]), ["id"]).orderBy("pos").collect()
    assert [g["std"] for g in got] == ["na", "kap", "kaip"]
    rows = spark.createDataFrame([("r", ["a", "b"])], "id string, words array<string>")
    fixes = spark.createDataFrame([("r", 1, "b", "c"), ("r", 0, "x", "y"), ("r", 5, "a", "b")], "id string, pos int, from string, to string")
    done, refused = standardise.point_fixes(rows, fixes)
    assert done.first()["words"] == ["a", "c"] and refused.count() == 2
    given = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "x"), ("d", "x")], "id string, dial string")
    out = spark.createDataFrame([("a", "x", []), ("b", "x", [3]), ("d", "X!", []), ("e", "x", []), ("d", "X!", [])], "id string, std string, unsure array<int>")
    errors = {(r["id"], r["error"]) for r in standardise.validate(given, out).collect()}
    assert errors == {("a", "word_count"), ("b", "bad_unsure"), ("c", "missing"), ("d", "bad_word"), ("d", "duplicate"), ("e", "extra")}
    ok = spark.createDataFrame([([1, 2], [2, 2]), ([3], [2]), ([1], [2, 2])], "p array<int>, s array<int>").select(standardise.valid_answers(None, "p", "s").alias("v"))
    assert [r["v"] for r in ok.collect()] == [True, False, False]


def test_choices(spark):
    plan = spark.createDataFrame([("r", 0, "a", None, "="), ("r", 1, None, ["b", "c"], "C"), ("r", 2, None, ["d", "e"], "N")], "id string, pos int, std string, cands array<string>, how string")
    got = standardise.choose(plan, spark.createDataFrame([("r", 1, 2)], "id string, j long, pick int"), ["id", "pos"]).orderBy("pos").collect()
    assert [(g["std"], g["unsure"]) for g in got] == [("a", False), ("c", False), ("d", True)]


def test_splits(spark):
    s = spark.createDataFrame([(f"s{k}", "R", "male" if k == 3 else "female", "60+" if k % 2 else "18-60", 9, 5000.0 if k < 9 else 1.0) for k in range(10)], "speaker_id string, region string, gender string, age_group string, clips long, sec double")
    ids = [r["speaker_id"] for r in splits.held_out_pick(s, 3, 1800).collect()]
    assert len(ids) == 3 and "s3" in ids and "s9" not in ids
    c = spark.createDataFrame([(f"c{k:03d}", "a", 10.0) for k in range(100)], "id string, speaker_id string, duration double")
    block = sorted(r["id"] for r in splits.contiguous_block(c, 95).collect())
    assert len(block) == 10 and int(block[-1][1:]) - int(block[0][1:]) == 9
    assert splits.contiguous_block(c, 5000).count() == 100


def test_vectors(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.gauss(k % 2 * 6, 1), rnd.gauss(3, 1)], k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = vectors.nearest(df, df.where("id < 5"), "id", "v", 3).collect()
    import numpy as np

    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        order = [str(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:3]
        assert [r["other"] for r in sorted(got, key=lambda r: r["nth"]) if r["id"] == str(q)] == order
    c = vectors.cluster(df.withColumn("b", F.lit("x")), "id", "v", "b", micro=10, threshold=0.2)
    assert c.count() == 60
    p = vectors.purity(c.join(df, "id"), "cluster", "label").first()
    assert p["purity"] > 0.9


def test_tables(spark):
    df = spark.createDataFrame([(12.5, 8), (33.333, 3)], "p double, n int")
    assert [r[0] for r in df.select(tables.recovered(F.col("p"), F.col("n"))).collect()] == [1, 1]
    with pytest.raises(Exception, match="no count"):
        spark.createDataFrame([(12.0, 8)], "p double, n int").select(tables.recovered(F.col("p"), F.col("n"))).collect()
    assert df.limit(1).select(tables.signed(F.lit(-1.5))).first()[0] == "−1.50"
    assert tables.markdown(df.limit(1)).splitlines()[2] == "| 12.5 | 8 |"
    assert "\\%" in tables.latex_macros({"a": "5%"})


def test_review(spark):
    from tarmill.operators import review

    d = spark.createDataFrame([("a", "keep", None, None), ("b", "std", "x+y", None), ("c", "merge", "x+y", None), ("d", "ctx", None, ["x", "x"]), ("e", None, None, None), ("c", "merge", "xy", None)], "word string, decision string, std string, cands array<string>")
    got = sorted((r["word"], r["error"]) for r in review.decision_errors(d).collect())
    assert got == [("b", "bad_std"), ("c", "bad_merge"), ("c", "repeated"), ("d", "few_candidates"), ("e", "unknown")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    review.require_subset(ids("a"), ids("a", "b"), "id")
    review.require_equal(ids("a", "b"), ids("b", "a"))
    for bad in (lambda: review.require_subset(ids("c"), ids("a"), "id"), lambda: review.require_unique(ids("a", "a"), "id"), lambda: review.require_equal(ids("a"), ids("a", "a"))):
        with pytest.raises(review.ContractError):
            bad()
    p = spark.createDataFrame([("spon/S/R/F3/x.wav",), ("spon/S/R/x.wav",), ("read/S/R/F3/x.wav",), ("spon/S/Q/F3/x.wav",)], "p string")
    out = [r[0] for r in p.select(review.path_codes(F.col("p"), {"F": "female"}, {"3": "18-60"}, {"R": "radio"})).collect()]
    assert tuple(out[0]) == ("female", "18-60", "radio") and out[1:] == [None, None, None]


def test_cluster_draw_of_any_table_size(spark):
    def drawn(times, **limit):
        rows = spark.range(10 * times).select(F.when(F.col("id") < 6 * times, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 4).cast("string"))).alias("c"))
        return {r["c"] for r in splits.cluster_draw(rows, "c", 1.0, **limit).collect()}

    for times in (4, 400):  # a session of more than 400 rows is drawn too, and a share excludes the same at every size
        assert "a" in drawn(times) and len(drawn(times)) == 5
        assert drawn(times, cap_share=0.5) == {"b0", "b1", "b2", "b3"}


def test_session_draw_has_no_limit(spark, tmp_path):
    from tarmill.plans import catalog

    row = "'liepa3.dial' as dataset_id, 'A000001' as speaker_id, 'A' as region, 'male' as gender, '60+' as age_group, 1.0D as duration, 'a' as text_normalized, timestamp'2026-01-01' as recorded_at, timestamp'2026-01-01' as loaded_at"
    spark.range(500).selectExpr("format_string('A00000101-%04d', id) as id", *row.split(", ")).write.parquet(str(tmp_path / "clips.parquet"))
    assert [tuple(r) for r in catalog.queries()["session_draw"](spark, str(tmp_path)).collect()] == [("A00000101", 500)]


def test_linkage_without_a_matrix():
    import numpy as np

    def slow(c, threshold):
        groups = [[i] for i in range(len(c))]
        while len(groups) > 1:
            d, i, j = min((float(np.mean([1 - c[a] @ c[b] for a in g for b in h])), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if d > threshold:
                break
            groups[i] += groups.pop(j)
        return {frozenset(g) for g in groups}

    rng = np.random.default_rng(3)
    for n, threshold in ((1, 0.3), (12, 0.1), (30, 0.3), (30, 0.6)):
        c = rng.normal(size=(n, 3))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        lab = vectors.average_linkage(c, threshold)
        assert {frozenset(np.flatnonzero(lab == k)) for k in set(lab)} == slow(c, threshold)
    assert len(set(vectors.average_linkage(np.tile([[0.6, 0.8]], (7, 1)), 0.1))) == 1


def test_every_vector_counts_in_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(rng.normal(size=(18_000, 6)))], "id long, v array<double>, b string")
    c = vectors.cluster(df, "id", "v", "b", micro=5, threshold=-1.0)  # nothing joins: a micro-cluster is a cluster
    found = c.groupBy("cluster").count()
    assert 3_400 < found.count() <= 3_600 and c.select("id").distinct().count() == 18_000
    small = df.where("id < 300")
    a, b = [{frozenset(r[0]) for r in vectors.cluster(small.repartition(n), "id", "v", "b", micro=5, threshold=0.3).groupBy("cluster").agg(F.collect_list("id")).collect()} for n in (1, 6)]
    assert a == b


def test_greedy_streams_across_batches(spark):
    rows = [("a", k, k % 7) for k in range(500)] + [(None, 1, 5), (None, 2, None), ("b", 1, 99)]
    df = spark.createDataFrame(rows, "k string, o int, w int").withColumn("chunk", F.lit("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r["k"], r["o"]): r["chunk"] for r in batches.greedy(df, "k", "o", "w", 10, 25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads: dict = {}
    for k, o, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        loads.setdefault((k, got[k, o]), []).append(w or 0)
    assert len(got) == len(rows) and all(len(v) == 1 or (len(v) <= 10 and sum(v) <= 25) for v in loads.values())
    chunks = [v for (k, _), v in sorted(loads.items(), key=lambda x: (str(x[0][0]), x[0][1])) if k == "a"]
    assert all(len(a) == 10 or sum(a) + b[0] > 25 for a, b in zip(chunks, chunks[1:]))  # none was closed too early


def test_running_sums_and_ranks(spark):
    df = spark.createDataFrame([("hot" if k % 3 else None, f"r{k}", float(k % 5)) for k in range(400)], "k string, id string, w double")
    got = runtime.running(df, ["k"], splits.shuffled("id"), ["id"], "w", "before").withColumn("o", splits.shuffled("id")).collect()
    for key in ("hot", None):
        total = 0.0
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["o"]):
            assert r["before"] == total
            total += r["w"]
    assert len(got) == 400 and runtime.running(df.limit(0), ["k"], splits.shuffled("id"), ["id"], "w", "before").count() == 0


def test_disordered(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 5), ("e", 6)], "id string, n int")
    b = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3), ("x", 4), ("e", 5)], "id string, n int")
    assert sorted(map(tuple, joins.disordered(a, b, "id", ["n"], ["n"]).collect())) == [("b", 1, 2), ("c", 2, 1)]
    assert joins.disordered(a, a.limit(0), "id", ["n"], ["n"]).count() == 0


def test_guarded(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 4), ("u", 5)], "sp string, id int")
    held = rows.where("id in (1, 4)")
    rest = spark.createDataFrame([("s", 0.9), ("s", 0.1), ("u", 0.5)], "sp string, sim double")
    got = {r["tau"]: (r["leak_mass"], r["leak_any"], r["dropped"]) for r in vectors.guarded(rest, held, rows, "sp", [0.5, 2.0]).collect()}
    assert got == {0.5: (0.166667, 0.5, 0.666667), 2.0: (0.333333, 0.5, 0.0)}
