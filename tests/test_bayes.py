import math
import os
import random
from collections import Counter, defaultdict

import __spark_entry__
import numpy as np
import pyarrow as pa
import pytest

from tarmill.operators import bayes, lexicon


def features(p, n, m):
    place = "first" if p is None else "last" if n is None else "mid"
    p, n, m = p or "<s>", n or "</s>", m or "</s>"
    return ["b", f"p={p}", f"n={n}", f"ps={p[-2:]}", f"ns={n[-2:]}", f"ns1={n[-1:]}", f"n2={m}", f"pos={place}"]


def slow_best(examples, contexts):
    """Every label scored, feature by feature."""
    prior, counts = Counter(y for y, *_ in examples), defaultdict(Counter)
    for y, *c in examples:
        counts[y].update(features(*c))
    v = len({f for c in counts.values() for f in c})
    out = []
    for c in contexts:
        scores = {y: math.log(k / len(examples)) + sum(math.log((counts[y][f] + 0.5) / (8 * k + 0.5 * v)) for f in features(*c)) for y, k in prior.items()}
        out.append(max((round(s, 7), y) for y, s in scores.items())[1])
    return out


def drawn(rnd, n, labels):
    """Examples of one frequent label and many rare ones, and contexts at the ends of lines too."""
    word = lambda: rnd.choice([None, *("".join(rnd.choices("abcė", k=rnd.randint(1, 3))) for _ in range(5))])
    y = lambda: rnd.choice(["l0"] * 3 + [f"l{min(int(rnd.expovariate(0.08)), labels)}"] * 2)
    return [(y(), word(), word(), word()) for _ in range(n)]


@pytest.mark.parametrize(("seed", "labels"), [(1, 4), (2, 80), (3, 300)])
def test_context_model(seed, labels):
    rnd = random.Random(seed)
    examples, rows = drawn(rnd, 400, labels), drawn(rnd, 150, labels)
    words, names = bayes.Numbers(), bayes.Numbers()
    keys = lambda x: bayes.context_keys(words, *(pa.array([r[k] for r in x], pa.string()) for k in (1, 2, 3)))
    model = bayes.ContextModel(keys(examples), np.array([names.number(r[0]) for r in examples]), names.names)
    assert (len(model.ids) <= bayes.FEW) == (labels == 4) and (len(model.classes) == 1) == (labels == 4)
    assert [names.names[k] for k in model.best(keys(rows))] == slow_best(examples, [r[1:] for r in rows])


def test_predict(spark, monkeypatch):
    rnd = random.Random(4)
    examples = {f: drawn(rnd, n, 40) for f, n in (("a", 200), ("b", 8), ("c", 7), ("d", 30))}
    rows = {f: drawn(rnd, n, 40) for f, n in (("a", 90), ("b", 20), ("c", 5), ("d", 5), ("e", 3))}
    kind = "dial string, std string, prev string, next string, next2 string"
    frame = lambda x: spark.createDataFrame([(f, *r) for f, of in x.items() for r in of], kind)
    forms = spark.createDataFrame([(f, f"most {f}".replace(" ", "-")) for f in "abce"], "dial string, majority string")
    given = frame(rows).selectExpr("*", "monotonically_increasing_id() as at")
    expected = Counter()
    for f in "abce":
        best = slow_best(examples[f], [r[1:] for r in rows[f]]) if len(examples.get(f, [])) >= 8 else [None] * len(rows[f])
        expected += Counter((f, *r, f"most-{f}", b) for r, b in zip(rows[f], best))
    for part in (bayes.PART, 7):  # the rows of a form in one task, and in several
        monkeypatch.setattr(bayes, "PART", part)
        got = bayes.predict(given, frame(examples), forms, given.groupBy("dial").count().withColumnRenamed("count", "n")).collect()
        assert Counter((r["dial"], r["std"], r["prev"], r["next"], r["next2"], r["majority"], r["predicted"]) for r in got) == expected
        assert len({r["at"] for r in got}) == len(got)


def test_neighbours(spark, data):
    rows = [("i", "x y z", "X Y"), ("i", "x y z", "X Y"), ("i", "x q", "X Q"), ("j", " v ", "V"), ("k", "", ""), ("l", None, "A"), (None, "u w", "U W")]
    got = bayes.neighbours(spark.createDataFrame(rows, "id string, dial string, std string"), ["id"]).collect()
    assert Counter(map(tuple, got)) == Counter([
        ("i", 0, "x", "X", None, "q", None), ("i", 1, "y", "Y", "x", None, None), ("i", 1, "q", "Q", "x", None, None), ("j", 0, "v", "V", None, None, None),
        (None, 0, "u", "U", None, "w", None), (None, 1, "w", "W", "u", None, None),
    ])
    x = bayes.neighbours(spark.read.parquet(f"{data}/layers.parquet"), ["id", "tier"])
    want = lexicon.features(x.select("id", "tier", "pos", "dial"), ["id", "tier"]).collect()
    assert {(r["id"], r["tier"], r["pos"]): r["features"] for r in want} == {(r["id"], r["tier"], r["pos"]): features(r["prev"], r["next"], r["next2"]) for r in x.collect()}


def test_classifier_moves_words_once(spark, data):
    """Bytes shuffled against those read: labels, features and scores never leave a task."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = moved()
    (r,) = __spark_entry__.queries()["context_classifier"](spark, data).collect()
    assert r["words"] > 0
    assert sum(b for k, b in moved().items() if k not in before) < 4 * os.path.getsize(f"{data}/layers.parquet")
