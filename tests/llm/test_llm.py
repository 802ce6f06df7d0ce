import itertools
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows_of
from pyspark.sql import functions as F

from tarmill.llm import catalog, encoding, forms, leaks, levels, overlap, packing, quotas, together

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    a, b = rows_of(spark, data, QUERIES[name], SQL[name])
    assert a == b


# --- 1 ---


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", ""), ("  ", ""), ("tai yra", "tai yra"), ("tai yra", "tai yra"), ("ta​i", "tai"), ("ｔａｉ", "tai"), ("šiandien", "šiandien"),
        ("іr", "ir"), ("конечно", "конечно"), ("кoнечно", "конечно"), ("λόγος", "λόγος"), ("ė́jo", "ė́jo"), ("nors‐ne", "nors-ne"), ("a  b", "a b"), ("јі", "ji"),
        ("a­b", "ab"), ("יום", "יום"), ("a\nb", "a b"),
    ],
)
def test_consistent(text, want):
    assert forms.consistent(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_consistent_is_stable(text):
    once = forms.consistent(text)
    assert forms.consistent(once) == once
    assert unicodedata.normalize("NFC", once) == once


@pytest.mark.parametrize(
    ("text", "want", "fine"),
    [
        ("naмas", "naмas", False), ("кas", "кas", False), ("нamas", "нamas", False), ("Δt", "Δt", False), ("пробка", "пробка", True), ("cор", "cop", True),
        ("ꓚop", "Cop", True), ("Ꭰa", "Da", True), ("日本のテスト", "日本のテスト", True), ("øl", "øl", True), ("mІl0", "mIl0", True),
    ],
)
def test_words_of_two_alphabets(spark, text, want, fine):
    assert forms.consistent(text) == want and forms.mixed(want) != fine
    df = spark.createDataFrame([("a", want)], "id string, dial string")
    assert forms.inconsistent(df, "id", ["dial"]).count() == (not fine)  # what no alphabet can spell is left and reported


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcsxklmnopуеахікмнѕαοτυծօսסꓚᎠéø"), min_size=1, max_size=8).map("".join))
def test_one_alphabet_a_word_or_the_original(word):
    got = forms.consistent(word)
    assert not forms.mixed(got) or got == unicodedata.normalize("NFC", word)
    assert forms.skeleton(got) == forms.skeleton(word)


def test_look_alike_table():
    known = forms.lookalikes()
    assert len(known.prototypes) > 6000 and known.prototypes["а"] == "a" and known.prototypes["м"] == "ʍ"
    assert known.twin("Н", "LATIN") == "H" and known.twin("о", "GREEK") == "ο" and known.twin("ж", "LATIN") is None


def test_inconsistent_and_groups(spark):
    rows = [("a", "tai", "tai"), ("b", "tаi", None), ("b", "tаi", None), ("c", "", "ta i"), (None, "x", "x" * 20_000)]
    df = spark.createDataFrame(rows, "id string, dial string, std string").withColumns({"text": F.lit(1), "field": F.lit(2)})
    assert sorted(tuple(r) for r in forms.inconsistent(df, "id", ["dial", "std"]).collect()) == [("b", "dial"), ("c", "std")]
    g = forms.word_groups(df, "id", ["dial", "std"]).collect()
    assert len(g) == 1 and g[0]["form"] == "tai" and {o["word"] for o in g[0]["originals"]} == {"tai", "tаi"}
    assert forms.inconsistent(df.limit(0), "id", ["dial", "std"]).count() == 0
    got = forms.to_consistent(df, "dial", "dial")
    assert got.columns == df.columns and got.count() == 5


# --- 2 ---


def test_quotas(spark):
    rows = [(f"s{k}", "F" if k < 30 else " male", "60 +" if k % 2 else "18–60") for k in range(40)] + [("s1 ", None, None), ("n", None, "60+"), (None, "F", "60+")]
    sp = spark.createDataFrame(rows, "speaker_id string, gender string, age_group string").withColumn("quota", F.lit(1))
    t = spark.createDataFrame([("p", 0.5, "male", "60+", 0.5, 1), ("p", 0.5, "male", "18-60", 0.0, 2), ("p", 0.5, "female", "60+", 0.1, 1), ("p", 0.5, "female", "18-60", 0.4, 1)], "plan_id string, sample_fraction double, gender string, age_group string, target_share double, min_count int")
    got = {(r["gender"], r["age_group"]): r for r in quotas.allocation(t, sp).collect()}
    m = got["male", "60+"]
    assert (m["sample_size"], m["quota"], m["available"], m["own"], m["short"]) == (20, 10, 5, 5, True)
    assert got["male", "18-60"]["to_siblings"] == 3 and sum(r["to_cousins"] for r in got.values()) == 2
    d = quotas.draw(t, sp)
    assert d.groupBy("gender", "age_group").count().count() == 4 and d.count() == sum(r["taken"] for r in got.values())
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, quotas.draw(t, sp.repartition(7)).collect()))
    assert quotas.allocation(t, sp.limit(0)).where("short").count() == 3 + 1
    assert quotas.allocation(t.limit(0), sp).count() == 0


def test_decimal_shares(spark):
    sp = spark.createDataFrame([(f"s{k}", "F", "60+") for k in range(100)], "speaker_id string, gender string, age_group string")
    t = spark.createDataFrame([("p", 0.29, "female", "60+", 0.1, 0), ("q", 0.3, "female", "60+", 0.7, 0)], "plan_id string, sample_fraction double, gender string, age_group string, target_share double, min_count int")
    got = {r["plan_id"]: (r["sample_size"], r["quota"]) for r in quotas.allocation(t, sp).collect()}
    assert got == {"p": (29, 3), "q": (30, 21)}


# --- 3 ---


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12), st.integers(60, 90), st.integers(1, 30))
def test_configurations_hold_everything(histogram, capacity, most):
    patterns, bound = packing.configurations(histogram, capacity, most, rounds=20)
    held: dict[int, int] = {}
    for p in patterns:
        assert sum(n * k for n, k in p.take.items()) <= capacity and sum(p.take.values()) <= most
        for n, k in p.take.items():
            held[n] = held.get(n, 0) + k * p.times
    assert held == histogram
    assert sum(p.times for p in patterns) >= bound - 1e-6


def test_configurations_round_the_program():
    # the order of discovery gives 75 here, as do no patterns; the program's solution rounded down is near the bound of 67.3
    patterns, bound = packing.configurations({31: 40, 14: 45, 16: 43, 15: 59, 27: 22}, 60, 30, rounds=40)
    assert bound <= sum(p.times for p in patterns) <= 70
    ways, _ = packing.candidates({n: 3 for n in range(1, 60)}, 60, 30, rounds=2)  # lengths that no round reaches
    assert all(sum(p.times * p.take.get(n, 0) for p in w) == 3 for w in ways.values() for n in range(1, 60)) and len(ways) == 3


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(f"r{k}", [rnd.randint(0, 300) for _ in range(rnd.choice([0, 1, 2, 3, 40, 120]))] or None, None) for k in range(200)]
    rows += [("r0", rows[0][1], None), (None, [1], [1]), ("nul", [None, 3, 3], []), ("big", list(range(130)), list(range(31)))]
    df = spark.createDataFrame(rows, "id string, ns array<int>, fix array<int>").withColumn("n", F.lit("x"))
    lim = spark.createDataFrame([("ns", 50, 20), ("fix", 30, 5)], "list_name string, capacity int, max_clips int")
    chunks, report = packing.pack(df, lim, rounds=20)
    got = chunks.collect()
    want = {(i, n, p) for i, ns, fix in rows for n, v in (("ns", ns), ("fix", fix)) if i for p in (v or []) if p is not None}
    assert {(r["id"], r["list_name"], p) for r in got for p in r["positions"]} == want and sum(len(r["positions"]) for r in got) == len(want)
    loads: dict = {}
    for r in got:
        loads.setdefault((r["list_name"], r["chunk"]), []).append(r["n"])
    assert all(sum(v) <= {"ns": 50, "fix": 30}[k[0]] and len(v) <= {"ns": 20, "fix": 5}[k[0]] for k, v in loads.items())
    assert {r["list_name"]: r["chunks"] for r in report.collect()} == {n: len({k for k in loads if k[0] == n}) for n in ("ns", "fix")}
    whole = {r["id"] for r in got if r["part"] > 0}
    assert whole == {i for i, ns, fix in rows if i and (len(set(ns or [])) > 50 or len(set(fix or [])) > 30)}
    assert sorted((r["id"], r["list_name"]) for r in packing.split_records(chunks).collect()) == [("big", "fix"), *sorted((i, "ns") for i in {r["id"] for r in got if r["part"] and r["list_name"] == "ns"})]
    assert packing.pack(df.limit(0), lim)[0].count() == 0


def test_filling_grows_with_lengths_not_containers():
    rnd = random.Random(4)
    h = {n: rnd.randint(1, 9) for n in range(1, 200)} | {1: 4000, 2: 700}
    many = {n: k * 5000 for n, k in h.items()}
    began = time.time()
    ps, bound = packing.configurations(many, 300, 150, rounds=5)
    assert time.time() - began < 20 and len(ps) < 5000 and sum(p.times for p in ps) < 1.02 * bound
    assert all(sum(p.times * p.take.get(n, 0) for p in ps) == k for n, k in many.items())
    assert sum(p.times for p in packing.configurations({180: 7, 1: 900}, 300, 150)[0]) == 8  # room is kept for small items


# --- 4 ---


def test_differencing():
    rnd = random.Random(1)
    w = [rnd.randint(1, 50) for _ in range(200)]
    b = together.differenced(w, 7)
    sums = [sum(x for x, k in zip(w, b) if k == i) for i in range(7)]
    assert max(sums) - min(sums) <= 2 and together.differenced([], 3) == []


def test_torn_and_assign(spark):
    roles = spark.createDataFrame([("a1", "Train"), (" A1", "seen "), ("b", "test"), ("c", "dev"), ("d", None), ("e", "dev"), (None, "dev")], "speaker_id string, role string").withColumn("person", F.lit(0))
    links = spark.createDataFrame([("a1", "zz"), ("ZZ ", "b"), ("c", "c"), ("d", "b"), (None, "c")], "speaker_id string, same_as string")
    assert sorted(r[0] for r in together.torn(roles, links).collect()) == ["A1", "B", "D"]
    assert together.torn(roles, links.limit(0)).count() == 0
    sp = spark.createDataFrame([(f"s{k}", "Dzūkija" if k % 3 else "dzukija ", None) for k in range(300)], "speaker_id string, region string, x int")
    w = spark.createDataFrame([(f"s{k}", 1 + k % 9) for k in range(0, 300, 2)], "speaker_id string, weight long")
    ln = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(20)], "speaker_id string, same_as string")
    r = together.assign(sp, ln, w, bins=20, group=100)
    assert r.count() == 300 and r.where("person = 'S0'").select("side").distinct().count() == 1
    got = {x["side"]: x["w"] for x in r.join(w.select(F.upper("speaker_id").alias("speaker_id"), "weight"), "speaker_id", "left").groupBy("side").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("w")).collect()}
    total = sum(got.values())
    assert abs(got["train"] / total - 0.8) < 0.08 and abs(got["dev"] / total - 0.1) < 0.06


def test_evened(spark):
    rows = [(f"p{k}", "r", float(1 + k % 4), "train") for k in range(300)] + [("big", "r", 400.0, "train"), ("d", "r", 1.0, "dev"), ("q", "s", 3.0, "test")]
    got = together.evened(spark.createDataFrame(rows, "person string, region string, weight double, side string"), together.SPLITS).collect()
    assert len(got) == len(rows) and next(r["side"] for r in got if r["person"] == "big") == "train"
    w = {k: sum(r["weight"] for r in got if r["region"] == "r" and r["side"] == k) for k in together.SPLITS}
    total = sum(w.values())
    assert all(abs(w[k] / total - share) < 0.01 for k, share in together.SPLITS.items())
    assert together.evened(spark.createDataFrame([], "person string, region string, weight double, side string"), together.SPLITS).count() == 0


# --- 5 ---


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40), st.integers(0, 12))
def test_distance(a, b, most):
    assert overlap.distance(a, b, most) == min(lev(a, b), most + 1)


def test_backward_search_counts():
    texts = ["labas rytas visiems", "labas vakaras", "", "rytas rytas"]
    idx = overlap.build(texts)
    row, start = overlap.letters(["rytas labas"])
    text, place, low, high = overlap.matches(idx, row, start, np.array([0]), 1)
    for p, lo, hi, end in zip(place, low, high, [len("rytas labas"), *place[:-1]]):
        piece = "rytas labas"[p:end]
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(piece, i)}
        assert {(int(idx["of"][s]), int(idx["at"][s])) for s in range(lo, hi)} == want


def test_near_loses_nothing(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("aeiouklmnprst") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(6, 25)))

    def spoiled(t):
        t = list(t)
        for _ in range(int(len(t) * rnd.uniform(0, 0.2))):
            k, what = rnd.randrange(len(t)), rnd.randint(0, 2)
            t[k : k + (what != 1)] = [] if what == 2 else [rnd.choice("aeiouk ")]
        return " ".join("".join(t).split())

    held = sorted({line() for _ in range(120)})
    train = sorted({spoiled(rnd.choice(held)) if rnd.random() < 0.6 else line() for _ in range(250)} | set(held[:5]))
    rows = lambda ts: spark.createDataFrame([(bytearray(t.encode()), t) for t in ts], "key binary, text string")
    got = {(bytes(r["train_key"]).decode(), bytes(r["held_key"]).decode()) for r in overlap.near(rows(train), rows(held), shard_chars=2000).collect()}
    want = {(a, b) for a, b in itertools.product(train, held) if lev(a, b) <= max(len(a), len(b)) * 15 // 100}
    assert got == want and len(want) > 60


def test_overlaps_cases(spark):
    t = "vienas du trys keturi penki šeši septyni"
    clips = [("a", t), ("b", t.upper() + "!"), ("c", "trumpas tekstas"), ("d", "trumpas tekstas"), ("e", None), ("f", ""), ("g", t), ("b", t.upper() + "!"), ("h", "x " * 4000), (None, t)]
    c = spark.createDataFrame([(*r, "d1") for r in clips], "id string, text_normalized string, dataset_id string").withColumn("key", F.lit(1))
    s = spark.createDataFrame([("dial.train.v1", " a\n"), ("dial.test.v1", "b"), ("dial.train.v1", "c"), ("dial.test.v1", "d"), ("phone.train.v1", "e"), ("phone.dev.v1", "e"), ("dial.excluded.v1", "g"), ("dial.train.v1", "nowhere"), ("dial.test.v1", "h")], "split_id string, id string")
    assert sorted(map(tuple, overlap.overlaps(c, s).collect())) == [("a", "b"), ("e", "e")]
    r = {x["split_id"]: (x["clips"], x["overlapping"]) for x in overlap.report(c, s).collect()}
    assert r == {"dial.test.v1": (3, 1), "phone.dev.v1": (1, 1)}
    assert overlap.overlaps(c, s.limit(0)).count() == 0 and overlap.overlaps(c.limit(0), s).count() == 0


# --- 6 ---


@pytest.fixture(scope="module")
def merges():
    return encoding.Merges.read(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(merges, text):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=encoding.PIECES, mergeable_ranks={t: i for i, t in enumerate(merges.token)}, special_tokens={})
    ids = encoding.Encoder(merges).encode(text)
    assert ids == enc.encode_ordinary(text)
    assert encoding.Decoder(merges).decode(np.array(ids, np.int64)).decode() == text


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "<|endoftext|>"), (4, "a" * 9000), (None, "x")], "k long, text string").withColumn("ids", F.lit(0))
    got = {(r["k"], len(r["ids"])) for r in encoding.encode(df, "k", "text").collect()}
    assert {(1, 0), (2, 0)} <= got and len(got) == 6
    assert encoding.encode(df.limit(0), "k", "text").count() == 0
    back = encoding.decode(encoding.encode(df, "k", "text"), "k").collect()
    assert sorted(r["text"] for r in back) == sorted(["", "", "  ", "<|endoftext|>", "a" * 9000, "x"])


# --- 7 ---


def test_leaks(spark):
    rnd = random.Random(3)
    w = [f"w{k}x" for k in range(400)]
    item = [rnd.choice(w) for _ in range(40)]
    noise = lambda n: [f"n{rnd.randint(0, 9999)}" for _ in range(n)]

    def doc(passage):
        return " ".join([*noise(30), *passage, *noise(30)])

    p = item[5:17]
    sub2 = [*p[:4], "zz", *p[5:8], "zz", *p[9:]]
    sub3 = [*p[:2], "zz", *p[3:5], "zz", *p[6:8], "zz", *p[9:]]
    long3 = [*item[:6], "q1", *item[7:9], "q2", *item[10:12], "q3", *item[13:18]]
    docs = [(1, doc(p)), (2, doc(item[5:16])), (3, doc(sub2)), (4, doc(sub3)), (5, "<p>" + doc(p).upper().replace(" ", ",​ ") + "</p>"), (6, None), (7, ""), (8, doc(item)), (8, doc(item)), (9, doc(long3)), (10, doc([*p[:6], "added", *p[6:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(70, " ".join(item)), (71, " ".join(item[:11])), (72, None), (73, "")], "item_id long, text string")
    got = sorted(map(tuple, leaks.leaked(df, items).collect()))
    brute = lambda t: leaks.passage(leaks.Hashes().of(item), leaks.Hashes().of(leaks.words(t)))
    want = sorted((k, 70) for k, t in docs if t and brute(t))
    assert got == want and {k for k, _ in got} == {1, 2, 3, 5, 8, 9, 10}  # 2: eleven words and a changed one
    assert sorted(map(tuple, leaks.leaked(df, items, broadcast_chars=60).collect())) == want
    assert [leaks.words(f"aa{c}bb") for c in "\u2066\u061c\u180e\U000e0041\u20d0\u0301\x07"] == [["aabb"]] * 7
    twice = items.unionByName(items).unionByName(spark.createDataFrame([(None, " ".join(item))], items.schema))
    assert [leaks.leaked(df, twice, broadcast_chars=n).count() for n in (0, 10_000)] == [2 * len(want)] * 2
    assert leaks.leaked(df, items.limit(0)).count() == 0 and leaks.leaked(df.limit(0), items).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_winnow_guarantee(a, b):
    """Every shared run of WINDOW + K - 1 words shares a fingerprint, and one with a word beside it."""
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    (pa, ha), (pb, hb) = leaks.winnow(a), leaks.winnow(b)
    both = np.concatenate([a, b])
    end = np.zeros(len(both), bool)
    end[[x for x in (len(a) - 1, len(both) - 1) if x >= 0]] = True
    if len(a) and len(b):  # texts in one row have the fingerprints that they have alone
        p, h = leaks.winnow(both, end)
        assert p.tolist() == [*pa.tolist(), *(pb + len(a)).tolist()] and h.tolist() == [*ha.tolist(), *hb.tolist()]
    ra, rb = (set(leaks.runs(*x)[1].tolist()) for x in ((a, pa, ha), (b, pb, hb)))
    shared = any((a[i : i + leaks.RUN] == b[j : j + leaks.RUN]).all() for i in range(len(a) - leaks.RUN + 1) for j in range(len(b) - leaks.RUN + 1))
    assert not shared or set(ha.tolist()) & set(hb.tolist()) and ra & rb


def test_long_items_and_documents():
    """A passage anywhere in long texts is found, and what is found agrees with a look at the whole texts."""
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(12)]
    for _ in range(60):
        item = [rnd.choice(common) if rnd.random() < 0.5 else f"i{rnd.randint(0, 400)}" for _ in range(rnd.choice([12, 30, 150]))]
        at, n = rnd.randrange(max(1, len(item) - 12)), rnd.randint(10, 40)
        piece = [w for w in item[at : at + n]]
        for _ in range(rnd.randint(0, n // 5)):
            k = rnd.randrange(len(piece))
            piece[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["new"]])
        doc = [*[rnd.choice(common) for _ in range(rnd.randint(0, 80))], *piece, *[rnd.choice(common) for _ in range(rnd.randint(0, 80))]]
        held = leaks.HeldOut.of([(5, " ".join(item))])
        hashes = leaks.Hashes()
        assert list(held.find([hashes.of(doc)])) == ([(0, 5)] if leaks.passage(hashes.of(item), hashes.of(doc)) else [])


# --- 8 ---


def test_levels(spark):
    rnd = random.Random(5)
    easy = lambda: " ".join(" ".join(rnd.choice(["jis", "ji", "namas", "bus", "eina", "kur"]) for _ in range(5)).capitalize() + "." for _ in range(20))
    hard = lambda: " ".join((", kadangi ".join(" ".join("hiperparadigm" + "".join(rnd.choice("aeiu") for _ in range(9)) for k in range(6)) for _ in range(4))).capitalize() + "." for _ in range(5))
    rows = [(k, easy() if k % 2 else hard()) for k in range(80)] + [(100, None), (101, ""), (102, "trumpas"), (103, easy() + " " + hard()[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x"))
    g = spark.createDataFrame([(k, (1 if k % 2 else 5), "r1") for k in range(40)] + [(1, 5, "r2"), (1, None, "r3"), (2, 9, "r1"), (3, 1, "r1")], "doc_id long, level int, rater string")
    got = {r["doc_id"]: r["level"] for r in levels.graded(df, g).collect()}
    assert all((got[k] >= 4) == (k % 2 == 0) for k in range(80)) and got[100] == got[101] == got[102] == 1
    assert len(got) == 84 and got[103] < 4
    assert levels.graded(df.limit(0), g).count() == 0
    assert {r["level"] for r in levels.graded(df, g.limit(0)).collect()} == {None}


def test_level_accuracy(spark):
    """Held out: documents whose two raters agree, judged by a scale that never saw their grades."""
    d = "/root/testdata/sf0.1"
    docs, grades = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_levels.parquet").dropna().distinct()
    g = grades.groupBy("doc_id").agg(F.min("level").alias("a"), F.max("level").alias("b"), F.count("*").alias("n")).where("a = b and n > 1")
    got = levels.graded(docs, grades.join(g, "doc_id", "left_anti")).join(g, "doc_id").select((F.col("level") >= 4).alias("p"), (F.col("a") >= 4).alias("t")).collect()
    assert len(got) > 50 and np.mean([r["p"] == r["t"] for r in got]) > 0.97


def test_equal_forms_have_equal_skeletons(spark):
    odd = [*forms.HYPHENS, "️", "͏", "ᅟ", "ㅤ", "​", "\x07", "\x7f", "́", "а", "o", "ﬁ", "ｏ", "ﾠ"]
    words = [f"b{a}o{b}c" for a in ["", "-", *odd] for b in ["", *odd]]
    by_form: dict[str, set] = {}
    for w in words:
        by_form.setdefault(forms.consistent(w), set()).add(forms.skeleton(w))
    assert len(by_form) > 5 and all(len(v) == 1 for v in by_form.values())
    df = spark.createDataFrame([("1", "vos-ne"), ("2", "vos‐ne"), ("3", "vos−ne️"), ("4", "kitas")], "id string, dial string")
    assert [[o["word"] for o in r["originals"]] for r in forms.word_groups(df, "id", ["dial"]).collect()] == [["vos-ne", "vos‐ne", "vos−ne️"]]
