"""Vocabulary mining: word counts, majority maps, variant decisions, contexts, near misses, rewrite rules, context features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmill.functions import text


SALT = 16  # parts of a frequent prefix


def counts(rows: DataFrame, words: str, part: Column) -> DataFrame:
    """(word, read, spon): uses of each word in read and in spontaneous texts; part is a string column of those two values."""
    x = rows.select(part.alias("part"), F.explode(text.words(text.normalise(F.col(words)))).alias("word"))
    return x.groupBy("word").agg(F.count_if(F.col("part") == "read").alias("read"), F.count_if(F.col("part") == "spon").alias("spon"))


def vote(pairs: DataFrame, form: str = "dial", out: str = "std", least: float = 0.9) -> DataFrame:
    """(form, n, std, share, decision) by majority over (form, out) pairs: keep if the form itself has the share, std if another
    has, else ctx. Of equally frequent outs the form itself, then the least, is taken."""
    c = pairs.groupBy(F.col(form).alias("form"), F.col(out).alias("std")).agg(F.count(F.lit(1)).alias("k"))
    own = (F.col("std") == F.col("form")).cast("int")
    order = Window.partitionBy("form").orderBy(F.desc("k"), F.desc(own), "std")
    x = c.withColumns({"n": F.sum("k").over(Window.partitionBy("form")), "at": F.row_number().over(order)}).where("at = 1")
    share = F.col("k") / F.col("n")
    decision = F.when((share >= least) & (own == 1), "keep").when(share >= least, "std").otherwise("ctx")
    return x.select("form", "n", "std", F.round(share, 3).alias("share"), decision.alias("decision"))


def variants(pairs: DataFrame, form: str = "dial", out: str = "std") -> DataFrame:
    """(form, decision, std, cands): keep or std if one out was ever seen, else ctx with all of them, most frequent first."""
    c = pairs.groupBy(F.col(form).alias("form"), F.col(out).alias("std")).agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy("form").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "std"))).alias("c"))
    first = F.element_at("c", 1)["std"]
    one = F.size("c") == 1
    return g.select("form", F.when(~one, "ctx").when(first == F.col("form"), "keep").otherwise("std").alias("decision"), F.when(one, first).alias("std"), F.when(~one, F.transform("c", lambda s: s["std"])).alias("cands"))


def inconsistent(pairs: DataFrame, form: str = "dial", out: str = "std", least: int = 4) -> DataFrame:
    """(form, n, outs, top, unchanged, oversight) of forms with several outs and at least `least` uses; oversight: most uses are
    changed to one out and at most a quarter stay as they are."""
    c = pairs.groupBy(F.col(form).alias("form"), F.col(out).alias("std")).agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy("form").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("outs"), F.min_by("std", F.struct((-F.col("k")).alias("k"), "std")).alias("top"),
        F.coalesce(F.sum(F.when(F.col("std") == F.col("form"), F.col("k"))), F.lit(0)).alias("unchanged"),
    ).where((F.col("outs") > 1) & (F.col("n") >= least))
    return g.withColumn("oversight", (F.col("unchanged") > 0) & (F.col("top") != F.col("form")) & (F.col("unchanged") * 4 <= F.col("n")))


def classes(words: DataFrame, lexicon: DataFrame, standard_tokens: int, ratio: float = 10.0) -> DataFrame:
    """(word, n, read, spon, ratio, class) of words that need a decision: nonstd where fewer than three read texts have them,
    dialect where they are `ratio` times as frequent here as in the standard corpus and occur three times.

    words: (word) uses; lexicon: (word, read, spon).
    """
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))  # one row
    x = n.join(lexicon, "word", "left").crossJoin(total).select("word", "n", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("spon", F.lit(0)).alias("spon"), "total")
    r = (F.col("n") / F.col("total")) / ((F.col("read") + F.col("spon") + 1) / F.lit(float(standard_tokens)))
    x = x.withColumn("r", r).withColumn("class", F.when(F.col("read") < 3, "nonstd").when((F.col("r") >= ratio) & (F.col("n") >= 3), "dialect"))
    return x.where(F.col("class").isNotNull()).select("word", "n", "read", "spon", F.round("r", 1).alias("ratio"), "class")


def top(words: DataFrame, k: int) -> DataFrame:
    """(word, n) of the k most frequent words, ties by the word; a partial top k in each task, never a full sort."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def spread(rows: DataFrame, region: str, word: str) -> DataFrame:
    """(word, regions array<struct<region, n>>) of each word, regions in order."""
    c = rows.groupBy(word, region).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(word).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(region, "n"))).alias("regions"))


def contexts(rows: DataFrame, word: str, key: str, line: str, k: int = 3) -> DataFrame:
    """(word, contexts) of the first k different lines, in the order of key, that hold each word.

    Each task keeps k lines a word before the shuffle: min_by over distinct lines needs one row a word and line.
    """
    first = rows.groupBy(word, line).agg(F.min(key).alias(key))
    order = Window.partitionBy(word).orderBy(key, line)
    return first.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).groupBy(word).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", line))), lambda s: s[line]).alias("contexts"))


def near_miss(words: DataFrame, lexicon: DataFrame, least_read: int = 20, cutoff: float = 0.85, prefix: int = 3) -> DataFrame:
    """(word, suggest, score) of unknown words of five letters and more that nearly spell a frequent word with the same first
    letters. lexicon: (word, read, spon).

    Words meet by prefix and a part, a hash of the unknown word: a frequent prefix is spread over SALT tasks, and the lexicon's
    words of a prefix go to each. The best suggestion of each word is kept by a partial aggregation, ties by the greater word.
    """
    w = words.select("word").distinct().where((F.length("word") >= 5) & ~F.col("word").contains("+"))
    w = w.join(lexicon.where("read + spon > 0").select("word"), "word", "left_anti").withColumns({"__p": F.substring("word", 1, prefix), "__s": F.pmod(F.xxhash64("word"), F.lit(SALT))})
    c = lexicon.where(F.col("read") >= least_read).select(F.col("word").alias("suggest"), F.substring("word", 1, prefix).alias("__p"))
    c = c.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    # no match of that score can differ more in length
    close = (2 * F.least(F.length("word"), F.length("suggest")) >= cutoff * (F.length("word") + F.length("suggest")))
    x = w.join(c, ["__p", "__s"]).where(close).select("word", "suggest", text.ratio(F.col("suggest"), F.col("word")).alias("score"))
    return x.where(F.col("score") >= cutoff).groupBy("word").agg(F.max(F.struct("score", "suggest")).alias("b")).select("word", "b.suggest", "b.score")


def rules(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(left, old, new, right, n): changes with a letter of context that at least `least` different (form, std) pairs show."""
    x = pairs.distinct().select(F.explode(text.edits_in_context("form", "std")).alias("e")).select("e.*")
    return x.groupBy("left", "old", "new", "right").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rewrite(words: DataFrame, learned: DataFrame, lexicon: DataFrame, edits: int = 2, beam: int = 200, limit: int = 50_000) -> DataFrame:
    """(word, candidate, score) of the known words that up to `edits` learned changes make of each word.

    A change scores the log of its count, a candidate half the log of its uses more. The rules are broadcast: more than
    `limit` of them raise an error. Candidate forms are joined with the lexicon, which is never broadcast.
    """
    rs = [tuple(r) for r in learned.select("left", "old", "new", "right", "n").limit(limit + 1).collect()]
    if len(rs) > limit:
        raise ValueError(f"more than {limit} rules")
    known = words.sparkSession.sparkContext.broadcast(sorted((a + b + d, a + c + d, math.log(n)) for a, b, c, d, n in rs))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w in pdf["word"]:
                frontier, found = {f"^{w}$": 0.0}, {}
                for _ in range(edits):
                    nxt: dict[str, float] = {}
                    for form, score in frontier.items():
                        for pattern, made, gain in known.value:
                            at = form.find(pattern)
                            while at >= 0:
                                f = form[:at] + made + form[at + len(pattern) :]
                                nxt[f] = max(nxt.get(f, -math.inf), score + gain)
                                at = form.find(pattern, at + 1)
                    for f, s in nxt.items():
                        if (c := f.strip("^$")) and s > found.get(c, -math.inf):
                            found[c] = s
                    frontier = dict(sorted(nxt.items(), key=lambda x: (-x[1], x[0]))[:beam])
                out += [(w, c, s) for c, s in found.items()]
            yield pd.DataFrame(out, columns=["word", "candidate", "s"])

    made = words.select("word").distinct().mapInPandas(forms, "word string, candidate string, s double")
    x = made.join(lexicon.where("read >= 3").select(F.col("word").alias("candidate"), "read"), "candidate")
    return x.select("word", "candidate", (F.col("s") + 0.5 * F.log("read")).alias("score"))


def confident(scored: DataFrame, margin: float = 1.0) -> DataFrame:
    """(word, candidate) whose best candidate leads the second by `margin`."""
    order = Window.partitionBy("word").orderBy(F.desc("score"), "candidate")
    x = scored.withColumns({"at": F.row_number().over(order), "next": F.lead("score").over(order)}).where("at = 1")
    return x.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)).select("word", "candidate")


def features(pairs: DataFrame, key: list[str], word: str = "dial") -> DataFrame:
    """pairs (key, pos, word, ...) with an array of context features of each word: neighbours, their ends, place in the line."""
    w = Window.partitionBy(*key).orderBy("pos")
    c = F.col(word)
    prev, nxt, nxt2 = F.lag(c).over(w), F.lead(c).over(w), F.lead(c, 2).over(w)
    x = pairs.withColumns({"__p": F.coalesce(prev, F.lit("<s>")), "__n": F.coalesce(nxt, F.lit("</s>")), "__m": F.coalesce(nxt2, F.lit("</s>")), "__place": F.when(prev.isNull(), "first").when(nxt.isNull(), "last").otherwise("mid")})
    tail = lambda col, k: F.right(F.col(col), F.lit(k))
    made = F.array(
        F.lit("b"), F.concat(F.lit("p="), "__p"), F.concat(F.lit("n="), "__n"), F.concat(F.lit("ps="), tail("__p", 2)), F.concat(F.lit("ns="), tail("__n", 2)),
        F.concat(F.lit("ns1="), tail("__n", 1)), F.concat(F.lit("n2="), "__m"), F.concat(F.lit("pos="), "__place"),
    )
    return x.withColumn("features", made).drop("__p", "__n", "__m", "__place")
