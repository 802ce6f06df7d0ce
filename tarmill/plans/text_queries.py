"""Queries over texts, words, tags and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.functions import text
from tarmill.operators import batches, bayes, joins, lexicon, scoring, standardise
from tarmill.plans import score_sql
from tarmill.plans.registry import query
from tarmill.plans.score_sql import N
from tarmill.runtime import table


def T(c: str) -> str:  # noqa: N802
    """SQL of text.tokens."""
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


REPS = 10_000
LAYERS_SQL = "(select distinct id, split, tier, dial, std, alignment from layers)"
PAIRS_SQL = f"""(select id, tier, unnest(range(least(len(d), len(s)))) as pos, d, s from (
  select id, tier, {T('dial')} as d, {T('std')} as s from {LAYERS_SQL} where dial is not null and std is not null))"""
WORDS_SQL = f"(select id, tier, pos::int as pos, d[pos + 1] as dial, s[pos + 1] as std from {PAIRS_SQL})"


def layers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layers").select("id", "split", "tier", "dial", "std", "alignment").distinct()


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.positional(layers(spark, d), ["id", "tier"], "dial", "std")


def clip_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips").select("id", "dataset_id", "region", F.explode(text.words(text.normalise(F.col("text_normalized")))).alias("word"))


def clip_lexicon(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("dataset_id") == "liepa3.phone", "read").otherwise("spon")
    return lexicon.counts(table(spark, d, "clips"), "text_normalized", part)


LEXICON_SQL = f"""(select word, count(*) filter (dataset_id = 'liepa3.phone') as read, count(*) filter (dataset_id is distinct from 'liepa3.phone') as spon
  from (select dataset_id, unnest(string_split({N('text_normalized')}, ' ')) as word from clips) where word <> '' group by word)"""


@query(f"select id, {N('dial')} as dial, {N('std')} as std from {LAYERS_SQL}")
def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).select("id", text.normalise(F.col("dial")).alias("dial"), text.normalise(F.col("std")).alias("std"))


@query("""select distinct id, left(id, 1) as region, left(id, 7) as speaker, left(id, 9) as session from clips where contains(id, '-')""")
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "clips").where(text.is_dialect_id(F.col("id"))).select("id").distinct()
    return x.select("id", text.region_of(F.col("id")).alias("region"), text.speaker_of(F.col("id")).alias("speaker"), text.session_of(F.col("id")).alias("session"))


@query(r"""select distinct split_id, string_split(trim(split_id), '.')[1] as corpus, string_split(trim(split_id), '.')[2] as side, string_split(trim(split_id), '.')[3] as version from split_ids""")
def split_labels(spark: SparkSession, d: str) -> DataFrame:
    p = F.split(F.trim("split_id"), r"\.")
    return table(spark, d, "split_ids").select("split_id").distinct().select("split_id", p[0].alias("corpus"), p[1].alias("side"), p[2].alias("version"))


@query(f"""select case when text_normalized is null or trim(text_normalized) = '' then 'empty_text' when coalesce(duration, -1) < 0 then 'unreadable'
    when duration not between 0.5 and 30 then 'length' when len({T('text_normalized')}) < 6 then 'short_text' else 'usable' end as reason, count(*) as n from clips group by 1""")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why clips can't be used, each counted under the first reason that holds."""
    t, s = F.col("text_normalized"), F.col("duration")
    reason = (
        F.when(t.isNull() | (F.trim(t) == ""), "empty_text").when(F.coalesce(s, F.lit(-1.0)) < 0, "unreadable").when(~s.between(0.5, 30), "length")
        .when(F.size(text.tokens(t)) < 6, "short_text").otherwise("usable")
    )
    return table(spark, d, "clips").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""select word, count(*) as n from (select unnest({T('std')}) as word from {LAYERS_SQL} where std is not null)
  where not regexp_matches(word, '{text.STANDARD_WORD}') group by word""")
def odd_words(spark: SparkSession, d: str) -> DataFrame:
    """Standard words that aren't well formed."""
    x = layers(spark, d).select(F.explode(text.tokens(F.col("std"))).alias("word"))
    return x.where(~F.col("word").rlike(text.STANDARD_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _known(c: str) -> str:
    return f"{c} in (select word from {LEXICON_SQL})"


@query(rf"""
with lex as {LEXICON_SQL}, w as (select distinct a.dial as dial, a.std as std from (select unnest(alignment) as a from {LAYERS_SQL})),
  t as (select dial, std, std in (select word from lex) as known, translate(std, 'ąęįų', 'aeiu') as s, translate(dial, 'ąęįų', 'aeiu') as e,
    coalesce(list_max(list_filter(range(least(length(dial), length(std)) + 1), lambda k: left(dial, k) = left(std, k))), 0) as p from w)
select case when dial = std then case when known then 'same' else 'kept' end when s = dial or s = e then 'nasal'
    when p >= 2 and length(dial) - p <= 3 and length(std) - p <= 3 then 'ending' else 'pron' end as tag, count(*) as pairs
from t where dial is not null and std is not null group by 1""")
def change_tags(spark: SparkSession, d: str) -> DataFrame:
    """How different word pairs of the alignments change."""
    w = layers(spark, d).select(F.explode("alignment").alias("a")).select("a.dial", "a.std").distinct().where("dial is not null and std is not null")
    lex = clip_lexicon(spark, d).select(F.col("word").alias("std"), F.lit(True).alias("known"))
    x = w.join(lex, "std", "left").withColumn("tag", standardise.change_tag(F.col("dial"), F.col("std"), F.coalesce("known", F.lit(False))))
    return x.groupBy("tag").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"select id, tier, pos, dial, std from {WORDS_SQL}")
def positional_words(spark: SparkSession, d: str) -> DataFrame:
    return word_pairs(spark, d)


@query(f"select word, read, spon from {LEXICON_SQL}")
def lexicon_counts(spark: SparkSession, d: str) -> DataFrame:
    return clip_lexicon(spark, d)


@query(f"""
with c as (select dial as form, std, count(*) as k from {WORDS_SQL} group by 1, 2),
  r as (select *, sum(k) over (partition by form) as n, row_number() over (partition by form order by k desc, std = form desc, std) as nth from c)
select form, n::bigint as n, std, round(k / n, 3) as share, case when k / n >= 0.9 and std = form then 'keep' when k / n >= 0.9 then 'std' else 'ctx' end as decision from r where nth = 1""")
def majority_map(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.vote(word_pairs(spark, d))


@query(f"""
with c as (select dial as form, std, count(*) as k from {WORDS_SQL} group by 1, 2),
  g as (select form, list(std order by k desc, std) as c from c group by form)
select form, case when len(c) > 1 then 'ctx' when c[1] = form then 'keep' else 'std' end as decision, case when len(c) = 1 then c[1] end as std,
  case when len(c) > 1 then array_to_string(c, ' ') end as cands from g""")
def variant_decisions(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.variants(word_pairs(spark, d)).withColumn("cands", F.array_join("cands", " "))


@query(f"""
with c as (select dial as form, std, count(*) as k from {WORDS_SQL} group by 1, 2),
  g as (select form, sum(k)::bigint as n, count(*) as outs, first(std order by k desc, std) as top, coalesce(sum(k) filter (std = form), 0)::bigint as unchanged from c group by form)
select form, n, outs, top, unchanged, unchanged > 0 and top <> form and unchanged * 4 <= n as oversight from g where outs > 1 and n >= 4""")
def inconsistent_forms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.inconsistent(word_pairs(spark, d))


STANDARD_TOKENS = 1_000_000


@query(f"""
with lex as {LEXICON_SQL}, n as (select dial as word, count(*) as n from {WORDS_SQL} group by 1), t as (select sum(n) as total from n),
  x as (select word, n, coalesce(read, 0) as read, coalesce(spon, 0) as spon, (n / total) / ((coalesce(read, 0) + coalesce(spon, 0) + 1) / {STANDARD_TOKENS}.0::double) as r from n left join lex using (word), t)
select word, n, read, spon, round(r, 1) as ratio, case when read < 3 then 'nonstd' else 'dialect' end as class from x where read < 3 or (r >= 10 and n >= 3)""")
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.classes(word_pairs(spark, d).select(F.col("dial").alias("word")), clip_lexicon(spark, d), STANDARD_TOKENS)


@query(f"select word, count(*) as n from (select unnest(string_split({N('text_normalized')}, ' ')) as word from clips) where word <> '' group by word order by n desc, word limit 50")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.top(clip_words(spark, d), 50)


@query(f"""
with c as (select word, left(id, 1) as region, count(*) as n from (select id, unnest(string_split({N('text_normalized')}, ' ')) as word from clips where contains(id, '-')) where word <> '' group by 1, 2)
select word, sum(n)::bigint as n, string_agg(region || ':' || n, ' ' order by region) as regions from c group by word""")
def region_spread(spark: SparkSession, d: str) -> DataFrame:
    x = clip_words(spark, d).where(text.is_dialect_id(F.col("id"))).select("word", text.region_of(F.col("id")).alias("region"))
    return lexicon.spread(x, "region", "word").withColumn("regions", F.array_join(F.transform("regions", lambda r: F.concat(r["region"], F.lit(":"), r["n"].cast("string"))), " "))


@query(f"""
with w as (select id, dial as line, unnest({T('dial')}) as word from {LAYERS_SQL} where dial is not null), f as (select word, line, min(id) as id from w group by 1, 2),
  r as (select *, row_number() over (partition by word order by id, line) as r from f)
select word, string_agg(line, ' | ' order by r) as contexts from r where r <= 3 group by word""")
def word_contexts(spark: SparkSession, d: str) -> DataFrame:
    x = layers(spark, d).select("id", F.col("dial").alias("line"), F.explode(text.tokens(F.col("dial"))).alias("word"))
    return lexicon.contexts(x, "word", "id", "line").withColumn("contexts", F.array_join("contexts", " | "))


def _maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = word_pairs(spark, d)
    reviewed = lexicon.variants(p.where("tier = 'gold'")).withColumnRenamed("form", "word")
    learned = lexicon.vote(p.where("tier = 'perclip'")).withColumnRenamed("form", "word")
    return reviewed, learned


MAPS_SQL = f"""
  rc as (select dial as word, std, count(*) as k from {WORDS_SQL} where tier = 'gold' group by 1, 2),
  rv as (select word, list(std order by k desc, std) as c from rc group by word),
  lc as (select dial as word, std, count(*) as k from {WORDS_SQL} where tier = 'perclip' group by 1, 2),
  lr as (select *, sum(k) over (partition by word) as n, row_number() over (partition by word order by k desc, std = word desc, std) as nth from lc),
  lv as (select word, std, k / n < 0.9 as ctx from lr where nth = 1)"""


@query(f"""
with lex as {LEXICON_SQL}, {MAPS_SQL},
  w as (select distinct dial as word from {WORDS_SQL}),
  x as (select w.word, rv.c, lv.std as ls, lv.ctx, coalesce(a.read, 0) as r, coalesce(b.read, 0) as nr,
      case when right(w.word, 1) in ('a', 'e', 'i', 'u') then left(w.word, length(w.word) - 1) || translate(right(w.word, 1), 'aeiu', 'ąęįų') end as nasal
    from w left join rv using (word) left join lv using (word) left join lex a on a.word = w.word
      left join lex b on b.word = case when right(w.word, 1) in ('a', 'e', 'i', 'u') then left(w.word, length(w.word) - 1) || translate(right(w.word, 1), 'aeiu', 'ąęįų') end)
select word, case when c is not null then c[1] when ls is not null then ls when r >= 3 and nr >= 5 * greatest(1, r) then nasal else word end as std,
  case when len(c) > 1 then 'r' when c is not null then 'R' when ctx then 'C' when ls is not null then 'M' when r >= 3 and nr >= 5 * greatest(1, r) then 'N' when r >= 3 then 'S' else 'U' end as src from x""")
def lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    """Standard form and source of every dialect word: reviewed, learned, lexicon, unknown."""
    reviewed, learned = _maps(spark, d)
    w = word_pairs(spark, d).select(F.col("dial").alias("word")).distinct()
    return joins.lookup_chain(w, reviewed, learned, clip_lexicon(spark, d))


@query(f"""
with {MAPS_SQL}, w as (select id, tier, pos, dial, std from {WORDS_SQL}),
  n as (select w.*, case when len(rv.c) > 1 then 'r' when rv.c is not null then 'R' when ctx then 'C' when lv.std is not null then 'M' else 'U' end as src,
    coalesce(rv.c[1], lv.std, dial) as new from w left join rv on rv.word = dial left join lv on lv.word = dial where tier = 'silver')
select src, count(*) as words, count(*) filter (new = std) as correct from n group by rollup (src)""")
def map_audit(spark: SparkSession, d: str) -> DataFrame:
    """How often the maps' forms equal those of the silver tier, by source and overall."""
    reviewed, learned = _maps(spark, d)
    silver = word_pairs(spark, d).where("tier = 'silver'")
    none = spark.createDataFrame([], "word string, read long")
    new = joins.lookup_chain(silver.select("id", "pos", F.col("dial").alias("word"), F.col("std").alias("truth")).distinct(), reviewed, learned, none)
    return standardise.audit(new, silver.select("id", "pos", "std").distinct())


@query(f"""
with {MAPS_SQL}, w as (select distinct dial as word from {WORDS_SQL}), lex as {LEXICON_SQL},
  x as (select w.word, rv.c, a.read as r1, b.read as r2,
      case when right(w.word, 1) in ('a', 'e', 'i', 'u') then left(w.word, length(w.word) - 1) || translate(right(w.word, 1), 'aeiu', 'ąęįų') end as v
    from w left join rv using (word) left join lex a on a.word = w.word
      left join lex b on b.word = case when right(w.word, 1) in ('a', 'e', 'i', 'u') then left(w.word, length(w.word) - 1) || translate(right(w.word, 1), 'aeiu', 'ąęįų') end),
  h as (select *, case when len(c) > 1 then 'C' when c[1] = word then '=' when c is not null then 'T' when r1 >= 3 and r2 >= 3 and r2 >= 0.05 * r1 then 'N' else '?' end as how from x)
select word, case how when 'T' then c[1] when '=' then word when '?' then word end as std, case how when 'C' then array_to_string(c, ' ') when 'N' then word || ' ' || v end as cands, how from h""")
def word_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each dialect word becomes without reading its context, or what is to be chosen from."""
    reviewed, _ = _maps(spark, d)
    w = word_pairs(spark, d).select(F.col("dial").alias("word")).distinct()
    return standardise.plan(w, reviewed, clip_lexicon(spark, d)).withColumn("cands", F.array_join("cands", " "))


@query(f"""
select id, pos, concat_ws(' ', 'b', 'p=' || p, 'n=' || n, 'ps=' || right(p, 2), 'ns=' || right(n, 2), 'ns1=' || right(n, 1), 'n2=' || m, 'pos=' || place) as features from (
  select id, tier, pos, coalesce(lag(dial) over w, '<s>') as p, coalesce(lead(dial) over w, '</s>') as n, coalesce(lead(dial, 2) over w, '</s>') as m,
    case when lag(dial) over w is null then 'first' when lead(dial) over w is null then 'last' else 'mid' end as place
  from (select distinct id, tier, pos, dial from {WORDS_SQL}) window w as (partition by id, tier order by pos))""")
def context_features(spark: SparkSession, d: str) -> DataFrame:
    p = word_pairs(spark, d).select("id", "tier", "pos", "dial").distinct()
    return lexicon.features(p, ["id", "tier"]).select("id", "pos", F.array_join("features", " ").alias("features"))


@query()
def context_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of naive Bayes and of the majority form, on silver words, after training on the other tiers."""
    texts = table(spark, d, "layers").select("id", "tier", "dial", "std")
    test = texts.where("tier = 'silver'")
    examples, words = (bayes.neighbours(t, ["id", "tier"]) for t in (texts.where("tier <> 'silver'"), test))
    open_ = lexicon.vote(examples).where("decision = 'ctx'").select(F.col("form").alias("dial"), F.col("std").alias("majority"))
    sizes = joins.positional(test, ["id"], "dial", "std").groupBy("dial").agg(F.count(F.lit(1)).alias("n"))
    x = bayes.predict(*(t.select("dial", "std", "prev", "next", "next2") for t in (words, examples)), open_, sizes)
    return x.agg(F.count(F.lit(1)).alias("words"), F.count_if(F.coalesce("predicted", "majority") == F.col("std")).alias("classifier_correct"), F.count_if(F.col("majority") == F.col("std")).alias("majority_correct"))


@query()
def rewrite_rules(spark: SparkSession, d: str) -> DataFrame:
    """Changes in context that several decided forms share."""
    v = lexicon.vote(word_pairs(spark, d)).where("decision = 'std'")
    return lexicon.rules(v.where(~F.col("std").contains("+")).select("form", "std"))


@query()
def near_misses(spark: SparkSession, d: str) -> DataFrame:
    """Unknown standard words that nearly spell a frequent one."""
    w = word_pairs(spark, d).where("dial <> std").select(F.col("std").alias("word"))
    return lexicon.near_miss(w, clip_lexicon(spark, d), least_read=5)


@query()
def moved_words(spark: SparkSession, d: str) -> DataFrame:
    """Words whose standard form belongs to another word of the line."""
    return standardise.moved(word_pairs(spark, d).distinct(), ["id", "tier"])


@query()
def slipped_words(spark: SparkSession, d: str) -> DataFrame:
    return standardise.slips(word_pairs(spark, d).distinct(), ["id", "tier"])


REPEAT_SQL = f"""select id, pos, dial, std from (select *, lag(std) over w as ps, lead(std) over w as ns, lag(dial) over w as pd, lead(dial) over w as nd
  from (select distinct id, tier, pos, dial, std from {WORDS_SQL}) window w as (partition by id, tier order by pos)) where dial <> std and ((ps = std and pd <> dial) or (ns = std and nd <> dial))"""


@query(REPEAT_SQL)
def adjacent_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Changed words whose neighbour has the same standard form for a different word."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id", "tier").orderBy("pos")
    x = word_pairs(spark, d).distinct().withColumns({"ps": F.lag("std").over(w), "ns": F.lead("std").over(w), "pd": F.lag("dial").over(w), "nd": F.lead("dial").over(w)})
    return x.where("dial <> std and ((ps = std and pd <> dial) or (ns = std and nd <> dial))").select("id", "pos", "dial", "std")


def _places(c: Column) -> Column:
    return F.array_compact(F.coalesce(c, F.array().cast("array<int>")))


@query(f"""select id, array_to_string([case when list_contains(f, i - 1) then '⟨' || w[i] || '⟩' else w[i] end for i in range(1, len(w) + 1)], ' ') as marked
  from (select distinct id, {T('dial')} as w, coalesce(fix, []) as f from std_queue)""")
def marked_dialect(spark: SparkSession, d: str) -> DataFrame:
    """Queue texts with the words to repair in angle brackets."""
    x = table(spark, d, "std_queue").select("id", text.tokens(F.col("dial")).alias("w"), F.coalesce("fix", F.array().cast("array<int>")).alias("f")).distinct()
    return x.select("id", batches.marked(F.col("w"), F.col("f")).alias("marked"))


@query(f"""select id, array_to_string([case when list_contains(f, i - 1) then '[' || len(list_filter(range(i), lambda k: list_contains(f, k))) || ']' else w[i] end for i in range(1, len(w) + 1)], ' ') as line
  from (select distinct id, {T('dial')} as w, list_filter(coalesce(ns, []), lambda p: p is not null) as f from std_queue)""")
def choice_lines(spark: SparkSession, d: str) -> DataFrame:
    """Queue texts with a numbered placeholder for each word to decide."""
    x = table(spark, d, "std_queue").select("id", text.tokens(F.col("dial")).alias("w"), _places(F.col("ns")).alias("f")).distinct()
    options = F.transform("w", lambda w, i: F.when(F.array_contains("f", i.cast("int")), F.array(w, F.concat(w, F.lit("?")))).otherwise(F.array(w)))
    return x.select("id", batches.choices(F.col("w"), options).alias("line"))


@query(f"""select id, pos, case when pos > 5 then '… ' else '' end || array_to_string(list_slice(w, greatest(1, pos - 4), pos + 6), ' ') || case when pos + 6 < len(w) then ' …' else '' end as context
  from (select id, w, unnest(p) as pos from (select distinct id, {T('dial')} as w, list_distinct(list_filter(fix, lambda x: x is not null)) as p from std_queue where fix is not null))""")
def repair_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Five words on either side of each word to repair."""
    x = table(spark, d, "std_queue").select("id", text.tokens(F.col("dial")).alias("w"), F.array_sort(F.array_distinct(F.array_compact("fix"))).alias("p")).distinct()
    return x.select("id", "w", F.explode("p").alias("pos")).distinct().select("id", "pos", batches.window(F.col("w"), F.col("pos"), 5).alias("context"))


@query(f"""
with a as (select id, min(dial) as dial from std_queue group by id), b as (select id, max({{'std': std, 'dial': dial}}) as g, count(*) as b from (select id, std, dial from layers where std is not null) group by id),
  n as (select id, count(*) as a from std_queue group by id)
select coalesce(n.id, b.id) as id, case when b.id is null then 'missing' when n.id is null then 'extra' when b.b > n.a then 'duplicate' end as status
from n full join b on n.id = b.id where b.id is null or n.id is null or b.b > n.a""")
def queue_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Queue records against layer records: missing, extra, duplicate."""
    return joins.reconcile(table(spark, d, "std_queue").select("id"), table(spark, d, "layers").where("std is not null").select("id"), "id")


@query(rf"""
with g as (select distinct id, dial, std, unsure from layers where std is not null), x as (select id, {T('dial')} as d, {T('std')} as s, coalesce(unsure, []) as u from g)
select id, 'word_count' as error from x where len(d) <> len(s) union all
select id, 'bad_word' from x where len(list_filter(s, lambda w: not regexp_matches(w, '{text.STANDARD_WORD}'))) > 0 union all
select id, 'bad_unsure' from x where len(list_filter(u, lambda p: p < 0 or p >= len(d))) > 0""")
def record_errors(spark: SparkSession, d: str) -> DataFrame:
    """Layer records that fail validation against their own dialect text."""
    g = table(spark, d, "layers").where("std is not null").select("id", "dial", "std", "unsure").distinct()
    return standardise.validate(g.select("id", "dial"), g.select("id", "std", "unsure"))


RULES = [("dabar", None, "dabartės"), ("nu", ["nu"], "na"), ("kap", None, "kaip")]


@query(f"""
with w as (select distinct id, tier, pos, dial, std from {WORDS_SQL}),
  a as (select *, case when dial = 'dabar' then 'dabartės' else std end as s1 from w), b as (select *, case when dial = 'nu' and s1 = 'nu' then 'na' else s1 end as s2 from a),
  c as (select *, case when dial = 'kap' then 'kaip' else s2 end as s3 from b)
select id, pos, dial, std, s3 as new from c where s3 <> std""")
def ordered_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Words that an ordered table of rewrites changes."""
    w = word_pairs(spark, d).distinct().withColumns({"unsure": F.lit(False), "was": F.col("std")})
    x = standardise.ordered(w, standardise.word_rules(RULES), ["id", "tier"])
    return x.where("std <> was").select("id", "pos", "dial", F.col("was").alias("std"), F.col("std").alias("new"))


@query(f"""
with r as (select *, case tier when 'gold' then 0 when 'perclip' then 1 else 2 end as rank from (select distinct id, tier, dial, std from layers))
select id, dial, std, tier from (select *, row_number() over (partition by id order by rank, dial, std) as nth from r) where nth = 1""")
def assembled_layer(spark: SparkSession, d: str) -> DataFrame:
    """One record an id: from the gold tier if it is there, else perclip, else silver."""
    x = table(spark, d, "layers").select("id", "tier", "dial", "std").distinct()
    return standardise.layered(*[(t, x.where(F.col("tier") == t).drop("tier")) for t in ("gold", "perclip", "silver")])


@query(score_sql.TOTALS)
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pooled error rates of clip transcripts against the layers."""
    return scoring.totals(scores(spark, d))


def references(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).groupBy("id").agg(F.min(F.struct("dial", "std", "alignment")).alias("r")).select("id", "r.*")


def scores(spark: SparkSession, d: str) -> DataFrame:
    hyps = table(spark, d, "clips").groupBy("id").agg(F.min("text_normalized").alias("hyp"))
    return scoring.clip_scores(references(spark, d), hyps)


@query(f"""
with r as (select id, min({{'dial': dial, 'std': std}}) as r from {LAYERS_SQL} group by id), h as (select id, min(text_normalized) as hyp from clips group by id),
  x as (select r.id, {N('r.r.dial')} as d, {N('r.r.std')} as s, h.hyp is null as missing from r left join h using (id))
select case when contains(id, '-') then left(id, 7) else id end as spk, count(*) as clips, sum(len(list_filter(string_split(d, ' '), lambda w: w <> '')))::bigint as n,
  sum(len(list_filter(string_split(s, ' '), lambda w: w <> '')))::bigint as n_std, sum(length(d))::bigint as chars, count(*) filter (missing) as missing from x group by 1""")
def score_denominators(spark: SparkSession, d: str) -> DataFrame:
    """Words, characters and missing transcripts of every speaker."""
    x = scores(spark, d).groupBy("spk").agg(F.count(F.lit(1)).alias("clips"), F.sum("n").alias("n"), F.sum("n_std").alias("n_std"), F.sum("chars").alias("chars"), F.count_if("missing").alias("missing"))
    return x


@query(score_sql.BY_REGION)
def score_by_region(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_region(scoring.by_speaker(scores(spark, d)))


@query(score_sql.BY_TAG)
def score_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_tag(scores(spark, d))


@query(score_sql.SPEAKER_MEAN)
def score_speaker_mean(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mean_over_speakers(scoring.by_speaker(scores(spark, d)))


@query(score_sql.INTERVAL)
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the share of changed words, resampling speakers."""
    x = table(spark, d, "layers").where("alignment is not null").select("id", "alignment").distinct()
    s = x.groupBy(text.speaker_of(F.col("id")).alias("spk")).agg(F.sum(F.size("alignment")).alias("n"), F.sum(F.size(F.filter("alignment", lambda z: z["tag"] != "same"))).alias("e"))
    return scoring.bootstrap(s, "e", "n", reps=REPS)


@query(score_sql.PAIRED)
def bootstrap_paired(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference in dialect error between clip transcripts and standard texts as hypotheses."""
    refs = references(spark, d)
    other = scoring.clip_scores(refs, refs.select("id", F.col("std").alias("hyp")))
    return scoring.bootstrap(scoring.by_speaker(scores(spark, d)), "e_dial", "n", scoring.by_speaker(other), reps=REPS)


@query(f"""
with g as (select id, min(dial) as dial, min(std) as std from layers where tier = 'gold' and std is not null group by id), c as (select id, min(text_normalized) as std from clips group by id),
  x as (select {T('g.dial')} as d, {T('g.std')} as s, {T('c.std')} as t from g join c using (id) where c.std is not null),
  y as (select d, s, t from x where len(d) = len(s) and len(s) = len(t))
select count(*) as records, sum(len(s))::bigint as words, sum(len(list_filter(range(1, len(s) + 1), lambda i: s[i] = t[i])))::bigint as agree,
  count(*) filter (len(list_filter(range(1, len(s) + 1), lambda i: s[i] <> t[i])) = 0) as exact,
  sum(len(list_filter(range(1, len(s) + 1), lambda i: d[i] <> s[i] or d[i] <> t[i])))::bigint as changed,
  sum(len(list_filter(range(1, len(s) + 1), lambda i: (d[i] <> s[i] or d[i] <> t[i]) and s[i] = t[i])))::bigint as changed_agree from y""")
def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Gold standard texts and clip transcripts compared word by word."""
    g = table(spark, d, "layers").where("tier = 'gold' and std is not null").groupBy("id").agg(F.min("dial").alias("dial"), F.min("std").alias("std"))
    c = table(spark, d, "clips").groupBy("id").agg(F.min("text_normalized").alias("std"))
    return joins.agreement(g, c)


@query(f"select ch, count(*) as n from (select unnest(string_split({N('text_normalized')}, '')) as ch from clips) where ch not in ('', ' ') group by ch")
def character_set(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "clips").select(F.explode(F.split(text.normalise(F.col("text_normalized")), "")).alias("ch"))
    return x.where("ch not in ('', ' ')").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
