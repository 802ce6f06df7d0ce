"""Queries over queues, embeddings, metrics and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.functions import text
from tarmill.operators import batches, joins, splits, tables, vectors
from tarmill.plans.registry import query
from tarmill.plans.split_queries import SHUFFLE
from tarmill.runtime import table
from tarmill.streaming import windows

QUEUE_SQL = "(select id, min(spk) as spk, min(queued_at) as queued_at, coalesce(max(len(ns)), 0) as w from std_queue group by id)"


def queue(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "std_queue").groupBy("id")
    return x.agg(F.min("spk").alias("spk"), F.min("queued_at").alias("queued_at"), F.coalesce(F.max(F.when(F.col("ns").isNotNull(), F.size("ns"))), F.lit(0)).alias("w"))


@query(f"select id, (row_number() over (order by id) - 1) // 265 + 1 as batch from {QUEUE_SQL}")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Queue records in batches of 265, numbered without a single-task window."""
    return batches.fixed(queue(spark, d).select("id"), ["id"], 265)


@query(f"""
with recursive q as (select spk, id, w, row_number() over (partition by spk order by id) as k from {QUEUE_SQL}),
  r as (select spk, id, k, 1 as chunk, 1 as n, w as total from q where k = 1 union all
    select q.spk, q.id, q.k, case when r.n >= 20 or r.total + q.w > 60 then r.chunk + 1 else r.chunk end, case when r.n >= 20 or r.total + q.w > 60 then 1 else r.n + 1 end,
      case when r.n >= 20 or r.total + q.w > 60 then q.w else r.total + q.w end from r join q on q.spk = r.spk and q.k = r.k + 1)
select spk, id, chunk from r""")
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each speaker's queue records in chunks of 20 records and 60 words to decide at most."""
    return batches.greedy(queue(spark, d), "spk", "id", "w", 20, 60)


NEXT_SQL = f"""
with q as (select id, min(spk) as spk, min(dial) as dial from std_queue group by id), c as (select *, left(id, 9) as session from q)
select id, coalesce(array_to_string(list_filter(list_value(lag(x, 3) over w, lag(x, 2) over w, lag(x) over w), lambda z: z is not null), ' | '), '') as before,
  coalesce(array_to_string(list_filter(list_value(lead(x) over w, lead(x, 2) over w), lambda z: z is not null), ' | '), '') as after
from (select *, dial as x from c) window w as (partition by session order by id)"""


@query(NEXT_SQL)
def neighbour_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines around each queue record in its session."""
    x = table(spark, d, "std_queue").groupBy("id").agg(F.min("spk").alias("spk"), F.min("dial").alias("dial")).withColumn("session", text.session_of(F.col("id")))
    y = batches.neighbours(x, ["session"], "id", "spk", "dial")
    return y.select("id", F.array_join("before", " | ").alias("before"), F.array_join("after", " | ").alias("after"))


@query(f"""
with x as (select id, left(id, 9) as session from {QUEUE_SQL}), r as (select *, row_number() over (partition by session order by id) - 1 as nth from x),
  b as (select session, id, floor((nth + {SHUFFLE.format('session')} % 5) / 5)::bigint as block_no from r)
select session, block_no, {SHUFFLE.format("session || '|' || block_no")} as picked, string_agg(id, ' ' order by id) as ids from b group by 1, 2 having count(*) = 5""")
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    """Unbroken runs of five queue records of a session, in seeded order."""
    x = batches.block_sample(queue(spark, d), "id", text.session_of(F.col("id")), 5)
    return x.withColumn("ids", F.array_join("ids", " "))


UNIT_SQL = "(select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"


@query(f"""
with u as {UNIT_SQL}, q as (select * from u where vec_id % 20 = 0), s as (select q.vec_id, u.vec_id as other, list_dot_product(q.v, u.v) as sim from q, u where u.vec_id <> q.vec_id)
select vec_id::varchar as vec_id, nth::int as nth, other::varchar as other, round(sim, 6) as sim from (select *, row_number() over (partition by vec_id order by sim desc, other::varchar) as nth from s) where nth <= 5""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, among all."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.nearest(x, x.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return n.withColumn("sim", F.round("sim", 6))


@query(f"""
with u as {UNIT_SQL}, s as (select q.label, q.vec_id, u.label as l2, list_dot_product(q.v, u.v) as sim, u.vec_id as other from u q, u where u.vec_id <> q.vec_id),
  k as (select *, row_number() over (partition by vec_id order by sim desc, other::varchar) as nth from s),
  b as (select label, vec_id, coalesce(max(sim) filter (l2 <> label), -1) as best from k where nth <= 20 group by 1, 2)
select label, count(*) as queries, round(avg(best), 6) as isolation from b group by label""")
def cluster_isolation(spark: SparkSession, d: str) -> DataFrame:
    """How near the nearest foreign vector is, on the mean of all vectors of a label, among 20 neighbours; -1 where all are own."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    n = vectors.nearest(x, x, "vec_id", "embedding", 20)
    lab = x.select(F.col("vec_id").cast("string").alias("vec_id"), "label")
    y = n.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("other"), F.col("label").alias("l2")), "other")
    best = y.groupBy("label", "vec_id").agg(F.coalesce(F.max(F.when(F.col("l2") != F.col("label"), F.col("sim"))), F.lit(-1.0)).alias("best"))
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("best"), 6).alias("isolation"))


@query(f"""
with u as {UNIT_SQL}, h as (select * from u where vec_id % 20 = 0), s as (select u.vec_id, max(list_dot_product(h.v, u.v)) as sim from h, u where u.vec_id % 20 <> 0 group by 1),
  n as (select count(*) as n from s)
select tau, round(1 - count(*) filter (sim < tau) / n, 6) as dropped from s, n, (select unnest([0.3, 0.4, 0.5, 1.01]::double[]) as tau) group by tau, n""")
def similarity_guard(spark: SparkSession, d: str) -> DataFrame:
    """Share of training vectors that a similarity limit to the held-out ones would drop, for several limits."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    held, rest = x.where("vec_id % 20 = 0"), x.where("vec_id % 20 <> 0")
    s = vectors.most_similar(rest, held, "vec_id", "embedding")
    t = F.explode(F.array(*[F.lit(v) for v in (0.3, 0.4, 0.5, 1.01)])).alias("tau")
    return s.select("sim", t).groupBy("tau").agg(F.round(1 - F.count_if(F.col("sim") < F.col("tau")) / F.count(F.lit(1)), 6).alias("dropped"))


@query(f"""
with u as (select *, label || '-' || vec_id % 5 as c from {UNIT_SQL}), z as (select c, count(*) as size from u group by c), n as (select sum(size) as n from z),
  o as (select c, coalesce(sum(size) over (order by {SHUFFLE.format('c')}, c rows between unbounded preceding and 1 preceding), 0) as b from z),
  h as (select * from u where c in (select c from o, n where b < 0.1 * n)), r as (select u.vec_id, any_value(u.label) as label, max(list_dot_product(h.v, u.v)) as sim from u, h where u.vec_id not in (select vec_id from h) group by 1),
  t as (select unnest([0.3, 0.4, 0.5, 1.01]::double[]) as tau), kept as (select tau, label, count(*) filter (sim < tau) as stay, count(*) as rest from r, t group by 1, 2),
  g as (select label, count(*) as n, count(*) filter (vec_id in (select vec_id from h)) as held from u group by 1)
select tau, round(sum(held * coalesce(stay, 0) / n) / sum(held), 6) as leak_mass, round(sum(case when stay > 0 then held else 0 end) / sum(held), 6) as leak_any, round(1 - sum(stay) / sum(rest), 6) as dropped
from (select * from t, g) left join kept using (tau, label) group by tau""")
def guard_leakage(spark: SparkSession, d: str) -> DataFrame:
    """What stays in training of the held-out clusters' labels if vectors too similar to held-out ones are dropped, by limit."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding", "label").withColumn("c", F.concat_ws("-", "label", (F.col("vec_id") % 5).cast("string")))
    held = x.join(splits.cluster_draw(x, "c", 0.1).select("c"), "c", "left_semi")
    rest = x.join(held.select("vec_id"), "vec_id", "left_anti")
    s = vectors.most_similar(rest, held, "vec_id", "embedding").join(rest.select("vec_id", "label"), "vec_id")
    return vectors.guarded(s, held, x, "label", [0.3, 0.4, 0.5, 1.01])


@query()
def speaker_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Purity of embedding clusters against labels."""
    x = table(spark, d, "embeddings").withColumn("bucket", F.lit("all"))
    c = vectors.cluster(x, "vec_id", "embedding", "bucket", micro=5, threshold=0.55)
    return vectors.purity(c.join(x.select("vec_id", "label"), "vec_id"), "cluster", "label")


@query(f"""
with c as (select left(id, 9) as cl, left(id, 7) as sp, count(*) as n from (select distinct id from clips where contains(id, '-')) group by 1, 2)
select (select sum(t) from (select max(n) as t from c group by cl)) / sum(n) as purity, (select sum(t) from (select max(n) as t from c group by sp)) / sum(n) as inverse_purity, count(distinct cl) as clusters, sum(n)::bigint as rows from c""")
def session_purity(spark: SparkSession, d: str) -> DataFrame:
    """Purity of sessions against speakers, both ways."""
    x = table(spark, d, "clips").where(text.is_dialect_id(F.col("id"))).select("id").distinct()
    return vectors.purity(x.select(text.session_of(F.col("id")).alias("c"), text.speaker_of(F.col("id")).alias("s")), "c", "s")


@query(f"""
with x as (select distinct id, left(id, 9) as c, left(id, 7) as s from clips where contains(id, '-')), z as (select c, count(*) as size from x group by c), n as (select sum(size) as n from z),
  o as (select c, size, coalesce(sum(size) over (order by {SHUFFLE.format('c')}, c rows between unbounded preceding and 1 preceding), 0) as b from z),
  h as (select c from o, n where b < 0.1 * n), g as (select s, count(*) as n, count(*) filter (c in (select c from h)) as h from x group by s)
select round(sum(case when n > h then h else 0 end) / sum(h), 9) as leak_any, round(sum(h * (n - h) / n) / sum(h), 9) as leak_mass, sum(h)::bigint as held from g where h > 0""")
def leak_mass(spark: SparkSession, d: str) -> DataFrame:
    """How much of the held-out sessions' speakers stays in training."""
    x = table(spark, d, "clips").where(text.is_dialect_id(F.col("id"))).select("id").distinct().select(text.session_of(F.col("id")).alias("c"), text.speaker_of(F.col("id")).alias("s"))
    y = vectors.leakage(x, splits.cluster_draw(x, "c", 0.1), "c", "s")
    return y.select(F.round("leak_any", 9).alias("leak_any"), F.round("leak_mass", 9).alias("leak_mass"), "held")


METRICS_SQL = """(select l_returnflag as model, l_linestatus as test, case l_linenumber % 2 when 0 then 's1' else 's2' end as seed, 100 * sum(l_discount) / sum(l_tax) as value, count(*) as n from lineitem group by 1, 2, 3)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax")
    g = x.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("test"), F.when(F.col("l_linenumber") % 2 == 0, "s1").otherwise("s2").alias("seed"))
    return g.agg((100 * F.sum("l_discount") / F.sum("l_tax")).alias("value"), F.count(F.lit(1)).alias("n"))


@query(f"select model, test, round(max(value) filter (seed = 's1'), 6) as s1, round(max(value) filter (seed = 's2'), 6) as s2 from {METRICS_SQL} group by 1, 2")
def wide_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Long metrics with a column for each seed."""
    x = tables.wide(metrics(spark, d), ["model", "test"], "seed", "value", ["s1", "s2"])
    return x.select("model", "test", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"))


@query(f"""with w as (select model, test, max(value) filter (seed = 's1') as s1, max(value) filter (seed = 's2') as s2 from {METRICS_SQL} group by 1, 2)
select test, round(sqrt(sum((s1 - s2) * (s1 - s2)) / (2 * count(*))), 6) as deviation, round(avg((s1 + s2) / 2), 6) as mean, round(min(s1), 6) as low, round(max(s1), 6) as high from w where s1 is not null and s2 is not null group by test""")
def seed_deviation(spark: SparkSession, d: str) -> DataFrame:
    x = tables.wide(metrics(spark, d), ["model", "test"], "seed", "value", ["s1", "s2"]).where("s1 is not null and s2 is not null")
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.groupBy("test").agg(r(tables.seed_deviation(x, "s1", "s2"), "deviation"), r(F.avg((F.col("s1") + F.col("s2")) / 2), "mean"), r(F.min("s1"), "low"), r(F.max("s1"), "high"))


@query(f"""with m as (select model, test, avg(value) as v from {METRICS_SQL} group by 1, 2), p as (select 'A' as a, 'R' as b union all select 'N', 'R')
select p.a, p.b, x.test, round(x.v - y.v, 6) as diff, round(100 * (y.v - x.v) / nullif(y.v, 0), 6) as gain from p join m x on x.model = p.a join m y on y.model = p.b and y.test = x.test""")
def model_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Differences and relative gains of named pairs of models."""
    m = metrics(spark, d).groupBy("model", "test").agg(F.avg("value").alias("v"))
    c = tables.contrasts(m, "model", "v", [("A", "R"), ("N", "R")], ["test"])
    y = m.select(F.col("model").alias("b"), "test", F.col("v").alias("base"))
    x = c.join(y, ["b", "test"])
    return x.select("a", "b", "test", F.round("diff", 6).alias("diff"), F.round(tables.relative_gain(F.col("base"), F.col("base") + F.col("diff")), 6).alias("gain"))


@query("""select l_suppkey as model, count(*) as n, count(*) filter (l_discount > 0.05) as e from lineitem group by 1""")
def recovered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Error counts recovered from percentages rounded to three digits, for suppliers, whose rows don't grow with the table."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count_if(F.col("l_discount") > 0.05) / F.count(F.lit(1)), 3).alias("p"))
    return g.select("model", "n", tables.recovered(F.col("p"), F.col("n")).alias("e"))


@query("""select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type: the batch form of the streaming aggregate (an extension)."""
    return windows.counts(table(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 6))


@query("""
with g as (select id, min(queued_at) as queued_at from std_queue where id is not null group by id having count(*) = 1),
  x as (select id, row_number() over (order by id) - 1 as given_at, row_number() over (order by queued_at nulls first, id) - 1 as got_at from g)
select id, given_at, got_at from x where given_at <> got_at""")
def order_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Queue records that were queued out of the order of their ids."""
    q = table(spark, d, "std_queue").select("id", "queued_at").where("id is not null")
    return joins.disordered(q, q, "id", ["id"], ["queued_at", "id"])


@query("select distinct id, strftime(queued_at, '%Y-%m-%d %H:%M') as at from std_queue")
def ledger_minutes(spark: SparkSession, d: str) -> DataFrame:
    """The minute at which each record was queued, as ledgers have it."""
    return table(spark, d, "std_queue").select("id", text.minute(F.col("queued_at")).alias("at")).distinct()


@query("""
with q as (select distinct id, list_filter(ns, lambda p: p is not null) as p from std_queue where len(list_filter(ns, lambda p: p is not null)) > 0),
  x as (select id, p, unnest(range(1, len(p) + 1)) as i from q)
select id, p[i] as place, max(i)::int as pick from x group by id, p, p[i]""")
def service_answers(spark: SparkSession, d: str) -> DataFrame:
    """Picks read from answers of a service that thinks aloud, with the queue's places in them."""
    q = table(spark, d, "std_queue").select("id", F.array_compact("ns").alias("p")).where(F.size("p") > 0).distinct()
    body = F.array_join(F.transform("p", lambda p, i: F.concat(F.lit('"'), p.cast("string"), F.lit('": "'), (i + 1).cast("string"), F.lit('"'))), ", ")
    a = q.select("id", F.concat(F.lit('<think>{"0": 9}</think> Answer: {'), body, F.lit("} {}")).alias("answer"))
    return a.select("id", F.explode(text.integer_answers(F.col("answer"))).alias("place", "pick"))


_SHARES = "select l_returnflag as model, l_linenumber as tag, 100.0 * count(*) filter (l_discount > 0.05) / count(*) as p from lineitem group by 1, 2"


@query(f"""
with m as ({_SHARES}), r as (select model, p as ref from m where tag = 1), b as (select tag, p - ref as base from m join r using (model) where model = 'A' and tag <> 1)
select model, tag, round(100 * (base - (p - ref)) / nullif(base, 0), 3) as gap_closed, round(p / nullif(ref, 0), 6) as ratio from m join r using (model) join b using (tag) where model <> 'A'""")
def gap_table(spark: SparkSession, d: str) -> DataFrame:
    """How far the gap of each tag to the reference tag closed against the base model, and the ratio of the two."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("tag")).agg((100 * F.count_if(F.col("l_discount") > 0.05) / F.count(F.lit(1))).alias("p"))
    m = m.join(m.where("tag = 1").select("model", F.col("p").alias("ref")), "model")  # a row for each model and tag
    base = m.where("model = 'A' and tag <> 1").select("tag", F.col("p").alias("bp"), F.col("ref").alias("br"))
    x = m.where("model <> 'A'").join(base, "tag")
    return x.select("model", "tag", F.round(tables.gap_closed(F.col("bp"), F.col("br"), F.col("p"), F.col("ref")), 3).alias("gap_closed"), F.round(F.col("p") / F.nullif(F.col("ref"), F.lit(0)), 6).alias("ratio"))


@query("""
with m as (select l_linenumber as dose, avg(l_quantity) as v from lineitem group by 1), e as (select arg_min(v, dose) as first, arg_max(v, dose) as last from m)
select dose, round(100 * (first - v) / nullif(first - last, 0), 3) as gain from m, e""")
def dose_gains(spark: SparkSession, d: str) -> DataFrame:
    """The share of the whole gain between the least and the greatest dose that each dose reaches."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("dose")).agg(F.avg("l_quantity").alias("v"))
    e = m.agg(F.min_by("v", "dose").alias("first"), F.max_by("v", "dose").alias("last"))  # one row
    return m.crossJoin(e).select("dose", F.round(tables.dose_gain(F.col("first"), F.col("last"), F.col("v")), 3).alias("gain"))
