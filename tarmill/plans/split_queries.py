"""Queries that build, guard and describe splits, samples and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmill.functions import text
from tarmill.operators import joins, splits
from tarmill.plans.registry import query
from tarmill.runtime import table

# one row a clip id, the last loaded
CLIPS_SQL = """(select id, c.dataset_id as dataset_id, c.speaker_id as speaker_id, c.region as region, c.gender as gender, c.age_group as age_group,
    case when c.duration >= 0 then c.duration end as duration, c.text_normalized as text_normalized, c.recorded_at as recorded_at
  from (select id, max_by({'dataset_id': dataset_id, 'speaker_id': speaker_id, 'region': region, 'gender': gender, 'age_group': age_group, 'duration': duration,
    'text_normalized': text_normalized, 'recorded_at': recorded_at}, loaded_at) as c from clips group by id))"""
IDS_SQL = r"(select distinct trim(split_id) as split_id, regexp_replace(id, '^\s+|\s+$', '', 'g') as id from split_ids)"
SHUFFLE = "('0x' || substr(md5('2026|' || {}), 1, 15))::bigint"
FACTS_SQL = f"""(select speaker_id, min(region) as region, min(gender) as gender, min(age_group) as age_group, count(*) as clips, coalesce(sum(duration), 0.0) as sec
  from {CLIPS_SQL} where speaker_id is not null group by speaker_id)"""
BIN_SQL = "len(list_filter([0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30.001], lambda e: e <= duration)) - 1"


def clips(spark: SparkSession, d: str) -> DataFrame:
    return splits.clean_clips(table(spark, d, "clips"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_ids").select(F.trim("split_id").alias("split_id"), F.regexp_replace("id", r"^\s+|\s+$", "").alias("id")).distinct()


def facts(spark: SparkSession, d: str) -> DataFrame:
    return splits.speaker_facts(clips(spark, d))


@query(f"select id, dataset_id, speaker_id, duration from {CLIPS_SQL}")
def clean_clips(spark: SparkSession, d: str) -> DataFrame:
    return clips(spark, d).select("id", "dataset_id", "speaker_id", "duration")


@query(f"select speaker_id, region, gender, age_group, clips, round(sec, 3) as sec from {FACTS_SQL}")
def speaker_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).withColumn("sec", F.round("sec", 3))


@query(f"""select split_id, count(*) as listed, count(c.id) as found, count(*) filter (c.id is null) as missing from {IDS_SQL} s left join (select distinct id from clips) c using (id) group by split_id""")
def list_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many ids of each list have a clip."""
    return joins.coverage(lists(spark, d), table(spark, d, "clips").select("id"), "id", "split_id")


@query(f"select distinct id from clips where id not in (select id from {IDS_SQL})")
def unlisted_clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips").select("id").distinct().join(lists(spark, d).select("id"), "id", "left_anti")


@query(r"""select split_id, id, count(*) - 1 as excess from (select trim(split_id) as split_id, regexp_replace(id, '^\s+|\s+$', '', 'g') as id from split_ids) group by 1, 2 having count(*) > 1""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "split_ids").select(F.trim("split_id").alias("split_id"), F.regexp_replace("id", r"^\s+|\s+$", "").alias("id"))
    return x.groupBy("split_id", "id").agg((F.count(F.lit(1)) - 1).alias("excess")).where("excess > 0")


@query(f"""
with e as (select sha1(id) as h, id from {CLIPS_SQL} where dataset_id = 'liepa3.phone'),
  b as (select id, (('0x' || substr(h, 1, 8))::bigint * 1) as a1, ('0x' || substr(h, 9, 8))::bigint as a2, ('0x' || substr(h, 17, 8))::bigint as a3, ('0x' || substr(h, 25, 8))::bigint as a4, ('0x' || substr(h, 33, 8))::bigint as a5 from e),
  m as (select id, ((((a1 % 100 * 96 + a2) % 100 * 96 + a3) % 100 * 96 + a4) % 100 * 96 + a5) % 100 as b from b)
select id, b, case b when 0 then 'test' when 1 then 'dev' else 'train' end as side from m""")
def published_split(spark: SparkSession, d: str) -> DataFrame:
    """The published side of telephone ids: SHA-1 modulo 100."""
    x = clips(spark, d).where("dataset_id = 'liepa3.phone'")
    return x.select("id", text.sha1_mod(F.col("id"), 100).alias("b"), text.published_split(F.col("id")).alias("side"))


@query(f"""
with x as (select id, sha1(audio.bytes) as h, array_to_string(regexp_split_to_array(trim(text_normalized), '\\s+'), ' ') as t from (select id, any_value(audio) as audio, min(text_normalized) as text_normalized from clips where dataset_id = 'liepa3.phone' group by id)),
  s as (select x.*, split_part(split_part(i.split_id, '.', 2), '.', 1) as side from x join {IDS_SQL} i using (id) where split_part(i.split_id, '.', 1) = 'phone'),
  held as (select * from s where side <> 'train')
select case when side = 'train' and (h in (select h from held where h is not null) or (len(string_split(t, ' ')) >= 6 and t in (select t from held where t is not null))) then 'excluded' else side end as placed, count(*) as n from s group by 1""")
def repeats_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Telephone clips by side after training clips that repeat held-out audio or text are excluded."""
    c = table(spark, d, "clips").where("dataset_id = 'liepa3.phone'").groupBy("id").agg(F.sha1(F.min("audio.bytes")).alias("h"), F.min("text_normalized").alias("t"))
    side = lists(spark, d).where("split_id like 'phone.%'").select("id", F.split("split_id", r"\.")[1].alias("side"))
    return joins.exclude_repeats(c.join(side, "id"), "side", "h", "t").groupBy("placed").agg(F.count(F.lit(1)).alias("n"))


HELD_SQL = f"(select id from {IDS_SQL} where split_part(split_id, '.', 2) in ('test', 'dev', 'seen', 'excluded'))"
ROLE_SQL = r"(select distinct upper(trim(speaker_id)) as speaker_id from speakers where lower(trim(role)) in ('test', 'dev'))"


@query(f"""
with t as (select distinct id from {IDS_SQL} where split_part(split_id, '.', 2) = 'train')
select id, 'id' as why from t where id in {HELD_SQL} union all select id, 'speaker' from t where contains(id, '-') and left(id, 7) in {ROLE_SQL}""")
def training_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Training ids that are held out or whose speaker is."""
    x = lists(spark, d).withColumn("side", F.split("split_id", r"\.")[1])
    held = x.where(F.col("side").isin("test", "dev", "seen", "excluded")).select("id")
    s = table(spark, d, "speakers").where(F.lower(F.trim("role")).isin("test", "dev")).select(F.upper(F.trim("speaker_id")).alias("speaker_id"))
    return joins.leaks(x.where("side = 'train'").select("id"), held, s)


@query(f"""select gender, age_group, {BIN_SQL} as bin, count(*) as clips, round(sum(duration) / 3600, 6) as hours from {CLIPS_SQL} where duration is not null group by 1, 2, 3""")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    x = clips(spark, d).where("duration is not null").withColumn("bin", text.length_bin(F.col("duration"), splits.EDGES))
    return x.groupBy("gender", "age_group", "bin").agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query(f"""select dataset_id, split_part(s.split_id, '.', 2) as side, count(*) as clips, round(sum(duration) / 3600, 6) as hours, count(distinct speaker_id) as speakers
  from {IDS_SQL} s join {CLIPS_SQL} c using (id) group by 1, 2""")
def split_hours(spark: SparkSession, d: str) -> DataFrame:
    x = lists(spark, d).join(clips(spark, d), "id").withColumn("side", F.split("split_id", r"\.")[1])
    return x.groupBy("dataset_id", "side").agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.countDistinct("speaker_id").alias("speakers"))


LEAST_SEC = 60.0


def _order_sql(rows: str) -> str:
    return f"(select *, {SHUFFLE.format('speaker_id')} as o from {rows})"


@query(f"""
with f as (select *, {SHUFFLE.format('speaker_id')} as o from {FACTS_SQL} where sec >= {LEAST_SEC}),
  a as (select *, case when gender = 'male' then row_number() over (partition by region, gender order by o, speaker_id) end as n0,
      case when gender = 'female' then row_number() over (partition by region, gender order by o, speaker_id) end as n1,
      case when age_group = '18-60' then row_number() over (partition by region, age_group order by o, speaker_id) end as n2,
      case when age_group = '60+' then row_number() over (partition by region, age_group order by o, speaker_id) end as n3 from f),
  g as (select *, case when n0 = 1 then 0 when n1 = 1 then 1 end as g from a),
  m as (select *, coalesce(max((g is not null and age_group = '18-60')::int) over (partition by region), 0) as m2, coalesce(max((g is not null and age_group = '60+')::int) over (partition by region), 0) as m3 from g),
  p as (select *, coalesce(g, case when n2 = 1 and m2 = 0 then 2 end, case when n3 = 1 and m3 = 0 then 3 end, 9) as pri from m)
select speaker_id, region from (select *, row_number() over (partition by region order by pri, o, speaker_id) as nth from p) where nth <= 3""")
def held_out_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Three test speakers a region, covering gender and age where the region can."""
    return splits.held_out_pick(facts(spark, d), 3, LEAST_SEC)


BLOCK_SEC = 300.0


@query(f"""
with c as (select id, speaker_id, coalesce(duration, 0.0) as dur from {CLIPS_SQL} where speaker_id is not null),
  r as (select *, sum(dur) over (partition by speaker_id order by id rows unbounded preceding) - dur as cum, sum(dur) over (partition by speaker_id) as total from c),
  s as (select speaker_id, arg_min(cum, {{'o': {SHUFFLE.format('id')}, 'id': id}}) as start from r where total - cum >= {BLOCK_SEC} group by speaker_id),
  k as (select r.* from r left join s using (speaker_id) where total <= {BLOCK_SEC} or (cum - start >= 0 and cum - start < {BLOCK_SEC}))
select speaker_id, count(*) as clips, min(id) as first_id, max(id) as last_id, round(sum(dur), 3) as sec from k group by 1""")
def contiguous_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Five unbroken minutes of each speaker."""
    x = clips(spark, d).where("speaker_id is not null").select("id", "speaker_id", "duration")
    k = splits.contiguous_block(x, BLOCK_SEC)
    return k.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("clips"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.round(F.sum(F.coalesce("duration", F.lit(0.0))), 3).alias("sec"))


DOSE_SQL = f"""
  h as (select speaker_id, region, sec / 3600 as hours, {SHUFFLE.format('speaker_id')} as o from {FACTS_SQL}),
  r as (select *, row_number() over (partition by region order by o, speaker_id) as round from h),
  w as (select speaker_id, region, round, row_number() over (order by round, region) as place, round(sum(hours) over (order by round, region rows unbounded preceding), 2) as cum_hours from r)"""


@query(f"with {DOSE_SQL} select speaker_id, region, round, place, cum_hours from w")
def dose_order(spark: SparkSession, d: str) -> DataFrame:
    """Speakers in turns of one a region, with running hours."""
    return splits.dose_order(facts(spark, d).withColumn("hours", F.col("sec") / 3600))


DOSES = [0.25, 0.5, 1.0, 2.0, 5.0]


@query(f"with {DOSE_SQL} select dose, min(place) as speakers, arg_min(cum_hours, place) as hours from w, (select unnest({DOSES}::double[]) as dose) where cum_hours >= dose group by dose")
def dose_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The least prefix of the dose order that reaches each dose."""
    return splits.dose_prefix(dose_order(spark, d), DOSES)


CELL = ["gender", "age_group", "bin"]
TARGET_SQL = f"""t as (select gender, age_group, {BIN_SQL} as bin, sum(duration) * 0.3 as target from {CLIPS_SQL} where duration is not null and gender is not null and age_group is not null group by 1, 2, 3)"""
HELD_TEXT_SQL = rf"""(select distinct t from (select trim(regexp_replace(text_normalized, '\s+', ' ', 'g')) as t from {CLIPS_SQL} join {IDS_SQL} using (id) where split_id in ('phone.test.v1', 'phone.dev.v1'))
  where len(string_split(t, ' ')) >= 6)"""
CAND_SQL = rf"""c as (select id, gender, age_group, {BIN_SQL} as bin, duration from {CLIPS_SQL} where duration between 0.5 and 30 and gender is not null and age_group is not null and left(id, 1) <> 'A'
    and trim(regexp_replace(text_normalized, '\s+', ' ', 'g')) <> '' and trim(regexp_replace(text_normalized, '\s+', ' ', 'g')) not in (select t from {HELD_TEXT_SQL} where t is not null))"""


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = clips(spark, d).where("duration is not null and gender is not null and age_group is not null").withColumn("bin", text.length_bin(F.col("duration"), splits.EDGES))
    target = x.groupBy(*CELL).agg((F.sum("duration") * 0.3).alias("target"))
    # candidates that have no text or repeat one of the other data's held-out texts of six words and more are no candidates
    plain = F.trim(F.regexp_replace("text_normalized", r"\s+", " "))
    listed = lists(spark, d).where(F.col("split_id").isin("phone.test.v1", "phone.dev.v1"))
    held = clips(spark, d).join(listed, "id").select(plain.alias("__t")).where(F.size(F.split("__t", " ")) >= 6).distinct()
    x = x.withColumn("__t", plain).where("__t <> ''").join(held, "__t", "left_anti")
    cand = x.where((F.col("duration").between(0.5, 30)) & (text.region_of(F.col("id")) != "A")).select("id", *CELL, "duration")
    return cand, target


@query(f"""
with {TARGET_SQL}, {CAND_SQL},
  o as (select c.*, target, coalesce(sum(duration) over (partition by c.gender, c.age_group, c.bin order by {SHUFFLE.format('id')}, id rows between unbounded preceding and 1 preceding), 0.0) as b from c join t using (gender, age_group, bin))
select gender, age_group, bin, count(*) as clips, round(sum(duration), 3) as sec from o where b < target group by 1, 2, 3""")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    """Clips of other regions that match three tenths of every gender, age and length cell."""
    cand, target = _pool(spark, d)
    k = splits.quota_fill(cand, target, CELL, "duration")
    return k.groupBy(*CELL).agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration"), 3).alias("sec"))


@query()
def quota_back_fill(spark: SparkSession, d: str) -> DataFrame:
    """Spare clips that fill the cells in which the quota fell short, nearest length first."""
    cand, target = _pool(spark, d)
    taken = splits.quota_fill(cand, target, CELL, "duration")
    spare = cand.join(taken.select("id"), "id", "left_anti")
    missing = splits.shortfall(target, taken, CELL, "duration")
    return splits.back_fill(spare, missing, ["gender", "age_group"], "bin", "duration")


@query(f"""
with x as (select id, left(id, 9) as c from {CLIPS_SQL} where contains(id, '-')), s as (select c, count(*) as size from x group by c), n as (select sum(size) as n from s),
  o as (select c, size, coalesce(sum(size) over (order by {SHUFFLE.format('c')}, c rows between unbounded preceding and 1 preceding), 0) as b from s)
select c as session, size from o, n where b < 0.1 * n""")
def session_draw(spark: SparkSession, d: str) -> DataFrame:
    """Whole sessions of any size up to a tenth of all clips."""
    x = clips(spark, d).where(text.is_dialect_id(F.col("id"))).select(text.session_of(F.col("id")).alias("session"))
    return splits.cluster_draw(x, "session", 0.1)


@query(f"""
with r as (select region, split_part(split_id, '.', 2) as side, count(*) as clips, sum(duration) / 3600 as hours from {IDS_SQL} join {CLIPS_SQL} c using (id) where contains(id, '-') group by 1, 2),
  k as (select distinct region as left_out from r where region is not null)
select left_out, sum(clips)::bigint as clips, round(sum(hours), 6) as hours from k, r where side = 'train' and region <> left_out group by left_out""")
def leave_region_out(spark: SparkSession, d: str) -> DataFrame:
    """Training clips and hours without each region, from sums by region."""
    x = lists(spark, d).join(clips(spark, d), "id").where(text.is_dialect_id(F.col("id")) & (F.split("split_id", r"\.")[1] == "train"))
    every = lists(spark, d).join(clips(spark, d), "id").where(text.is_dialect_id(F.col("id"))).select(F.col("region").alias("left_out")).where("left_out is not null").distinct()
    r = x.groupBy("region").agg(F.count(F.lit(1)).alias("clips"), (F.sum("duration") / 3600).alias("hours"))
    y = r.join(F.broadcast(every), F.col("region") != F.col("left_out"))  # regions against regions: letters of an id
    return y.groupBy("left_out").agg(F.sum("clips").alias("clips"), F.round(F.sum("hours"), 6).alias("hours"))


@query(f"""
with p as (select split_id, split_part(split_id, '.', 1) as corpus, count(*) as clips, round(sum(duration) / 3600, 6) as hours, count(distinct speaker_id) as speakers from {IDS_SQL} join {CLIPS_SQL} c using (id) where split_part(split_id, '.', 2) = 'train' group by 1, 2),
  r as (select 'S' as recipe_id, 'phone' as corpus, 'spoken' as layer union all select 'S+D', 'phone', 'spoken' union all select 'S+D', 'dial', 'dial' union all select 'D', 'dial', 'std')
select recipe_id, string_agg(split_id || ':' || layer || ':' || clips, ';' order by split_id) as parts, sum(clips)::bigint as clips, round(sum(hours), 6) as hours from r join p using (corpus) group by recipe_id""")
def recipe_parts(spark: SparkSession, d: str) -> DataFrame:
    """Training recipes resolved to lists, layers, clips and hours."""
    x = lists(spark, d).where(F.split("split_id", r"\.")[1] == "train").join(clips(spark, d), "id")
    p = x.groupBy("split_id", F.split("split_id", r"\.")[0].alias("corpus")).agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration") / 3600, 6).alias("hours"))
    r = spark.createDataFrame([("S", "phone", "spoken"), ("S+D", "phone", "spoken"), ("S+D", "dial", "dial"), ("D", "dial", "std")], "recipe_id string, corpus string, layer string")
    y = p.join(F.broadcast(r), "corpus").withColumn("part", F.concat_ws(":", "split_id", "layer", F.col("clips").cast("string")))
    return y.groupBy("recipe_id").agg(F.array_join(F.array_sort(F.collect_list("part")), ";").alias("parts"), F.sum("clips").alias("clips"), F.round(F.sum("hours"), 6).alias("hours"))


@query(f"""
select coalesce(g, '?') as gender, coalesce(a, '?') as age_group, n, round(hours, 6) as hours from (select gender as g, age_group as a, count(*) as n, sum(duration) / 3600 as hours from {CLIPS_SQL} where contains(id, '-') group by grouping sets ((gender, age_group), ()))""")
def hours_with_total(spark: SparkSession, d: str) -> DataFrame:
    x = clips(spark, d).where(text.is_dialect_id(F.col("id")))
    g = x.groupingSets([["gender", "age_group"], []], "gender", "age_group").agg(F.count(F.lit(1)).alias("n"), (F.sum("duration") / 3600).alias("hours"))
    return g.select(F.coalesce("gender", F.lit("?")).alias("gender"), F.coalesce("age_group", F.lit("?")).alias("age_group"), "n", F.round("hours", 6).alias("hours"))


@query(f"select count(*) - count(distinct h) as excess from (select sha1(any_value(audio).bytes) as h from clips group by id)")
def excess_audio(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose audio another clip has already."""
    x = table(spark, d, "clips").groupBy("id").agg(F.sha1(F.min("audio.bytes")).alias("h"))
    return x.agg((F.count(F.lit(1)) - F.countDistinct("h")).alias("excess"))


@query(f"""
select c.region, count(*) as clips, count(distinct c.speaker_id) as speakers, round(avg(f.sec), 6) as mean_sec from {CLIPS_SQL} c join {FACTS_SQL} f on f.speaker_id = c.speaker_id group by 1""")
def strict_facts(spark: SparkSession, d: str) -> DataFrame:
    """Clips by region with the facts of their speakers, each of which must be known."""
    x = clips(spark, d).where("speaker_id is not null").select("id", "speaker_id", "region")
    y = joins.strict(x, facts(spark, d).select("speaker_id", "sec"), "speaker_id")
    return y.groupBy("region").agg(F.count(F.lit(1)).alias("clips"), F.countDistinct("speaker_id").alias("speakers"), F.round(F.avg("sec"), 6).alias("mean_sec"))
