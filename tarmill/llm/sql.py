"""SQL that the queries must equal, for those that SQL can express over whole tables."""

from __future__ import annotations

_BLANKS = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _code(c: str) -> str:
    return rf"nullif(upper(regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), '')"


_GENDER = r"""case when regexp_replace(lower(gender), '[^a-z]', '', 'g') in ('f', 'female', 'fem', 'woman', 'w', 'mot', 'moteris', 'moter', 'moteriska') then 'female'
    when regexp_replace(lower(gender), '[^a-z]', '', 'g') in ('m', 'male', 'man', 'vyr', 'vyras', 'vyriska') then 'male' end"""
_AGE = rf"regexp_replace(regexp_replace(lower(age_group), '{_BLANKS}+', '', 'g'), '[‐‑‒–—―−]', '-', 'g')"

_POPULATION = rf"""
  pop as (
    select speaker, max(g) gender, max(a) age_group from (
      select {_code('speaker_id')} speaker, {_GENDER} g,
        case when {_AGE} in ('0-17', '<18', '<=17', 'under18', 'iki18') then '0-17' when {_AGE} in ('18-60', '18-59') then '18-60'
          when {_AGE} in ('60+', '>60', '>=60', '+60', '60plus', 'over60', 'virš60') then '60+' end a
      from dial_speakers)
    where speaker is not null group by speaker having max(g) is not null and max(a) is not null),
  have as (select gender, age_group, count(*) n from pop group by 1, 2)"""

_SHARED = rf"""{_POPULATION},
  t as (
    select plan_id, gender, age_group, size::bigint as sample_size, greatest(coalesce(min_count, 0), ceil(coalesce(target_share, 0)::decimal(18, 8) * size))::bigint as quota, coalesce(n, 0) as available
    from (select distinct plan_id, gender, age_group, target_share, min_count, floor(coalesce(sample_fraction, 0)::decimal(18, 8) * (select count(*) from pop)) as size from sample_targets
      where plan_id is not null and gender is not null and age_group is not null) left join have using (gender, age_group)),
  o as (select *, least(quota, available) as own, available - least(quota, available) as spare, quota - least(quota, available) as unmet from t),
  s as (
    select *, greatest(0, least(spare, owed - before)) as to_siblings from (
      select *, sum(unmet) over (partition by plan_id, gender) as owed,
        coalesce(sum(spare) over (partition by plan_id, gender order by spare desc, age_group rows between unbounded preceding and 1 preceding), 0) as before from o)),
  u as (
    select * exclude (owed, before), spare - to_siblings as rest, case when row_number() over (partition by plan_id, gender order by age_group) = 1 then owed - sum(to_siblings) over (partition by plan_id, gender) else 0 end as up from s),
  plan as (
    select *, own + to_siblings + to_cousins as taken from (
      select *, greatest(0, least(rest, owed - before)) as to_cousins from (
        select *, sum(up) over (partition by plan_id) as owed,
          coalesce(sum(rest) over (partition by plan_id order by rest desc, gender, age_group rows between unbounded preceding and 1 preceding), 0) as before from u)))"""

SQL = {
    "p2_report": f"""with {_SHARED}
select plan_id, gender, age_group, sample_size, quota, available, own, to_siblings::bigint as to_siblings, to_cousins::bigint as to_cousins, taken::bigint as taken, available < quota as short from plan""",
    "p2_sample": f"""with {_SHARED},
  r as (
    select plan_id, speaker as speaker_id, gender, age_group, taken,
      row_number() over (partition by plan_id, gender, age_group order by ('0x' || substr(md5('2026|' || plan_id || '|' || speaker), 1, 15))::bigint) as nth
    from pop join plan using (gender, age_group))
select plan_id, speaker_id, gender, age_group from r where nth <= taken""",
    "p2_found": rf"""
with {_POPULATION},
  t as (
    select distinct plan_id, gender, age_group, target_share, min_count,
      floor(sample_fraction::decimal(18, 8) * (select count(*) from pop)) size
    from sample_targets)
select t.plan_id, t.gender, t.age_group from t left join have using (gender, age_group)
where coalesce(have.n, 0) < greatest(t.min_count, ceil(t.target_share::decimal(18, 8) * t.size))""",
    "p3_found": """
select distinct q.id, l.list_name from (
  select id, 'ns' list_name, ns p from std_queue union all select id, 'fix', fix from std_queue) q
join chunk_limits l using (list_name)
where len(list_distinct(q.p)) > l.capacity""",
    "p4_found": rf"""
with recursive
  e as (select distinct {_code('speaker_id')} u, {_code('same_as')} v from speaker_links),
  sym as (select u, v from e union select v, u from e),
  reach as (select u, v from sym where u is not null and v is not null union select r.u, s.v from reach r join sym s on r.v = s.u),
  person as (select u, least(min(v), u) p from reach group by u),
  s as (select distinct {_code('speaker_id')} u,
      case lower(regexp_replace(role, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) when 'seen' then 'train' when 'train' then 'train' when 'dev' then 'dev' when 'test' then 'test' end side
    from speakers),
  x as (select s.u, s.side, coalesce(p, s.u) p from s left join person using (u) where s.u is not null)
select distinct u speaker_id from x where p in (select p from x group by p having count(distinct side) > 1)""",
    "p6_texts": "select doc_id, coalesce(text, '') as text from documents",
}
