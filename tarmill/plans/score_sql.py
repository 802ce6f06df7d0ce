"""SQL of the scoring queries: edit tables and either-form alignment as recursive queries, row by row of each table."""

from __future__ import annotations


def N(c: str) -> str:  # noqa: N802
    """SQL of text.normalise."""
    return rf"trim(regexp_replace(lower(nfc_normalize(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def W(c: str) -> str:  # noqa: N802
    """SQL of the words of a normalised text."""
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


# one-byte signs that no normalised text holds; each letter of a pair beyond ASCII becomes one of them, as the distance counts bytes
_FREE = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and not c.isdigit()).replace("'", "''")

REFERENCES = """refs as (
    select id, dial, std, alignment from (
      select *, row_number() over (partition by id order by dial nulls first, std nulls first, alignment nulls first) as nth from (select distinct id, dial, std, alignment from layers))
    where nth = 1)"""


_SPK = "case when contains(id, '-') then left(id, 7) else id end"
_V, _C = "(1208925819614629174706176::hugeint)", "(1099511627776::hugeint)"  # 2^80 and 2^40


def scored(hyps: str, tag: str = "1", third: bool = False) -> str:
    """Common tables: `edits` of each reference's two texts (p = 3 k and 3 k + 1; if third, 3 k + 2 is one against the other), and `done`, the either-form errors of each tag,
    or in all. hyps: (id, hyp) as SQL."""
    return f"""
  {REFERENCES}, hyps as ({hyps}),
  norm as (select id, row_number() over (order by id) as k, hyp is null as missing, alignment, {N('dial')} as d, {N('std')} as s, {N('hyp')} as h from refs left join hyps using (id)),
  txt as materialized (select *, {W('d')} as dw, {W('s')} as sw, {W('h')} as hw, len({W('h')}) as m from norm),
  pairs as materialized (
    select k * 3 as p, dw as r, hw, m, len(dw) as n from txt union all select k * 3 + 1, sw, hw, m, len(sw) from txt union all select k * 3 + 2, dw, sw, len(sw), len(dw) from txt where {str(third).lower()}),
  refw as materialized (select p, n, unnest(range(1, n + 1)) as i, unnest(r) as w from pairs),
  -- a state is the cost of a place times 2^20, and the substitutions
  grid as (
    select p, 0::bigint as i, j, case when j > 0 then hw[j] end as w, j << 20 as v from pairs, unnest(range(m + 1)) as t(j)
    union all
    select p, i, j, w, min(v - (j << 20)) over (partition by p order by j rows unbounded preceding) + (j << 20) from (
      select g.p, x.i, g.j, g.w, least(g.v + (1 << 20), lag(g.v) over (partition by g.p order by g.j) + case when x.w = g.w then 0 else (1 << 20) + 1 end) as v
      from grid g join refw x on x.p = g.p and x.i = g.i + 1)),
  edits as materialized (select p, v >> 20 as cost, v & 1048575 as sub, n, m from grid join pairs using (p) where i = n and j = m),
  slot as materialized (
    select k, i, tag, o1, o2, greatest(len(o1), len(o2), 1) as steps from (
      select k, i, z.tag as tag, {W(N('z.dial'))} as o1, {W(N('z.std'))} as o2 from (select k, unnest(range(1, len(alignment) + 1)) as i, unnest(alignment) as z from txt where len(alignment) > 0))
    union all
    select k, i, 'same', [w], [w], 1 from (select k, unnest(range(1, len(dw) + 1)) as i, unnest(dw) as w from txt where len(coalesce(alignment, [])) = 0)),
  tags as materialized (select tag, row_number() over (order by tag nulls first) as g from (select distinct {tag} as tag from slot)),
  step as materialized (
    select k, row_number() over (partition by k order by i, t) as s, g as tg, o1[t] as w1, o2[t] as w2, t = steps as last
    from (select k, i, {tag} as tag, o1, o2, steps, unnest(range(1, steps + 1)) as t from slot) u join tags on u.tag is not distinct from tags.tag),
  -- a state for each tag: cost times (m + 1) plus what is left after the run's begin, the cost before the run, the tag's errors
  -- before it; packed into one number by factors of 2^40, so that the least number is the state of least cost and latest begin
  walk as (
    select k, g, 0::bigint as s, j, m, case when j > 0 then hw[j] end as w, (j * (m + 1) + m - j)::hugeint * {_V} as a, (j * (m + 1) + m - j)::hugeint * {_V} as b
    from txt, unnest(range(m + 1)) as t(j), tags
    union all
    select k, g, s + 1, j, m, w, case when last then fresh else a end, case when last then fresh else b end from (
      select *, (cost * (m + 1) + m - j) * {_V} + cost * {_C} + low % {_C} + case when g = tg then cost - low % {_V} // {_C} else 0 end as fresh from (
        select *, least(a, b) as low, least(a, b) // {_V} // (m + 1) as cost from (
          select k, g, s, j, m, w, tg, last, case when w1 is null then a else min(ca - j * (m + 1) * {_V}) over run + j * (m + 1) * {_V} end as a,
            case when w2 is null then b else min(cb - j * (m + 1) * {_V}) over run + j * (m + 1) * {_V} end as b from (
            select q.*, x.tg, x.w1, x.w2, x.last, least(a + (m + 1) * {_V}, lag(a) over line + case when x.w1 = q.w then 0 else (m + 1) * {_V} end) as ca,
              least(b + (m + 1) * {_V}, lag(b) over line + case when x.w2 = q.w then 0 else (m + 1) * {_V} end) as cb
            from walk q join step x on x.k = q.k and x.s = q.s + 1 window line as (partition by q.k, q.g order by q.j))
          window run as (partition by k, g order by j rows unbounded preceding))))),
  ends as materialized (select k, max(s) as s, arg_max(tg, s) as tg from step group by k),
  done as materialized (
    select k, g, cost + m - j as cost, e + case when g = tg then m - j else 0 end as e from (
      select w.k, w.g, w.j, w.m, n.tg, w.a % {_V} // {_C} as cost, w.a % {_C} as e, row_number() over (partition by w.k, w.g order by w.a % {_V} // {_C} - w.j, w.j) as nth
      from walk w join ends n on n.k = w.k and n.s = w.s) where nth = 1)"""


def counted(hyps: str, tag: str = "1") -> str:
    """scored() and `clip`: one row for each reference, with all counters."""
    return f"""{scored(hyps, tag)},
  clip as (
    select {_SPK} as spk, len(dw) as n, len(sw) as n_std, a.cost as e_dial, b.cost as e_std, coalesce(done.cost, t.m) as e_either,
      a.sub, (a.cost - a.sub + a.n - a.m) // 2 as del, (a.cost - a.sub - a.n + a.m) // 2 as ins, length(d) as chars, missing,
      levenshtein(translate(d, odd, '{_FREE}'), translate(h, odd, '{_FREE}')) as e_char
    from (select *, array_to_string(list_distinct(regexp_extract_all(d || h, '[^ -~]')), '') as odd from txt) t join edits a on a.p = t.k * 3 join edits b on b.p = t.k * 3 + 1 left join done on done.k = t.k)"""


def speakers(hyps: str) -> str:
    """scored() and `by_spk`: words and dialect errors of each speaker."""
    return f"""{scored(hyps)}, by_spk as (select {_SPK} as spk, sum(n) as n, sum(cost) as e from txt join edits on p = k * 3 group by 1)"""


CLIPS = "select id, min(text_normalized) as hyp from clips group by id"


def pct(a: str, b: str) -> str:
    return f"round(100 * {a} / nullif({b}, 0), 3)"


TOTALS = f"""with recursive {counted(CLIPS)}
select count(*) as clips, sum(n)::bigint as words, sum(n_std)::bigint as words_standard, {pct('sum(e_dial)', 'sum(n)')} as wer_dialect, {pct('sum(e_std)', 'sum(n_std)')} as wer_standard,
  {pct('sum(e_either)', 'sum(n)')} as wer_either, {pct('sum(e_char)', 'sum(chars)')} as cer_dialect, sum(sub)::bigint as sub, sum(del)::bigint as del, sum(ins)::bigint as ins,
  count(*) filter (missing) as missing_hyps from clip"""

BY_REGION = f"""with recursive {speakers(CLIPS)} select left(spk, 1) as region, {pct('sum(e)', 'sum(n)')} as wer_dialect from by_spk group by 1"""

SPEAKER_MEAN = f"""with recursive {speakers(CLIPS)} select round(coalesce(sum(100 * e / nullif(n, 0)), 0) / greatest(1, count(*)), 3) as wer_mean_over_speakers from by_spk"""

BY_TAG = f"""with recursive {scored(CLIPS, 'tag')},
  err as (select g, sum(e)::bigint as errors from done group by g), many as (select tag, count(*) as slots from slot group by tag)
select tags.tag, slots, errors, {pct('errors', 'slots')} as err_pct from many join tags on many.tag is not distinct from tags.tag join err using (g)"""

_NUMBERED = "k as (select *, row_number() over (order by spk) - 1 as nth, count(*) over () as n from spk)"
_DRAWN = """draw as (
    select rep, ('0x' || substr(h, (1 + 16 * part)::int, 15))::bigint % n as nth from (
      select rep, n, k, part, md5('2026-' || rep || '-' || k) as h from (select unnest(range(10000)) as rep), (select n, unnest(range((n + 1) // 2)) as k from (select max(n) as n from k)), (select unnest([0, 1]) as part))
    where 2 * k + part < n)"""
_ENDS = "round(v[floor(0.025 * len(v))::int + 1], 3) as low, round(v[floor(0.975 * len(v))::int + 1], 3) as high"

INTERVAL = f"""
with spk as (select left(id, 7) as spk, sum(len(alignment))::bigint as w, sum(len(list_filter(alignment, lambda z: z.tag <> 'same')))::bigint as e
    from (select distinct id, alignment from layers where alignment is not null) group by 1),
  {_NUMBERED}, {_DRAWN},
  v as (select rep, 100 * sum(e) / sum(w) as v from draw join k using (nth) group by rep), s as (select list(v order by v) as v from v)
select {_ENDS} from s"""

PAIRED = f"""with recursive {scored(CLIPS, third=True)},
  spk as (select {_SPK} as spk, sum(txt_n)::bigint as w, sum(a)::bigint as e, sum(c)::bigint as e2 from (
    select id, len(dw) as txt_n, x.cost as a, z.cost as c from txt join edits x on x.p = k * 3 join edits z on z.p = k * 3 + 2) group by 1),
  {_NUMBERED}, {_DRAWN},
  v as (select rep, 100 * sum(e) / sum(w) - 100 * sum(e2) / sum(w) as v from draw join k using (nth) group by rep), s as (select list(v order by v) as v from v)
select {_ENDS} from s"""
