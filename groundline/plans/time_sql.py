"""The SQL that the time and interval queries are checked against: an own reading of the formats, by splitting texts into fields."""

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_ABBR = ("MAP {'UTC': 0, 'GMT': 0, 'Z': 0, 'BST': 60, 'CET': 60, 'CEST': 120, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'JST': 540, 'IST': 330, 'AEST': 600, 'AEDT': 660}")
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_Z = r"\s*(Z|UTC|GMT|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?|[A-Za-z_]+/[A-Za-z_/]+)?(?:\[[A-Za-z_/]+\])?"
# name of the form, pattern, and the fields of its groups
_FORMS = [
    ("cal", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_HMS}{_Z})?$", "y mo d h mi s f z"),
    ("cal", rf"(?i)^(\d{{4}})/(\d{{2}})/(\d{{2}})(?:[T ]{_HMS}{_Z})?$", "y mo d h mi s f z"),
    ("cal", r"(?i)^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*(Z|[+-]\d{2}(?::?\d{2})?)?$", "y mo d h mi s f z"),
    ("cal", rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[T ]{_HMS}{_Z})?$", "d mo y h mi s f z"),
    ("cal", rf"(?i)^(?:[a-z]{{3}}, )?(\d{{1,2}})[- ]([a-z]{{3}})[- ](\d{{4}})(?: {_HMS}{_Z})?$", "d mo y h mi s f z"),
    ("cal", rf"(?i)^([a-z]{{3}}) (\d{{1,2}}), (\d{{4}})(?: {_HMS}\s*(AM|PM)?{_Z})?$", "mo d y h mi s f ap z"),
    ("ord", rf"(?i)^(\d{{4}})-(\d{{3}})(?:[T ]{_HMS}{_Z})?$", "y d h mi s f z"),
    ("week", rf"(?i)^(\d{{4}})-W(\d{{2}})-(\d)(?:[T ]{_HMS}{_Z})?$", "y mo d h mi s f z"),
]


def _fields(pattern, names):
    g = names.split()
    pick = ", ".join(f"'{n}'" for n in g)
    have = f"regexp_extract(raw, '{pattern}', [{pick}])"
    return "{" + ", ".join(f"'{n}': {have}.{n}" if n in g else f"'{n}': ''" for n in "y mo d h mi s f ap z".split()) + "}"


def instants(values: str) -> str:
    """CTEs that end in `inst`: the columns of `values` (with raw and zone) and instant_us, null where raw names none."""
    kind = "case " + " ".join(f"when regexp_matches(raw, '{p}') then '{k}'" for k, p, _ in _FORMS) + " end"
    fields = "case " + " ".join(f"when regexp_matches(raw, '{p}') then {_fields(p, n)}" for _, p, n in _FORMS) + " end"
    off = lambda t: f"(epoch_us(timezone(rule, make_timestamptz({t}))) - ({t}))"
    frac = "(substr(rpad(coalesce(x.f, ''), 6, '0'), 1, 6))::bigint"
    return f"""v as ({values}), u as (select distinct raw, zone from v),
a as (select raw, zone, {kind} kind, {fields} x from u),
b as (select *, coalesce(try_cast(x.mo as bigint), nullif(list_position({_MONTHS}, lower(x.mo)), 0)) mo, try_cast(x.y as bigint) y, try_cast(x.d as bigint) dd,
  coalesce(try_cast(x.h as bigint), 0) h0, coalesce(try_cast(x.mi as bigint), 0) mi, coalesce(try_cast(x.s as bigint), 0) s from a),
c as (select *, case when y = 0 then null
    when kind = 'cal' then try_cast(x.y || '-' || lpad(mo::varchar, 2, '0') || '-' || lpad(x.d, 2, '0') as date)
    when kind = 'ord' and dd > 0 and year(make_date(y, 1, 1) + (dd - 1)::int) = y then make_date(y, 1, 1) + (dd - 1)::int
    when kind = 'week' and mo between 1 and 53 and dd between 1 and 7
      and isoyear(date_trunc('week', make_date(y, 1, 4)) + to_days((mo * 7 - 7)::int)) = y then (date_trunc('week', make_date(y, 1, 4)) + to_days((mo * 7 - 8 + dd)::int))::date end dt,
  case when coalesce(x.ap, '') = '' then h0 when h0 between 1 and 12 then h0 % 12 + case when upper(x.ap) = 'PM' then 12 else 0 end end h from b),
e as (select *, case when h < 24 and mi < 60 and s < 60 then epoch_us(dt::timestamp) + ((h * 60 + mi) * 60 + s) * 1000000 end wall,
  case when x.z = '' then zone when contains(x.z, '/') then x.z end rule,
  case when regexp_matches(x.z, '^[+-]\\d') then case when x.z[1] = '-' then -1 else 1 end *
    (case when (substr(x.z, 2, 2)::bigint * 60 + coalesce(try_cast(right(replace(substr(x.z, 4), ':', ''), 2) as bigint), 0)) <= 1080
      then substr(x.z, 2, 2)::bigint * 60 + coalesce(try_cast(right(replace(substr(x.z, 4), ':', ''), 2) as bigint), 0) end)
    else {_ABBR}[upper(x.z)] end mins from c),
g as (select *, {off('wall - 86400000000')} o1, {off('wall + 86400000000')} o2 from e),
k as (select *, case when rule is null then wall - mins * 60000000
    when {off('wall - o1')} = o1 then wall - o1 when {off('wall - o2')} = o2 then wall - o2 else wall - o1 end us from g),
w as (select raw, zone, case when regexp_matches(raw, '^\\d{{1,11}}\\.\\d+$') then split_part(raw, '.', 1)::bigint * 1000000 + substr(rpad(split_part(raw, '.', 2), 6, '0'), 1, 6)::bigint
  when regexp_matches(raw, '^\\d{{1,11}}$') then raw::bigint * 1000000 when regexp_matches(raw, '^\\d{{12,14}}$') then raw::bigint * 1000
  when regexp_matches(raw, '^\\d{{15,17}}$') then raw::bigint else us + {frac} end instant_us from k),
inst as (select v.*, instant_us from v join w using (raw, zone))"""


_tz = f"(select {_STRIP.format('environment')} env, min(tz_name) tz_name from environments group by 1)"
_env = _STRIP.format("(scope::json ->> 'environment')")
VALUES = f"""select t table_name, f field_name, id record_id, raw, coalesce(tz_name, 'UTC') zone from (
  select 'claims' t, 'observed_at' f, {_STRIP.format('claim_id')} id, {_STRIP.format('observed_at')} raw, {_env} env from claims
  union all select 'claims', 'valid_from', {_STRIP.format('claim_id')}, {_STRIP.format('valid_from')}, {_env} from claims
  union all select 'evidence', 'observed_at', {_STRIP.format('evidence_id')}, {_STRIP.format('observed_at')}, {_STRIP.format('environment')} from evidence) left join {_tz} using (env)
  where raw <> '' and id <> ''"""
_group = "select table_name, field_name, record_id, min(instant_us) instant_us from inst where instant_us is not null {} group by 1, 2, 3"
P2_INSTANTS = f"with {instants(VALUES)} {_group.format('')}"
P2_FOUND = "with " + instants(VALUES) + _group.format(r" and not regexp_matches(raw, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$')").replace("select", " select", 1)
_claims = f"""select {_STRIP.format('claim_id')} id, min({_STRIP.format('subject')}) subject, min({_STRIP.format('valid_from')}) raw, min({_STRIP.format('valid_to')}) fin,
  coalesce(min(tz_name), 'UTC') zone from (select *, {_env} env from claims) left join {_tz} using (env) where {_STRIP.format('claim_id')} <> '' group by 1"""
P4_FOUND = f"""with {instants(_claims)}, i as (select subject, instant_us a, case when coalesce(fin, '') = '' then 253402214400000000 else epoch_us(try_cast(fin as timestamptz)) end b from inst),
j as (select subject, a, b, max(b) over (partition by subject order by a, b rows between unbounded preceding and 1 preceding) top from i where subject <> '' and a < b),
n as (select *, sum(case when top >= a then 0 else 1 end) over (partition by subject order by a, b) n from j),
p as (select subject, min(a) a, max(b) b from n group by subject, n), q as (select *, lag(b) over (partition by subject order by a) prev from p)
select subject, 'period' span_kind, a start_us, b end_us from p union all select subject, 'gap', prev, a from q where prev is not null"""
