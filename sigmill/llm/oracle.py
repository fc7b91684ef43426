"""The SQL that states some of the subpackage's queries a second time."""

_DEMO = (
    "primaryid caseid caseversion event_dt fda_dt age age_cod sex occr_country reporter_country serious seriousnessdeath "
    "seriousnesslifethreatening seriousnesshospitalization seriousnessdisabling seriousnesscongenitalanomali seriousnessother quarter"
).split()
_FILLED = " + ".join(f"(case when trim(coalesce({c}, '')) in ('', 'NA') then 0 else 1 end)" for c in _DEMO)
_DIGITS = "regexp_extract(quarter, '([0-9]{4}|[0-9]{2})', 1)"

_CODED = [c for c in _DEMO if c in ("age_cod", "sex", "serious") or c.startswith("seriousness")]
_ID = "nullif(regexp_extract(ltrim(trim({0}), '0'), '^[0-9]+$'), '')"
_SORTED = f"lpad(length(coalesce({_ID}, ''))::varchar, 10, '0') || coalesce({_ID}, '')"
_STEPS = " union all ".join(f"select '{c}' as field, lag({c}) over (partition by cid order by d) as earlier, {c} as later from daily" for c in _CODED)
_VALUES = " union all ".join(f"select cid, '{c}' as field, ver, d, trim({c}) as v from r where trim(coalesce({c}, '')) not in ('', 'NA')" for c in _DEMO)
_DAILY = ", ".join(f"max(case when trim(coalesce({c}, '')) in ('', 'NA') then '(none)' else trim({c}) end) as {c}" for c in _CODED)

SQL: dict[str, str] = {
    "p4_found": f"""
with rows as (
  select ltrim(trim(caseid), '0') as caseid, ltrim(trim(primaryid), '0') as primaryid, ltrim(trim(caseversion), '0') as version,
         quarter, {_FILLED} as filled,
         case when upper(quarter) like 'Q%' then cast(right('20' || substr(replace(quarter, ' ', ''), 3), 4) as int) * 4 + cast(substr(quarter, 2, 1) as int)
              else cast(right('20' || regexp_extract(quarter, '^([0-9]+)', 1), 4) as int) * 4 + cast(right(quarter, 1) as int) end as period
  from current_demo where regexp_full_match(trim(caseid), '[0-9]+')
), ranked as (
  select *, count(*) over (partition by caseid) as n,
         row_number() over (partition by caseid order by length(version) desc, version desc, length(primaryid) desc, primaryid desc, filled desc, period desc, quarter desc) as place
  from rows
)
select caseid, primaryid, quarter from ranked where n >= 2 and place = 1""",
    "p4_fused": f"""
with recursive r as (
  select * replace (trim(caseid) as caseid), {_ID.format('caseid')} as cid, {_SORTED.format('caseversion')} || {_SORTED.format('primaryid')} as ver,
         case when regexp_full_match(fda_dt, '[0-9]{{8}}') then fda_dt else '' end as d
  from current_demo where {_ID.format('caseid')} is not null
), daily as (select cid, d, {_DAILY} from r where d <> '' group by cid, d),
seen as (select field, earlier, later, count(*) as n from ({_STEPS}) where earlier is not null and earlier <> later group by all),
net as (select field, v, sum(w) / sum(abs(w))::double as net from (select field, later as v, n as w from seen union all select field, earlier, -n from seen) group by all),
up as (
  select s.field, s.earlier, s.later from seen s left join seen b on b.field = s.field and b.earlier = s.later and b.later = s.earlier
  join net x on x.field = s.field and x.v = s.earlier join net y on y.field = s.field and y.v = s.later
  where s.n >= 1.25::double * greatest(coalesce(b.n, 0), 1) and x.net < y.net
), known as (select * from up union select k.field, k.earlier, u.later from known k join up u on u.field = k.field and u.earlier = k.later),
vals as ({_VALUES}),
tops as (select vals.* from vals join (select cid, field, max(ver) as ver from vals group by all) using (cid, field, ver)),
latest as (select cid, field, arg_max(v, d || v) as v from tops where d <> '' group by all),
cand as (select distinct cid, field, v, true as stands from latest union select distinct t.cid, t.field, t.v, false from tops t left join latest l using (cid, field) where t.d = '' and t.v is distinct from l.v),
kept as (select * from cand c where field not in ({", ".join(f"'{c}'" for c in _CODED)}) or not exists (select 1 from cand o join known k on k.field = o.field and k.later = o.v where o.cid = c.cid and o.field = c.field and k.earlier = c.v)),
won as (select cid, field, arg_max(v, (stands::int::varchar || v)) as v from kept group by all)
select r.cid as "case", count(*) as rows, {", ".join(f"(select v from won w where w.cid = r.cid and w.field = '{c}') as {c}" for c in _DEMO)} from r group by r.cid""",
    "p6_found": """
with base as (select distinct dataset_id, primaryid, drug_text, event_pt from report_pairs),
d as (select dataset_id, drug_text, count(distinct primaryid) as n from base group by all),
e as (select dataset_id, event_pt, count(distinct primaryid) as n from base group by all),
u as (select dataset_id, count(distinct primaryid) as n from base group by all),
p as (select dataset_id, drug_text, event_pt, count(distinct primaryid) as n from base where drug_text is not null and event_pt is not null group by all)
select p.dataset_id, p.drug_text, p.event_pt
from p join d using (dataset_id, drug_text) join e using (dataset_id, event_pt) join u using (dataset_id)
where p.n >= 4 and p.n * u.n >= 4 * d.n * e.n""",
    "p6_ratios": """
with base as (select distinct dataset_id, primaryid, drug_text, event_pt from report_pairs),
d as (select dataset_id, drug_text, count(distinct primaryid) as drug_n from base group by all),
e as (select dataset_id, event_pt, count(distinct primaryid) as event_n from base group by all),
u as (select dataset_id, count(distinct primaryid) as universe from base group by all),
p as (select dataset_id, drug_text, event_pt, count(distinct primaryid) as n from base where drug_text is not null and event_pt is not null group by all)
select dataset_id, drug_text, event_pt, n, drug_n, event_n, universe, round(n::double * universe / (drug_n::double * event_n), 6) + 0.0::double as ratio,
       round((n + 0.5::double) * (universe - drug_n - event_n + n + 0.5::double) / ((drug_n - n + 0.5::double) * (event_n - n + 0.5::double)), 6) + 0.0::double as odds_ratio
from p join d using (dataset_id, drug_text) join e using (dataset_id, event_pt) join u using (dataset_id)""",
}
