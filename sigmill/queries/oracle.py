"""The SQL that states each core query a second time, written independently of the Spark expressions."""

from sigmill.queries import oracle_feeds


def _plain(c: str) -> str:
    return f"nullif(regexp_extract(ltrim(trim({c}), '0'), '^[0-9]+$'), '')"


def _term(c: str) -> str:
    return f"nullif(nullif(upper(regexp_replace(trim({c}), '\\s+', ' ', 'g')), ''), 'NA')"


def _r(column: str, digits: int = 6) -> str:
    return f"round({column}, {digits}) + 0.0::double as {column}"


def _safe(c: str) -> str:
    return f"case when regexp_matches({c}, '^\\s*[=+@-]') then chr(39) || {c} else {c} end"


_KEY = "dataset_id, drug_text, drug_text_source, drug_role, event_pt"
_GROUP = "dataset_id, drug_text, drug_text_source, drug_role"
_COUNTS = "a, b, c, d, drug_reports, event_reports, universe_reports"
_OTHERS = "caseid caseversion event_dt fda_dt age age_cod sex occr_country reporter_country serious seriousnessdeath seriousnesslifethreatening seriousnesshospitalization seriousnessdisabling seriousnesscongenitalanomali seriousnessother quarter".split()
_ROLE = "case upper(trim(role_cod)) when 'PS' then 'primary_suspect' when 'SS' then 'secondary_suspect' when 'C' then 'concomitant' when 'I' then 'interacting' end"
_ROLES = "unnest(case when drug_role in ('primary_suspect', 'secondary_suspect') then [drug_role, 'suspect', 'all'] else [drug_role, 'all'] end)"
_DEMO = f"select * replace ({_plain('primaryid')} as primaryid, {_plain('caseid')} as caseid, {_plain('caseversion')} as caseversion) from demo_all"
_VALID = "primaryid is not null and caseid is not null and caseversion is not null"
_NEWEST = "partition by caseid order by length(caseversion) desc, caseversion desc, length(primaryid) desc, primaryid desc, quarter"

# received reports once each, the current ones, and the children that belong to a received report
_STAGES = f"""
demo as (
  select * exclude (rn) from (
    select *, row_number() over (partition by primaryid order by coalesce(quarter, '') desc, {", ".join(f"coalesce({c}, '') desc" for c in _OTHERS)}) as rn from ({_DEMO}) where {_VALID}
  ) where rn = 1
),
cur as (select * exclude (rn) from (select *, row_number() over ({_NEWEST}) as rn from demo) where rn = 1),
drug as (select * replace ({_plain('primaryid')} as primaryid, {_plain('caseid')} as caseid) from drug_all),
reac as (select * replace ({_plain('primaryid')} as primaryid, {_plain('caseid')} as caseid) from reac_all),
drug_ok as (select drug.* from drug join (select primaryid, caseid from demo) using (primaryid, caseid)),
reac_ok as (select reac.* from reac join (select primaryid, caseid from demo) using (primaryid, caseid)),
dc as (
  select * from (
    select primaryid, coalesce({_term('prod_ai')}, {_term('drugname')}) as drug_text,
           case when {_term('prod_ai')} is not null then 'PROD_AI' when {_term('drugname')} is not null then 'DRUGNAME' end as drug_text_source, {_ROLE} as drug_role
    from drug_ok where primaryid in (select primaryid from cur)
  ) where drug_text is not null and drug_role is not null
),
ec as (select * from (select primaryid, {_term('pt')} as event_pt from reac_ok where primaryid in (select primaryid from cur)) where event_pt is not null),
built as (select * from (select distinct * from dc) join (select distinct * from ec) using (primaryid)),
rolled as (select distinct 'sigmill-all' as dataset_id, primaryid, drug_text, drug_text_source, event_pt, r as drug_role from (select *, {_ROLES} as r from built)),
made as (
  select {_KEY}, a, dr - a as b, er - a as c, n - dr - er + a as d, dr as drug_reports, er as event_reports, n as universe_reports
  from (select {_KEY}, count(distinct primaryid) as a from rolled group by all)
  join (select {_GROUP}, count(distinct primaryid) as dr from rolled group by all) using ({_GROUP})
  join (select event_pt, count(distinct primaryid) as er from built group by all) using (event_pt)
  cross join (select count(distinct primaryid) as n from built)
)"""
_ROLLED = f"rolled as (select distinct dataset_id, primaryid, drug_text, drug_text_source, event_pt, r as drug_role from (select *, {_ROLES} as r from report_pairs))"
_GIVEN = "given as (select distinct * from disproportionality_cells)"


def _scores(source: str) -> str:
    """Statistics of the cells in ``source``, as ``labelled``."""
    z = "1.959963984540054::double"
    prr_var, ror_var = "sqrt(1 / p - 1 / (p + q) + 1 / r - 1 / (r + s))", "sqrt(1 / p + 1 / q + 1 / r + 1 / s)"
    margins = "((a + b)::double * (c + d) * (a + c) * (b + d))"
    return f"""
shifted as (select *, case when least(a, b, c, d) = 0 then 0.5::double else 0::double end as k from {source}),
ratios as (
  select *, a + k as p, b + k as q, c + k as r, d + k as s, ((a + k) / (a + b + 2 * k)) / ((c + k) / (c + d + 2 * k)) as prr, ((a + k) * (d + k)) / ((b + k) * (c + k)) as ror,
         case when {margins} > 0 then (a + b + c + d)::double * power(greatest(abs(a::double * d - b::double * c) - (a + b + c + d) / 2.0::double, 0), 2) / {margins} else 0 end as chi2
  from shifted
),
scored as (
  select *, prr * exp(-{z} * {prr_var}) as prr_low, prr * exp({z} * {prr_var}) as prr_high, ror * exp(-{z} * {ror_var}) as ror_low, ror * exp({z} * {ror_var}) as ror_high from ratios
),
labelled as (
  select *, case when a >= 3 and prr >= 2 and chi2 >= 4 then 'meets_profile' when a >= 3 and (prr >= 1.5 or ror_low > 1) then 'intermediate_review' else 'below_profile' end as outcome from scored
)"""


_FISHER = """
tables as (select distinct a, b, c, d from given),
wide as (select *, a + b as r1, a + c as c1, a + b + c + d as n, greatest(0, a - d)::bigint as lo, least(a + b, a + c)::bigint as hi from tables),
probs as (
  select a, b, c, d, lo,
         list_transform(range(lo, hi + 1), lambda x: lgamma(c1 + 1) - lgamma(x + 1) - lgamma(c1 - x + 1) + lgamma(n - c1 + 1) - lgamma(r1 - x + 1) - lgamma(n - c1 - r1 + x + 1)
           - lgamma(n + 1) + lgamma(r1 + 1) + lgamma(n - r1 + 1)) as logs
  from wide
),
seen as (select *, logs[(a - lo + 1)::bigint] + ln(1 + 1e-7) as most from probs),
fisher as (select a, b, c, d, least(1, list_sum(list_transform(list_filter(logs, lambda v: v <= most), lambda v: exp(v)))) as fisher_p from seen)"""
_BH = f"""
tested as (select labelled.*, fisher_p from labelled join fisher using (a, b, c, d)),
ranked as (select *, row_number() over (partition by {_GROUP} order by fisher_p, event_pt) as rk, count(*) over (partition by {_GROUP}) as m from tested),
adjusted as (select *, min(least(1, fisher_p * m / rk)) over (partition by {_GROUP} order by rk rows between current row and unbounded following) as fdr_q from ranked)"""
_PAGE = f"page as (select * from (select *, row_number() over (partition by {_GROUP} order by round(prr, 6) desc, event_pt) as place from labelled) where place <= 50)"
_LIVE = """
seen as (select distinct primaryid, drug_text, event_pt from report_pairs),
counts as (select drug_text, event_pt, count(*) as a from seen group by all),
top as (select * from (select *, row_number() over (partition by drug_text order by a desc, event_pt) as place from counts) where place <= 25),
margins as (
  select top.*, dr, er, n from top join (select drug_text, count(distinct primaryid) as dr from seen group by all) using (drug_text)
  join (select event_pt, count(distinct primaryid) as er from seen group by all) using (event_pt) cross join (select count(distinct primaryid) as n from seen)
),
full_tables as (select drug_text, event_pt, place, a, dr - a as b, er - a as c, n - dr - er + a as d from margins)"""
_LABEL = "case outcome when 'meets_profile' then 'MEETS_EVANS_EDUCATIONAL_PROFILE' when 'intermediate_review' then 'INTERMEDIATE_REVIEW' else 'BELOW_PROFILE' end as label"
_MISSING = " union all ".join(
    f"select '{c}' as field_name, count(*) as n_reports, sum(case when trim(coalesce({c}, '')) in ('', 'NA') then 1 else 0 end)::bigint as n_missing from demo_all" for c in ["primaryid", *_OTHERS]
)
_POPULATIONS = (
    "(select count(*) from demo) as source_demo_rows, (select count(*) from cur) as current_case_reports, "
    "(select count(distinct primaryid) from built) as eligible_reports, (select count(*) from built) as drug_event_pairs"
)
_QA = {
    "source_quarters": "(select count(distinct quarter) from demo)", "source_demo_rows": "(select count(*) from demo)", "current_case_reports": "(select count(*) from cur)",
    "superseded_demo_rows": "(select count(*) from demo) - (select count(*) from cur)", "duplicate_caseversion_rows": "(select count(*) - count(distinct (caseid, caseversion)) from demo)",
    "drug_rows_raw": "(select count(*) from drug_all)", "reaction_rows_raw": "(select count(*) from reac_all)", "eligible_reports": "(select count(distinct primaryid) from built)",
    "drug_event_pairs": "(select count(*) from built)", "distinct_drug_role_groups": "(select count(*) from (select distinct drug_text, drug_text_source, drug_role from built))",
    "distinct_event_pts": "(select count(distinct event_pt) from built)", "aggregate_rows": "(select count(*) from made)", "demo_duplicate_primaryids": "(select count(*) - count(distinct primaryid) from demo)",
    **{f"{n}_orphan_rows": f"(select count(*) from {t} where primaryid is null or primaryid not in (select primaryid from demo))" for n, t in (("drug", "drug"), ("reaction", "reac"))},
    **{f"{n}_caseid_mismatches": f"(select count(*) from {t} join demo using (primaryid) where {t}.caseid <> demo.caseid)" for n, t in (("drug", "drug"), ("reaction", "reac"))},
    **{f"eligible_{n}_component_rows": f"(select count(*) from {t})" for n, t in (("drug", "dc"), ("reaction", "ec"))},
    **{f"unique_{n}_components": f"(select count(*) from (select distinct * from {t}))" for n, t in (("drug", "dc"), ("reaction", "ec"))},
    **{f"duplicate_{n}_components_removed": f"(select count(*) from {t}) - (select count(*) from (select distinct * from {t}))" for n, t in (("drug", "dc"), ("reaction", "ec"))},
    "max_projected_pairs_per_report": "(select max(pairs) from loads)", "reports_with_joinable_components": "(select count(*) from loads)",
    **{f"{n}_rows_for_superseded_reports": f"(select count(*) from {t} where primaryid is null or primaryid not in (select primaryid from cur))" for n, t in (("drug", "drug"), ("reaction", "reac"))},
}
_LOADS = """loads as (
  select primaryid, n_drugs * n_events as pairs from (select primaryid, count(distinct (drug_text, drug_text_source, drug_role)) as n_drugs from dc group by 1) join (select primaryid, count(distinct event_pt) as n_events from ec group by 1) using (primaryid)
)"""
_METRIC = "case when k > 0 then 'corrected' else 'observed' end as input_cells, case when k > 0 then 'haldane_anscombe' else 'none' end as correction_method, k as added_to_each_cell"
_START = "make_date(left(quarter, 4)::int, right(quarter, 1)::int * 3 - 2, 1)"

_REQUEST = f"""
with wanted as (select dataset_id, drug_text, drug_text_source from disproportionality_cells where drug_role = 'all' and drug_text_source in ('PROD_AI', 'DRUGNAME') order by dataset_id, drug_reports desc, drug_text, drug_text_source limit 1),
given as (select distinct c.* from disproportionality_cells c join wanted using (dataset_id, drug_text, drug_text_source) where drug_role = 'all'),
{_scores('given')}, {_FISHER}, {_BH}
select dataset_id, drug_text, event_pt, a, b, c, d, {_r('prr')}, {_r('ror')}, {_r('chi2')}, {_r('fisher_p')}, {_r('fdr_q')}, outcome as flag from adjusted"""


def _text(c: str) -> str:
    """A rounded number as text: in digits from 1e-4 to below 1e6, else with an exponent."""
    v = f"round({c}, 6)"
    power = f"floor(log10(abs({v})) + 1e-9)::int"
    digits = f"regexp_replace(regexp_replace(round({v} / power(10::double, {power}), 9)::varchar, '0+$', ''), '[.]$', '')"
    far = f"{digits} || case when {power} < 0 then 'e-' else 'e+' end || lpad(abs({power})::varchar, 2, '0')"
    return f"case when {c} is null then '' when {v} = 0 then '0' when abs({v}) < 1e-4 or abs({v}) >= 1e6 then {far} else regexp_replace({v}::varchar, '[.]0$', '') end"


SQL: dict[str, str] = {
    "latest_case_version": f"select caseid, primaryid, caseversion, quarter from (select *, row_number() over ({_NEWEST}) as rn from ({_DEMO}) where {_VALID}) where rn = 1",
    "integrity_counters": f"""
with {_STAGES}, par as (select * from ({_DEMO}) where {_VALID}),
idx as (select primaryid, min(caseid) as pc from par group by 1)
select (select count(*) - count(distinct primaryid) from par) as duplicate_primaryids, (select count(*) - count(distinct (caseid, caseversion)) from par) as duplicate_versions,
       (select count(*) from drug where primaryid is null) as drug_unusable, (select count(*) from drug where primaryid is not null and primaryid not in (select primaryid from idx)) as drug_orphans,
       (select count(*) from drug join idx using (primaryid) where caseid <> pc) as drug_mismatches,
       (select count(*) from reac where primaryid is null) as reac_unusable, (select count(*) from reac where primaryid is not null and primaryid not in (select primaryid from idx)) as reac_orphans,
       (select count(*) from reac join idx using (primaryid) where caseid <> pc) as reac_mismatches""",
    "superseded_children": f"""
with {_STAGES}
select 'drug_all' as table_name, primaryid, count(*) as n_rows from drug_ok where primaryid not in (select primaryid from cur) group by all
union all select 'reac_all', primaryid, count(*) from reac_ok where primaryid not in (select primaryid from cur) group by all""",
    "canonical_ids": f"select primaryid, {_plain('primaryid')} as plain, count(*) as n_rows from drug_all group by primaryid",
    "role_mapping": f"select role_cod, {_ROLE} as role, coalesce(upper(trim(role_cod)) not in ('', 'NA', 'PS', 'SS', 'C', 'I'), false) as is_unknown, count(*) as n_rows from drug_all group by all",
    "normalized_terms": "select pt, upper(regexp_replace(trim(pt), '\\s+', ' ', 'g')) as term, count(*) as n_rows from reac_all group by all",
    "quarter_coverage": f"""
select quarter, strftime({_START}, '%Y-%m-%d') as first_day, strftime({_START} + interval 3 month - interval 1 day, '%Y-%m-%d') as last_day, count(*) as n_rows
from demo_all where quarter is not null group by quarter""",
    "join_load": f"""
with {_STAGES}
select primaryid, n_drugs, n_events, n_drugs * n_events as pairs
from (select primaryid, count(distinct (drug_text, drug_text_source, drug_role)) as n_drugs from dc group by 1) join (select primaryid, count(distinct event_pt) as n_events from ec group by 1) using (primaryid)""",
    "built_pairs": f"""
with {_STAGES}
select primaryid, caseid, quarter, drug_text, drug_text_source, drug_role, event_pt, 'UNCLASSIFIED_SOURCE_PT' as event_category,
       {", ".join(f"nullif(nullif({c}, ''), 'NA') as {c}" for c in ("age", "sex", "occr_country", "serious"))}
from built join cur using (primaryid)""",
    "role_rollup": f"with {_ROLLED} select dataset_id, drug_role, count(*) as n_rows, count(distinct primaryid) as n_reports from rolled group by all",
    "event_margins": "select dataset_id, event_pt, count(distinct primaryid) as event_reports from report_pairs group by all",
    "drug_margins": f"with {_ROLLED} select {_GROUP}, count(distinct primaryid) as drug_reports from rolled group by all",
    "universe_count": "select dataset_id, count(distinct primaryid) as universe_reports from report_pairs group by all",
    "contingency_cells": f"with {_STAGES} select {_KEY}, {_COUNTS} from made",
    "dataset_cells": f"""
with base as (select * from report_pairs where drug_text is not null and drug_text_source is not null and event_pt is not null and drug_role is not null and primaryid is not null),
rolled as (select distinct dataset_id, primaryid, drug_text, drug_text_source, event_pt, r as drug_role from (select *, {_ROLES} as r from base))
select {_KEY}, a, dr - a as b, er - a as c, n - dr - er + a as d, dr as drug_reports, er as event_reports, n as universe_reports
from (select {_KEY}, count(distinct primaryid) as a from rolled group by all)
join (select {_GROUP}, count(distinct primaryid) as dr from rolled group by all) using ({_GROUP})
join (select dataset_id, event_pt, count(distinct primaryid) as er from base group by all) using (dataset_id, event_pt)
join (select dataset_id, count(distinct primaryid) as n from base group by all) using (dataset_id)""",
    "cell_violations": """
select dataset_id, case when a + b <> drug_reports then 'drug margin' when a + c <> event_reports then 'event margin' when a + b + c + d <> universe_reports then 'universe' end as violation, count(*) as n_rows
from disproportionality_cells group by all""",
    "prr_ror": f"with {_GIVEN}, {_scores('given')} select {_KEY}, k > 0 as zero_corrected, {', '.join(_r(c) for c in ('prr', 'prr_low', 'prr_high', 'ror', 'ror_low', 'ror_high'))} from labelled",
    "yates_chi2": f"with {_GIVEN}, {_scores('given')} select {_KEY}, {_r('chi2')} from labelled",
    "screening_outcome": f"with {_GIVEN}, {_scores('given')} select {_KEY}, outcome from labelled",
    "exploratory_score": f"with {_GIVEN}, {_scores('given')} select {_KEY}, round(log2(prr) * sqrt(chi2), 5) + 0.0::double as score from labelled",
    "fisher_exact": f"with {_GIVEN}, {_FISHER} select a, b, c, d, {_r('fisher_p', 7)}, 'ok' as fisher_status from fisher",
    "bh_qvalues": f"with {_GIVEN}, {_scores('given')}, {_FISHER}, {_BH} select {_KEY}, {_r('fdr_q')} from adjusted",
    "drug_signal_scan": f"with {_STAGES}, {_scores('made')} select drug_text, drug_text_source, drug_role, event_pt, a, b, c, d, {_r('prr')}, {_r('ror')}, {_r('chi2')}, outcome from labelled",
    "top_events_for_drug": """
select * from (select *, row_number() over (partition by drug_text order by n_reports desc, event_pt) as place
  from (select drug_text, event_pt, count(distinct primaryid) as n_reports from report_pairs group by all)) where place <= 30""",
    "prr_ranked_page": f"with {_GIVEN}, {_scores('given')}, {_PAGE} select {_KEY}, {_r('prr')}, place from page",
    "forest_points": f"""
with {_GIVEN}, {_scores('given')}, {_PAGE}, marked as (select *, round(prr_low, 6) > 0 as ok from page),
numbered as (select *, row_number() over (partition by {_GROUP}, ok order by place) as nth from marked)
select {_KEY}, {_r('prr')}, {_r('prr_low')}, {_r('prr_high')}, place, case when not ok then 'unplottable' when nth <= 30 then 'shown' else 'deferred' end as plot from numbered""",
    "map_coordinates": f"with {_GIVEN}, {_scores('given')} select {_KEY}, round(log2(greatest(prr, 0.01)), 6) + 0.0::double as map_x, round(log10(greatest(a, 1)), 6) + 0.0::double as map_y from labelled",
    "population_counts": f"with {_STAGES} select {_POPULATIONS}",
    "field_completeness": f"select field_name, n_reports, n_missing, round(100.0::double * n_missing / n_reports, 6) as missing_percent from ({_MISSING})",
    "duplicate_components": f"""
with {_STAGES}, du as (select count(*) as u from (select distinct * from dc)), eu as (select count(*) as u from (select distinct * from ec))
select 'drug' as component, count(*) as n_rows, any_value(u) as n_unique, count(*) - any_value(u) as n_repeated from dc cross join du
union all select 'event', count(*), any_value(u), count(*) - any_value(u) from ec cross join eu""",
    "qa_summary": f"with {_STAGES}, {_LOADS} " + " union all ".join(f"select '{m}' as metric, ({v})::bigint as value" for m, v in _QA.items()),
    "build_guards": f"""
with {_STAGES}, {_LOADS}
select (select max(pairs) from loads) as max_pairs, (select arg_max(primaryid, (pairs, primaryid)) from loads) as heaviest_report, (select count(*) from loads) as joinable_reports,
       (select count(*) from loads where pairs > 10000) as over_budget,
       (select count(*) from drug_ok where primaryid in (select primaryid from cur) and coalesce(upper(trim(role_cod)) not in ('', 'NA', 'PS', 'SS', 'C', 'I'), false)) as unknown_roles""",
    "ordered_pairs": f"""
with {_STAGES}
select primaryid, drug_text, drug_text_source, drug_role, event_pt, row_number() over (partition by primaryid order by drug_text, drug_role, event_pt, drug_text_source)::int as place from built""",
    "eligible_completeness": f"""
with {_STAGES}, el as (select * from cur where primaryid in (select primaryid from built))
select field_name, n_reports, n_missing, round(100.0::double * n_missing / n_reports, 6) as missing_percent from (
  {" union all ".join(f"select '{c}' as field_name, count(*) as n_reports, sum(case when trim(coalesce({c}, '')) in ('', 'NA') then 1 else 0 end)::bigint as n_missing from el" for c in ("age", "sex", "occr_country", "serious"))}
)""",
    "text_checks": f"select dataset_id, count(*) as n_rows, 0::bigint as n_invalid_texts, count(*) - count(distinct ({_KEY})) as n_repeated_keys from disproportionality_cells group by all",
    "chi2_pvalue": f"""
with given as (select distinct a, b, c, d from disproportionality_cells), {_scores('given')}
select a, b, c, d, round(case when chi2 <= 0 then 1 else list_sum(list_transform(range(0, 20000), lambda k: exp(-chi2 / 2 / power(sin((k + 0.5::double) * pi() / 40000), 2)))) / 20000 end, 9) + 0.0::double as chi2_p from labelled""",
    "fisher_long_supports": f"""
with base as (select distinct a, b, c, d, least(a + b, a + c) - greatest(0, a - d) as w from disproportionality_cells),
given as (select distinct a * t as a, b * t as b, c * t as c, d * t as d from (select *, floor(5000 / w)::bigint + 1 as t from base where w > 0)),
{_FISHER} select a, b, c, d, {_r('fisher_p')}, 'ok' as fisher_status from fisher""",
    "prr_third_page": f"""
with {_GIVEN}, {_scores('given')}, placed as (select *, row_number() over (partition by {_GROUP} order by round(prr, 6) desc, event_pt) as place, count(*) over (partition by {_GROUP}) as n from labelled)
select {_KEY}, {_r('prr')}, place from placed where (place - 1) // 50 = least(2, (n - 1) // 50)""",
    "count_ordered_page": f"""
with {_GIVEN}, {_scores('given')}, placed as (select *, row_number() over (partition by {_GROUP} order by a desc, event_pt) as place, count(*) over (partition by {_GROUP}) as n from labelled where outcome = 'meets_profile')
select {_KEY}, a, place from placed where (place - 1) // 50 = least(1, (n - 1) // 50)""",
    "name_ordered_page": f"with {_GIVEN} select {_KEY}, place from (select *, row_number() over (partition by {_GROUP} order by event_pt) as place from given) where place <= 50",
    "review_counts": f"with {_LIVE}, {_scores('full_tables')} select drug_text, count(*) as n_events, count(*) filter (outcome = 'meets_profile') as n_review from labelled group by all",
    "digest_check": f"with {_GIVEN} select count(*) as n_rows, true as same_in_any_order, true as missing_row_seen, true as changed_row_seen from given",
    "row_order": """
with given as (select distinct dataset_id, drug_text, event_pt from disproportionality_cells where drug_role = 'all'),
one as (select dataset_id, drug_text from (select dataset_id, drug_text, count(*) as n from given group by all) order by n desc, dataset_id, drug_text limit 1),
numbered as (select *, row_number() over (order by event_pt) as k, count(*) over () as n from given join one using (dataset_id, drug_text)),
moved as (select *, case when k % 10 = 3 then k + 1 when k % 10 = 4 then k - 1 else k end as number from numbered)
select m.dataset_id, m.drug_text, m.event_pt, m.number from moved m left join moved b on b.number = m.number - 1 where case when b.event_pt is null then m.number <> 1 else b.event_pt >= m.event_pt end""",
    "protocol_scan": _REQUEST,
    "store_scan": _REQUEST,
    "result_export": f"""
{_REQUEST[: _REQUEST.index("select dataset_id, drug_text, event_pt, a, b, c, d")]},
base as (select *, row_number() over (order by event_pt) as rn, count(*) over () as cnt, case drug_text_source when 'PROD_AI' then 'faers-prod_ai' else 'faers-drugname' end || ':' || drug_text as concept from adjusted),
long as (
  select *, 'fisher_exact' as method, 'two_sided_probability_ordering' as measure, fisher_p as e, null::double as lo, null::double as hi, fisher_p as p_, fdr_q as q_, 'observed' as ic, 'false' as za, 'none' as zm, 0::double as zz from base
  union all select *, 'prr', 'reporting_ratio', prr, prr_low, prr_high, null, null, case when k > 0 then 'corrected' else 'observed' end, (k > 0)::varchar, case when k > 0 then 'haldane_anscombe' else 'none' end, k from base
  union all select *, 'ror', 'reporting_odds_ratio', ror, ror_low, ror_high, null, null, case when k > 0 then 'corrected' else 'observed' end, (k > 0)::varchar, case when k > 0 then 'haldane_anscombe' else 'none' end, k from base
)
select 'all_events_of_one_drug' as result_family_id, cnt::varchar as result_row_count, rn::varchar as result_row_number, {_safe('concept')} as drug_concept_id, 'source_pt:' || event_pt as event_concept_id, {_safe('event_pt')} as event_term,
       'UNCLASSIFIED_SOURCE_PT' as event_category, a::varchar as a, b::varchar as b, c::varchar as c, d::varchar as d, (a + b + c + d)::varchar as n, method, measure,
       {_text('e')} as estimate, {_text('lo')} as lower_95, {_text('hi')} as upper_95, {_text('p_')} as p_value, {_text('q_')} as q_value, ic as input_cells, za as zero_cell_correction_applied, zm as zero_cell_correction_method, {_text('zz')} as added_to_each_cell
from long""",
    "metrics_long": f"""
with {_GIVEN}, {_scores('given')}, {_FISHER}, {_BH}
select {_KEY}, 'prr' as method, 'reporting_ratio' as measure, round(prr, 6) as estimate, round(prr_low, 6) as lower_95, round(prr_high, 6) as upper_95, null::double as p_value, null::double as q_value, {_METRIC} from labelled
union all select {_KEY}, 'ror', 'reporting_odds_ratio', round(ror, 6), round(ror_low, 6), round(ror_high, 6), null, null, {_METRIC} from labelled
union all select {_KEY}, 'fisher_exact', 'two_sided_probability_ordering', round(fisher_p, 6), null, null, round(fisher_p, 6), round(fdr_q, 6), 'observed', 'none', 0 from adjusted""",
    "review_flags": f"""
with {_GIVEN}, {_scores('given')}
select {_KEY}, 'evans_educational' as profile_id, outcome as flag, 'a=' || a || '; PRR=' || round(prr, 6)::decimal(24,6)::varchar || '; Yates chi-square=' || round(chi2, 6)::decimal(24,6)::varchar as reason from labelled""",
    "spreadsheet_texts": f"select distinct {_safe('drug_text')} as drug_text, {_safe('event_pt')} as event_pt, chr(39) || '=' || drug_text as marked from disproportionality_cells",
    "live_scan": f"with {_LIVE}, {_scores('full_tables')} select drug_text, event_pt, place, a, b, c, d, {_r('prr')}, {_r('ror')}, {_r('chi2')}, {_LABEL} from labelled",
    "live_scan_drug": f"""
with {_LIVE}, one as (select drug_text from (select drug_text, count(distinct primaryid) as n from report_pairs group by 1) order by n desc, drug_text limit 1),
own as (select full_tables.* from full_tables join one using (drug_text)), {_scores('own')} select event_pt, a, b, c, d, {_r('prr')}, {_r('ror')}, {_r('chi2')}, {_LABEL} from labelled""",
    "result_revalidation": f"""
with {_GIVEN}, tagged as (select *, (a + 2 * b) % 211 = 11 as gone from given)
select {_KEY}, 'row' as field from tagged where gone
union all select {_KEY}, 'prr' from tagged where not gone and b % 101 = 7
union all select {_KEY}, 'ror_high' from tagged where not gone and c % 103 = 5
union all select {_KEY}, 'fisher_p' from tagged where not gone and d % 107 = 3
union all select {_KEY}, 'fdr_q' from tagged where not gone and event_reports % 109 = 2
union all select {_KEY}, 'outcome' from tagged where not gone and drug_reports % 113 = 4""",
    "quarters_scan": """
select quarter, nullif(nullif(trim(role_cod), ''), 'NA') as role_cod, count(*) as n_rows, count(nullif(nullif(trim(drugname), ''), 'NA')) as n_named, 0::bigint as n_routes from drug_all where quarter is not null group by all""",
    "snapshot_checks": f"""
with {_STAGES}
select (select count(*) from made) as n_cells, 1::bigint as n_datasets, (select max(universe_reports) from made) as universe_reports, 1::bigint as n_constants, 'all_other_eligible_reports' as comparator,
       'all_recorded_source_pts' as event_scope, 'MAX_CASEVERSION_PER_CASEID_THEN_MAX_PRIMARYID' as deduplication_policy, (select count(*) from cur) as current_reports, (select count(distinct primaryid) from cur) as retained_ids""",
    "csv_scan_roundtrip": f"""
select {", ".join(f"nullif(nullif(trim({c}), ''), 'NA') as {c}" for c in ("primaryid", "role_cod", "drugname", "prod_ai", "route", "dose_vbm"))}, count(*) as n_rows from drug_all group by all""",
    "parquet_roundtrip": "select quarter, count(*) as n_rows, count(distinct (dataset_id, primaryid)) as n_reports from report_pairs group by all",
    "cells_text_roundtrip": f"with {_GIVEN} select dataset_id, drug_role, count(*) as n_cells, sum(a)::bigint as sum_a, sum(d)::bigint as sum_d from given group by all",
    **oracle_feeds.SQL,
}
