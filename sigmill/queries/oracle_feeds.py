"""The SQL that states the reference-and-feed queries a second time."""

_ORPHANS = """
parents as (select ltrim(trim(primaryid), '0') as primaryid, ltrim(trim(caseid), '0') as caseid, quarter from demo_all),
gone as (select ltrim(trim(caseid), '0') as caseid, min(quarter) as gone from deleted_cases group by 1),
idx as (select primaryid, min(quarter) as first, min(gone) as gone from parents left join gone using (caseid) group by 1),
refs as (
  select distinct 'drug_all' as table_name, quarter, ltrim(trim(primaryid), '0') as primaryid from drug_all where regexp_full_match(trim(primaryid), '[0-9]+')
  union all
  select distinct 'reac_all', quarter, ltrim(trim(primaryid), '0') from reac_all where regexp_full_match(trim(primaryid), '[0-9]+')
),
judged as (
  select table_name, refs.quarter, refs.primaryid,
         case when idx.primaryid is null then 'missing' when first > refs.quarter then 'late' when gone <= refs.quarter then 'deleted' else 'held' end as standing
  from refs left join idx using (primaryid)
)"""

# parts of every line; columns tied to fields; types of the columns
_PARTS = r"""
with parts as (
  select feed, feed_kind, file_no, line_no, unnest(string_split(raw_line, case feed_kind when 'demo' then '$' else chr(9) end)) as v,
         generate_subscripts(string_split(raw_line, case feed_kind when 'demo' then '$' else chr(9) end), 1) as pos
  from feed_lines
), named as (
  select feed, feed_kind, file_no, pos, lower(regexp_replace(regexp_replace(v, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as name from parts where line_no = 0
), cols as (
  select n.*, coalesce(f.field_name, n.name) as field from named n left join field_names f on f.feed_kind = n.feed_kind and f.seen_as = n.name
), typed as (
  select feed, file_no, pos,
         case when bool_and(regexp_full_match(v, '[0-9]+')) then 'integer' when bool_and(regexp_full_match(v, '[0-9]+([.][0-9]+)?')) then 'decimal'
              when bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) then 'date' else 'text' end as type
  from parts where line_no > 0 and trim(v) not in ('', 'NA') group by all
"""

SQL: dict[str, str] = {
    "p3_found": f"with {_ORPHANS} select table_name, quarter, primaryid, standing as orphan_kind from judged where standing <> 'held'",
    "p3_snapshot": f"with {_ORPHANS} select table_name, quarter, standing, count(*) as n_references from judged group by all",
    "p3_snapshots": r"""
with parents as (select ltrim(trim(primaryid), '0') as primaryid, ltrim(trim(caseid), '0') as caseid, left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1 as p from demo_all),
gone as (select ltrim(trim(caseid), '0') as caseid, min(left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1) as g from deleted_cases group by 1),
refs as (
  select distinct 'drug_all' as table_name, left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1 as p, quarter, ltrim(trim(primaryid), '0') as primaryid from drug_all where regexp_full_match(trim(primaryid), '[0-9]+')
  union all
  select distinct 'reac_all', left(quarter, 4)::int * 4 + right(quarter, 1)::int - 1, quarter, ltrim(trim(primaryid), '0') from reac_all where regexp_full_match(trim(primaryid), '[0-9]+')
),
occur as (select p from parents union select g from gone union select p from refs),
ends as (select distinct (select min(p) from occur) + (p - (select min(p) from occur)) // 4 * 4 + 3 as e from occur),
idx as (select e, primaryid, min(p) as first, min(case when g <= e then g end) as gone from ends join parents on p <= e left join gone using (caseid) group by all)
select (e // 4)::varchar || 'Q' || (e % 4 + 1)::varchar as as_of, table_name, quarter,
       case when idx.primaryid is null then 'missing' when first > refs.p then 'late' when gone <= refs.p then 'deleted' else 'held' end as standing, count(*) as n_references
from ends join refs on refs.p <= ends.e left join idx using (e, primaryid) group by all""",
    "p5_found": f"""{_PARTS}), files as (
  select feed, file_no, lag(file_no) over (partition by feed order by file_no) as prev from (select distinct feed, file_no from feed_lines)
), f as (
  select c.feed, c.file_no, c.field, c.name, t.type, x.prev from cols c left join typed t using (feed, file_no, pos) join files x using (feed, file_no)
)
select distinct a.feed, a.file_no, a.field as field_name, 'added' as change_kind from f a left join f b on b.feed = a.feed and b.field = a.field and b.file_no = a.prev where a.prev is not null and b.feed is null
union all
select distinct x.feed, x.file_no, b.field, 'removed' from files x join f b on b.feed = x.feed and b.file_no = x.prev left join f a on a.feed = x.feed and a.file_no = x.file_no and a.field = b.field where a.feed is null
union all
select distinct a.feed, a.file_no, a.field, 'renamed' from f a join f b on b.feed = a.feed and b.field = a.field and b.file_no = a.prev where a.name <> b.name
union all
select distinct a.feed, a.file_no, a.field, 'retyped' from f a join f b on b.feed = a.feed and b.field = a.field and b.type is not null and b.file_no < a.file_no
where a.type <> b.type and not exists (select 1 from f z where z.feed = a.feed and z.field = a.field and z.type is not null and z.file_no < a.file_no and z.file_no > b.file_no)""",
    "p5_alternatives": f"""{_PARTS}), each as (
  select c.feed, c.file_no, c.field, case when regexp_full_match(trim(v), '[0-9]+') then 'integer' when regexp_full_match(trim(v), '[0-9]+([.][0-9]+)?') then 'decimal'
    when regexp_full_match(trim(v), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'date' else 'text' end as branch
  from parts p join cols c using (feed, file_no, pos) where p.line_no > 0 and c.name <> '' and trim(v) not in ('', 'NA')
), counted as (select feed, field, branch, file_no, count(*) as n from each group by all)
select feed, file_no, field as field_name, branch, n as n_values
from (select *, row_number() over (partition by feed, field, branch order by file_no) as k, min(file_no) over (partition by feed, field) as begun from counted) where k = 1 and file_no > begun""",
    "p5_values": f"""{_PARTS})
select p.feed, p.file_no, p.line_no, c.field as field_name, trim(v) as value from parts p join cols c using (feed, file_no, pos) where p.line_no > 0 and c.name <> '' and trim(v) not in ('', 'NA')""",
}
