"""DuckDB oracle SQL for the registered queries.

The item view is the portable SQL of FIXTURES.md §3 (same rows in Spark and
DuckDB); every oracle query starts from these CTEs.
"""

from .summaries import PROMPT_HEAD

ITEMS_CTE = """
base as (
  select doc_id, 'SCP-' || case when doc_id < 1000 then lpad(cast(doc_id as varchar), 3, '0')
                                else cast(doc_id as varchar) end as scp
  from documents),
items as (
  select case when d.doc_id % 50 = 49 then lower(base.scp) || '-j' else lower(base.scp) end as link,
         case when d.doc_id % 50 = 49 then base.scp || '-J' else base.scp end as scp,
         d.doc_id as scp_number,
         split_part(d.text, chr(10), 1) as title,
         case when d.doc_id % 50 = 49 then 'joke'
              else 'series-' || cast(cast(floor(d.doc_id / 1000.0) as bigint) + 1 as varchar) end as series,
         cast(floor(c.c_acctbal) as bigint) as rating,
         o.o_orderdate as created_at,
         case when d.doc_id % 10 = 0 then null else c.c_name end as creator,
         'https://wiki.example.org/' || lower(base.scp) as url,
         d.text as raw_source, p.html as raw_content, sha1(p.html) as content_sha1
  from documents d
  join base on base.doc_id = d.doc_id
  left join orders o on o.o_orderkey = d.doc_id
  left join customer c on c.c_custkey = o.o_custkey
  left join pages p on p.page_id = d.doc_id),
item_tags as (
  select doc_id as scp_number, 'lang-' || lang as tag from documents
  union all select doc_id, source from documents
  union all select doc_id, case when quality = 1 then 'euclid' else 'keter' end from labels
  union all select doc_id, 'hostile' from labels where toxic = 1),
tag_arrays as (
  select scp_number, list_sort(list(tag)) as tags from item_tags group by scp_number),
item_references as (
  select distinct l.l_orderkey as scp_number,
         'scp-' || case when l.l_partkey < 1000 then lpad(cast(l.l_partkey as varchar), 3, '0')
                        else cast(l.l_partkey as varchar) end as ref_link
  from lineitem l join documents d on d.doc_id = l.l_orderkey),
item_history as (
  select e.event_id % n.n as scp_number, e.event_id as seq,
         'user' || cast(e.user_id as varchar) as author, e.ts as date, e.event_type as comment
  from events e cross join (select count(*) as n from documents) n),
item_hubs as (
  select doc_id as scp_number, 'hub-' || source as hub from documents),
items_t as (
  select i.*, coalesce(t.tags, []) as tags from items i left join tag_arrays t using (scp_number)),
stored as (
  select i.scp_number, b.markdown, c.summary from items i
  left join (select item_id, min(text) as markdown from benchmark group by item_id) b on b.item_id = i.scp_number
  left join (select conv_id, first(text order by turn, text) as summary from conversations where role = 'assistant' group by conv_id) c
    on c.conv_id = i.scp_number)
"""


def q(body: str) -> str:
    return "with " + ITEMS_CTE.strip() + "\n" + body


SQL: dict[str, str] = {}

SQL["search_filter"] = q("""
select link, scp, scp_number, title, rating, series,
       case when len(tags) > 0 then array_to_string(tags, ',') end as tags,
       created_at, creator, cast(null as varchar) as summary
from items_t
where series = 'series-1' and rating >= 0 and list_has_all(tags, ['lang-en', 'euclid'])
order by rating desc, link asc
limit 25
""")


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def pad3(x: str) -> str:
    return f"(case when length(ltrim({x}, '0')) < 3 then lpad(ltrim({x}, '0'), 3, '0') else ltrim({x}, '0') end)"


def norm_sql(x: str, pad_prefixed: bool = True) -> str:
    """B1 (pad_prefixed) / B2 in SQL."""
    rest = f"substr({x}, 5)"
    pref = (f"case when regexp_matches({rest}, '^[0-9]+$') then 'SCP-' || {pad3(rest)} else upper({x}) end"
            if pad_prefixed else f"upper({x})")
    return (f"(case when {x} is null then null "
            f"when regexp_matches({x}, '^[0-9]+$') then 'SCP-' || {pad3(x)} "
            f"when starts_with(lower({x}), 'scp-') then {pref} "
            f"when starts_with(upper({x}), 'SCP-') then upper({x}) "
            f"else 'SCP-' || upper({x}) end)")


def num_sql(x: str) -> str:
    e = f"regexp_extract(upper({x}), 'SCP-([0-9]+)', 1)"
    return f"(case when {e} <> '' then cast({e} as bigint) end)"


ID_INPUTS = """
core as (select scp_number, link, scp from items),
inp as (
  select 'number' as kind, cast(scp_number as varchar) as input from core
  union all select 'prefixed', 'scp-' || cast(scp_number as varchar) from core
  union all select 'link', link from core
  union all select 'zero_padded', lpad(cast(scp_number as varchar), 6, '0') from core
  union all select 'bare_suffix', regexp_replace(scp, '^SCP-', '') from core)
"""

VARIANTS = """
v0 as (select link, scp, scp_number, [scp, cast(scp_number as varchar), link] as base,
              'SCP-' || lpad(cast(scp_number as varchar), 3, '0') as padded from items),
v1 as (select link, scp, scp_number,
              case when scp_number < 1000 and not list_contains(base, padded)
                   then list_append(base, padded) else base end as variants from v0),
var as (select link, scp, scp_number, i - 1 as pos, variants[i] as variant
        from (select *, unnest(range(1, len(variants) + 1)) as i from v1))
"""

IMG_RE = r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""

SQL["items_base"] = q(f"""
select i.link, i.scp, i.scp_number, i.title, i.series, i.rating, i.created_at, i.creator, i.url,
       'scp-wiki.wikidot.com' as domain, i.content_sha1, sha1(i.raw_source) as raw_source_sha1,
       (select string_agg(tag, ',' order by tag) from item_tags t where t.scp_number = i.scp_number) as tags,
       (select string_agg(hub, ',' order by hub) from item_hubs h where h.scp_number = i.scp_number) as hubs,
       (select string_agg(ref_link, ',' order by ref_link) from item_references r
         where r.scp_number = i.scp_number) as refs,
       coalesce(len(regexp_extract_all(i.raw_content, {lit(IMG_RE)}, 1)), 0) as n_images,
       (select count(*) from item_history h where h.scp_number = i.scp_number) as n_history
from items i
""")

SQL["item_tags"] = q("select i.link, t.tag from items i join item_tags t using (scp_number)")
SQL["item_references"] = q("select i.link, r.ref_link from items i join item_references r using (scp_number)")
SQL["item_history"] = q("""
select i.link, row_number() over (partition by h.scp_number order by h.seq) - 1 as pos,
       h.author, h.date, h.comment
from items i join item_history h using (scp_number)
""")

SQL["normalize_ids"] = q("," + ID_INPUTS + f"""
select kind, input, {norm_sql('input')} as norm_loader, {norm_sql('input', False)} as norm_script,
       {num_sql(norm_sql('input'))} as number
from inp
""")

SQL["select_range"] = q(f"select scp as label from items where {num_sql('scp')} between 100 and 250")

SQL["select_single"] = q(f"""
select scp as label from items
where scp in (select {norm_sql('cast(l_partkey as varchar)', False)} from lineitem)
""")

SQL["sample_seeded"] = q("select scp as label from items order by md5('42:' || scp), scp limit 25")

SQL["invalid_ids"] = q(f""",
req as (select distinct cast(l_partkey as varchar) as request from lineitem),
norm as (select request, {norm_sql('trim(request)')} as normalized from req),
missing as (select request, normalized, {num_sql('normalized')} as number from norm where normalized not in (select scp from items)),
placed as (select scp, scp_number, row_number() over (order by scp_number, scp) as place from items),
upto as (select m.request, m.number, count(p.place) as place
         from missing m left join placed p on p.scp_number <= m.number where m.number is not null group by m.request, m.number),
near as (select u.request, p.scp, row_number() over (partition by u.request order by abs(p.scp_number - u.number), p.scp_number, p.scp) as rn
         from upto u join placed p on p.place between u.place - 2 and u.place + 3),
top as (select request, string_agg(scp, ',' order by rn) as suggestions from near where rn <= 3 group by request)
select m.request, 'ITEM_NOT_FOUND' as code, 'Item ' || m.normalized || ' not found in dataset' as message,
       t.suggestions
from missing m left join top t using (request)
""")

SQL["shard_paths"] = q("," + ID_INPUTS + """,
s as (select kind, input, lower(regexp_replace(input, '^[Ss][Cc][Pp]-', '')) as body from inp),
s2 as (select kind, input,
              case when body = '' then 'unknown' else array_to_string(string_split(body, ''), '/') end as shard,
              case when starts_with(input, 'scp-') then input
                   when starts_with(upper(input), 'SCP-') then lower(input)
                   else 'scp-' || lower(input) end as file_link
       from s)
select kind, input, shard, file_link, concat_ws('/', 'markdown', shard, file_link || '.md') as path from s2
""")

SQL["identifier_variants"] = q("," + VARIANTS + "select link, pos, variant from var")

SQL["lookup_many"] = q("," + VARIANTS + f""",
req0 as (select distinct l_partkey from lineitem),
req as (select cast(l_partkey as varchar) as request from req0
        union all select 'SCP-' || cast(l_partkey as varchar) from req0
        union all select 'scp-' || cast(l_partkey as varchar) || '-j' from req0),
rk as (select distinct request, key from (
         select request, upper(trim(request)) as key from req
         union all select request, upper({norm_sql('trim(request)')}) from req)),
vk as (select link, scp, scp_number, upper(variant) as key,
              case pos when 0 then 0 when 2 then 1 when 3 then 2 else 3 end as rnk from var),
m as (select rk.request, vk.link, vk.scp, vk.scp_number, min(vk.rnk) as match_rank
      from rk join vk using (key) group by rk.request, vk.link, vk.scp, vk.scp_number)
select request, link, match_rank from m
qualify row_number() over (partition by request
        order by match_rank, not regexp_matches(upper(scp), '^SCP-[0-9]+$'), scp_number, link) = 1
""")

HIT_SELECT = """link, scp, scp_number, title, rating, series,
       case when len(tags) > 0 then array_to_string(tags, ',') end as tags,
       created_at, creator, cast(null as varchar) as summary"""

SQL["item_hits"] = q(f"select {HIT_SELECT} from items_t")
SQL["items_index"] = q("""select link, scp, title, series, rating, (select count(*) from items) as total_count
from items""")
SQL["series_items"] = q(f"select {HIT_SELECT} from items_t where series = 'series-1'")
SQL["series_stats"] = q("""select series, count(*) as n_items, round(avg(rating), 6) as avg_rating,
       min(rating) as min_rating, max(rating) as max_rating from items group by series""")
SQL["search_page_2"] = q(f"select {HIT_SELECT} from items_t order by rating desc, link limit 25 offset 25")

PRIMARY = "coalesce(nullif(cast(null as varchar), ''), nullif(raw_content, ''), raw_source)"

SQL["content_fallback"] = q("""
select link,
       case when markdown <> '' then 'markdown' when raw_content <> '' then 'raw_content'
            when raw_source is not null then 'raw_source' end as primary_source,
       sha1(coalesce(nullif(markdown, ''), nullif(raw_content, ''), raw_source)) as primary_sha1,
       sha1(coalesce(nullif(summary, ''), nullif(markdown, ''), nullif(raw_content, ''), raw_source)) as summary_sha1,
       coalesce(nullif(summary, ''), nullif(markdown, ''), nullif(raw_content, ''), nullif(raw_source, '')) is not null as has_content,
       sha1(case when regexp_replace(coalesce(nullif(raw_content, ''), raw_source), '^\\s+|\\s+$', '', 'g') <> ''
                 then coalesce(nullif(raw_content, ''), raw_source) end) as html_sha1,
       coalesce(markdown, '') = '' as fallback
from items join stored using (scp_number)
""")

SQL["content_hashes"] = q("""
select link, case when nullif(raw_content, '') is not null then sha1(raw_content) end as content_sha1,
       sha1(raw_source) as source_sha1
from items
""")

SQL["attribution"] = q(f""",
ha as (select scp_number, list(distinct author) as h from item_history where author is not null group by scp_number)
select i.link, i.title, i.url,
       array_to_string(list_sort(list_distinct(
         list_concat(case when i.creator is not null then [i.creator] else [] end, coalesce(ha.h, [])))), ',') as authors,
       'CC BY-SA 3.0' as license,
       'Content from the SCP Wiki is licensed under CC BY-SA 3.0. Derivatives must be shared under the same license.'
         as notice, coalesce(length(coalesce(nullif(s.markdown, ''), nullif(raw_content, ''), raw_source)), 0) < 100 as short
from items i left join ha using (scp_number) join stored s using (scp_number)
""")

TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"

SQL["search_bm25"] = q(f""",
docs as (select link, concat_ws(' ', title, array_to_string(tags, ' '),
                                coalesce(nullif(raw_content, ''), raw_source)) as text from items_t),
toks as (select link, {TOKENS.format(x='text')} as toks from docs),
dl as (select link, len(toks) as dl from toks where len(toks) > 0),
post as (select link, term, count(*) as tf from (select link, unnest(toks) as term from toks) group by link, term),
stats as (select count(*) as n, avg(dl) as avgdl from dl),
dfs as (select term, count(*) as df from post group by term),
qt as (select query_id, term, count(*) as qtf
       from (select item_id as query_id, unnest({TOKENS.format(x='text')}) as term from benchmark)
       group by query_id, term),
scored as (
  select qt.query_id, p.link,
         round(sum(ln(1 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / stats.avgdl)) * qt.qtf), 6) as score
  from qt join post p using (term) join dfs using (term) join dl using (link) cross join stats
  group by qt.query_id, p.link)
select query_id, link, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, link) as rank from scored)
where rank <= 5
""")

SQL["vector_topk"] = """
with pos as (select label, i, cast(embedding[i] as double) as x
             from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
cent as (select cast(label as bigint) as query_id, list(x order by i) as qv
         from (select label, i, avg(x) as x from pos group by label, i) group by label),
e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
sc as (select c.query_id, e.vec_id,
              list_dot_product(e.v, c.qv) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.qv, c.qv)))
                as score
       from cent c cross join e)
select query_id, vec_id, rank from (
  select *, row_number() over (partition by query_id order by score desc nulls last, vec_id) as rank from sc)
where rank <= 3
"""

SQL["related_items"] = q(""",
refs as (select i.link, r.ref_link from items i join item_references r using (scp_number)),
seeds as (select link as seed from items where series = 'joke'),
e as (select s.seed, r.ref_link as link, 'references' as relation
      from seeds s join refs r on r.link = s.seed join items i on i.link = r.ref_link
      union all
      select s.seed, r.link, 'referenced_by' from seeds s join refs r on r.ref_link = s.seed)
select seed, link, count(*) as n_relations, array_to_string(list_sort(list(distinct relation)), ',') as relations
from e group by seed, link
""")

SQL["related_hubs"] = q(""",
hubs as (select i.link, h.hub from items i join item_hubs h using (scp_number)),
sizes as (select hub, count(*) as n_members from hubs group by hub),
seeds as (select link as seed from items where series = 'joke'),
sh as (select distinct s.seed, h.hub from seeds s join hubs h on h.link = s.seed)
select sh.seed, sh.hub, sizes.n_members - 1 as n_others from sh join sizes using (hub)
""")

SQL["dangling_references"] = q("""
select i.link, r.ref_link from items i join item_references r using (scp_number)
where r.ref_link not in (select link from items)
""")

SQL["random_item"] = q(f"""
select {HIT_SELECT} from items_t
where series = 'series-1' and list_contains(tags, 'euclid')
order by md5('7:' || scp), scp limit 1
""")

OLD_SNAPSHOT = """,
refs as (select i.link, r.ref_link from items i join item_references r using (scp_number)),
old as (select i.link, case when l.quality = 0 then sha1(i.raw_source) else i.content_sha1 end as content_sha1
        from items i join labels l on l.doc_id = i.scp_number
        union all
        select distinct ref_link as link, cast(null as varchar) from refs where ref_link not in (select link from items)),
new as (select link, content_sha1 from items),
diff as (
  select coalesce(o.link, n.link) as link, o.content_sha1 as old_sha1, n.content_sha1 as new_sha1,
         case when o.link is null then 'added' when n.link is null then 'removed'
              when o.content_sha1 is distinct from n.content_sha1 then 'updated' else 'unchanged' end as state
  from old o full outer join new n on o.link = n.link)
"""

SQL["snapshot_diff"] = q(OLD_SNAPSHOT + "select link, old_sha1, new_sha1, state from diff")
SQL["sync_summary"] = q(OLD_SNAPSHOT + "select state, count(*) as n_items from diff group by state")
SQL["merge_upsert"] = q(OLD_SNAPSHOT + """
select link, content_sha1, 'new' as origin from new
union all select link, content_sha1, 'old' from old where link not in (select link from new)
""")

VERSIONS = """
with pd as (select o_orderpriority as table_name, o_orderdate as created_at, count(*) as row_count
            from orders group by o_orderpriority, o_orderdate),
v as (select *, row_number() over (partition by table_name order by created_at) as version,
             substr(sha1(cast(created_at as varchar)), 1, 12) as dataset_commit from pd)
"""

SQL["retention_plan"] = VERSIONS + """,
r as (select *, row_number() over (partition by table_name order by version desc) as rn from v)
select table_name, version, created_at from r where rn > 20
"""

SQL["version_info"] = VERSIONS + """
select table_name, max(version) as current_version, count(*) as n_versions,
       arg_max(dataset_commit, version) as dataset_commit, arg_max(row_count, version) as current_rows,
       min(created_at) as first_created_at, max(created_at) as last_created_at,
       20 as keep_versions, 'daily' as cleanup
from v group by table_name
"""

SQL["dump_page"] = q("""
select link, scp, scp_number, title, series, rating, created_at, creator, url,
       case when len(tags) > 0 then array_to_string(tags, ',') end as tags, content_sha1
from items_t order by link limit 20 offset 10
""")


def yq(x: str) -> str:
    return f"""('"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"')"""


def iso_sql(x: str) -> str:
    us = f"(epoch_us({x}) % 1000000)"
    return (f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || case when {us} <> 0 "
            f"then '.' || lpad(cast({us} as varchar), 6, '0') else '' end)")


def list_block(name: str, x: str) -> str:
    return (f"case when len({x}) > 0 then '{name}:' || chr(10) || "
            f"array_to_string(list_transform({x}, lambda t: '  - ' || {yq('t')}), chr(10)) end")


FRONTMATTER = f"""concat_ws(chr(10), '---',
  'scp_id: ' || {yq("coalesce(scp, 'Unknown')")},
  'title: ' || {yq("coalesce(title, scp, 'Unknown')")},
  case when nullif(link, '') is not null then 'link: ' || {yq('link')} end,
  case when scp_number is not null then 'scp_number: ' || cast(scp_number as varchar) end,
  case when nullif(series, '') is not null then 'series: ' || {yq('series')} end,
  case when rating is not null then 'rating: ' || cast(rating as varchar) end,
  case when nullif(creator, '') is not null then 'author: ' || {yq('creator')} end,
  case when created_at is not null then 'created_at: ' || {yq(iso_sql('created_at'))} end,
  case when nullif(url, '') is not null then 'source_url: ' || {yq('url')} end,
  'domain: ' || {yq("'scp-wiki.wikidot.com'")},
  {list_block('tags', 'tags')},
  {list_block('references', 'refs')},
  case when nullif(content_sha1, '') is not null then 'content_sha1: ' || {yq('content_sha1')} end,
  'license: "CC BY-SA 3.0"',
  'license_url: "https://creativecommons.org/licenses/by-sa/3.0/"',
  '---')"""

ITEMS_FULL = """,
ref_arrays as (select scp_number, list_sort(list(ref_link)) as refs from item_references group by scp_number),
items_f as (select t.*, coalesce(r.refs, []) as refs from items_t t left join ref_arrays r using (scp_number))
"""

SQL["frontmatter"] = q(ITEMS_FULL + f"select link, {FRONTMATTER} as frontmatter from items_f")

FM_RE = r"(?s)\A[ \t]*---[ \t]*\r?\n(?:.*?\n)??[ \t]*---[ \t]*\r?(?:\n|\z)"

SQL["strip_frontmatter"] = q(ITEMS_FULL + f""",
docs as (select link, {FRONTMATTER} || chr(10) || chr(10) || raw_source as doc from items_f),
b as (select link, regexp_replace(regexp_replace(doc, {lit(FM_RE)}, ''), '^\\s+|\\s+$', '', 'g') as body from docs)
select link, sha1(body) as body_sha1, length(body) as body_len from b
""")

NUM_STRICT = ("(case when regexp_matches(regexp_replace(trim(scp), '^[Ss][Cc][Pp]-', ''), '^[+-]?[0-9]+$') "
              "then cast(regexp_replace(trim(scp), '^[Ss][Cc][Pp]-', '') as bigint) end)")
RAW = f""",
raw as (select i.link, i.scp, i.title, i.series, i.url, i.rating, i.creator, i.created_at, d.lang,
               {NUM_STRICT} as num
        from items i join documents d on d.doc_id = i.scp_number),
val as (select *, (link is not null and scp is not null and title is not null and series is not null
                   and url is not null and num is not null) as valid from raw)
"""

SQL["validate_items"] = q(RAW + """
select link, valid, num as scp_number,
       concat_ws(',', case when link is null then 'link' end, case when scp is null then 'scp' end,
                 case when title is null then 'title' end, case when series is null then 'series' end,
                 case when url is null then 'url' end, case when num is null then 'scp_number' end) as errors,
       concat_ws(',', case when rating is null then 'rating' end) as warnings,
       coalesce(rating, 0) as rating,
       case lang when 'fr' then created_at - interval 2 hour when 'de' then created_at + interval 330 minute
                 else created_at end as created_at
from val
""")

SQL["export_plan"] = q(""",
e as (select scp as label, link,
             lower(regexp_replace(scp, '^[Ss][Cc][Pp]-', '')) as body,
             case when starts_with(link, 'scp-') then link when starts_with(upper(link), 'SCP-') then lower(link)
                  else 'scp-' || lower(link) end as fl,
             scp_number in (select page_id from pages) as has_markdown,
             scp_number in (select doc_id from labels) as has_summary
      from items),
e2 as (select *, case when body = '' then 'unknown' else array_to_string(string_split(body, ''), '/') end as shard
       from e)
select label, link, concat_ws('/', 'markdown', shard, fl || '.md') as markdown_path,
       concat_ws('/', 'summary', shard, fl || '.md') as summary_path, has_markdown, has_summary
from e2
""")

SQL["run_counts"] = q(RAW + f""",
req as (select distinct {norm_sql('cast(l_partkey as varchar)', False)} as label from lineitem),
run as (select scp as label from val union select label from req),
st as (select run.label, case when v.valid is null then 'skipped' when v.valid then 'imported' else 'error' end
              as status
       from run left join (select scp as label, valid from val) v using (label))
select status, count(*) as n_items from st group by status
""")

# The same patterns as quire.functions.html_extract (fixed text).
TOKEN_RE = (r"(?i)<script[\s\S]*?</script\s*>|<style[\s\S]*?</style\s*>|<!--[\s\S]*?-->"
            r"|<[^>]+>|[^<]+|<")
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title\s*>"
HEADING_RE = r"(?is)<h[1-6][^>]*>.*?</h[1-6]\s*>"
LINK_RE = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
IMG_TAG_RE = r"(?is)<img\b[^>]*>"
ATTR_SRC_RE = r"""(?is)\ssrc\s*=\s*["']([^"']*)["']"""
ATTR_ALT_RE = r"""(?is)\salt\s*=\s*["']([^"']*)["']"""
BOILERPLATE_RE = (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
                  r"|<iframe\b[^>]*>.*?</iframe\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->")


def inner_text_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def body_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(BOILERPLATE_RE)}, ' ', 'g')"


TOKEN_KIND = """case when starts_with(lower(token), '<script') then 'script'
     when starts_with(lower(token), '<style') then 'style'
     when starts_with(token, '<!--') then 'comment'
     when starts_with(token, '</') then 'end_tag'
     when regexp_matches(token, '^<[^>]+>$') then 'tag' else 'text' end"""

SQL["page_tokens"] = f"""
with t as (select page_id, regexp_extract_all(html, {lit(TOKEN_RE)}, 0) as toks from pages),
u as (select page_id, i - 1 as seq, toks[i] as token from (select *, unnest(range(1, len(toks) + 1)) as i from t))
select page_id, seq, {TOKEN_KIND} as kind, length(token) as len, sha1(token) as token_sha1 from u
"""

SQL["page_links"] = f"""
with t as (select page_id, regexp_extract_all({body_sql('html')}, {lit(LINK_RE)}, 0) as ms from pages),
u as (select page_id, i - 1 as pos, ms[i] as m from (select *, unnest(range(1, len(ms) + 1)) as i from t))
select page_id, pos, regexp_extract(m, {lit(LINK_RE)}, 1) as href,
       {inner_text_sql(f"regexp_extract(m, {lit(LINK_RE)}, 2)")} as text
from u
"""

SQL["page_images"] = f"""
with t as (select page_id, regexp_extract_all({body_sql('html')}, {lit(IMG_TAG_RE)}, 0) as ms from pages),
u as (select page_id, i, regexp_extract(ms[i], {lit(ATTR_SRC_RE)}, 1) as src,
             regexp_extract(ms[i], {lit(ATTR_ALT_RE)}, 1) as alt
      from (select *, unnest(range(1, len(ms) + 1)) as i from t)),
v as (select *, row_number() over (partition by page_id order by i) - 1 as pos from u where src <> '')
select page_id, pos, src, alt,
       '![' || case when alt <> '' then alt else 'Image' end || '](' || src || ')' as markdown
from v
"""

SQL["page_headings"] = f"""
with t as (select page_id,
                  case when regexp_matches(html, {lit(TITLE_RE)})
                       then {inner_text_sql(f"regexp_extract(html, {lit(TITLE_RE)}, 1)")} end as title,
                  regexp_extract_all({body_sql('html')}, {lit(HEADING_RE)}, 0) as ms from pages),
u as (select page_id, title, i - 1 as pos, ms[i] as m
      from (select *, unnest(case when len(ms) = 0 then [null::bigint]
                                  else range(1, len(ms) + 1) end) as i from t))
select page_id, title, pos,
       cast(regexp_extract(m, '(?i)^<h([1-6])', 1) as integer) as level,
       {inner_text_sql("regexp_extract(m, '(?is)^<h[1-6][^>]*>(.*)</h[1-6]\\s*>$', 1)")} as text
from u
"""

SQL["page_text"] = f"""
with t as (select page_id, {inner_text_sql(body_sql('html'))} as text from pages)
select page_id, length(text) as text_len, sha1(text) as text_sha1 from t
"""

SQL["search_ranked_page"] = q(f""",
docs as (select link, concat_ws(' ', title, array_to_string(tags, ' '),
                                coalesce(nullif(raw_content, ''), raw_source)) as text from items_t),
toks as (select link, {TOKENS.format(x='text')} as toks from docs),
dl as (select link, len(toks) as dl from toks where len(toks) > 0),
post as (select link, term, count(*) as tf from (select link, unnest(toks) as term from toks) group by link, term),
stats as (select count(*) as n, avg(dl) as avgdl from dl),
dfs as (select term, count(*) as df from post group by term),
qt as (select query_id, term, count(*) as qtf
       from (select item_id as query_id, unnest({TOKENS.format(x='text')}) as term from benchmark) group by query_id, term),
mine as (select * from items_t where series = 'series-1' and list_contains(tags, 'lang-en')),
scored as (
  select qt.query_id, p.link,
         round(sum(ln(1 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / stats.avgdl)) * qt.qtf), 6) as score
  from qt join post p using (term) join dfs using (term) join dl using (link) cross join stats
  where p.link in (select link from mine) group by qt.query_id, p.link),
listed as (select *, row_number() over (partition by query_id order by score desc, link) as place from scored)
select {HIT_SELECT}, query_id, score, place - 25 as rank from mine join listed using (link) where place between 26 and 50
""")

SQL["catalog_profile"] = q("""
select series, count(*) as n_rows,
       count(*) filter (where rating >= 1000) as n_rating_ge_1000,
       count(*) filter (where list_contains(tags, 'euclid')) as n_euclid,
       count(*) filter (where list_contains(tags, 'hostile')) as n_hostile,
       count(*) filter (where coalesce(nullif(raw_content, ''), nullif(raw_source, '')) is not null) as n_with_content,
       count(*) filter (where creator is null) as n_no_creator
from items_t group by series
""")

_head, _tail = SQL["lookup_many"].split("select request, link, match_rank from m\nqualify", 1)
SQL["item_content"] = (_head.rstrip().rstrip(",") + """,
best as (select request, link from m
qualify""" + _tail.rstrip() + """)
select b.request, i.link, i.url, i.content_sha1, coalesce(s.markdown, '') = '' as fallback,
       sha1(coalesce(nullif(s.markdown, ''), nullif(i.raw_content, ''), i.raw_source)) as best_sha1,
       sha1(coalesce(nullif(s.summary, ''), nullif(s.markdown, ''), nullif(i.raw_content, ''), i.raw_source)) as summary_sha1
from best b join items i using (link) join stored s using (scp_number)
""")

SQL["item_metadata"] = (_head.rstrip().rstrip(",") + """,
best as (select request, link, match_rank from m
qualify""" + _tail.rstrip() + """)
select b.request, b.match_rank, i.link, i.scp, i.scp_number, i.title, i.series, i.rating,
       cast(i.created_at as timestamp) as created_at, i.creator, i.url
from best b join items i using (link)
""")


def iso_sql(x: str) -> str:
    return (f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({x}) % 1000000 <> 0 "
            f"then '.' || strftime({x}, '%f') else '' end)")


SQL["dump_json"] = q(f""",
r as (select scp_number, string_agg(ref_link, ',' order by ref_link) as r from item_references group by scp_number),
h as (select scp_number, string_agg(concat_ws('|', author, {iso_sql('cast("date" as timestamp)')}, comment), ',' order by seq) as h
      from item_history group by scp_number)
select i.link, i.scp, i.title, i.series, i.url, i.creator, {iso_sql('cast(i.created_at as timestamp)')} as created_at, i.content_sha1,
       i.scp_number, i.rating, array_to_string(i.tags, ',') as tags, coalesce(r.r, '') as "references", b.hub as hubs,
       sha1(i.raw_source) as source_sha1, sha1(i.raw_content) as html_sha1, sha1(coalesce(h.h, '')) as history_sha1
from items_t i join item_hubs b using (scp_number) left join r using (scp_number) left join h using (scp_number)
""")

SQL["export_json"] = SQL["dump_json"].replace("select i.link, i.scp,", """select 'json/' || array_to_string(string_split(
       lower(regexp_replace(i.scp, '^SCP-', '')), ''), '/') || '/' || i.link || '.json' as path, i.link, i.scp,""")


# J0-J17 for the tags that the pages hold: text nodes of the body by the block
# tag before them (TOKEN_RE splits as the page job's tokens do).
BLOCK_TAGS = "'nav', 'ul', 'li', 'div', 'h1', 'h2', 'h3', 'p', 'article', 'footer', 'body', 'html'"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ENTITIES = [("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")]


def unescape_sql(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


PAGE_TOKENS = f"""
pt as (select page_id, regexp_extract_all(html, {lit(TOKEN_RE)}, 0) as toks from pages where html is not null),
pu as (select page_id, i as seq, toks[i] as token from (select *, unnest(range(1, len(toks) + 1)) as i from pt)),
pk as (select page_id, seq, token,
              case when regexp_matches(token, '^(?i)<(script|style)') then 'raw'
                   when starts_with(token, '<!') or starts_with(token, '<?') then 'skip'
                   when starts_with(token, '</') then 'close' when starts_with(token, '<') then 'open' else 'text' end as kind,
              lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pu),
pb as (select page_id, min(seq) as body from pk where kind = 'open' and tag = 'body' group by page_id)
"""

SQL["clean_pages"] = f"""with {PAGE_TOKENS},
n as (select page_id, seq, kind, token, coalesce(body, 0) as body,
             case kind when 'open' then 1 when 'text' then 1
                  when 'raw' then 1 + cast(regexp_extract(token, '^<[^>]*>([\\s\\S]*)</', 1) <> '' as int) else 0 end as nodes
      from pk left join pb using (page_id))
select page_id, cast(sum(nodes) filter (where seq <= body) as int) as root, cast(sum(nodes) as int) as n_nodes,
       cast(count(*) filter (where kind = 'text' and seq > body) as int) as n_live_text,
       sha1(coalesce(string_agg({unescape_sql('token')}, '' order by seq) filter (where kind = 'text' and seq > body), ''))
         as text_sha1, cast(null as varchar) as shred_error
from n group by page_id
"""

PAGES_MD = PAGE_TOKENS + f""",
pm as (select k.*, max(case when kind in ('open', 'close') and tag in ({BLOCK_TAGS}) then seq end)
                     over (partition by k.page_id order by seq) as blk,
              max(case when kind = 'open' and tag = 'ul' then seq end) over (partition by k.page_id order by seq) as ul
       from pk k),
px as (select m.page_id, m.blk, max(m.ul) as ul, max(b.kind || b.tag) as mark,
              {STRIP.format(f"string_agg({unescape_sql('m.token')}, '' order by m.seq)")} as text
       from pm m join pb using (page_id) join pk b on b.page_id = m.page_id and b.seq = m.blk
       where m.kind = 'text' and m.seq > pb.body group by m.page_id, m.blk),
pl as (select page_id, case when mark = 'openli' then ul else blk end as unit, blk, mark = 'openli' as item,
              case when mark = 'openli' then '- ' when mark in ('openh1', 'openh2', 'openh3')
                   then repeat('#', cast(right(mark, 1) as int)) || ' ' else '' end || text as line
       from px where text <> ''),
pn as (select page_id, unit, string_agg(line, chr(10) order by blk) as part from pl group by page_id, unit),
pa as (select page_id, string_agg(part, chr(10) || chr(10) order by unit) as md from pn group by page_id),
page_md as (select page_id, {STRIP.format("""regexp_replace(regexp_replace(regexp_replace(md,
              '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'),
              '\\n\\n\\n+', chr(10) || chr(10), 'g')""")} as md from pa)
"""

SQL["pages_to_markdown"] = f"""with {PAGES_MD}
select page_id, md as markdown, case when md is not null then 'converted' end as md_source, cast(null as varchar) as error
from pages left join page_md using (page_id)
"""

SQL["export_markdown"] = q(ITEMS_FULL + f""", {PAGES_MD},
e as (select f.*, st.markdown as kept, coalesce(nullif(m.md, ''), '') <> '' as has_md, m.md, nullif(f.raw_content, '') is not null as has_html,
             array_to_string(string_split(lower(regexp_replace(f.scp, '^SCP-', '')), ''), '/') as shard
      from items_f f join stored st using (scp_number) left join page_md m on m.page_id = f.scp_number),
d as (select link, kept, 'markdown/' || shard || '/' || link || '.md' as path,
             case when kept <> '' then 'markdown' when has_html and has_md then 'converted' when has_html then 'raw_html'
                  when nullif(raw_source, '') is not null then 'raw_source' end as source,
             {FRONTMATTER} as fm, title, md, raw_content, raw_source from e),
b as (select link, path, source, concat_ws(chr(10), fm, '', '# ' || title, '', '## Content', '',
             case source when 'markdown' then kept
                  when 'converted' then '*Note: Content converted from HTML to Markdown*' || chr(10) || chr(10) || md
                  when 'raw_html' then '*Note: Content displayed as raw HTML*' || chr(10) || chr(10) || '```html' || chr(10)
                                       || raw_content || chr(10) || '```'
                  when 'raw_source' then '*Note: Content displayed as raw source*' || chr(10) || chr(10) || '```' || chr(10)
                                         || raw_source || chr(10) || '```'
                  else '*No content available*' end, '') as body from d)
select link, path, source, cast(length(body) as int) as body_len, sha1(body) as body_sha1 from b
""")

SQL["related_hits"] = q(""",
refs as (select i.link, r.ref_link from items i join item_references r using (scp_number)),
seeds as (select link as seed from items where series = 'joke'),
e as (select s.seed, r.ref_link as link, 'references' as relation
      from seeds s join refs r on r.link = s.seed join items i on i.link = r.ref_link
      union all
      select s.seed, r.link, 'referenced_by' from seeds s join refs r on r.ref_link = s.seed),
g as (select seed, link, count(*) as n_relations, array_to_string(list_sort(list(distinct relation)), ',') as relations
      from e group by seed, link)
select g.seed, row_number() over (partition by g.seed order by n_relations desc, t.rating desc nulls last, g.link) as pos,
       g.link, g.n_relations, g.relations, t.scp, t.scp_number, t.title, t.series, t.rating,
       case when len(t.tags) > 0 then array_to_string(t.tags, ',') end as tags
from g join items_t t using (link)
""")

SQL["import_snapshot"] = q(f"""
select i.link, i.scp, i.scp_number, i.title, i.series, coalesce(i.rating, 0) as rating, i.created_at, i.creator, i.url,
       'scp-wiki.wikidot.com' as domain, case when i.raw_content <> '' then i.content_sha1 end as content_sha1,
       sha1(i.raw_source) as raw_source_sha1,
       (select string_agg(tag, ',' order by tag) from item_tags t where t.scp_number = i.scp_number) as tags,
       (select string_agg(hub, ',' order by hub) from item_hubs h where h.scp_number = i.scp_number) as hubs,
       (select string_agg(ref_link, ',' order by ref_link) from item_references r
         where r.scp_number = i.scp_number) as refs,
       coalesce(len(regexp_extract_all(i.raw_content, {lit(IMG_RE)}, 1)), 0) as n_images,
       (select count(*) from item_history h where h.scp_number = i.scp_number) as n_history,
       (select max(date) from item_history h where h.scp_number = i.scp_number) as last_edit,
       true as has_file, 'bbbbbbbbbbbb' as dataset_commit, (select count(*) from items where title is not null) as total_count
from items i where i.title is not null
""")

SQL["summary_worklist"] = q(f""",
{PAGES_MD},
w as (select i.link, i.scp, i.title, nullif(s.markdown, '') as kept, nullif(m.md, '') as md, nullif(i.raw_content, '') as html,
             nullif(i.raw_source, '') as raw
      from items i join stored s using (scp_number) left join page_md m on m.page_id = i.scp_number
      where i.scp_number not in (select doc_id from labels)),
v as (select link, scp, title, case when kept is not null then 'markdown' when html is not null and md is not null then 'converted'
                                    when html is not null then 'raw_html' when raw is not null then 'raw_source' end as source,
             coalesce(kept, case when html is not null then md end, html, raw) as text from w),
n as (select *, ceil(length(text) / 102000.0)::bigint as n_parts from v where source is not null),
p as (select link, source, part, n_parts, {lit(PROMPT_HEAD)} || scp || ' - ' || coalesce(title, scp) || chr(10) || chr(10) || 'Content:' || chr(10)
             || substr(text, (part - 1) * 102000 + 1, 102000) || chr(10) as prompt
      from n, unnest(range(1, n_parts + 1)) t(part))
select link, source, part, n_parts, sha1(prompt) as prompt_sha1, length(prompt) as prompt_len from p
""")

SQL["related_with_hubs"] = q(""",
refs as (select i.link, r.ref_link from items i join item_references r using (scp_number)),
hubs as (select i.link, h.hub from items i join item_hubs h using (scp_number)),
seeds as (select link as seed from items where series = 'joke'),
e as (select s.seed, r.ref_link as link, 'references' as relation
      from seeds s join refs r on r.link = s.seed join items i on i.link = r.ref_link
      union all
      select s.seed, r.link, 'referenced_by' from seeds s join refs r on r.ref_link = s.seed
      union all
      select s.seed, o.link, 'shared_hub' from seeds s join hubs h on h.link = s.seed join hubs o on o.hub = h.hub and o.link <> s.seed),
g as (select seed, link, count(*) as n_relations, array_to_string(list_sort(list(distinct relation)), ',') as relations from e group by seed, link),
r as (select g.*, row_number() over (partition by g.seed order by n_relations desc, i.rating desc nulls last, g.link) as pos
      from g join items i using (link))
select seed, pos, link, n_relations, relations from r where pos <= 25
""")

SQL["history_parse"] = q(f""",
h as (select scp_number, count(*) as n, string_agg(concat_ws('|', author, {iso_sql('cast("date" as timestamp)')}, comment), ',' order by seq) as h
      from item_history group by scp_number)
select i.link, coalesce(h.n, 0) as n_edits, cast(null as varchar) as raw, sha1(coalesce(h.h, '')) as edits_sha1
from items i left join h using (scp_number)
union all select 'event-' || event_id, null, props, null from events
""")

SQL["import_large_maps"] = q(f"""
select i.scp as label, i.link, i.title, i.series, i.creator, {iso_sql('cast(i.created_at as timestamp)')} as created_at,
       case when i.raw_content <> '' then i.content_sha1 end as content_sha1, sha1(i.raw_source) as raw_source_sha1,
       (select string_agg(ref_link, ',' order by ref_link) from item_references r where r.scp_number = i.scp_number) as refs,
       (select count(*) from item_history h where h.scp_number = i.scp_number) as n_history, 'cccccccccccc' as dataset_commit
from items i
""")

SQL["sync_stream"] = q(""",
refs as (select i.link, r.ref_link from items i join item_references r using (scp_number)),
old as (select i.link, i.scp_number, i.title, case when i.raw_content <> '' then sha1(
               i.raw_content || case when l.quality = 0 then '<p>old</p>' else '' end) end as content_sha1
        from items i join labels l on l.doc_id = i.scp_number where i.title is not null
        union all
        select distinct ref_link, cast(regexp_extract(ref_link, '[0-9]+') as bigint), ref_link, cast(null as varchar)
        from refs where ref_link not in (select link from items)),
new as (select link, scp_number, title, case when raw_content <> '' then content_sha1 end as content_sha1 from items where title is not null),
d as (select case when o.link is null then 'added' when n.link is null then 'removed'
                  when o.content_sha1 is distinct from n.content_sha1 then 'updated' else 'unchanged' end as state
      from old o full outer join new n on o.link = n.link),
c as (select count(*) filter (state = 'added') as added, count(*) filter (state = 'updated') as updated,
             count(*) filter (state = 'unchanged') as unchanged, count(*) filter (state = 'removed') as removed from d)
select cast(1 as bigint) as version, 'scp-1700000000-aaaaaaaaaaaa' as snapshot, 'aaaaaaaaaaaa' as dataset_commit, link, scp_number, title, content_sha1,
       (select count(*) from old) as added, cast(0 as bigint) as updated, cast(0 as bigint) as unchanged, cast(0 as bigint) as removed, cast(0 as bigint) as errors from old
union all
select 2, 'scp-1800000000-bbbbbbbbbbbb', 'bbbbbbbbbbbb', link, scp_number, title, content_sha1, added, updated, unchanged, removed, 0 from new, c
""")

SQL["staged_round_trip"] = q(f""",
{PAGES_MD},
w as (select i.link, i.scp, i.scp_number, i.title, i.raw_content as html, i.raw_source, nullif(m.md, '') as md
      from items i left join page_md m on m.page_id = i.scp_number where i.title is not null),
t as (select link, coalesce(nullif(html, ''), nullif(raw_source, '')) as text, scp, title from w
      where scp_number not in (select doc_id from labels)),
p as (select link, part, {lit(PROMPT_HEAD)} || scp || ' - ' || coalesce(title, scp) || chr(10) || chr(10) || 'Content:' || chr(10)
             || substr(text, (part - 1) * 102000 + 1, 102000) || chr(10) as prompt
      from t, unnest(range(1, ceil(length(text) / 102000.0)::bigint + 1)) u(part) where text is not null),
s as (select link, string_agg('Summary of ' || length(prompt) || ' characters, ' || md5(prompt), chr(10) || chr(10) order by part) as summary
      from p group by link),
b as (select w.link, w.raw_source, s.summary, case when html is not null then {STRIP.format("""concat_ws(chr(10), '# ' || title, '', '## Content', '',
             case when html <> '' and md is not null then '*Note: Content converted from HTML to Markdown*' || chr(10) || chr(10) || md
                  when html <> '' then '*Note: Content displayed as raw HTML*' || chr(10) || chr(10) || '```html' || chr(10) || html || chr(10) || '```'
                  else '*Note: Content displayed as raw source*' || chr(10) || chr(10) || '```' || chr(10) || raw_source || chr(10) || '```' end)""")} end as markdown
      from w left join s using (link))
select link, sha1(markdown) as markdown_sha1, length(markdown) as markdown_len, summary, sha1(raw_source) as raw_source_sha1 from b
""")
