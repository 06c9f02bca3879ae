"""The registered queries of the traceability engine over the whole made corpus, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markdown import file_sections
from ..lineage import cut, placed
from ..operators import audit, authority, closure, drift, graph, reconcile
from ..operators import lattice as L
from ..sources import documents, links, sinks, snapshot
from ..sources.config import glob_match
from ..sources.frontmatter import parsed
from ..sources.tickets import parse_responses, requests
from ..writer import rewrite
from .corpus import ORACLE, TEAM, canonical_sql, files, hash_sql, lattice, linked, malformed, nodes, raw_edges, reach_sql, responses, star_edges, star_lattice, table, tickets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the impact queries start from.
FILE = "doc-3"
SECTION = "(select min(target_key) from targets where anchor = 'l11')"


def _section(found: L.Lattice) -> str:
    """The first section of that name, as SECTION says in SQL."""
    return found.targets.where("anchor = 'l11'").agg(F.min("target_key")).first()[0]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Text


@query(f"select doc_id, {hash_sql('text')} as hash, cast(length({canonical_sql('text')}) as int) as length from documents")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"), F.length(T.canonicalize("text")).alias("length"))


@query("select doc_id, cast(greatest(1, len(string_split(text, chr(10))) - case when text = '' or text like '%' || chr(10) then 1 else 0 end) as int) as lines from documents")
def line_split_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count("text").alias("lines"))


@query(
    r"select page_id, url, case when contains(url, '#') then regexp_extract(url, '^(.*)#([^#]*)$', 1) else url end as file_id, case when contains(url, '#') then regexp_extract(url, '^(.*)#([^#]*)$', 2) end as anchor from pages"
)
def parse_ref(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", T.ref_file("url").alias("file_id"), T.ref_anchor("url").alias("anchor"))


@query(
    r"""select doc_id, regexp_matches(text, '[\x00-\x1F\x7F-\x{9F}]') as found,
    case when regexp_matches(text, '[\x00-\x1F\x7F-\x{9F}]') then cast(length(regexp_extract(text, '(?s)\A(.*?)[\x00-\x1F\x7F-\x{9F}]', 1)) as int) end as first_at,
    cast(length(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g')) as int) as clean_length from documents"""
)
def control_char_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_control("text").alias("found"), T.first_control("text").alias("first_at"), F.length(T.strip_control("text")).alias("clean_length"))


@query(
    "select id, replace(coalesce(nullif(title, ''), id), '\"', '''') as mermaid, replace(replace(coalesce(nullif(title, ''), id), '\\', '\\\\'), '\"', '\\\"') as dot, list_position(['exploratory', 'derived', 'binding'], authority) - 1 as rank from docs".join(
        [ORACLE, ""]
    )
)
def node_labels(spark, sf_dir):
    name = T.label("title", "id")
    return nodes(spark, sf_dir).select("id", T.mermaid_escape(name).alias("mermaid"), T.dot_escape(name).alias("dot"), T.authority_rank("authority").alias("rank"))


# Sources


@query(
    f"""with recursive d as (select doc_id, doc_id % 10 as k, coalesce(text, '') as text from documents where doc_id is not null)
    select 'docs/' || doc_id || '.md' as path, case when k = 9 then null when k = 8 then 'id-less' when k = 7 then 'untracked' else 'tracked' end as disposition,
      case when k < 7 then 'doc-' || doc_id end as id, cast(case when k < 7 then 2 + (doc_id % 4 = 1)::int else 0 end as int) as edges,
      case when k <> 9 then {hash_sql('text')} end as body_hash, case when k = 9 then 'FRONTMATTER_ERROR' end as error_code from d"""
)
def frontmatter_disposition(spark, sf_dir):
    edges = F.coalesce(F.size(F.coalesce("derives_from", F.array().cast("array<struct<ref:string,seen:string>>"))), F.lit(0))
    return parsed(files(spark, sf_dir)).select("path", "disposition", "id", edges.alias("edges"), T.content_hash("body").alias("body_hash"), "error_code")


_CHANGED = "doc_id % 10 = 3"


@query(
    """with d as (select doc_id as k, 'docs/' || doc_id || '.md' as path from documents where doc_id is not null)
    select path, 'id-less' as kind, cast(null as varchar) as what from d where k % 10 = 8
    union all select path, 'reused-anchor', null from d where k % 10 < 7 and k % 6 = 2
    union all select path, 'repeated-edge', 'doc-' || k || ' doc-' || k from d where k % 10 < 7 and k % 4 = 1"""
)
def document_warnings(spark, sf_dir):
    return documents.questionable(parsed(files(spark, sf_dir)))


@query(
    """with d as (select doc_id % 6 as k, 'docs/' || doc_id || '.md' as path, coalesce(text, '') as text, chr(39) as q from documents where doc_id is not null),
    said as (select path, case when k in (1, 2) then 'UNREADABLE_DOC' else 'FRONTMATTER_ERROR' end as error_code,
      case k when 1 then q || path || q || ' is not UTF-8: invalid start byte at byte ' || strlen(text)
        when 2 then 'the frontmatter of ' || q || path || q || ' has no closing ' || q || '---' || q
        when 3 then 'invalid frontmatter in ' || q || path || q || ':' || chr(10) || '  owner: unknown key; there are id, title, layer, authority, derives_from, tickets' || chr(10) || '  derives_from.0.sen: unknown key; there are ref, seen'
        when 4 then 'invalid frontmatter in ' || q || path || q || ':' || chr(10) || '  id: must be a string' || chr(10) || '  layer: must be one of design, technical, production' || chr(10) || '  tickets: must be a list'
        when 5 then q || path || q || ' declares ' || q || 'tickets' || q || ' but has no ' || q || 'id' || q end as error_message from d where k > 0)
    select * from said"""
)
def document_errors(spark, sf_dir):
    return parsed(malformed(spark, sf_dir)).where("error_code is not null").select("path", "error_code", "error_message")


_SEEN = "'f' || lpad(cast(doc_id as varchar), 31, '0')"


@query(
    rf"""with d as (select doc_id, doc_id % 6 = 2 as named, {_SEEN} as seen, coalesce(text, '') as text from documents where doc_id is not null and doc_id % 10 < 7),
    w as (select doc_id, text, '---' || chr(10) || 'id: doc-' || doc_id || chr(10) || case when named then 'title: &t T' || chr(10) else '' end || 'authority: derived' || chr(10) || 'derives_from:' || chr(10)
      || '- ref: doc-' || doc_id || chr(10) || '  seen: ' || seen || chr(10)
      || '- {{ref: ''doc-0#l1'', seen: ' || case when doc_id % 3 = 0 or doc_id = 0 then seen else 'null' end || '}}' || chr(10)
      || case when doc_id % 4 = 1 then '- {{seen: ' || seen || ', ref: doc-' || doc_id || '}}' || chr(10) else '' end
      || 'tickets: [' || case when named then '&t ' else '' end || 'ENG-' || doc_id || ']' || chr(10) || '---' || chr(10) as meta from d)
    select 'docs/' || doc_id || '.md' as path, sha256(meta || text) as sha256, case when doc_id % 3 = 0 then 'doc-0#l1 ' else '' end || 'doc-' || doc_id as applied, cast(null as varchar) as error_code from w where doc_id <> 0
    union all select 'docs/0.md', sha256(meta || text), 'doc-0 doc-0#l1', null from w where doc_id = 0"""
)
def rewritten_frontmatter(spark, sf_dir):
    """New hashes for every document's edge to itself, and for a third of them for the second one too, as bytes of the rewritten file. Files without such edges give no row."""
    new = F.expr(_SEEN.replace("varchar", "string"))
    both = F.array(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 0, F.lit("doc-0#l1")))
    made = files(spark, sf_dir)
    planned = made.select("path", F.explode(F.array_compact(both)).alias("ref"), new.alias("new_seen"))
    return rewrite.rewritten(made, planned).select("path", F.sha2("content", 256).alias("sha256"), F.array_join("applied", " ").alias("applied"), "error_code")


_TEAM_VALUES = "select p_brand as value from part union select o_orderpriority from orders union select c_mktsegment from customer union select upper(p_name) from part union select 'ENG' || p_size from part"


@query(f"select value, regexp_full_match(value, '[A-Z][A-Z0-9]*') as ok from ({_TEAM_VALUES})")
def team_keys(spark, sf_dir):
    for name in ("part", "orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_TEAM_VALUES).select("value", T.is_team_key("value").alias("ok"))


@query(
    """with d as (select doc_id, coalesce(text, '') as text, doc_id % 4 as k, contains(coalesce(text, ''), chr(10)) as many from documents)
    select doc_id, case when k = 1 and many then 'CRLF' when k = 2 and many then 'CR' when k = 3 and text = '' then 'CRLF' when k = 3 and not many then 'CRLF' else 'LF' end as ending from d"""
)
def line_endings(spark, sf_dir):
    """Documents with LF as they are, with CRLF, with CR, and with both LF and CRLF."""
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    made = F.when(k == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace(text, F.lit("\n"), F.lit("\r"))).when(k == 3, F.concat(text, F.lit("\r\n"))).otherwise(text)
    name = F.replace(F.replace(T.line_ending("made"), F.lit("\r"), F.lit("CR")), F.lit("\n"), F.lit("LF"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).select("doc_id", name.alias("ending"))


@query(
    f"""select '{TEAM}-' || o_orderkey as ticket_ref, '{TEAM}-' || o_orderkey as identifier, 'Order ' || o_orderpriority as title, 'https://t.invalid/{TEAM}-' || o_orderkey as url,
      o_orderstatus as state, case when o_orderkey % 3 = 0 then '{TEAM}-' || o_orderkey || 'a:part' else '' end as children from orders"""
)
def tickets_from_json(spark, sf_dir):
    listed = F.array_join(F.transform("ticket.children", lambda c: F.concat_ws(":", c["identifier"], c["title"])), " ")
    return parse_responses(responses(spark, sf_dir)).select("ticket_ref", "ticket.identifier", "ticket.title", "ticket.url", F.col("ticket.state.name").alias("state"), listed.alias("children"))


_LINKS = """with p as (select page_id as k, 'k/' || page_id || '.md' as path from pages where page_id is not null),
    found as (
      select path, cast(3 as int) as line, (k + 7) || '.md#page' as target, 'k/' || (k + 7) || '.md' as file, 'page' as fragment from p
      union all select path, 3, '../k/' || k || '.md#lost', 'k/' || k || '.md', 'lost' from p
      union all select path, 10, '../../far.md', null, null from p)
"""


@query(_LINKS + "select path, line, target from found")
def doc_links(spark, sf_dir):
    return links.links(linked(spark, sf_dir))


@query(_LINKS + "select * from found")
def link_targets(spark, sf_dir):
    return links.resolved(links.links(linked(spark, sf_dir)))


@query(
    _LINKS
    + """select path, line, target, case when file is null then 'escapes' when file not in (select path from p) then 'no such file' else 'no such heading' end as why
    from found where file is null or file not in (select path from p) or fragment = 'lost'"""
)
def broken_links(spark, sf_dir):
    docs = linked(spark, sf_dir)
    heads = docs.select(F.col("path").alias("file_id"), F.inline(file_sections("body")))
    return links.broken(docs, heads, docs)


@query(_LINKS + "select path, cast(10 as int) as line from p")
def raw_anchor_lines(spark, sf_dir):
    return links.anchor_lines(linked(spark, sf_dir))


@query(f"select 'docs/' || doc_id || '.md' as path, not ({_CHANGED}) and doc_id % 17 <> 0 as hit from documents where doc_id is not null")
def cache_lookup(spark, sf_dir):
    """A snapshot without every 17th file, and files of which every tenth has changed since."""
    now = files(spark, sf_dir)
    was = F.when(F.expr(_CHANGED), F.concat("content", F.lit(b"old"))).otherwise(F.col("content"))
    known = now.where("doc_id % 17 <> 0").select("path", F.create_map(F.lit(""), F.struct("length", "modificationTime")).alias("stats"), F.sha2(was, 256).alias("sha256"))
    return snapshot.lookup(now, known)


@query("select 'docs/' || doc_id || '.md' as path, doc_id % 17 <> 0 and doc_id % 3 <> 0 and doc_id % 10 <> 3 as hit from documents where doc_id is not null")
def cache_lookup_stat(spark, sf_dir):
    """The same by size and time, of which this root has seen two thirds of the files, and a tenth at another time."""
    now = files(spark, sf_dir)
    time = F.when(F.expr(_CHANGED), F.col("modificationTime") - F.expr("interval 1 second")).otherwise(F.col("modificationTime"))
    mine = F.when(F.col("doc_id") % 3 == 0, F.lit("there")).otherwise(F.lit("here"))
    known = now.where("doc_id % 17 <> 0").select("path", F.create_map(mine, F.struct("length", time.alias("modificationTime"))).alias("stats"), F.lit("").alias("sha256"))
    return snapshot.lookup(now, known, True, "here")


@query(
    f"""with d as (select doc_id, doc_id % 5 <> 4 as here, doc_id % 17 <> 0 as known, {_CHANGED} as changed from documents where doc_id is not null)
    select 'docs/' || doc_id || '.md' as path, case when here and known and not changed then 'a b' when here then 'b' else 'a' end as roots,
      case when doc_id % 10 < 7 then 'doc-' || doc_id end as id, doc_id % 10 = 3 and not here as outdated from d where here or known"""
)
def cache_refresh(spark, sf_dir):
    """A snapshot that root a has filled, as root b finds it: b lacks a fifth of the files, and a tenth have changed since."""
    now = files(spark, sf_dir)
    was = F.when(F.expr(_CHANGED), F.concat("content", F.lit(b"old"))).otherwise(F.col("content"))
    before = snapshot.refresh(now.where("doc_id % 17 <> 0").withColumn("content", was), None, root="a")
    after = snapshot.refresh(now.where("doc_id % 5 <> 4"), cut(before), root="b")
    return after.select("path", F.array_join(F.array_sort(F.map_keys("stats")), " ").alias("roots"), "id", F.coalesce(F.col("body").endswith("old"), F.lit(False)).alias("outdated"))


@query("select 'docs/' || doc_id || '.md' as path, cast(1 + (doc_id % 2) as int) as kept from documents where doc_id is not null and doc_id % 3 <> 2")
def cache_evict(spark, sf_dir):
    """Records of roots that were used lately stay; files that only other roots have seen go."""
    pair = lambda k, on: F.when(on, F.struct(F.lit(k).alias("key"), F.lit(1).alias("value")))
    on = F.col("doc_id") % 3 != 2
    stats = F.map_from_entries(F.array_compact(F.array(pair("a", on), pair("b", on & (F.col("doc_id") % 2 == 1)), pair("gone", F.lit(True)))))
    known = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), stats.alias("stats"))
    return snapshot.evict_stats(known, snapshot.evicted(["gone", *"cdefghi"], "b") + ["a"]).select("path", F.size("stats").alias("kept"))


_IGNORED = ("en/*", "**/1*.md", "f?/doc-[2-4]?.md", "de/**/x*")


@query(
    """with p as (select coalesce(lang, 'xx') || '/' || case when doc_id % 3 = 0 then 'deep/' else 'doc-' end || doc_id || '.md' as path from documents where doc_id is not null)
    select path, regexp_full_match(path, 'en/[^/]+') or regexp_full_match(path, '(.*/)?1[^/]*[.]md') or regexp_full_match(path, 'f[^/]/doc-[2-4][^/][.]md') or regexp_full_match(path, 'de/(.*/)?x[^/]*') as ignored from p"""
)
def ignored_paths(spark, sf_dir):
    name = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "deep/").otherwise("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    named = table(spark, sf_dir, "documents").where("doc_id is not null").select(name.alias("path"))
    return named.select("path", glob_match(F.col("path"), _IGNORED).alias("ignored"))


@query("select page_id, cast(len(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*(?:\"[^\"]*\"|''[^'']*'')')) as int) as n_anchors from pages")
def raw_anchors(spark, sf_dir):
    return links.raw_anchors(table(spark, sf_dir, "pages"), "page_id", "html")


# Sections


@query(ORACLE + 'select id as file_id, pos, level, text, marker, slug, anchor, start, "end" from secs')
def headings(spark, sf_dir):
    return L.headings(nodes(spark, sf_dir)).drop("ancestors")


@query(ORACLE + "select id as file_id, anchor, hash, start, \"end\" from targets t join docs d on d.id = t.file_id where kind = 'section'")
def section_hash(spark, sf_dir):
    return L.file_targets(nodes(spark, sf_dir)).where("kind = 'section'").select("file_id", "anchor", "hash", "start", "end")


@query(
    ORACLE
    + 'select s.id || \'#\' || s.anchor as target_key, o.id || \'#\' || o.anchor as ancestor_key, cast(row_number() over (partition by s.id, s.pos order by o.start) - 1 as int) as pos from secs s join secs o on o.id = s.id and o.start < s.start and o."end" >= s."end"'
)
def ancestors(spark, sf_dir):
    return L.ancestors(L.file_targets(nodes(spark, sf_dir)))


@query(ORACLE + 'select target_key, file_id, anchor, kind, start, "end", path, hash from targets')
def target_index(spark, sf_dir):
    return L.file_targets(nodes(spark, sf_dir)).drop("ancestors")


@query(ORACLE + "select target_key, count(*) as n, arg_min(path || ':' || start, (path, start)) as first_site, arg_max(path || ':' || start, (path, start)) as last_site from targets group by target_key having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return L.duplicate_keys(L.file_targets(nodes(spark, sf_dir)))


@query(ORACLE + "select file_id, string_agg(distinct target_key, ' ' order by target_key) as anchors from targets where kind = 'section' group by file_id")
def anchors_by_file(spark, sf_dir):
    return L.anchors_by_file(L.file_targets(nodes(spark, sf_dir))).select("file_id", F.array_join("anchors", " ").alias("anchors"))


# Edges


@query(ORACLE + "select source_id, pos, target_ref, target_key, seen from edges")
def resolved_edges(spark, sf_dir):
    return lattice(spark, sf_dir).edges.drop("actual")


@query(ORACLE + "select source_id, pos, target_ref, seen from edges")
def edge_dedupe_last_wins(spark, sf_dir):
    return L.last_wins(raw_edges(spark, sf_dir, L.file_targets(nodes(spark, sf_dir))))


@query(ORACLE + "select target_key, string_agg(distinct source_id, ' ' order by source_id) as sources from edges where target_key is not null group by target_key")
def dependents(spark, sf_dir):
    return L.dependents(lattice(spark, sf_dir).edges).select("target_key", F.array_join("sources", " ").alias("sources"))


@query(ORACLE + "select * from statuses")
def check_edges(spark, sf_dir):
    return drift.check(lattice(spark, sf_dir))


@query(ORACLE + "select s.state, count(t.state) as count from (values ('OK'), ('STALE'), ('UNRECONCILED'), ('BROKEN')) s(state) left join statuses t on t.state = s.state group by s.state")
def check_summary(spark, sf_dir):
    return drift.summary(drift.check(lattice(spark, sf_dir)))


@query(ORACLE + "select * from statuses where state in ('STALE', 'BROKEN')")
def check_only(spark, sf_dir):
    return drift.only(drift.check(lattice(spark, sf_dir)), ["stale", "broken"])


@query(ORACLE + "select * from statuses where state <> 'OK'")
def check_problems(spark, sf_dir):
    return drift.problems(drift.check(lattice(spark, sf_dir)))


@query(ORACLE + "select coalesce(bool_or(state <> 'OK'), false) as has_drift from statuses")
def drift_gate(spark, sf_dir):
    return drift.gate(drift.check(lattice(spark, sf_dir)))


@query(
    ORACLE
    + """select '::error file=' || path || ',title=drift%3A ' || state || '::' || source_id || ' -> ' || target_ref as line, path as place
    from statuses join docs on id = source_id where state <> 'OK'"""
)
def check_annotations(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return sinks.check_annotations(drift.check(found), found.nodes, sinks.Places("/w/project", ("/w/project",)))


@query(ORACLE + "select source_id, pos, rpad(state, 13, ' ') || ' ' || source_id || ' -> ' || target_ref as line from statuses")
def check_rendered(spark, sf_dir):
    return sinks.check_rendered(drift.check(lattice(spark, sf_dir)))


@query(ORACLE + "select source_id, target_ref, count(*) as n from raw_edges group by source_id, target_ref having count(*) > 1")
def duplicate_edges(spark, sf_dir):
    return L.repeated(raw_edges(spark, sf_dir, L.file_targets(nodes(spark, sf_dir))))


# Authority


@query(ORACLE + "select source_id, pos, target_ref, target_id, source_authority, target_authority from linted where kind = 'violation'")
def lint_violations(spark, sf_dir):
    return authority.violations(authority.lint(lattice(spark, sf_dir)))


@query(ORACLE + "select source_id, pos, target_ref, kind as reason from linted where kind like '%-unannotated'")
def lint_skipped(spark, sf_dir):
    return authority.skipped(authority.lint(lattice(spark, sf_dir)))


@query(
    ORACLE
    + "select count(*) filter (kind in ('ok', 'violation')) as checked, count(*) filter (kind = 'violation') as violations, count(*) filter (kind = 'source-unannotated') as source_unannotated, count(*) filter (kind = 'target-unannotated') as target_unannotated from linted"
)
def lint_coverage(spark, sf_dir):
    return authority.coverage(authority.lint(lattice(spark, sf_dir)))


@query(ORACLE + "select coalesce(bool_or(kind = 'violation'), false) as fails from linted")
def lint_gate(spark, sf_dir):
    return authority.gate(authority.lint(lattice(spark, sf_dir)))


@query(
    ORACLE
    + """select '::error file=project/' || path || ',title=authority ladder::' || source_id || ' (' || source_authority || ') -> ' || target_ref || ' (' || target_authority || ')' as line, 'project/' || path as place
    from linted join docs on id = source_id where kind = 'violation'"""
)
def lint_annotations(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return sinks.lint_annotations(authority.lint(found), found.nodes, sinks.Places("/w/project", ("/elsewhere", "/w")))


# Impact

_EXPAND_FILE = f"select target_key from targets where file_id = '{FILE}'"
_EXPAND_SECTION = f"""select distinct o.id || '#' || o.anchor as target_key from secs s join secs o on o.id = s.id and o.start <= s.start and o."end" >= s."end" where s.id || '#' || s.anchor = {SECTION}
  union select split_part({SECTION}, '#', 1)"""


@query(ORACLE + _EXPAND_FILE)
def expand_file_token(spark, sf_dir):
    return closure.expand(lattice(spark, sf_dir), FILE)


@query(ORACLE + _EXPAND_SECTION)
def expand_section_token(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return closure.expand(found, _section(found))


_AFFECTED = "select d.id, d.title, d.path, r.depth from reach r join docs d on d.id = r.id"


def _impact(spark, sf_dir, token, depth=None):
    return closure.impact(lattice(spark, sf_dir), token, depth).drop("tickets")


@query(ORACLE + reach_sql(_EXPAND_FILE, 60) + _AFFECTED)
def impact_full(spark, sf_dir):
    return _impact(spark, sf_dir, FILE)


@query(ORACLE + reach_sql(_EXPAND_FILE, 1) + _AFFECTED)
def impact_depth1(spark, sf_dir):
    return _impact(spark, sf_dir, FILE, 1)


@query(ORACLE + reach_sql(_EXPAND_FILE, 2) + _AFFECTED)
def impact_depth2(spark, sf_dir):
    return _impact(spark, sf_dir, FILE, 2)


@query(ORACLE + reach_sql(_EXPAND_SECTION, 60) + _AFFECTED)
def impact_section(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return closure.impact(found, _section(found)).drop("tickets")


@query(
    """with n as (select n_nationkey from nation where n_regionkey = 1), c as (select c_custkey from customer where c_nationkey in (from n))
    select 'nation-' || n_nationkey as id, 1 as depth from n union all select 'customer-' || c_custkey, 2 from c
    union all select 'supplier-' || s_suppkey, 2 from supplier where s_nationkey in (from n)
    union all select 'order-' || o_orderkey, 3 from orders where o_custkey in (from c)"""
)
def impact_star_region(spark, sf_dir):
    return closure.impact_ids(star_edges(spark, sf_dir), spark.createDataFrame([("region-1",)], "target_key string"))


@query(
    """with n as (select n_nationkey from nation where n_regionkey = 1), c as (select c_custkey from customer where c_nationkey in (from n)),
    o as (select o_orderkey from orders where o_custkey in (from c))
    select 'nation-' || n_nationkey as id, 1 as depth from n union all select 'customer-' || c_custkey, 2 from c
    union all select 'supplier-' || s_suppkey, 2 from supplier where s_nationkey in (from n)
    union all select 'order-' || o_orderkey, 3 from o
    union all select distinct 'lineitem-' || l_orderkey || '-' || l_linenumber, 4 from lineitem where l_orderkey in (from o)"""
)
def impact_star_lineitem(spark, sf_dir):
    return closure.impact_ids(star_lattice(spark, sf_dir), spark.createDataFrame([("region-1",)], "target_key string"))


# Graph


@query(ORACLE + "select * from collapsed")
def graph_edges(spark, sf_dir):
    return graph.collapsed(drift.check(lattice(spark, sf_dir)))


@query(
    ORACLE
    + """, named as (select id, 'n' || (row_number() over (order by id) - 1) as name, replace(coalesce(nullif(title, ''), id), '"', '''') as label from docs),
    lines as (select 0 as part, id as a, '' as b, '    ' || name || '["' || label || '"]' as line from named
      union all select 1, upstream, downstream, '    ' || u.name || case when stale then ' -.-> ' else ' --> ' end || d.name
      from collapsed join named u on u.id = upstream join named d on d.id = downstream)
    select row_number() over (order by part, a, b) as place, line from lines"""
)
def graph_mermaid(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return graph.mermaid(found, drift.check(found))


@query(
    ORACLE
    + """, lines as (select 0 as part, id as a, '' as b, '    "' || id || '" [label="' || replace(coalesce(nullif(title, ''), id), '"', '\\"') || '"];' as line from docs
      union all select 1, upstream, downstream, '    "' || upstream || '" -> "' || downstream || '"' || case when stale then ' [style=dashed];' else ';' end from collapsed)
    select row_number() over (order by part, a, b) as place, line from lines"""
)
def graph_dot(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return graph.dot(found, drift.check(found))


@query(ORACLE + "select id, title, layer, authority, path from docs")
def graph_json_nodes(spark, sf_dir):
    return graph.json_nodes(lattice(spark, sf_dir))


# Audit

_OWN = f"select '{FILE}'"


def _joined(trigger):
    return trigger.select("node_id", F.array_join("drifted_refs", " ").alias("drifted_refs"))


@query(ORACLE + "select * from stale_nodes")
def audit_trigger(spark, sf_dir):
    return _joined(audit.audit_trigger(lattice(spark, sf_dir)))


@query(ORACLE + reach_sql(_EXPAND_FILE, 60) + f"select * from stale_nodes where node_id in (select id from reach union {_OWN})")
def audit_trigger_scoped(spark, sf_dir):
    return _joined(audit.audit_trigger(lattice(spark, sf_dir), FILE))


@query(
    ORACLE
    + reach_sql(_EXPAND_FILE, 60)
    + """select source_id as node_id, string_agg(target_ref, ' ' order by pos) as drifted_refs from edges e join targets t on t.target_key = e.target_key
    where source_id in (select id from reach) and (file_id in (select id from reach) or e.target_key in (select target_key from seeds)) group by source_id"""
)
def from_trigger(spark, sf_dir):
    return _joined(audit.from_trigger(lattice(spark, sf_dir), FILE))


def _partitioned(found, trigger):
    return audit.partition_tickets(audit.ticket_refs(found, trigger), TEAM, most=None)


@query(ORACLE + "select distinct ticket_ref, reason from refused join node_tickets using (ticket_ref) where node_id in (select node_id from stale_nodes)")
def ticket_partition(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return _partitioned(found, audit.audit_trigger(found))


@query(
    ORACLE
    + """, valid as (select distinct split_part(ticket_ref, '-', 1) as team, cast(split_part(ticket_ref, '-', 2) as bigint) as number
      from refused join node_tickets using (ticket_ref) where reason is null and node_id in (select node_id from stale_nodes)),
    placed as (select *, cast((row_number() over (partition by team order by number) - 1) // 50 as int) as batch from valid)
    select team, batch, string_agg(number, ',' order by number) as numbers from placed group by team, batch"""
)
def ticket_batches(spark, sf_dir):
    found = lattice(spark, sf_dir)
    return audit.ticket_batches(_partitioned(found, audit.audit_trigger(found)))


@query(
    ORACLE
    + """, valid as (select distinct split_part(ticket_ref, '-', 1) as team, cast(split_part(ticket_ref, '-', 2) as bigint) as number
      from refused join node_tickets using (ticket_ref) where reason is null and node_id in (select node_id from stale_nodes)),
    placed as (select *, cast((row_number() over (partition by team order by number) - 1) // 50 as int) as batch from valid)
    select team, batch, team as key, '[' || string_agg(number, ',' order by number) || ']' as wanted from placed group by team, batch"""
)
def ticket_requests(spark, sf_dir):
    found = lattice(spark, sf_dir)
    asked = requests(audit.ticket_batches(_partitioned(found, audit.audit_trigger(found))))
    part = lambda path: F.get_json_object("body", path)
    return asked.select("team", "batch", part("$.variables.key").alias("key"), part("$.variables.wanted").alias("wanted"))


_FINDINGS = """, graded as (
  select case when t.type is null then 'BLOCKED' when t.type = 'completed' then 'DANGER' when t.type = 'started' then 'WARNING' when t.type in ('unstarted', 'backlog') then 'INFO' end as severity,
    n.node_id, d.title as node_title, d.path as node_path, s.drifted_refs, n.ticket_ref, case when t.type is null then coalesce(r.reason, 'not-found') end as reason, t.type as state
  from node_tickets n join stale_nodes s using (node_id) join docs d on d.id = n.node_id left join tracker t using (ticket_ref) left join refused r using (ticket_ref)),
findings as (select * from graded where severity is not null)
"""


def _findings(spark, sf_dir):
    found = lattice(spark, sf_dir)
    trigger = audit.audit_trigger(found)
    return audit.stale_shipped(found, trigger, tickets(spark, sf_dir), _partitioned(found, trigger))


@query(ORACLE + _FINDINGS + "select * from findings")
def stale_shipped(spark, sf_dir):
    shown = F.array_join("drifted_refs", " ").alias("drifted_refs")
    return _findings(spark, sf_dir).select("severity", "node_id", "node_title", "node_path", shown, "ticket_ref", "reason", F.col("ticket.state.type").alias("state"))


@query(ORACLE + _FINDINGS + "select coalesce(bool_or(severity in ('DANGER', 'BLOCKED', 'WARNING')), false) as fails from findings")
def stale_shipped_gate(spark, sf_dir):
    return audit.gate(_findings(spark, sf_dir), warnings=True)


_IN_ORDER = "list_position(['DANGER', 'BLOCKED', 'WARNING', 'INFO'], severity), node_id, ticket_ref"


@query(ORACLE + _FINDINGS + f"select row_number() over (order by {_IN_ORDER}) - 1 as place, severity, node_id, ticket_ref from findings")
def findings_in_order(spark, sf_dir):
    found = _findings(spark, sf_dir).select("severity", "node_id", "ticket_ref", T.severity_rank("severity").alias("_grade"))
    return placed(found, ["_grade", "node_id", "ticket_ref"], "place").drop("_grade")


@query(
    ORACLE
    + _FINDINGS
    + "select severity, node_id, ticket_ref, rpad(severity, 8, ' ') || ' ' || node_id || '  ' || ticket_ref || ' (' || coalesce(reason, (select any_value(o_orderstatus) from orders where 'ENG-' || o_orderkey = ticket_ref)) || ')  drifted: ' || replace(drifted_refs, ' ', ', ') as line from findings"
)
def findings_rendered(spark, sf_dir):
    return sinks.findings_rendered(_findings(spark, sf_dir))


# Reconcile

_PLAN = "select d.path, source_id, target_ref as ref, actual as new_seen from statuses join docs d on d.id = source_id where state in ('STALE', 'UNRECONCILED')"


@query(ORACLE + _PLAN)
def reconcile_plan_all(spark, sf_dir):
    return reconcile.plan(lattice(spark, sf_dir), everything=True)


@query(ORACLE + f"select row_number() over (order by path, ref) - 1 as place, path, ref from ({_PLAN})")
def reconcile_plan_in_order(spark, sf_dir):
    return placed(reconcile.plan(lattice(spark, sf_dir), everything=True).select("path", "ref"), ["path", "ref"], "place")


@query(ORACLE + _PLAN + " and source_id = 'doc-5'")
def reconcile_plan_node(spark, sf_dir):
    return reconcile.plan(lattice(spark, sf_dir), "doc-5")


@query(ORACLE + _PLAN + " and target_ref = 'doc-3'")
def reconcile_plan_ref(spark, sf_dir):
    return reconcile.plan(lattice(spark, sf_dir), ref="doc-3", everything=True)


@query(ORACLE + "select state, count(*) as count from (select case when state in ('STALE', 'UNRECONCILED') then 'OK' else state end as state from statuses) group by state")
def post_reconcile_check(spark, sf_dir):
    found = lattice(spark, sf_dir)
    after = reconcile.applied(found, reconcile.plan(found, everything=True))
    return drift.check(after).groupBy("state").agg(F.count(F.lit(1)).alias("count"))
