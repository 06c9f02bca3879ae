"""A corpus with structure, made of tables that have none, so that every operator has rows to work on.

Each document becomes a node. Every fifth line of its text becomes a heading, every second of these with an explicit marker;
behind the text of some follow lines that make things hard: fences with what looks like headings, slugs that collide with others' numbers,
characters beyond ASCII, an anchor that is given twice. References (some of them given twice), hashes last seen and tickets follow
from the document's number. ``ORACLE`` says the same in DuckDB's SQL. Documents without an id, which nothing could name, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.lattice import Lattice, file_targets, resolve

TEAM = "ENG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines behind the text of every ``n``th document: (line, and if it is a heading: level, text, marker).
HARD: dict[int, tuple[tuple[str, int | None, str, str | None], ...]] = {
    6: (
        ("```text", None, "", None),
        ("# not a heading", None, "", None),
        ("~~~", None, "", None),
        ("```", None, "", None),
        ("# Notes", 1, "Notes", None),
        ("## Notes ##", 2, "Notes", None),
        ("# Notes {#n}", 1, "Notes {#n}", "n"),
        ("#Notes", None, "", None),
        ("# Notes-1", 1, "Notes-1", None),
        ("## Notes", 2, "Notes", None),
        ("#", 1, "", None),
        ("# \u00dcn\u00efcode Stra\u00dfe \u2460 7_b", 1, "\u00dcn\u00efcode Stra\u00dfe \u2460 7_b", None),
        ("plain", None, "", None),
    ),
    8: (("# First {#dup}", 1, "First {#dup}", "dup"), ("one", None, "", None), ("# Second {#dup}", 1, "Second {#dup}", "dup"), ("two", None, "", None)),
    9: (("   ~~~~ x", None, "", None), ("# in a fence that is never closed", None, "", None)),
}


def _line(line: Column, i: Column) -> Column:
    marker = F.when(i % 10 == 0, F.concat(F.lit(" {#l"), (i + 1).cast("string"), F.lit("}"))).otherwise("")
    hashes = F.when(F.floor(i / 5) % 3 == 0, "# ").when(F.floor(i / 5) % 3 == 1, "## ").otherwise("### ")
    return F.when(i % 5 == 0, F.concat(hashes, line, marker)).otherwise(line)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.lit("doc-"), k.cast("string"))
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), "#{}", "   "), "\n", -1)
    ticket = lambda x: F.concat(F.lit(f"{TEAM}-"), x.cast("string"))
    odd = lambda n, ref: F.when(k % n == 0, F.array(F.lit(ref))).otherwise(F.array().cast("array<string>"))
    hard = [F.when(k % n == 0, F.array(*[F.lit(x[0]) for x in some])).otherwise(F.array().cast("array<string>")) for n, some in HARD.items()]
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    cores = spark.sparkContext.defaultParallelism
    if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        docs = docs.repartition(cores)  # a table too small for a task on every core; larger ones are never moved
    return docs.select(
        name.alias("id"),
        F.when(k % 7 != 0, F.concat(F.lit('Title "'), k.cast("string"), F.lit('"'))).alias("title"),
        F.element_at(F.array(F.lit("design"), F.lit("technical"), F.lit("production")), (k % 3 + 1).cast("int")).alias("layer"),
        F.when(k % 4 == 0, "exploratory").when(k % 4 == 1, "derived").when(k % 4 == 2, "binding").alias("authority"),
        F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), name, F.lit(".md")).alias("path"),
        F.array_join(F.concat(F.transform(lines, _line), *hard), "\n").alias("body"),
        F.concat(F.array(ticket(k * 4), ticket(k * 4 + 1), ticket(k * 4)), odd(9, "eng-7"), odd(10, f"{TEAM}-007"), odd(12, "SEC-9")).alias("tickets"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, length, modificationTime, content): each document as a file, with frontmatter of every kind.

    Every fourth gives its first reference twice, every sixth names two nodes of its YAML alike.
    """
    k = F.col("doc_id")
    number = k.cast("string")
    again = F.when(k % 4 == 1, F.concat(F.lit("- {seen: old, ref: doc-"), number, F.lit("}\n"))).otherwise("")
    named = F.when(k % 6 == 2, "&t ").otherwise("")
    title = F.when(k % 6 == 2, "title: &t T\n").otherwise("")
    tracked = F.concat(F.lit("---\nid: doc-"), number, F.lit("\n"), title, F.lit("authority: derived\nderives_from:\n- ref: doc-"), number, F.lit("\n- {ref: 'doc-0#l1', seen: null}\n"), again, F.lit("tickets: ["), named, F.lit("ENG-"), number, F.lit("]\n---\n"))
    head = F.when(k % 10 == 9, "---\nid: x\nowner: nobody\n---\n").when(k % 10 == 8, "---\nkind: note\n---\n").when(k % 10 == 7, "").otherwise(tracked)
    content = F.concat(head, F.coalesce("text", F.lit(""))).cast("binary")
    made = table(spark, sf_dir, "documents").where("doc_id is not null")
    return made.select("doc_id", F.concat(F.lit("docs/"), number, F.lit(".md")).alias("path"), F.length(content).cast("long").alias("length"), F.timestamp_seconds(k).alias("modificationTime"), content.alias("content"))


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each document as a file with something wrong with it, but every sixth."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    framed = lambda meta: F.concat(F.lit(f"---\n{meta}\n---\n"), text).cast("binary")
    content = (
        F.when(k % 6 == 1, F.concat(text.cast("binary"), F.lit(b"\xff")))
        .when(k % 6 == 2, F.concat(F.lit("---\nid: x\n"), text).cast("binary"))
        .when(k % 6 == 3, framed("id: x\nowner: nobody\nderives_from: [{ref: y, sen: z}]"))
        .when(k % 6 == 4, framed("id: 5\nlayer: lower\ntickets: T-1"))
        .when(k % 6 == 5, framed("tickets: [T-1]"))
        .otherwise(framed("id: x"))
    )
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("docs/"), k.cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, body): each page as a document whose links lead to others, some by reference, some to nowhere, some in code."""
    k, n = F.col("page_id"), F.lit(7)
    number = k.cast("string")
    body = F.concat(
        F.lit("# Page\n\nSee [one]("), (k + n).cast("string"), F.lit(".md#page) and `[no](code.md)`,\nor [two][r].\n\n```\n[not](fence.md)\n```\n## Ends\n<a href='x'>raw</a> ![i](i.png) [three](../../far.md)\n\n[r]: ../k/"),
        number, F.lit(".md#lost 'title'\n"),
    )
    return table(spark, sf_dir, "pages").where("page_id is not null").select(F.concat(F.lit("k/"), number, F.lit(".md")).alias("path"), body.alias("body"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, response): orders as the tracker's JSON, fifty to a response, with control characters in what people may type."""
    ref = F.concat(F.lit(f"{TEAM}-"), F.col("o_orderkey").cast("string"))
    state = F.struct(F.concat(F.lit("\u0007"), "o_orderstatus").alias("name"), F.lit("started").alias("type"))
    child = F.struct(F.concat(ref, F.lit("a")).alias("identifier"), F.lit("part\u0000").alias("title"), state.alias("state"))
    children = F.when(F.col("o_orderkey") % 3 == 0, F.array(child)).otherwise(F.array())
    node = F.struct(ref.alias("identifier"), F.col("o_orderkey").alias("number"), F.concat(F.lit("Order\u001b "), "o_orderpriority").alias("title"), F.concat(F.lit("https://t.invalid/"), ref).alias("url"), state.alias("state"), F.struct(children.alias("nodes")).alias("children"))
    asked = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 50)).agg(F.collect_list(node).alias("nodes"))
    return asked.select(F.lit(TEAM).alias("team"), F.to_json(F.struct(F.struct(F.struct("nodes").alias("issues")).alias("data"))).alias("response"))


def raw_edges(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    """References and what was last seen: nothing, something else, or the target as it is now."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))
    k = F.col("doc_id")
    doc = lambda x: F.concat(F.lit("doc-"), x.cast("string"))
    ref = lambda pos, to: F.struct(F.lit(pos).alias("pos"), to.alias("target_ref"))
    refs = F.array(
        ref(0, doc((k * 7 + 3) % F.col("n"))),
        ref(1, F.concat(doc(F.expr("doc_id div 2")), F.lit("#l11"))),
        F.when(k % 11 == 0, ref(2, doc((k * 7 + 3) % F.col("n")))),
        F.when(k % 13 == 0, ref(3, F.concat(F.lit("ghost-"), k.cast("string")))),
    )
    # One row is broadcast.
    listed = docs.crossJoin(F.broadcast(n)).select("doc_id", F.explode(F.array_compact(refs)).alias("r")).select("doc_id", "r.*")
    hashes = targets.select(F.col("target_key").alias("target_ref"), "hash")
    seen = F.when(k % 5 == 0, None).when((k % 5 == 1) | (F.col("pos") == 2), "0123456789abcdef0123456789abcdef").otherwise(F.coalesce("hash", F.lit("gone")))
    return listed.join(hashes, "target_ref", "left").select(doc(k).alias("source_id"), "pos", "target_ref", seen.alias("seen"))


def lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    found = nodes(spark, sf_dir)
    targets = cut(file_targets(found))
    edges = cut(resolve(raw_edges(spark, sf_dir, targets), targets))
    return Lattice(found.drop("body"), targets, edges)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket_ref, ticket) from orders."""
    kind = F.when(F.col("o_orderkey") % 17 == 0, "canceled").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "started").otherwise("unstarted")
    ref = F.concat(F.lit(f"{TEAM}-"), F.col("o_orderkey").cast("string"))
    state = F.struct(F.col("o_orderstatus").alias("name"), kind.alias("type"))
    return table(spark, sf_dir, "orders").select(ref.alias("ticket_ref"), F.struct(ref.alias("identifier"), state.alias("state")).alias("ticket"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_key): the star schema's foreign keys from regions down to orders. ``star_lattice`` goes on to lineitem."""
    key = lambda name, c: F.concat(F.lit(f"{name}-"), F.col(c).cast("string"))
    of = lambda t, name, own, other, to: table(spark, sf_dir, t).select(key(name, own).alias("source_id"), key(other, to).alias("target_key"))
    return (
        of("nation", "nation", "n_nationkey", "region", "n_regionkey")
        .union(of("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .union(of("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .union(of("orders", "order", "o_orderkey", "customer", "o_custkey"))
    )


def star_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_key): region <- nation <- customer/supplier <- orders <- lineitem, and part <- lineitem.

    A lineitem is named by its order and its line number.
    """
    key = lambda name, *c: F.concat(F.lit(name), *[x for k in c for x in (F.lit("-"), F.col(k).cast("string"))])
    # Two reads of a few columns each, so that a filter of keys comes before names are made.
    items = lambda to: table(spark, sf_dir, "lineitem").select(key("lineitem", "l_orderkey", "l_linenumber").alias("source_id"), to.alias("target_key"))
    return star_edges(spark, sf_dir).union(items(key("order", "l_orderkey"))).union(items(key("part", "l_partkey")))


_WS = r"[\t\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def canonical_sql(x: str) -> str:
    lf = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({lf}, '{_WS}+(\n|$)', '\1', 'g'), '\A\n+|\n+\z', '', 'g')"


def hash_sql(x: str) -> str:
    return f"substr(sha256({canonical_sql(x)}), 1, 32)"


def _hard_sql() -> str:
    quote = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({n}, {k}, {', '.join(map(quote, line))})" for n, some in HARD.items() for k, line in enumerate(some))


ORACLE = rf"""
with recursive docs0 as (
  select doc_id, 'doc-' || doc_id as id, case when doc_id % 7 <> 0 then 'Title "' || doc_id || '"' end as title,
    case doc_id % 3 when 0 then 'design' when 1 then 'technical' else 'production' end as layer,
    case doc_id % 4 when 0 then 'exploratory' when 1 then 'derived' when 2 then 'binding' end as authority,
    'docs/' || coalesce(lang, 'xx') || '/doc-' || doc_id || '.md' as path,
    list_transform(string_split(translate(coalesce(text, ''), '#{{}}', '   '), chr(10)), lambda l, i:
      case when i % 5 = 1 then repeat('#', cast(1 + (i // 5) % 3 as int)) || ' ' || l || case when i % 10 = 1 then ' {{#l' || i || '}}' else '' end else l end) as own
  from documents where doc_id is not null),
hard as (select * from (values {_hard_sql()}) h(n, k, line, level, text, marker)),
behind as (
  select doc_id, list(h.line order by n, k) as more, list({{'level': level, 'text': h.text, 'marker': marker}} order by n, k) as known from docs0 join hard h on doc_id % n = 0 group by doc_id),
docs as (
  select d.*, coalesce(known, []) as known, list_concat(own, coalesce(more, [])) as built from docs0 d left join behind using (doc_id)),
made as (select *, array_to_string(built, chr(10)) as body, case when built[len(built)] = '' then built[1:len(built) - 1] else built end as lines from docs),
heads as (
  select id, path, cast(i as int) as line, cast(1 + (i // 5) % 3 as int) as level,
    trim(ltrim(built[i], '#')) as text, case when i % 10 = 1 then 'l' || i end as marker, lines, greatest(1, len(lines)) as total
  from (select *, unnest(range(1, len(own) + 1)) as i from made) where i % 5 = 1
  union all
  select id, path, cast(len(own) + j as int), cast(known[j].level as int), known[j].text, known[j].marker, lines, greatest(1, len(lines))
  from (select *, unnest(range(1, len(known) + 1)) as j from made) where known[j].level is not null),
based as (
  select *, replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}} -]', '', 'g'), ' ', '-') as base, row_number() over (partition by id order by line) as nth from heads),
-- Slugs in order: a taken one is numbered on, from the last number its own text was given. ``taken`` has every slug so far, ``last`` the numbers.
slugged(id, nth, slug, taken, last) as (
  select id, cast(1 as bigint), base, [base], map([base], [cast(0 as bigint)]) from based where nth = 1
  union all
  select id, nth, slug, list_append(taken, slug), map_from_entries(list_concat(list_filter(map_entries(last), lambda e: e.key <> base and e.key <> slug), case when slug = base then [{{'key': base, 'value': cast(0 as bigint)}}] else [{{'key': base, 'value': free}}, {{'key': slug, 'value': cast(0 as bigint)}}] end))
  from (
    select *, case when free is null then base else base || '-' || free end as slug
    from (
      select b.id, b.nth, b.base, s.taken, s.last,
        case when list_contains(s.taken, b.base) then list_filter(range(s.last[b.base] + 1, s.last[b.base] + len(s.taken) + 2), lambda n: not list_contains(s.taken, b.base || '-' || n))[1] end as free
      from slugged s join based b on b.id = s.id and b.nth = s.nth + 1))),
slugs as (select b.*, s.slug from based b join slugged s on s.id = b.id and s.nth = b.nth),
ends as (select a.id, a.line, min(b.line) - 1 as until from heads a join heads b on a.id = b.id and b.line > a.line and b.level <= a.level group by a.id, a.line),
secs as (
  select s.id, s.path, cast(row_number() over (partition by s.id order by s.line) - 1 as int) as pos, s.level, s.text, s.marker, s.lines,
    s.slug, coalesce(s.marker, s.slug) as anchor,
    s.line as start, cast(coalesce(e.until, s.total) as int) as "end"
  from slugs s left join ends e on s.id = e.id and s.line = e.line),
pieces as (
  select *, array_to_string(list_concat([rtrim(regexp_replace(lines[start], '(^|\s+)\{{#[A-Za-z0-9][A-Za-z0-9_-]*\}}\s*$', ' '))], lines[start + 1:"end"]), chr(10)) as content from secs),
targets as (
  select id as target_key, id as file_id, cast(null as varchar) as anchor, 'file' as kind, 1 as start, cast(greatest(1, len(lines)) as int) as "end", path, {hash_sql('body')} as hash from made
  union all
  select id || '#' || anchor, id, anchor, 'section', start, "end", path, {hash_sql('content')} from pieces),
refs as (
  select d.doc_id, 'doc-' || d.doc_id as source_id, r.pos, r.target_ref
  from docs d, (select max(doc_id) + 1 as n from documents) m, lateral (
    select 0 as pos, 'doc-' || ((d.doc_id * 7 + 3) % m.n) as target_ref
    union all select 1, 'doc-' || (d.doc_id // 2) || '#l11'
    union all select 2, 'doc-' || ((d.doc_id * 7 + 3) % m.n) where d.doc_id % 11 = 0
    union all select 3, 'ghost-' || d.doc_id where d.doc_id % 13 = 0) r),
raw_edges as (
  select source_id, pos, target_ref, t.target_key, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 or pos = 2 then '0123456789abcdef0123456789abcdef' else coalesce(t.hash, 'gone') end as seen
  from refs left join targets t on t.target_key = refs.target_ref),
edges as (
  select source_id, min(pos) as pos, target_ref, any_value(target_key) as target_key, arg_max({{'s': seen}}, pos).s as seen from raw_edges group by source_id, target_ref),
statuses as (
  select source_id, pos, target_ref, e.target_key as target_id,
    case when e.target_key is null then 'BROKEN' when seen is null then 'UNRECONCILED' when seen = hash then 'OK' else 'STALE' end as state,
    seen as expected, hash as actual
  from edges e left join targets t on t.target_key = e.target_key),
linted as (
  select source_id, pos, target_ref, e.target_key as target_id, s.authority as source_authority, d.authority as target_authority,
    case when s.authority is null then 'source-unannotated' when d.authority is null then 'target-unannotated'
      when list_position(['exploratory', 'derived', 'binding'], d.authority) < list_position(['exploratory', 'derived', 'binding'], s.authority) then 'violation' else 'ok' end as kind
  from edges e join targets t on t.target_key = e.target_key join docs s on s.id = source_id join docs d on d.id = t.file_id),
file_edges as (select distinct split_part(target_key, '#', 1) as to_file, source_id as id from edges where target_key is not null),
collapsed as (
  select split_part(target_id, '#', 1) as upstream, source_id as downstream, bool_or(state = 'STALE') as stale from statuses where target_id is not null group by all),
node_tickets as (
  select id as node_id, unnest(list_distinct([r for r in [
    '{TEAM}-' || (doc_id * 4), '{TEAM}-' || (doc_id * 4 + 1), case when doc_id % 9 = 0 then 'eng-7' end,
    case when doc_id % 10 = 0 then '{TEAM}-007' end, case when doc_id % 12 = 0 then 'SEC-9' end] if r is not null])) as ticket_ref from docs),
refused as (
  select distinct ticket_ref, case when not regexp_full_match(ticket_ref, '[A-Z][A-Z0-9]*-(0|[1-9][0-9]*)') then 'malformed' when split_part(ticket_ref, '-', 1) <> '{TEAM}' then 'cross-team' end as reason
  from node_tickets),
tracker as (
  select '{TEAM}-' || o_orderkey as ticket_ref, case when o_orderkey % 17 = 0 then 'canceled' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'started' else 'unstarted' end as type
  from orders),
stale_nodes as (select source_id as node_id, string_agg(target_ref, ' ' order by pos) as drifted_refs from statuses where state = 'STALE' group by source_id)
"""


def reach_sql(seeds: str, depth: int) -> str:
    """CTE ``reach`` (id, depth) from the targets ``seeds``, to be put behind ORACLE; deep enough for whole graphs, as ``union`` drops repeats."""
    return f"""
, seeds as ({seeds}),
walk(id, depth) as (
  select distinct source_id, 1 from edges where target_key in (select target_key from seeds)
  union select f.id, w.depth + 1 from walk w join file_edges f on f.to_file = w.id where w.depth < {depth}),
reach as (select id, cast(min(depth) as int) as depth from walk group by id)
"""
