"""Queries on the data's own problems (records, references, hierarchies, schemas) over whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import plain_form
from weftgraph.operators import drift, duplicates, frequency, hierarchy, nested, orphans, weighted
from weftgraph.operators.durable import cut, shared_dir

CHILD_TO_PARENT = ["subclassof", "biolinksubclassof"]
PARENT_TO_CHILD = ["superclassof", "biolinksuperclassof"]
#: A key is reported from one row in SHARE of the table.
SHARE = 200
EDGE_COLUMNS = {
    "subject": "string", "predicate": "string", "object": "string", "category": ["string"],
    "sources": [{"resource_id": "string", "resource_role": "string", "upstream_resource_ids": ["string"]}],
    "knowledge_level": "string", "agent_type": "string", "publications": ["string"], "p_value": "number", "evidence_count": "number",
}
EDGE_DDL = (
    "subject string, predicate string, object string, category array<string>, "
    "sources array<struct<resource_id:string,resource_role:string,upstream_resource_ids:array<string>>>, "
    "knowledge_level string, agent_type string, publications array<string>, p_value double, evidence_count double"
)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# 1 ---------------------------------------------------------------------------


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = _table(spark, d, "edges").select("edge_row", _micros("loaded_at").alias("at"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), plain_form(f).alias("key")) for f in ("subject", "object")])).alias("e"))
    nodes = _table(spark, d, "nodes").select(plain_form("id").alias("key"), _micros("loaded_at").alias("start"), _micros("retired_at").alias("end"))
    found = orphans.find_orphans(edges.select(F.col("edge_row").alias("ref_id"), "e.field_name", "e.key", "at"), nodes)
    return found.select(F.col("ref_id").alias("edge_row"), "field_name", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"), "reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("field_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


_PLAIN = "coalesce(lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"
_P1 = f"""with r as (
  select edge_row, 'subject' as field_name, {_PLAIN.format("subject")} as k, loaded_at from edges
  union all select edge_row, 'object', {_PLAIN.format("object")}, loaded_at from edges),
n as (select {_PLAIN.format("id")} as k, loaded_at as s, retired_at as e from nodes),
first_seen as (select k, min(s) as s from n group by k)
select r.edge_row, r.field_name, strftime(r.loaded_at, '%Y-%m') as period,
  case when f.k is null then 'missing' when f.s > r.loaded_at then 'late' else 'deleted' end as reason
from r left join first_seen f on f.k = r.k
where r.k <> '' and not exists (select 1 from n where n.k = r.k and n.s <= r.loaded_at and (n.e is null or r.loaded_at < n.e))"""

# 2 ---------------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "edges").select(plain_form("predicate").alias("p"), "subject", "object").filter(F.col("p").isin(CHILD_TO_PARENT + PARENT_TO_CHILD))
    up = F.col("p").isin(CHILD_TO_PARENT)
    s, o = plain_form("subject"), plain_form("object")
    return e.select(F.when(up, s).otherwise(o).alias("child"), F.when(up, o).otherwise(s).alias("parent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.hierarchy(_links(spark, d), with_path=False)
    return t.select(F.col("node").alias("node_key"), F.col("root").alias("root_key"), "depth", "n_desc", F.col("state").alias("node_state"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.hierarchy(_links(spark, d))
    return t.filter(F.col("state") == "ok").select(F.col("node").alias("node_key"), F.array_join("path", "/").alias("path"), "depth")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Of nodes that are neither on nor below a cycle; p2_all_descendants has all."""
    t = hierarchy.descendants(hierarchy.hierarchy(_links(spark, d)))
    return t.select(F.col("node").alias("node_key"), F.col("descendant").alias("descendant_key"), "distance")


def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Of every node, whatever its state: n_desc rows each."""
    links = cut(_links(spark, d))
    t = hierarchy.descendants(hierarchy.hierarchy(links), links)
    return t.select(F.col("node").alias("node_key"), F.col("descendant").alias("descendant_key"), "distance")


_IN = lambda ps: ", ".join(f"'{p}'" for p in ps)
_LINKS = f"""p as (select {_PLAIN.format("predicate")} as p, {_PLAIN.format("subject")} as s, {_PLAIN.format("object")} as o from edges),
l as (select distinct case when p in ({_IN(CHILD_TO_PARENT)}) then s else o end as c, case when p in ({_IN(CHILD_TO_PARENT)}) then o else s end as a
  from p where p in ({_IN(CHILD_TO_PARENT + PARENT_TO_CHILD)}) and s <> '' and o <> ''),
"""
_P2_SQL = f"""with recursive {_LINKS}
n as (select c as k from l union select a from l),
up as (select c as k, a as x, 1 as steps from l union select up.k, l.a, up.steps + 1 from up join l on l.c = up.x where up.steps < 400 and up.x <> up.k),
cyc as (select distinct k from up where x = k),
below as (select distinct up.k from up join cyc on cyc.k = up.x where up.k not in (select k from cyc)),
tops as (select k, max_by(x, steps) as root, max(steps) as depth from up group by k),
reach as (select distinct k, x from up where k <> x),
n_desc as (select x as k, count(*) as n from reach group by x)
select n.k as node_key, case when n.k in (select k from cyc) or n.k in (select k from below) then '' else coalesce(tops.root, n.k) end as root_key,
  case when n.k in (select k from cyc) or n.k in (select k from below) then -1 else coalesce(tops.depth, 0) end as depth,
  coalesce(n_desc.n, 0) as n_desc,
  case when n.k in (select k from cyc) then 'cycle' when n.k in (select k from below) then 'below_cycle' else 'ok' end as node_state
from n left join tops on tops.k = n.k left join n_desc on n_desc.k = n.k"""
# A walk inside a cycle never ends by itself; walks of nodes below one are cut by the guard on steps.
_TREES = f"""with recursive {_LINKS}
t as (select distinct a as k, a as path, 0 as depth from l where a not in (select c from l)
  union all select l.c, t.path || '/' || l.c, t.depth + 1 from t join l on l.a = t.k)"""
_P2_PATHS = f"{_TREES} select k as node_key, path, depth from t"
_P2_DESC = f"""with recursive {_LINKS}
roots as (select distinct a as k from l where a not in (select c from l)),
t as (select k from roots union all select l.c from t join l on l.a = t.k),
r as (select l.a as k, l.c as x, 1 as distance from l join t on t.k = l.a
  union all select r.k, l.c, r.distance + 1 from r join l on l.a = r.x)
select k as node_key, x as descendant_key, distance from r"""
_P2_ALL_DESC = f"""with recursive {_LINKS}
up as (select c as k, a as x, 1 as steps, [c, a] as way from l
  union all select up.k, l.a, up.steps + 1, list_append(up.way, l.a) from up join l on l.c = up.x where not list_contains(up.way, l.a))
select x as node_key, k as descendant_key, steps as distance from up where k <> x"""

# 3 ---------------------------------------------------------------------------


def _source_levels() -> list[nested.Level]:
    """The visitor of sources, whose texts are plain already; upstream ids get the position of the source they came from."""

    def source(above: list[Column], at: list[Column]) -> dict[str, Column]:
        x = above[-1]
        return {"resource_key": x["r"], "role_key": x["o"], "n_upstream": F.size(F.array_compact(x["u"]))}

    def upstream(above: list[Column], at: list[Column]) -> dict[str, Column]:
        x, u = above
        return {"resource_key": x["r"], "role_key": x["o"], "parent_pos": F.array_position(F.col("keys"), u) - 1}

    return [nested.Level("source", lambda above: F.col("sources"), source, [nested.Level("upstream", lambda above: above[-1]["u"], upstream)])]


def _tagged_sources(spark: SparkSession, d: str) -> DataFrame:
    def plain_or_null(c: Column) -> Column:
        return F.when(c.isNotNull(), plain_form(c))

    # Every text is brought to its plain form once, before the visit.
    once = F.transform("sources", lambda x: F.when(x.isNotNull(), F.struct(plain_form(x["resource_id"]).alias("r"), plain_form(x["resource_role"]).alias("o"), F.coalesce(F.transform(x["upstream_resource_ids"], plain_or_null), F.array().cast("array<string>")).alias("u"))))
    plain = _table(spark, d, "edges").select("edge_row", once.alias("sources")).withColumn("keys", F.transform("sources", lambda x: x["r"]))
    return nested.emit_tagged(plain, "edge_row", _source_levels())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The tables of sources and of upstream mentions, written by tag in one pass; schemas are applied on reading."""
    path = f"{shared_dir(spark)}/tagged-{uuid4().hex}"
    nested.write_tagged(_tagged_sources(spark, d), path)
    keys = {"resource_key": "string", "role_key": "string"}
    ups = nested.read_tagged(spark, path, "upstream", keys | {"parent_pos": "bigint"})
    alone = nested.read_tagged(spark, path, "source", keys | {"n_upstream": "bigint"}).filter("n_upstream = 0")
    none = F.lit(-1).cast("bigint")
    head = [F.element_at("pk", 1).alias("edge_row"), F.element_at("pk", 2).alias("source_pos"), "resource_key", "role_key"]
    return ups.select(*head, F.element_at("pk", 3).alias("upstream_pos"), "parent_pos").unionByName(alone.select(*head, none.alias("upstream_pos"), none.alias("parent_pos")))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and values of the flat tables that a schema-driven visitor makes of sources and publications; p3_all_tables has all of edges."""
    e = _table(spark, d, "edges").select("edge_row", "sources", "publications")
    _, levels = nested.levels_of(e.schema)
    t = nested.emit_tagged(e, "edge_row", levels)
    value = F.coalesce(F.col("payload")["resource_id"], F.col("payload")["value"])
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.sum(F.element_at("pk", -1)).alias("sum_pos"))


def p3_all_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and non-null values of each flat table that a schema-driven visitor makes of edges, the records' own included."""
    e = _table(spark, d, "edges")
    scalars, levels = nested.levels_of(e.schema)
    t = nested.emit_tagged(e, "edge_row", levels, ("edges", {k: F.col(f"`{k}`") for k in scalars}))
    values = F.size(F.filter(F.map_values("payload"), lambda v: v.isNotNull()))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(values).alias("n_values"), F.sum(F.element_at("pk", -1)).alias("sum_pos"))


_P3 = f"""with s as (select edge_row, unnest(range(len(sources))) as p, sources from edges where sources is not null),
k as (select edge_row, p, sources[p + 1] as x, list_transform(sources, lambda y: case when y is not null then {_PLAIN.format("y.resource_id")} end) as keys from s where sources[p + 1] is not null),
u as (select edge_row, p, x, keys, unnest(range(len(x.upstream_resource_ids))) as q from k where x.upstream_resource_ids is not null)
select edge_row, p as source_pos, {_PLAIN.format("x.resource_id")} as resource_key, {_PLAIN.format("x.resource_role")} as role_key, q as upstream_pos,
  coalesce(list_position(keys, {_PLAIN.format("x.upstream_resource_ids[q + 1]")}), 0) - 1 as parent_pos
from u where x.upstream_resource_ids[q + 1] is not null
union all select edge_row, p, {_PLAIN.format("x.resource_id")}, {_PLAIN.format("x.resource_role")}, -1, -1
from k where len(list_filter(coalesce(x.upstream_resource_ids, []), lambda y: y is not null)) = 0"""
_P3_TABLES = """with s as (select edge_row, unnest(range(len(sources))) as p, sources from edges),
x as (select p, sources[p + 1] as x from s where sources[p + 1] is not null),
rows as (
  select 'sources' as tag, p, x.resource_id as v from x
  union all select 'sources.upstream_resource_ids', q, l[q + 1] from (select unnest(range(len(x.upstream_resource_ids))) as q, x.upstream_resource_ids as l from x)
  union all select 'sources.source_record_urls', q, l[q + 1] from (select unnest(range(len(x.source_record_urls))) as q, x.source_record_urls as l from x)
  union all select 'publications', q, l[q + 1] from (select unnest(range(len(publications))) as q, publications as l from edges))
select tag, count(*) as n_rows, count(v) as n_values, cast(sum(p) as bigint) as sum_pos from rows where tag = 'sources' or v is not null group by tag"""

_SCALARS = ["edge_row", "id", "subject", "predicate", "object", "knowledge_level", "agent_type", "p_value", "evidence_count", "object_aspect_qualifier", "object_direction_qualifier", "asserted_at", "loaded_at"]
_LIST = "select '{0}' as tag, q as p, cast(l[q + 1] is not null as bigint) as n from (select unnest(range(len({1}))) as q, {1} as l from {2}) where l[q + 1] is not null"
_P3_ALL_TABLES = f"""with s as (select edge_row, unnest(range(len(sources))) as p, sources from edges),
x as (select p, sources[p + 1] as x from s where sources[p + 1] is not null),
rows as (
  select 'edges' as tag, edge_row as p, {" + ".join(f"cast({c} is not null as bigint)" for c in _SCALARS)} as n from edges
  union all select 'sources', p, cast(x.resource_id is not null as bigint) + cast(x.resource_role is not null as bigint) from x
  union all {_LIST.format("sources.upstream_resource_ids", "x.upstream_resource_ids", "x")}
  union all {_LIST.format("sources.source_record_urls", "x.source_record_urls", "x")}
  union all {_LIST.format("publications", "publications", "edges")}
  union all {_LIST.format("category", "category", "edges")})
select tag, count(*) as n_rows, cast(sum(n) as bigint) as n_values, cast(sum(p) as bigint) as sum_pos from rows group by tag"""

# 4 ---------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _table(spark, d, "edges"), _table(spark, d, "nodes")
    one = F.lit(1).cast("bigint")
    of_edges = edges.select(F.col("edge_row").alias("record"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), plain_form(f).alias("term")) for f in ("predicate", "knowledge_level")])).alias("e"))
    pairs = of_edges.select("e.field_name", "e.term", "record", one.alias("times"))
    # What repeats within a record is added up before the sort.
    plain = F.transform("category", lambda c: plain_form(c))
    each = F.transform(F.array_distinct("p"), lambda c: F.struct(c.alias("term"), F.size(F.filter("p", lambda x: x == c)).cast("bigint").alias("times")))
    terms = nodes.select(F.col("node_row").alias("record"), plain.alias("p")).select("record", F.explode(each).alias("e"))
    pairs = pairs.unionByName(terms.select(F.lit("category").alias("field_name"), "e.term", "record", "e.times"))
    n_edges, n_nodes = edges.count(), nodes.count()  # from the files' footers
    found = frequency.with_mark(frequency.term_frequencies(pairs), {"predicate": n_edges, "knowledge_level": n_edges, "category": n_nodes})
    return found.withColumnRenamed("term", "value_key")


_P4 = f"""with t as (
  select 'predicate' as field_name, {_PLAIN.format("predicate")} as k, edge_row as r from edges
  union all select 'knowledge_level', {_PLAIN.format("knowledge_level")}, edge_row from edges
  union all select 'category', {_PLAIN.format("c")}, node_row from (select unnest(category) as c, node_row from nodes)),
g as (select field_name, k, count(*) as n_occur, count(distinct r) as n_records from t where k <> '' group by field_name, k)
select field_name, k as value_key, n_occur, n_records,
  case when n_records < 3 then 'rare' when n_records > 0.3 * (case when field_name = 'category' then (select count(*) from nodes) else (select count(*) from edges) end) then 'common' else 'ok' end as mark from g"""

# 5 ---------------------------------------------------------------------------


def _ends(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "edges").select(plain_form("subject").alias("s"), plain_form("object").alias("o"))
    ends = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(k).alias("node_key"), F.col(v).alias("partner")) for f, k, v in (("subject", "s", "o"), ("object", "o", "s"))])
    return e.select(F.explode(ends).alias("e")).select("e.*").filter(F.col("node_key") != "")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "edges").count()  # from the files' footers
    per = weighted.counts(weighted.compress(_ends(spark, d), ["field_name", "node_key"], "partner"), ["field_name", "node_key"], lambda v: v != "")
    return per.filter(F.col("n_rows") * SHARE >= n).select("field_name", "node_key", "n_rows", F.col("n_distinct").alias("n_partners"))


def p5_modes(spark: SparkSession, d: str) -> DataFrame:
    """Of every endpoint, whatever its share: the partner that it shares most rows with."""
    ends = _ends(spark, d).withColumn("partner", F.nullif("partner", F.lit("")))
    return weighted.modes(weighted.compress(ends, ["field_name", "node_key"], "partner"), ["field_name", "node_key"]).withColumnsRenamed({"mode": "partner_key", "mode_rows": "n_shared"})


def p5_medians(spark: SparkSession, d: str) -> DataFrame:
    """Of every subject: the median (lower) of evidence_count, exact."""
    e = _table(spark, d, "edges").select(plain_form("subject").alias("node_key"), F.col("evidence_count").cast("double").alias("v")).filter("node_key <> ''")
    return weighted.percentiles(weighted.compress(e, ["node_key"], "v"), ["node_key"], 0.5).withColumnRenamed("percentile", "median_evidence")


_ENDS = f"""with p as (select {_PLAIN.format("subject")} as s, {_PLAIN.format("object")} as o from edges),
e as (select 'subject' as field_name, s as k, nullif(o, '') as v from p union all select 'object', o, nullif(s, '') from p)"""
_P5 = f"""{_ENDS} select field_name, k as node_key, count(*) as n_rows, count(distinct v) as n_partners from e where k <> ''
group by field_name, k having count(*) * {SHARE} >= (select count(*) from edges)"""
_P5_MODES = f"""{_ENDS}, g as (select field_name, k, v, count(*) as n from e where k <> '' and v is not null group by all)
select field_name, k as node_key, v as partner_key, n as n_shared from (select *, row_number() over (partition by field_name, k order by n desc, v) as i from g) where i = 1"""
_P5_MEDIANS = f"""select {_PLAIN.format("subject")} as node_key, cast(quantile_disc(evidence_count, 0.5) as double) as median_evidence from edges
where evidence_count is not null and {_PLAIN.format("subject")} <> '' group by 1"""

# 6 ---------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_table(spark, d, "edge_files")).select("feed", "file_id", "change_kind", "old_path", "new_path")


def _unified(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "edge_files")
    return drift.unify(lines, drift.canonical_names(drift.changes(lines)), EDGE_COLUMNS, EDGE_DDL)


def _with_flat_sources(t: DataFrame) -> DataFrame:
    """Records without sources get them from the flat fields of older files, which then leave the rest."""
    first, more = F.col("rest")["primary_knowledge_source"], F.col("rest")["aggregator_knowledge_source"]
    texts = F.coalesce(F.from_json(more, "array<string>"), F.array_compact(F.array(F.from_json(F.concat(F.lit("["), more, F.lit("]")), "array<string>")[0])))
    source = lambda i, role, up: F.struct(i.alias("resource_id"), F.lit(role).alias("resource_role"), up.alias("upstream_resource_ids"))
    name = F.from_json(F.concat(F.lit("["), first, F.lit("]")), "array<string>")[0]
    # Aggregators are given with the nearest to the user first: each draws from the one behind it.
    chain = F.reverse(F.coalesce(texts, F.array().cast("array<string>")))
    of = F.transform(chain, lambda x, i: source(x, "aggregator_knowledge_source", F.array(F.when(i == 0, name).otherwise(F.get(chain, i - 1)))))
    flat = F.col("sources").isNull() & name.isNotNull() & first.startswith('"')
    left = F.map_filter("rest", lambda k, v: ~k.isin("primary_knowledge_source", "aggregator_knowledge_source"))
    whole = F.concat(F.array(source(name, "primary_knowledge_source", F.array().cast("array<string>"))), of)
    return t.withColumns({"sources": F.when(flat, whole).otherwise(F.col("sources")), "rest": F.when(flat, F.when(F.size(left) > 0, left)).otherwise(F.col("rest"))})


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    """The raw records of all files in one table, scalars only (lists and the rest as JSON text)."""
    return _with_flat_sources(_unified(spark, d)).withColumns({c: F.to_json(c) for c in ("category", "sources", "publications", "rest")})


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many fields of each line that have a value are held by the unified table, in a column or in the rest."""
    t = _unified(spark, d)
    rest = F.coalesce(F.map_keys("rest"), F.array().cast("array<string>"))
    held = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in EDGE_COLUMNS]))
    return t.select("line_id", F.size(F.array_union(held, rest)).alias("n_values"))


_JSON_LINES = "json_valid(payload) and json_type(payload) = 'OBJECT'"
_P6_KEPT = f"select line_id, cast(coalesce(len(list_filter(json_keys(payload), lambda k: json_type(payload, '$.\"' || k || '\"') <> 'NULL')), 0) as int) as n_values from (select * from edge_files where {_JSON_LINES})"
_P6 = f"""with l as (select distinct feed, file_no, file_id, payload from edge_files where {_JSON_LINES}),
t as (select feed, file_no, file_id, regexp_replace(regexp_replace(x.fullkey, '\\[[0-9]+\\]', '', 'g'), '^\\$\\.', '') as p, x.value as v,
  case x.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as ty
  from l, json_tree(l.payload) x where x.fullkey <> '$' and not x.fullkey like '%]'),
s as (select feed, file_id, p, coalesce(list_sort(list(distinct ty) filter (ty is not null)), []) as ty from t group by all),
f as (select feed, file_id, lag(file_id) over (partition by feed order by file_no, file_id) as prev from (select distinct feed, file_no, file_id from l)),
pr as (select * from f where prev is not null),
o as (select pr.feed, pr.file_id, s.p, s.ty from pr join s on s.feed = pr.feed and s.file_id = pr.prev),
n as (select pr.feed, pr.file_id, s.p, s.ty from pr join s on s.feed = pr.feed and s.file_id = pr.file_id),
u as (select feed, file_id, p, o.ty as oty, n.ty as nty from o full join n using (feed, file_id, p)),
bad as (select feed, file_id, p from u where oty is null or nty is null or oty <> nty),
e as (select * from u where not exists (select 1 from bad where bad.feed = u.feed and bad.file_id = u.file_id and starts_with(u.p, bad.p || '.'))),
vals as (select distinct feed, file_id, p, v::varchar as v from t where ty is not null),
cand as (select g.feed, g.file_id, g.p as op, c.p as np from e g join e c on g.feed = c.feed and g.file_id = c.file_id and g.nty is null and c.oty is null and len(g.oty) > 0 and g.oty = c.nty
  and regexp_replace(g.p, '[^.]*$', '') = regexp_replace(c.p, '[^.]*$', '')),
ren as (select c.feed, c.file_id, c.op, c.np from cand c join pr on pr.feed = c.feed and pr.file_id = c.file_id join vals v on v.feed = c.feed and v.file_id = c.file_id and v.p = c.np
  left join vals w on w.feed = c.feed and w.file_id = pr.prev and w.p = c.op and w.v = v.v group by all having count(w.v) * 2 >= count(*))
select feed, file_id, 'type_changed' as change_kind, p as old_path, p as new_path from e where len(oty) > 0 and len(nty) > 0 and oty <> nty
union all select feed, file_id, 'renamed', op, np from ren
union all select feed, file_id, 'removed', p, '' from e where nty is null and not exists (select 1 from ren where ren.feed = e.feed and ren.file_id = e.file_id and ren.op = e.p)
union all select feed, file_id, 'added', '', p from e where oty is null and not exists (select 1 from ren where ren.feed = e.feed and ren.file_id = e.file_id and ren.np = e.p)"""

# 7 ---------------------------------------------------------------------------
_KEYS, _VALUES = ["subject", "predicate", "object"], ["object_aspect_qualifier"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(_table(spark, d, "edges"), "edge_row", _KEYS, _VALUES)


def p7_statements(spark: SparkSession, d: str) -> DataFrame:
    s, _ = duplicates.collapse(_table(spark, d, "edges"), "edge_row", _KEYS, _VALUES)
    return s.select(F.col("first_row").alias("edge_row"), "n_copies")


_QUAL = f"""case when ltrim(object_aspect_qualifier) like '{{%' and json_valid(object_aspect_qualifier) and len(json_keys(object_aspect_qualifier)) > 0 then
  array_to_string(list_sort(list_transform(json_keys(object_aspect_qualifier), lambda k: {_PLAIN.format("k")} || chr(1) || {_PLAIN.format("json_extract_string(object_aspect_qualifier, '$.\"' || k || '\"')")})), '')
  else {_PLAIN.format("object_aspect_qualifier")} end"""
_STATEMENTS = f"""with p as (select edge_row, {_PLAIN.format("subject")} as s, {_PLAIN.format("predicate")} as p, {_PLAIN.format("object")} as o, replace({_QUAL}, chr(1), '') as q from edges)"""
_P7 = f"""{_STATEMENTS}, w as (select edge_row, min(edge_row) over (partition by s, p, o, q) as a from p where s <> '' and p <> '' and o <> '')
select a as row_a, edge_row as row_b from w where a <> edge_row"""
_P7_STATEMENTS = f"{_STATEMENTS} select min(edge_row) as edge_row, count(*) as n_copies from p where s <> '' and p <> '' and o <> '' group by s, p, o, q"

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_paths, p2_descendants, p2_all_descendants, p3_found, p3_tables, p3_all_tables, p4_found, p5_found, p5_modes, p5_medians, p6_found, p6_unified, p6_kept, p7_found, p7_statements)}
SQL = {
    "p1_found": _P1, "p1_report": f"select field_name, period, reason, count(*) as n_refs from ({_P1}) group by all", "p2_found": _P2_SQL, "p2_paths": _P2_PATHS, "p2_descendants": _P2_DESC, "p2_all_descendants": _P2_ALL_DESC,
    "p3_found": _P3, "p3_tables": _P3_TABLES, "p3_all_tables": _P3_ALL_TABLES, "p4_found": _P4, "p5_found": _P5, "p5_modes": _P5_MODES, "p5_medians": _P5_MEDIANS, "p6_found": _P6, "p6_kept": _P6_KEPT, "p7_found": _P7, "p7_statements": _P7_STATEMENTS,
}
