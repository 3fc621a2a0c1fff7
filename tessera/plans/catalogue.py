"""Registered queries over the driver's tables and their DuckDB equivalents.

Operators take typed inputs; an adapter view projects the driver's tables into
each. Adapters are SQL that both engines read alike, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.functions.vectors import hash_embed
from tessera.operators import evaluation, extract, graph, incremental, ownership, planning, profile, retrieval, review, synthesis
from tessera.sources.scratch import Scratch
from tessera.sources.tables import table
from tessera.streaming import maintenance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS = {
    "commit_files": """select concat(event_type, '/', cast(floor(k / 10.0) as int), '/f', k, '.py') as path, user_id as author_id, cast(floor(value) as bigint) as additions, 0 as deletions, ts as committed_at, event_id as sha
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""",
    "last_seen": "select user_id as author_id, max(ts) as last_seen_at from events where event_type in ('signup', 'purchase') group by user_id",
    "symbols": """select p_partkey as symbol_id, replace(p_name, ' ', '_') as name,
        concat(case p_size % 8 when 0 then 'tests' when 1 then 'apps/api/src/api/routes' when 2 then 'apps/worker/src/worker/ingest' when 3 then 'apps/web/src/app' when 4 then 'packages/core/src'
        when 5 then 'alembic/versions' when 6 then './components' else 'jobs/nightly_cron' end, '/', lower(replace(p_brand, '#', '_')), '/', lower(replace(p_type, ' ', '_')), '.py') as path,
        case p_size % 3 when 0 then 'function' when 1 then 'method' else 'class' end as kind, p_size as start_line, p_size + 20 as end_line, p_size * 40 as start_byte, p_size * 40 + 800 as end_byte from part""",
    "edges": """select a.l_partkey as src_id, b.l_partkey as dst_id, case a.l_returnflag when 'A' then 'calls' when 'N' then 'emits' else 'imports' end as kind, round(0.3 + 5.9 * a.l_discount + (a.l_partkey % 97) * 0.0000137, 7) as confidence
        from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1""",
    "questions": "select item_id as query_id, text as query from benchmark",
    "answers": "select conv_id * 1000 + turn as answer_id, text as answer from conversations",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, or a driver table."""
    if name not in ADAPTERS:
        return table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir)
    if name == "edges":  # a self-join that every graph query reads: written once a session
        if key not in _EDGES:
            _EDGES[key] = Scratch(spark, "edges").table(_adapted(spark, sf_dir, name), "edges")
        return _EDGES[key]
    return _adapted(spark, sf_dir, name)


_EDGES: dict[tuple[str, str], DataFrame] = {}


def _adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    for t in TABLES:
        if re.search(rf"\b(from|join) {t}\b", sql):
            temporary = f"adapted_{t}_{zlib.crc32(sf_dir.encode())}"
            table(spark, sf_dir, t).createOrReplaceTempView(temporary)
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {temporary}", sql)
    return spark.sql(sql)


def query(oracle: str | None = None, **named: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a query; adapters the oracle names are put before it."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            own = [f"{k} as ({v})" for k, v in ADAPTERS.items() if f"{k}" in oracle]
            body = oracle.strip()
            recursive = "recursive " if body.lower().startswith("recursive") else ""
            body = body.removeprefix("recursive ")
            if own:
                body = f"with {recursive}{', '.join(own)}" + (", " + body.removeprefix("with ") if body.startswith("with ") else " " + body)
            elif recursive:
                body = "with recursive " + body.removeprefix("with ")
            ORACLE[f.__name__] = body
        return f

    return add


def _as_of() -> Any:
    return F.lit(AS_OF).cast("timestamp")


# -- ownership --------------------------------------------------------------------------------------------------------

OWNED = f"""owned as (select regexp_replace(path, '/[^/]*$', '') as path_prefix, author_id, sum(w) as score, max(committed_at) as last_touched_at from
    (select *, (additions + deletions) * exp(-ln(2) / 90 * greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(committed_at)) / 86400e6)) as w from commit_files) x where w > 0 group by 1, 2)"""


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.ownership(view(spark, sf_dir, "commit_files"), _as_of())


@query(f"with {OWNED} select path_prefix, author_id, round(score, 4) as score, last_touched_at from owned")
def ownership_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(
    f"""with {OWNED}, t as (select *, sum(score) over (partition by path_prefix) as total, row_number() over (partition by path_prefix order by score desc, author_id) as r from owned)
    select t.path_prefix, t.author_id, round(t.score / t.total, 4) as share, (epoch_us(timestamp '{AS_OF}') - epoch_us(coalesce(l.last_seen_at, t.last_touched_at))) / 86400e6 > 10 as inactive
    from t left join last_seen l on l.author_id = t.author_id where r = 1 and t.score / t.total >= 0.03"""
)
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events spread over many users, so the share and inactivity are set for them."""
    found = ownership.bus_factor(_owned(spark, sf_dir), view(spark, sf_dir, "last_seen"), _as_of(), share=0.03, inactive_days=10)
    return found.withColumn("share", F.round("share", 4))


@query("select c_custkey as author_id, count(o_orderkey) as commits from customer left join orders on c_custkey = o_custkey group by 1")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author_id"))
    return ownership.contributions(authors, view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("sha")))


@query(f"with {OWNED} select path_prefix, author_id, round(score / sum(score) over (partition by path_prefix), 4) as share from owned where path_prefix like 'view/%'")
def ownership_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _owned(spark, sf_dir).where(F.col("path_prefix").startswith("view/"))
    return ownership.share_of_total(rows, "path_prefix", "score").select("path_prefix", "author_id", F.round("share", 4).alias("share"))


@query(
    f"""with {OWNED}, best as (select path_prefix, sum(score) as total from owned group by 1 order by 2 desc, 1 limit 12),
    r as (select o.path_prefix, o.author_id, o.score, b.total, row_number() over (partition by o.path_prefix order by o.score desc, o.author_id) as rank from owned o join best b on o.path_prefix = b.path_prefix)
    select path_prefix, author_id, round(score, 4) as score, round(total, 4) as total, rank from r where rank <= 5"""
)
def top_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.top_prefixes(_owned(spark, sf_dir)).withColumns({"score": F.round("score", 4), "total": F.round("total", 4)})


@query(
    f"""with {OWNED}, asked as (select distinct regexp_replace(path, '/[^/]*$', '') as d, concat(path, '/deep/x.py') as path from commit_files),
    met as (select a.path, o.*, length(o.path_prefix) as n from asked a join owned o on o.path_prefix in (concat(a.d, '/', regexp_extract(a.path, '([^/]+)/deep/x.py', 1), '/deep'), concat(a.d, '/', regexp_extract(a.path, '([^/]+)/deep/x.py', 1)), a.d, split_part(a.d, '/', 1), '.')),
    s as (select path, path_prefix, author_id, score / sum(score) over (partition by path) as share, row_number() over (partition by path order by score desc, author_id) as rank from (select *, max(n) over (partition by path) as m from met) x where n = m)
    select path, path_prefix, author_id, round(share, 4) as share, rank from s where rank <= 10"""
)
def who_owns_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "commit_files").select(F.concat("path", F.lit("/deep/x.py")).alias("path")).distinct()
    return ownership.who_owns(asked, _owned(spark, sf_dir)).withColumn("share", F.round("share", 4))


# -- paths and classes ------------------------------------------------------------------------------------------------

CATEGORY = f"""case when regexp_matches(lower(path), '{paths.TEST}') or starts_with(lower(name), 'test_') then 'tests' when regexp_matches(lower(path), '{paths.CRON}') or regexp_matches(lower(name), '{paths.CRON}') then 'cron'
    when regexp_matches(lower(path), '{paths.WORKER}') then 'workers' when regexp_matches(lower(path), '{paths.ROUTE}') then 'routes' else 'other' end"""


@query(f"select {CATEGORY} as category, count(*) as symbols, count(distinct path) as files from symbols group by 1")
def path_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "symbols").select(paths.categorize_path(F.col("path"), F.col("name")).alias("category"), "path")
    return rows.groupBy("category").agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files"))


LAYER = """case when starts_with(path, 'tests') then 'test' when starts_with(path, 'alembic') then 'data' when starts_with(path, 'apps/web/src/app') then 'web' when starts_with(path, './components') then 'web'
    when starts_with(path, 'apps/worker') then 'worker' when starts_with(path, 'apps/api') then 'api' else 'lib' end"""
DOMAIN = """case when starts_with(path, 'tests') then 'Tests' when starts_with(path, 'alembic') then 'Migrations' when starts_with(path, 'apps/web/src/app') then 'Web' when starts_with(path, './components') then 'Web'
    when starts_with(path, 'apps/worker') then concat('Brand ', regexp_extract(path, 'brand_([0-9]+)', 1)) when starts_with(path, 'apps/api') then 'API routes' when starts_with(path, 'packages') then 'Core' else 'Jobs' end"""


@query(f"select {LAYER} as layer, {DOMAIN} as domain, count(*) as symbols from symbols group by 1, 2")
def layers_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "symbols").select(paths.assign_layer(F.col("path")).alias("layer"), paths.assign_domain(F.col("path")).alias("domain"))
    return rows.groupBy("layer", "domain").agg(F.count("*").alias("symbols"))


@query("select array_to_string(list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, 2), '/') as module, count(*) as symbols from symbols group by 1")
def module_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_nodes(view(spark, sf_dir, "symbols"), 2).select(F.col("id").alias("module"), F.col("symbol_count").alias("symbols"))


@query("select upper(coalesce(nullif(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '' and not starts_with(x, '{') and not starts_with(x, ':'))[1], ''), 'root')) as group_name, count(*) as endpoints from pages group by 1")
def endpoint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    return view(spark, sf_dir, "pages").groupBy(text.route_group(route).alias("group_name")).agg(F.count("*").alias("endpoints"))


@query("select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as symbols from symbols where not regexp_matches(path, '^tests') group by 1 order by 2 desc, 1 limit 24")
def folder_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.folder_topk(view(spark, sf_dir, "symbols"))


@query("select kind, count(*) as n, round(avg(confidence), 4) as confidence from edges group by 1")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


# -- graph ------------------------------------------------------------------------------------------------------------


@query("select src_id, dst_id, kind, max(confidence) as confidence, count(*) as n from edges group by 1, 2, 3")
def edges_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").groupBy("src_id", "dst_id", "kind").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query(
    """with points as (select l_orderkey * 10 + l_linenumber as point_id, path, cast(l_quantity * 40 as int) as byte from lineitem join symbols on l_partkey = symbol_id),
    met as (select p.point_id, s.symbol_id, row_number() over (partition by p.point_id, p.path, p.byte order by s.end_byte - s.start_byte, s.start_byte, s.symbol_id) as r from points p left join symbols s on p.path = s.path and s.start_byte <= p.byte and p.byte < s.end_byte)
    select point_id, symbol_id as src_id from met where r = 1"""
)
def enclosing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols")
    items = view(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), "l_partkey", (F.col("l_quantity") * 40).cast("int").alias("byte"))
    points = items.join(symbols.select("symbol_id", "path"), F.col("l_partkey") == F.col("symbol_id")).select("point_id", "path", "byte")
    return graph.enclosing_symbol(points, symbols).select("point_id", "src_id")


CALLS = "calls_made as (select distinct l_partkey as src_id, concat('f', l_suppkey, '.py') as path, name from lineitem join symbols on (l_partkey * 7 + l_linenumber) % 50 + 1 = symbol_id)"


@query(
    f"""with {CALLS}, c as (select name, symbol_id as dst_id, row_number() over (partition by name order by path, start_line, symbol_id) as rank from symbols),
    met as (select m.src_id, m.path, m.name, c.dst_id, row_number() over (partition by m.src_id, m.path, m.name order by c.rank) as place from calls_made m join c on m.name = c.name and c.rank <= 6 where c.dst_id <> m.src_id),
    kept as (select *, count(*) over (partition by src_id, path, name) as n from met where place <= 5)
    select src_id, dst_id, max(case when n = 1 then 0.55 else 0.3 end) as confidence from kept group by 1, 2"""
)
def name_match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols")
    made = view(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 50 + 1).alias("target"))
    calls = made.join(symbols.select("symbol_id", "name"), F.col("target") == F.col("symbol_id")).select(F.col("l_partkey").alias("src_id"), F.concat(F.lit("f"), "l_suppkey", F.lit(".py")).alias("path"), "name").distinct()
    none = spark.createDataFrame([], "path string, alias string, target_path string")
    return graph.call_edges(calls, symbols, none, most=graph.MOST_CANDIDATES).groupBy("src_id", "dst_id").agg(F.max("confidence").alias("confidence"))


@query(
    """select src_id, dst_id, 0.35 as confidence from (select distinct e.user_id as src_id, s.user_id as dst_id from (select distinct user_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events where event_type = 'purchase') e
    join (select distinct user_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events where event_type = 'signup') s on e.k = s.k where e.user_id <> s.user_id) x"""
)
def emit_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.regexp_extract("props", "([0-9]+)", 1).cast("int").cast("string")
    rows = view(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), event.alias("event"), "event_type").distinct()
    side = lambda kind: rows.where(F.col("event_type") == kind).select("symbol_id", "event")
    return graph.dynamic_edges(side("purchase"), side("signup")).select("src_id", "dst_id", F.col("confidence").cast("double").alias("confidence"))


def _levels(seeds: str, depth: int, most: int = 500) -> str:
    """Unrolled reverse traversal in SQL: one level an expression, best bottleneck over the parents one level nearer."""
    out = f"""back as (select dst_id as at, src_id as next, max(coalesce(nullif(confidence, 0), 0.5)) as c from edges where kind in ('calls', 'emits') group by 1, 2), l0 as ({seeds})"""
    for d in range(1, depth + 1):
        seen = " union all ".join(f"select seed, symbol_id from l{i}" for i in range(d))
        out += f""", l{d} as (select f.seed, b.next as symbol_id, {d} as depth, max(least(f.min_confidence, b.c)) as min_confidence from l{d - 1} f join back b on f.symbol_id = b.at
            where not exists (select 1 from ({seen}) s where s.seed = f.seed and s.symbol_id = b.next) group by 1, 2)"""
    every = " union all ".join(f"select * from l{i}" for i in range(1, depth + 1))
    return out + f", every as ({every}), ranked as (select *, row_number() over (partition by seed order by depth, min_confidence desc, symbol_id) as r from every), impact as (select seed, symbol_id, depth, round(min_confidence, 3) as min_confidence from ranked where r <= {most})"


SEEDS = "select symbol_id as seed, symbol_id, 0 as depth, 1.0::double as min_confidence from symbols where symbol_id % 20 = 0"


def _every_twentieth(symbols: DataFrame) -> DataFrame:
    """The stated query set of searches."""
    return symbols.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("seed"), "symbol_id")


@query(f"with {_levels(SEEDS, 4)} select seed, symbol_id, depth, min_confidence from impact")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(view(spark, sf_dir, "edges"), _every_twentieth(view(spark, sf_dir, "symbols")))


@query(f"with {_levels(SEEDS, 4)} select seed, {CATEGORY} as category, count(*) as n, max(min_confidence) as confidence, min(depth) as nearest from impact i join symbols s on i.symbol_id = s.symbol_id group by 1, 2")
def blast_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_impact(graph.describe_impact(blast_radius(spark, sf_dir), view(spark, sf_dir, "symbols")))


@query(f"with {_levels(SEEDS, 4)}, named as (select seed, {CATEGORY} as category from impact i join symbols s on i.symbol_id = s.symbol_id) select seed, count(*) as total, case when bool_or(category in ('routes', 'workers', 'cron')) or count(*) >= 15 then 'high' when count(*) >= 5 then 'medium' else 'low' end as risk from named group by 1")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_risk(graph.describe_impact(blast_radius(spark, sf_dir), view(spark, sf_dir, "symbols")))


COMPONENT = f"select {DOMAIN} as seed, symbol_id, 0 as depth, 1.0::double as min_confidence from symbols where {LAYER} = 'worker'"


@query(f"with {_levels(COMPONENT, 4, 400)} select seed, count(*) as total, round(sum(min_confidence), 2) as confidence from impact group by 1")
def component_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols")
    found = graph.component_impact(view(spark, sf_dir, "edges"), symbols.where(paths.assign_layer(F.col("path")) == "worker").select(paths.assign_domain(F.col("path")).alias("seed"), "symbol_id"))
    return found.groupBy("seed").agg(F.count("*").alias("total"), F.round(F.sum("min_confidence"), 2).alias("confidence"))


def _flow_sql(depth: int) -> str:
    """Unrolled breadth-first steps of every seed, a hundred a seed and level."""
    out = """o as (select src_id, dst_id, min(kind) as kind, any_value(c) as c from (select src_id, dst_id, kind, c, max(c) over (partition by src_id, dst_id) as m from (select src_id, dst_id, kind, coalesce(nullif(confidence, 0), 0.5) as c from edges where kind in ('calls', 'emits')) x) y where c = m group by 1, 2),
        f0 as (select symbol_id as seed, symbol_id as node, 1 as place from symbols where symbol_id % 20 = 0)"""
    for d in range(1, depth + 1):
        seen = " union all ".join(f"select seed, node from f{i}" for i in range(d))
        out += f""", s{d} as (select * from (select f.seed, {d} as depth, o.src_id, o.dst_id, o.kind, o.c, row_number() over (partition by f.seed order by f.place, o.c desc, o.dst_id, o.kind) as pos from f{d - 1} f join o on f.node = o.src_id) z where pos <= 100),
            f{d} as (select seed, dst_id as node, min(pos) as place from s{d} s where not exists (select 1 from ({seen}) w where w.seed = s.seed and w.node = s.dst_id) group by 1, 2)"""
    every = " union all ".join(f"select * from s{d}" for d in range(1, depth + 1))
    return out + f", steps as (select *, row_number() over (partition by seed order by depth, pos) as step from ({every}) e)"


@query(f"with {_flow_sql(3)} select seed, step, src_id, dst_id, kind, round(c, 3) as confidence, depth from steps where step <= 100")
def call_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_flow(view(spark, sf_dir, "edges"), _every_twentieth(view(spark, sf_dir, "symbols")))


@query(f"with {_flow_sql(3)} select seed, concat('flowchart TD', chr(10), string_agg(concat('    n', src_id, case when round(c, 3) >= 0.7 then ' -->' else ' -.->' end, case when kind = 'calls' then '' else concat('|', kind, '|') end, ' n', dst_id), chr(10) order by step)) as diagram from steps where step <= 100 group by 1")
def flow_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mermaid(call_flow(spark, sf_dir))


MODULE = "array_to_string(list_slice(list_filter(string_split({}.path, '/'), lambda x: x <> ''), 1, 2), '/')"


@query(
    f"""select {MODULE.format("s")} as src, {MODULE.format("d")} as dst, count(*) as weight, round(avg(coalesce(nullif(confidence, 0), 0.5)), 3) as confidence from edges e
    join symbols s on e.src_id = s.symbol_id join symbols d on e.dst_id = d.symbol_id where {MODULE.format("s")} <> {MODULE.format("d")} group by 1, 2"""
)
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_graph(view(spark, sf_dir, "edges"), view(spark, sf_dir, "symbols"))


@query(
    f"""with c as (select symbol_id, {LAYER} as layer, {DOMAIN} as domain from symbols), n as (select count(distinct (layer, domain)) as n from c where layer <> 'test'),
    k as (select symbol_id, layer, case when (select n from n) > 18 then layer else concat(layer, ':', domain) end as key from c where layer <> 'test')
    select s.key as src, d.key as dst, count(*) as weight, round(avg(coalesce(nullif(confidence, 0), 0.5)), 3) as confidence from edges e join k s on e.src_id = s.symbol_id join k d on e.dst_id = d.symbol_id where s.key <> d.key group by 1, 2"""
)
def architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.architecture(view(spark, sf_dir, "edges"), view(spark, sf_dir, "symbols"))


FILE_EDGES = "file_e as (select s.path as src, d.path as dst, round(sum(greatest(coalesce(nullif(confidence, 0), 0.5), 0.1)), 3) as weight from edges e join symbols s on e.src_id = s.symbol_id join symbols d on e.dst_id = d.symbol_id where e.kind in ('calls', 'imports') and s.path <> d.path group by 1, 2)"


@query(f"with {FILE_EDGES} select * from file_e")
def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_edges(view(spark, sf_dir, "edges"), view(spark, sf_dir, "symbols"))


NATION_EDGES = """nation_e as (select least(a, b) as a, greatest(a, b) as b, count(*) as w from (select concat('c', o_custkey) as a, concat('s', l_suppkey) as b from orders join lineitem on o_orderkey = l_orderkey ) x group by 1, 2),
    peak as (select v, max(w) as p from (select a as v, w from nation_e union all select b, w from nation_e) y group by 1),
    strong as (select n.a, n.b, n.w from nation_e n join peak x on n.a = x.v join peak y on n.b = y.v where n.w + 1e-9 >= 0.45 * greatest(x.p, y.p))"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = view(spark, sf_dir, "orders").join(view(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return met.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit(1).alias("weight"))


@query(
    f"""recursive with {NATION_EDGES}, both_ways as (select a, b from strong union all select b, a from strong), node as (select distinct v from peak),
    reach(v, c) as (select v, v from node union select b.a, r.c from reach r join both_ways b on b.b = r.v where r.c < b.a)
    select v as id, min(c) as component from (select v, c from reach) z group by 1"""
)
def components_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Scratch(spark, "pairs").table(graph.undirected(_weighted(spark, sf_dir)), "pairs")
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return graph.connected_components(nodes, graph.strong_edges(pairs))


def _file_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    symbols = view(spark, sf_dir, "symbols")
    member = symbols.select(F.col("path").alias("id"), paths.package_key(F.col("path")).alias("cluster")).distinct()
    return graph.undirected(graph.file_edges(view(spark, sf_dir, "edges"), symbols)), member


@query(
    f"""with {FILE_EDGES}, pair as (select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as w from file_e group by 1, 2),
    member as (select distinct path as id, case when split_part(path, '/', 1) in ('apps', 'packages', 'services', 'libs') then concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) else split_part(path, '/', 1) end as cluster from symbols),
    met as (select x.cluster as ca, y.cluster as cb, w from pair join member x on a = x.id join member y on b = y.id),
    sums as (select cluster, sum(intra) as intra, sum(outr) as outr from (select ca as cluster, case when ca = cb then w else 0 end as intra, case when ca <> cb then w else 0 end as outr from met union all select cb, 0, w from met where ca <> cb) z group by 1)
    select m.cluster, count(*) as files, round(any_value(intra) / (any_value(intra) + any_value(outr)), 3) as cohesion, round(any_value(outr) / (any_value(intra) + any_value(outr)), 3) as coupling from member m join sums s on m.cluster = s.cluster group by 1"""
)
def cohesion_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, member = _file_pairs(spark, sf_dir)
    return graph.cohesion(pairs, member)


@query("""recursive with n as (select count(distinct split_part(path, '/', 1)) as n from symbols), e as (select distinct split_part(s.path, '/', 1) as src, split_part(d.path, '/', 1) as dst from edges e join symbols s on e.src_id = s.symbol_id join symbols d on e.dst_id = d.symbol_id where split_part(s.path, '/', 1) <> split_part(d.path, '/', 1)),
    walk(id, layer) as (select distinct split_part(path, '/', 1), 0 from symbols union select e.dst, layer + 1 from walk join e on e.src = walk.id, n where layer < n) select id, max(layer) as layer from walk group by 1""")
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols")
    return graph.layering(graph.module_nodes(symbols, 1), graph.module_graph(view(spark, sf_dir, "edges"), symbols, 1))


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = _weighted(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    edges = Scratch(spark, "edges").table(weighted, "edges")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return graph.clusters(nodes, edges)


# -- retrieval --------------------------------------------------------------------------------------------------------


def _distance(a: str, b: str) -> str:
    return f"1 - list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"


KNN = f"""asked as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0), near as (select query_id, vec_id, {_distance("embedding", "q")} as distance from embeddings, asked),
    knn as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from near)"""


@query(f"with {KNN} select query_id, vec_id, round(distance, 5) + 0.0 as distance, rank from knn where rank <= 10")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(vectors, asked).select("query_id", "vec_id", (F.round("distance", 5) + 0.0).alias("distance"), "rank")


STOP = ", ".join(f"'{w}'" for w in sorted(set(text.STOPWORDS)))


IDENTIFIERS = f"""t as (select query_id, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*')) as tok, generate_subscripts(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*'), 1) as i from questions),
    f as (select *, row_number() over (partition by query_id, lower(tok) order by i) as n from t where length(tok) >= 3 and lower(tok) not in ({STOP})),
    s as (select query_id, tok, case when contains(tok, '_') then 20 else 0 end + case when regexp_matches(substr(tok, 2), '[A-Z]') then 15 else 0 end + case when regexp_matches(tok, '^[A-Z]') then 8 else 0 end + least(length(tok), 24) as score from f where n = 1),
    ident as (select *, row_number() over (partition by query_id order by score desc, length(tok) desc, tok) as rank from s)"""


@query(f"with {IDENTIFIERS} select query_id, string_agg(tok, ',' order by rank) as identifiers from ident where rank <= 8 group by 1")
def query_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "questions").select("query_id", text.query_identifiers(F.col("query")).alias("t"))
    return rows.where(F.size("t") > 0).select("query_id", F.array_join(F.slice("t", 1, 8), ",").alias("identifiers"))


NAMES = "names as (select distinct cast(p_size as bigint) as query_id, first_value(replace(substr(p_name, 1, 4 + p_size % 9), ' ', '_')) over (partition by p_size order by p_partkey) as query from part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = view(spark, sf_dir, "part")
    return part.groupBy(F.col("p_size").cast("long").alias("query_id")).agg(F.min_by(F.expr("replace(substr(p_name, 1, 4 + p_size % 9), ' ', '_')"), "p_partkey").alias("query"))


@query(
    f"""with {NAMES}, met as (select n.query_id, s.*, case when name = query then 100 when lower(name) = lower(query) then 90 when starts_with(lower(name), lower(query)) then 70 when contains(lower(name), lower(query)) then 50 end as score from symbols s, names n),
    b as (select *, row_number() over (partition by query_id, path order by score desc, start_line, symbol_id) as n from met where score is not null),
    r as (select *, row_number() over (partition by query_id order by score desc, path, start_line) as rank from b where n = 1)
    select query_id, rank, path, symbol_id, name, start_line, score from r where rank <= 20"""
)
def symbol_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.symbol_ladder(view(spark, sf_dir, "symbols"), _names(spark, sf_dir), 20)


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


@query(
    f"""with {NAMES}, l as (select symbol_id, name, {TRIGRAMS.format("name")} as t from symbols), r as (select query_id, {TRIGRAMS.format("query")} as q from names),
    m as (select query_id, symbol_id, name, len(list_intersect(t, q)) as k, len(t) + len(q) as n from l, r)
    select query_id, symbol_id, name, round(k / (n - k), 4) as similarity from m where k / (n - k) >= 0.3"""
)
def trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuzzy_symbols(view(spark, sf_dir, "symbols"), _names(spark, sf_dir)).withColumn("similarity", F.round("similarity", 4))


FILES = "select concat('d/', doc_id) as path, text from documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")


@query(
    f"""with f as ({FILES}), l as (select path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from f)
    select path, line, substr(text, 1, 1000) as text from l where regexp_matches(text, '(?i)licen[cs]ed? under')"""
)
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.grep(_files(spark, sf_dir), "licen[cs]ed? under", ignore_case=True, limit=None)


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
OVERLAP = f"""asked as (select query_id, {TOKENS.format("query")} as q from questions), token as (select query_id, len(q) as n, unnest(q) as token from asked),
    have as (select concat('p', page_id) as slug, unnest({TOKENS.format("concat(url, ' ', html)")}) as token from pages),
    overlap as (select query_id, slug, count(*) / any_value(n) as score from have join token on have.token = token.token group by 1, 2),
    overlap_r as (select *, row_number() over (partition by query_id order by score desc, slug) as rank from overlap)"""


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("slug"), F.col("url").alias("title"), F.col("html").alias("body"))
    return retrieval.wiki_overlap(pages, view(spark, sf_dir, "questions"), 15)


@query(f"with {OVERLAP} select query_id, slug, round(score, 4) as score, rank from overlap_r where rank <= 15")
def wiki_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).withColumn("score", F.round("score", 4))


# The three channels: symbols and lines by name, vectors by distance, pages by overlap. A question asks with the vector of its number.
LISTS = f"""{OVERLAP}, {IDENTIFIERS},
    ladder as (select i.query_id, i.rank - 1 as part, y.path, y.name, y.start_line, y.symbol_id, case when name = tok then 100 when lower(name) = lower(tok) then 90 when starts_with(lower(name), lower(tok)) then 70 when contains(lower(name), lower(tok)) then 50 end as score from symbols y, ident i where i.rank <= 6),
    ladder_best as (select *, row_number() over (partition by query_id, part, path order by score desc, start_line, symbol_id) as n from ladder where score is not null),
    ladder_hit as (select query_id, part, path, name as snippet, row_number() over (partition by query_id, part order by score desc, path, start_line) as pos from ladder_best where n = 1),
    ladder_sum as (select query_id, part, coalesce(sum(count(*)) over (partition by query_id order by part rows between unbounded preceding and 1 preceding), 0) as before from ladder_hit where pos <= 30 group by 1, 2),
    doc_line as (select concat('d/', doc_id) as path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
    word_line as (select path, text, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) as w from doc_line),
    held as (select i.query_id, w.path, arg_min(w.text, w.line) as text from word_line w join ident i on w.w = i.tok and i.rank = 1 group by 1, 2),
    held_hit as (select query_id, 6 as part, path, substr(text, 1, 400) as snippet, row_number() over (partition by query_id order by path) as pos from held),
    lexical_all as (select h.query_id, h.part, h.path, h.snippet, h.pos from ladder_hit h join ladder_sum u on h.query_id = u.query_id and h.part = u.part where u.before < 60 and h.pos <= 30 union all select * from held_hit where pos <= 30),
    lexical_one as (select *, row_number() over (partition by query_id, path order by part, pos) as n from lexical_all),
    lexical as (select query_id, 'lexical' as channel, row_number() over (partition by query_id order by part, pos, path) as rank, path, snippet from lexical_one where n = 1),
    ask_vector as (select q.query_id, e.embedding as q from questions q join embeddings e on q.query_id = e.vec_id),
    vector_near as (select a.query_id, e.vec_id, row_number() over (partition by a.query_id order by {_distance("e.embedding", "a.q")}, e.vec_id) as rank from embeddings e, ask_vector a),
    wiki_page as (select concat('p', page_id) as slug, url from pages),
    chan as (select * from lexical where rank <= 30 union all select query_id, 'semantic', rank, concat('d/', vec_id), concat('chunk ', vec_id) from vector_near where rank <= 30
    union all select o.query_id, 'wiki', o.rank, o.slug, h.url from overlap_r o join wiki_page h on o.slug = h.slug where o.rank <= 10)"""
FUSED = """fused as (select query_id, path, sum(1 / (60 + rank)) as score, arg_min(snippet, (-length(snippet), channel, rank)) as snippet, string_agg(distinct channel, ',' order by channel) as sources from chan group by 1, 2)"""


def _asked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    vectors = view(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("d/"), "vec_id").alias("path"), F.concat(F.lit("chunk "), "vec_id").alias("snippet"))
    questions = view(spark, sf_dir, "questions").join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    pages = view(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("slug"), F.col("url").alias("title"), F.col("html").alias("body"))
    return {"questions": questions, "symbols": view(spark, sf_dir, "symbols"), "files": _files(spark, sf_dir), "vectors": vectors, "pages": pages}


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir)
    asked = a["questions"].where("embedding is not null")
    wiki = retrieval.wiki_overlap(a["pages"], a["questions"], 10).join(a["pages"], "slug").select("query_id", F.lit("wiki").alias("channel"), "rank", F.col("slug").alias("path"), F.col("title").alias("snippet"))
    lists = retrieval.lexical_channel(a["questions"], a["symbols"], a["files"], 30).unionByName(retrieval.semantic_channel(a["vectors"], asked, 30)).unionByName(wiki)
    return Scratch(spark, "channels").table(lists, "lists")


@query(f"with {LISTS} select query_id, rank, path, snippet from lexical where rank <= 30")
def lexical_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir)
    return retrieval.lexical_channel(a["questions"], a["symbols"], a["files"], 30).drop("channel")


@query(f"with {LISTS}, {FUSED}, r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, path) as rank from fused) select query_id, path, round(score, 6) as score, snippet, sources, rank from r where rank <= 20")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""with {LISTS}, n as (select query_id, count(distinct channel) as n from chan group by 1), {FUSED}, r as (select f.*, row_number() over (partition by f.query_id order by round(score, 12) desc, path) as rank from fused f join n on f.query_id = n.query_id where n.n > 1)
    select query_id, path, round(score, 6) as score, snippet, sources, rank from r where rank <= 10 union all select c.query_id, path, round(1 / (60 + rank), 6), snippet, channel, rank from chan c join n on c.query_id = n.query_id where n.n = 1 and rank <= 10"""
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir)
    whole = retrieval.retrieve(a["questions"].where("embedding is not null"), a["symbols"], a["files"], a["vectors"], a["pages"], 10)
    return whole.withColumn("score", F.round("score", 6))


@query(
    f"""with {LISTS}, want as (select o_custkey % 40 as id, case when o_orderkey % 2 = 0 then concat('p', o_orderkey % 50) else concat('d/', o_orderkey % 50) end as path from orders), d as (select distinct id, path from want), top as (select distinct query_id as id, path from chan where rank <= 10)
    select d.id, round(count(top.path) / count(*), 4) as recall from d left join top on d.id = top.id and d.path = top.path group by 1"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = view(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("d/"), F.col("o_orderkey") % 50).alias("path"))
    got = _lists(spark, sf_dir).select(F.col("query_id").alias("id"), "path", "rank")
    return evaluation.recall_at_k(want, got, 10).withColumn("recall", F.round("recall", 4))


@query("select answer_id, regexp_matches(answer, '" + text.ABSTAIN.replace("'", "''") + "') as abstains from answers")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.abstention(view(spark, sf_dir, "answers"))


# -- review -----------------------------------------------------------------------------------------------------------

ADDED = "added as (select distinct concat('./', s.path) as path, cast(l_quantity as int) as line from lineitem join symbols s on l_partkey = s.symbol_id)"


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = view(spark, sf_dir, "symbols").select("symbol_id", "path")
    rows = view(spark, sf_dir, "lineitem").join(symbols, F.col("l_partkey") == F.col("symbol_id"))
    return rows.select(F.concat(F.lit("./"), "path").alias("path"), F.col("l_quantity").cast("int").alias("line")).distinct()


@query(
    f"""with {ADDED} select s.symbol_id, s.path, bool_or(a.line = s.start_line) as is_signature_change, count(*) as lines from symbols s join added a on ltrim(a.path, './') = ltrim(s.path, './')
    where a.line between s.start_line and s.end_line group by 1, 2"""
)
def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.changed_symbols(_added(spark, sf_dir), view(spark, sf_dir, "symbols"))


@query(f"with {ADDED}, r as (select *, line - row_number() over (partition by path order by line) as run from added) select path, min(line) as first_line, max(line) as last_line, count(*) as lines from r group by path, run")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.line_islands(_added(spark, sf_dir))


# A patch is made of a document: two hunk headers, then its lines tagged by their length.
def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda x: F.when(F.length(x) % 4 == 0, "-").when(F.length(x) % 4 == 1, " ").otherwise("+")
    body = F.transform(F.split("text", "\n"), lambda x: F.concat(tag(x), x))
    head = F.array(F.lit("diff"), F.concat(F.lit("@@ -1,4 +"), F.col("doc_id") % 7 + 1, F.lit(",6 @@")))
    return view(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.array_join(F.concat(head, body), "\n").alias("patch"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
    g as (select *, length(t) % 4 as m, sum(case when length(t) % 4 = 0 then 0 else 1 end) over (partition by doc_id order by i) as n from l)
    select concat('d/', doc_id) as path, doc_id % 7 + n as line, t as text from g where m >= 2"""
)
def patch_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.added_lines(_patches(spark, sf_dir))


@query(
    """with f as (select l_orderkey as pr_id, l_linenumber as finding_id, case l_returnflag when 'A' then 'blast_radius' when 'N' then 'duplicate' else 'pattern' end as chk, case when l_linestatus = 'O' then 'warning' else 'info' end as severity, round(0.5 + 5 * l_discount, 2) as confidence from lineitem),
    r as (select *, row_number() over (partition by pr_id order by case severity when 'warning' then 2 else 1 end desc, confidence desc, finding_id) as rank from f where chk <> 'pattern' and confidence >= 0.75)
    select pr_id, finding_id, severity, confidence, rank from r where rank <= 3"""
)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "blast_radius").when(F.col("l_returnflag") == "N", "duplicate").otherwise("pattern")
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("finding_id"), kind.alias("check"), F.when(F.col("l_linestatus") == "O", "warning").otherwise("info").alias("severity"), F.round(0.5 + 5 * F.col("l_discount"), 2).alias("confidence"))
    return review.threshold_gate(rows, 0.75, 3, ("pattern",)).select("pr_id", "finding_id", "severity", "confidence", "rank")


SCAN = ((r"<script\b", "script", "bundle"), (r"(?i)href=", "href", "router"), (r"<img\b", "img", "media"))


@query(
    """with l as (select page_id, unnest(string_split(html, chr(10))) as t, generate_subscripts(string_split(html, chr(10)), 1) as line from pages),
    m as (select page_id, line, c.name as raw_call from l, (values ('<script\\b', 'script'), ('(?i)href=', 'href'), ('<img\\b', 'img')) c(p, name) where regexp_matches(t, c.p))
    select concat('p', page_id) as path, raw_call, min(line) as line from m group by 1, 2"""
)
def raw_call_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("text"))
    return review.raw_calls(retrieval.lines(rows), SCAN).select("path", "raw_call", "line")


@query(
    """with n as (select o_orderstatus <> 'P' as posted, o_orderpriority like '1%' as dismissed from orders order by o_orderdate desc, o_orderkey desc limit 500)
    select count(*) as reviews, count(*) filter (where posted) as posted, round(count(*) filter (where posted and dismissed) / nullif(count(*) filter (where posted), 0), 4) as dismissal_rate from n"""
)
def dismissal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "P").alias("posted"), F.col("o_orderpriority").startswith("1").alias("dismissed"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("review_id"))
    return review.dismissal_rate(rows, 500).withColumn("dismissal_rate", F.round("dismissal_rate", 4))


@query(
    """with c as (select conv_id * 1000 + turn as answer_id, concat('d/', conv_id) as path, least(turn * 9 + 1, length(text) % 40) as a, greatest(turn * 9 + 1, length(text) % 40) as b from conversations),
    n as (select concat('d/', doc_id) as path, len(string_split(text, chr(10))) as total_lines from documents)
    select distinct answer_id, c.path, a as start_line, least(b, total_lines) as end_line from c join n on c.path = n.path where a <= total_lines"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.concat(F.lit("see [[ d/"), "conv_id", F.lit(":"), F.col("turn") * 9 + 1, F.lit(" - "), F.length("text") % 40, F.lit("]] and [[note]]"))
    answers = view(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), cited.alias("answer"))
    counts = _files(spark, sf_dir).select("path", F.size(F.split("text", "\n")).alias("total_lines"))
    return review.verify_citations(answers, counts)


# -- incremental ------------------------------------------------------------------------------------------------------


@query(
    """with b as (select concat('d/', doc_id) as path, sha1(text) as old from documents where source <> 'src3'), a as (select concat('d/', doc_id) as path, sha1(case when lang = 'de' then upper(text) else text end) as new from documents where source <> 'src5')
    select coalesce(b.path, a.path) as path, case when old is null then 'added' when new is null then 'deleted' when old = new then 'unchanged' else 'changed' end as status from b full join a on b.path = a.path"""
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d/"), "doc_id"))
    before = docs.where("source <> 'src3'").select("path", incremental.content_hash(F.col("text")).alias("sha"))
    after = docs.where("source <> 'src5'").select("path", incremental.content_hash(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))).alias("sha"))
    return incremental.change_detection(before, after)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return incremental.unseen(view(spark, sf_dir, "customer").select("c_custkey"), known, "c_custkey")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) x where n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest_per_key(view(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    """with l as (select doc_id, source, unnest(string_split(text, chr(10))) as t from documents), n as (select doc_id, list_sort(list(distinct sha1(t))) as s from l group by 1),
    o as (select doc_id, list_sort(list(distinct sha1(case when source = 'src1' then concat(t, '!') else t end))) as s from l where source <> 'src2' group by 1)
    select n.doc_id as path, coalesce(n.s = o.s, false) as reuse from n left join o on n.doc_id = o.doc_id"""
)
def chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source", F.explode(F.split("text", "\n")).alias("t"))
    old = rows.where("source <> 'src2'").select("path", F.sha1(F.when(F.col("source") == "src1", F.concat("t", F.lit("!"))).otherwise(F.col("t"))).alias("sha"))
    return incremental.reusable(old, rows.select("path", F.sha1("t").alias("sha")))


@query(
    """with p as (select o_orderkey as delivery_id, array_to_string(list_sort(list_distinct(list(concat('s', l_suppkey, '/p', l_partkey, '.py')))), ',') as paths, o_orderstatus from orders join lineitem on o_orderkey = l_orderkey group by 1, 3)
    select delivery_id, paths from p where o_orderstatus <> 'P'"""
)
def push_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == flag, F.concat(F.lit("./s"), "l_suppkey", F.lit("/p"), "l_partkey", F.lit(".py"))))
    met = view(spark, sf_dir, "orders").join(view(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    ref = F.when(F.col("o_orderstatus") == "P", "refs/heads/other").otherwise("refs/heads/main")
    pushes = met.groupBy(F.col("o_orderkey").alias("delivery_id"), ref.alias("ref")).agg(F.array(F.struct(files("A").alias("added"), files("N").alias("modified"), files("R").alias("removed"))).alias("commits"))
    return incremental.push_paths(pushes).select("delivery_id", F.array_join("paths", ",").alias("paths"))


@query()
def streaming_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running form of ownership_decay: state is a decayed sum a key, so it does not depend on arrival order."""
    return maintenance.ownership_stream_once(spark, view(spark, sf_dir, "commit_files"), AS_OF).withColumn("score", F.round("score", 4))


# -- text and planning ------------------------------------------------------------------------------------------------


@query()
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chunk_files(_files(spark, sf_dir)).select("path", "part", "start_line", "end_line", F.length("content").alias("chars"), "content_sha")


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", hash_embed(64)(F.col("text")).alias("embedding"))


@query(
    """with b as (select source, concat('d/', doc_id) as path, greatest(1, length(text) // 4) + 1 as cost from documents), u as (select *, sum(cost) over (partition by source order by path rows between unbounded preceding and current row) + 13 as used, row_number() over (partition by source order by path) as n from b),
    c as (select *, max(case when used > 4000 and n > 1 then 1 else 0 end) over (partition by source order by path rows between unbounded preceding and current row) as cut from u)
    select source, path, used from c where cut = 0"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select("source", F.concat(F.lit("d/"), "doc_id").alias("path"), (F.greatest(F.lit(1), F.floor(F.length("text") / 4)) + 1).alias("cost"))
    return planning.token_budget(rows, 4000, 13, [F.col("path")], "source").select("source", "path", "used")


@query(
    """with f as (select p_partkey as ref, case when p_size > 25 then 1.0 else 0.35 end as i, least(1.0, p_size / 8) as c, case when p_type like '%BRASS%' then 0.85 else 0.25 end as b, case when p_brand like '%1' then 0.9 else 0.15 end as r, least(1.0, greatest(0.0, p_retailprice / 2000 - 0.2)) as u from part),
    s as (select ref, round(least(1.0, greatest(0.0, 0.4 * i + 0.25 * c + 0.1 * b + 0.1 * r + 0.15 * u)), 3) as score from f) select ref, score, case when score >= 0.55 then 'deep' else 'brief' end as depth from s"""
)
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = planning.module_factors(F.col("p_size") > 25, F.col("p_size"), F.col("p_type").contains("BRASS"), F.col("p_brand").endswith("1"), F.col("p_retailprice") / 2000 - 0.2)
    return planning.priorities(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), *factors), "library")


@query(
    """with u as (select event_id as run_id, case user_id % 4 when 0 then 'gemini-3.1-flash-lite-001' when 1 then 'gemini-3.1-flash-002' when 2 then 'gemini-3.1-pro' else 'other-model' end as model,
    case when event_type = 'view' then null else 20 * cast(floor(value) as bigint) end as i, case when event_type = 'view' then null else 20 * cast(floor(value * 2) as bigint) end as o, 20 * cast(floor(value * 3) as bigint) as t from events),
    p(prefix, ip, op) as (values ('gemini-3.1-flash-lite', 0.10, 0.40), ('gemini-3.1-flash', 0.30, 2.50), ('gemini-3.1-pro', 1.25, 10.00), ('mock', 0.0, 0.0)),
    m as (select u.*, p.*, row_number() over (partition by run_id order by length(prefix) desc) as n from u left join p on starts_with(model, prefix))
    select run_id, model, prefix, round(case when i is null and o is null then t / 1e6 * ip else coalesce(i, 0) / 1e6 * ip + coalesce(o, 0) / 1e6 * op end::double, 6) as cost from m where n = 1"""
)
def price_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_type") != "view"
    model = F.element_at(F.array(F.lit("gemini-3.1-flash-lite-001"), F.lit("gemini-3.1-flash-002"), F.lit("gemini-3.1-pro"), F.lit("other-model")), (F.col("user_id") % 4 + 1).cast("int"))
    whole = lambda x: F.floor(x).cast("long") * 20
    usage = view(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), model.alias("model"), F.when(known, whole(F.col("value"))).alias("input_tokens"), F.when(known, whole(F.col("value") * 2)).alias("output_tokens"), whole(F.col("value") * 3).alias("total_tokens"))
    return planning.price_of(usage, planning.price_table(spark))


@query("select count(*) as checks, count(*) filter (where d.doc_id is null) as failed, count(*) filter (where d.doc_id is null) = 0 as publish from conversations c left join documents d on c.conv_id * 11 = d.doc_id")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = view(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("slug"), (F.col("conv_id") * 11).alias("ref"))
    known = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"))
    return planning.publish_gate(planning.reference_checks(refs, known))


@query(
    """with m as (select conv_id, turn, length(text) as chars, role = 'assistant' as is_tool from conversations), t as (select *, sum(chars) over (partition by conv_id) as total, count(*) over (partition by conv_id) - row_number() over (partition by conv_id order by turn) as rest from m),
    s as (select *, is_tool and rest >= 2 as can from t), b as (select *, coalesce(sum(case when can then chars - 20 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as saved from s)
    select conv_id, turn, can and floor((total - saved) / 4) > 300 as elided from b"""
)
def compact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), (F.col("role") == "assistant").alias("is_tool"), F.lit(20).alias("elided_chars"))
    return planning.compact_history(rows, 300)


@query(
    """with s as (select c_nationkey as repo_id, c_mktsegment as style, sum(round(c_acctbal)) as score from customer where c_acctbal > 0 group by 1, 2), r as (select *, row_number() over (partition by repo_id order by score desc, style) as rank, coalesce(lead(score) over (partition by repo_id order by score desc, style), 0) as nxt from s)
    select repo_id, style, score, rank, case when rank = 1 then round(score / (score + nxt), 3) end as confidence from r"""
)
def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.style_scores(view(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), F.col("c_mktsegment").alias("style"), F.when(F.col("c_acctbal") > 0, F.round("c_acctbal")).otherwise(0.0).alias("weight")))


@query(
    """with s as (select o_orderstatus, case o_orderpriority when '1-URGENT' then 'locate' when '2-HIGH' then 'flow' when '3-MEDIUM' then 'exact_string' when '5-LOW' then 'unanswerable' else 'history' end as category, o_totalprice > 150000 as found, o_custkey % 3 <> 0 as grounded, o_orderkey % 4 = 0 as abst from orders)
    select count(*) as n, round(avg(case when category in ('locate', 'flow', 'exact_string') then case when found then 1.0 else 0.5 end end), 4) as mean_recall, round(avg(case when category <> 'unanswerable' then grounded::int end), 4) as grounding_rate, round(avg(case when category <> 'unanswerable' then found::int end), 4) as string_match_rate,
    round(avg(case when category = 'unanswerable' then abst::int end), 4) as abstention_rate, round(1 - avg(case when category = 'unanswerable' then abst::int end), 4) as hallucination_rate from s"""
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "locate", "2-HIGH": "flow", "3-MEDIUM": "exact_string", "5-LOW": "unanswerable"}
    category = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in names.items()], F.lit("history"))
    rows = view(spark, sf_dir, "orders").select(category.alias("category"), (F.col("o_totalprice") > 150000).alias("f"), (F.col("o_custkey") % 3 != 0).alias("g"), (F.col("o_orderkey") % 4 == 0).alias("a"))
    asked = F.col("category") != "unanswerable"
    scores = rows.select("category", F.when(asked, F.when(F.col("f"), 1.0).otherwise(0.5)).alias("recall"), F.when(asked, F.col("f")).alias("found"), F.when(asked, F.col("g")).alias("grounded"), F.when(~asked, F.col("a")).alias("abstained"))
    out = evaluation.report(scores)
    return out.select("n", *[F.round(c, 4).alias(c) for c in out.columns if c != "n"])


@query(
    """with i as (select l_orderkey as id, list(distinct l_suppkey) filter (where l_quantity > 10) as e, list(distinct l_suppkey) filter (where l_quantity < 45) as f from lineitem group by 1), j as (select coalesce(e, []) as e, coalesce(f, []) as f from i)
    select round(sum(len(list_intersect(e, f))) / sum(len(f)), 4) as "precision", round(sum(len(list_intersect(e, f))) / sum(len(e)), 4) as recall, count(*) filter (where len(list_intersect(e, f)) < len(f)) as false_positive_items from j"""
)
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.collect_set(F.when(c, F.col("l_suppkey")))
    items = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(some(F.col("l_quantity") > 10).alias("expected"), some(F.col("l_quantity") < 45).alias("found"))
    out = evaluation.set_scores(items)
    return out.select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), "false_positive_items")


@query("select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, length(regexp_replace(html, '<[^>]*>', '', 'g')) // 4 as tokens from pages")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.token_estimate(F.regexp_replace("html", "<[^>]*>", "")).alias("tokens"))


@query(
    """with c as (select event_id as sha, concat('Merge #', user_id % 60, ' and GH-', event_id % 90) as message, user_id % 60 as m from events), p as (select c_custkey as number, c_custkey * 3 as merge_sha from customer),
    q as (select merge_sha, min(number) as merged from p group by 1) select c.sha, coalesce(q.merged, p.number) as pr_number from c left join q on c.sha = q.merge_sha left join p on c.m = p.number"""
)
def pull_request_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("Merge #"), F.col("user_id") % 60, F.lit(" and GH-"), F.col("event_id") % 90)
    commits = view(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), message.alias("message"))
    pulls = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), (F.col("c_custkey") * 3).alias("merge_commit_sha"))
    return ownership.link_pull_requests(commits, pulls).select("sha", F.col("pr_number").cast("long").alias("pr_number"))


@query(f"select replace(path, chr(92), '/') as path, count(*) as symbol_count, min(start_line) as start_line from symbols where {LAYER} = 'worker' group by 1 order by 2 desc, 1 limit 40")
def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.component_members(view(spark, sf_dir, "symbols"), "worker")


@query(
    """with w as (select s_suppkey as ref, concat('b', s_suppkey % 25) as path, concat('n', s_nationkey) as preferred from supplier), y as (select concat('b', p_partkey % 25) as path, p_partkey as symbol_id, concat('n', p_size) as name, case p_size % 3 when 0 then 'class' else 'function' end as kind, p_size as start_line from part),
    m as (select w.ref, y.symbol_id, row_number() over (partition by ref order by case when name = preferred then 0 when kind = 'function' then 1 else 2 end, start_line, symbol_id) as n from w join y on w.path = y.path) select ref, symbol_id from m where n = 1"""
)
def handler_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("b"), F.col("s_suppkey") % 25).alias("path"), F.concat(F.lit("n"), "s_nationkey").alias("preferred"))
    symbols = view(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_partkey") % 25).alias("path"), F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("n"), "p_size").alias("name"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("function").alias("kind"), F.col("p_size").alias("start_line"))
    return synthesis.pick_handlers(wanted, symbols)


@query("select user_id, sum(case when event_type = 'view' then 0 else cast(floor(value) as bigint) end) as input_tokens, sum(cast(floor(value * 2) as bigint)) as output_tokens, 0 as total_tokens from events group by 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "view", F.floor("value")).alias("input_tokens"), F.floor(F.col("value") * 2).alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    return synthesis.usage_totals(rows, ["user_id"])


@query("select n_regionkey as parent_key, string_agg(concat('n', n_nationkey), ',' order by concat('n', n_nationkey)) as children from nation group by 1")
def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = view(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent_key"))
    regions = view(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent_key"))
    tree = synthesis.module_tree(nations.unionByName(regions)).where(F.size("children") > 0)
    return tree.select(F.expr("cast(substring(key, 2) as int)").alias("parent_key"), F.array_join("children", ",").alias("children"))


@query("select concat('c', conv_id) as id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, max(turn) as last_turn from conversations where role <> 'system' group by 1")
def conversation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.groupBy(F.concat(F.lit("c"), "conv_id").alias("id")).agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query(
    """with s as (select n_regionkey as repo_id, case n_nationkey % 4 when 0 then 'backend_api' when 1 then 'frontend' when 2 then 'cli' else 'library' end as style, n_nationkey / 10.0 as score from nation),
    w as (select repo_id, coalesce(sum(score) filter (where style = 'backend_api'), 0) as b, coalesce(sum(score) filter (where style = 'frontend'), 0) as f, coalesce(sum(score) filter (where style = 'cli'), 0) as c, coalesce(sum(score) filter (where style = 'library'), 0) as l from s group by 1),
    d as (select *, case when b >= 3 and f >= 3 then 'fullstack_monorepo' when c >= 3 and c >= b and f < 3 then 'cli' when l >= 3 and b < 3 and f < 3 and c < 3 then 'library' when greatest(b, f, c, l) < 2.5 then 'unknown'
    when b >= greatest(f, c, l) then 'backend_api' when c >= greatest(f, l) then 'cli' when f >= l then 'frontend' else 'library' end as style from w),
    v as (select *, case style when 'backend_api' then b when 'frontend' then f when 'cli' then c when 'library' then l else 0 end as own, greatest(case when style = 'backend_api' then 0 else b end, case when style = 'frontend' then 0 else f end, case when style = 'cli' then 0 else c end, case when style = 'library' then 0 else l end) as rival from d)
    select repo_id, style, round(case when style = 'unknown' then 0.2 when rival <= 0 then least(0.9, 0.55 + own / 20) else least(0.97, greatest(0.45, own / (own + rival))) end, 3)::double as confidence from v"""
)
def style_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.element_at(F.array(*[F.lit(x) for x in ("backend_api", "frontend", "cli", "library")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return profile.decide_style(view(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("repo_id"), style.alias("style"), (F.col("n_nationkey") / 10.0).alias("score"))).drop("reason")
