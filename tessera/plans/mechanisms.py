"""Registered queries of the trees, histories, indexes, forests and tables that other operators stand on, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import forest, graph, history, ownership, retrieval
from tessera.plans.catalogue import ADAPTERS, query, view
from tessera.sources import tables, tree
from tessera.sources.scratch import Scratch

ADAPTERS |= {
    "tree_files": """select case doc_id % 8 when 0 then concat('src/', source, '/f', doc_id, '.py') when 1 then concat('web/node_modules/', source, '/f', doc_id, '.js') when 2 then concat('web/', lang, '/_f', doc_id, '.ts')
        when 3 then concat('pkg', doc_id, '/package.json') when 4 then concat('.github/workflows/w', doc_id, '.yml') when 5 then concat('build/f', doc_id, '.py') when 6 then concat('docs/f', doc_id, '.md')
        else concat('deploy/', source, '/k', doc_id, '.yaml') end as path, coalesce(text, '') as text, doc_id % 8 as kind from documents""",
    "history": """select o_orderkey as sha, o_orderdate as committed_at, o_custkey % 40 as branch, lag(o_orderkey) over (partition by o_custkey % 40 order by o_orderkey) as first_up, case when o_orderkey % 7 = 0 then o_orderkey - 5 end as second_up from orders""",
    "moves": "select lang as sha, concat(source, '/f', doc_id, '.txt') as path, doc_id % 2 = 1 as added, text from documents",
}


PATTERNS = ("licen[cs]ed? under", "(copyright|\\(c\\)) [0-9]{4}", "https?://[a-z]+", "[a-z]+@[a-z]+[.](com|org)", "q[uvw]x+z")


# -- indexes ----------------------------------------------------------------------------------------------------------


@query(
    f"""with l as (select concat('d/', doc_id) as path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), p as (select unnest([{", ".join(f"'{p}'" for p in PATTERNS)}]) as pattern)
    select pattern, path, cast(line as int) as line, substr(text, 1, 1000) as text from l, p where regexp_matches(text, concat('(?i)', pattern))"""
)
def grep_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several expressions over one stored index of the documents; only what it can't rule out is read again."""
    files = view(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    index = retrieval.file_lines(files, Scratch(spark, "grep").path("index"))
    found = [retrieval.grep(None, p, ignore_case=True, limit=None, index=index).select(F.lit(p).alias("pattern"), "path", "line", "text") for p in PATTERNS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- graphs -----------------------------------------------------------------------------------------------------------

DEPENDS = """depends as (select distinct concat('s', l_suppkey) as src, concat('p', l_partkey) as dst from lineitem union select concat('p', p_partkey), p_brand from part union select p_brand, p_type from part where p_size < 5
    union select p_type, split_part(p_type, ' ', 1) from part union select p_type, concat(p_brand, '+') from part where p_size = 50 union select concat(p_brand, '+'), p_type from part where p_size = 49)"""


@query(
    f"""recursive with {DEPENDS}, node as (select src as id from depends union select dst from depends), n as (select count(*) as n from node),
    walk(id, layer) as (select id, 0 from node union select d.dst, layer + 1 from walk join depends d on d.src = walk.id, n where layer < n and d.src <> d.dst) select id, max(layer) as layer from walk group by 1"""
)
def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts, brands and types as a graph of some thousand nodes, with cycles between types and brands."""
    part = view(spark, sf_dir, "part")
    two = lambda a, b, where="true": part.where(where).select(F.expr(a).alias("src"), F.expr(b).alias("dst"))
    first = "split_part(p_type, ' ', 1)"
    edges = view(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) as src", "concat('p', l_partkey) as dst")
    for more in (two("concat('p', p_partkey)", "p_brand"), two("p_brand", "p_type", "p_size < 5"), two("p_type", first), two("p_type", "concat(p_brand, '+')", "p_size = 50"), two("concat(p_brand, '+')", "p_type", "p_size = 49")):
        edges = edges.unionByName(more)
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return graph.layering(nodes, edges)


@query(
    """with pair as (select least(src_id, dst_id) as a, greatest(src_id, dst_id) as b, sum(cast(confidence as double)) as w from edges where src_id <> dst_id group by 1, 2), member as (select symbol_id as id, split_part(path, '/', 1) as cluster from symbols),
    met as (select x.cluster, a as src, b as dst, round(w, 3) as weight from pair join member x on a = x.id join member y on b = y.id where x.cluster = y.cluster), ranked as (select *, row_number() over (partition by cluster order by weight desc, src, dst) as rank from met)
    select cluster, src, dst, weight, cast(rank as int) as rank from ranked where rank <= 12"""
)
def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest inner edges of each top folder."""
    pairs = graph.undirected(view(spark, sf_dir, "edges").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("confidence").cast("double").alias("weight")))
    member = view(spark, sf_dir, "symbols").select(F.col("symbol_id").alias("id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("cluster"))
    return forest.evidence_edges(pairs, member)


# -- trees and history ------------------------------------------------------------------------------------------------


@query("select path, cast(strlen(text) as bigint) as length, md5(text) as digest from tree_files where kind in (0, 2, 3, 4, 7)")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files, scanned as a repository: skipped folders and other files are never opened."""
    root = Scratch(spark, "tree").path("files")
    tree.write_tree(view(spark, sf_dir, "tree_files"), root)
    return tables.source_files(spark, root, manifests=True).select("path", "length", F.md5("text").alias("digest"))


@query("select path, kind in (0, 2, 3, 4, 7) as scanned, kind = 7 as infra, kind = 4 as ci, kind in (0, 1, 2, 5) as embeddable, kind in (0, 2) as source from tree_files")
def tree_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules hold for each path: sources, manifests, workflows, deployment files, skipped folders."""
    p = F.col("path")
    return view(spark, sf_dir, "tree_files").select("path", paths.is_scanned(p).alias("scanned"), paths.is_infra(p).alias("infra"), paths.is_ci(p).alias("ci"), paths.is_embeddable(p).alias("embeddable"), paths.is_source(p).alias("source"))


@query(
    """recursive with up as (select sha, first_up as up from history where first_up is not null union all select sha, second_up from history where second_up in (select sha from history)),
    reach(sha) as (select max(sha) from history where branch = 0 union select u.up from reach r join up u on u.sha = r.sha) select sha, committed_at from history where sha in (select sha from reach)"""
)
def head_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits that the newest one of a branch reaches, merges included; those of other branches are absent."""
    commits = view(spark, sf_dir, "history").withColumn("parents", F.array("first_up", "second_up"))
    head = commits.where("branch = 0").agg(F.max("sha").alias("sha"))
    return ownership.commit_walk(commits, commits.where("false"), heads=head).select("sha", "committed_at")


@query(
    """recursive with f as (select * from moves where text <> '' and sha is not null), eq_rank as (select sha, path, added, md5(text) as d, row_number() over (partition by sha, added, md5(text) order by path) as n from f),
    eq as (select o.sha, o.path as old_path, w.path as new_path from eq_rank o join eq_rank w on o.sha = w.sha and o.d = w.d and o.n = w.n and not o.added and w.added),
    rest as (select * from f where (sha, path) not in (select (sha, old_path) from eq union all select (sha, new_path) from eq)),
    line as (select sha, path, added, l, count(*) as n, max(strlen(l) + 1) as bytes from (select sha, path, added, unnest(string_split(text, chr(10))) as l from rest) z group by all),
    size as (select sha, path, sum(n * bytes) as size from line group by all),
    shared as (select o.sha, o.path as old_path, w.path as new_path, sum(least(o.n, w.n) * o.bytes) as shared from line o join line w on o.sha = w.sha and o.l = w.l and not o.added and w.added group by all),
    pair as (select s.sha, old_path, new_path, shared * 100 // greatest(a.size, b.size) as similarity from shared s join size a on a.sha = s.sha and a.path = old_path join size b on b.sha = s.sha and b.path = new_path),
    ordered as (select *, row_number() over (order by similarity desc, split_part(old_path, '/', -1) <> split_part(new_path, '/', -1), md5(concat(sha, chr(10), old_path, chr(10), new_path)), old_path, new_path) as i from pair where similarity >= 50),
    greedy(i, used) as (select cast(0 as bigint), cast([] as varchar[]) union all select g.i + 1, case when list_contains(used, concat(p.sha, '<', old_path)) or list_contains(used, concat(p.sha, '>', new_path)) then used else list_concat(used, [concat(p.sha, '<', old_path), concat(p.sha, '>', new_path), cast(p.i as varchar)]) end from greedy g join ordered p on p.i = g.i + 1),
    last as (select used from greedy order by i desc limit 1)
    select sha, old_path, new_path, cast(100 as bigint) as similarity from eq union all select sha, old_path, new_path, cast(similarity as bigint) from ordered, last where list_contains(used, cast(ordered.i as varchar))"""
)
def detected_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language as one commit's files, every other one deleted, the rest added."""
    return history.renames(view(spark, sf_dir, "moves"))
