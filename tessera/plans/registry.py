"""Named operators and SQL functions for callers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions import paths
from tessera.functions.vectors import hash_embed
from tessera.operators import extract, graph, ownership, retrieval, synthesis
from tessera.sources import tables

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "list_dir": tables.list_dir,
    "read_file": tables.read_file,
    "glob": tables.glob_files,
    "grep": retrieval.grep,
    "search_code": retrieval.retrieve,
    "find_symbol": retrieval.symbol_ladder,
    "git_log": ownership.git_log,
    "who_owns": ownership.who_owns,
    "why_here": ownership.why_here,
    "analyze_impact": graph.blast_radius,
    "call_flow": graph.call_flow,
    "query_flow": retrieval.flow_query,
    "component_members": synthesis.component_members,
    "list_pages": tables.list_pages,
    "list_repositories": tables.list_repositories,
}


def explain_diff(commit_files: DataFrame, sha: str, budget: int = 12_000) -> DataFrame:
    """Files of a commit in path order until their patches pass the character budget."""
    from tessera.operators.planning import token_budget

    return token_budget(commit_files.where(F.col("sha") == sha).withColumn("cost", F.length(F.coalesce("patch", F.lit("")))), budget)


def compare_releases(commits: DataFrame, base: str, head: str) -> DataFrame:
    """Commits after ``base`` up to ``head`` by time."""
    at = commits.select("sha", "committed_at")
    lo, hi = at.where(F.col("sha") == base).select(F.col("committed_at").alias("lo")), at.where(F.col("sha") == head).select(F.col("committed_at").alias("hi"))
    return commits.crossJoin(F.broadcast(lo)).crossJoin(F.broadcast(hi)).where("committed_at > lo and committed_at <= hi").drop("lo", "hi")


def git_blame(hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Commit of each (path, line) by the hunk that holds it."""
    return lines.join(hunks, "path").where("line between start_line and end_line").select("path", "line", "sha", "author_id")


TOOLS |= {"explain_diff": explain_diff, "compare_releases": compare_releases, "git_blame": git_blame}


def run_tool(name: str, *args: object, **kwargs: object) -> dict:
    """{ok, result} or {ok, error}; unknown tools and bad arguments do not raise."""
    if name not in TOOLS:
        return {"ok": False, "error": f"unknown tool {name}"}
    try:
        return {"ok": True, "result": TOOLS[name](*args, **kwargs)}
    except (TypeError, ValueError) as e:
        return {"ok": False, "error": str(e)}


#: Bodies of the SQL functions, in the order they are made (later ones call earlier ones); paths go by the rule tables of the column functions.
PLAIN = "lower(translate(coalesce(p, ''), '\\\\', '/'))"
CATEGORIES = ((paths.CRON, "cron"), (paths.WORKER, "workers"), (paths.ROUTE, "routes"), ("", "other"))
SQL_FUNCTIONS = {
    "normalize_path(p string) returns string": "regexp_replace(translate(coalesce(p, ''), '\\\\', '/'), '^[./]+', '')",
    "categorize_path(p string, n string) returns string": f"""case when {PLAIN} rlike {paths.sql_string(paths.TEST)} or startswith(lower(coalesce(n, '')), 'test_') then 'tests'
        when lower(coalesce(n, '')) rlike {paths.sql_string(paths.CRON)} then 'cron' else {paths.first_match(PLAIN, CATEGORIES)} end""",
    "layer_of_lower(l string) returns string": paths.layer_sql("l"),
    "domain_of_normal(q string) returns string": paths.domain_sql("q"),
    "assign_layer(p string) returns string": "layer_of_lower(lower(normalize_path(p)))",
    "assign_domain(p string) returns string": "domain_of_normal(normalize_path(p))",
}


@udtf(returnType=extract.SYMBOLS.removeprefix("path string, "))
class SymbolsOf:
    """Definitions of one file: extract_symbols(path, text)."""

    def eval(self, path: str, text: str):
        try:
            yield from list(extract._python_symbols(text) if path.endswith((".py", ".pyi")) else extract._js_symbols(text))[: extract.MOST_SYMBOLS] if text else ()
        except (SyntaxError, ValueError, RecursionError):
            return


@udtf(returnType=extract.REFERENCES.removeprefix("path string, "))
class ReferencesOf:
    """Calls and imports of one file: extract_references(path, text)."""

    def eval(self, path: str, text: str):
        try:
            yield from list(extract._python_references(text) if path.endswith((".py", ".pyi")) else extract._js_references(text)) if text else ()
        except (SyntaxError, ValueError, RecursionError):
            return


@udtf(returnType="start_line int, end_line int, content string")
class ChunksOf:
    """Line windows of one file: chunk_file(text)."""

    def eval(self, text: str):
        lines = (text or "").splitlines(keepends=True)
        for i, j in extract.split_lines(lines, extract.CHUNK_CHARS):
            yield i + 1, j, "".join(lines[i:j])


def register(spark: SparkSession) -> None:
    """SQL functions with JVM bodies (normalize_path, categorize_path, assign_layer, assign_domain), hash_embed, and the table functions extract_symbols, extract_references and chunk_file."""
    for head, body in SQL_FUNCTIONS.items():
        name, _, kind = head.partition(" returns ")
        spark.sql(f"create or replace temporary function {name} returns {kind} return {body}")
    spark.udf.register("hash_embed", hash_embed(64))
    for name, f in (("extract_symbols", SymbolsOf), ("extract_references", ReferencesOf), ("chunk_file", ChunksOf)):
        spark.udtf.register(name, f)
