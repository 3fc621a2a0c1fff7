"""Lexical, semantic and overlap retrieval, and reciprocal-rank fusion.

Queries are rows too, so a batch of questions is one plan. A ranked list is
(query_id, rank, path, snippet, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import overlap_tokens, query_identifiers, trigrams
from tessera.functions.vectors import cosine_distance
from tessera.operators import gramindex, vectorindex
from tessera.operators.gramindex import GramIndex
from tessera.operators.vectorindex import VectorIndex
from tessera.sources.scratch import Scratch

K, MOST_LINES, LINE_CLIP = 60, 200, 1000


def _rank(rows: DataFrame, order: list[Column], limit: int | None, key: str = "query_id") -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit else out


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = 10, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) by exact cosine distance, ties by id; over ``index`` if there is one, else over one made for this query set."""
    scratch = Scratch(vectors.sparkSession, "nearest")
    return (index or vectorindex.build(vectors, scratch.path("index"))).search(queries, limit, scratch)


def top_nearest(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """One query: a top-k sort without a window."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", cosine_distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "vec_id").limit(limit)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def symbol_names(symbols: DataFrame, path: str) -> GramIndex:
    """The index of lower-cased names that ``symbol_ladder`` looks up."""
    return gramindex.build(symbols.select(F.lower("name").alias("low")).where("low is not null").distinct(), path, F.col("low"))


def symbol_ladder(symbols: DataFrame, names: DataFrame, limit: int | None = None, index: GramIndex | None = None) -> DataFrame:
    """Exact 100, case-blind 90, prefix 70, substring 50; the best symbol of a path; by (-score, path, line).

    Names meet over a trigram index: ``index`` if there is one, else one made for these symbols.
    """
    index = index or symbol_names(symbols, Scratch(symbols.sparkSession, "ladder").path("names"))
    asked = names.select("query_id", F.trim("query").alias("q"), F.lower(F.trim("query")).alias("ql"))
    found = index.containing(asked.select(F.col("ql").alias("ask_id"), F.col("ql").alias("needle")).distinct()).select("low", F.col("needle").alias("ql"))
    met = found.join(symbols.withColumn("low", F.lower("name")), "low").join(asked, "ql")
    score = F.when(F.col("name") == F.col("q"), 100).when(F.col("low") == F.col("ql"), 90).when(F.col("low").startswith(F.col("ql")), 70).otherwise(50)
    best = first_per_key(met.withColumn("score", score), ["query_id", "path"], [F.desc("score"), F.col("start_line"), F.col("symbol_id")])
    return _rank(best, [F.desc("score"), F.col("path"), F.col("start_line")], limit).select("query_id", "rank", "path", "symbol_id", "name", "start_line", "score")


def fuzzy_symbols(symbols: DataFrame, names: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Trigram similarity of at least ``threshold``: an inverted join, so pairs without a common trigram never meet."""
    left = symbols.select("symbol_id", "name", trigrams(F.col("name")).alias("t"))
    left = left.select("symbol_id", "name", F.size("t").alias("n"), F.explode("t").alias("gram"))
    right = names.select("query_id", trigrams(F.col("query")).alias("q"))
    right = right.select("query_id", F.size("q").alias("m"), F.explode("q").alias("gram"))
    met = left.join(right, "gram").groupBy("query_id", "symbol_id", "name", "n", "m").agg(F.count("*").alias("k"))
    return met.select("query_id", "symbol_id", "name", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, text): 1-based lines."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def file_lines(files: DataFrame, path: str) -> GramIndex:
    """The index of files (path, text) that ``grep`` looks up."""
    return gramindex.build(files.select("path", F.col("text").alias("body")), path, gramindex.ascii_lower(F.col("body")), by_line=True)


def grep(files: DataFrame | None, pattern: str, ignore_case: bool = False, path_prefix: str | None = None, limit: int | None = MOST_LINES, index: GramIndex | None = None) -> DataFrame:
    """Lines that match, clipped, in (path, line) order; of ``files``, or of those that ``index`` (``file_lines``) can't rule out."""
    if index is not None:
        files = index.matching(pattern).select("path", F.col("body").alias("text"))
    rows = files.where(F.col("path").startswith(path_prefix)) if path_prefix else files
    found = lines(rows).where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)).withColumn("text", F.substring("text", 1, LINE_CLIP))
    return found.orderBy("path", "line").limit(limit) if limit else found


def wiki_overlap(pages: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Share of a query's tokens that a page has; pages without any are left out; by (-score, slug).

    An inverted join on tokens: only pages and queries that share one meet.
    """
    asked = queries.select("query_id", overlap_tokens(F.col("query")).alias("q"))
    tokens = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("token"))
    have = pages.select("slug", F.explode(overlap_tokens(F.concat_ws(" ", "title", "body"))).alias("token"))
    met = have.join(tokens, "token").groupBy("query_id", "slug").agg((F.count("*") / F.first("n")).alias("score"))
    return _rank(met, [F.desc("score"), F.col("slug")], limit)


def reciprocal_rank_fusion(lists: DataFrame, k: int = K, limit: int = 20) -> DataFrame:
    """Fuse (query_id, channel, rank, path, snippet): each occurrence adds 1 / (k + rank); the longest snippet stays, first channel and rank on ties."""
    pick = F.min_by("snippet", F.struct((-F.length("snippet")).alias("l"), "channel", "rank"))
    fused = lists.groupBy("query_id", "path").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), pick.alias("snippet"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))
    return _rank(fused, [F.desc(F.round("score", 12)), F.col("path")], limit)


def hybrid(lists: DataFrame, k: int = K, limit: int = 20) -> DataFrame:
    """Fusion; a query with one channel keeps that list as it is, scores 1 / (k + rank) and all."""
    channels = lists.groupBy("query_id").agg(F.countDistinct("channel").alias("channels"))
    met = lists.join(channels, "query_id")
    alone = met.where("channels = 1").select("query_id", "path", (1 / (F.lit(k) + F.col("rank"))).alias("score"), "snippet", F.col("channel").alias("sources"), "rank").where(F.col("rank") <= limit)
    return reciprocal_rank_fusion(met.where("channels > 1"), k, limit).select("query_id", "path", "score", "snippet", "sources", "rank").unionByName(alone)


def lexical_channel(questions: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 15, most_names: int = 6) -> DataFrame:
    """(query_id, channel, rank, path, snippet): symbols of each question's best identifiers, name after name until 2 * limit are found, then the lines that hold the first name; one hit a path.

    A line holds a name if one of its runs of letters, digits and underscores is the name, so lines and names meet by equality.
    """
    named = questions.select("query_id", F.posexplode(F.slice(query_identifiers(F.col("query")), 1, most_names)).alias("part", "name"))
    scratch = Scratch(questions.sparkSession, "lexical")
    named = scratch.table(named.withColumn("asked", F.xxhash64("query_id", "part")), "named")
    hits = symbol_ladder(symbols, named.select(F.col("asked").alias("query_id"), F.col("name").alias("query")), limit)
    hits = hits.select(F.col("query_id").alias("asked"), "rank", "path", F.col("name").alias("snippet")).join(named.select("asked", "query_id", "part"), "asked").drop("asked")
    hits = scratch.table(hits, "hits")
    found = hits.groupBy("query_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = found.withColumn("before", before).where(F.col("before") < 2 * limit).select("query_id", "part")
    hits = hits.join(wanted, ["query_id", "part"])
    words = lines(files).select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))
    held = words.join(named.where("part = 0").select("query_id", "name"), "name").groupBy("query_id", "path").agg(F.min_by(F.struct("line", "text"), "line").alias("m"))
    held = _rank(held, [F.col("path")], limit).select("query_id", F.lit(most_names).alias("part"), "rank", "path", F.substring("m.text", 1, 400).alias("snippet"))
    rows = first_per_key(hits.unionByName(held), ["query_id", "path"], [F.col("part"), F.col("rank")])
    return _rank(rows.withColumnRenamed("rank", "at"), [F.col("part"), F.col("at"), F.col("path")], limit).select("query_id", F.lit("lexical").alias("channel"), "rank", "path", "snippet")


def semantic_channel(vectors: DataFrame, questions: DataFrame, limit: int = 15) -> DataFrame:
    """The nearest chunks (vec_id, embedding, path, snippet) of questions (query_id, embedding); the nearest chunk of a path counts."""
    near = nearest(vectors.select("vec_id", "embedding"), questions.select("query_id", "embedding"), limit)
    met = near.join(vectors.select("vec_id", "path", "snippet"), "vec_id")
    best = met.groupBy("query_id", "path").agg(F.min_by(F.struct("rank", "snippet"), "rank").alias("m"))
    return _rank(best.select("query_id", "path", F.col("m.rank").alias("at"), "m.snippet"), [F.col("at")], limit).select("query_id", F.lit("semantic").alias("channel"), "rank", "path", "snippet")


def retrieve(questions: DataFrame, symbols: DataFrame, files: DataFrame, vectors: DataFrame, pages: DataFrame, limit: int = 10, fresh: bool = True) -> DataFrame:
    """Hybrid answers to (query_id, query, embedding): lexical and semantic channels of max(3 * limit, 15) and a wiki channel of ``limit``, fused; a stale index leaves the lexical one alone. The lists are written once."""
    wide = max(3 * limit, 15)
    lists = lexical_channel(questions, symbols, files, wide)
    if fresh:
        wiki = wiki_overlap(pages, questions, limit).join(pages.select("slug", "title"), "slug")
        lists = lists.unionByName(semantic_channel(vectors, questions, wide)).unionByName(wiki.select("query_id", F.lit("wiki").alias("channel"), "rank", F.col("slug").alias("path"), F.col("title").alias("snippet")))
    return hybrid(Scratch(questions.sparkSession, "channels").table(lists, "lists"), limit=limit)


def catalog_scores(entries: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, entry_id, kind, title, path, literal, score) of catalogue entries (entry_id, kind, title, literal, path) that a question speaks of.

    Shared tokens, 5 for a literal in the question (4 for a job's name), 1.5 where
    the entry's path is among ``hits`` (query_id, path), 0.5 more for http. Each
    part is a join of its own: on tokens, over a trigram index of the questions, on
    paths.
    """
    scratch = Scratch(entries.sparkSession, "catalog")
    asked = questions.select("query_id", F.explode(overlap_tokens(F.col("query"))).alias("token"))
    named = entries.select("entry_id", F.explode(overlap_tokens(F.concat_ws(" ", "title", "literal"))).alias("token"))
    shared = named.join(asked, "token").groupBy("query_id", "entry_id").agg(F.count("*").cast("double").alias("score"))
    spoken = entries.where(F.length("literal") > 1).select("entry_id", "kind", F.lower("literal").alias("needle"))
    met = gramindex.containing(questions.select("query_id", F.lower("query").alias("low")).where("low is not null"), F.col("low"), spoken.select(F.col("needle").alias("ask_id"), "needle").distinct(), scratch)
    said = met.select("query_id", "needle").join(spoken, "needle").select("query_id", "entry_id", F.when(F.col("kind") == "job", 4.0).otherwise(5.0).alias("score"))
    at = hits.select("query_id", "path").distinct().join(entries.select("entry_id", "kind", "path"), "path").select("query_id", "entry_id", F.when(F.col("kind") == "http", 2.0).otherwise(1.5).alias("score"))
    total = shared.unionByName(said).unionByName(at).groupBy("query_id", "entry_id").agg(F.sum("score").alias("score"))
    return total.join(entries.select("entry_id", "kind", "title", "path", "literal"), "entry_id").select("query_id", "entry_id", "kind", "title", "path", "literal", "score")


def catalog_seed(entries: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """The best entry of each question: by score, http before others, then title; else the first retrieved path that an entry has, http first."""
    scores = Scratch(entries.sparkSession, "seeds").table(catalog_scores(entries, questions, hits), "scores")
    best = first_per_key(scores, ["query_id"], [F.desc("score"), F.col("kind") != "http", F.col("title"), F.col("entry_id")])
    met = hits.select("query_id", "rank", "path").join(entries.select("entry_id", "kind", "title", "path"), "path").join(best.select("query_id"), "query_id", "left_anti")
    other = first_per_key(met, ["query_id"], [F.col("rank"), F.col("kind") != "http", F.col("title"), F.col("entry_id")])
    return best.select("query_id", "entry_id", "kind", "title", "path", "score").unionByName(other.select("query_id", "entry_id", "kind", "title", "path", F.lit(1.0).alias("score")))


def flow_query(questions: DataFrame, hits: DataFrame, entries: DataFrame, flows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, steps) of questions about a flow: retrieval picks a catalogue entry; a known flow (flow_id, title) of its title, or that names its literal, answers; else the entry's symbol is traced.

    ``entries`` also have ``symbol_id`` (null: unknown). Answers: query_id, matched,
    title, kind, flow_id. Steps: those of traced questions, by query_id.
    """
    from tessera.operators import graph

    scratch = Scratch(entries.sparkSession, "flows")
    seeds = scratch.table(catalog_seed(entries, questions, hits).join(entries.select("entry_id", "literal", "symbol_id"), "entry_id"), "seeds")
    known = flows.select("flow_id", F.lower("title").alias("t"), F.col("title").alias("flow_title"))
    same = seeds.select("query_id", F.lower("title").alias("t")).join(known, "t").select("query_id", "flow_id", F.lit(0).alias("way"))
    literals = seeds.where("kind = 'http' and literal <> ''").select("query_id", F.col("literal").alias("needle"))
    held = gramindex.containing(known.where("flow_title is not null"), F.col("flow_title"), literals.select(F.col("needle").alias("ask_id"), "needle").distinct(), scratch, "titles")
    named = held.select("flow_id", "needle").join(literals, "needle").select("query_id", "flow_id", F.lit(1).alias("way"))
    flow = first_per_key(same.unionByName(named), ["query_id"], [F.col("way"), F.col("flow_id")]).select("query_id", "flow_id")
    answers = questions.select("query_id").join(seeds, "query_id", "left").join(flow, "query_id", "left")
    answers = answers.select("query_id", F.col("entry_id").isNotNull().alias("matched"), "title", "kind", "flow_id", "symbol_id")
    traced = answers.where("matched and flow_id is null and symbol_id is not null").select(F.col("query_id").alias("seed"), "symbol_id")
    return answers.drop("symbol_id"), graph.call_flow(edges, traced)
