"""Call-graph construction, traversal, rollups and clustering.

Traversals carry a seed with every frontier row, so many targets run as one
plan; each level is a written table, which keeps plans short and survives lost
executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import assign_domain, assign_layer, categorize_path, module_of, package_key, parent_prefix, risk_level
from tessera.functions.text import norm_route
from tessera.operators import forest
from tessera.sources.scratch import Scratch

IMPACT_KINDS = ("calls", "emits", "subscribes", "implements", "extends")
FLOW_KINDS = ("calls", "emits", "subscribes")
DEFINITIONS = ("function", "method", "class")
IMPORTED, UNIQUE, AMBIGUOUS, DYNAMIC, IMPORT_EDGE, ROUTE, MOST_CANDIDATES = 0.9, 0.55, 0.3, 0.35, 0.95, 0.4, 5
# Calls that emit, subscribe or register a route, and the objects routes are registered on.
EMIT_OPS = ("emit", "publish", "dispatch", "send", "fire", "trigger", "produce")
SUBSCRIBE_OPS = ("on", "subscribe", "addlistener", "addeventlistener", "listen", "consume")
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
ROUTE_RECEIVERS = ("app", "router", "api", "route", "blueprint", "bp", "server")
KEEP_RATIO, SPLIT_FROM, PAIRS = 0.45, 8, 1 << 22
#: Sites of an event a block, blocks that meet a task, and 64-bit bitmaps of frequent events.
EMITS, SUBSCRIBES, UNITS, MASKS = 1 << 12, 1 << 13, 8, 4


def confidence(c: Column) -> Column:
    """Null and zero count as one half."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))


# -- edge construction ------------------------------------------------------------------------------------------------


def binned(spans: DataFrame, start: str, end: str, width: int, name: str = "bin") -> DataFrame:
    """A row of ``spans`` for each bin of ``width`` that [start, end) touches."""
    return spans.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))


def enclosing_symbol(points: DataFrame, symbols: DataFrame, at: str = "byte", width: int = 2048) -> DataFrame:
    """Innermost definition around each point: least span, then start, then id. Null if none.

    Places (path, position) meet spans by path and bin, so the places and spans of a
    long file don't all meet. Points of one place, and definitions of one span, meet
    once; points are written once.
    """
    scratch = Scratch(points.sparkSession, "enclosing")
    asked = scratch.table(points.distinct(), "points")
    spans = symbols.where(F.col("kind").isin(*DEFINITIONS) & F.col("symbol_id").isNotNull()).groupBy("path", "start_byte", "end_byte").agg(F.min("symbol_id").alias("symbol_id"))
    places = asked.select("path", F.col(at).alias("_at")).distinct().withColumn("bin", F.floor(F.col("_at") / width))
    met = places.join(binned(spans, "start_byte", "end_byte", width), ["path", "bin"]).where("start_byte <= _at and _at < end_byte")
    pick = F.min(F.struct((F.col("end_byte") - F.col("start_byte")).alias("span"), "start_byte", "symbol_id"))
    found = scratch.table(met.groupBy("path", "_at").agg(pick.alias("m")).select("path", F.col("_at").alias(at), F.col("m.symbol_id").alias("src_id")), "found")
    return asked.join(found, ["path", at], "left").select(*points.columns, "src_id")


def resolve_modules(imports: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """First candidate path of each import that exists; null if none. ``candidates``: (import_id, pos, candidate)."""
    hits = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("import_id").agg(F.min_by("candidate", "pos").alias("target_path"))
    return imports.join(hits, "import_id", "left")


def module_candidates(imports: DataFrame) -> DataFrame:
    """Ordered candidate paths of (import_id, path, module, is_relative): Python modules and relative JavaScript ones."""
    folder = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    js = F.col("path").rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.greatest(dots - 1, F.lit(0)))), "/")
    tail = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    glue = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat_ws("/", a, b))
    base = F.when(F.col("is_relative"), glue(up, tail)).otherwise(tail)
    python = F.array(F.concat(base, F.lit(".py")), glue(base, F.lit("__init__.py")), F.concat(F.lit("src/"), base, F.lit(".py")), F.concat(F.lit("src/"), base, F.lit("/__init__.py")))
    climbs = F.size(F.split("module", r"\.\./")) - 1
    root = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - climbs)), "/")
    target = glue(root, F.regexp_replace("module", r"^(\.{1,2}/)+", ""))
    endings = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    script = F.when(F.col("module").startswith("."), F.array(*[F.concat(target, F.lit(e)) for e in endings])).otherwise(F.array().cast("array<string>"))
    return imports.select("import_id", F.posexplode(F.when(js, script).otherwise(python)).alias("pos", "candidate"))


def least_two(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, least, second): the two least ``dst_id`` of each key; null where there is no second."""
    least = rows.groupBy(*keys).agg(F.min("dst_id").alias("least"))
    second = rows.join(least, [*keys]).where("dst_id <> least").groupBy(*keys).agg(F.min("dst_id").alias("second"))
    return least.join(second, [*keys], "left")


def name_matches(rest: DataFrame, defs: DataFrame, scratch: Scratch) -> DataFrame:
    """(src_id, dst_id, name, path, alone) of every definition, but the caller, that bears the name of a call (src_id, path, name); ``alone`` where it is the only one.

    A caller meets a name once, whatever the number of its files. Of a name with many
    calls and definitions, calls are dealt over parts of some PAIRS pairs each, so no
    task makes all pairs of a name.
    """
    callers = scratch.table(rest.where("src_id is not null").groupBy("src_id", "name").agg(F.max("path").alias("path")), "callers")
    defs = defs.where("symbol_id is not null").select(F.col("symbol_id").alias("dst_id"), "name")
    names = callers.groupBy("name").agg(F.count("*").alias("made")).join(defs.groupBy("name").agg(F.count("*").alias("defined")), "name")
    names = scratch.table(names.select("name", "defined", F.ceil(F.col("made") * F.col("defined") / PAIRS).alias("parts")), "names")
    own = defs.groupBy(F.col("dst_id").alias("src_id"), "name").agg(F.count("*").alias("own"))
    asked = callers.join(names, "name").join(own, ["src_id", "name"], "left").withColumn("part", F.pmod(F.xxhash64("src_id"), "parts"))
    asked = asked.select("src_id", "name", "path", "part", (F.col("defined") - F.coalesce("own", F.lit(0)) == 1).alias("alone"))
    dealt = defs.join(names, "name").select("dst_id", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return asked.join(dealt, ["name", "part"]).where("src_id <> dst_id").select("src_id", "dst_id", "name", "path", "alone")


def call_edges(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, targets: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Edges of (src_id, path, name) calls: through an import binding (path, alias, target_path), else by name.

    With ``targets`` (module, target_path) bindings are (path, alias, module), and an
    alias may stand for a definition in any file of its module. Calls meet no more than
    two definitions of an alias, the least and the next for a caller that is the least.
    A call by name gives an edge to each definition of that name. With ``most`` it gives
    its first candidates only: a name is cut to these before it meets the calls, and
    before the shuffle too (a group limit), so no task sorts all definitions of a name.
    Where both ways find an edge, that of more confidence stays. Definitions and calls
    with what imports resolve are written once, as each is read more than once.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    calls = calls.select("src_id", "path", "name").distinct()
    defs = scratch.table(symbols.where(F.col("kind").isin(*DEFINITIONS)).select("symbol_id", "path", "name", "start_line"), "definitions")
    first = defs.groupBy(F.col("path").alias("target_path"), "name").agg(F.min_by("symbol_id", F.struct("start_line", "symbol_id")).alias("dst_id"))
    bound = bindings.select("path", F.col("alias").alias("name"), F.col("target_path" if targets is None else "module").alias("module"))
    if targets is None:
        options = first.withColumnRenamed("target_path", "module")
    else:
        two = least_two(scratch.table(targets.join(bound.select("module", "name").distinct(), "module").join(first, ["target_path", "name"]).select("module", "name", "dst_id"), "options"), "module", "name")
        options = two.select("module", "name", F.explode(F.array_compact(F.array("least", "second"))).alias("dst_id"))
    meant = scratch.table(least_two(scratch.table(bound.join(options, ["module", "name"]).select("path", "name", "dst_id"), "bound"), "path", "name"), "meant")
    resolved = calls.join(meant, ["path", "name"], "left").select("src_id", "path", "name", F.when(F.col("src_id") != F.col("least"), F.col("least")).when(F.col("src_id") != F.col("second"), F.col("second")).alias("dst_id"))
    resolved = scratch.table(resolved, "resolved")
    imported = resolved.where("dst_id is not null").select("src_id", "dst_id", "name", "path", F.lit("calls").alias("kind"), F.lit(IMPORTED).alias("confidence"), F.lit("import_resolved").alias("method"))
    rest = resolved.where("dst_id is null").drop("dst_id")
    if most is None:
        met = name_matches(rest, defs, scratch)
    else:
        # One more than the cap, since a caller is never its own candidate.
        found = defs.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("path", "start_line", "symbol_id"))).where(F.col("rank") <= most + 1)
        met = rest.join(found.select("name", F.col("symbol_id").alias("dst_id"), "rank"), "name").where("src_id <> dst_id")
        met = met.withColumn("place", F.row_number().over(Window.partitionBy("src_id", "path", "name").orderBy("rank"))).where(F.col("place") <= most)
        met = met.withColumn("alone", F.count("*").over(Window.partitionBy("src_id", "path", "name")) == 1)
    named = met.select("src_id", "dst_id", "name", "path", F.lit("calls").alias("kind"), F.when(F.col("alone"), UNIQUE).otherwise(AMBIGUOUS).alias("confidence"), F.lit("name_match").alias("method"))
    best = F.max(F.struct(F.col("confidence"), F.col("method"), F.col("name"), F.col("path"))).alias("m")
    return imported.unionByName(named).groupBy("src_id", "dst_id", "kind").agg(best).select("src_id", "dst_id", "m.name", "m.path", "kind", "m.confidence", "m.method")


def import_edges(resolved: DataFrame) -> DataFrame:
    """File to file (or outside module) edges of resolved imports (path, module, target_path), each once."""
    inside = F.col("target_path").isNotNull()
    rows = resolved.select("path", F.coalesce("target_path", "module").alias("dst_name"), F.when(inside, IMPORT_EDGE).otherwise(AMBIGUOUS).alias("confidence"), F.when(inside, "import_resolved").otherwise("name_match").alias("method"))
    best = rows.groupBy("path", "dst_name").agg(F.max(F.struct("confidence", "method")).alias("m"))
    return best.select("path", "dst_name", F.lit("imports").alias("kind"), "m.confidence", "m.method")


def event_sites(calls: DataFrame, subscribing: bool) -> DataFrame:
    """(symbol_id, event, path) of calls (src_id, path, name, str_arg) inside a symbol that emit, or subscribe to, a literal."""
    rows = calls.where(F.lower("name").isin(*(SUBSCRIBE_OPS if subscribing else EMIT_OPS)) & (F.col("str_arg") != "") & F.col("src_id").isNotNull())
    return rows.select(F.col("src_id").alias("symbol_id"), F.col("str_arg").alias("event"), "path").distinct()


def route_edges(calls: DataFrame) -> DataFrame:
    """Registrations of a path on an application object: (src_id or null, path, dst_name as METHOD /route)."""
    rows = calls.where(F.lower("name").isin(*HTTP_METHODS) & F.lower("receiver").isin(*ROUTE_RECEIVERS) & F.col("str_arg").startswith("/"))
    return rows.select("src_id", "path", F.concat_ws(" ", F.upper("name"), "str_arg").alias("dst_name")).distinct().select("src_id", "path", "dst_name", F.lit("route").alias("kind"), F.lit(ROUTE).alias("confidence"), F.lit("route_convention").alias("method"))


EDGE_COLUMNS = {"src_id": "string", "dst_id": "string", "dst_name": "string", "kind": "string", "confidence": "double", "method": "string", "path": "string"}


def union_edges(*parts: DataFrame) -> DataFrame:
    """Calls, imports, routes and events as one edge table; what a part lacks is null."""
    shaped = [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(k).alias(c) for c, k in EDGE_COLUMNS.items()]) for p in parts]
    out = shaped[0]
    for p in shaped[1:]:
        out = out.unionByName(p)
    return out


def route_endpoints(edges: DataFrame, symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(method, route, file_path, handler_name, source) of route edges, with the symbol and file they sit in if any; those ``known`` (method, route, file_path) are left out."""
    parsed = r"(?i)^\s*(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|WEBSOCKET)\s+(/\S*)\s*$"
    rows = edges.where(F.col("kind") == "route").select("src_id", F.regexp_extract("dst_name", parsed, 1).alias("method"), F.regexp_extract("dst_name", parsed, 2).alias("route")).where("method <> ''")
    met = rows.join(symbols.select(F.col("symbol_id").alias("src_id"), F.col("name").alias("handler_name"), F.col("path").alias("p")), "src_id", "left")
    found = met.select(F.upper("method").alias("method"), norm_route(F.col("route")).alias("route"), F.translate(F.coalesce("p", F.lit("")), "\\", "/").alias("file_path"), "handler_name")
    first = found.groupBy("method", "route", "file_path").agg(F.min("handler_name").alias("handler_name"))
    return first.join(known.select("method", "route", "file_path").distinct(), ["method", "route", "file_path"], "left_anti").withColumn("source", F.lit("route_convention"))


def graph_scope(files: DataFrame, symbols: DataFrame, edges: DataFrame, endpoints: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """What clustering and features read: files (path, symbol_count) and symbols without tests, file edges from symbol edges and imports, and the seeds of endpoints and jobs.

    ``endpoints``: method, route, file_path, handler_name. ``jobs``: name, path, kind.
    """
    plain = lambda df: df.withColumn("path", F.translate("path", "\\", "/")).where(assign_layer(F.col("path")) != "test")
    kept = plain(symbols)
    units = plain(files).select("path").unionByName(kept.select("path")).distinct().join(kept.groupBy("path").agg(F.count("*").alias("symbol_count")), "path", "left")
    units = units.withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    imports = edges.where("kind = 'imports' and src_id is null").select(F.col("path").alias("src"), F.translate("dst_name", "\\", "/").alias("dst"), confidence(F.col("confidence")).alias("weight"))
    known = units.select("path")
    imports = imports.where("src <> dst").join(known.withColumnRenamed("path", "src"), "src", "left_semi").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    linked = file_edges(edges.where("src_id is not null and dst_id is not null"), kept).unionByName(imports)
    at = kept.groupBy(F.col("path").alias("file_path"), "name").agg(F.max("symbol_id").alias("symbol_id"))
    http = endpoints.select(F.concat_ws(" ", "method", "route").alias("title"), F.lit("http").alias("kind"), F.coalesce("handler_name", "route").alias("name"), "file_path")
    work = jobs.select(F.col("name").alias("title"), F.when(F.col("kind") == "celery", "job").otherwise(F.col("kind")).alias("kind"), "name", F.translate("path", "\\", "/").alias("file_path"))
    return {"files": units, "symbols": kept, "edges": linked, "seeds": http.unionByName(work).join(at, ["file_path", "name"], "left").select("title", "kind", "symbol_id", "file_path", "name")}


def dynamic_edges(emits: DataFrame, subscribes: DataFrame) -> DataFrame:
    """Emitter to subscriber of one event literal, each pair once.

    A pair is made at its first common event only, so pairs, of which there may be far
    more than sites, are never shuffled. Whether two symbols have an earlier event in
    common is told by bitmaps for the events with most pairs, by lists for the others.
    The sites of an event meet in blocks, so neither an event's sites nor its pairs are
    one task's.
    """
    spark = emits.sparkSession
    scratch = Scratch(spark, "events")
    sites = {}
    for name, rows in (("src_id", emits), ("dst_id", subscribes)):
        rows = rows.select(F.col("symbol_id").alias(name), "event").where(F.col(name).isNotNull() & F.col("event").isNotNull())
        sites[name] = rows.distinct()
    count = lambda name: sites[name].groupBy("event").agg(F.count("*").alias(f"{name}s"))
    events = scratch.table(count("src_id").join(count("dst_id"), "event"), "both")
    most = events.orderBy(F.desc(F.col("src_ids") * F.col("dst_ids")), "event").limit(64 * MASKS)
    coded = most.select("event", (F.row_number().over(Window.orderBy("event")) - 1).alias("code"))
    blocks = [F.ceil(F.col("src_ids") / EMITS).alias("src_blocks"), F.ceil(F.col("dst_ids") / SUBSCRIBES).alias("dst_blocks")]
    events = scratch.table(events.join(coded, "event", "left").select("event", "code", *blocks), "events")
    units = events.agg(F.sum(F.col("src_blocks") * F.col("dst_blocks"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), units // UNITS)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def side(name: str, other: str) -> DataFrame:
        w = Window.partitionBy(name).orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
        mask = lambda i: F.when(F.floor(F.col("code") / 64) == i, F.expr("shiftleft(1L, code % 64)"))
        before = [F.coalesce(F.bit_or(mask(i)).over(w), F.lit(0)).alias(f"{name}_{i}") for i in range(MASKS)]
        before.append(F.collect_list(F.when(F.col("code").isNull(), F.col("event"))).over(w).alias(f"{name}_rest"))
        rows = sites[name].join(events, "event").select(name, "event", "src_blocks", "dst_blocks", *before)
        own = F.pmod(F.xxhash64(name), f"{name[:3]}_blocks").alias(f"{name[:3]}_block")
        rows = rows.select(name, "event", *[c for c in rows.columns if c.startswith(f"{name}_")], own, upto(f"{other[:3]}_blocks").alias(f"{other[:3]}_block"))
        return rows.repartition(parts, "event", "src_block", "dst_block")

    met = side("src_id", "dst_id").join(side("dst_id", "src_id").hint("shuffle_hash"), ["event", "src_block", "dst_block"])
    first = F.lit(True)
    for i in range(MASKS):
        first = first & (F.col(f"src_id_{i}").bitwiseAND(F.col(f"dst_id_{i}")) == 0)
    met = met.where((F.col("src_id") != F.col("dst_id")) & first & ((F.size("src_id_rest") == 0) | (F.size("dst_id_rest") == 0) | ~F.arrays_overlap("src_id_rest", "dst_id_rest")))
    return met.select("src_id", "dst_id", F.lit("emits").alias("kind"), F.lit(DYNAMIC).alias("confidence"), F.concat(F.lit("consumer "), "event").alias("dst_name"))


# -- traversal --------------------------------------------------------------------------------------------------------


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, max_nodes: int = 500, kinds: tuple[str, ...] = IMPACT_KINDS) -> DataFrame:
    """(seed, symbol_id, depth, min_confidence) of everything that reaches a seed.

    ``seeds``: (seed, symbol_id), several symbols a seed allowed. Level by level,
    nearest first; a node's confidence is the best bottleneck over its parents one
    level nearer. ``max_nodes`` a seed, cut within a level by (-confidence, id).
    """
    scratch = Scratch(edges.sparkSession, "blast")
    back = edges.where(F.col("kind").isin(*kinds) & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    back = scratch.table(back.groupBy(F.col("dst_id").alias("at"), F.col("src_id").alias("next")).agg(F.max(confidence(F.col("confidence"))).alias("c")), "edges")
    front = seeds.select("seed", "symbol_id", F.lit(0).alias("depth"), F.lit(1.0).cast("double").alias("min_confidence")).distinct()
    seen = front = scratch.table(front, "level-0")
    levels = [front]
    for d in range(1, max_depth + 1):
        reached = front.join(back, front["symbol_id"] == back["at"]).groupBy("seed", F.col("next").alias("symbol_id")).agg(F.max(F.least("min_confidence", "c")).alias("min_confidence"))
        new = reached.join(seen.select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti").select("seed", "symbol_id", F.lit(d).alias("depth"), "min_confidence")
        front = scratch.table(new, f"level-{d}")
        levels.append(front)
        seen = seen.unionByName(front)
        # A seed with max_nodes nodes gains none from a deeper level, so only the others go on.
        full = seen.where("depth > 0").groupBy("seed").count().where(F.col("count") >= max_nodes)
        front = front.join(full, "seed", "left_anti")
        if front.isEmpty():
            break
    found = levels[1]
    for x in levels[2:]:
        found = found.unionByName(x)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", F.desc("min_confidence"), "symbol_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max_nodes).drop("rank").withColumn("min_confidence", F.round("min_confidence", 3))


def recursive_reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """(seed, symbol_id, depth) of what reaches a seed, as one recursive query.

    For graphs with few paths to a node, such as hierarchies: every path is walked up
    to the depth, where ``blast_radius`` walks every node once.
    """
    spark, tag = edges.sparkSession, uuid.uuid4().hex
    edges.where("src_id is not null and dst_id is not null").select("src_id", "dst_id").createOrReplaceTempView(f"edges_{tag}")
    seeds.select("seed", "symbol_id").createOrReplaceTempView(f"seeds_{tag}")
    return spark.sql(
        f"""with recursive reach(seed, symbol_id, depth) as (select seed, symbol_id, 0 from seeds_{tag} union all
        select r.seed, e.src_id, r.depth + 1 from reach r join edges_{tag} e on e.dst_id = r.symbol_id where r.depth < {int(max_depth)})
        select r.seed, r.symbol_id, min(depth) as depth from reach r left anti join seeds_{tag} s on r.seed = s.seed and r.symbol_id = s.symbol_id group by 1, 2"""
    )


def component_impact(edges: DataFrame, members: DataFrame, max_depth: int = 4, max_nodes: int = 400) -> DataFrame:
    """What reaches any member (seed, symbol_id) of a component from outside of it."""
    return blast_radius(edges, members, max_depth, max_nodes)


def describe_impact(impact: DataFrame, symbols: DataFrame) -> DataFrame:
    return impact.join(symbols.select("symbol_id", "name", "path", "kind"), "symbol_id").withColumn("category", categorize_path(F.col("path"), F.col("name")))


def group_impact(impact: DataFrame) -> DataFrame:
    """Count and greatest confidence of a seed's impact by category."""
    return impact.groupBy("seed", "category").agg(F.count("*").alias("n"), F.max("min_confidence").alias("confidence"), F.min("depth").alias("nearest"))


def impact_risk(impact: DataFrame) -> DataFrame:
    reached = F.bool_or(F.col("category").isin("routes", "workers", "cron"))
    return impact.groupBy("seed").agg(F.count("*").alias("total"), reached.alias("reached")).select("seed", "total", risk_level(F.col("total"), F.col("reached")).alias("risk"))


def call_flow(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_steps: int = 100, kinds: tuple[str, ...] = FLOW_KINDS) -> DataFrame:
    """(seed, step, src_id, dst_id, kind, confidence, depth): breadth-first steps, each edge once, a node expanded once.

    A level's nodes are expanded in the order they were found; a node's edges go by
    (-confidence, dst_id, kind), the first kind of an edge wins.
    """
    scratch = Scratch(edges.sparkSession, "flow")
    out = edges.where(F.col("kind").isin(*kinds) & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).select("src_id", "dst_id", "kind", confidence(F.col("confidence")).alias("c"))
    out = scratch.table(out.groupBy("src_id", "dst_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "kind")).alias("m")).select("src_id", "dst_id", "m.kind", (-F.col("m.c")).alias("c")), "edges")
    front = seen = scratch.table(seeds.select("seed", F.col("symbol_id").alias("node"), F.lit(1).cast("long").alias("place")), "front-0")
    levels = []
    for d in range(1, max_depth + 1):
        order = Window.partitionBy("seed").orderBy("place", F.desc("c"), "dst_id", "kind")
        steps = front.join(out, front["node"] == out["src_id"]).select("seed", "src_id", "dst_id", "kind", "c", "place").withColumn("at", F.row_number().over(order)).withColumn("depth", F.lit(d))
        steps = scratch.table(steps.where(F.col("at") <= max_steps), f"steps-{d}")
        levels.append(steps)
        new = steps.groupBy("seed", F.col("dst_id").alias("node")).agg(F.min("at").cast("long").alias("place")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = scratch.table(new.select("seed", "node", "place"), f"front-{d}")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    step = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "at"))
    return rows.withColumn("step", step).where(F.col("step") <= max_steps).select("seed", "step", "src_id", "dst_id", "kind", F.round("c", 3).alias("confidence"), "depth")


def mermaid(steps: DataFrame) -> DataFrame:
    """Flowchart text of each seed's steps; edges under 0.7 dashed, kinds other than calls labelled."""
    arrow = F.when(F.col("confidence") >= 0.7, "-->").otherwise("-.->")
    label = F.when(F.col("kind") == "calls", "").otherwise(F.concat(F.lit("|"), "kind", F.lit("|")))
    line = F.concat(F.lit("    n"), "src_id", F.lit(" "), arrow, label, F.lit(" n"), "dst_id")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("step", line.alias("line")))), lambda x: x["line"])
    return steps.groupBy("seed").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(lines, "\n")).alias("diagram"))


# -- rollups ----------------------------------------------------------------------------------------------------------


def _ends(edges: DataFrame, symbols: DataFrame, key: dict[str, Column], kinds: tuple[str, ...]) -> DataFrame:
    side = lambda end: symbols.select(F.col("symbol_id").alias(f"{end}_id"), *[c.alias(f"{end}_{k}") for k, c in key.items()])
    return edges.where(F.col("kind").isin(*kinds)).join(side("src"), "src_id").join(side("dst"), "dst_id")


def module_graph(edges: DataFrame, symbols: DataFrame, depth: int = 2, kinds: tuple[str, ...] = (*IMPACT_KINDS, "imports")) -> DataFrame:
    """Edges between modules with their number and mean confidence."""
    met = _ends(edges, symbols, {"mod": module_of(F.col("path"), depth)}, kinds).where("src_mod <> dst_mod")
    return met.groupBy(F.col("src_mod").alias("src"), F.col("dst_mod").alias("dst")).agg(F.count("*").alias("weight"), F.round(F.avg(confidence(F.col("confidence"))), 3).alias("confidence"))


def module_nodes(symbols: DataFrame, depth: int = 2) -> DataFrame:
    return symbols.groupBy(module_of(F.col("path"), depth).alias("id")).agg(F.count("*").alias("symbol_count"))


def architecture_nodes(symbols: DataFrame, by_layer: bool = False, most_folders: int = 8) -> DataFrame:
    """Components (layer, domain) without tests: symbols, files and first folders."""
    rows = symbols.select(assign_layer(F.col("path")).alias("layer"), assign_domain(F.col("path")).alias("domain"), "path", module_of(F.col("path"), 2).alias("folder")).where("layer <> 'test'")
    keys = ["layer"] if by_layer else ["layer", "domain"]
    folders = F.array_join(F.slice(F.sort_array(F.collect_set("folder")), 1, most_folders), ",")
    return rows.groupBy(*keys).agg(F.count("*").alias("symbol_count"), F.countDistinct("path").alias("file_count"), folders.alias("folders"))


def component_rollup(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(layer, domain, file_count, symbol_count, folders): components without tests, files without symbols too, and up to twelve folders of two segments."""
    key = [assign_layer(F.col("path")).alias("layer"), assign_domain(F.col("path")).alias("domain")]
    rows = files.select("path", F.lit(0).alias("n")).unionByName(symbols.select("path", F.lit(1).alias("n"))).select(*key, "path", "n").where("layer <> 'test'")
    folders = F.slice(F.sort_array(F.collect_set(module_of(parent_prefix(F.col("path")), 2))), 1, 12)
    return rows.groupBy("layer", "domain").agg(F.countDistinct("path").alias("file_count"), F.sum("n").alias("symbol_count"), F.array_join(folders, ",").alias("folders"))


def hotspots(symbols: DataFrame, most: int = 6) -> DataFrame:
    """(path, symbol_count, layer, domain) of the fullest files without tests."""
    p = F.translate("path", "\\", "/")
    rows = symbols.select(p.alias("path")).where(assign_layer(F.col("path")) != "test").groupBy("path").agg(F.count("*").alias("symbol_count"))
    return rows.orderBy(F.desc("symbol_count"), "path").limit(most).select("path", "symbol_count", assign_layer(F.col("path")).alias("layer"), assign_domain(F.col("path")).alias("domain"))


def folder_topk(symbols: DataFrame, most: int = 24) -> DataFrame:
    """(folder, symbols) of the fullest folders without tests."""
    rows = symbols.where(categorize_path(F.col("path")) != "tests").groupBy(parent_prefix(F.col("path")).alias("folder")).agg(F.count("*").alias("symbols"))
    return rows.orderBy(F.desc("symbols"), "folder").limit(most)


def layout(layers: DataFrame, x_gap: float = 200.0, y_gap: float = 140.0) -> DataFrame:
    """(id, layer, x, y): nodes of a layer side by side in order of id."""
    place = F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1
    return layers.select("id", "layer", F.round(place * x_gap, 1).alias("x"), F.round(F.col("layer") * y_gap, 1).alias("y"))


def topological_order(modules: DataFrame) -> DataFrame:
    """(key, parent_key, level) of (key, parent_key): parents before children, a level a round; what hangs on no known parent goes under the application."""
    scratch = Scratch(modules.sparkSession, "order")
    known = modules.select(F.col("key").alias("parent_key")).distinct().withColumn("known", F.lit(True))
    rows = scratch.table(modules.select("key", "parent_key").join(known, "parent_key", "left"), "rows")
    front = scratch.table(rows.where("parent_key is null").select("key", "parent_key", F.lit(0).alias("level")), "0")
    done, rest, level = front, rows.where("parent_key is not null"), 0
    while True:
        level += 1
        met = rest.join(front.select(F.col("key").alias("parent_key")), "parent_key", "left_semi").select("key", "parent_key", F.lit(level).alias("level"))
        front = scratch.table(met, str(level))
        if front.isEmpty():
            break
        done = done.unionByName(front)
    root = not done.where("key = 'application'").isEmpty()
    left = rest.select("key").join(done.select("key"), "key", "left_anti")
    return done.unionByName(left.select("key", F.lit("application" if root else None).cast("string").alias("parent_key"), F.lit(level + 1).alias("level")))


def architecture_edges(edges: DataFrame, symbols: DataFrame, by_layer: bool = False, kinds: tuple[str, ...] = (*IMPACT_KINDS, "imports")) -> DataFrame:
    layer, domain = assign_layer(F.col("path")), assign_domain(F.col("path"))
    key = {"c": layer if by_layer else F.concat_ws(":", layer, domain), "layer": layer}
    met = _ends(edges, symbols, key, kinds).where("src_layer <> 'test' and dst_layer <> 'test' and src_c <> dst_c")
    return met.groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.count("*").alias("weight"), F.round(F.avg(confidence(F.col("confidence"))), 3).alias("confidence"))


def architecture(edges: DataFrame, symbols: DataFrame, most: int = 18) -> DataFrame:
    """Component edges, at layer grain where there are more than ``most`` components."""
    wide = architecture_nodes(symbols).limit(most + 1).count() > most
    return architecture_edges(edges, symbols, by_layer=wide)


def file_edges(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("calls", "imports", "implements", "extends")) -> DataFrame:
    met = _ends(edges, symbols, {"path": F.col("path")}, kinds).where("src_path <> dst_path")
    return met.groupBy(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).agg(F.round(F.sum(F.greatest(confidence(F.col("confidence")), F.lit(0.1))), 3).alias("weight"))


def layering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): the longest path that ends in a node; with n nodes, n for those on a cycle or behind one.

    That is where relaxing all edges n + 1 times, with n as the limit, comes to rest:
    nodes are peeled off round by round, those without a predecessor left first, and
    what is never peeled is on a cycle or behind one. Rounds follow the longest path
    outside cycles, and each handles the edges that are left.
    """
    scratch = Scratch(nodes.sparkSession, "layers")
    ids = scratch.table(nodes.select("id").distinct(), "ids")
    left = edges.where("src <> dst").select("src", "dst").distinct()
    left = scratch.table(left.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "edges-0")
    behind = scratch.table(left.select(F.col("dst").alias("id")).distinct(), "behind-0")
    done = [ids.join(behind, "id", "left_anti").select("id", F.lit(0).alias("layer"))]
    while True:
        turn = len(done)
        # Edges from nodes that still have a predecessor stay.
        left = scratch.table(left.join(behind.withColumnRenamed("id", "src"), "src", "left_semi"), f"edges-{turn}")
        now = scratch.table(left.select(F.col("dst").alias("id")).distinct(), f"behind-{turn}")
        free = scratch.table(behind.join(now, "id", "left_anti").select("id", F.lit(turn).alias("layer")), f"layer-{turn}")
        if free.isEmpty():
            break
        done.append(free)
        behind = now
    n = ids.count()
    out = behind.select("id", F.lit(n).alias("layer"))
    for layer in done:
        out = out.unionByName(layer)
    return out


# -- clustering -------------------------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b and summed weights."""
    rows = edges.where("src <> dst and weight > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


def strong_edges(pairs: DataFrame, ratio: float = KEEP_RATIO) -> DataFrame:
    """Pairs whose weight is at least ``ratio`` of the greater of its ends' greatest weights."""
    both = pairs.select(F.col("a").alias("v"), "w").unionByName(pairs.select(F.col("b").alias("v"), "w"))
    peak = both.groupBy("v").agg(F.max("w").alias("p"))
    met = pairs.join(peak.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(peak.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
    return met.where(F.col("w") + 1e-9 >= ratio * F.greatest("pa", "pb")).select("a", "b", "w")


def connected_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): least id reachable over ``pairs`` (a, b); by alternating large and small stars, a written table a round.

    Tasks first make stars of parts of bounded size; edges that fit one part are done by then.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    now = scratch.table(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    parts = -(-now.count() // forest.PART)
    state, i = None, 0
    if parts:
        i += 1
        starred = now.repartition(parts, "a", "b").mapInArrow(forest.stars, now.schema)
        now = scratch.table(starred.where("a <> b").distinct(), str(i))
        scratch.drop(str(i - 1))
    while parts > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        i += 1
        now = scratch.table(small, str(i))
        scratch.drop(str(i - 1))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    low = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    return nodes.select("id").distinct().join(low, "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): components over strong edges; nodes without edges go by package; large clusters are split at weak edges.

    A lone node with a strong edge to its strongest neighbour is in that neighbour's component already, since both are kept by the same ratio.
    """
    scratch = Scratch(nodes.sparkSession, "clusters")
    pairs = scratch.table(undirected(edges), "pairs")
    comp = connected_components(nodes, strong_edges(pairs))
    linked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().withColumn("linked", F.lit(True))
    comp = comp.join(linked, "id", "left").withColumn("cluster", F.when(F.col("linked"), F.col("component")).otherwise(F.concat(F.lit("package:"), package_key(F.col("id")))))
    member = scratch.table(comp.select("id", "cluster"), "member")
    large = member.join(member.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= SPLIT_FROM).select("cluster"), "cluster", "left_semi")
    inside = pairs.join(large.withColumnRenamed("id", "a"), "a").join(large.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other").select("cluster", "a", "b", "w")
    inside = scratch.table(inside, "inside")
    scratch.drop("pairs")
    tree = scratch.table(forest.spanning_forest(inside.select("cluster", "a", "b", "w"), scratch, connected_components), "forest")
    cut = scratch.table(forest.weakest_cuts(large, inside, tree, scratch, connected_components), "cuts")
    parted = large.join(cut.select("cluster"), "cluster", "left_semi").select("id")
    kept = tree.join(inside.select("a", "b", "cluster"), ["a", "b"]).join(cut, "cluster").where(F.struct("w", "a", "b") > F.col("e")).select("a", "b")
    parts = connected_components(parted, kept).select("id", F.col("component").alias("cluster"))
    return member.join(parted, "id", "left_anti").unionByName(parts)


def cohesion(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, files, cohesion, coupling): inner and crossing weight as shares; without edges 1 for a lone file, else 0."""
    met = pairs.join(member.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    inner = met.where("ca = cb").select(F.col("ca").alias("cluster"), F.col("w").alias("intra"), F.lit(0.0).alias("outer"))
    for c in ("ca", "cb"):
        inner = inner.unionByName(met.where("ca <> cb").select(F.col(c).alias("cluster"), F.lit(0.0).alias("intra"), F.col("w").alias("outer")))
    sums = inner.groupBy("cluster").agg(F.sum("intra").alias("intra"), F.sum("outer").alias("outer"))
    rows = member.groupBy("cluster").agg(F.count("*").alias("files")).join(sums, "cluster", "left")
    total = F.coalesce(F.col("intra") + F.col("outer"), F.lit(0.0))
    return rows.select(
        "cluster",
        "files",
        F.round(F.when(total > 0, F.col("intra") / total).when(F.col("files") <= 1, 1.0).otherwise(0.0), 3).alias("cohesion"),
        F.round(F.when(total > 0, F.col("outer") / total).otherwise(0.0), 3).alias("coupling"),
    )


def cluster_names(member: DataFrame, generic: tuple[str, ...] = ("src", "apps", "packages", "lib", "libs", "services", "app", "api", "main", "index", "core", "common", "utils")) -> DataFrame:
    """Most frequent folder name that says something, ties by name; else the first file's stem."""
    dirs = member.select("cluster", F.explode(F.filter(F.slice(F.split("id", "/"), 1, F.greatest(F.size(F.split("id", "/")) - 1, F.lit(0))), lambda x: ~F.lower(x).isin(*generic) & (x != ""))).alias("d"))
    best = dirs.groupBy("cluster", "d").count().groupBy("cluster").agg(F.min(F.struct((-F.col("count")).alias("n"), F.lower("d").alias("d"))).alias("m"))
    stem = member.groupBy("cluster").agg(F.regexp_extract(F.min("id"), r"([^/.]+)[^/]*$", 1).alias("stem"))
    return stem.join(best, "cluster", "left").select("cluster", F.initcap(F.coalesce("m.d", "stem")).alias("name"))
