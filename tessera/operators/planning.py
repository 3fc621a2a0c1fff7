"""Budgets, priorities, prices, profiles, publish gates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priority weights by style (importance, centrality, business, risk, uncertainty), prices by model prefix (input, output for a million tokens), and the analyzers of each style.
FACTORS = ("importance", "centrality", "business", "risk", "uncertainty")
WEIGHTS = {
    "default": (0.30, 0.20, 0.20, 0.20, 0.10),
    "backend_api": (0.25, 0.20, 0.25, 0.20, 0.10),
    "frontend": (0.30, 0.15, 0.25, 0.15, 0.15),
    "fullstack_monorepo": (0.25, 0.20, 0.25, 0.20, 0.10),
    "ml_system": (0.20, 0.15, 0.30, 0.15, 0.20),
    "cli": (0.40, 0.15, 0.20, 0.10, 0.15),
    "library": (0.40, 0.25, 0.10, 0.10, 0.15),
    "event_driven": (0.25, 0.25, 0.20, 0.20, 0.10),
    "infra": (0.20, 0.15, 0.15, 0.35, 0.15),
    "data_pipeline": (0.25, 0.25, 0.20, 0.15, 0.15),
}
PRICES = {"gemini-3.1-flash-lite": (0.10, 0.40), "gemini-3.1-flash": (0.30, 2.50), "gemini-3.1-pro": (1.25, 10.00), "mock": (0.0, 0.0)}
DEEP = 0.55
CHARS_PER_TOKEN = 4


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def priorities(entities: DataFrame, style: str = "default") -> DataFrame:
    """(ref, score, depth) of entities with the five factors; by (-score, ref)."""
    weights = WEIGHTS.get(style, WEIGHTS["default"])
    total = sum(F.lit(w) * unit(F.col(f)) for w, f in zip(weights, FACTORS, strict=True))
    score = F.round(unit(total), 3)
    return entities.select("ref", score.alias("score"), F.when(score >= DEEP, "deep").otherwise("brief").alias("depth"))


def module_factors(has_entry: Column, in_degree: Column, in_feature: Column, auth: Column, coupling: Column) -> list[Column]:
    return [
        F.when(has_entry, 1.0).otherwise(0.35).alias("importance"),
        F.least(F.lit(1.0), in_degree / 8).alias("centrality"),
        F.when(in_feature, 0.85).otherwise(0.25).alias("business"),
        F.when(auth, 0.9).otherwise(0.15).alias("risk"),
        unit(coupling).alias("uncertainty"),
    ]


def doc_plan(profile: DataFrame) -> DataFrame:
    """(style, key, enabled) of page categories, from a row of signals: style, analyzers, endpoint_count, feature_count, entry_point_count, has_tests, has_models, has_auth."""
    has = lambda *names: F.arrays_overlap("analyzers", F.array(*[F.lit(n) for n in names]))
    rules = {
        "overview": F.lit(True),
        "architecture": F.lit(True),
        "execution_flows": (F.col("entry_point_count") > 0) | (F.col("feature_count") > 0) | has("http", "worker", "event"),
        "data": has("db") | F.col("has_models"),
        "security": F.col("has_auth"),
        "testing": F.col("has_tests"),
        "deploy": has("docker", "ci"),
        "api": has("http") | (F.col("endpoint_count") > 0),
    }
    extra = {
        "ml_system": ("agent", "tool", "prompt", "retrieval", "eval"),
        "frontend": ("page_map", "component_map"),
        "library": ("public_api", "extension_guide"),
        "cli": ("commands",),
        "event_driven": ("events",),
        "data_pipeline": ("pipeline",),
    }
    rows = [F.struct(F.lit(k).alias("key"), e.alias("enabled")) for k, e in rules.items()]
    more = F.array().cast("array<struct<key:string,enabled:boolean>>")
    for style, keys in extra.items():
        more = F.when(F.col("style") == style, F.array(*[F.struct(F.lit(k).alias("key"), F.lit(True).alias("enabled")) for k in keys])).otherwise(more)
    return profile.select("style", F.explode(F.concat(F.array(*rows), more)).alias("c")).select("style", "c.key", "c.enabled")


def style_scores(signals: DataFrame) -> DataFrame:
    """(repo_id, style, score, confidence): summed weights, best first; confidence is the best's share of the best two."""
    sums = signals.where("weight > 0").groupBy("repo_id", "style").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("score"), "style")
    ranked = sums.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.select("repo_id", "style", "score", "rank", F.round(F.when(F.col("rank") == 1, F.col("score") / (F.col("score") + F.col("next"))), 3).alias("confidence"))


def price_of(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of (run_id, model, input_tokens, output_tokens, total_tokens) at the longest price prefix; null if none; only a total goes at the input rate."""
    met = usage.join(F.broadcast(prices), F.expr("startswith(model, prefix)"), "left")
    best = met.groupBy("run_id").agg(F.max_by(F.struct(*[F.col(c) for c in ("model", "input_tokens", "output_tokens", "total_tokens", "prefix", "input_price", "output_price")]), F.length(F.coalesce("prefix", F.lit("")))).alias("m"))
    rows = best.select("run_id", "m.*")
    split = F.coalesce("input_tokens", F.lit(0)) / 1e6 * F.col("input_price") + F.coalesce("output_tokens", F.lit(0)) / 1e6 * F.col("output_price")
    cost = F.when(F.col("input_tokens").isNull() & F.col("output_tokens").isNull(), F.col("total_tokens") / 1e6 * F.col("input_price")).otherwise(split)
    return rows.select("run_id", "model", "prefix", F.round(cost, 6).alias("cost"))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "prefix string, input_price double, output_price double")


def token_budget(blocks: DataFrame, budget: int, header: int = 0, order: list[Column] | None = None, key: str | None = None) -> DataFrame:
    """Blocks (cost) in order until the first that would pass the budget; the first block always stays."""
    order = order or [F.col("path")]
    if key is None:  # each block costs one at least, so no more than the budget can stay: a top-k bounds the one task
        blocks = blocks.where("cost > 0").orderBy(*order).limit(budget + 1)
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(*order)
    used = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + header
    rows = blocks.withColumn("used", used).withColumn("over", (F.col("used") > budget) & (F.row_number().over(w) > 1))
    return rows.withColumn("cut", F.max(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("cut = 0").drop("over", "cut")


def repo_map(symbols: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(path, used, block): signatures by file, shallow and dense files first, methods under their class, cut at the budget."""
    usable = symbols.where(F.col("kind").isin("class", "function", "method", "interface", "type") & F.col("name").isNotNull())
    sig = F.element_at(F.split(F.trim(F.coalesce("signature", "name")), "\n"), 1)
    parents = usable.select(F.col("symbol_id").alias("pid"), F.col("path").alias("ppath"), F.col("start_line").alias("pline"))
    met = usable.join(parents, (F.col("parent_id") == F.col("pid")) & (F.col("path") == F.col("ppath")) & (F.col("kind") == "method"), "left")
    line = F.concat(F.when(F.col("pid").isNotNull(), "    ").otherwise("  "), sig, F.lit("  # L"), F.col("start_line"))
    blocks = met.groupBy("path").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pline", "start_line").alias("a"), F.col("pid").isNotNull().alias("b"), "start_line", "name", line.alias("l")))), lambda x: x["l"]), "\n").alias("body")
    )
    blocks = blocks.withColumn("block", F.concat_ws("\n", "path", "body")).withColumn("cost", F.greatest(F.lit(1), F.floor(F.length("block") / CHARS_PER_TOKEN)) + 1)
    return token_budget(blocks, max_tokens, 13, [F.length(F.regexp_replace("path", "[^/]", "")), F.desc("n"), F.col("path")]).select("path", "used", "block")


def compact_history(messages: DataFrame, budget: int, keep_last: int = 2) -> DataFrame:
    """(conv_id, turn, elided): oldest tool results elided until a conversation is under budget; the last ``keep_last`` stay.

    ``messages``: conv_id, turn, chars, is_tool, elided_chars. The reference order is oldest first: a message is elided
    where the total, less what earlier elisions saved, is still over budget.
    """
    w = Window.partitionBy("conv_id")
    rows = messages.withColumn("total", F.sum("chars").over(w)).withColumn("left", F.count("*").over(w) - F.row_number().over(w.orderBy("turn")))
    can = F.col("is_tool") & (F.col("left") >= keep_last)
    saved = F.when(can, F.col("chars") - F.col("elided_chars")).otherwise(0)
    before = F.coalesce(F.sum(saved).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("elided", can & (F.floor((F.col("total") - before) / CHARS_PER_TOKEN) > budget)).select("conv_id", "turn", "elided")


def reference_checks(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, ref, ok): whether each page's reference exists."""
    met = refs.join(known.select("ref").distinct().withColumn("ok", F.lit(True)), "ref", "left")
    return met.select("slug", "ref", F.coalesce("ok", F.lit(False)).alias("ok"))


def publish_gate(checks: DataFrame) -> DataFrame:
    """A run's number of checks and failures, and whether all its pages may be published."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("publish"))


def staleness(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Targets whose content hash is not the stored one."""
    met = found.join(stored.select("target", F.col("content_sha").alias("old")), "target", "left")
    return met.where(~F.col("content_sha").eqNullSafe(F.col("old"))).drop("old")


def gate_verdict(recall: Column, baseline: float = 0.97) -> Column:
    """PASS from the recorded baseline on."""
    return F.when(recall + 1e-9 >= baseline, "PASS").otherwise("FAIL")


def question_set(modules: DataFrame, features: DataFrame, most: int = 8) -> DataFrame:
    """(pos, question): one of the whole, of the first four features, and of the first three modules; ``modules`` and ``features`` are (pos, name)."""
    spark = modules.sparkSession
    first = spark.createDataFrame([(0, 0, "What are the main modules, and how do they relate?")], "part int, pos int, question string")
    of = lambda df, part, n, text: df.orderBy("pos").limit(n).select(F.lit(part).alias("part"), F.col("pos").cast("int").alias("pos"), text.alias("question"))
    rows = first.unionByName(of(features, 1, 4, F.concat(F.lit("How does "), "name", F.lit(" work, and which modules does it cross?"))))
    rows = rows.unionByName(of(modules, 2, 3, F.concat(F.lit("What is "), "name", F.lit(" responsible for?"))))
    return rows.orderBy("part", "pos").limit(most).select(F.row_number().over(Window.orderBy("part", "pos")).alias("pos"), "question")
