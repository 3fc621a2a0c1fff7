"""What kind of repository it is: frameworks, weighted signals, the decision, and the analyzers that follow from it.

Facts of many repositories are one table, a row each; every signal is a row of a
rule table evaluated over it, so detectors are data and a plan is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, is_ci, is_infra, normalize_path, parent_prefix

# Package or import names of frameworks.
FRAMEWORKS = {
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "starlette": "Starlette", "celery": "Celery", "next": "Next.js", "react": "React", "express": "Express", "hono": "Hono", "nestjs": "NestJS", "vue": "Vue",
    "svelte": "Svelte", "sqlalchemy": "SQLAlchemy", "prisma": "Prisma", "alembic": "Alembic", "click": "Click", "typer": "Typer", "langchain": "LangChain", "transformers": "Transformers", "torch": "PyTorch",
    "sklearn": "scikit-learn", "airflow": "Airflow", "dagster": "Dagster", "prefect": "Prefect",
}
#: Names that count anywhere in a package's name.
LOOSE = ("next", "react", "fastapi", "express")
# The style each family of frameworks speaks for, with the weight of a declared and of an imported one (React's is the same), and families without a style.
FAMILIES = {
    "backend_api": ("FastAPI", "Flask", "Django", "Starlette", "Express", "NestJS", "Hono"), "frontend": ("Next.js", "React", "Vue", "Svelte"), "event_driven": ("Celery",),
    "ml_system": ("LangChain", "Transformers", "PyTorch", "scikit-learn"), "data_pipeline": ("Airflow", "Dagster", "Prefect"), "cli": ("Click", "Typer"),
}
DATABASE = ("SQLAlchemy", "Prisma", "Alembic")
DECLARED, IMPORTED, REACT = 3.0, 1.5, 2.0
# Folder names that hint at a style, tool definitions, and files that export a package.
AREAS = {"ml_system": (1.2, ("prompts", "prompt", "evals", "eval", "retrieval", "agents", "agent")), "data_pipeline": (1.5, ("dags", "pipelines", "transforms", "sinks"))}
TOOL = r"@(tool|function_tool)\b|\"type\"\s*:\s*\"function\"|\bBaseTool\b|\bStructuredTool\b"
EXPORTS = ("__init__.py", "index.ts", "index.js", "index.tsx")
# Detectors over a repository's facts: name, style, weight, condition.
SIGNALS = (
    ("entry_point", "backend_api", 2.0, "http_entries > 0"),
    ("entry_point", "frontend", 2.0, "page_entries > 0"),
    ("entry_point", "frontend", 1.5, "page_entries = 0 and next_entries > 0"),
    ("entry_point", "event_driven", 2.0, "worker_entries > 0"),
    ("entry_point", "cli", 2.5, "cli_entries > 0 and http_entries = 0"),
    ("endpoints", "backend_api", 1.0, "endpoints > 0 and http_entries > 0"),
    ("endpoints", "backend_api", 1.5, "plain_endpoints > 0 and http_entries = 0 and next_entries = 0"),
    ("jobs", "event_driven", 1.5, "jobs > 0"),
    ("console_scripts", "cli", 3.0, "scripts > 0"),
    ("layout", "fullstack_monorepo", 2.5, "api_folders > 0 and web_folders > 0"),
    ("languages", "fullstack_monorepo", 2.0, "python_files > 0 and script_files > 0"),
    ("tool_definitions", "ml_system", 2.0, "tools > 0"),
    ("event_edges", "event_driven", 2.5, "event_edges >= 2 and event_edges > route_edges"),
    ("infra_files", "infra", 0.0, "infra_files > 0"),
    ("ci_files", "infra", 0.0, "ci_files > 0"),
    ("infra_dominant", "infra", 4.5, "infra_files >= 2 and files <= infra_files"),
)
LIBRARY = (("package_manifest", "library", 3.5, "manifests > 0"), ("exports", "library", 1.5, "manifests > 0 and exports > 0"))
APPLICATION = "http_entries > 0 or page_entries > 0 or worker_entries > 0 or scripts > 0 or endpoints > 0 or jobs > 0"
COUNTS = (
    "http_entries", "page_entries", "next_entries", "worker_entries", "cli_entries", "endpoints", "plain_endpoints", "jobs", "scripts", "api_folders", "web_folders", "python_files", "script_files", "tools", "event_edges",
    "route_edges", "infra_files", "ci_files", "files", "manifests", "exports",
)
# What a style must reach, in order of precedence; a number is a score to compare with, a name another style, ``best`` the highest score.
DECISIONS = (
    ("infra", "infra_dominates_source", "infra >= 4, infra >= best"),
    ("ml_system", "ml_signals", "ml_system >= 4, ml_system >= backend_api, ml_system >= frontend"),
    ("data_pipeline", "pipeline_shape", "data_pipeline >= 4, data_pipeline >= backend_api, frontend < 3"),
    ("fullstack_monorepo", "backend_and_frontend", "backend_api >= 3, frontend >= 3"),
    ("fullstack_monorepo", "multi_surface", "fullstack_monorepo >= 4, backend_api >= 2, frontend >= 2"),
    ("event_driven", "queues_over_http", "event_driven >= 3, event_driven > backend_api, backend_api < 3, frontend < 3"),
    ("cli", "cli_entry", "cli >= 3, cli >= backend_api, frontend < 3, event_driven < cli"),
    ("library", "package_without_app_entry", "library >= 3, backend_api < 3, frontend < 3, cli < 3, event_driven < 3"),
)
LEAST_SCORE, UNSURE = 2.5, 0.35
STYLES = ("backend_api", "frontend", "fullstack_monorepo", "ml_system", "cli", "library", "event_driven", "infra", "data_pipeline")
# Analyzers, those of each style, those that evidence adds, and those a style never runs.
ANALYZERS = ("http", "db", "ui", "worker", "event", "cli", "ai", "docker", "ci")
STYLE_ANALYZERS = {
    "backend_api": ("http", "db"), "frontend": ("ui", "http"), "fullstack_monorepo": ("http", "db", "ui", "worker"), "ml_system": ("ai", "http"), "cli": ("cli",), "library": (),
    "event_driven": ("event", "worker", "db"), "infra": ("docker", "ci"), "data_pipeline": ("event", "worker", "db"), "unknown": ANALYZERS,
}
EVIDENCE = {
    "db": (DATABASE, ("database",), ()), "worker": (("Celery",), ("queue_sdk", "event_edges"), ()), "event": (("Celery",), ("queue_sdk", "event_edges"), ()), "ui": (FAMILIES["frontend"], (), ()),
    "ai": (FAMILIES["ml_system"], ("external_llm", "tool_definitions"), ("ml_system",)), "docker": ((), ("infra_files",), ()), "ci": ((), ("ci_files",), ()), "cli": ((), ("console_scripts",), ("cli",)),
}
NEVER = {"library": ("http", "ui", "worker", "event"), "cli": ("http", "ui"), "infra": ("http", "db", "ui", "worker", "event", "cli", "ai")}


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def package_frameworks(packages: DataFrame) -> DataFrame:
    """(repo_id, name, declared) of (repo_id, package, declared): declared by a manifest if any package says so.

    A declared package counts if it is the name, starts with it before / or -, or
    ends with it after -; an imported one if it is the name, or has it as a segment.
    """
    known = packages.sparkSession.createDataFrame([(k, v, k in LOOSE) for k, v in FRAMEWORKS.items()], "key string, name string, loose boolean")
    p = F.lower("package")
    listed = (p == F.col("key")) | p.startswith(F.concat("key", F.lit("/"))) | p.startswith(F.concat("key", F.lit("-"))) | p.endswith(F.concat(F.lit("-"), "key")) | (F.col("loose") & p.contains(F.col("key")))
    imported = (p == F.col("key")) | p.startswith(F.concat("key", F.lit("/"))) | p.contains(F.concat(F.lit("/"), "key"))
    met = packages.select("repo_id", "package", "declared").distinct().join(F.broadcast(known), (F.col("declared") & listed) | (~F.col("declared") & imported))
    return met.groupBy("repo_id", "name").agg(F.bool_or("declared").alias("declared"))


def file_facts(files: DataFrame) -> DataFrame:
    """Counts of (repo_id, path, text) that a path or a text shows, and the area folders, a row a repository."""
    p = normalize_path(F.col("path"))
    folder, name = parent_prefix(F.col("path")), base_name(p)
    many = lambda cond, alias: F.count_if(cond).alias(alias)
    areas = F.filter(F.split(F.lower(folder), "/"), lambda x: x.isin(*[a for _, names in AREAS.values() for a in names]))
    return files.groupBy("repo_id").agg(
        many(folder.rlike(r"^(apps/api|backend)(/|$)"), "api_folders"),
        many(folder.rlike(r"^(apps/web|app|src/app)(/|$)"), "web_folders"),
        many(p.rlike(r"\.pyi?$"), "python_files"),
        many(p.rlike(r"\.([mc]?js|jsx|[mc]?ts|tsx)$"), "script_files"),
        many(F.col("text").rlike(TOOL), "tools"),
        many(is_infra(F.col("path")), "infra_files"),
        many(is_ci(F.col("path")), "ci_files"),
        F.count("*").alias("files"),
        many(name.isin(*EXPORTS), "exports"),
        F.array_distinct(F.flatten(F.collect_set(areas))).alias("areas"),
    )


def entry_facts(entries: DataFrame) -> DataFrame:
    """Counts of (repo_id, path, kind) entry points; an App Router route is no application of its own."""
    routed = F.col("path").rlike(r"(^|/)route\.(ts|js|tsx)$")
    kinds = {"http_entries": (F.col("kind") == "http_app") & ~routed, "page_entries": F.col("kind") == "page", "next_entries": routed, "worker_entries": F.col("kind") == "worker", "cli_entries": F.col("kind") == "cli"}
    return entries.groupBy("repo_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def _rule_rows(rules: tuple[tuple[str, str, float, str], ...]) -> Column:
    return F.array(*[F.when(F.expr(cond), F.struct(F.lit(style).alias("style"), F.lit(name).alias("detector"), F.lit(w).alias("weight"))) for name, style, w, cond in rules])


def style_signals(facts: DataFrame, frameworks: DataFrame, externals: DataFrame) -> DataFrame:
    """(repo_id, style, detector, weight) of every detector that fires.

    ``facts``: repo_id, any of COUNTS (absent: 0) and ``areas``. ``frameworks``: as of
    ``package_frameworks``. ``externals``: (repo_id, name, kind).
    """
    spark = facts.sparkSession
    wide = facts.select("repo_id", *[(F.coalesce(F.col(c), F.lit(0)) if c in facts.columns else F.lit(0)).alias(c) for c in COUNTS], (F.coalesce("areas", F.array()) if "areas" in facts.columns else F.array()).cast("array<string>").alias("areas"))
    rows = wide.select("repo_id", F.explode(F.array_compact(_rule_rows(SIGNALS))).alias("s")).select("repo_id", "s.*")
    family = [(f, style) for style, names in FAMILIES.items() for f in names] + [(f, "backend_api") for f in DATABASE]
    met = frameworks.join(F.broadcast(spark.createDataFrame(family, "name string, style string")), "name")
    weight = F.when(F.col("name").isin(*DATABASE), 0.0).when(F.col("name") == "React", REACT).when(F.col("declared"), DECLARED).otherwise(IMPORTED)
    rows = rows.unionByName(met.select("repo_id", "style", F.when(F.col("name").isin(*DATABASE), "database").otherwise("framework").alias("detector"), weight.alias("weight")))
    area = spark.createDataFrame([(a, style, w) for style, (w, names) in AREAS.items() for a in names], "area string, style string, weight double")
    rows = rows.unionByName(wide.select("repo_id", F.explode("areas").alias("area")).distinct().join(F.broadcast(area), "area").select("repo_id", "style", F.lit("area").alias("detector"), "weight"))
    of_kind = spark.createDataFrame([("llm", "ml_system", "external_llm", 2.0), ("queue", "event_driven", "queue_sdk", 1.0), ("database", "backend_api", "database", 0.0)], "kind string, style string, detector string, weight double")
    rows = rows.unionByName(externals.select("repo_id", "name", "kind").distinct().join(F.broadcast(of_kind), "kind").select("repo_id", "style", "detector", "weight"))
    # A package without an application of its own is a library.
    strong = rows.where(F.col("style").isin("backend_api", "frontend", "event_driven")).groupBy("repo_id", "style").agg(F.sum("weight").alias("w")).where("w >= 1")
    plain = wide.where(~F.expr(APPLICATION)).join(strong.select("repo_id").distinct(), "repo_id", "left_anti")
    return rows.unionByName(plain.select("repo_id", F.explode(F.array_compact(_rule_rows(LIBRARY))).alias("s")).select("repo_id", "s.*"))


def decide_style(scores: DataFrame) -> DataFrame:
    """(repo_id, style, reason, confidence) from (repo_id, style, score): the first of DECISIONS whose terms hold, else the highest score from LEAST_SCORE on, else unknown."""
    wide = scores.groupBy("repo_id").agg(*[F.coalesce(F.sum(F.when(F.col("style") == s, F.col("score"))), F.lit(0.0)).alias(s) for s in STYLES])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(s)).alias("v"), F.lit(s).alias("style")) for s in STYLES]))
    wide = wide.withColumn("ranked", ranked).withColumn("best", -F.col("ranked")[0]["v"])
    options = [F.when(F.expr(terms.replace(",", " and ")), F.struct(F.lit(style).alias("style"), F.lit(reason).alias("reason"))) for style, reason, terms in DECISIONS]
    highest = F.when(F.col("best") >= LEAST_SCORE, F.struct(F.col("ranked")[0]["style"].alias("style"), F.lit("highest_score").alias("reason")))
    rows = wide.withColumn("d", F.coalesce(*options, highest, F.struct(F.lit("unknown").alias("style"), F.lit("weak_evidence").alias("reason"))))
    own = -F.aggregate("ranked", F.lit(0.0), lambda a, x: F.when(x["style"] == F.col("d.style"), x["v"]).otherwise(a))
    rival = F.aggregate("ranked", F.lit(0.0), lambda a, x: F.when(x["style"] == F.col("d.style"), a).otherwise(F.greatest(a, -x["v"])))
    level = F.when(F.col("d.style") == "unknown", 0.2).when(rival <= 0, F.least(F.lit(0.9), 0.55 + own / 20)).otherwise(F.least(F.lit(0.97), F.greatest(F.lit(0.45), own / (own + rival))))
    return rows.select("repo_id", "d.style", "d.reason", F.round(level, 3).alias("confidence"))


def select_analyzers(profiles: DataFrame) -> DataFrame:
    """Analyzers of (repo_id, style, confidence, frameworks array, detectors array), in catalogue order; unknown or unsure profiles keep all."""
    base = F.coalesce(*[F.when(F.col("style") == k, _strings(v)) for k, v in STYLE_ANALYZERS.items()])
    chosen = F.when((F.col("style") == "unknown") | (F.col("confidence") < UNSURE), _strings(ANALYZERS)).otherwise(base)
    added = [F.when(F.arrays_overlap("frameworks", _strings(names)) | F.arrays_overlap("detectors", _strings(seen)) | F.col("style").isin(*styles, ""), F.lit(a)) for a, (names, seen, styles) in EVIDENCE.items()]
    added.append(F.when(F.arrays_overlap("frameworks", _strings(FAMILIES["backend_api"])) & ~F.col("style").isin(*NEVER), F.lit("http")))
    barred = F.coalesce(*[F.when(F.col("style") == k, _strings(v)) for k, v in NEVER.items()], _strings(()))
    with_all = F.when(F.col("style") == "infra", _strings(("docker", "ci"))).otherwise(F.concat(chosen, F.array_compact(F.array(*added))))
    return profiles.select("repo_id", F.filter(_strings(ANALYZERS), lambda x: F.array_contains(with_all, x) & ~F.array_contains(barred, x)).alias("analyzers"))


def repository_profile(facts: DataFrame, frameworks: DataFrame, externals: DataFrame) -> DataFrame:
    """(repo_id, style, reason, confidence, frameworks, detectors, analyzers) of every repository in ``facts``."""
    signals = style_signals(facts, frameworks, externals)
    scores = facts.select("repo_id", F.lit("unknown").alias("style"), F.lit(0.0).alias("score")).unionByName(signals.groupBy("repo_id", "style").agg(F.sum("weight").alias("score")))
    seen = signals.groupBy("repo_id").agg(F.array_sort(F.collect_set("detector")).alias("detectors"))
    named = frameworks.groupBy("repo_id").agg(F.array_sort(F.collect_set("name")).alias("frameworks"))
    rows = decide_style(scores).join(named, "repo_id", "left").join(seen, "repo_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("frameworks", "detectors")})
    return rows.join(select_analyzers(rows), "repo_id")
