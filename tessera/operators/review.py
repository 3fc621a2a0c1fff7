"""Diff parsing, changed spans, findings and the review gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import normalize_path
from tessera.operators.graph import binned

# Raw calls that a repository usually wraps, the definition line of a function, and severities.
RAW_CALLS = (
    (r"\blogging\.getLogger\b", "logging.getLogger", "the repo's logging setup"),
    (r"^\s*print\(", "print()", "the repo's logger"),
    (r"\bexcept\s*:", "bare except:", "specific exception handling"),
    (r"\b(?:httpx|requests)\.(?:get|post|put|delete|patch|request)\(", "raw httpx/requests", "the repo's HTTP client wrapper"),
)
DEFINITION = r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+(\w+)|^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("
SEVERITY = {"warning": 2, "info": 1}
NOTABLE = ("cron", "routes", "tests", "workers")
MOST_BODY = 40
#: Lines of a bin in which added lines meet spans.
LINES = 64


def added_lines(patches: DataFrame) -> DataFrame:
    """(path, line, text) of added lines of unified diffs (path, patch); lines are counted within each hunk."""
    rows = patches.where("patch is not null and patch <> ''").select("path", F.posexplode(F.split(F.regexp_replace("patch", "\n$", ""), "\n")).alias("at", "raw"))
    start = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    by_file = Window.partitionBy("path").orderBy("at")
    rows = rows.withColumn("start", F.when(start != "", start.cast("int"))).withColumn("hunk", F.count("start").over(by_file)).where("hunk > 0")
    tag = F.substring("raw", 1, 1)
    grows = F.when(F.col("start").isNull() & ~tag.isin("-", "\\"), 1).otherwise(0)
    in_hunk = Window.partitionBy("path", "hunk").orderBy("at")
    line = F.first("start").over(in_hunk) + F.sum(grows).over(in_hunk) - 1
    return rows.withColumn("line", line).where(F.col("start").isNull() & (tag == "+")).select("path", "line", F.expr("substring(raw, 2)").alias("text"))


def changed_symbols(added: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols with an added line in their span, and whether their first line is one."""
    left = added.select(normalize_path(F.col("path")).alias("p"), "line", F.floor(F.col("line") / LINES).alias("bin"))
    spans = symbols.select("symbol_id", "path", "start_line", "end_line", normalize_path(F.col("path")).alias("p"), (F.col("end_line") + 1).alias("stop"))
    met = binned(spans, "start_line", "stop", LINES).join(left, ["p", "bin"]).where("line between start_line and end_line")
    return met.groupBy("symbol_id", "path").agg(F.bool_or(F.col("line") == F.col("start_line")).alias("is_signature_change"), F.count("*").alias("lines"))


def line_islands(added: DataFrame) -> DataFrame:
    """Runs of consecutive added lines."""
    run = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return added.withColumn("run", run).groupBy("path", "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines")).drop("run")


def added_functions(added: DataFrame) -> DataFrame:
    """(path, name, line, source): each added definition with the added lines that follow it without a gap, up to the next or MOST_BODY."""
    by_file = Window.partitionBy("path").orderBy("line")
    name = F.coalesce(F.nullif(F.regexp_extract("text", DEFINITION, 1), F.lit("")), F.nullif(F.regexp_extract("text", DEFINITION, 2), F.lit("")))
    rows = added.withColumn("name", name).withColumn("run", F.col("line") - F.row_number().over(by_file))
    rows = rows.withColumn("head", F.count("name").over(Window.partitionBy("path", "run").orderBy("line"))).where("head > 0")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "run", "head").orderBy("line"))).where(F.col("n") <= MOST_BODY)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("path", "run", "head").agg(F.min_by("name", "line").alias("name"), F.min("line").alias("line"), body.alias("source")).drop("run", "head")


def raw_calls(added: DataFrame, patterns: tuple = RAW_CALLS) -> DataFrame:
    """First added line of each (path, raw API)."""
    catalogue = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("raw_call"), F.lit(w).alias("wrapper")) for p, n, w in patterns])
    met = added.select("path", "line", "text", F.trim("text").alias("snippet"), F.explode(catalogue).alias("c")).where(F.expr("text rlike c.p"))
    return met.groupBy("path", "c.raw_call", "c.wrapper").agg(F.min("line").alias("line"), F.min_by("snippet", "line").alias("snippet"))


def blast_findings(changed: DataFrame, impact: DataFrame) -> DataFrame:
    """A finding for each changed signature with callers: warning where a notable category is reached."""
    sums = impact.groupBy(F.col("seed").alias("symbol_id")).agg(F.count("*").alias("total"), F.max("min_confidence").alias("confidence"), F.count_if(F.col("category").isin(*NOTABLE)).alias("notable"))
    met = changed.where("is_signature_change").join(sums, "symbol_id")
    return met.select(F.lit("blast_radius").alias("check"), F.when(F.col("notable") > 0, "warning").otherwise("info").alias("severity"), F.round("confidence", 3).alias("confidence"), "path", "symbol_id", "total", "notable")


def threshold_gate(findings: DataFrame, min_confidence: float = 0.75, most: int = 10, disabled: tuple[str, ...] = (), key: str = "pr_id") -> DataFrame:
    """Enabled findings of enough confidence, by severity then confidence, at most ``most`` (below zero: all) a review; ties by id."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITY.items()], F.lit(0))
    kept = findings.where(~F.col("check").isin(*disabled) & (F.col("confidence") >= min_confidence))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(weight.desc(), F.desc("confidence"), "finding_id")))
    return kept.where(F.col("rank") <= most) if most >= 0 else kept


def parse_verdicts(verdicts: DataFrame) -> DataFrame:
    """(candidate_id, flagged, confidence, reason) of raw JSON, fenced or not; clamped, zero where not flagged or unreadable."""
    body = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "flag boolean, confidence double, reason string")
    flag = F.coalesce(got["flag"], F.lit(False))
    conf = F.when(flag, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["confidence"], F.lit(0.0))))).otherwise(0.0)
    return verdicts.select("candidate_id", flag.alias("flagged"), F.round(conf, 3).alias("confidence"), F.coalesce(F.substring(F.trim(got["reason"]), 1, 300), F.lit("unparseable verdict")).alias("reason"))


def judged_findings(candidates: DataFrame, verdicts: DataFrame, check: str, severity: str = "warning") -> DataFrame:
    """Findings of flagged candidates (candidate_id, path, line)."""
    met = candidates.join(parse_verdicts(verdicts).where("flagged"), "candidate_id")
    return met.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "confidence", "path", "line", F.col("reason").alias("message"), F.col("candidate_id").alias("finding_id"))


def verify_citations(answers: DataFrame, line_counts: DataFrame) -> DataFrame:
    """(answer_id, path, start_line, end_line) of citations whose file exists and has the first line; ends swapped and clipped; distinct."""
    from tessera.functions.text import CITATION

    token = F.explode(F.regexp_extract_all("answer", F.lit(r"(\[\[[^\[\]]*\]\])"), F.lit(1)))
    rows = answers.select("answer_id", token.alias("t")).where(F.col("t").rlike(CITATION))
    a = F.regexp_extract("t", CITATION, 2).cast("long")
    b = F.coalesce(F.nullif(F.regexp_extract("t", CITATION, 3), F.lit("")).cast("long"), a)
    rows = rows.select("answer_id", F.regexp_extract("t", CITATION, 1).alias("path"), F.least(a, b).alias("start_line"), F.greatest(a, b).alias("end_line"))
    met = rows.join(line_counts, "path").where(F.col("start_line") <= F.col("total_lines"))
    return met.select("answer_id", "path", "start_line", F.least("end_line", "total_lines").alias("end_line")).distinct()


def dismissal_rate(reviews: DataFrame, limit: int = 50) -> DataFrame:
    """Dismissed share of the posted among the newest ``limit`` reviews; null if none was posted."""
    newest = reviews.orderBy(F.desc("created_at"), F.desc("review_id")).limit(limit)
    posted = F.count_if(F.col("posted"))
    return newest.agg(F.count("*").alias("reviews"), posted.alias("posted"), (F.count_if(F.col("posted") & F.col("dismissed")) / F.nullif(posted, F.lit(0))).alias("dismissal_rate"))


def eligible(pulls: DataFrame, actions: tuple[str, ...] = ("opened", "reopened", "synchronize", "ready_for_review")) -> DataFrame:
    return pulls.where(F.col("action").isin(*actions) & ~F.coalesce("draft", F.lit(False)) & (F.lower(F.coalesce("author_type", F.lit(""))) != "bot"))


def render_review(findings: DataFrame, key: str = "pr_id") -> DataFrame:
    line = F.format_string("- **%s** `%s:%d` %s (%.2f)", "severity", "path", "line", "message", "confidence")
    return findings.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))


def outside_paths(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """Hits (path, ...) in files that aren't among the changed ones (path), however either writes its paths."""
    return hits.withColumn("_at", normalize_path(F.col("path"))).join(changed.select(normalize_path(F.col("path")).alias("_at")), "_at", "left_anti").drop("_at")
