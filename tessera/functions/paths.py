"""Path rules as column expressions: categories, layers, domains, modules, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that classify a path.
TEST = r"(^|/)(tests?|__tests__)(/|$)|(^|/)test_|_test\.|\.test\.|\.spec\."
ROUTE = r"(^|/)(routes?|api|controllers?|endpoints?|handlers?)(/|$)|/webhooks?"
WORKER = r"(^|/)(workers?|tasks?|jobs?|queue|celery|ingest)(/|$)"
CRON = r"cron|schedule|scheduler|periodic"
SKIP_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".next", "dist", "build", "coverage", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "vendor", "third_party")
SOURCE_SUFFIXES = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
MANIFEST = r"^(package(-lock)?\.json|requirements(-dev)?\.txt|go\.mod|Cargo\.toml|Gemfile|composer\.json|Pipfile|\.env\.(example|sample|template)|.*\.toml)$"
INFRA = r"(^|/)(dockerfile(\.[^/]*)?|(docker-)?compose\.ya?ml)$|(^(deploy|k8s|kubernetes)|/(k8s|kubernetes))/.*\.ya?ml$"
CI = r"(^|/)\.github/workflows/.*\.ya?ml$"
NOT_EMBEDDED = r"\.lock$|\.min\.(js|css)$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock)$"
WORKSPACES = ("apps", "packages", "services", "libs")


def slashed(path: Column) -> Column:
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def normalize_path(path: Column) -> Column:
    """Forward slashes, without leading dots and slashes (any run of either)."""
    return F.regexp_replace(slashed(path), r"^[./]+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def categorize_path(path: Column, name: Column | None = None) -> Column:
    """tests, cron, workers, routes or other; the first that applies."""
    p, n = F.lower(slashed(path)), F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    return F.when(p.rlike(TEST) | n.startswith("test_"), "tests").when(p.rlike(CRON) | n.rlike(CRON), "cron").when(p.rlike(WORKER), "workers").when(p.rlike(ROUTE), "routes").otherwise("other")


# What the first pattern that finds something in a normalised path says of it. Layers go by the lower-cased path; a domain is a label, or the segment (from the end if negative) that names it.
LAYERS = (
    (r"(^|/)(tests?|__tests__)(/|$)|(^|/)test_[^/]*$|\.(test|spec)\.[^/]*$", "test"),
    (r"alembic/|migrations/", "data"),
    (r"^(?!(packages|libs)/)(.*/)?models(\.py|/|$)", "data"),
    (r"^(?=(.*/)?app/)((.*/)?api(/|$)|.*/route\.[jt]s$)", "api"),
    (r"(^|/)app/|^components/|^pages/|^src/components", "web"),
    (r"^(?!apps/api).*(apps/web|frontend/|src/pages)", "web"),
    (r"^(?!.*node_modules).*(apps/worker|/workers?/|celery|/jobs/|/tasks/)", "worker"),
    (r"apps/api|backend/|/routes/|/controllers/|webhooks", "api"),
    (r"", "lib"),
)
DOMAINS = (
    ("(?i)" + LAYERS[0][0], "Tests"),
    (r"(?i)alembic|(^|/)migrations(/|$)", "Migrations"),
    (r"^(?=(.*/)?app/)(.*/)?api(/|$)", "API"),
    (r"(^|/)app/|^components/|^pages/", "Web"),
    (r"(?i)^(?=.*apps/worker|(.*/)?worker(/|$))(.*/)?(bot|ingest)(/|$)", -2),
    (r"(?i)apps/worker|(^|/)worker(/|$)", "Worker"),
    (r"(?i)(^|/)bot(/|$)|/pr_review", "Review bot"),
    (r"(?i)(^|/)agent(/|$)", "Agent"),
    (r"(?i)(^|/)routes(/|$)", "API routes"),
    (r"(?i)apps/api|^backend/", "API"),
    (r"^(packages|apps|src)/+[^/]", 2),
    (r"", 1),
)


def sql_string(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match(subject: str, rules: tuple[tuple[str, str | int], ...], named: str = "") -> str:
    """SQL for the value of the first rule whose pattern is found in ``subject``; a number stands for ``named`` with that number in place of ``{}``."""
    return "case " + " ".join(f"when {subject} rlike {sql_string(pattern)} then {sql_string(value) if isinstance(value, str) else named.format(value)}" for pattern, value in rules) + " end"


def layer_sql(lower_path: str) -> str:
    """SQL of the layer of a normalised lower-case path, from the same rules as ``assign_layer``."""
    return first_match(lower_path, LAYERS)


def domain_sql(path: str) -> str:
    """SQL of the domain of a normalised path, from the same rules as ``assign_domain``."""
    words = f"trim(translate(coalesce(try_element_at(filter(split({path}, '/'), x -> x <> ''), {{0}}), ''), '-_', '  '))"
    return first_match(path, DOMAINS, f"if({words} = '', 'Root', concat(upper(substr({words}, 1, 1)), substr({words}, 2)))")


def assign_layer(path: Column) -> Column:
    """test, data, api, web, worker or lib, by ordered rules on the normalised lower-case path."""
    return _by_rules(F.lower(normalize_path(path)), LAYERS)


def titled(part: Column) -> Column:
    """Dashes and underscores as spaces, first letter upper-case."""
    words = F.trim(F.translate(part, "-_", "  "))
    return F.when(words == "", "Root").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))))


def _by_rules(subject: Column, rules: tuple[tuple[str, str | int], ...]) -> Column:
    """The value of the first rule whose pattern is found; a number names a segment."""
    parts = F.filter(F.split(subject, "/"), lambda x: x != "")
    out = None
    for pattern, value in rules:
        found = F.lit(value) if isinstance(value, str) else titled(F.coalesce(F.try_element_at(parts, F.lit(value)), F.lit("")))
        out = F.when(subject.rlike(pattern), found) if out is None else out.when(subject.rlike(pattern), found)
    return out


def assign_domain(path: Column) -> Column:
    """A label from the path's folders."""
    return _by_rules(normalize_path(path), DOMAINS)


def module_of(path: Column, depth: int) -> Column:
    """First ``depth`` segments; nothing is (root)."""
    parts = F.filter(F.split(slashed(path), "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, "(root)").otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def parent_prefix(path: Column) -> Column:
    """Parent folder, or ``.``."""
    p = F.regexp_replace(slashed(path), "^/+|/+$", "")
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(folder: Column) -> Column:
    """A folder, each folder above it, and ``.``; longest first."""
    parts = F.filter(F.split(slashed(folder), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array(F.lit("."))
    return F.when(F.size(parts) == 0, empty).otherwise(F.concat(F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))), empty))


def package_key(path: Column) -> Column:
    """Two segments below a workspace folder, else one."""
    parts = F.filter(F.split(slashed(path), "/"), lambda x: x != "")
    first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("(root)")), F.get(parts, F.lit(1))
    return F.when(first.isin(*WORKSPACES) & second.isNotNull(), F.concat_ws("/", first, second)).otherwise(first)


def is_infra(path: Column) -> Column:
    """Container and deployment files."""
    return F.lower(normalize_path(path)).rlike(INFRA)


def is_ci(path: Column) -> Column:
    """Workflow files of continuous integration; the folder's leading dot may be stripped."""
    return F.lower(slashed(path)).rlike(CI)


def is_embeddable(path: Column) -> Column:
    """Source suffixes, whatever the folder, without lock files and minified ones."""
    p = F.lower(slashed(path))
    ends = F.lit(False)
    for s in SOURCE_SUFFIXES:
        ends = ends | p.endswith(s)
    return ends & ~p.rlike(NOT_EMBEDDED)


def is_scanned(path: Column) -> Column:
    """Source, manifests, environment examples, infrastructure and workflows, outside skipped folders and nested clones."""
    skipped = F.arrays_overlap(F.split(parent_prefix(path), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS])) | slashed(path).rlike("^data/clones/")
    return (is_source(path) | base_name(slashed(path)).rlike(MANIFEST) | is_infra(path) | is_ci(path)) & ~skipped


def is_source(path: Column) -> Column:
    """Source suffix and no skipped folder above."""
    ends = F.lit(False)
    for s in SOURCE_SUFFIXES:
        ends = ends | path.endswith(s)
    return ends & ~F.arrays_overlap(F.split(parent_prefix(path), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def risk_level(total: Column, reached: Column) -> Column:
    """none; high from 15 on or where a route, worker or cron job is reached; medium from 5 on; else low."""
    return F.when(total == 0, "none").when(reached | (total >= 15), "high").when(total >= 5, "medium").otherwise("low")
