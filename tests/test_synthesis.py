import pytest
from pyspark.sql import functions as F

from tessera.operators import planning, profile
from tessera.operators import synthesis as s


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


@pytest.mark.parametrize(
    ("scores", "style", "confidence"),
    [
        ({"backend_api": 6.0, "event_driven": 2.0}, "backend_api", 0.75),
        ({"backend_api": 3.0, "frontend": 3.0}, "fullstack_monorepo", 0.45),
        ({"event_driven": 3.5}, "event_driven", 0.725),
        ({"cli": 5.5}, "cli", 0.825),
        ({"library": 3.5}, "library", 0.725),
        ({"ml_system": 4.0, "backend_api": 3.0}, "ml_system", 0.571),
        ({"infra": 4.5}, "infra", 0.775),
        ({"frontend": 2.0}, "unknown", 0.2),
        ({"frontend": 2.5}, "frontend", 0.675),
    ],
)
def test_styles(spark, scores, style, confidence):
    df = spark.createDataFrame([(1, k, v) for k, v in scores.items()], "repo_id int, style string, score double")
    assert rows(profile.decide_style(df), "repo_id", "style", "confidence") == [(1, style, confidence)]


def test_analyzers(spark):
    df = spark.createDataFrame([(1, "library", 0.7, ["SQLAlchemy", "FastAPI"], []), (2, "unknown", 0.2, [], []), (3, "cli", 0.8, [], ["external_llm"])], "repo_id int, style string, confidence double, frameworks array<string>, detectors array<string>")
    assert rows(profile.select_analyzers(df)) == [(1, ["db"]), (2, list(profile.ANALYZERS)), (3, ["cli", "ai"])]


def test_hierarchy_and_tree(spark):
    leaves = spark.createDataFrame([("a", "A", "apps/x", 1.0, 0.0), ("b", "B", "packages/y", 0.5, 0.5), ("c", "C", None, 0.0, 1.0)], "key string, name string, boundary string, cohesion double, coupling double")
    tree = s.module_hierarchy(leaves)
    assert rows(tree, "key", "kind", "parent_key") == [("a", "module", "service:apps-x"), ("application", "application", None), ("b", "module", "service:packages-y"), ("c", "module", "application"), ("service:apps-x", "service", "application"), ("service:packages-y", "service", "application")]
    assert dict(rows(s.module_tree(tree)))["application"] == ["c", "service:apps-x", "service:packages-y"]
    assert {r[2] for r in rows(s.module_hierarchy(leaves.where("key = 'a'")), "key", "kind", "parent_key")} == {None, "application"}


def test_features_cross_modules_and_events(spark):
    edges = spark.createDataFrame([("route", "svc", "calls", 0.9, None), ("svc", "core", "calls", 0.8, None), ("core", None, "emits", 0.3, "saved"), ("mail", None, "subscribes", 0.3, "saved"), ("lone", "lone2", "calls", 0.9, None)], "src_id string, dst_id string, kind string, confidence double, dst_name string")
    symbols = spark.createDataFrame([(x, f"{d}/{x}.py") for x, d in (("route", "api"), ("svc", "svc"), ("core", "core"), ("mail", "mail"), ("lone", "z"), ("lone2", "z"))], "symbol_id string, path string")
    member = symbols.select(F.col("path").alias("id"), F.split("path", "/")[0].alias("cluster"))
    seeds = spark.createDataFrame([("f", "route"), ("g", "lone")], "seed string, symbol_id string")
    assert rows(s.features(edges, seeds, symbols, member)) == [("f", 4, 4, 4, 4, 0.45)]


def test_handlers_members_usage(spark):
    symbols = spark.createDataFrame([("a.py", 1, "X", "class", 1), ("a.py", 2, "f", "function", 5), ("a.py", 3, "g", "function", 9), ("b.py", 4, "Y", "class", 1)], "path string, symbol_id int, name string, kind string, start_line int")
    want = spark.createDataFrame([("r1", "a.py", "g"), ("r2", "a.py", None), ("r3", "b.py", "zzz")], "ref string, path string, preferred string")
    assert rows(s.pick_handlers(want, symbols)) == [("r1", 3), ("r2", 2), ("r3", 4)]
    assert rows(s.component_members(symbols, "lib")) == [("a.py", 3, 1), ("b.py", 1, 1)]
    use = spark.createDataFrame([(1, 5, None, 7), (1, None, 2, None)], "run int, input_tokens long, output_tokens long, total_tokens long")
    assert rows(s.usage_totals(use, ["run"])) == [(1, 5, 2, 7)]


def test_flows_by_title(spark):
    edges = spark.createDataFrame([("x", "y", "calls", 0.9)], "src_id string, dst_id string, kind string, confidence double")
    seeds = spark.createDataFrame([("1", "Login ", 1, "x"), ("2", "login", 2, "y"), ("3", " ", 0, "x"), ("4", "Jobs", 3, None)], "seed string, title string, priority int, symbol_id string")
    flows, steps = s.seed_flows(seeds, edges)
    assert [r[0] for r in rows(flows, "seed")] == ["1", "4"] and rows(steps, "seed", "dst_id") == [("1", "y")]


def test_pull_request_pages(spark):
    raw = '{"nodes": [{"number": 3, "title": "t", "mergedAt": "2024-01-02T03:04:05Z", "mergeCommit": {"oid": "abc"}, "author": null, "closingIssuesReferences": {"nodes": [{"number": 9}, null]}}, {"title": "no number"}, null]}'
    got = s.parse_pull_requests(spark.createDataFrame([(raw,)], "raw string")).collect()
    assert len(got) == 1 and (got[0]["number"], got[0]["merge_commit_sha"], got[0]["author_login"], got[0]["issue_refs"]) == (3, "abc", None, [9])


def test_config():
    assert s.review_config(None) == s.review_config("- a") == s.review_config(": :\n\t- {") == s.ReviewConfig()
    c = s.review_config("enabled: 'yes'\nmin_confidence: 7\nmax_comments: -3\nchecks: {duplicate: off, who: true}\nx: 1")
    assert (c.enabled, c.min_confidence, c.max_comments, c.off()) == (True, 1.0, 0, ("duplicate",))
    assert s.review_config("enabled: false").off() == s.CHECKS and s.review_config("min_confidence: .nan").min_confidence == 0.75


def test_review_end_to_end(spark):
    patches = spark.createDataFrame([("core.py", "@@ -1,2 +1,3 @@\n+def core(x, y):\n+    print(x)\n pass")], "path string, patch string")
    symbols = spark.createDataFrame([("c", "core", "core.py", "function", 1, 9), ("r", "route", "api/routes/r.py", "function", 1, 9)], "symbol_id string, name string, path string, kind string, start_line int, end_line int")
    edges = spark.createDataFrame([("r", "c", "calls", 0.9)], "src_id string, dst_id string, kind string, confidence double")
    hits = spark.createDataFrame([("core.py:core:1", "other.py"), ("core.py:core:1", "./core.py")], "candidate_id string, path string")
    verdicts = spark.createDataFrame([("core.py:core:1", '{"flag": true, "confidence": 0.8, "reason": "same"}'), ("core.py:print()", '{"flag": false, "confidence": 1}')], "candidate_id string, raw string")
    got = rows(s.review_core(s.ReviewConfig(), patches, symbols, edges, hits, verdicts), "rank", "check", "confidence")
    assert got == [(1, "blast_radius", 0.9), (2, "duplicate", 0.8)]


def test_pages_and_gate(spark):
    files = "files array<string>"
    modules = spark.createDataFrame([("m1", "Billing", "Bills.", ["a.py"]), ("m2", "Auth", "Auths.", ["gone.py"])], f"id string, name string, summary string, {files}")
    feats = spark.createDataFrame([("f1", "Login", "Logs in.", ["a.py"])], f"id string, name string, summary string, {files}")
    ends = spark.createDataFrame([("GET", "/x", "a.py")], "method string, route string, file_path string")
    plan = spark.createDataFrame([("api", True), ("execution_flows", False)], "key string, enabled boolean")
    pages = s.assemble_pages(spark.createDataFrame([("Hello",)], "body string"), modules, feats, ends, plan)
    assert [r[0] for r in rows(pages, "slug")] == ["api", "architecture", "diagram/architecture", "module-auth", "module-billing", "overview"]
    more = spark.createDataFrame([(k, True) for k in ("data", "security", "testing", "deploy", "public_api", "execution_flows")], "key string, enabled boolean")
    guarded = ends.withColumn("auth_hint", F.lit("session"))
    every = {r["slug"]: r for r in s.assemble_pages(spark.createDataFrame([("Hello",)], "body string"), modules, feats, guarded, more, "a library").collect()}
    assert set(every) == {"architecture", "data", "deploy", "diagram/architecture", "feature-login", "module-auth", "module-billing", "overview", "public-api", "security", "testing"}
    assert every["security"]["body"] == "GET /x" and every["data"]["body"] == "No data facts were found." and every["public-api"]["body"].endswith("profile is a library.")
    checks = s.validate_pages(pages, spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([("module:m1",), ("module:m2",)], "ref string"))
    assert rows(checks.where("not ok"), "slug", "ref") == [("architecture", "gone.py"), ("module-auth", "gone.py"), ("overview", "gone.py")]


def test_narrative_of_facts(spark):
    facts = spark.createDataFrame([(["Python", "TypeScript"], ["FastAPI"])], "languages array<string>, frameworks array<string>")
    folders = spark.createDataFrame([(1, "apps/api"), (2, "tests"), (3, "packages/core"), (4, "apps/api/routes")], "pos int, folder string")
    ends = spark.createDataFrame([(1, "GET", "/x")], "pos int, method string, route string")
    none = spark.createDataFrame([], "name string")
    got = s.narrative(facts, folders, ends, none)
    assert rows(got["summary"]) == [("This is a Python / TypeScript repository using FastAPI.",)]
    assert [r["name"] for r in got["domains"].collect()] == ["API", "Core", "API routes"] and [r["layer"] for r in got["layers"].collect()] == ["api", "lib"]
    assert [r["question"] for r in got["questions"].collect()][2:] == ["How does a request get handled?", "What does GET /x do?", "If I change a central module, what breaks?"]
    assert s.component_of(" api:Billing ") == ("api", "Billing") and s.component_of("api") == ("api", None) == s.component_of("api:")


def test_profiles_of_repositories(spark):
    facts = spark.createDataFrame(
        [(1, 1, 0, 0, 0, 1, 0, 1, [], 3), (2, 0, 0, 0, 3, 0, 0, 1, [], 3), (3, 0, 0, 1, 0, 0, 0, 1, [], 2), (4, 0, 0, 0, 0, 0, 0, 1, ["prompts"], 2), (5, 0, 0, 0, 0, 0, 0, 1, [], 2), (6, 0, 0, 0, 0, 0, 0, 0, [], 0), (7, 0, 1, 0, 0, 0, 0, 1, [], 2), (8, 0, 0, 0, 0, 0, 3, 0, [], 3)],
        "repo_id int, http_entries int, page_entries int, worker_entries int, scripts int, endpoints int, infra_files int, manifests int, areas array<string>, files int",
    )
    packages = spark.createDataFrame([(1, "FastAPI", True), (1, "sqlalchemy-utils", True), (2, "click", True), (3, "celery", True), (4, "langchain/tools", False), (7, "next", True), (7, "react-dom", True), (4, "my/langchain", False)], "repo_id int, package string, declared boolean")
    frames = profile.package_frameworks(packages)
    assert ("SQLAlchemy", True) in rows(frames.where("repo_id = 1"), "name", "declared")
    none = spark.createDataFrame([(4, "OpenAI", "llm")], "repo_id int, name string, kind string")
    got = {r["repo_id"]: r for r in profile.repository_profile(facts, frames, none).collect()}
    assert {k: r["style"] for k, r in got.items()} == {1: "backend_api", 2: "cli", 3: "event_driven", 4: "ml_system", 5: "library", 6: "unknown", 7: "frontend", 8: "infra"}
    assert got[1]["analyzers"] == ["http", "db"] and got[2]["analyzers"] == ["cli"] and got[3]["analyzers"] == ["db", "worker", "event"] and "ai" in got[4]["analyzers"]
    assert got[5]["analyzers"] == [] and got[6]["analyzers"] == list(profile.ANALYZERS) and got[8]["analyzers"] == ["docker", "ci"] and got[7]["analyzers"] == ["http", "ui"]
    files = spark.createDataFrame([(1, "apps/api/main.py", "x"), (1, "apps/web/a.tsx", "@tool"), (1, "Dockerfile", ""), (1, ".github/workflows/c.yml", ""), (1, "prompts/__init__.py", None)], "repo_id int, path string, text string")
    f = profile.file_facts(files).collect()[0]
    assert (f["api_folders"], f["web_folders"], f["python_files"], f["script_files"], f["tools"], f["infra_files"], f["ci_files"], f["files"], f["exports"], f["areas"]) == (1, 1, 2, 1, 1, 1, 1, 5, 1, ["prompts"])
    entries = spark.createDataFrame([(1, "app/api/route.ts", "http_app"), (1, "main.py", "http_app")], "repo_id int, path string, kind string")
    assert rows(profile.entry_facts(entries), "http_entries", "next_entries") == [(1, 1)]


def test_narrative_and_grounding(spark):
    drafts = spark.createDataFrame([(1, "A", "", ["./src", "no"]), (2, "A", "w", ["src"]), (3, "B", None, ["no"]), (4, " ", None, ["src"])], "pos int, name string, why string, folders array<string>")
    assert rows(s.sanitize_domains(drafts, spark.createDataFrame([("src",)], "folder string"))) == [(1, "A", ["src"], "Code under src")]
    texts = spark.createDataFrame([(1, "see src/a.py and src/b.py")], "id int, text string")
    assert rows(s.ungrounded_paths(texts, spark.createDataFrame([("src/a.py",)], "path string"))) == [(1, "src/b.py")]
    member = spark.createDataFrame([("apps/x/a.py", "1"), ("apps/x/b.py", "1"), ("apps/y/c.py", "2"), ("lib/d.py", "2")], "id string, cluster string")
    assert rows(s.boundary(member)) == [("1", "apps/x"), ("2", None)]


def test_summaries(spark):
    from tessera.operators import summaries

    hops = spark.createDataFrame([("f", 1, "a", "b", 0.9), ("f", 2, "b", "c", 0.3)], "id string, step int, src string, dst string, confidence double")
    feats = spark.createDataFrame([("f", "Login", "a.py", ["Core", "Web"], "calls"), ("g", "Lone", None, [], "calls")], "id string, name string, entry_file string, modules array<string>, resolution string")
    got = dict(rows(summaries.feature_summaries(feats, hops)))
    assert got["f"] == "Login starts in a.py. Confirmed steps (calls): a → b. Inferred steps: b → c. Touches Core, Web."
    assert got["g"] == "Lone starts. Confirmed steps (calls): none. Inferred steps: none. Touches no other module."
    kids = spark.createDataFrame([(1, "Core", "Does it. Well."), (2, "Web", None)], "pos int, name string, summary string")
    named = spark.createDataFrame([(1, "Login")], "pos int, name string")
    assert rows(summaries.overview_summary(kids, named, "library")) == [("This library is explained from its modules — Core: Does it; Web. Cross-cutting features: Login.",)]
    assert rows(summaries.overview_summary(kids.where("false"), named.where("false"), "cli")) == [("This cli does not have responsibility modules yet.",)]
    found = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "target string, content_sha string")
    stored = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "1", " ")], "target string, content_sha string, summary string")
    assert rows(summaries.unchanged(found, stored)) == [("a", "1")]
    q = planning.question_set(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "pos int, name string"), named)
    assert [r["question"] for r in q.orderBy("pos").collect()][1:] == ["How does Login work, and which modules does it cross?", "What is A responsible for?", "What is B responsible for?", "What is C responsible for?"]
