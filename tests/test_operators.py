"""Scenarios on small literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, extract, graph, incremental, ownership, planning, retrieval, review, vectorindex


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


NODES = "symbol_id string, name string, path string, kind string, start_line int, start_byte int, end_byte int"
EDGES = "src_id string, dst_id string, kind string, confidence double"


def symbols(spark, *items):
    return spark.createDataFrame([(i, n, p, "function", 1, 0, 10) for i, n, p in items], NODES)


def test_ownership_halves_in_ninety_days(spark):
    data = [("src/a.py", 1, 100, 0, "2024-01-01"), ("src/b.py", 2, 100, 0, "2023-10-03"), ("src/c.py", None, 9, 9, "2024-01-01")]
    df = spark.createDataFrame(data, "path string, author_id int, additions int, deletions int, at string").withColumn("committed_at", F.to_timestamp("at"))
    got = {r["author_id"]: round(r["score"], 6) for r in ownership.ownership(df, F.lit("2024-01-01")).collect()}
    assert got == {1: 100.0, 2: 50.0}
    owned = ownership.ownership(df, F.lit("2024-01-01"))
    seen = spark.createDataFrame([(1, None)], "author_id int, last_seen_at timestamp")
    assert rows(ownership.bus_factor(owned, seen, F.lit("2024-01-01"), share=0.6), "path_prefix", "author_id", "inactive") == [("src", 1, False)]


def test_blast_radius_depths_and_cycle(spark):
    e = spark.createDataFrame([("route", "svc", "calls", 0.9), ("svc", "core", "calls", 0.9), ("core", "route", "calls", 0.3), ("x", "core", "imports", 0.9), ("y", "svc", "calls", 0.0)], EDGES)
    seeds = spark.createDataFrame([("s", "core")], "seed string, symbol_id string")
    got = rows(graph.blast_radius(e, seeds), "symbol_id", "depth", "min_confidence")
    assert got == [("route", 2, 0.9), ("svc", 1, 0.9), ("y", 2, 0.5)]
    assert rows(graph.blast_radius(e, seeds, max_depth=1), "symbol_id") == [("svc",)]
    assert rows(graph.blast_radius(e, seeds, max_nodes=2), "symbol_id") == [("route",), ("svc",)]


def test_call_flow_order_and_diagram(spark):
    e = spark.createDataFrame([("svc", "core", "calls", 0.9), ("svc", "log", "emits", 0.4), ("core", "log", "calls", 0.4), ("log", "svc", "calls", 0.8)], EDGES)
    seeds = spark.createDataFrame([("s", "svc")], "seed string, symbol_id string")
    flow = graph.call_flow(e, seeds)
    assert rows(flow, "step", "src_id", "dst_id", "depth") == [(1, "svc", "core", 1), (2, "svc", "log", 1), (3, "core", "log", 2), (4, "log", "svc", 2)]
    assert "-.->|emits| nlog" in graph.mermaid(flow).first()["diagram"]


def test_call_resolution(spark):
    s = symbols(spark, ("a", "run", "a.py"), ("b", "run", "b.py"), ("c", "main", "c.py"), ("d", "only", "d.py"))
    calls = spark.createDataFrame([("c", "c.py", "run"), ("a", "a.py", "only"), ("d", "d.py", "run")], "src_id string, path string, name string")
    bound = spark.createDataFrame([("c.py", "run", "b.py")], "path string, alias string, target_path string")
    got = rows(graph.call_edges(calls, s, bound), "src_id", "dst_id", "confidence")
    assert got == [("a", "d", 0.55), ("c", "b", 0.9), ("d", "a", 0.3), ("d", "b", 0.3)]


def test_module_resolution(spark):
    files = spark.createDataFrame([("gateway.py",), ("pkg/util.py",), ("pkg/__init__.py",), ("src/lib/index.ts",)], "path string")
    imports = spark.createDataFrame(
        [(1, "a.py", "gateway", False), (2, "pkg/service.py", ".util", True), (3, "src/x.ts", "./lib", True), (4, "src/x.ts", "react", False), (5, "a.py", "pkg", False)], "import_id long, path string, module string, is_relative boolean"
    )
    got = rows(graph.resolve_modules(imports, graph.module_candidates(imports), files), "import_id", "target_path")
    assert got == [(1, "gateway.py"), (2, "pkg/util.py"), (3, "src/lib/index.ts"), (4, None), (5, "pkg/__init__.py")]


def test_enclosing_symbol_takes_the_innermost(spark):
    s = spark.createDataFrame([("outer", "f", "a", "class", 1, 0, 100), ("inner", "g", "a", "method", 2, 10, 20)], NODES)
    p = spark.createDataFrame([(1, "a", 15), (2, "a", 50), (3, "b", 5)], "point_id int, path string, byte int")
    assert rows(graph.enclosing_symbol(p, s), "point_id", "src_id") == [(1, "inner"), (2, "outer"), (3, None)]


def test_dynamic_edges(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "y")], "symbol_id string, event string")
    s = spark.createDataFrame([("c", "x"), ("a", "x")], "symbol_id string, event string")
    assert rows(graph.dynamic_edges(e, s), "src_id", "dst_id", "dst_name") == [("a", "c", "consumer x")]


def test_layering_chain_and_cycle(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(graph.layering(n, chain)) == [("a", 0), ("b", 1), ("c", 2)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert rows(graph.layering(n, loop)) == [("a", 3), ("b", 3), ("c", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_layering_is_where_relaxation_rests(spark, seed):
    """Random graphs with and without cycles, against n + 1 rounds over all edges."""
    r = random.Random(seed)
    ids, edges = [], []
    for g in range(25):
        mine = [f"{g}-{i}" for i in range(r.randint(1, 9))]
        ids += mine
        edges += [(a, b) for a in mine for b in mine if r.random() < 0.25 and (a < b or r.random() < 0.15)]
    edges += [("0-0", "0-0"), ("gone", "0-0"), ("0-0", "gone")]
    n, layer = len(ids), dict.fromkeys(ids, 0)
    for _ in range(n + 1):
        before = dict(layer)
        for a, b in edges:
            if a != b and a in before and b in before:
                layer[b] = max(layer[b], min(before[a] + 1, n))
    got = graph.layering(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert dict(map(tuple, got.collect())) == layer and n in layer.values() and 2 in layer.values()


def test_clusters_split_and_fall_back(spark):
    ids = [f"m/{g}{i}.py" for g in "xy" for i in range(6)]
    pairs = [(f"m/{g}{i}.py", f"m/{g}{j}.py", 5.0) for g in "xy" for i in range(6) for j in range(i + 1, 6)] + [("m/x0.py", "m/y0.py", 3.0)]
    n = spark.createDataFrame([(i,) for i in [*ids, "apps/a/z.py", "apps/a/w.py"]], "id string")
    got = graph.clusters(n, spark.createDataFrame(pairs, "src string, dst string, weight double")).groupBy("cluster").count()
    assert rows(got) == [("m/x0.py", 6), ("m/y0.py", 6), ("package:apps/a", 2)]


def test_cohesion_and_names(spark):
    pairs = spark.createDataFrame([("src/billing/a.py", "src/billing/b.py", 8.0), ("src/auth/c.py", "src/billing/a.py", 1.0)], "src string, dst string, weight double")
    member = spark.createDataFrame([("src/billing/a.py", "1"), ("src/billing/b.py", "1"), ("src/auth/c.py", "2"), ("lone.py", "3")], "id string, cluster string")
    assert rows(graph.cohesion(graph.undirected(pairs), member)) == [("1", 2, 0.889, 0.111), ("2", 1, 0.0, 1.0), ("3", 1, 1.0, 0.0)]
    assert rows(graph.cluster_names(member)) == [("1", "Billing"), ("2", "Auth"), ("3", "Lone")]


def test_fusion_counts_each_occurrence(spark):
    lists = spark.createDataFrame(
        [(1, "semantic", 1, "a", "s"), (1, "semantic", 2, "b", "long"), (1, "semantic", 3, "c", "s"), (1, "lexical", 1, "c", "s"), (1, "lexical", 2, "b", "s"), (1, "lexical", 3, "n", "s"), (2, "lexical", 1, "a", "s"), (2, "lexical", 2, "a", "t")],
        "query_id int, channel string, rank int, path string, snippet string",
    )
    got = {r["path"]: r for r in retrieval.reciprocal_rank_fusion(lists.where("query_id = 1")).collect()}
    assert got["b"]["rank"] < got["a"]["rank"]
    assert got["b"]["sources"] == "lexical,semantic"
    assert got["b"]["snippet"] == "long"
    alone = retrieval.hybrid(lists).where("query_id = 2").collect()
    assert len(alone) == 2


def test_patch_lines_and_functions(spark):
    patch = "@@ -1,4 +1,6 @@\n a\n+def f(x):\n b\n+    y = 1\n+    print(y)\n-old\n c\n@@ -9,1 +20,2 @@\n+def g():\n+    return 1"
    p = spark.createDataFrame([("./pkg/a.py", patch), ("b", None)], "path string, patch string")
    added = review.added_lines(p)
    assert rows(added, "line") == [(2,), (4,), (5,), (20,), (21,)]
    assert rows(review.added_functions(added), "name", "line") == [("f", 2), ("g", 20)]
    assert rows(review.raw_calls(added), "raw_call", "line") == [("print()", 5)]
    spans = spark.createDataFrame([("s", "pkg\\a.py", 2, 6), ("t", "pkg/a.py", 3, 4), ("u", "pkg/a.py", 7, 9)], "symbol_id string, path string, start_line int, end_line int")
    assert rows(review.changed_symbols(added, spans), "symbol_id", "is_signature_change") == [("s", True), ("t", False)]


def test_gate_and_verdicts(spark):
    f = spark.createDataFrame([(1, 1, "a", "info", 0.99), (1, 2, "a", "warning", 0.8), (1, 3, "a", "warning", 0.5), (1, 4, "off", "warning", 0.9)], "pr_id int, finding_id int, check string, severity string, confidence double")
    assert [r["finding_id"] for r in review.threshold_gate(f, disabled=("off",)).orderBy("rank").collect()] == [2, 1]
    assert review.threshold_gate(f, most=0).count() == 0
    v = spark.createDataFrame([("a", '```json\n{"flag": true, "confidence": 7, "reason": " r "}\n```'), ("b", '{"flag": false, "confidence": 0.9}'), ("c", "junk"), ("d", None)], "candidate_id string, raw string")
    got = {r["candidate_id"]: (r["flagged"], r["confidence"], r["reason"]) for r in review.parse_verdicts(v).collect()}
    assert got["a"] == (True, 1.0, "r")
    assert got["b"][:2] == (False, 0.0)
    assert got["c"] == (False, 0.0, "unparseable verdict")


def test_citations(spark):
    a = spark.createDataFrame([(1, "[[a.py:9-2]] [[b.py:1]] [[a.py:99]] [[a.py]]")], "answer_id int, answer string")
    n = spark.createDataFrame([("a.py", 5)], "path string, total_lines int")
    assert rows(review.verify_citations(a, n)) == [(1, "a.py", 2, 5)]


def test_evaluation(spark):
    want = spark.createDataFrame([(1, "./a.py"), (1, "b.py"), (2, None)], "id int, path string")
    got = spark.createDataFrame([(1, "a.py", 1), (1, "b.py", 20)], "id int, path string, rank int")
    assert rows(evaluation.recall_at_k(want, got, 10)) == [(1, 0.5), (2, 1.0)]
    items = spark.createDataFrame([(["x", "y"], ["x", "z"]), ([], [])], "expected array<string>, found array<string>")
    assert tuple(evaluation.set_scores(items).first()) == (0.5, 0.5, 1)


def test_changes_and_pushes(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha string")
    n = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha string")
    assert rows(incremental.change_detection(b, n)) == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")]
    p = spark.createDataFrame([("1", "refs/heads/main", [(["./b", "a"], ["a"], None)]), ("2", "refs/heads/x", [])], "delivery_id string, ref string, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>")
    assert rows(incremental.push_paths(p)) == [("1", ["a", "b"])]


def test_planning(spark):
    e = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0), ("b", 0.0, -5.0, 0.0, None, 9.0)], "ref string, importance double, centrality double, business double, risk double, uncertainty double")
    assert rows(planning.priorities(e)) == [("a", 1.0, "deep"), ("b", 0.1, "brief")]
    u = spark.createDataFrame([(1, "gemini-3.1-flash-lite-x", 1_000_000, None, None), (2, "who", 1, 1, 2), (3, "gemini-3.1-pro", None, None, 2_000_000)], "run_id int, model string, input_tokens long, output_tokens long, total_tokens long")
    assert rows(planning.price_of(u, planning.price_table(spark)), "run_id", "cost") == [(1, 0.1), (2, None), (3, 2.5)]
    plan = spark.createDataFrame([("library", ["db"], 0, 0, 0, True, False, False)], "style string, analyzers array<string>, endpoint_count int, feature_count int, entry_point_count int, has_tests boolean, has_models boolean, has_auth boolean")
    got = dict(rows(planning.doc_plan(plan), "key", "enabled"))
    assert got["data"] and got["testing"] and got["public_api"] and not got["api"] and not got["execution_flows"]


PYTHON = '''"""doc"""
from fastapi import FastAPI
from .util import helper as h
import stripe

app = FastAPI()

@app.get("/items/{id}/")
def read(id):
    """Read it."""
    return helper("x")

class A:
    def run(self):
        return bus.emit("saved")

@shared_task
def nightly():
    pass
'''


def test_extraction(spark):
    files = spark.createDataFrame(
        [("apps/api/main.py", PYTHON), ("web/app/(shop)/cart/[id]/route.ts", 'export async function POST(req) { return x("y"); }\nimport {a as b} from "./lib"'), ("bad.py", "def ("), ("apps/api/webhooks.py", "def _x():\n  pass\ndef hook():\n  pass\n")], "path string, text string"
    )
    got = rows(extract.extract_symbols(files), "path", "name", "kind")
    assert ("apps/api/main.py", "run", "method") in got and ("apps/api/main.py", "A", "class") in got and ("web/app/(shop)/cart/[id]/route.ts", "POST", "function") in got
    refs = extract.extract_references(files)
    assert rows(refs.where("type = 'import' and path like '%.ts'"), "name", "alias", "module", "is_relative") == [("a", "b", "./lib", True)]
    assert rows(refs.where("name = 'emit'"), "receiver", "str_arg") == [("bus", "saved")]
    assert rows(extract.extract_endpoints(files), "method", "route") == [("GET", "/items/{id}"), ("POST", "/cart/{id}")]
    assert rows(extract.extract_jobs(files), "name", "kind") == [("hook", "webhook"), ("nightly", "celery")]
    assert ("apps/api/main.py", "http_app", "main.py") in rows(extract.entry_points(files))
    assert ("Stripe", "payments", 0.75) in rows(extract.externals(refs.where("type = 'import'")))
    m = spark.createDataFrame([("package.json", '{"dependencies": {"next": "1"}, "bin": {"x": "y"}}'), ("pyproject.toml", '[project]\ndependencies = ["fastapi>=1", "redis"]\n[project.scripts]\ncli = "a:b"'), ("b/package.json", "{")], "path string, text string")
    assert rows(extract.manifests(m).fillna(""), "ecosystem", "dependency", "script") == [("node", "", "x"), ("node", "next", ""), ("python", "", "cli"), ("python", "fastapi", ""), ("python", "redis", "")]


def test_repository_graph(spark):
    files = spark.createDataFrame([("service.py", "from gateway import send\n\ndef handle():\n    return send()\n"), ("gateway.py", "def send():\n    return 1\n")], "path string, text string")
    _, edges = extract.repository_graph(files)
    assert rows(edges.where("kind = 'calls'"), "dst_name", "confidence", "method") == [("send", 0.9, "import_resolved")]
    assert rows(edges.where("kind = 'imports'"), "path", "dst_name", "confidence") == [("service.py", "gateway.py", 0.95)]


def test_repository_graph_with_events_routes_and_scripts(spark):
    files = spark.createDataFrame(
        [
            ("api/a.py", "import os\nfrom .lib import helper as h\n\ndef a(bus):\n    bus.emit('evt')\n    h()\n"),
            ("api/lib.py", "def helper():\n    pass\n"),
            ("b.py", "def b(bus):\n    bus.on('evt')\n    helper()\n"),
            ("web/app.ts", 'import { load } from "./load";\nrouter.get("/items", list);\nclass Store {\n  // save( {\n  save(x: string): void {\n    load("}");\n  }\n}\n'),
            ("web/load.ts", "export const load = async (x) => {\n  return fetch(`${x} {`);\n};\n"),
        ],
        "path string, text string",
    )
    symbols, edges = extract.repository_graph(files)
    name = {r["symbol_id"]: r["name"] for r in symbols.collect()}
    got = {(name.get(r["src_id"]), name.get(r["dst_id"]) or r["dst_name"], r["kind"], r["confidence"]) for r in edges.collect()}
    assert ("a", "b", "emits", 0.35) in got and (None, "GET /items", "route", 0.4) in got
    assert (None, "api/lib.py", "imports", 0.95) in got and (None, "os", "imports", 0.3) in got and (None, "web/load.ts", "imports", 0.95) in got
    assert ("b", "helper", "calls", 0.55) in got and ("save", "load", "calls", 0.9) in got
    ends = graph.route_endpoints(edges, symbols, spark.createDataFrame([], "method string, route string, file_path string"))
    assert rows(ends, "method", "route", "file_path", "source") == [("GET", "/items", "", "route_convention")]
    jobs = spark.createDataFrame([("b", "b.py", "celery")], "name string, path string, kind string")
    scope = graph.graph_scope(files, symbols, edges, ends.withColumn("file_path", F.lit("web/app.ts")), jobs)
    assert rows(scope["seeds"], "title", "kind") == [("GET /items", "http"), ("b", "job")]
    assert ("web/app.ts", "web/load.ts") in rows(scope["edges"], "src", "dst") and scope["files"].count() == 5


def test_javascript_nesting(spark):
    text = """/** Pays. */
export class Gateway {
  #n = 0;
  constructor(a) { this.a = "{"; }
  static async charge(x = f(1)) {
    if (x) { while (y) { z(); } }
    return () => { /* } */ };
  }
  get total() { return 1; }
}
export interface Pay { charge(): void }
const arrow = (a, b) => a + b;
function outer() {
  function inner() {}
}
"""
    got = extract.extract_symbols(spark.createDataFrame([("a.ts", text)], "path string, text string")).collect()
    by = {r["name"]: r for r in got}
    assert {(n, r["kind"], r["parent"]) for n, r in by.items()} == {
        ("Gateway", "class", None), ("constructor", "method", "Gateway"), ("charge", "method", "Gateway"), ("total", "method", "Gateway"), ("Pay", "interface", None), ("arrow", "function", None), ("outer", "function", None), ("inner", "function", "outer"),
    }
    assert (by["Gateway"]["start_line"], by["Gateway"]["end_line"], by["Gateway"]["docstring"]) == (2, 10, "Pays.")
    assert (by["charge"]["start_line"], by["charge"]["end_line"]) == (5, 8) and (by["inner"]["start_line"], by["outer"]["end_line"]) == (14, 15)
    assert text.encode()[by["total"]["start_byte"] : by["total"]["end_byte"]].decode().strip() == "get total() { return 1; }"


def test_manifests_and_entries(spark):
    rows_ = [
        ("pyproject.toml", '[project]\ndependencies = [\n  "FastAPI>=1",\n  "httpx [http2]",\n]\n[project.scripts]\nshop = "a:b"\n[project.optional-dependencies]\ndev = ["pytest"]\n'),
        ("x/pyproject.toml", "[tool.poetry.dependencies]\npython = \"3\"\nDjango = {version = \"4\"}\n"),
        ("bad/pyproject.toml", "[["), ("package.json", '{"dependencies": {"react": "1"}, "bin": {"go": "x"}}'), ("requirements.txt", "a==1 # b\n-r c\nd[e]>2\n"), ("go.mod", "module x"),
    ]
    got = {(r["path"], r["dependency"], r["script"]) for r in extract.manifests(spark.createDataFrame(rows_, "path string, text string")).collect()}
    assert {x[1:] for x in got if x[0] == "pyproject.toml"} == {(None, "shop"), ("fastapi", None), ("httpx", None), ("pytest", None)}
    assert {x[1] for x in got if x[0] == "x/pyproject.toml"} == {"python", "django"} and not any(x[0].startswith("bad") for x in got)
    assert {x[1:] for x in got if x[0] == "package.json"} == {("react", None), (None, "go")} and {x[1] for x in got if x[0] == "requirements.txt"} == {"a", "d"}
    entries = [("celery_app.py", "app = Celery('x')"), ("worker.py", "celery_app = make()"), ("cli/main.py", "print(1)"), ("web/app/shop/page.tsx", ""), ("src/main.tsx", ""), ("hooks/webhook_in.py", "def _a():\n  pass\nasync def handle():\n  pass\n"), ("a.py", None)]
    got = rows(extract.entry_points(spark.createDataFrame(entries, "path string, text string")), "kind", "name")
    assert got == [("cli", "main.py"), ("page", "/shop"), ("page", "main.tsx"), ("webhook", "handle"), ("webhook", "webhook_in.py"), ("worker", "celery_app.py"), ("worker", "worker.py")]


def test_rollups_order_and_layout(spark):
    symbols = spark.createDataFrame([("1", "apps/api/a.py"), ("2", "apps/api/a.py"), ("3", "apps/web/b.ts"), ("4", "tests/t.py")], "symbol_id string, path string")
    assert rows(graph.hotspots(symbols), "path", "symbol_count") == [("apps/api/a.py", 2), ("apps/web/b.ts", 1)]
    files = spark.createDataFrame([("apps/api/a.py",), ("apps/web/b.ts",), ("apps/web/c.ts",)], "path string")
    assert rows(graph.component_rollup(symbols, files), "layer", "file_count", "symbol_count", "folders") == [("api", 1, 2, "apps/api"), ("web", 2, 1, "apps/web")]
    tree = spark.createDataFrame([("application", None), ("s", "application"), ("m", "s"), ("lost", "gone"), ("x", "y"), ("y", "x")], "key string, parent_key string")
    got = {r["key"]: (r["parent_key"], r["level"]) for r in graph.topological_order(tree).collect()}
    assert [got[k][1] for k in ("application", "s", "m")] == [0, 1, 2] and {got[k][0] for k in ("lost", "x", "y")} == {"application"}
    placed = graph.layout(spark.createDataFrame([("b", 0), ("a", 0), ("c", 1)], "id string, layer int"))
    assert rows(placed) == [("a", 0, 0.0, 0.0), ("b", 0, 200.0, 0.0), ("c", 1, 0.0, 140.0)]


def test_chunks(spark):
    assert extract.split_lines(["x" * 10] * 5, 25, 1) == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert extract.fold_tiny([(1, 2, "a" * 50), (3, 3, "b"), (9, 9, "c")]) == [(1, 3, "a" * 50 + "\nb"), (9, 9, "c")]
    f = spark.createDataFrame([("a.py", "x = 1\n" * 3000), ("b.py", " "), ("c.py", None)], "path string, text string")
    got = rows(extract.chunk_files(f), "path", "start_line", "end_line")
    assert len(got) > 2 and got[0][1] == 1 and got[-1][2] == 3000


def test_repo_map_budget(spark):
    s = spark.createDataFrame([("1", None, "A", "class", "a.py", 1, "class A:"), ("2", "1", "run", "method", "a.py", 2, "def run(self):"), ("3", None, "f", "function", "d/b.py", 1, "def f():")], "symbol_id string, parent_id string, name string, kind string, path string, start_line int, signature string")
    assert planning.repo_map(s).count() == 2
    assert "    def run" in planning.repo_map(s).where("path = 'a.py'").first()["block"]
    assert planning.repo_map(s, 16).count() == 1


def test_query_blocks_give_the_same_rows(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = rows(retrieval.nearest(v, q, 3), "query_id", "vec_id", "rank")
    monkeypatch.setattr(vectorindex, "BLOCK", 7)
    assert rows(retrieval.nearest(v, q, 3), "query_id", "vec_id", "rank") == whole
