"""A small system of our own, scanned end to end, with commands over it."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

import pytest

from factloom import cli
from factloom.extract import api, code, data
from factloom.plans import draft, scan, validate
from factloom.sinks import book, figures
from factloom.sources.files import coverage, read_tree

TREE = {
    "README.md": "# Library\n\nLends books.\n",
    "docker-compose.yml": "services:\n  desk:\n    build: ./desk\n    ports: ['80:80']\n    depends_on: [store, stock, bus]\n  stock:\n    build: ./stock\n    depends_on: [store]\n  letters:\n    build: ./letters\n    depends_on: [bus]\n  store:\n    image: postgres:16\n  bus:\n    image: rabbitmq:3\n",
    "db/001.sql": "CREATE TABLE loans (\n  id UUID PRIMARY KEY,\n  state TEXT NOT NULL DEFAULT 'open' CHECK (state IN ('open', 'late', 'done')),\n  book_id UUID REFERENCES books (id)\n);\nCREATE TABLE books (id UUID PRIMARY KEY, title TEXT NOT NULL);\n",
    "desk/package.json": '{"name": "@lib/desk", "dependencies": {"express": "4", "pg": "8", "amqplib": "1"}}\n',
    "desk/src/app.ts": """import express from "express";
import loans from "./routes/loans";

const app = express();
app.use("/api", loans);
app.get("/healthz", (req, res) => res.send("ok"));
app.listen(80);
""",
    "desk/src/routes/loans.ts": """import { Router } from "express";
import { openLoan, endLoan } from "../db";
import { reserve } from "../stock";
import { requireMember } from "../auth";

const router = Router();
/** Lends a book. */
router.post("/loans", requireMember, lend);
router.delete("/loans/:id", requireMember, async (req, res) => {
  await endLoan(req.params.id);
  res.status(204).end();
});

export async function lend(req, res) {
  const copy = await reserve(req.body.book);
  if (!copy) return res.status(409).json({ error: "none left" });
  await openLoan(req.body);
  res.status(201).json({ id: 1 });
}

export default router;
""",
    "desk/src/db.ts": """import { Pool } from "pg";
import amqp from "amqplib";
const pool = new Pool();
let channel;

export async function openLoan(loan) {
  await pool.query("INSERT INTO loans (id, state) VALUES ($1, 'open')", [loan.id]);
  channel.publish("loan.opened", Buffer.from(loan.id));
}

export async function endLoan(id: string) {
  await pool.query("UPDATE loans SET state = 'done' WHERE id = $1 AND state IN ('open', 'late')", [id]);
}
""",
    "desk/src/stock.ts": """interface Copy { shelf: string; isbn: string; }
export async function reserve(book: string): Promise<Copy> {
  const r = await fetch(`http://stock/books/${book}/copies`, { method: "POST" });
  return (await r.json()) as Copy;
}
""",
    "desk/src/auth.ts": "export function requireMember(req, res, next) { next(); }\n",
    "stock/pyproject.toml": '[project]\nname = "stock"\ndependencies = ["fastapi", "psycopg"]\n',
    "stock/stock/__main__.py": "import uvicorn\nfrom stock.web import app\n\nif __name__ == '__main__':\n    uvicorn.run(app)\n",
    "stock/stock/web.py": '''"""Stock of books."""
import psycopg
from fastapi import APIRouter, FastAPI, HTTPException
from pydantic import BaseModel

app = FastAPI()
router = APIRouter(prefix="/books")


class CopyOut(BaseModel):
    shelf: str


@router.post("/{book_id}/copies", status_code=201)
def take(book_id: str) -> CopyOut:
    """Takes a copy."""
    row = psycopg.connect("").execute("SELECT title FROM books WHERE id = %s", (book_id,)).fetchone()
    if row is None:
        raise HTTPException(status_code=404)
    return CopyOut(shelf="a")


app.include_router(router)
''',
    "letters/pyproject.toml": '[project]\nname = "letters"\ndependencies = ["pika"]\n',
    "letters/letters/__main__.py": '''import pika

QUEUE_TOPIC = "loan.opened"


def send(channel, method, props, body):
    print(body)


def main():
    channel = pika.BlockingConnection().channel()
    channel.basic_consume(QUEUE_TOPIC, send)


main()
''',
    "specs/loans/spec.md": "### Requirement: Lend\nPOST /api/loans answers 201 or 409\n### Requirement: List\nGET /api/loans answers 200\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def model(spark, tree):
    return scan.scan(read_tree(spark, tree))


@pytest.fixture(scope="module")
def drawn(model):
    from factloom.plans.flows import flows

    return flows(model)


def test_model(model):
    assert {r["id"]: (r["kind"], r["language"], r["compose_service"]) for r in model.units.collect()} == {"desk": ("http-service", "TypeScript", "desk"), "stock": ("http-service", "Python", "stock"), "letters": ("worker", "Python", "letters")}
    assert {r["id"]: r["used_by"] for r in model.infra.collect()} == {"postgres": ["desk", "stock"], "rabbitmq": ["desk", "letters"]}
    assert {(r["source"], r["target"]): (r["edge_type"], r["label"]) for r in model.relationships.collect()} == {
        ("desk", "postgres"): ("write", "writes loans"), ("stock", "postgres"): ("read", "reads books"), ("desk", "rabbitmq"): ("event", "publishes loan.opened"), ("rabbitmq", "letters"): ("event", "delivers loan.opened"), ("desk", "stock"): ("sync", "calls /books/{book}/copies"),
    }
    ops = {r["id"]: r for r in model.operations.collect()}
    assert set(ops) == {"desk:POST /api/loans", "desk:DELETE /api/loans/{id}", "stock:POST /books/{book_id}/copies"}
    lend = ops["desk:POST /api/loans"]
    assert lend["handler"] == "lend" and [a["kind"] for a in lend["auth"]] == ["authenticated"] and lend["summary"] == "Lends a book." and lend["file"] == "desk/src/routes/loans.ts" and TREE[lend["file"]].split("\n")[lend["line"] - 1].startswith("router.post")
    take = ops["stock:POST /books/{book_id}/copies"]
    assert (take["response_type"], take["success_status"], take["errors"], take["confidence"]) == ("CopyOut", 201, [404], "partial")
    assert [(r["operation"], r["reason"]) for r in model.excluded.collect()] == [("desk:GET /healthz", "health / liveness probe")]
    assert [(r["unit"], r["operation"], r["target_host"], r["drift"]) for r in model.client_calls.collect()] == [("desk", "stock:POST /books/{book_id}/copies", "stock", ["isbn"])]
    assert [(r["id"], [f["name"] for f in r["fields"]]) for r in model.models.collect()] == [("stock:CopyOut", ["shelf"])]
    assert {r["table"]: [c["name"] for c in r["columns"]] for r in model.entities.collect()} == {"loans": ["id", "state", "book_id"], "books": ["id", "title"]}
    (machine,) = model.state_machines.collect()
    assert [(s["name"], s["initial"], s["terminal"]) for s in machine["states"]] == [("open", True, False), ("late", False, False), ("done", False, True)]
    assert sorted((r["from"], r["to"], r["trigger"]) for r in model.transitions.collect()) == [("late", "done", "endLoan"), ("open", "done", "endLoan")]


def test_flow_order(drawn):
    told = {r["entry"]: [(s["from"], s["to"], s["kind"]) for s in r["steps"]] for r in drawn.collect()}
    assert told["desk:POST /api/loans"] == [("desk", "stock", "call"), ("stock", "postgres", "read"), ("stock", "desk", "reply"), ("desk", "postgres", "write"), ("desk", "rabbitmq", "event"), ("rabbitmq", "letters", "deliver")]


def test_evidence_points_at_what_it_says(model, tree):
    for r in model.relationships.collect():
        e = r["evidence"][0]
        assert e["start_line"] <= len(TREE[e["file_path"]].split("\n")), r
    for r in model.accesses.collect():
        assert r["table"] in TREE[r["path"]].split("\n")[r["line"] - 1]


def test_two_runs_agree(spark, tree, model):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = scan.scan(read_tree(spark, tree))
        for name in ("units", "infra", "relationships", "operations", "models", "client_calls", "entities", "state_machines"):
            a, b = (sorted(getattr(m, name).toJSON().collect()) for m in (model, again))
            assert a == b, name
        assert scan.diff(model, again).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repositories_dont_mix(spark, tree, model):
    from pyspark.sql import functions as F

    one = read_tree(spark, tree)
    both = scan.scan(one.withColumn("repo", F.lit("a")).unionByName(one.withColumn("repo", F.lit("b"))))
    for name, alone in model.tables().items():
        drop = [c for c in alone.columns if c == "repo"]
        want = sorted(alone.drop(*drop).toJSON().collect())
        for repo in ("a", "b") if drop else ():
            got = both.tables()[name].where(F.col("repo") == repo).drop("repo").toJSON().collect()
            assert sorted(x.replace(f'"entity:{repo}:', '"entity::') for x in got) == want, (name, repo)  # keys hold the repository


def test_calls_reach_member_repositories(spark, tree):
    from pyspark.sql import functions as F

    one = read_tree(spark, tree)
    far = scan.scan(one.where("path not like 'stock/%'").withColumn("repo", F.lit("a")).unionByName(one.where("path like 'stock/%'").withColumn("repo", F.lit("b"))).unionByName(one.where("path like 'stock/%'").withColumn("repo", F.lit("c"))))
    got = scan.cross_repo(far, spark.createDataFrame([("b", "stock")], "repo string, host string")).collect()
    assert [(r["repo"], r["member"], r["operation"]) for r in got] == [("a", "b", "stock:POST /books/{book_id}/copies")]


def test_diff_says_what_changed(spark, tree, model):
    files = read_tree(spark, tree)
    from pyspark.sql import functions as F

    changed = files.where("path not like 'letters/%'").withColumn("content", F.replace("content", F.lit("title TEXT NOT NULL"), F.lit("title TEXT")))
    got = [(r["section"], r["verb"], r["subject"]) for r in scan.diff(model, scan.scan(changed)).collect()]
    assert got == [("containers", "removed", "letters"), ("relationships", "removed", "rabbitmq -> letters (event)"), ("entities", "changed", "books")]


def test_diagrams_are_valid_and_drawn(spark, model, drawn):
    from factloom.sources import specs

    told = drawn.collect()
    entities, machine, moves = model.entities.collect(), model.state_machines.first(), model.transitions.collect()
    for document in (draft.system(model), draft.sequence(told[0]), draft.entity_diagram(entities), draft.lifecycle(machine, moves)):
        assert specs.diagram_errors(json.dumps(document)) == []
        found = validate.validate(*specs.diagram_tables(spark, "d", json.dumps(document))).where("severity = 'error'").collect()
        assert [f for f in found if f["code"] != "ERR_ORPHAN_NODE"] == [], document["title"]
        at = figures.layout(document)
        assert set(at) == {n["id"] for n in document["nodes"]} and figures.svg(document).endswith("</svg>") and figures.drawio(document).startswith("<mxfile>") and figures.drawio_csv(document).count("\r\n") == len(document["nodes"]) + 1
        boxes = list(at.values())
        assert not any(a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] for i, a in enumerate(boxes) for b in boxes[:i])


def test_domains_and_capabilities(model):
    assert {r["table"]: r["domain"] for r in draft.domains(model.entities, model.accesses).collect()} == {"loans": "desk", "books": "stock"}
    assert [(r["unit"], r["capability"], r["operations"]) for r in draft.capabilities(model.operations).collect()] == [("desk", "Loans", 2), ("stock", "Books", 1)]


def test_score(spark, tree, model, drawn):
    from factloom.plans.score import score

    row = score(model, coverage(read_tree(spark, tree)), drawn).first()
    assert row["source_read"] == 1.0 and row["data_described"] == 1.0 and row["evidence_verified"] is None and 0 < row["score"] <= 100


def test_deployment_configuration_and_commands_reach_model_and_book(spark):
    from factloom.plans.flows import flows
    from factloom.sources import specs

    manifest = """kind: Deployment
metadata: {name: desk}
spec: {template: {metadata: {labels: {app: desk}}, spec: {containers: [{image: "lib/desk:1", env: [{name: DB, value: "postgres://store:5432/x"}]}]}}}
---
kind: StatefulSet
metadata: {name: store}
spec: {template: {metadata: {labels: {app: store}}}}
---
kind: Service
metadata: {name: store}
spec: {selector: {app: store}}
"""
    extra = {
        "k8s/all.yaml": manifest, "stock/src/main/resources/application-prod.yml": "server:\n  port: 8080\n", "compose.prod.yml": "services:\n  desk: {}\n  cache: {image: redis}\n",
        "tool/Cargo.toml": '[package]\nname = "tool"\n[dependencies]\nclap = "4"\n', "tool/src/main.rs": "use clap::Parser;\n/// Counts books.\n#[derive(Parser)]\nstruct Args {\n    /// How many.\n    #[arg(long)]\n    most: Option<u32>,\n}\n",
    }
    files = spark.createDataFrame([(None, p, t) for p, t in {**TREE, **extra}.items()], "repo string, path string, content string")
    model = scan.scan(files)
    assert [tuple(r)[2:] for r in model.topology.orderBy("from", "to").collect()] == [("desk", "store", "calls"), ("store", "store", "selects")]
    assert [(r["key"], r["value"], r["profile"]) for r in model.configuration.collect()] == [("server.port", "8080", "prod")]
    pages = book.plan(model, flows(model), coverage(files))
    assert "figures/deployment.svg" in pages and specs.diagram_errors(pages["ir/deployment.json"]) == []
    assert "server.port" in pages["configuration.md"] and "Lends books." in pages["index.md"] and "--most" in pages["commands.md"] and "| desk | loans" in pages["data.md"]
    assert "### POST /api/loans" in pages["requirements.md"] and "- Access: authenticated" in pages["requirements.md"] and "writes loans" in pages["requirements.md"]


def test_book_is_incremental(tmp_path):
    files = {"a.md": "one\n", "ir/x.json": "{}\n"}
    assert book.write(files, str(tmp_path))["written"] == ["a.md", "ir/x.json"] and book.check(files, str(tmp_path)) == {"changed": [], "missing": [], "orphaned": []}
    (tmp_path / "authored.json").write_text("{}")
    (tmp_path / "ir/x.json").write_text('{"mine": 1}\n')
    done = book.write({"b.md": "two\n", "ir/x.json": '{"new": 1}\n'}, str(tmp_path))
    assert done == {"written": ["b.md"], "unchanged": [], "removed": ["a.md"], "kept": ["ir/x.json"]} and (tmp_path / "authored.json").exists()
    with pytest.raises(ValueError):
        book.write({"../x": ""}, str(tmp_path))


def test_escaping():
    evil = {"version": "1.0.0", "diagramType": "container", "title": "</script><b>", "theme": "editorial-light", "metadata": {"targetRepo": ".", "generatedAt": "x"}, "containers": [], "nodes": [{"id": "a", "label": "<img onerror=x>", "isKeyFocalPoint": True, "subtitle": "=cmd()"}], "edges": []}
    page = figures.figure_html(evil)
    assert "<img" not in page and page.count("</script>") == 1 and "'=cmd()" in figures.drawio_csv(evil) and "<b>" not in page


def test_commands(spark, tree, tmp_path, capsys):
    root = tmp_path / "repo"
    subprocess.run(["cp", "-r", tree, str(root)], check=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    out = str(root / "docs/architecture")
    assert cli.main(["generate", "--repo", str(root), "--out", out]) == 0 and "loans" in Path(out, "data.md").read_text() and Path(out, "figures/system.svg").exists()
    assert json.loads(Path(out, "manifest.json").read_text()).keys() >= {"index.md", "llms.txt", "book.html"}
    Path(out, "api.md").write_text("edited")
    assert cli.main(["check", "--repo", str(root), "--out", out]) == 1
    assert cli.main(["verify", "--repo", str(root), "desk/src/app.ts:1-3"]) == 0
    assert cli.main(["verify", "--repo", str(root), "desk/src/app.ts:999", "none.ts:1", "../x:1"]) == 1
    assert cli.main(["conform", "--repo", str(root)]) == 1
    said = capsys.readouterr().out
    assert "line-out-of-range" in said and "file-missing" in said and "outside-repo" in said and "matched: POST /api/loans" in said and "missing: GET /api/loans" in said
    db = root / "desk/src/db.ts"
    db.write_text("// new\n" + db.read_text())
    assert cli.main(["verify", "--repo", str(root), "desk/src/db.ts:1"]) == 1
    run("rm", "-rq", "--cached", "letters")
    run("commit", "-qm", "two")
    assert cli.main(["diff", "--repo", str(root), "--base", "HEAD~1", "--exit-code"]) == 1 and "**removed** letters" in capsys.readouterr().out
    assert cli.main(["diff", "--repo", str(root), "--base=--evil"]) == 2
    ir = tmp_path / "ir.json"
    assert cli.main(["analyze", "--repo", str(root), "--emit-ir", str(ir)]) == 0 and cli.main(["validate", str(ir)]) == 0 and cli.main(["render", str(ir), "--out", str(tmp_path / "x.svg")]) == 0
    ir.write_text("{}")
    assert cli.main(["validate", str(ir)]) == 1 and cli.main(["render", str(ir), "--out", str(tmp_path / "y.svg")]) == 1 and not (tmp_path / "y.svg").exists()
    assert cli.main(["schema"]) == 0
    answer = cli.answer({"id": 1, "method": "tools/call", "params": {"name": "verify", "arguments": {"repo": str(root), "places": ["bad"]}}}, ".")
    assert answer["result"]["isError"] and len(cli.answer({"id": 2, "method": "tools/list"}, ".")["result"]["tools"]) == 4 and cli.answer({"method": "note"}, ".") is None


@pytest.mark.parametrize(("name", "text", "want"), [
    ("a.go", 'package a\nimport "net/http"\nfunc R(mux *http.ServeMux) {\n\tmux.HandleFunc("GET /a/{id}", getA)\n}\nfunc getA(w http.ResponseWriter, r *http.Request) { w.WriteHeader(http.StatusNotFound) }\n', [("GET", "/a/{id}", "getA")]),
    ("a.rs", 'use axum::Router;\npub fn app() -> Router { Router::new().nest("/v1", inner()) }\nfn inner() -> Router { Router::new().route("/x/:id", get(read).post(write)) }\n', [("GET", "/v1/x/{id}", "read"), ("POST", "/v1/x/{id}", "write")]),
    ("A.java", '@RestController\n@RequestMapping("/shop")\npublic class A {\n    @GetMapping("/items/{id}")\n    public ResponseEntity<Item> item(@PathVariable String id) { return null; }\n}\n', [("GET", "/shop/items/{id}", "item")]),
    ("A.kt", '@RestController\n@RequestMapping("/shop")\nclass A {\n    @PostMapping("/items")\n    fun add(@RequestBody item: Item): Item = item\n}\n', [("POST", "/shop/items", "add")]),
    ("AController.cs", '[Route("api/[controller]")]\npublic class StockController {\n    [HttpGet("{id:int}")]\n    public ActionResult<Item> Get(int id) { return null; }\n}\n', [("GET", "/api/stock/{id}", "Get")]),
    ("a.py", 'from flask import Blueprint, Flask\nbp = Blueprint("x", __name__, url_prefix="/x")\n@bp.route("/<int:n>", methods=["PUT"])\ndef put(n): ...\napp = Flask(__name__)\napp.register_blueprint(bp)\n', [("PUT", "/x/{n}", "put")]),
    ("a.ts", '@Controller("cats")\nexport class Cats {\n  @Get(":id")\n  async one(@Param("id") id: string): Promise<Cat> { return null; }\n}\n', [("GET", "/cats/{id}", "one")]),
])
def test_routes_of_each_language(name, text, want):
    operations, _ = api.read_unit({name: text})
    assert [(o["method"], o["path"], o["handler"]) for o in operations] == want and not any(o["path_partial"] for o in operations)


def test_facts_of_each_language():
    texts = {"a.rs": "use a::b;\npub fn f(x: i32) { g(x); }\n", "a.go": 'package p\nimport "fmt"\nfunc F(x int) { fmt.Println("s") }\n', "A.java": "package p;\nimport a.B;\npublic class A {\n  public void f(int x) { g(\"s\"); }\n}\n", "a.kt": "package p\nimport a.B\nclass A {\n  fun f(x: Int) { g() }\n}\n", "A.cs": "using A.B;\nnamespace P;\npublic class A {\n  public void F(int x) { G(); }\n}\n", "a.ts": 'import x from "y";\nexport function f(x: number) { g(x); }\n', "a.py": "import a\ndef f(x):\n    g(x)\n"}
    for path, text in texts.items():
        (facts,) = code.parse(path, text)
        f = next(s for s in facts["symbols"] if s["name"].lower() == "f")
        assert len(f["params"]) == 1 and facts["imports"] and facts["calls"] and not facts["has_syntax_errors"], path
        assert text.split("\n")[f["start_line"] - 1].lower().count("f") and f["end_line"] >= f["start_line"]
    assert code.parse("a.py", "def (")[0]["has_syntax_errors"] and code.parse("x.txt", "") == []
    for path in texts:  # odd input never fails
        for odd in ("", "{", '"', "/*", "(((", "\x00é\U0001f600", "fn fn fn((", "@" * 99):
            code.parse(path, odd), data.entities(path, odd), data.accesses(path, odd), api.read_unit({path: odd})


def test_sql_statements():
    got = data.statement("WITH x AS (SELECT 1 FROM raw) UPDATE orders o SET state = 'paid', n = n + 1 WHERE o.id = $1 AND state IN ('a', 'b') AND total > 10")
    assert got["target"] == "orders" and got["reads"] == ["raw"] and {"column": "state", "value": "'paid'"} in got["sets"] and [w["value"] for w in got["wheres"] if w["column"] == "state"] == ["'a'", "'b'"]
    assert data.business_conditions(got["conditions"], "state") == ["total > 10"] and data.statement("select one from the list") is None and not data.is_sql("please update the docs")


def test_inline_handlers_end_where_they_end():
    text = 'import express from "express";\nconst app = express();\napp.get("/a", (req, res) => {\n' + "  step();\n" * 60 + '  res.send("x");\n});\napp.get("/b", (req, res) => {\n  res.send("y");\n});\n'
    a, b = sorted(api.read_unit({"src/app.js": text})[0], key=lambda r: r["line"])
    assert (a["line"], a["end_line"], b["line"], b["end_line"]) == (3, 65, 66, 68)
