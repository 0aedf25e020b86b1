"""Flows through field chains, ports, a command bus, messages and events; relationships by bus; walks against brute force."""

from __future__ import annotations

import random

import pytest

from factloom.operators import walks
from factloom.plans import scan
from factloom.plans.flows import flows

GO = """package main

import (
	"context"
	"net/http"

	"github.com/go-chi/chi/v5"
	"github.com/mehdihadeli/go-mediatr"
	_ "github.com/lib/pq"
)

type Loan struct{ id string }

type LoanRepo interface {
	AddLoan(ctx context.Context, l *Loan) error
}

type SqlLoanRepo struct{ db *sql.DB }

func (r SqlLoanRepo) AddLoan(ctx context.Context, l *Loan) error {
	r.db.Exec("INSERT INTO loans (id) VALUES ($1)", l.id)
	return nil
}

type lendHandler struct{ repo LoanRepo }

func (h lendHandler) Handle(ctx context.Context, cmd Lend) error {
	return h.repo.AddLoan(ctx, nil)
}

type listHandler struct{ db *sql.DB }

func (h listHandler) Handle(ctx context.Context, q List) error {
	h.db.Query("SELECT id FROM books")
	return nil
}

type Queries struct{ List ListHandler }
type Base struct{ Queries Queries }
type App struct{ *Base }
type HttpServer struct{ app App }

func (s HttpServer) ListLoans(w http.ResponseWriter, r *http.Request) {
	s.app.Queries.List.Handle(r.Context(), 1)
}

func (s HttpServer) Lend(w http.ResponseWriter, r *http.Request) {
	mediatr.Send[Lend, string](r.Context(), cmd)
}

func main() {
	s := HttpServer{}
	r := chi.NewRouter()
	r.Get("/loans", s.ListLoans)
	r.Post("/loans", s.Lend)
	http.ListenAndServe(":80", r)
}
"""
TREE = {
    "desk/go.mod": "module example.com/desk\n\nrequire (\n\tgithub.com/go-chi/chi/v5 v5.0.0\n\tgithub.com/lib/pq v1.0.0\n\tgithub.com/mehdihadeli/go-mediatr v1.0.0\n)\n",
    "desk/main.go": GO,
    "mail/pyproject.toml": '[project]\nname = "mail"\ndependencies = ["fastapi", "kafka-python", "pika", "psycopg"]\n',
    "mail/mail/web.py": """import psycopg
from fastapi import FastAPI
from kafka import KafkaProducer

app = FastAPI()


@app.post("/letters")
def write():
    psycopg.connect("").execute("INSERT INTO letters (id) VALUES (1)")
    KafkaProducer().send("letter.written", b"x")
    KafkaProducer().send("audit.noted", b"x")
    return {}
""",
    "mail/mail/rabbit.py": "import pika\n\n\ndef connect():\n    return pika.BlockingConnection()\n",
    "post/pyproject.toml": '[project]\nname = "post"\ndependencies = ["kafka-python", "psycopg"]\n',
    "post/post/__main__.py": """import psycopg
from kafka import KafkaConsumer

TOPIC = "letter.written"


def deliver(m):
    psycopg.connect("").execute("INSERT INTO stamps (id) VALUES (1)")


def main():
    KafkaConsumer(TOPIC).run(deliver)
    deliver(1)


main()
""",
    "blind/pyproject.toml": '[project]\nname = "blind"\ndependencies = ["pika", "psycopg", "fastapi"]\n',
    "blind/blind/web.py": """import pika
import psycopg
from fastapi import FastAPI

app = FastAPI()


@app.post("/blind")
def send():
    psycopg.connect("").execute("UPDATE stamps SET id = 2")
    channel.basic_publish(exchange=x, routing_key=key, body=b"")
    return {}


def work(ch, method, props, body):
    psycopg.connect("").execute("INSERT INTO parcels (id) VALUES (1)")


def start():
    channel.basic_consume(queue, work)
""",
    "stock/pom.xml": "<project><artifactId>stock</artifactId><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId></dependency><dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency></dependencies></project>",
    "stock/src/main/java/Stock.java": """package stock;

import org.springframework.web.bind.annotation.*;
import org.postgresql.Driver;

@RestController
public class Stock {
    @PostMapping("/reserve")
    public String reserve() {
        jdbc.update("UPDATE stock SET n = 1");
        publisher.publishEvent(new Reserved("x"));
        return "";
    }

    @EventListener
    public void on(Reserved e) {
        jdbc.update("INSERT INTO audit (id) VALUES (1)");
    }
}
""",
    "web/package.json": '{"name": "web", "dependencies": {"express": "4", "pg": "8", "stripe": "1"}}',
    "web/src/app.js": 'import express from "express";\nimport { Pool } from "pg";\nconst pool = new Pool();\nconst app = express();\napp.post("/a", (req, res) => {\n' + "  step();\n" * 60 + '  pool.query("INSERT INTO late (id) VALUES (1)");\n  pool.query("UPDATE later SET id = 1");\n});\napp.post("/b", (req, res) => {\n  pool.query("INSERT INTO next (id) VALUES (1)");\n  pool.query("UPDATE other SET id = 1");\n});\napp.listen(80);\n',
    "web/src/pay.js": 'import Stripe from "stripe";\nconst stripe = new Stripe();\nexport function pay() {\n  stripe.charges.create();\n}\nexport function refund() {\n  stripe.refunds.create();\n}\nexport function idle() {\n  return 1;\n}\n',
    "web/src/routes.js": 'import { pay } from "./pay";\nimport { Pool } from "pg";\nconst router = express.Router();\nrouter.post("/pay", checkout);\nfunction checkout(req, res) {\n  pay();\n  pool.query("INSERT INTO paid (id) VALUES (1)");\n}\n',
    "db/schema.sql": "CREATE TABLE loans (id TEXT);\nCREATE TABLE books (id TEXT);\nCREATE TABLE letters (id TEXT);\nCREATE TABLE stamps (id TEXT);\nCREATE TABLE parcels (id TEXT);\nCREATE TABLE stock (id TEXT, n INT);\nCREATE TABLE audit (id TEXT);\nCREATE TABLE late (id TEXT);\nCREATE TABLE later (id TEXT);\nCREATE TABLE next (id TEXT);\nCREATE TABLE other (id TEXT);\nCREATE TABLE paid (id TEXT);\n",
}


@pytest.fixture(scope="module")
def model(spark):
    return scan.scan(spark.createDataFrame([("", p, t) for p, t in TREE.items()], "repo string, path string, content string"))


@pytest.fixture(scope="module")
def told(model):
    return {r["entry"]: r for r in flows(model).collect()}


def short(row):
    return [(s["from"], s["to"], s["label"]) for s in row["steps"]]


def test_field_chains_ports_and_a_bus(model, told):
    assert {r["id"] for r in model.operations.collect()} >= {"desk:GET /loans", "desk:POST /loans"}
    from factloom.plans import flows as plan

    bodies = plan.functions(model)
    edges = {(r["src"].split("\x01")[-1], r["dst"].split("\x01")[-1], r["dst"].split("\x01")[-2]) for r in plan.call_edges(model, bodies).where("src like '%main.go%'").collect()}
    line = lambda text: str(1 + GO[: GO.index(text)].count("\n"))
    assert ("ListLoans", "Handle", line("func (h listHandler)")) in edges and ("Lend", "Handle", line("func (h lendHandler)")) in edges
    assert ("Handle", "AddLoan", line("func (r SqlLoanRepo)")) in edges


def test_messages_events_and_lone_consumers(told):
    assert short(told["mail:POST /letters"]) == [("mail", "postgres", "writes letters"), ("mail", "kafka", "publishes letter.written"), ("mail", "kafka", "publishes audit.noted"), ("kafka", "post", "delivers letter.written"), ("post", "postgres", "writes stamps")]
    assert short(told["blind:POST /blind"]) == [("blind", "postgres", "writes stamps"), ("blind", "rabbitmq", "publishes"), ("rabbitmq", "blind", "delivers"), ("blind", "postgres", "writes parcels")]
    assert short(told["stock:POST /reserve"]) == [("stock", "postgres", "writes stock"), ("stock", "stock", "publishes Reserved"), ("stock", "stock", "Reserved → on"), ("stock", "postgres", "writes audit")]
    assert [s["async"] for s in told["stock:POST /reserve"]["steps"]] == [False, True, True, True]


def test_inline_handlers_and_third_parties(told):
    assert short(told["web:POST /a"]) == [("web", "postgres", "writes late"), ("web", "postgres", "writes later")]
    assert short(told["web:POST /b"]) == [("web", "postgres", "writes next"), ("web", "postgres", "writes other")]
    assert short(told["web:POST /pay"]) == [("web", "stripe", "charges cards"), ("web", "postgres", "writes paid")]
    assert told["web:POST /pay"]["functions"] == ["web:checkout", "web:pay"]


def test_topics_belong_to_their_bus(model):
    assert {r["id"]: r["topics"] for r in model.infra.where("category = 'event-bus'").collect()} == {"kafka": ["audit.noted", "letter.written"], "rabbitmq": []}
    edges = {(r["source"], r["target"]): r["label"] for r in model.relationships.collect()}
    # the topic that another unit shares, though another one is less
    assert edges["mail", "kafka"] == "publishes letter.written" and edges["mail", "rabbitmq"] == "connects" and edges["kafka", "post"] == "delivers letter.written"


def test_conform_keeps_repositories_apart(spark, model):
    from types import SimpleNamespace

    ops = spark.createDataFrame([("x", "GET", "/users/{id}", 200, [404], "a", "f", 1), ("y", "POST", "/users", 201, [], "b", "f", 1)], "repo string, method string, path string, success_status int, errors array<int>, id string, file string, line int")
    declared = spark.createDataFrame([("x", "POST", "/users", [201]), ("x", "GET", "/users/{u}", [200]), ("y", "POST", "/users", [201, 409])], "repo string, method string, path string, statuses array<int>")
    got = sorted((r["repo"], r["method"], r["verdict"]) for r in scan.conform(declared, SimpleNamespace(operations=ops)).collect())
    assert got == [("x", "GET", "matched"), ("x", "POST", "missing"), ("y", "POST", "partial")]


def test_the_first_closed_set_counts(spark):
    files = [("", "db/schema.sql", "CREATE TABLE jobs (id INT, status TEXT DEFAULT 'new' CHECK (status IN ('new', 'done')));\n"), ("", "app/package.json", '{"name": "app", "dependencies": {"typeorm": "1", "pg": "8"}}'), ("", "app/src/a.ts", 'enum Status { Old = "old", New = "new", Done = "done" }\n@Entity("jobs")\nexport class Job {\n  @PrimaryColumn() id: number;\n  @Column({ type: "enum", enum: Status }) status: Status;\n}\nexport async function end() {\n  await pool.query("UPDATE jobs SET status = \'done\' WHERE status = \'new\'");\n}\n')]
    for partitions in (1, 3):
        got = scan.scan(spark.createDataFrame(files, "repo string, path string, content string").repartition(partitions)).state_machines.collect()
        assert [[s["name"] for s in r["states"]] for r in got] == [["new", "done"]]


DAO = """package dao;

public abstract class AbstractDao<E extends Base<E>, K> extends Root {
    protected abstract JpaRepository<E, K> getRepository();

    public E save(E entity) {
        getRepository().save(entity);
        entityManager.persist(entity);
        return entity;
    }

    public E find(K id) {
        return getRepository().findById(id);
    }
}
"""
DAOS = {
    "app/pom.xml": "<project><artifactId>app</artifactId><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-data-jpa</artifactId></dependency></dependencies></project>",
    "app/src/main/java/AbstractDao.java": DAO,
    "app/src/main/java/Middle.java": "package dao;\n\npublic abstract class Middle<T> extends AbstractDao<T, String> {\n}\n",
    "app/src/main/java/DeviceDao.java": "package dao;\n\npublic class DeviceDao extends AbstractDao<Device, Long> {\n}\n",
    "app/src/main/java/AssetDao.java": "package dao;\n\npublic class AssetDao extends Middle<Asset> {\n}\n",
    "app/src/main/java/LoneDao.java": DAO.replace("AbstractDao", "LoneDao"),
    "app/src/main/java/Device.java": 'package dao;\n\n@Entity\n@Table(name = "device")\npublic class Device {\n    @Id\n    private Long id;\n}\n',
    "app/src/main/java/Asset.java": 'package dao;\n\n@Entity\n@Table(name = "asset")\npublic class Asset {\n    @Id\n    private Long id;\n}\n',
}


def test_a_generic_base_writes_for_the_classes_that_bind_it(spark):
    model = scan.scan(spark.createDataFrame([("", p, t) for p, t in DAOS.items()], "repo string, path string, content string"))
    got = sorted((r["table"], r["through"], r["mode"], DAO.split("\n")[r["line"] - 1].strip()) for r in model.accesses.where("through is not null").collect())
    calls = [("read", "return getRepository().findById(id);"), ("write", "entityManager.persist(entity);"), ("write", "getRepository().save(entity);")]
    assert got == [(t, sub, mode, line) for t, sub in (("asset", "AssetDao"), ("device", "DeviceDao")) for mode, line in calls]
    assert model.accesses.where("path like '%LoneDao%'").count() == 0


def test_bound_parameters_against_brute_force(spark):
    rnd = random.Random(2)
    names = [f"c{k}" for k in range(9)]
    params = {c: rnd.sample(["E", "K", "V"], rnd.randrange(4)) for c in names}
    extends = [(rnd.choice(names), rnd.choice(names), [rnd.choice(["E", "K", "V", "x", "y", None]) for _ in range(rnd.randrange(4))]) for _ in range(22)]
    want = set()
    for base in names:
        for param in params[base]:
            todo, seen = [(base, param)], {(base, param)}
            while todo:
                at, arg = todo.pop()
                for sub, parent, args in extends:
                    k = params[at].index(arg)
                    if parent == at and k < len(args) and args[k] is not None:
                        if args[k] in params[sub]:
                            if (sub, args[k]) not in seen:
                                seen.add((sub, args[k]))
                                todo.append((sub, args[k]))
                        else:
                            want.add((base, param, sub, args[k]))
    got = walks.bound_parameters(spark.createDataFrame([("s", c, p) for c, p in params.items()] + [("s", None, ["E"])], "scope string, class string, params array<string>"), spark.createDataFrame([("s", *e) for e in extends] + [("s", "c1", None, ["x"])], "scope string, class string, parent string, args array<string>"))
    assert {(r["base"], r["param"], r["sub"], r["bound"]) for r in got.collect()} == want and want


def brute_promoted(fields, most):
    own, inner = {}, {}
    for scope, type_, field, to, embedded, pos in sorted(fields, key=lambda f: (f[5], f[3])):
        if embedded:
            inner.setdefault((scope, type_), []).append((pos, to))
        else:
            own.setdefault((scope, type_), {}).setdefault(field, to)
    out = {}
    for scope, type_ in {(f[0], f[1]) for f in fields}:
        level, seen = [((), type_)], {type_}
        for _ in range(most + 1):
            for _, at in sorted(level):
                for field, to in own.get((scope, at), {}).items():
                    out.setdefault((scope, type_, field), to)
            nxt = {}
            for order, at in level:
                for pos, to in inner.get((scope, at), []):
                    if to not in seen:
                        nxt[to] = min(nxt.get(to, ((10**9,),)), (*order, pos)) if to in nxt else (*order, pos)
            seen |= nxt.keys()
            level = [(o, t) for t, o in nxt.items()]
    return out


def test_chains_against_brute_force(spark):
    rnd = random.Random(3)
    fields = list({(rnd.choice("xy"), f"t{rnd.randrange(7)}", rnd.choice("abc"), f"t{rnd.randrange(7)}", rnd.random() < 0.4, rnd.randrange(4)) for _ in range(60)})
    ddl = "scope string, type string, field string, to string, embedded boolean, pos int"
    rows = spark.createDataFrame([*fields, (None, "t1", "a", "t2", False, 0), ("x", "t0", "c", None, False, 0), ("x", "t3", "", "t3", True, 0)], ddl)
    made = walks.promoted(rows, 3)
    want = brute_promoted([*fields, ("x", "t3", "", "t3", True, 0)], 3)
    got = {(r["scope"], r["type"], r["field"]): r["to"] for r in made.collect()}
    assert got == want
    chains = [(i, rnd.choice(["x", "y", None]), f"t{rnd.randrange(8)}", [rnd.choice("abc") for _ in range(rnd.randrange(5))]) for i in range(120)]
    found = {r["id"]: r["found"] for r in walks.chain_ends(spark.createDataFrame(chains, "id int, scope string, type string, names array<string>"), made).collect()}
    for i, scope, type_, names in chains:
        for n in names:
            type_ = want.get((scope, type_, n))
        assert found[i] == type_, i


def test_traversal_against_brute_force(spark):
    rnd = random.Random(8)
    for trial in range(2):
        edges = [(rnd.randrange(14), rnd.randrange(14), [rnd.randrange(5), rnd.randrange(3)], rnd.random() < 0.3, rnd.choice(["p", "q", None])) for _ in range(45)] + [(1, None, [0], False, None), (None, 2, [0], False, None)]
        entries = [(e, rnd.randrange(14), [e]) for e in range(5)] + [(0, 3, [9]), (2, 2, [1]), (None, 1, [0]), (4, None, [0])]
        gone = [(1, 5), (3, 7)]
        made = walks.traverse(spark.createDataFrame(entries, "entry int, node int, order array<int>"), spark.createDataFrame(edges, "src int, dst int, order array<int>, remote boolean, via string"), 2, 2, spark.createDataFrame(gone, "entry int, node int"))
        got = sorted((r["entry"], r["node"], tuple(r["order"]), r["depth"], r["hops"], tuple(r["via"])) for r in made.collect())
        seen, front = {}, {}
        for e, n, order in entries:
            if e is not None and n is not None and (e, n) not in gone:
                front[e, n] = min(front.get((e, n), ((10**9,),)), (tuple(order), 0, 0, ()))
        while front:
            seen |= front
            nxt = {}
            for (e, n), (order, depth, hops, via) in front.items():
                for src, dst, o, remote, by in edges:
                    if src == n and dst is not None and (e, dst) not in seen and (e, dst) not in gone and ((hops < 2 and (by is None or by not in via)) if remote else depth < 2):
                        s = ((*order, *o), 0 if remote else depth + 1, hops + remote, (*via, by) if remote and by else via)
                        nxt[e, dst] = min(nxt.get((e, dst), s), s)
            front = nxt
        assert got == sorted((e, n, *s) for (e, n), s in seen.items()), trial


def test_takers_bodies_and_deliveries(spark):
    asked = spark.createDataFrame([(1, "s", "a", ["m", "n"]), (2, "s", "b", ["n"]), (3, "s", "b", []), (4, None, "b", ["m"]), (5, "s", None, ["m"])], "id int, scope string, node string, messages array<string>")
    takers = spark.createDataFrame([("s", "m", "a"), ("s", "m", "b"), ("s", "n", "b"), ("s", "n", "c"), ("s", "n", "c"), ("s", "m", None)], "scope string, message string, node string")
    assert {r["id"]: r["taker"] for r in walks.only_taker(asked, takers).collect()} == {1: "b", 2: "c", 3: None, 4: None, 5: None}
    methods = spark.createDataFrame([("s", "Repo", "Add", "b1"), ("s", "listHandler", "Handle", "b2"), ("s", "ONE", "x", "b3"), ("s", "One", "x", "b4"), ("s", "Repo", "Add", "b0")], "scope string, type string, method string, body string")
    ports = spark.createDataFrame([("s", "Port", "Repo")], "scope string, port string, type string")
    want = {1: ("Repo", "Add", "b0"), 2: ("ListHandler", "Handle", "b2"), 3: ("one", "x", None), 4: ("Port", "Add", "b0"), 5: ("Port", "Gone", None), 6: ("ONE", "x", "b3")}
    got = walks.method_bodies(spark.createDataFrame([(i, "s", t, m) for i, (t, m, _) in want.items()], "id int, scope string, type string, method string"), methods, ports)
    assert {r["id"]: r["body"] for r in got.collect()} == {i: b for i, (_, _, b) in want.items()}
    published = spark.createDataFrame([(1, "s", "k", "t"), (2, "s", "k", None), (3, "s", "r", "u"), (4, "s", "r", None), (5, "s", "z", "t")], "id int, scope string, bus string, topic string")
    consumers = spark.createDataFrame([("a", "s", "k", "t", 3), ("b", "s", "k", "t", 1), ("c", "s", "k", "t", 2), ("d", "s", "r", None, 1)], "consumer string, scope string, bus string, topic string, order int")
    assert sorted(tuple(r) for r in walks.deliver(published, consumers, 2).collect()) == [(1, "b", 1, False), (1, "c", 2, False), (3, "d", 1, True), (4, "d", 1, True)]


def test_delivery_joins_no_more_consumers_than_it_keeps(spark):
    rnd = random.Random(3)
    consumers = [(f"c{k}", "s", f"b{k % 2}", rnd.choice(["t", "u", None]), rnd.choice([None, 1, 2, 3])) for k in range(300)]
    published = [(i, "s", f"b{i % 3}", rnd.choice(["t", "u", "v", None])) for i in range(200)] + [(7, "s", "b0", "t"), (7, "s", "b1", "u"), (8, None, "b0", "t")]
    left, right = spark.createDataFrame(published, "id int, scope string, bus string, topic string"), spark.createDataFrame(consumers, "consumer string, scope string, bus string, topic string, order int")
    met = {}
    for i, scope, bus, topic in published:
        met.setdefault(i, []).extend((-1 if at is None else at, c) for c, s, b, t, at in consumers if (s, b, t) == (scope, bus, topic) and t)
    made = walks.deliver(left, right, 2)
    rows = made.collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, c, n, False) for i, m in met.items() for n, (_, c) in enumerate(sorted(m)[:2], 1))
    plan = made._jdf.queryExecution().executedPlan()
    joined = []

    def look(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        for n in inner:
            look(n)

    look(plan)
    assert joined and max(joined) <= 2 * len(published)


def test_entries_of_one_node_share_a_walk(spark, monkeypatch):
    rnd = random.Random(12)
    edges = [(rnd.randrange(12), rnd.randrange(12), [rnd.randrange(5)], rnd.random() < 0.3, rnd.choice(["p", "q", None])) for _ in range(40)] + [(3, 4, None, False, None)]
    entries = [(e, e % 3, [e]) for e in range(60)] + [(60, 1, None), (61, 2, []), (62, 1, [1]), (62, 2, [2]), (63, 1, [7]), (63, 1, [6])]
    left, right, gone = spark.createDataFrame(entries, "entry int, node int, order array<int>"), spark.createDataFrame(edges, "src int, dst int, order array<int>, remote boolean, via string"), spark.createDataFrame([(1, 5), (4, 1)], "entry int, node int")
    sizes, kept = [], walks.cut

    def cut(df):
        out = kept(df)
        if "walk" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(walks, "cut", cut)
    together = sorted(map(repr, walks.traverse(left, right, 2, 2, gone).collect()))
    assert max(sizes) <= 12 * (3 + 4)  # three nodes where entries begin, and four entries that walk by themselves
    # a visited node that no edge meets makes every entry walk by itself
    each = spark.createDataFrame([(e, 99) for e in range(64)] + [(1, 5), (4, 1)], "entry int, node int")
    assert together == sorted(map(repr, walks.traverse(left, right, 2, 2, each).collect()))
