"""Types as written, statuses along ancestries, services named by literals, replaced tables: against plain Python and in a scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.extract import faults
from factloom.operators import aggregates, joins, sets, types
from factloom.plans import scan

CLASS = "scope string, class int, name string, package string, unit string, path string, parent string"
IMPORT = "scope string, path string, pos int, specifier string"
ASK = "id int, scope string, unit string, path string, package string, name string, home string"


def meant(row, classes, imports, never=()):
    """The class that a name means, step by step."""
    scope, unit, path, package, name = row
    if name in never or name is None or scope is None:
        return None
    named = [c for c in classes if c[0] == scope and c[2] == name]
    if len(named) == 1:
        return named[0][1]
    plain = lambda p: p or ""
    near = [c[1] for c in named if plain(c[3]) == plain(package) and unit is not None and c[4] == unit]
    if near:
        return min(near)
    mine = [(i[2], i[3].removesuffix(".*")) for i in imports if i[0] == scope and i[1] == path and path is not None and i[3]]
    hits = [(pos, c[1]) for pos, said in mine for c in named if said in (f"{plain(c[3])}.{name}", plain(c[3]))]
    if hits:
        return min(hits)[1]
    home = [c[1] for c in named if unit is not None and c[4] == unit]
    return home[0] if len(home) == 1 else None


def world(rnd):
    pick = lambda *x: rnd.choice(x)
    classes = [(pick("s", "s", "t"), n, pick("A", "B", "C", "D"), pick("p", "q", None), pick("u", "v", None), pick("f", "g", None), pick("A", "B", "C", "D", "E", None)) for n in range(rnd.randrange(9))]
    imports = [(pick("s", "t"), pick("f", "g", None), n, pick("p.A", "q.A", "p.*", "q", "q.B", "p.C", None)) for n in range(rnd.randrange(8))]
    return classes, imports


@pytest.mark.parametrize("seed", range(6))
def test_resolve_and_inherit(spark, seed):
    rnd = random.Random(seed)
    classes, imports = world(rnd)
    pick = lambda *x: rnd.choice(x)
    asks = [(n, pick("s", "t", None), pick("u", "v", None), pick("f", "g", None), pick("p", "q", None), pick("A", "B", "C", "D", "E", None), pick("u", "v", None)) for n in range(30)]
    cs, im, at = spark.createDataFrame(classes, CLASS), spark.createDataFrame(imports, IMPORT), spark.createDataFrame(asks, ASK)
    got = {tuple(r[:5]): r["class"] for r in types.resolve(at, cs, im, ["D"]).collect()}
    assert got == {(a[1], a[2], a[3], a[4], a[5]): meant((a[1], a[2], a[3], a[4], a[5]), classes, imports, ["D"]) for a in asks}
    known, local, every = [("E", 500)], [(pick("s", "t"), pick("u", "v"), pick("A", "B"), n + 400, pick(1, 2)) for n in range(3)], [(pick("s", "t"), pick("B", "C"), n + 410, pick(1, 2)) for n in range(3)]
    by_id = {c[1]: c for c in classes}

    def value(a):
        _, scope, unit, path, package, name, home = a
        for _ in range(5):
            if name is None:
                return None
            if name == "E":
                return 500
            mine = sorted((x[4], x[3]) for x in local if x[:3] == (scope, unit, name)) or sorted((x[3], x[2]) for x in every if x[:2] == (scope, name))
            if mine:
                return mine[0][1]
            c = by_id.get(meant((scope, home, path, package, name), classes, imports, ["D"]))
            if c is None:
                return None
            _, _, _, package, home, path, name = c
        return None

    frames = spark.createDataFrame(known, "name string, value int"), spark.createDataFrame(local, "scope string, unit string, name string, value int, ord int"), spark.createDataFrame(every, "scope string, name string, value int, ord int")
    found = types.inherited(at, cs, im, *frames, never=["D"])
    assert {r["id"]: r["value"] for r in found.collect()} == {a[0]: value(a) for a in asks}


def test_ancestries_in_a_ring_end(spark):
    ring = spark.createDataFrame([("s", 1, "A", None, "u", "f", "B"), ("s", 2, "B", None, "u", "f", "A"), ("s", 3, "C", None, "u", "f", "Gone")], CLASS)
    none = spark.createDataFrame([], IMPORT)
    assert {r["class"]: r["names"] for r in types.ancestry(ring, none).collect()} == {1: ["A", "B", "A", "B", "A"], 2: ["B", "A", "B", "A", "B"], 3: ["C", "Gone"]}
    assert types.ancestry(ring.limit(0), none).count() == 0


def test_named_services(spark):
    said = [("r", "web", 1, "http://pay-api:80/x?y=://pay"), ("r", "web", 2, "PAY_API_URL"), ("r", "pay", 3, "http://pay"), ("r", "web", 4, "xPAY_HOST"), ("s", "web", 5, "http://pay"), ("r", "web", 6, None), ("r", None, 7, "PAY_ADDR"), ("r", "web", 8, "https://PAY")]
    df = spark.createDataFrame(said, "repo string, unit string, pos int, value string")
    names = spark.createDataFrame([("r", "pay"), ("r", "pay-api"), ("r", "pay"), ("r", None)], "repo string, service string")
    assert sorted((r["pos"], r["service"]) for r in joins.named_services(df, names).collect()) == [(1, "pay"), (1, "pay-api"), (2, "pay-api")]


def test_superseded_and_busiest(spark):
    rows = [("r", "albums", True), ("r", "album", False), ("r", "bus", True), ("r", "bu", False), ("r", "items_sets", True), ("r", "item_set", False), ("s", "cats", True), ("r", "kept", True), ("r", None, True), ("r", "used_ones", True), ("r", "used_one", False)]
    tables = spark.createDataFrame(rows, "repo string, table string, written boolean")
    used = spark.createDataFrame([("r", "used_ones"), ("s", "albums"), (None, None)], "repo string, table string")
    assert sorted(tuple(r) for r in sets.superseded(tables, used).collect()) == [("r", "albums"), ("r", "items_sets")]
    units = [("r", "b", 4, False, 1, 9), ("r", "a", 5, None, 1, 9), ("r", "c", 3, True, 99, 99), ("s", "x", None, None, None, None), ("s", "w", None, True, None, None)]
    frame = spark.createDataFrame(units, "repo string, id string, modules int, service boolean, degree int, lines int")
    assert sorted(tuple(r) for r in aggregates.busiest(frame).collect()) == [("r", "a"), ("s", "w")]
    told = spark.createDataFrame([("a", "typed"), ("a", None), ("b", "partial")], "unit string, confidence string")
    gone = spark.createDataFrame([("a",), ("c",)], "unit string")
    assert sorted(tuple(r) for r in aggregates.contracts(told, gone, ["unit"]).collect()) == [("a", 2, 1, 0, 1, 1), ("b", 1, 0, 1, 0, 0), ("c", 0, 0, 0, 0, 1)]


API = '''package shop.api;

import shop.faults.TakenException;

@RestController
@RequestMapping("/items")
public class Items {
    private final Stock stock;

    @GetMapping("/{id}")
    public Item one(@PathVariable String id) {
        return stock.find(id);
    }

    @PostMapping
    public Item add(@RequestBody Item item) {
        if (item == null) throw new ResponseStatusException(HttpStatus.BAD_REQUEST, "404 or so");
        if (item.taken()) {
            throw new SoldException("500 sold");
        }
        return stock.store(item);
    }

    @DeleteMapping("/{id}")
    public void drop(@PathVariable String id) {
        throw new ForbiddenException();
    }
}
'''
STOCK = '''package shop.stock;

public class Stock {
    public Item find(String id) {
        throw new MissingException(id);
    }

    public Item store(Item item) {
        throw new OddException();
    }
}
'''
FAULTS = {
    "TakenException": "public class TakenException extends RuntimeException {\n}\n", "SoldException": "public class SoldException extends TakenException {\n}\n", "OddException": "public class OddException extends RuntimeException {\n}\n",
    "MissingException": '@ResponseStatus(value = HttpStatus.GONE, reason = "404")\npublic class MissingException extends RuntimeException {\n}\n',
}
ADVICE = '''package shop.api;

@RestControllerAdvice
public class Advice {
    @ExceptionHandler(TakenException.class)
    public ResponseEntity<String> taken(TakenException e) {
        return ResponseEntity.status(HttpStatus.CONFLICT).body("taken");
    }

    @ExceptionHandler
    @ResponseStatus(HttpStatus.UNPROCESSABLE_ENTITY)
    public void odd(OddException e) {
    }
}
'''


def test_statuses_of_exceptions(spark):
    pom = "<project><groupId>a</groupId><artifactId>shop</artifactId></project>"
    texts = {"shop/pom.xml": pom, "shop/src/Items.java": API, "shop/src/Stock.java": STOCK, "shop/src/Advice.java": ADVICE, **{f"shop/src/{k}.java": f"package shop.faults;\n\n{v}" for k, v in FAULTS.items()}}
    other = {"pom.xml": pom.replace("shop", "other"), "TakenException.java": "package x;\n\n@ResponseStatus(HttpStatus.NOT_FOUND)\npublic class TakenException extends RuntimeException {\n}\n"}
    files = spark.createDataFrame([("a", p, t) for p, t in texts.items()] + [("b", p, t) for p, t in other.items()], "repo string, path string, content string")
    got = {(r["method"], r["path"]): r["errors"] for r in scan.scan(files).operations.collect()}
    assert got == {("GET", "/items/{id}"): [410], ("POST", "/items"): [400, 409, 422], ("DELETE", "/items/{id}"): [403]}


def test_reading_exceptions():
    kotlin = 'package a\n\n@ResponseStatus(HttpStatus.NOT_FOUND)\nclass LostException : RuntimeException()\n\nclass A {\n    fun f() {\n        throw LostException("x")\n    }\n}\n'
    assert [(r["kind"], r["name"], r["status"]) for r in faults.faults("a.kt", kotlin)] == [("status", "LostException", 404), ("throw", "LostException", None)]
    mapper = "package a;\n\npublic class M implements ExceptionMapper<b.OddException> {\n    public Response toResponse(OddException e) {\n        return Response.status(418).build();\n    }\n}\n"
    assert [(r["kind"], r["name"], r["status"]) for r in faults.faults("M.java", mapper)] == [("advice", "OddException", 418)]
    for odd in ("", "{", '"', "throw new ", "throw new X(", "@ExceptionHandler", "class A implements ExceptionMapper<", "\x00é" * 9, "throw new X(" * 50):
        for path in ("A.java", "a.kt", "a.py"):
            faults.faults(path, odd)


def test_services_named_in_code_and_replaced_tables(spark):
    serve = 'import express from "express";\nconst app = express();\napp.get("/cats/:id", (req, res) => res.json({}));\napp.listen(80);\n'
    call = 'import express from "express";\nimport axios from "axios";\nconst app = express();\nconst base = process.env["STOCK_API_URL"];\napp.get("/x", async (req, res) => { await axios.get("https://far.example/v1/rates"); });\napp.listen(81);\n'
    package = '{"name": "%s", "dependencies": {"express": "4", "axios": "1"}}\n'
    texts = {"stock/package.json": package % "stock-api", "stock/app.ts": serve, "desk/package.json": package % "desk", "desk/app.ts": call}
    ddl = {"db/1.sql": "CREATE TABLE albums (id INT PRIMARY KEY);\nCREATE TABLE covers (id INT PRIMARY KEY);\n", "m/models.py": 'from sqlalchemy import Column, Integer\nclass Album(Base):\n    __tablename__ = "album"\n    id = Column(Integer, primary_key=True)\n'}
    gate = "spring:\n  application:\n    name: front\n  cloud:\n    gateway:\n      routes:\n        - id: a\n          uri: lb://cats\n          predicates:\n            - Path=/cats/**\n        - id: b\n          uri: http://nobody:80\nzuul:\n  routes:\n    d:\n      path: /desk/**\n      url: http://far:80\n      serviceId: desk\n"
    texts |= {"gate/pom.xml": "<project><groupId>a</groupId><artifactId>gate</artifactId></project>", "gate/src/main/resources/application.yml": gate, "stock/src/main/resources/application.properties": "spring.application.name=cats\n"}
    composed = {"docker-compose.yml": "services:\n  x:\n    image: redis\n"}
    rows = [("a", p, t) for p, t in {**texts, **ddl}.items()] + [("b", p, t) for p, t in {**texts, **composed}.items()]
    model = scan.scan(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert [tuple(r) for r in model.relationships.where("label = 'HTTP'").select("repo", "source", "target", F.col("evidence")[0]["start_line"]).collect()] == [("a", "desk", "stock-api", 4)]
    assert sorted(tuple(r) for r in model.relationships.where("repo = 'a' and label like 'routes%'").select("source", "target", "label", F.col("evidence")[0]["start_line"]).collect()) == [("gate", "desk", "routes /desk/**", 18), ("gate", "stock-api", "routes /cats/**", 8)]
    assert sorted(r["table"] for r in model.entities.where("repo = 'a'").collect()) == ["album", "covers"]
    assert [(r["target"], r["unit"], r["calls"]) for r in scan.unresolved(model).where("repo = 'a'").collect()] == [("far.example", "desk", 1)]
