"""Modules, command surfaces, patches, remedies and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.extract.commands import commands
from factloom.extract.models import models
from factloom.functions.json_patch import apply
from factloom.plans import modules, scan, validate
from factloom.streaming import watch

TREE = {
    "go.mod": "module example.org/shop\n", "cmd/shop/main.go": 'package main\nimport "example.org/shop/internal/core"\nfunc main() { core.Run() }\n', "internal/core/core.go": 'package core\nimport "example.org/shop/store"\nfunc Run() { store.Get() }\n', "store/store.go": "package store\nfunc Get() {}\n",
    "web/package.json": '{"name": "web"}', "web/src/a/index.ts": 'import { b } from "../b/thing";\nimport { c } from "../lib/internal/c";\nexport const a = b;\n', "web/src/b/thing.ts": "export const b = 1;\n", "web/src/lib/internal/c.ts": "export const c = 1;\n",
}


@pytest.fixture(scope="module")
def model(spark):
    return scan.scan(spark.createDataFrame([("r", p, t) for p, t in TREE.items()], "repo string, path string, content string"))


def test_imports_resolve_and_modules_depend(model):
    got = {(r["path"], r["target"]) for r in modules.resolved(model).collect()}
    assert got == {("cmd/shop/main.go", "internal/core/core.go"), ("internal/core/core.go", "store/store.go"), ("web/src/a/index.ts", "web/src/b/thing.ts"), ("web/src/a/index.ts", "web/src/lib/internal/c.ts")}
    assert {(r["source"], r["target"]): r["weight"] for r in modules.dependencies(model).where("unit = 'shop'").collect()} == {("cmd/shop", "internal/core"): 1, ("internal/core", "store"): 1}
    assert [(r["from"], r["to"]) for r in modules.violations(model).collect()] == [("web/src/a", "web/src/lib/internal")]
    assert {r["module"]: r["is_entry"] for r in modules.modules(model).where("unit = 'shop'").collect()} == {"cmd/shop": True, "internal/core": False, "store": False}


def test_python_imports():
    assert modules.candidates("a/b/c.py", "..x.y") == ["a/x/y.py", "a/x/y/__init__.py"] and modules.candidates("a/b.py", ".") == ["a/__init__.py", "a/"]


def test_command_surface():
    text = '#[derive(Parser)]\n#[command(name = "tool")]\n/// Does things.\nstruct Cli {\n    /// How much.\n    #[arg(long, default_value_t = 3)]\n    how_much: u32,\n    #[command(subcommand)]\n    command: Command,\n}\n#[derive(Subcommand)]\nenum Command {\n    /// Builds.\n    BuildAll { path: String, #[arg(long)] fast: bool },\n    Check(CheckArgs),\n}\n#[derive(Args)]\nstruct CheckArgs { #[arg(long)] out: Option<String> }\n'
    got = {c["name"]: (c["program"], [(a["name"], a["kind"], a["required"], a["default"]) for a in c["args"]]) for c in commands("a.rs", text)}
    assert got == {"": ("tool", [("--how-much", "option", False, "3")]), "build-all": ("tool", [("path", "argument", True, None), ("--fast", "flag", False, None)]), "check": ("tool", [("--out", "option", False, None)])}
    assert commands("a.rs", "fn main() {}") == []


def test_shapes_of_each_language():
    given = {
        "a.py": "from pydantic import BaseModel, Field\nclass A(BaseModel):\n    x: int = Field(..., gt=0, alias='X')\n    y: str | None = None\n", "a.ts": "export interface A { X: number; y?: string }\n", "a.go": 'package a\ntype A struct {\n\tX int `json:"X"`\n\tY string `json:"y,omitempty"`\n\tz int\n}\n',
        "a.rs": '#[derive(Serialize)]\nstruct A { #[serde(rename = "X")] x: i32, y: Option<String> }\n', "A.java": 'record A(@JsonProperty("X") int x, String y) {}\n', "a.kt": 'data class A(@JsonProperty("X") val x: Int, val y: String? = null)\n', "A.cs": "public record A(int X, string? Y);\n",
    }
    for path, text in given.items():
        (a,) = models(path, text)
        assert a["name"] == "A" and [f["name"].lower() for f in a["fields"]] == ["x", "y"] and a["fields"][0]["required"], path
    assert models("a.py", given["a.py"])[0]["fields"][0]["rules"] == ["gt 0"] and models("a.ts", given["a.ts"])[0]["fields"][1]["required"] is False


def test_json_patch():
    given = {"a": [1, 2], "b/c": {"d": 1}}
    ops = [{"op": "add", "path": "/a/1", "value": 9}, {"op": "add", "path": "/a/-", "value": 3}, {"op": "remove", "path": "/a/0"}, {"op": "replace", "path": "/b~1c/d", "value": 2}]
    assert apply(given, ops) == {"a": [9, 2, 3], "b/c": {"d": 2}} and given["a"] == [1, 2]
    for bad in ({"op": "remove", "path": "/x"}, {"op": "replace", "path": "/a/7", "value": 0}, {"op": "move", "path": "/a"}, {"op": "add", "path": "a", "value": 1}):
        with pytest.raises((KeyError, IndexError, ValueError)):
            apply(given, [bad])


def test_findings(spark):
    nodes = [("d", f"n{i}", None, "L", None, None, i == 0, None, 0) for i in range(24)] + [("s", "a", "gone", "x" * 40, None, None, True, "initial", 0), ("s", "b", "box", "B", None, None, True, "terminal", 20), ("s", "b", None, "B", None, None, True, None, 0), ("s", "c", None, "C", None, None, False, None, 0)]
    n = spark.createDataFrame(nodes, "diagram string, id string, container_id string, label string, subtitle string, tech_stack string, is_key_focal_point boolean, state_kind string, attributes int").withColumn("diagram_type", F.when(F.col("diagram") == "s", "lifecycle").otherwise("container"))
    edges = [("d", i, f"e{i}", "n0", f"n{i}", "x", False, None, None) for i in range(1, 20)] + [("s", 0, "e0", "a", "b", None, True, 1, None), ("s", 1, "e1", "b", "a", None, True, 1, None), ("s", 2, "e2", "a", "zz", "l", False, None, "1:n"), ("s", 3, "e3", "a", "a", "l", False, None, None), ("s", 4, "e4", "a", "b", "l", False, None, None)]
    e = spark.createDataFrame(edges, "diagram string, pos int, id string, source string, target string, label string, is_primary_path boolean, sequence int, cardinality string").withColumn("diagram_type", F.when(F.col("diagram") == "s", "lifecycle").otherwise("container"))
    c = spark.createDataFrame([("s", "box"), ("s", "empty")], "diagram string, id string")
    got = {(r["diagram"], r["code"]) for r in validate.validate(c, n, e).collect()}
    assert {x for d, x in got if d == "s"} >= {"ERR_DUPLICATE_ID", "ERR_UNKNOWN_CONTAINER", "WARN_EMPTY_CONTAINER", "ERR_MISSING_ENDPOINT", "ERR_SELF_LOOP", "WARN_DUPLICATE_EDGE", "ERR_ORPHAN_NODE", "ERR_ACCENT_OVERUSE", "WARN_LABEL_TOO_LONG", "ERR_TERMINAL_HAS_TRANSITIONS", "WARN_UNREACHABLE_STATE", "WARN_UNLABELED_TRANSITION"}
    assert ("d", "WARN_HIGH_DENSITY") in got and ("d", "ERR_ORPHAN_NODE") in got
    plain = e.where("diagram = 's'").withColumn("label", F.lit(None).cast("string"))
    assert [r["code"] for r in validate.cycle_checks(plain).collect()] == ["ERR_UNLABELED_CYCLE"] and validate.cycle_checks(e.where("diagram = 'd'")).count() == 0
    assert {r["code"] for r in validate.entity_checks(n.where("diagram = 's'"), e.where("diagram = 's'")).collect()} == {"WARN_ENTITY_WITHOUT_ATTRIBUTES", "ERR_TOO_MANY_ATTRIBUTES", "WARN_MISSING_CARDINALITY"}
    assert {r["code"] for r in validate.sequence_checks(n, e.where("diagram = 's'")).collect()} == {"ERR_TOO_MANY_PARTICIPANTS", "ERR_SEQUENCE_MISSING", "ERR_SEQUENCE_DUPLICATE"}
    light = validate.remedies(n.where("diagram = 'd'"), e.where("diagram = 'd'")).collect()
    assert light[0]["text"] == "19 nodes like n1 as one" and light[0]["saves"] == 36


def test_evidence_states(spark):
    cited = spark.createDataFrame([("1", "", "/etc/x", 1, 1, None), ("2", "", "a/../x", 1, 1, None), ("3", "", "none", 1, 1, None), ("4", "", "f", 2, 9, None), ("5", "", "f", 1, 1, "m.gone"), ("6", "", "f", 1, 2, "m::two"), ("7", "", "g", 1, 1, None), ("8", "", "f", 3, 3, None), ("9", "", "f", 0, 1, None)], "id string, repo string, path string, start int, end int, symbol string")
    files = spark.createDataFrame([("", "f", ["one", "two", "three"], True), ("", "g", ["x"], False)], "repo string, path string, lines array<string>, tracked boolean")
    hunks = spark.createDataFrame([("", "f", 3, 3)], "repo string, path string, lo int, hi int")
    got = {r["id"]: r["state"] for r in validate.evidence_checks(cited, files, hunks).collect()}
    assert got == {"1": "outside-repo", "2": "outside-repo", "3": "file-missing", "4": "line-out-of-range", "5": "symbol-mismatch", "6": "verified", "7": "untracked", "8": "stale", "9": "line-out-of-range"}


def test_streams(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"repo": "r", "path": "a.py", "content": t, "version": v}) for v, t in ((1, "x = 1"), (2, "def f(): pass"))))
    q = watch.follow(watch.changed_files(spark, str(folder)), str(tmp_path / "ck"), lambda df, n: seen.extend(df.collect()))
    q.awaitTermination(120)
    assert [(r["path"], r["version"], [s["name"] for s in r["symbols"]]) for r in seen] == [("a.py", 2, ["f"])]
    (folder / "2.json").write_text(json.dumps({"repo": "r", "path": "b.py", "content": "y = 2", "version": 1}))
    watch.follow(watch.changed_files(spark, str(folder)), str(tmp_path / "ck"), lambda df, n: seen.extend(df.collect())).awaitTermination(120)
    assert [r["path"] for r in seen] == ["a.py", "b.py"]
    src = tmp_path / "ev"
    spark.createDataFrame([("2024-01-01 00:01:00", "u"), ("2024-01-01 00:02:00", "u"), ("2024-01-01 00:20:00", "u")], "at string, key string").selectExpr("cast(at as timestamp) at", "key").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("at timestamp, key string").parquet(str(src))
    out = watch.windowed(stream, "at", ["key"]).writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [1, 2]
