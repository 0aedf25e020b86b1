"""Parsers of manifests, configuration, deployment, schemas and specifications on small texts of our own."""

from __future__ import annotations

import json

import pytest

from factloom.sources import catalog, config, deploy, git, manifests, schemas, specs
from factloom.sources.files import coverage, read_tree, refuse_unread, walk


def names(text, path):
    return [(d["name"], d["line"], d["dev"]) for d in manifests.parse(path, text)[0]["dependencies"]]


def test_manifests():
    assert names('[package]\nname = "a"\n[dependencies]\naxum = "0.7"\n[dev-dependencies]\nrand = "0.8"\n', "x/Cargo.toml") == [("axum", 4, False), ("rand", 6, True)]
    assert names('{"name": "w",\n "dependencies": {\n  "pg": "8"},\n "devDependencies": {"vite": "5"}}', "package.json") == [("pg", 3, False), ("vite", 4, True)]
    assert names("module m\n\nrequire (\n\tgithub.com/a/b/v2 v2.0.0\n\tgithub.com/c/d v1 // indirect\n)\n", "go.mod") == [("github.com/a/b/v2", 4, False), ("github.com/c/d", 5, False)]
    assert names('[project]\nname = "p"\ndependencies = [\n  "psycopg[binary]>=3",\n  "fastapi",\n]\n', "pyproject.toml") == [("psycopg", 4, False), ("fastapi", 5, False)]
    assert names("# c\nflask==3\n-r other.txt\nredis ; python_version > '3'\n", "s/requirements.txt") == [("flask", 2, False), ("redis", 4, False)]
    pom = "<project><artifactId>a</artifactId><dependencies>\n<dependency><groupId>g</groupId>\n<artifactId>x</artifactId></dependency></dependencies></project>"
    assert names(pom, "pom.xml") == [("g:x", 3, False)] and manifests.maven(pom)["is_workspace_root"] is False
    assert names("plugins { id 'java' }\ndependencies {\n  implementation 'g:a:1'\n  testImplementation(\"g:t:2\")\n  implementation project(':lib')\n}", "build.gradle")[:3] == [("g:a", 3, False), ("g:t", 4, True), ("lib", 5, False)]
    assert names('<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup>\n<PackageReference Include="Npgsql" /></ItemGroup></Project>', "A/A.csproj") == [("microsoft.net.sdk.web", 1, False), ("Npgsql", 2, False)]
    with pytest.raises(ValueError):
        manifests.maven('<!DOCTYPE x [<!ENTITY a "b">]><project/>')


def test_a_broken_manifest_is_a_row_not_a_failure(spark):
    files = spark.createDataFrame([("r", "a/package.json", "{"), ("r", "b/package.json", '{"name": "b"}'), ("r", "c/package.json", None)], "repo string, path string, content string")
    got = {r["path"]: (r["name"], r["error"] is None) for r in manifests.manifests(files).collect()}
    assert got == {"a/package.json": (None, False), "b/package.json": ("b", True)}


def test_catalogue():
    assert catalog.infra_of_package("github.com/jackc/pgx/v5/pgxpool") == "postgres" and catalog.infra_of_package("github.com/jackc/pgxfoo") is None
    assert catalog.infra_of_image("docker.io/bitnami/postgresql:16") == "postgres" and catalog.infra_of_image("prom/postgres-exporter") is None and catalog.infra_of_image("redpandadata/redpanda:v1") == "kafka"
    assert catalog.import_package("@scope/pkg/sub") == "@scope/pkg" and catalog.import_package("stripe.checkout") == "stripe" and catalog.framework_of_namespace("io.ktor.server.routing.get") == ("Ktor", "http-server")


def test_config():
    assert config.flatten_yaml("a:\n  b: [1, {c: x}]\n---\nd: e\n") == [("a.b[0]", "1", 2), ("a.b[1].c", "x", 2), ("d", "e", 4)]
    assert config.flatten_properties("# c\na.b = 1\\\n  2\nc:d\n") == [("a.b", "12", 2), ("c", "d", 4)]
    assert config.dotenv("export A='x y' # z\nB=1 # q\n#C=2\n") == [("A", "x y"), ("B", "1")]
    assert config.placeholder("${X:-${Y:z}}/${K}", {"K": "k"}) == "z/k"


def test_compose_and_kubernetes(spark):
    base = "services:\n  api:\n    build: ./api\n    depends_on: [db]\n    ports: ['80:80']\n    environment: {DB: 'postgres://db/x'}\n  db:\n    image: postgres:16\n"
    got = {s["name"]: s for s in deploy.compose("docker-compose.yml", base)}
    assert got["api"]["build_dir"] == "api" and got["api"]["publishes_ports"] and got["api"]["depends_on"] == ["db"] and got["db"]["line"] == 7
    files = spark.createDataFrame([("r", "compose.yml", base), ("r", "compose.prod.yml", "services:\n  api: {}\n  cache: {image: redis}\n"), ("r", "k8s/all.yaml", K8S)], "repo string, path string, content string")
    assert [tuple(r) for r in deploy.overlays(deploy.compose_services(files)).select("variant", "adds", "changes").collect()] == [("prod", ["cache"], ["api"])]
    links = deploy.topology_links(deploy.workloads(files))
    want = {("edge", "api", "routes"), ("api", "api-pod", "selects"), ("db", "db-pod", "selects"), ("api-pod", "db-pod", "calls")}
    assert {tuple(r) for r in links.collect()} == {("r", "default", *w) for w in want}
    other = K8S.replace("metadata: {", "metadata: {namespace: far, ").replace("db:5432", "db.default:5432")
    both = files.unionByName(spark.createDataFrame([("s", "k8s/all.yaml", K8S), ("r", "k8s/far.yaml", other)], files.schema))
    got = {tuple(r) for r in deploy.topology_links(deploy.workloads(both)).collect()}
    assert {r[2:] for r in got if r[0] == "s"} == want and {r[2:] for r in got if r[:2] == ("r", "far")} == want
    assert {r[2:] for r in got if r[:2] == ("r", "default")} == want
    assert deploy.render_values("image: {{ .Values.image.name | quote }}:{{ .Values.tag | default \"v1\" }}", {"image": {"name": "x"}}) == "image: x:v1" and deploy.render_values("{{ if .Values.a }}x{{ end }}", {}) is None


K8S = """
apiVersion: apps/v1
kind: Deployment
metadata: {name: api-pod}
spec: {replicas: 2, template: {metadata: {labels: {app: api}}, spec: {containers: [{image: api, env: [{name: DB, value: "postgres://db:5432/x"}]}]}}}
---
kind: Deployment
metadata: {name: db-pod}
spec: {template: {metadata: {labels: {app: db, v: "1"}}}}
---
kind: Service
metadata: {name: api}
spec: {selector: {app: api}}
---
kind: Service
metadata: {name: db}
spec: {selector: {app: db}}
---
kind: Ingress
metadata: {name: edge}
spec: {rules: [{http: {paths: [{backend: {service: {name: api}}}]}}]}
"""


def test_sql_schema():
    sql = """-- +goose Up
CREATE TYPE mood AS ENUM ('ok', 'bad');
CREATE TABLE IF NOT EXISTS "shop"."parts" (
  id BIGSERIAL PRIMARY KEY, -- a, comment
  state TEXT NOT NULL DEFAULT 'new' CHECK (state IN ('new', 'sold')),
  m mood,
  price NUMERIC(10, 2) CHECK (price > 0),
  owner_id INT,
  FOREIGN KEY (owner_id) REFERENCES owners (oid)
);
ALTER TABLE parts ADD COLUMN note TEXT, ADD CONSTRAINT u UNIQUE (note);
-- +goose Down
DROP TABLE parts;
"""
    (t,) = schemas.sql_tables(sql)
    assert t["table"] == "parts" and t["line"] == 3
    cols = {c["name"]: c for c in t["columns"]}
    assert list(cols) == ["id", "state", "m", "price", "owner_id", "note"]
    assert cols["id"]["primary_key"] and not cols["id"]["nullable"] and cols["state"]["default"] == "'new'" and cols["owner_id"]["references"] == "owners.oid" and cols["note"]["unique"] and cols["price"]["type_name"] == "NUMERIC(10, 2)"
    assert {v["column"]: v["values"] for v in t["values_of"]} == {"state": ["new", "sold"], "m": ["ok", "bad"]}


def test_other_schemas():
    prisma = 'enum S {\n  A\n  B\n}\nmodel User {\n  id Int @id @default(autoincrement())\n  s S\n  posts Post[]\n  @@map("users")\n}\nmodel Post {\n  id Int @id\n  user User @relation(fields: [uid], references: [id])\n  uid Int\n}\n'
    made = {t["table"]: t for t in schemas.prisma(prisma)}
    assert [c["name"] for c in made["users"]["columns"]] == ["id", "s"] and made["users"]["values_of"] == [{"column": "s", "values": ["A", "B"]}]
    assert {c["name"]: c["references"] for c in made["Post"]["columns"]} == {"id": None, "uid": "users.id"}
    alembic = "import sqlalchemy as sa\ndef upgrade():\n    op.create_table('t', sa.Column('id', sa.Integer(), primary_key=True), sa.Column('o', sa.Integer(), sa.ForeignKey('x.id'), nullable=False))\n    op.add_column('t', sa.Column('n', sa.String(9)))\n    op.drop_column('t', 'o')\ndef downgrade():\n    op.drop_table('t')\n"
    (t,) = schemas.alembic(alembic)
    assert [(c["name"], c["nullable"]) for c in t["columns"]] == [("id", False), ("n", True)]
    xml = '<databaseChangeLog xmlns="x"><changeSet><createTable tableName="t"><column name="id" type="int"><constraints primaryKey="true"/></column><column name="a" type="int"/></createTable><addColumn tableName="t"><column name="b" type="int"/></addColumn><dropColumn tableName="t" columnName="a"/></changeSet></databaseChangeLog>'
    assert [[c["name"] for c in t["columns"]] for t in schemas.liquibase(xml, "a.xml")] == [["id", "b"]]
    assert schemas.includes("databaseChangeLog:\n- include: {file: a.xml}\n- include: {file: b.xml}\n", "m.yaml") == ["a.xml", "b.xml"]


def test_specs(spark):
    text = "# T\n### Requirement: Buy\n- WHEN POST /orders/{id} THEN 201\n- otherwise 409\n### Requirement: Prose only\nnothing\n"
    files = spark.createDataFrame([("r", "specs/shop/spec.md", text)], "repo string, path string, content string")
    got = sorted(((r["requirement"], r["method"], r["path"], sorted(r["statuses"])) for r in specs.declared(files).collect()), key=repr)
    assert got == sorted([("Buy", "POST", "/orders/{id}", [201, 409]), ("Prose only", None, None, [])], key=repr) or got == [("Buy", "POST", "/orders/{id}", [201, 409])]
    assert specs.summary("# T\n\n[![b](x)](y)\n\n- list\n\nA **tool** for [x](y)\nof use.\n\nMore.") == "A tool for x of use."
    assert specs.pin("a b.py:3-9") == ("a b.py", 3, 9) and specs.authored("{")[1] and specs.authored('{"operations": {"x": {}}}')[0]["operations"] == {"x": {}}
    for bad in ("a.py", "a.py:0", "a.py:5-3"):
        with pytest.raises(ValueError):
            specs.pin(bad)
    assert [e["release"] for e in specs.history('[{"release": "1", "date": "2020"}]', {"release": "2", "date": "2021"})] == ["2", "1"]


def test_diagram_documents():
    good = {"version": "1.0.0", "diagramType": "container", "title": "T", "theme": "editorial-dark", "metadata": {"targetRepo": ".", "generatedAt": "x"}, "containers": [], "nodes": [{"id": "a", "label": "A", "isKeyFocalPoint": True}], "edges": []}
    assert specs.diagram_errors(json.dumps(good)) == []
    for change, at in (({"theme": "x"}, "$.theme"), ({"more": 1}, "$.more"), ({"nodes": [{"id": "a", "label": "A"}]}, "$.nodes[0]"), ({"nodes": [{**good["nodes"][0], "evidence": {"filePath": "f", "startLine": 1.5, "endLine": 2}}]}, "$.nodes[0].evidence.startLine")):
        assert [p for p, _ in specs.diagram_errors(json.dumps(good | change))] == [at]
    assert specs.diagram_errors("{")[0][0] == "$" and specs.json_schema()["additionalProperties"] is False


def test_walk_and_coverage(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "tests/b.py": "", ".gitignore": "out/\n*.tmp\n", "out/c.py": "", "d.tmp": "", "e.cpp": "", ".hidden/f.py": "", "g_test.go": "", "src/main/java/test/H.java": "class H {}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert walk(str(tmp_path))["paths"] == ["a.py", "bad.py", "e.cpp", "src/main/java/test/H.java"]
    files = read_tree(spark, str(tmp_path))
    row = coverage(files).first()
    assert (row["read"], row["unread"], row["census"], row["share"]) == (3, 1, "1 C++", 0.75) and files.where("content is null").count() == 1
    refuse_unread(files)
    with pytest.raises(ValueError):
        refuse_unread(files.where("path = 'e.cpp'"))
    assert coverage(files.where("false")).first()["share"] == 1.0


def test_hunks():
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n@@ -9 +10,0 @@ f\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert git.parse_hunks(diff) == [("x", 1, 3), ("x", 10, 10)]


def test_a_store_is_read_by_the_rules_of_a_tree(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.sources import files

    kept = ["a/src/x.py", "a/src/main/java/test/B.java", "b/c d.ts"]
    gone = {"a/tests/y.py": "folder", "a/src/x_test.go": "test", "b/node_modules/z.js": "built", "b/conftest.py": "test", "b/f.spec.ts": "test", "a/test/src/main/java/C.java": "folder", "a/big.py": "oversized"}
    for p in [*kept, *gone]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * (files.MAX_BYTES + 1 if p.endswith("big.py") else 3))
    (tmp_path / "b/odd.py").write_bytes(b"\xff")
    repo = F.substring_index("path", "/", 1)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted(tuple(r) for r in files.read_store(spark, root, repo).collect()) == sorted([*((p[0], p, "xxx") for p in kept), ("b", "b/odd.py", None)], key=lambda r: r[:2])
    counts = {r["reason"]: r["files"] for r in files.store_left_out(spark, str(tmp_path)).collect()}
    assert counts == {w: list(gone.values()).count(w) for w in set(gone.values())}
    assert sorted(files.walk(str(tmp_path))["paths"]) == sorted([*kept, "b/odd.py"])
