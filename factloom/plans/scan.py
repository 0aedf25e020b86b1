"""The fact model of systems: from files to units, infrastructure, relationships, operations, calls, entities and states.

`files` may hold many repositories; every table carries `repo`, and nothing is ever compared across repositories except
by :func:`cross_repo`. Parsing is per file, the readers of operations per unit; all else are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.extract import api, code, commands, data, events, faults
from factloom.extract import models as shapes
from factloom.operators import aggregates, joins, sets, types, walks
from factloom.operators.cut import cut
from factloom.plans import states
from factloom.sources import catalog, config, deploy, manifests, schemas, specs
from factloom.sources.files import _arrow, extract, with_language

#: What a unit does to a third party; fixed values.
VERBS = {"stripe": "charges cards", "sendgrid": "sends email", "twilio": "sends messages", "openai": "calls LLM", "anthropic": "calls LLM", "slack": "posts messages", "smtp": "sends email"}


@dataclass
class Model:
    """The tables of a scan."""

    files: DataFrame
    facts: DataFrame
    units: DataFrame
    infra: DataFrame
    relationships: DataFrame
    operations: DataFrame
    models: DataFrame
    excluded: DataFrame
    client_calls: DataFrame
    entities: DataFrame
    accesses: DataFrame
    state_machines: DataFrame
    transitions: DataFrame
    events: DataFrame
    flows_input: DataFrame
    vendor_files: DataFrame
    workloads: DataFrame
    topology: DataFrame
    overlays: DataFrame
    configuration: DataFrame
    summaries: DataFrame
    commands: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def evidence(path: Column, start: Column, end: Column | None = None, symbol: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(path.alias("file_path"), start.cast("int").alias("start_line"), (end if end is not None else start).cast("int").alias("end_line"), (symbol if symbol is not None else none).alias("symbol_name"), none.alias("note"), none.alias("repo"))


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def units_of(files: DataFrame, built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units (repo, unit, name, root, manifest, language) and owners (repo, path, unit) of source files.

    A manifest is a unit unless it is only a workspace root; several in one folder are one unit, the first by path.
    Files below no manifest belong to their top folder. A second unit of one name gets `-2`, by root order.
    """
    own = built.where("error is null").where(~F.col("is_workspace_root") | (F.size("dependencies") > 0))
    first = Window.partitionBy("repo", "dir").orderBy(F.when(F.col("path").endswith("requirements.txt"), 1).otherwise(0), "path")
    own = own.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    short = F.element_at(F.split(F.regexp_replace("name", r"/v\d+$", ""), "[/:]"), -1)
    own = own.select("repo", F.col("dir").alias("root"), F.col("path").alias("manifest"), short.alias("name"), "language", "dependencies", "description")
    key = F.concat_ws("\u0001", F.coalesce("repo", F.lit("")), "path")
    source = with_language(files).where("language is not null").select("repo", "path", key.alias("key"))
    scoped = source.withColumn("scoped", F.concat_ws("/", F.concat(F.lit("\u0002"), F.coalesce("repo", F.lit(""))), "path"))
    roots = own.select(F.concat_ws("/", F.concat(F.lit("\u0002"), F.coalesce("repo", F.lit(""))), "root").alias("prefix"), F.col("root").alias("owner"))
    owned = joins.longest_prefix(scoped, roots, "key", "scoped", "prefix", "owner").select("repo", "path", "owner")
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("root"))
    owned = owned.withColumn("root", F.coalesce("owner", F.concat(F.lit("\u0003"), top)))
    loose = owned.where("owner is null").select("repo", "root").distinct().select(
        "repo", "root", F.lit(None).cast("string").alias("manifest"), F.substring("root", 2, 1 << 20).alias("name"), F.lit(None).cast("string").alias("language"), F.array().cast(own.schema["dependencies"].dataType).alias("dependencies"), F.lit(None).cast("string").alias("description")
    )
    every = own.unionByName(loose).withColumn("unit", _slug(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("repo", "unit").orderBy("root"))
    every = every.withColumn("unit", F.when(nth == 1, F.col("unit")).otherwise(F.concat_ws("-", "unit", nth.cast("string"))))
    owners = owned.join(every.select(F.col("repo").alias("_r"), F.col("root").alias("_o"), "unit"), F.col("repo").eqNullSafe(F.col("_r")) & (F.col("root") == F.col("_o"))).select("repo", "path", "unit")
    return every, owners


def _looked_up(names: DataFrame, column: str) -> DataFrame:
    """Distinct package or namespace names with infra, framework, role, orm and mcp from the dictionaries."""
    schema = T.StructType([T.StructField(column, T.StringType()), *[T.StructField(n, T.StringType()) for n in ("infra", "framework", "role")], T.StructField("orm", T.BooleanType()), T.StructField("mcp", T.BooleanType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spec in batch.column(0).to_pylist():
                package = catalog.import_package(spec)
                kind = catalog.infra_of_namespace(spec) or catalog.infra_of_package(spec) or catalog.infra_of_package(package)
                framework = catalog.framework_of_namespace(spec) or catalog.framework_of_package(spec) or catalog.framework_of_package(package) or (None, None)
                rows.append({column: spec, "infra": kind, "framework": framework[0], "role": framework[1], "orm": catalog.is_orm(spec) or catalog.is_orm(package), "mcp": catalog.is_mcp_sdk(package)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return names.select(column).where(f"{column} is not null").distinct().mapInArrow(run, schema)


def _unit_rows(files: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """operations and calls (with repo and unit) read from each unit's texts together."""
    both = f"repo string, unit string, what string, o struct<{_inline(api.OPERATION)}>, c struct<{_inline(api.CALL)}>"
    kind = T.StructType.fromDDL(both)
    arrow = _arrow(kind)

    def read(key: tuple, table: pa.Table) -> pa.Table:
        texts = {p: t for p, t in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True) if t is not None}
        operations, calls = api.read_unit(texts)
        repo, unit = table.column("repo")[0].as_py(), table.column("unit")[0].as_py()
        rows = [{"repo": repo, "unit": unit, "what": "o", "o": o, "c": None} for o in operations] + [{"repo": repo, "unit": unit, "what": "c", "o": None, "c": c} for c in calls]
        return pa.Table.from_pylist(rows, schema=arrow)

    owned = files.join(owners.withColumnsRenamed({"repo": "_r", "path": "_p"}), F.col("repo").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p"))).select(F.coalesce("repo", F.lit("")).alias("_k"), "repo", "unit", "path", "content")
    # few bytes, much work: a stated number of partitions isn't coalesced
    session = files.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    found = cut(owned.repartition(tasks, "_k", "unit").groupBy("_k", "unit").applyInArrow(read, kind))
    return found.where("what = 'o'").select("repo", "unit", "o.*"), found.where("what = 'c'").select("repo", "unit", "c.*")


def _inline(ddl: str) -> str:
    """`a string, b int` as the fields of a struct."""
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def _own(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return rows.join(owners.withColumnsRenamed({"repo": "_r", "path": "_p"}), F.col("repo").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p"))).drop("_r", "_p")


def _by_repo(rows: DataFrame) -> DataFrame:
    """`rows` with a repo that joins can use: null becomes the empty text."""
    return rows.withColumn("repo", F.coalesce("repo", F.lit("")))


def scan(files: DataFrame) -> Model:
    """The model of all repositories in `files` (repo, path, content)."""
    files = _by_repo(files)
    facts = cut(code.facts(files))
    built = cut(manifests.manifests(files))
    units, owners = units_of(files, built)
    units, owners = cut(units), cut(owners)
    owned = _own(facts.where("error is null"), owners)

    # infrastructure and frameworks, from manifests and imports
    deps = units.select("repo", "unit", "manifest", F.explode("dependencies").alias("d")).select("repo", "unit", F.col("manifest").alias("path"), F.col("d.name").alias("spec"), F.col("d.line").alias("line"), F.lit("manifest").alias("origin"), F.col("d.dev").alias("dev"))
    imports = owned.select("repo", "unit", "path", F.explode("imports").alias("i")).select("repo", "unit", "path", F.col("i.specifier").alias("spec"), F.col("i.line").alias("line"), F.lit("code").alias("origin"), F.lit(False).alias("dev"))
    named = deps.unionByName(imports)
    uses = cut(named.join(_looked_up(named, "spec"), "spec"))

    # operations, calls, data
    operations, calls = _unit_rows(files, owners)
    reason = _excluded(operations)
    operations = operations.join(reason, "path", "left").withColumn("id", F.concat("unit", F.lit(":"), "method", F.lit(" "), "path"))
    first = Window.partitionBy("repo", "id").orderBy("file", "line")
    operations = operations.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    left_out = operations.where("reason is not null").select("repo", F.col("id").alias("operation"), "reason", evidence(F.col("file"), F.col("line")).alias("evidence"))
    operations = cut(_confidence(operations.where("reason is null").drop("reason").withColumn("evidence", evidence(F.col("file"), F.col("line"), symbol=F.col("handler")))))
    is_source = F.col("path").rlike(r"\.(?:rs|[mc]?tsx?|[mc]?jsx?|go|py|java|kt|cs)$")
    is_migration = F.col("path").rlike(r"(?i)(?:^|/)(?:migrations?|alembic|changelog|db/migrate|versions)/")
    declared = cut(_own(extract(files, data.entities, data.ENTITY, is_source & ~F.col("path").rlike(r"_test\.|/tests?/")), owners).where("error is null"))
    physical = schemas.merged(schemas.tables(files))
    access = _own(extract(files, data.accesses, data.ACCESS, is_source & ~is_migration), owners).where("error is null")
    entities = cut(_entities(declared, physical))
    mapped = entities.select("repo", F.explode("code_names").alias("name"), F.col("table").alias("table"))
    access = cut(access.unionByName(_orm_access(files.where(is_source & ~is_migration), owners, mapped), allowMissingColumns=True))
    classes = cut(_own(extract(files, data.classes, data.CLASS, F.col("path").endswith(".java")), owners).where("error is null"))
    access = cut(access.unionByName(_inherited(classes, mapped), allowMissingColumns=True))
    entities = cut(_without_superseded(entities, access))
    thrown = F.col("path").rlike(r"\.(?:java|kts?)$") & F.col("content").rlike(r"\bthrow\s|ResponseStatus|ExceptionHandler|ExceptionMapper")
    operations = cut(_answered(operations, owned, classes, cut(_own(extract(files, faults.faults, faults.FAULT, thrown), owners).where("error is null"))))
    found = cut(_on_bus(_own(extract(files, events.events, events.EVENT, is_source), owners).where("error is null"), uses))

    shaped = cut(_models(_own(extract(files, shapes.models, shapes.MODEL, is_source), owners).where("error is null")))
    calls = cut(_client_calls(calls, operations, shaped))
    services = cut(_by_repo(deploy.compose_services(files)))
    kinds = _kinds(units, owned, uses, found, files)
    unit_table = cut(_unit_table(units, owned, kinds, services))
    configuration = cut(_by_repo(config.configs(files)).where("error is null").drop("error"))
    infra, relationships = _relationships(unit_table, uses, access, found, calls, services, owned, _routed(configuration, unit_table))
    machines, moves = _states(entities, access)
    sold = [k for k in catalog._KINDS if catalog.describe(k)[2] == "third-party"]
    vendors = uses.where(F.col("infra").isin(sold) & (F.col("origin") == "code")).groupBy("repo", "unit", "path", F.col("infra").alias("target")).agg(F.collect_set("spec").alias("specs"))
    placed = cut(_by_repo(deploy.workloads(files)).where("error is null").drop("error"))
    clean = lambda rows: _by_repo(rows).where("error is null").drop("error")
    return Model(
        files=files.join(owners, ["repo", "path"], "left").select("repo", "path", "unit"), facts=owned, units=unit_table, infra=infra, relationships=relationships, operations=operations, models=_reachable(operations, shaped), excluded=left_out, client_calls=calls,
        entities=entities.drop("code_names"), accesses=access, state_machines=machines, transitions=moves, events=found, flows_input=owned.select("repo", "unit", "path", "symbols", "calls", "types"), vendor_files=vendors,
        workloads=placed, topology=deploy.topology_links(placed.withColumn("error", F.lit(None).cast("string"))), overlays=deploy.overlays(services), configuration=configuration, summaries=clean(specs.readmes(files)),
        commands=clean(commands.surface(files)),
    )


def _on_bus(found: DataFrame, uses: DataFrame) -> DataFrame:
    """`found` with the bus of what is published and consumed: the one that the call is of, else one that its file
    imports, else one that its unit uses; of several the least by name."""
    kinds = [k for k in catalog._KINDS if catalog.describe(k)[2] == "event-bus"]
    used = uses.where(F.col("infra").isin(kinds) & ~F.col("dev"))
    near = used.where("origin = 'code'").groupBy("repo", "unit", "path").agg(F.min("infra").alias("_near"))
    far = used.groupBy("repo", "unit").agg(F.min("infra").alias("_far"), F.collect_set("infra").alias("_all"))
    met = found.join(near, ["repo", "unit", "path"], "left").join(far, ["repo", "unit"], "left")
    bus = F.coalesce(F.when(F.array_contains("_all", F.col("bus")), F.col("bus")), "_near", "_far")
    return met.withColumn("bus", F.when(F.col("kind").isin("publish", "consume"), bus)).select(*found.columns)


def _excluded(operations: DataFrame) -> DataFrame:
    """path, reason of operational routes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([api.excluded(p) for p in paths], pa.string())], names=["path", "reason"])

    return operations.select("path").distinct().mapInArrow(run, "path string, reason string")


def _confidence(operations: DataFrame) -> DataFrame:
    body = F.col("method").isin("POST", "PUT", "PATCH")
    asks, answers = F.col("request_type").isNotNull(), F.col("response_type").isNotNull() | (F.col("success_status") == 204)
    answers = F.coalesce(answers, F.lit(False))
    some = asks | F.exists("params", lambda p: p["location"] != "path")
    grade = F.when(body & asks & answers, "typed").when(body & ~asks & ~answers, "opaque").when(body, "partial").when(answers, "typed").when(some, "partial").otherwise("opaque")
    return operations.withColumn("confidence", grade)


def _entities(declared: DataFrame, physical: DataFrame) -> DataFrame:
    """Entities merged from physical schemas and code, with the code names that map to each."""
    code_rows = declared.select("repo", "table", "unit", "source", F.lit(False).alias("physical"), F.struct("path", "line").alias("pos"), "columns", "values_of", "name")
    real = _by_repo(physical).select("repo", "table", F.lit(None).cast("string").alias("unit"), "source", F.lit(True).alias("physical"), F.struct("path", "line").alias("pos"), "columns", "values_of", F.lit(None).cast("string").alias("name"))
    rows = code_rows.unionByName(real)
    keyed = rows.withColumn("_t", F.col("table")).withColumn("table", F.concat_ws("\u0001", "repo", F.lower("table")))
    merged = aggregates.merge_entities(keyed.select("table", "unit", "source", "physical", "pos", "columns"))
    side = keyed.groupBy("table").agg(
        F.min_by("_t", F.struct((~F.col("physical")).cast("int"), "pos")).alias("_name"), F.array_sort(F.collect_set("name")).alias("code_names"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("physical")).cast("int").alias("k"), "pos", "values_of"))), lambda x: x["values_of"])).alias("values_of"),
        F.min_by("pos", F.struct((~F.col("physical")).cast("int"), "pos")).alias("pos"), F.first("repo").alias("repo"),
    )
    out = merged.join(side, "table")
    return out.select(
        "repo", F.regexp_replace("entity", "\u0001", ":").alias("key"), F.concat(F.lit("entity:"), F.col("_name")).alias("id"), F.col("_name").alias("table"), "source", F.col("declared_by").alias("units"), "columns", "values_of", "code_names", evidence(F.col("pos.path"), F.col("pos.line")).alias("evidence")
    )


def _orm_access(files: DataFrame, owners: DataFrame, mapped: DataFrame) -> DataFrame:
    """Accesses through mapped classes: the classes of a repository travel with its files as one sorted array."""
    names = mapped.groupBy("repo").agg(F.to_json(F.array_sort(F.collect_set(F.struct("name", "table")))).alias("names"))
    schema = T.StructType([T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), *T.StructType.fromDDL(data.ACCESS).fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            rows = []
            for repo, path, content, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [{"repo": repo, "path": path, **r} for r in data.orm_accesses(path, content or "", {x["name"]: x["table"] for x in json.loads(known)})]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    given = files.join(names, "repo").select("repo", "path", "content", "names")
    return _own(given.mapInArrow(run, schema), owners)


def _inherited(classes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Accesses of generic bases, once for every class below that binds the parameter to a mapped class (`through`)."""
    scoped = cut(classes.withColumn("scope", F.concat_ws("\u0001", "repo", "unit")))
    first = scoped.groupBy("scope", F.col("name").alias("class")).agg(F.min_by(F.struct("params", "parent", "args"), F.struct("path")).alias("c")).select("scope", "class", "c.*")
    bound = walks.bound_parameters(first.select("scope", "class", "params"), first.select("scope", "class", "parent", "args"))
    used = scoped.select("repo", "unit", "path", "scope", F.col("name").alias("base"), F.explode("uses").alias("u")).select("repo", "unit", "path", "scope", "base", "u.*")
    met = used.join(bound, ["scope", "base", "param"]).join(mapped.withColumnRenamed("name", "bound"), ["repo", "bound"])
    none = F.array().cast("array<struct<column:string,value:string>>")
    return met.select("repo", "unit", "path", "line", "symbol", "table", "mode", none.alias("sets"), none.alias("wheres"), F.array().cast("array<string>").alias("conditions"), none.alias("inserted"), F.col("sub").alias("through"))


def _without_superseded(entities: DataFrame, access: DataFrame) -> DataFrame:
    """`entities` less tables of migrations that nothing uses and that code declares under their singular or plural."""
    only = F.forall(F.split("source", r"\+"), lambda s: s.isin("ddl", "alembic", "liquibase"))
    gone = sets.superseded(entities.select("repo", "table", only.alias("written")), access.select("repo", "table"))
    return entities.join(gone, ["repo", "table"], "left_anti").select(*entities.columns)


def _answered(operations: DataFrame, owned: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """`operations` with the statuses of what their handlers throw, and of what the methods that these call throw.

    A method called through a receiver counts if it is the only one of its name in the unit that throws. An exception
    without a status of its own has that of the nearest of its class and the classes above: a known one, what the unit
    answers it with, its annotation.
    """
    thrown = found.where("kind = 'throw'").select("repo", "unit", F.col("path").alias("file"), "symbol", "start", "name", "status").distinct()
    if thrown.isEmpty():
        return operations
    methods = owned.select("repo", F.col("path").alias("file"), F.explode("symbols").alias("s")).where("s.kind in ('method', 'function')").select("repo", "file", F.col("s.start_line").alias("line"), F.col("s.end_line").alias("end"))
    spans = operations.select("repo", "unit", "id", "file", "line").join(methods, ["repo", "file", "line"])
    direct = spans.select("repo", "id", "unit", "file", F.col("line").alias("start"))
    only = thrown.select("repo", "unit", "symbol", "file", "start").distinct().groupBy("repo", "unit", "symbol").agg(F.count("*").alias("n"), F.min(F.struct("file", "start")).alias("m")).where("n = 1")
    called = owned.select("repo", F.col("path").alias("file"), F.explode("calls").alias("c")).where(F.col("c.callee").contains(".")).select("repo", "file", F.col("c.line").alias("at"), F.col("c.name").alias("symbol"))
    through = spans.join(called, ["repo", "file"]).where("at between line and end").select("repo", "unit", "id", "symbol").distinct().join(only, ["repo", "unit", "symbol"]).select("repo", "id", "unit", "m.file", "m.start")
    reached = cut(direct.unionByName(through).distinct().join(thrown.drop("unit", "symbol"), ["repo", "file", "start"]))
    homes = owned.select("repo", F.col("path").alias("file"), F.col("unit").alias("home"), "package")
    # an exception asked from one file for one unit is one question, whatever the number of operations
    asks = reached.where("status is null").select("repo", "unit", "file", "name").distinct().join(homes, ["repo", "file"]).select(F.concat_ws("\u0001", "repo", "unit", "file", "name").alias("id"), F.col("repo").alias("scope"), "unit", F.col("file").alias("path"), "package", "name", "home")
    parents = classes.select("repo", "path", "name", F.regexp_extract("parent", r"([^.]+)$", 1).alias("parent")).groupBy("repo", "path", "name").agg(F.min("parent").alias("parent"))
    declared = owned.where("language in ('Java', 'Kotlin')").select("repo", "unit", "path", "package", F.explode("symbols").alias("s")).where("s.kind in ('class', 'interface')").select("repo", "unit", "path", "package", F.col("s.name").alias("name"), F.col("s.start_line").alias("line"))
    declared = declared.join(parents, ["repo", "path", "name"], "left").select(F.col("repo").alias("scope"), F.concat_ws("\u0001", "repo", "path", F.format_string("%09d", "line"), "name").alias("class"), "name", "package", "unit", "path", "parent")
    imports = owned.where("language in ('Java', 'Kotlin')").select(F.col("repo").alias("scope"), "path", F.explode("imports").alias("i")).select("scope", "path", F.col("i.line").alias("pos"), F.col("i.specifier").alias("specifier"))
    said = found.select(F.col("repo").alias("scope"), "unit", "name", F.col("status").alias("value"), F.struct("path", "line").alias("ord"), "kind")
    known = operations.sparkSession.createDataFrame(list(faults.KNOWN.items()), "name string, value int")
    answers = types.inherited(asks, declared, imports, known, said.where("kind = 'advice'"), said.where("kind = 'status'")).where("value is not null").select("id", "value")
    late = reached.where("status is null").select("repo", F.col("id").alias("operation"), F.concat_ws("\u0001", "repo", "unit", "file", "name").alias("id")).join(answers, "id").select("repo", F.col("operation").alias("id"), F.col("value").alias("status"))
    every = reached.where("status is not null").select("repo", "id", "status").unionByName(late).where("status >= 400").groupBy("repo", "id").agg(F.collect_set("status").alias("_more"))
    more = F.array_sort(F.array_distinct(F.concat(F.coalesce("errors", F.array().cast("array<int>")), F.coalesce("_more", F.array().cast("array<int>")))))
    return operations.join(every, ["repo", "id"], "left").withColumn("errors", more).select(*operations.columns)


def unresolved(model: Model) -> DataFrame:
    """repo, target, unit, calls, places: calls that no operation of the model answers, by the host they name (null: none)."""
    left = model.client_calls.where("operation is null")
    said = F.struct("method", "path", "caller", F.col("evidence.file_path").alias("file"), F.col("evidence.start_line").alias("line"))
    return left.groupBy("repo", F.col("target_host").alias("target"), "unit").agg(F.count("*").alias("calls"), F.slice(F.array_sort(F.collect_set(said)), 1, 200).alias("places"))


def _models(found: DataFrame) -> DataFrame:
    """id, unit, name, fields of each unit's shapes: the first definition in path order; parents' fields come first.

    A field of a child replaces its parent's of that name and moves to the end; up to four generations are followed.
    """
    first = F.row_number().over(Window.partitionBy("repo", "unit", "name").orderBy("path", "line"))
    own = found.withColumn("_r", first).where("_r = 1").select("repo", "unit", "name", "path", "line", "fields", "parents")
    out = own.withColumn("above", F.col("parents"))
    for _ in range(4):
        up = own.select("repo", "unit", F.col("name").alias("_p"), F.col("fields").alias("_f"), F.col("parents").alias("_a"))
        met = out.withColumn("_p", F.element_at(F.when(F.size("above") > 0, F.col("above")), 1)).join(up, ["repo", "unit", "_p"], "left")
        more = F.filter(F.coalesce("_f", F.slice("fields", 1, 0)), lambda p: ~F.exists("fields", lambda c: c["name"] == p["name"]))
        out = met.select("repo", "unit", "name", "path", "line", F.concat(more, "fields").alias("fields"), F.coalesce("_a", F.array().cast("array<string>")).alias("above"))
    return out.select("repo", "unit", F.concat("unit", F.lit(":"), "name").alias("id"), "name", "fields", evidence(F.col("path"), F.col("line"), symbol=F.col("name")).alias("evidence"))


def _reachable(operations: DataFrame, shaped: DataFrame) -> DataFrame:
    """The shapes that requests and responses name, and those that their fields' types name, six deep."""
    named = operations.select("repo", "unit", F.explode(F.array_compact(F.array("request_type", "response_type"))).alias("name")).distinct()
    refers = shaped.select("repo", "unit", "name", F.explode("fields").alias("f")).select("repo", "unit", "name", F.explode(F.regexp_extract_all("f.type_name", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))).alias("to")).distinct()
    known = shaped.select("repo", "unit", F.col("name").alias("to"))
    edges = refers.join(known, ["repo", "unit", "to"], "left_semi").where("name <> to")
    seen = front = named
    for _ in range(6):
        front = cut(front.join(edges, ["repo", "unit", "name"]).select("repo", "unit", F.col("to").alias("name")).distinct().join(seen, ["repo", "unit", "name"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return cut(shaped.join(seen.distinct(), ["repo", "unit", "name"], "left_semi"))


def _client_calls(calls: DataFrame, operations: DataFrame, shaped: DataFrame) -> DataFrame:
    """Calls with the operation that each reaches, its unit, and the drift: fields the caller reads that the operation's
    response doesn't declare. Nothing can be said where the response has no known fields, or where the caller's shape is
    the declared one."""
    numbered = calls.withColumn("call_id", F.concat_ws("\u0001", "repo", "unit", "file", F.col("line").cast("string"), "method", "path"))
    ids = operations.select("repo", F.col("id").alias("operation"), "unit", "method", "path", "path_partial")
    asked = numbered.select("repo", "call_id", "unit", "method", "path").distinct()
    met = joins.best_match(asked, ids, "repo").select("call_id", "operation")  # another repository's operations never count
    wire = shaped.select("repo", "unit", "name", F.transform("fields", lambda f: f["name"]).alias("names"))
    expected = F.regexp_replace("response_type", r"^(?:Promise<|Array<|List<|Vec<|list\[)+|\[\]$|>+$|\]$", "")
    own = numbered.join(met, "call_id", "left").withColumn("name", expected).join(wire.withColumnRenamed("names", "wanted"), ["repo", "unit", "name"], "left").drop("name")
    none = F.array().cast("array<string>")
    own = own.withColumn("reads", F.array_distinct(F.concat(F.coalesce("reads", none), F.coalesce("wanted", none)))).drop("wanted")
    served = operations.select("repo", F.col("id").alias("operation"), "unit", F.col("response_type").alias("name")).join(wire.withColumnRenamed("names", "fields"), ["repo", "unit", "name"]).select("repo", "operation", "fields")
    literal = operations.where("response_type is null and size(response_fields) > 0").select("repo", F.col("id").alias("operation"), F.col("response_fields").alias("fields"))
    served = served.unionByName(literal)
    scoped = own.withColumn("operation", F.concat_ws("\u0001", "repo", F.coalesce("operation", F.lit("?"))))
    drifted = sets.drift(scoped, served.select(F.concat_ws("\u0001", "repo", "operation").alias("operation"), "fields"))
    drifted = drifted.withColumn("operation", F.element_at(F.split("operation", "\u0001"), 2)).withColumn("operation", F.when(F.col("operation") != "?", F.col("operation")))
    return drifted.select(
        "repo", "unit", "method", "path", "target_host", F.substring_index("operation", ":", 1).alias("target_unit"), "operation", "caller", "reads", "drift", "response_type", evidence(F.col("file"), F.col("line"), symbol=F.col("caller")).alias("evidence")
    )


def _kinds(units: DataFrame, owned: DataFrame, uses: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """unit kinds: the first rule that applies."""
    used = uses.where("not dev").groupBy("repo", "unit").agg(
        F.bool_or(F.col("role") == "http-server").alias("http"), F.bool_or(F.col("role") == "web-client").alias("web"), F.bool_or(F.col("framework") == "Express").alias("express"), F.bool_or("mcp").alias("mcp"),
        F.array_sort(F.collect_set("framework")).alias("frameworks"),
    )
    facts = owned.groupBy("repo", "unit").agg(
        F.bool_or(F.size("entry_points") > 0).alias("entry"), F.bool_or(F.exists("calls", lambda c: c["name"].startswith("ListenAndServe"))).alias("listens"),
        F.bool_or(F.exists("annotations", lambda a: a["name"].isin("SpringBootApplication", "QuarkusMain", "MicronautApplication"))).alias("application"), F.bool_or(F.col("language").isin("Java", "Kotlin")).alias("jvm"),
    )
    consumes = found.groupBy("repo", "unit").agg(F.bool_or(F.col("kind") == "consume").alias("consumes"))
    on = ["repo", "unit"]
    met = units.select(*on).join(used, on, "left").join(facts, on, "left").join(consumes, on, "left").fillna(False)
    entry = F.when(F.col("jvm"), F.col("application") | (F.col("entry") & ~F.col("http") & ~F.col("consumes"))).otherwise(F.col("entry"))
    consumed = F.col("consumes") & (~F.col("jvm") | F.col("application"))
    kind = (
        F.when(F.col("web") & ~F.col("express"), "web-client").when((F.col("http") | F.col("listens")) & entry, "http-service").when(entry & F.col("mcp"), "mcp-server")
        .when(consumed, "worker").when(entry, "cli").otherwise("library")
    )
    return met.select(*on, kind.alias("kind"), F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"))


def _unit_table(units: DataFrame, owned: DataFrame, kinds: DataFrame, services: DataFrame) -> DataFrame:
    on = ["repo", "unit"]
    totals = owned.groupBy(*on).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    spoken = aggregates.dominant(owned, on, "language", "line_count", "spoken").select(*on, "spoken")
    entries = owned.select(*on, "path", F.explode("entry_points").alias("e")).groupBy(*on).agg(F.array_sort(F.collect_list(evidence(F.col("path"), F.col("e.start_line"), F.col("e.end_line"), F.col("e.symbol")))).alias("entry_points"))
    named = services.where("error is null and variant is null and build_dir is not null").groupBy("repo", F.col("build_dir").alias("root")).agg(F.min("name").alias("compose_service"), F.max(F.col("publishes_ports").cast("int")).alias("_ports"))
    met = units.join(kinds, on).join(totals, on, "left").join(spoken, on, "left").join(entries, on, "left").join(named, ["repo", "root"], "left")
    kind = F.when((F.col("kind") == "cli") & F.col("compose_service").isNotNull() & (F.col("_ports") == 0), "worker").otherwise(F.col("kind"))
    return met.select("repo", F.col("unit").alias("id"), "name", kind.alias("kind"), F.coalesce("spoken", "language").alias("language"), F.when(F.col("root").startswith("\u0003"), F.substring("root", 2, 1 << 20)).otherwise(F.col("root")).alias("root"), "manifest", "frameworks", "description", "entry_points", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("lines", F.lit(0)).alias("lines"), "compose_service")


def _relationships(units: DataFrame, uses: DataFrame, access: DataFrame, found: DataFrame, calls: DataFrame, services: DataFrame, owned: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = units.sparkSession
    known = spark.createDataFrame([(k, *catalog.describe(k)) for k in catalog._KINDS], "kind string, label string, role string, category string")
    sql = F.col("kind").isin("postgres", "mysql", "sqlite")
    images = _imaged(services)
    used = uses.where("infra is not null and not dev").select("repo", "unit", F.col("infra").alias("kind"), "origin", evidence(F.col("path"), F.col("line")).alias("evidence"))
    infra = used.groupBy("repo", "kind").agg(F.array_sort(F.collect_set("unit")).alias("used_by"), F.slice(F.array_sort(F.collect_set("evidence")), 1, 6).alias("evidence"))
    infra = infra.join(images.groupBy("repo", "kind").agg(F.min("name").alias("compose_service")), ["repo", "kind"], "full_outer").join(known, "kind")
    said = found.where("kind in ('publish', 'consume') and bus is not null").select("repo", "unit", F.col("bus").alias("kind"), F.col("kind").alias("way"), "name", "path", "line", "symbol")
    topics = said.groupBy("repo", "kind").agg(F.array_sort(F.collect_set("name")).alias("_topics"))
    infra = infra.join(topics, ["repo", "kind"], "left").select("repo", F.col("kind").alias("id"), "kind", "label", "category", "role", F.coalesce("used_by", F.array().cast("array<string>")).alias("used_by"), "evidence", "compose_service", F.when(F.col("category") == "event-bus", F.col("_topics")).alias("topics"))

    per = used.join(known, "kind").groupBy("repo", "unit", "kind", "category").agg(F.min("evidence").alias("evidence"), F.min_by("evidence", F.struct((F.col("origin") != "code").cast("int"), "evidence")).alias("at"), F.max((F.col("origin") == "code").cast("int")).alias("code"))
    tables = access.groupBy("repo", "unit").agg(F.array_sort(F.collect_set(F.when(F.col("mode") == "write", F.col("table")))).alias("w"), F.array_sort(F.collect_set(F.when(F.col("mode") == "read", F.col("table")))).alias("r"), F.min_by(evidence(F.col("path"), F.col("line"), symbol=F.col("symbol")), F.struct(F.when(F.col("mode") == "write", 0).otherwise(1), "path", "line")).alias("seen"))
    store = per.where("category = 'storage'").join(tables, ["repo", "unit"], "left")
    two = lambda c: F.array_join(F.slice(c, 1, 2), ", ")
    writes, reads = sql & (F.size("w") > 0), sql & (F.size("r") > 0)
    storage = store.select(
        "repo", F.col("unit").alias("source"), F.col("kind").alias("target"), F.when(writes, "write").when(reads, "read").otherwise("sync").alias("edge_type"),
        F.when(writes, F.concat(F.lit("writes "), two("w"))).when(reads, F.concat(F.lit("reads "), two("r"))).otherwise(F.lit("connects")).alias("label"), F.when(F.col("code") == 1, "code").otherwise("manifest").alias("origin"), F.when(writes | reads, F.coalesce("seen", "at")).otherwise(F.col("at")).alias("evidence"),
    )
    # a topic that another unit shares on this bus names the relationship, else the least; one that isn't known comes last
    met = said.join(said.groupBy("repo", "kind", "name").agg(F.count_distinct("unit").alias("units")), ["repo", "kind", "name"], "left")
    rank = F.struct(F.col("name").isNull(), F.coalesce(F.col("units"), F.lit(1)) < 2, "name", "path", "line", "symbol")
    shared = met.groupBy("repo", "unit", "kind", "way").agg(F.min_by(F.struct("name", "path", "line", "symbol"), rank).alias("e"))
    bus = per.where("category = 'event-bus'").join(shared, ["repo", "unit", "kind"], "left")
    sends, out = F.col("way") == "publish", F.col("way") == "consume"
    buses = bus.select(
        "repo", F.when(out, F.col("kind")).otherwise(F.col("unit")).alias("source"), F.when(out, F.col("unit")).otherwise(F.col("kind")).alias("target"), F.when(sends | out, "event").otherwise("async").alias("edge_type"),
        F.when(sends, F.concat(F.lit("publishes "), F.coalesce("e.name", F.lit("messages")))).when(out, F.concat(F.lit("delivers "), F.coalesce("e.name", F.lit("messages")))).otherwise(F.lit("connects")).alias("label"), F.when(F.col("code") == 1, "code").otherwise("manifest").alias("origin"),
        F.when(F.col("e").isNotNull(), evidence(F.col("e.path"), F.col("e.line"), symbol=F.col("e.symbol"))).otherwise(F.col("at")).alias("evidence"),
    )
    verbs = F.create_map(*[x for k, v in VERBS.items() for x in (F.lit(k), F.lit(v))])
    vendors = per.where("category = 'third-party'").select("repo", F.col("unit").alias("source"), F.col("kind").alias("target"), F.lit("sync").alias("edge_type"), verbs[F.col("kind")].alias("label"), F.when(F.col("code") == 1, "code").otherwise("manifest").alias("origin"), F.col("at").alias("evidence"))
    called = calls.where("operation is not null").select("repo", F.col("unit").alias("source"), F.col("target_unit").alias("target"), F.lit("sync").alias("edge_type"), F.concat(F.lit("calls "), "path").alias("label"), F.lit("code").alias("origin"), "evidence")
    names = units.where("compose_service is not null").select("repo", F.col("compose_service").alias("name"), F.col("id").alias("element")).unionByName(images.select("repo", "name", F.col("kind").alias("element")))
    depends = services.where("error is null and variant is null").select("repo", "name", "path", "line", F.explode("depends_on").alias("other"))
    a, b = names.select("repo", "name", F.col("element").alias("source")), names.select("repo", F.col("name").alias("other"), F.col("element").alias("target"))
    deployed = depends.join(a, ["repo", "name"]).join(b, ["repo", "other"]).join(units.select("repo", F.col("id").alias("target"), F.lit(True).alias("is_unit")), ["repo", "target"], "left")
    deployed = deployed.where("is_unit").select("repo", "source", "target", F.lit("sync").alias("edge_type"), F.lit("depends on").alias("label"), F.lit("compose").alias("origin"), evidence(F.col("path"), F.col("line")).alias("evidence"))
    libraries = uses.where("origin = 'manifest'").select("repo", F.col("unit").alias("source"), F.lower(F.element_at(F.split("spec", "[/:]"), -1)).alias("name"), "path", "line").join(units.where("kind = 'library'").select("repo", F.lower("name").alias("name"), F.col("id").alias("target")), ["repo", "name"])
    libraries = libraries.select("repo", "source", "target", F.lit("sync").alias("edge_type"), F.lit("uses").alias("label"), F.lit("manifest").alias("origin"), evidence(F.col("path"), F.col("line")).alias("evidence"))
    # variables and addresses that name a service, where no compose file says what depends on what
    literals = owned.join(services.where("error is null").select("repo").distinct(), "repo", "left_anti").select("repo", "unit", "path", F.explode("strings").alias("s")).select("repo", "unit", F.struct("path", "s.line").alias("pos"), F.col("s.value").alias("value"))
    named = joins.named_services(literals, units.where("kind = 'http-service'").select("repo", F.col("id").alias("service")))
    linked = named.select("repo", F.col("unit").alias("source"), F.col("service").alias("target"), F.lit("sync").alias("edge_type"), F.lit("HTTP").alias("label"), F.lit("code").alias("origin"), evidence(F.col("pos.path"), F.col("pos.line")).alias("evidence"))
    # the order of kinds of evidence decides which one names a relationship
    rows = None
    for n, part in enumerate((storage, buses, vendors, called, libraries, routed, linked, deployed)):
        part = part.withColumn("_k", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("seq", F.struct("_k", "label", "evidence")).drop("_k")
    scoped = rows.select(F.concat_ws("\u0001", "repo", "source").alias("source"), F.concat_ws("\u0001", "repo", "target").alias("target"), "edge_type", "label", "origin", "evidence", "seq")
    merged = aggregates.merge_relationships(scoped)
    end = lambda c: F.element_at(F.split(c, "\u0001"), 2)
    out = merged.select(F.element_at(F.split("source", "\u0001"), 1).alias("repo"), end("source").alias("source"), end("target").alias("target"), "edge_type", "label", "sources", "evidence")
    return cut(infra), cut(out.withColumn("id", F.concat_ws("--", "source", "target")))


def _routed(configuration: DataFrame, units: DataFrame) -> DataFrame:
    """Relationships of gateways with the units that their routes name: by id, name, compose service or application name.

    A configuration file belongs to the unit with the deepest root above it. A name of several units is that of the
    least; the address of a service counts by its whole host.
    """
    repo = F.concat(F.lit("\u0002"), "repo")
    places = configuration.select("repo", "path", F.concat_ws("\u0001", "repo", "path").alias("key"), F.concat_ws("/", repo, "path").alias("scoped")).distinct()
    owned = joins.longest_prefix(places, units.select(F.concat_ws("/", repo, "root").alias("prefix"), F.col("id").alias("owner")), "key", "scoped", "prefix", "owner").where("owner is not null").select("repo", "path", F.col("owner").alias("source"))
    called = configuration.where(F.col("key").isin("spring.application.name", "micronaut.application.name", "quarkus.application.name") & ~F.col("value").contains("${")).join(owned, ["repo", "path"]).select("repo", F.col("value").alias("name"), F.col("source").alias("id"))
    own = units.select("repo", F.explode(F.array_compact(F.array("id", "name", "compose_service"))).alias("name"), "id")
    names = called.unionByName(own).groupBy("repo", F.lower("name").alias("name")).agg(F.min("id").alias("target"))
    routes = config.gateway_routes(configuration).withColumn("name", F.lower("target")).drop("target")
    met = routes.join(owned, ["repo", "path"]).join(names, ["repo", "name"]).where("source <> target")
    label = F.concat_ws(" ", F.lit("routes"), "pattern")
    return met.select("repo", "source", "target", F.lit("sync").alias("edge_type"), label.alias("label"), F.lit("config").alias("origin"), evidence(F.col("path"), F.col("line")).alias("evidence"))


def _imaged(services: DataFrame) -> DataFrame:
    """repo, name, kind of compose services whose image is a known kind of infrastructure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [catalog.infra_of_image(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string())], names=["repo", "name", "kind"])

    given = services.where("error is null and variant is null and image is not null").select("repo", "name", "image")
    return given.mapInArrow(run, "repo string, name string, kind string").where("kind is not null")


def _states(entities: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """state_machines and transitions of columns with a closed set of values that code moves between them."""
    # of several closed sets of a column the first counts: of schemas before code, then by path and line
    closed = entities.select("repo", "table", F.posexplode("values_of").alias("at", "v"), "columns").select("repo", "table", F.col("v.column").alias("column"), F.col("v.values").alias("values"), "columns", "at")
    closed = closed.where(F.lower("column").rlike("status|state|stage|phase|lifecycle") & (F.size("values") >= 2))
    closed = closed.groupBy("repo", "table", "column").agg(F.min_by(F.struct("values", "columns"), "at").alias("c")).select("repo", "table", "column", "c.values", "c.columns")
    plain = lambda c: F.regexp_replace(c, "^'|'$", "")
    sets_ = access.where("mode = 'write'").select("repo", "unit", "table", "path", "line", "symbol", "wheres", F.explode("sets").alias("s"))
    moved = sets_.join(closed, ["repo", "table"]).where(F.col("s.column") == F.col("column")).withColumn("to", plain(F.col("s.value"))).where(F.array_contains("values", F.col("to")))
    given = F.transform(F.filter("wheres", lambda w: w["column"] == F.col("column")), lambda w: plain(w["value"]))
    known = F.filter(given, lambda x: F.array_contains("values", x) & (x != F.col("to")))
    from_ = moved.withColumn("from", F.explode_outer(known))
    machine = F.concat(F.lit("state:"), "table", F.lit("."), "column")
    moves = from_.select("repo", machine.alias("machine"), "from", "to", "unit", F.col("symbol").alias("trigger"), evidence(F.col("path"), F.col("line"), symbol=F.col("symbol")).alias("evidence")).distinct()
    moves = cut(moves)
    keyed = moves.select(F.concat_ws("\u0001", "repo", "machine").alias("machine"), "from", "to")
    start = F.element_at(F.filter("columns", lambda c: c["name"] == F.col("column")), 1)["default"]
    every = closed.select(F.concat_ws("\u0001", "repo", machine).alias("machine"), F.posexplode("values").alias("pos", "state"), plain(start).alias("start")).join(keyed.select("machine").distinct(), "machine", "left_semi")
    marked = every.join(states.flags(keyed).select("machine", "state", "terminal"), ["machine", "state"], "left").withColumn("initial", F.coalesce(F.col("state") == F.col("start"), F.lit(False))).fillna(False, ["terminal"])
    machines = marked.groupBy("machine").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("state").alias("name"), "initial", "terminal"))).alias("states"))
    out = machines.select(F.element_at(F.split("machine", "\u0001"), 1).alias("repo"), F.element_at(F.split("machine", "\u0001"), 2).alias("id"), F.transform("states", lambda s: F.struct(s["name"].alias("name"), s["initial"].alias("initial"), s["terminal"].alias("terminal"))).alias("states"))
    return out, moves


def cross_repo(model: Model, members: DataFrame) -> DataFrame:
    """Calls that no operation of their own repository takes, with the operation of a member repository that they reach.

    `members` has repo, host: the names by which a repository's units are called. A call has to name its member.
    """
    calls = model.client_calls.where("operation is null and target_host is not null")
    named = calls.join(members.withColumnsRenamed({"repo": "member", "host": "target_host"}), "target_host").where("member <> repo")
    asked = named.withColumn("call_id", F.to_json(F.struct("repo", "unit", "method", "path", "evidence", "member")))
    ids = model.operations.select(F.col("repo").alias("member"), F.col("id").alias("operation"), F.concat_ws("\u0001", "repo", "unit").alias("unit"), "method", "path", "path_partial")
    met = joins.best_match(asked.select("member", "call_id", F.concat_ws("\u0001", "repo", "unit").alias("unit"), "method", "path").distinct(), ids, "member")
    found = asked.drop("operation").join(met.select("call_id", "operation"), "call_id").where("operation is not null")
    return found.select("repo", "unit", "method", "path", "target_host", "member", "operation", "evidence")


def diff(base: Model, head: Model) -> DataFrame:
    """section, verb, subject, details of what changed: containers, relationships, operations, entities, infrastructure."""
    parts = []
    arr = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")

    def section(n: int, name: str, a: DataFrame, b: DataFrame, keys: list[str], compare: list[str], subject: Column) -> None:
        d = sets.keyed_diff(a, b, keys, compare)
        said = [F.when(~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) & (F.col("verb") == "changed"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"{c}_before").cast("string"), F.lit("none")), F.lit(" -> "), F.coalesce(F.col(f"{c}_after").cast("string"), F.lit("none")))) for c in compare]
        parts.append(d.select(F.lit(n).alias("_s"), F.lit(name).alias("section"), "ordinal", "verb", subject.alias("subject"), (F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")).alias("details")))

    flat = lambda m: m.units.select("repo", "id", "kind", "language", arr(F.col("frameworks")).alias("frameworks"))
    section(0, "containers", flat(base), flat(head), ["repo", "id"], ["kind", "language", "frameworks"], F.col("id"))
    section(1, "relationships", base.relationships, head.relationships, ["repo", "source", "target", "edge_type"], [], F.concat("source", F.lit(" -> "), "target", F.lit(" ("), "edge_type", F.lit(")")))
    ops = lambda m: m.operations.select("repo", "id", "request_type", "response_type", "success_status", arr(F.transform("errors", lambda e: e.cast("string"))).alias("errors"), arr(F.transform("auth", lambda a: a["kind"])).alias("auth"))
    section(2, "operations", ops(base), ops(head), ["repo", "id"], ["request_type", "response_type", "success_status", "errors", "auth"], F.col("id"))
    cols = lambda m: m.entities.select("repo", "table", arr(F.array_sort(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type_name"], F.when(c["nullable"], F.lit("null")))))).alias("columns"))
    section(3, "entities", cols(base), cols(head), ["repo", "table"], ["columns"], F.col("table"))
    section(4, "infrastructure", base.infra, head.infra, ["repo", "id"], [], F.col("id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("_s", "ordinal", "subject").select("section", "verb", "subject", "details")


def conform(declared: DataFrame, model: Model) -> DataFrame:
    """verdicts of declared endpoints against the model's operations, of the same repository if `declared` has `repo`."""
    scope = "repo" if "repo" in declared.columns else None
    done = model.operations.select(*[scope] * bool(scope), "method", "path", F.array_distinct(F.concat(F.array_compact(F.array("success_status")), "errors")).alias("statuses"), F.struct("id", "file", "line").alias("pos"))
    return sets.conform(_by_repo(declared) if scope else declared, done, scope)
