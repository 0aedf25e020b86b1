"""Human-written inputs: specifications in Markdown, README summaries, authored answers, evidence pins, diagram documents."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import join_path
from factloom.operators.windows import carry_forward
from factloom.sources.files import extract

VERBS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"


def declared(files: DataFrame) -> DataFrame:
    """repo, source, line, requirement, method, path, statuses of every endpoint that specification files declare.

    A heading names the requirement of the lines below it. An endpoint is a path with the nearest verb before it on
    its line; requirement headings without any endpoint below them are rows without a method and path.
    """
    lines = files.where(F.col("path").rlike(r"(?:^|/)(?:requirements|spec|design|tasks)\.md$|(?:^|/)(?:specs?|openspec)/.*\.md$"))
    lines = lines.select("repo", F.col("path").alias("source"), F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    head = F.regexp_extract("text", r"^#{2,6}\s+(?:Requirement:\s*)?(.+?)\s*$", 1)
    fr = F.regexp_extract("text", r"^\s*[-*]\s+\*\*(FR-\d+)\*\*", 1)
    title = F.when(head != "", head).when(fr != "", fr)
    own = carry_forward(lines.withColumn("_h", title), ["repo", "source"], ["line"], F.col("_h"), "requirement")
    found = F.regexp_extract_all("text", F.lit(rf"\b({VERBS})\b\W{{1,3}}(/[\w\-./{{}}:<>*]*)"), F.lit(0))
    hits = own.where(F.size(found) > 0).select("*", F.explode(found).alias("hit"))
    statuses = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\w/.-])([1-5]\d\d)(?![\w/.-])"), F.lit(1)), lambda s: s.cast("int")))
    path = F.regexp_replace(F.regexp_extract("hit", r"(/.*)$", 1), "[.:,]+$", "")
    endpoints = hits.select("repo", "source", "line", "requirement", F.regexp_extract("hit", rf"({VERBS})", 1).alias("method"), join_path(F.lit(""), path).alias("path"), statuses.alias("statuses"))
    # statuses on the other lines of a requirement belong to its endpoint, if it has just one
    per = own.where("requirement is not null").groupBy("repo", "source", "requirement").agg(F.min("line").alias("first"), F.array_sort(F.collect_set(F.when(F.size(statuses) > 0, statuses))).alias("said"))
    count = endpoints.groupBy("repo", "source", "requirement").agg(F.count("*").alias("n"))
    same = [F.col("repo").eqNullSafe(F.col("r")), F.col("source") == F.col("s"), F.col("requirement").eqNullSafe(F.col("q"))]
    near = per.select(F.col("repo").alias("r"), F.col("source").alias("s"), F.col("requirement").alias("q"), "said").join(count.select(F.col("repo").alias("r2"), F.col("source").alias("s2"), F.col("requirement").alias("q2"), "n"), F.col("r").eqNullSafe(F.col("r2")) & (F.col("s") == F.col("s2")) & F.col("q").eqNullSafe(F.col("q2")))
    full = endpoints.join(near.select("r", "s", "q", "said", "n"), same, "left")
    full = full.select("repo", "source", "line", "requirement", "method", "path", F.when(F.col("n") == 1, F.array_distinct(F.concat("statuses", F.flatten("said")))).otherwise(F.col("statuses")).alias("statuses"))
    bare = per.where(F.col("requirement").rlike(r"(?i)^(requirement|FR-\d+|user story|scenario)")).join(endpoints.select("repo", "source", "requirement").distinct(), ["source", "requirement"], "left_anti")
    none = bare.select("repo", "source", F.col("first").alias("line"), "requirement", F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("path"), F.array().cast("array<int>").alias("statuses"))
    return full.unionByName(none)


def summary(text: str) -> str | None:
    """The first paragraph of prose of a README: no headings, badges, HTML, lists, tables or code."""
    fenced, words = False, []
    for line in text.splitlines() + [""]:
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or re.match(r"(#|<|\||[-*+] |\d+[.)] |>|={3,}|-{3,}|\[!\[|!\[|\[[^\]]+\]:)", s):
            if words:
                break
            continue
        if not s:
            if words:
                break
            continue
        words.append(s)
    said = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", " ".join(words))
    return re.sub(r"[*_`]{1,3}", "", said).strip() or None


def readmes(files: DataFrame) -> DataFrame:
    return extract(files, lambda path, text: [{"summary": summary(text)}], "summary string", F.lower(F.substring_index("path", "/", -1)).isin("readme.md", "readme"))


def authored(text: str | None) -> tuple[dict, str | None]:
    """Authored answers, and a warning if they can't be read: that is never a failure."""
    if not text:
        return {"business": {}, "operations": {}}, None
    try:
        made = json.loads(text)
        if not isinstance(made, dict):
            raise ValueError("not an object")
        return {"business": made.get("business") or {}, "operations": made.get("operations") or {}}, None
    except ValueError as e:
        return {"business": {}, "operations": {}}, f"authored answers were ignored: {e}"


def history(text: str | None, entry: dict | None = None) -> list[dict]:
    """Release entries, newest first; `entry` replaces the one of its release."""
    try:
        known = json.loads(text) if text else []
    except ValueError:
        known = []
    known = [e for e in known if isinstance(e, dict) and (entry is None or e.get("release") != entry["release"])] if isinstance(known, list) else []
    return sorted([*([entry] if entry else []), *known], key=lambda e: (e.get("date") or "", e.get("release") or ""), reverse=True)


def pin(text: str) -> tuple[str, int, int]:
    """`path:LINE` or `path:LINE-END`."""
    m = re.fullmatch(r"(.+?):(\d+)(?:-(\d+))?", text)
    if not m or int(m[2]) < 1 or m[3] and int(m[3]) < int(m[2]):
        raise ValueError(f"not a place in a file: {text!r}")
    return m[1], int(m[2]), int(m[3] or m[2])


#: Fields of a diagram document: kind and whether it is required; a tuple is a closed set of values. Fixed values.
DIAGRAM = {
    "document": {"version": (("1.0.0", "1.1.0"), True), "diagramType": (("system-context", "container", "component", "data-flow", "lifecycle", "sequence", "entity-relationship"), True), "title": (str, True), "subtitle": (str, False), "theme": (("editorial-light", "editorial-dark"), True), "metadata": ("metadata", True), "containers": (["container"], True), "nodes": (["node"], True), "edges": (["edge"], True)},
    "metadata": {"targetRepo": (str, True), "commitHash": (str, False), "generatedAt": (str, True), "visualDensityScore": (float, False)},
    "container": {"id": (str, True), "label": (str, True), "boundaryType": (("trust-zone", "internal-service", "third-party", "storage", "client"), True), "roleDescription": (str, False)},
    "node": {"id": (str, True), "containerId": (str, False), "label": (str, True), "subtitle": (str, False), "techStack": (str, False), "isKeyFocalPoint": (bool, True), "evidence": ("evidence", False), "metadata": (dict, False), "attributes": (["attribute"], False), "stateKind": (("initial", "normal", "terminal"), False)},
    "evidence": {"filePath": (str, True), "startLine": (int, True), "endLine": (int, True), "symbolName": (str, False), "repo": (str, False)},
    "attribute": {"name": (str, True), "typeName": (str, True), "key": (("pk", "fk", "pk-fk"), False), "nullable": (bool, False), "note": (str, False)},
    "edge": {"id": (str, True), "source": (str, True), "target": (str, True), "label": (str, False), "edgeType": (("sync", "async", "event", "read", "write"), True), "style": (("solid", "dashed"), False), "isPrimaryPath": (bool, False), "sequence": (int, False), "reply": (bool, False), "payload": (str, False), "cardinality": (("1:1", "1:n", "n:1", "n:m"), False), "guard": (str, False), "evidence": ("evidence", False)},
}


def json_schema() -> dict:
    """The JSON Schema of a diagram document."""

    def of(kind):
        if isinstance(kind, list):
            return {"type": "array", "items": of(kind[0])}
        if isinstance(kind, tuple):
            return {"enum": list(kind)}
        if isinstance(kind, str):
            return {"$ref": f"#/$defs/{kind}"}
        return {"type": {str: "string", bool: "boolean", int: "integer", float: "number", dict: "object"}[kind]}

    made = {n: {"type": "object", "additionalProperties": False, "required": [k for k, (_, need) in f.items() if need], "properties": {k: of(t) for k, (t, _) in f.items()}} for n, f in DIAGRAM.items()}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **made.pop("document"), "$defs": made}


def diagram_tables(spark, name: str, text: str):
    """containers, nodes, edges of a valid diagram document, with the names that the checks use."""
    errors = diagram_errors(text)
    if errors:
        raise ValueError("; ".join(f"{at}: {said}" for at, said in errors))
    made = json.loads(text)
    ev = lambda e: None if e is None else (e["filePath"], e["startLine"], e["endLine"], e.get("symbolName"), None, e.get("repo"))
    kind, place = made["diagramType"], "evidence struct<file_path:string,start_line:int,end_line:int,symbol_name:string,note:string,repo:string>"
    c = spark.createDataFrame([(name, x["id"], x["label"], x["boundaryType"]) for x in made["containers"]], "diagram string, id string, label string, boundary_type string")
    n = spark.createDataFrame(
        [(name, kind, i, x["id"], x.get("containerId"), x["label"], x.get("subtitle"), x.get("techStack"), x["isKeyFocalPoint"], x.get("stateKind"), len(x.get("attributes") or ()), ev(x.get("evidence"))) for i, x in enumerate(made["nodes"])],
        f"diagram string, diagram_type string, pos int, id string, container_id string, label string, subtitle string, tech_stack string, is_key_focal_point boolean, state_kind string, attributes int, {place}",
    )
    e = spark.createDataFrame(
        [(name, kind, i, x["id"], x["source"], x["target"], x.get("label"), x["edgeType"], bool(x.get("isPrimaryPath")), x.get("sequence"), x.get("cardinality"), ev(x.get("evidence"))) for i, x in enumerate(made["edges"])],
        f"diagram string, diagram_type string, pos int, id string, source string, target string, label string, edge_type string, is_primary_path boolean, sequence int, cardinality string, {place}",
    )
    return c, n, e


def diagram_errors(text: str) -> list[tuple[str, str]]:
    """(JSON path, message) of every way in which a diagram document departs from its schema; none if it is valid."""
    try:
        made = json.loads(text)
    except ValueError as e:
        return [("$", str(e))]
    out: list[tuple[str, str]] = []

    def look(value, kind, at: str) -> None:
        if isinstance(kind, list):
            if not isinstance(value, list):
                out.append((at, "expected an array"))
            else:
                for n, x in enumerate(value):
                    look(x, kind[0], f"{at}[{n}]")
        elif isinstance(kind, tuple):
            if value not in kind:
                out.append((at, f"expected one of {', '.join(kind)}"))
        elif isinstance(kind, str):
            if not isinstance(value, dict):
                out.append((at, "expected an object"))
                return
            fields = DIAGRAM[kind]
            out.extend((f"{at}.{k}", "unknown field") for k in value if k not in fields)
            for name, (of, needed) in fields.items():
                if value.get(name) is None:
                    if needed:
                        out.append((at, f"missing field {name}"))
                else:
                    look(value[name], of, f"{at}.{name}")
        elif kind is int and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
            out.append((at, "expected a line number or count"))
        elif kind is float and (isinstance(value, bool) or not isinstance(value, int | float)):
            out.append((at, "expected a number"))
        elif kind in (str, bool, dict, list) and not isinstance(value, kind):
            out.append((at, f"expected {kind.__name__}"))

    look(made, "document", "$")
    return out
