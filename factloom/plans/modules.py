"""Modules: the folders of a unit as parts that import each other, and imports across a module's boundary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import joins
from factloom.plans.scan import Model, evidence
from factloom.sources import catalog


def module_of(path: str) -> str:
    """The folder of a file, `.` at the top."""
    return path.rpartition("/")[0] or "."


def candidates(path: str, spec: str) -> list[str]:
    """Files that an import may mean, in order of preference, by the rules of the importing file's language.

    A candidate that ends in `/` is a folder of files; one that begins with `*` may lie below any folder.
    """
    language, folder = catalog.language_of(path), path.rpartition("/")[0]

    def up(base: str, parts: list[str]) -> str:
        out = [p for p in base.split("/") if p]
        for p in parts:
            out = out[:-1] if p == ".." else out if p in (".", "") else [*out, p]
        return "/".join(out)

    if language in ("TypeScript", "JavaScript"):
        if not spec.startswith("."):
            return []
        base = up(folder, spec.split("/"))
        stem = base.rsplit(".", 1)[0] if base.endswith((".js", ".mjs", ".jsx")) else base
        return [base, *(f"{b}{e}" for b in dict.fromkeys([base, stem]) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"))]
    if language == "Python":
        dots = len(spec) - len(spec.lstrip("."))
        name = spec.lstrip(".").replace(".", "/")
        if dots:
            base = up(folder, [".."] * (dots - 1) + ([name] if name else []))
            return [f"{base}.py", f"{base}/__init__.py"] if name else [f"{base}/__init__.py", f"{base}/"]
        return [f"{name}.py", f"{name}/__init__.py", f"*/{name}.py", f"*/{name}/__init__.py"]
    if language == "Go":
        parts = spec.split("/")
        return [f"*/{'/'.join(parts[n:])}/" for n in range(1, len(parts))] if len(parts) > 2 else []
    if language in ("Java", "Kotlin"):
        name = spec.replace(".", "/")
        return [f"*/{name}.java", f"*/{name}.kt", f"*/{name.rpartition('/')[0]}.java", f"*/{name}/"]
    if language == "Rust" and spec.startswith(("crate::", "super::", "self::")):
        parts = spec.split("::")
        base = up(folder, [".."] if parts[0] == "super" and path.endswith("mod.rs") else [])
        root = path.split("/src/")[0] + "/src" if "/src/" in path else "src" if path.startswith("src/") else folder
        base = root if parts[0] == "crate" else base
        return [f"{base}/{'/'.join(parts[1:n])}{e}" for n in range(len(parts), 1, -1) for e in (".rs", "/mod.rs")]
    return []


def resolved(model: Model) -> DataFrame:
    """repo, unit, path, line, specifier, target: the file or folder within the unit that each import means.

    Candidates are exploded with their rank and meet files, folders and the ends of paths by equality.
    """
    imports = model.facts.select("repo", "unit", "path", F.explode("imports").alias("i")).select("repo", "unit", "path", F.col("i.line").alias("line"), F.col("i.specifier").alias("specifier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [candidates(p, s) for p, s in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.string()))], names=[*b.schema.names, "tried"])

    tried = imports.mapInArrow(run, "repo string, unit string, path string, line int, specifier string, tried array<string>").select("*", F.posexplode("tried").alias("rank", "c")).drop("tried")
    files = model.facts.select("repo", "unit", F.col("path").alias("target"))
    parts = F.split("target", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("*/"), F.array_join(F.slice(parts, n, F.size(parts)), "/")))
    folder = F.regexp_replace("target", "[^/]*$", "")
    inner = F.split(F.regexp_replace(folder, "/$", ""), "/")
    folder_ends = F.transform(F.sequence(F.lit(1), F.size(inner)), lambda n: F.concat(F.lit("*/"), F.array_join(F.slice(inner, n, F.size(inner)), "/"), F.lit("/")))
    keys = files.select("repo", "unit", "target", F.explode(F.array_distinct(F.concat(F.array("target"), ends, F.when(folder != "", F.concat(F.array(folder), folder_ends)).otherwise(F.array().cast("array<string>"))))).alias("c"))
    met = tried.join(keys, ["repo", "unit", "c"])
    first = F.row_number().over(Window.partitionBy("repo", "unit", "path", "line", "specifier").orderBy("rank", "target"))
    return met.withColumn("_r", first).where("_r = 1").select("repo", "unit", "path", "line", "specifier", "target")


def modules(model: Model) -> DataFrame:
    """repo, unit, module, files, symbols, is_entry, doc of every folder that holds source files."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    rows = model.facts.withColumn("module", folder)
    return rows.groupBy("repo", "unit", "module").agg(
        F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"), F.bool_or(F.size("entry_points") > 0).alias("is_entry"), F.min_by("module_doc", F.struct(F.col("module_doc").isNull(), "path")).alias("doc")
    )


def dependencies(model: Model) -> DataFrame:
    """repo, unit, source, target, weight, evidence: imports and messages between modules of a unit, with their number."""
    folder = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))
    imported = resolved(model).select("repo", "unit", folder("path").alias("source"), folder("target").alias("target"), evidence(F.col("path"), F.col("line")).alias("evidence"))
    scoped = model.events.select(F.concat_ws("\u0001", "repo", "unit", "name").alias("event"), F.concat_ws("\u0001", "repo", "unit", folder("path")).alias("module"), evidence(F.col("path"), F.col("line")).alias("at"), "kind")
    met = joins.publish_listen(scoped.where("kind = 'publish'"), scoped.where("kind in ('consume', 'listen')"))
    part = lambda c, n: F.element_at(F.split(c, "\u0001"), n)
    told = met.select(part("src", 1).alias("repo"), part("src", 2).alias("unit"), part("src", 3).alias("source"), part("dst", 3).alias("target"), "weight", F.col("first_at").alias("evidence"))
    counted = imported.where("source <> target").groupBy("repo", "unit", "source", "target").agg(F.count("*").alias("weight"), F.min("evidence").alias("evidence"))
    return counted.unionByName(told).groupBy("repo", "unit", "source", "target").agg(F.sum("weight").alias("weight"), F.min("evidence").alias("evidence"))


def violations(model: Model) -> DataFrame:
    """Imports from outside of what lies below a folder named `internal` or `impl`: repo, unit, from, to, specifier, evidence.

    Such a folder's contents belong to the tree that holds the folder; files of that tree may import them.
    """
    hidden = F.regexp_extract("target", r"^(.*?)(?:^|/)(?:internal|impl)/", 1)
    inside = F.regexp_extract("target", r"(?:^|/)(?:internal|impl)/", 0) != ""
    found = resolved(model).where(inside).withColumn("owner", hidden)
    outside = (F.col("owner") != "") & ~F.col("path").startswith(F.concat("owner", F.lit("/")))
    return found.where(outside).select("repo", "unit", F.regexp_replace("path", "/[^/]*$", "").alias("from"), F.regexp_replace("target", "/[^/]*$", "").alias("to"), "specifier", evidence(F.col("path"), F.col("line")).alias("evidence"))
