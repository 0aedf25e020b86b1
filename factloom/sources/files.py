"""File trees as a table (repo, path, content), and per-file table functions over it.

A tree is listed on the driver, its texts are read by the executors' own file reader; a `files` table from anywhere
else (an object store, a lake table of many repositories) works the same, so one scan may cover many repositories.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources import catalog

#: Limits of a scan; fixed values.
MAX_FILES, MAX_BYTES, READ_FLOOR = 25_000, 1_000_000, 0.10
FILES = "repo string, path string, content string"
#: Folders of what is built or installed, never read.
BUILT = ("node_modules", "target", "vendor", "dist", "build", "__pycache__", "venv")
JVM_ROOTS = ("src/main/java", "src/main/kotlin")


def _ignored(rules: list[tuple[str, str, bool]], path: str, is_dir: bool) -> bool:
    """Whether .gitignore `rules` (folder, pattern, negated), outer ones first, leave a path out: the last that matches."""
    out = False
    for base, pattern, negated in rules:
        only_dir, plain = pattern.endswith("/"), pattern.strip("/")
        if only_dir and not is_dir:
            continue
        inner = os.path.relpath(path, base) if base else path
        if inner.startswith(".."):
            continue
        anchored = "/" in pattern.rstrip("/")
        hit = fnmatch.fnmatch(inner, plain.replace("**/", "*")) if anchored else fnmatch.fnmatch(os.path.basename(path), plain)
        if hit:
            out = not negated
    return out


def walk(root: str, include_tests: bool = False, most: int = MAX_FILES, most_bytes: int = MAX_BYTES) -> dict:
    """The files of a tree in path order: paths, oversized, skipped_dirs, skipped_files, truncated.

    Hidden names and what .gitignore leaves out are skipped; test and tooling folders too, unless `include_tests` or
    below a JVM source root, where such a name is a package.
    """
    root = str(Path(root).resolve())
    out = {"paths": [], "oversized": [], "skipped_dirs": 0, "skipped_files": 0, "truncated": False}
    rules: list[tuple[str, str, bool]] = []
    for folder, dirs, names in os.walk(root):
        here = os.path.relpath(folder, root)
        here = "" if here == "." else here
        if ".gitignore" in names:
            for line in Path(folder, ".gitignore").read_text(errors="replace").splitlines():
                line = line.strip()
                if line and not line.startswith("#"):
                    rules.append((here, line.removeprefix("!"), line.startswith("!")))
        in_jvm = any(f"/{r}/" in f"/{here}/" for r in JVM_ROOTS)
        kept = []
        for d in sorted(dirs):
            path = f"{here}/{d}" if here else d
            if d.startswith(".") or d in BUILT or _ignored(rules, path, True) or os.path.islink(os.path.join(folder, d)):
                continue
            if not include_tests and not in_jvm and catalog.is_other_dir(d):
                out["skipped_dirs"] += 1
                continue
            kept.append(d)
        dirs[:] = kept
        for n in sorted(names):
            path = f"{here}/{n}" if here else n
            if n.startswith(".") and not n.startswith(".env") or _ignored(rules, path, False) or os.path.islink(os.path.join(folder, n)):
                continue
            if not include_tests and catalog.is_test_file(n):
                out["skipped_files"] += 1
            elif os.path.getsize(os.path.join(folder, n)) > most_bytes:
                out["oversized"].append(path)
            else:
                out["paths"].append(path)
    out["paths"].sort()
    out["truncated"], out["paths"] = len(out["paths"]) > most, out["paths"][:most]
    return out


def read_tree(spark: SparkSession, root: str, repo: str | None = None, include_tests: bool = False) -> DataFrame:
    """`files` of a tree on the driver's disk; texts that aren't UTF-8 have a null content, not a missing row."""
    root = str(Path(root).resolve())
    rows = []
    for path in walk(root, include_tests)["paths"]:
        try:
            rows.append((repo, path, Path(root, path).read_bytes().decode()))
        except UnicodeDecodeError:
            rows.append((repo, path, None))
    return spark.createDataFrame(rows, FILES)


def _store(spark: SparkSession, path: str, include_tests: bool) -> DataFrame:
    """path (below the root), length, content, reason of all files of a store; the reason says why one isn't read."""
    plain = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
    root = re.sub(plain, "", path) if re.match(plain, path) else os.path.abspath(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring(F.regexp_replace("path", plain, ""), len(root.rstrip("/")) + 2, 1 << 20)
    rows = raw.select(below.alias("path"), "length", "content").withColumn("name", F.substring_index("path", "/", -1))
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # below a JVM source root a name is a package
    outer = F.split(F.regexp_replace("path", rf"((?:^|/)(?:{'|'.join(JVM_ROOTS)}))/.*$", "$1/"), "/")
    outer = F.slice(outer, F.lit(1), F.size(outer) - 1)
    low = lambda d: F.lower(d)
    other = F.exists(outer, lambda d: low(d).isin(*sorted({*catalog.TEST_DIRS, *catalog.OTHER_DIRS})) | low(d).startswith("e2e-") | low(d).endswith("-e2e") | low(d).endswith("-tests") | low(d).endswith("_tests"))
    test = F.col("name").rlike(f"(?:{'|'.join(map(re.escape, catalog.TEST_ENDS))})$|{'|'.join(map(re.escape, catalog.TEST_MARKS))}|^test_.*\\.py$|^conftest\\.py$")
    hidden = F.exists(folders, lambda d: d.startswith(".")) | (F.col("name").startswith(".") & ~F.col("name").startswith(".env"))
    built = F.exists(folders, lambda d: d.isin(*BUILT))
    reason = F.when(hidden, "hidden").when(built, "built").when(F.lit(not include_tests) & other, "folder").when(F.lit(not include_tests) & test, "test").when(F.col("length") > MAX_BYTES, "oversized")
    return rows.withColumn("reason", reason)


def read_store(spark: SparkSession, path: str, repo: Column | None = None, include_tests: bool = False) -> DataFrame:
    """`files` of a store that Spark reads, such as many repositories below one path; paths are those below it.

    `repo` is an expression over path, such as its first folder, which then stays in the path. What :func:`walk` leaves
    out is left out, but for .gitignore, which isn't read; :func:`store_left_out` counts it. Spark doesn't list names
    that begin with `_` or `.`. Texts that aren't UTF-8 have a null content.
    """
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    kept = _store(spark, path, include_tests).where((F.col("length") <= MAX_BYTES) & F.col("reason").isNull())
    return kept.select((repo if repo is not None else F.lit(None)).cast("string").alias("repo"), "path", text.alias("content"))


def store_left_out(spark: SparkSession, path: str, include_tests: bool = False) -> DataFrame:
    """reason, files, bytes of what :func:`read_store` doesn't read; no content is read for it."""
    return _store(spark, path, include_tests).where("reason is not null").groupBy("reason").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def with_language(files: DataFrame) -> DataFrame:
    """`files` with language, null where the extension isn't parsed, and unread, the language of files only counted."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[x for k, v in catalog.PARSED.items() for x in (F.lit(k), F.lit(v))])
    other = F.create_map(*[x for k, v in catalog._UNREAD.items() for x in (F.lit(k), F.lit(v))])
    return files.withColumn("language", known[ext]).withColumn("unread", F.when(F.col("language").isNull(), other[ext]))


def coverage(files: DataFrame) -> DataFrame:
    """One row: read, unread, share (1 without any), census (`3 Ruby, 1 Perl`)."""
    tagged = with_language(files)
    counts = tagged.where("unread is not null").groupBy("unread").agg(F.count("*").alias("n"))
    listed = counts.agg(F.sum("n").alias("unread"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("unread").alias("u")))).alias("l"))
    said = F.array_join(F.transform("l", lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["u"])), ", ")
    read = tagged.agg(F.count("language").alias("read"))
    whole = F.col("read") + F.coalesce("unread", F.lit(0))
    return read.join(listed, F.lit(True), "left").select("read", F.coalesce("unread", F.lit(0)).alias("unread"), F.when(whole == 0, 1.0).otherwise(F.try_divide("read", whole)).alias("share"), said.alias("census"))


def refuse_unread(files: DataFrame, allow_partial: bool = False, floor: float = READ_FLOOR) -> None:
    """Raise if less than `floor` of the source files can be read, unless `allow_partial`."""
    row = coverage(files).first()
    if row["share"] < floor and not allow_partial:
        raise ValueError(f"only {row['share']:.0%} of the source files can be read ({row['census']})")


def extract(files: DataFrame, parse: Callable[[str, str], list[dict]], ddl: str, where: Column | None = None) -> DataFrame:
    """A row for every dict that `parse(path, content)` returns, with repo and path in front and error behind.

    The filter runs before texts reach Python. A file that fails to parse gives one row with its error, not a failed
    job. Files without a text give none.
    """
    schema = T.StructType([T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), *T.StructType.fromDDL(ddl).fields, T.StructField("error", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"repo": repo, "path": path, **r} for r in parse(path, content)]
                except Exception as e:  # noqa: BLE001  reported as data
                    rows.append({"repo": repo, "path": path, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kept = files.where("content is not null")
    kept = kept.where(where) if where is not None else kept
    return kept.select("repo", "path", "content").mapInArrow(run, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)
