"""Configuration: YAML and properties flattened to dotted keys with lines, dotenv, placeholders, and the tool's own TOML."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import url_host
from factloom.sources.files import extract


def flatten_yaml(text: str) -> list[tuple[str, str, int]]:
    """(key, value, line) of every scalar of all documents; list items are `a[0]`; anchors of one document are followed."""
    out: list[tuple[str, str, int]] = []

    def add(node, key: str, depth: int) -> None:
        if depth > 40:
            return
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                name = str(k.value)
                add(v, f"{key}.{name}" if key else name, depth + 1)
        elif isinstance(node, yaml.SequenceNode):
            for n, v in enumerate(node.value):
                add(v, f"{key}[{n}]", depth + 1)
        elif node is not None:
            out.append((key, node.value, node.start_mark.line + 1))

    for node in yaml.compose_all(text, Loader=yaml.SafeLoader):
        add(node, "", 0)
    return out


def flatten_properties(text: str) -> list[tuple[str, str, int]]:
    out, whole, start = [], "", 0
    for n, line in enumerate(text.splitlines(), 1):
        if not whole and re.match(r"\s*([#!]|$)", line):
            continue
        start = start if whole else n
        whole += line.lstrip()
        if whole.endswith("\\") and not whole.endswith("\\\\"):
            whole = whole[:-1]
            continue
        m = re.match(r"((?:\\.|[^\\=:\s])+)\s*[=:\s]\s*(.*)", whole)
        if m:
            out.append((re.sub(r"\\(.)", r"\1", m[1]), m[2].strip(), start))
        whole = ""
    return out


def dotenv(text: str) -> list[tuple[str, str]]:
    """KEY=value lines: `export`, comments and quotes are understood."""
    out = []
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", line)
        if m:
            value = m[2].strip()
            quoted = re.match(r"""(["'])(.*?)\1""", value)
            out.append((m[1], quoted[2] if quoted else re.split(r"\s+#", value)[0].strip()))
    return out


def placeholder(value: str, known: dict[str, str], rounds: int = 8) -> str:
    """`${key:default}` and `${VAR:-default}` replaced by what is known, else the default, else nothing; inner ones first."""

    def put(m: re.Match) -> str:
        name, _, default = m[1].partition(":")
        return known.get(name, default.removeprefix("-"))

    for _ in range(rounds):
        value, before = re.sub(r"\$\{([^{}]*)\}", put, value), value
        if value == before:
            break
    return value


def parse(path: str, text: str) -> list[dict]:
    rows = flatten_properties(text) if path.endswith(".properties") else flatten_yaml(text)
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    profile = name.split("-", 1)[1] if "-" in name else None
    return [{"key": k, "value": v, "line": n, "profile": profile} for k, v, n in rows]


def configs(files: DataFrame) -> DataFrame:
    """key, value, line, profile of the application's configuration files."""
    name = F.substring_index("path", "/", -1)
    return extract(files, parse, "key string, value string, line int, profile string", name.rlike(r"^(application|bootstrap)(-[\w-]+)?\.(ya?ml|properties)$"))


def gateway_routes(settings: DataFrame) -> DataFrame:
    """repo, path, route, target, pattern, line: routes that Zuul's or Spring Cloud Gateway's keys of `settings` declare.

    `settings` has repo, path, key, value, line. The target is a service's id, else the host of the address; a route
    without a target is none. Of several patterns or targets of a route the first by line counts; a pattern may lack.
    """
    zuul, cloud = r"^zuul\.routes\.(.+)\.([^.]+)$", r"^(spring\.cloud\.gateway\.(?:server\.webflux\.|mvc\.)?routes\[\d+\])\.(.+)$"
    told = settings.where(F.col("key").rlike(f"{zuul}|{cloud}") & F.col("value").isNotNull())
    old = F.col("key").startswith("zuul.")
    parts = told.select("repo", "path", "line", "value", old.alias("old"), *[F.when(old, F.regexp_extract("key", zuul, n)).otherwise(F.regexp_extract("key", cloud, n)).alias(name) for n, name in ((1, "route"), (2, "field"))])
    pattern = F.when(F.col("old") & (F.col("field") == "path"), F.col("value")).when(~F.col("old") & F.col("field").startswith("predicates") & F.col("value").startswith("Path="), F.substring("value", 6, 1 << 20))
    id_ = F.when(F.col("old") & F.col("field").isin("serviceId", "service-id"), F.col("value"))
    host = F.when((F.col("old") & (F.col("field") == "url")) | (~F.col("old") & (F.col("field") == "uri")), url_host(F.col("value")))
    rows = parts.select("repo", "path", "route", "line", pattern.alias("pattern"), id_.alias("id"), host.alias("host"))
    at = F.struct((F.col("id").isNull()).cast("int"), "line")
    named = F.when(F.coalesce("id", "host").isNotNull(), F.struct(F.coalesce("id", "host").alias("target"), "line"))
    met = rows.groupBy("repo", "path", "route").agg(F.min_by(named, F.when(named.isNotNull(), at)).alias("t"), F.min_by("pattern", F.when(F.col("pattern").isNotNull(), F.col("line"))).alias("pattern"))
    return met.where("t is not null").select("repo", "path", "route", "t.target", "pattern", "t.line")


def settings(folder: str, name: str = "factloom.toml") -> dict:
    """The nearest settings file up the tree; its output folder has to lie inside the folder that holds the file."""
    at = Path(folder).resolve()
    for home in (at, *at.parents):
        file = home / name
        if file.is_file():
            made = tomllib.loads(file.read_text())
            out = (home / made.get("out", "docs/architecture")).resolve()
            if not out.is_relative_to(home):
                raise ValueError(f"the output folder {out} lies outside {home}")
            return {**made, "root": str(home), "out": str(out)}
    return {"root": str(at), "out": str(at / "docs/architecture")}
