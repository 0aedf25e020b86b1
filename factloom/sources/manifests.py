"""Build manifests: what a folder builds, its name and its dependencies with their lines."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.files import extract

DDL = "kind string, dir string, name string, description string, language string, dependencies array<struct<name:string,line:int,path:string,indirect:boolean,dev:boolean>>, is_workspace_root boolean"
NAMES = ("Cargo.toml", "package.json", "go.mod", "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", "build.gradle.kts")


def line_of(text: str, mark: str, start: int = 0) -> int:
    """The line, from 1, of the first place of `mark` after `start`; 1 if there is none."""
    at = text.find(mark, start)
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


def _dep(name: str, line: int = 1, path: str | None = None, indirect: bool = False, dev: bool = False) -> dict:
    return {"name": name, "line": line, "path": path, "indirect": indirect, "dev": dev}


def _made(kind: str, language: str, name, deps=(), description=None, root=False) -> dict:
    return {"kind": kind, "name": name, "description": description, "language": language, "dependencies": list(deps), "is_workspace_root": root}


def cargo(text: str) -> dict:
    doc = tomllib.loads(text)
    deps = []
    for section, dev in (("dependencies", False), ("build-dependencies", True), ("dev-dependencies", True)):
        for name, spec in doc.get(section, {}).items():
            given = spec if isinstance(spec, dict) else {}
            at = re.search(rf'(?m)^\s*"?{re.escape(name)}"?\s*[=.]', text[max(text.find(f"[{section}"), 0) :])
            line = text.count("\n", 0, max(text.find(f"[{section}"), 0) + at.start() + len(at[0]) - len(at[0].lstrip())) + 1 if at else line_of(text, name)
            deps.append(_dep(given.get("package", name), line, given.get("path"), dev=dev))
    package = doc.get("package", {})
    said = package.get("description")
    return _made("cargo", "Rust", package.get("name"), deps, said if isinstance(said, str) else None, "workspace" in doc)


def package_json(text: str) -> dict:
    doc = json.loads(text)
    deps = []
    for section, dev in (("dependencies", False), ("peerDependencies", False), ("devDependencies", True)):
        start = max(text.find(f'"{section}"'), 0)
        for name, spec in (doc.get(section) or {}).items():
            local = re.match(r"(?:file|link):(.*)", spec) if isinstance(spec, str) else None
            deps.append(_dep(name, line_of(text, f'"{name}"', start), local and local[1], dev=dev))
    typed = any(d["name"] == "typescript" for d in deps)
    return _made("npm", "TypeScript" if typed else "JavaScript", doc.get("name"), deps, doc.get("description"), "workspaces" in doc)


def go_mod(text: str) -> dict:
    name, deps, block, replaced = None, [], None, {}
    for n, line in enumerate(text.splitlines(), 1):
        body, _, note = line.partition("//")
        words = body.split()
        if words[:1] == ["module"] and len(words) > 1:
            name = words[1]
        elif len(words) == 2 and words[1] == "(":
            block = words[0]
        elif words == [")"]:
            block = None
        else:
            verb, rest = (block, words) if block else (words[0] if words else None, words[1:])
            if verb == "require" and rest:
                deps.append(_dep(rest[0], n, indirect="indirect" in note))
            elif verb == "replace" and "=>" in rest and rest[rest.index("=>") + 1].startswith("."):
                replaced[rest[0]] = rest[rest.index("=>") + 1]
    for d in deps:
        d["path"] = replaced.get(d["name"])
    return _made("go", "Go", name, deps)


def pep508(spec: str) -> str:
    """`psycopg[binary]>=3 ; python_version>'3'` is `psycopg`."""
    return re.match(r"\s*([A-Za-z0-9._-]*)", spec)[1].rstrip(".-_")


def pyproject(text: str) -> dict:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
    given = [(d, False) for d in project.get("dependencies", [])] + [(d, True) for group in project.get("optional-dependencies", {}).values() for d in group]
    given += [(d, True) for group in doc.get("dependency-groups", {}).values() for d in group if isinstance(d, str)]
    deps = [_dep(pep508(d), line_of(text, d), dev=dev) for d, dev in given]
    sources = doc.get("tool", {}).get("uv", {}).get("sources", {})
    for d in deps:
        local = sources.get(d["name"])
        d["path"] = local.get("path") if isinstance(local, dict) else None
    groups = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True), *((g.get("dependencies", {}), True) for g in poetry.get("group", {}).values())]
    for table, dev in groups:
        deps += [_dep(k, line_of(text, k), v.get("path") if isinstance(v, dict) else None, dev=dev) for k, v in table.items() if k != "python"]
    return _made("python", "Python", project.get("name") or poetry.get("name"), deps, project.get("description") or poetry.get("description"), "workspace" in doc.get("tool", {}).get("uv", {}))


def requirements(text: str) -> dict:
    deps = [_dep(pep508(x), n) for n, x in enumerate(text.splitlines(), 1) if re.match(r"\s*[A-Za-z0-9]", x) and pep508(x)]
    return _made("python", "Python", None, deps)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(text: str) -> ET.Element:
    """An element tree of a text without document types: entities of its own are never expanded."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        raise ValueError("document types aren't read")
    return ET.fromstring(text)


def _child(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in e if _local(c.tag) == name), None) if e is not None else None


def _said(e: ET.Element | None, name: str) -> str | None:
    c = _child(e, name)
    return c.text.strip() if c is not None and c.text else None


def maven(text: str) -> dict:
    root = _xml(text)
    deps, at = [], 0
    held = _child(root, "dependencies")
    for d in held if held is not None else ():
        group, artifact = _said(d, "groupId"), _said(d, "artifactId")
        if artifact:
            at = max(text.find(f"<artifactId>{artifact}<", at), 0)
            deps.append(_dep(f"{group}:{artifact}", text.count("\n", 0, at) + 1, dev=_said(d, "scope") == "test"))
    return _made("maven", "Java", _said(root, "artifactId"), deps, _said(root, "description"), _child(root, "modules") is not None)


def gradle(text: str) -> dict:
    bare = re.sub(r"(?m)(?<!:)//.*$", "", text)
    deps = []
    pattern = r"""(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompile|[rR]untime)\w*|kapt|ksp|annotationProcessor)\s*\(?\s*(?:platform\()?\s*(?:project\s*\(?\s*(?:path\s*[:=]\s*)?['"]:([^'"]+)['"]|['"]([^'":]+:[^'":]+)(?::[^'"]*)?['"])"""
    for m in re.finditer(pattern, bare):
        line, dev = bare.count("\n", 0, m.start(1)) + 1, m[1].lower().startswith("test")
        deps.append(_dep(m[2].split(":")[-1], line, m[2].replace(":", "/"), dev=dev) if m[2] else _dep(m[3], line, dev=dev))
    for m in re.finditer(r"""(?m)\bid\s*\(?\s*['"]([\w.-]+)['"]""", bare):
        deps.append(_dep(m[1], bare.count("\n", 0, m.start(1)) + 1, dev=True))
    kotlin = re.search(r"""kotlin\s*\(\s*["']jvm|org\.jetbrains\.kotlin""", bare)
    name = re.search(r"""rootProject\.name\s*=\s*['"]([^'"]+)""", bare)
    return _made("gradle", "Kotlin" if kotlin else "Java", name and name[1], deps)


def csproj(text: str) -> dict:
    root = _xml(text)
    sdk = root.get("Sdk")
    deps = [_dep(sdk.lower(), 1)] if sdk else []
    for e in root.iter():
        name = e.get("Include")
        if name and _local(e.tag) in ("PackageReference", "FrameworkReference"):
            deps.append(_dep(name, line_of(text, f'"{name}"')))
        elif name and _local(e.tag) == "ProjectReference":
            path = name.replace("\\", "/")
            deps.append(_dep(path.rsplit("/", 1)[-1].removesuffix(".csproj"), line_of(text, name), path.rsplit("/", 1)[0] if "/" in path else "."))
    return _made("msbuild", "C#", next((e.text for e in root.iter() if _local(e.tag) == "AssemblyName"), None), deps)


_PARSERS = {"Cargo.toml": cargo, "package.json": package_json, "go.mod": go_mod, "pyproject.toml": pyproject, "requirements.txt": requirements, "pom.xml": maven, "build.gradle": gradle, "build.gradle.kts": gradle}


def parse(path: str, text: str) -> list[dict]:
    folder, _, name = path.rpartition("/")
    made = csproj(text) if name.endswith(".csproj") else _PARSERS[name](text)
    if not made["name"]:
        made["name"] = name.removesuffix(".csproj") if name.endswith(".csproj") else folder.rsplit("/", 1)[-1] or None
    return [{"dir": folder, **made}]


def manifests(files: DataFrame) -> DataFrame:
    """The manifests of `files`; one that can't be parsed is a row with its error."""
    name = F.substring_index("path", "/", -1)
    return extract(files, parse, DDL, name.isin(*NAMES) | name.endswith(".csproj"))
