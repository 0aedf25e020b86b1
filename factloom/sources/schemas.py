"""Database schemas: SQL definitions, Prisma, Alembic and Liquibase, replayed in order to tables with columns and lines."""

from __future__ import annotations

import ast
import json
import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.files import extract
from factloom.sources.manifests import _local, _xml

COLUMN = "struct<name:string,type_name:string,primary_key:boolean,nullable:boolean,unique:boolean,references:string,default:string,constraints:array<string>,line:int>"
DDL = f"table string, source string, line int, columns array<{COLUMN}>, values_of array<struct<column:string,values:array<string>>>"


def blank(sql: str) -> str:
    """SQL of the same length with comments and string contents blanked, so that offsets stay."""

    def gone(m: re.Match) -> str:
        x = m[0]
        return x[0] + re.sub(r"[^\n]", " ", x[1:-1]) + x[-1] if x[0] == "'" else re.sub(r"[^\n]", " ", x)

    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", gone, sql, flags=re.S)


def close(text: str, at: int, pair: str = "()") -> int:
    """The place of the bracket that closes the one at `at`; the end if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    return len(text)


def split_top(text: str, sep: str = ",") -> list[tuple[int, str]]:
    """(offset, part) of a text cut at separators outside all brackets and quotes."""
    out, depth, begin, quote = [], 0, 0, ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == sep and not depth:
            out.append((begin, text[begin:i]))
            begin = i + 1
    out.append((begin, text[begin:]))
    return [(b, p) for b, p in out if p.strip()]


def up_half(sql: str) -> str:
    """The part of a migration that goes up; the rest blanked, so that lines stay."""
    m = re.search(r"(?im)^--\s*(?:\+goose|migrate:|\+migrate)\s*:?\s*down\b", sql)
    return sql[: m.start()] + re.sub(r"[^\n]", " ", sql[m.start() :]) if m else sql


def _name(raw: str) -> str:
    return raw.strip().split(".")[-1].strip("\"`[] ")


_ID = r"(?:[\"`\[]?\w+[\"`\]]?\.)?[\"`\[]?\w+[\"`\]]?"
_TAIL = r"\b(?:NOT\s+NULL|NULL|PRIMARY\s+KEY|UNIQUE|REFERENCES|DEFAULT|CHECK|CONSTRAINT|GENERATED|COLLATE|AUTO_INCREMENT|AUTOINCREMENT|COMMENT|ON\s+UPDATE)\b"


def _values(body: str) -> list[str]:
    return re.findall(r"'((?:[^']|'')*)'", body)


def _column(raw: str, line: int) -> tuple[dict, list[str]]:
    """A column definition, and the values its check closes it to."""
    seen = blank(raw)
    m = re.match(rf"\s*({_ID})\s*", seen)
    rest, at = seen[m.end() :], m.end()
    tail = re.search(_TAIL, rest, re.I)
    kind = re.sub(r"\s+", " ", raw[at : at + (tail.start() if tail else len(rest))]).strip()
    extra, seen_tail = (raw[at + tail.start() :], rest[tail.start() :]) if tail else ("", "")
    ref = re.search(rf"REFERENCES\s+({_ID})\s*(?:\(\s*({_ID})\s*\))?", extra, re.I)
    default = re.search(rf"DEFAULT\s+('(?:[^']|'')*'|.+?)(?=\s+(?:{_TAIL})|$)", extra.strip(), re.I | re.S)
    key = bool(re.search(r"PRIMARY\s+KEY", seen_tail, re.I))
    constraints, closed = [], []
    for c in re.finditer(r"CHECK\s*\(", seen_tail, re.I):
        body = extra[c.end() : close(seen_tail, c.end() - 1)]
        constraints.append("CHECK (" + re.sub(r"\s+", " ", body).strip() + ")")
        inside = re.search(rf"{re.escape(_name(m[1]))}[\"`]?\s+IN\s*\(|ANY\s*\(", body, re.I)
        closed += _values(body[inside.end() :]) if inside else []
    return {
        "name": _name(m[1]), "type_name": kind.upper() if kind.islower() or kind.isupper() else kind, "primary_key": key, "nullable": not (key or re.search(r"NOT\s+NULL", seen_tail, re.I)), "unique": bool(re.search(r"\bUNIQUE\b", seen_tail, re.I)),
        "references": f"{_name(ref[1])}.{_name(ref[2]) if ref[2] else 'id'}" if ref else None, "default": default[1].strip() if default else None, "constraints": constraints, "line": line,
    }, closed


def sql_tables(sql: str, base_line: int = 1) -> list[dict]:
    """Tables after all CREATE and ALTER statements of a text, in order of creation."""
    sql = up_half(sql)
    seen = blank(sql)
    line = lambda at: sql.count("\n", 0, at) + base_line
    tables: dict[str, dict] = {}
    enums: dict[str, list[str]] = {}
    for m in re.finditer(rf"CREATE\s+TYPE\s+({_ID})\s+AS\s+ENUM\s*\(", seen, re.I):
        enums[_name(m[1]).lower()] = _values(sql[m.end() : close(seen, m.end() - 1)])
    for m in re.finditer(rf"CREATE\s+(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_ID})\s*\(", seen, re.I):
        name, begin = _name(m[1]), m.end()
        t = {"table": name, "source": "ddl", "line": line(m.start()), "columns": [], "values_of": []}
        body, blanked = sql[begin : close(seen, begin - 1)], seen[begin : close(seen, begin - 1)]
        for at, part in split_top(blanked):
            raw, words = body[at : at + len(part)], part.split()
            place = line(begin + at + len(part) - len(part.lstrip()))
            if re.match(r"\s*(?:CONSTRAINT\s+\S+\s+)?(?:PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK|EXCLUDE|INDEX|KEY)\b", part, re.I):
                _table_constraint(t, raw)
            elif len(words) > 1:
                column, closed = _column(raw, place)
                t["columns"].append(column)
                if closed:
                    t["values_of"].append({"column": column["name"], "values": closed})
        tables.setdefault(name, t)
    for m in re.finditer(rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?({_ID})\s+([^;]*)", seen, re.I):
        t = tables.setdefault(_name(m[1]), {"table": _name(m[1]), "source": "ddl", "line": line(m.start()), "columns": [], "values_of": []})
        for at, part in split_top(m[2]):
            raw, place = sql[m.start(2) + at : m.start(2) + at + len(part)], line(m.start(2) + at + len(part) - len(part.lstrip()))
            if add := re.match(r"\s*ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?!CONSTRAINT|PRIMARY|UNIQUE\s*\(|FOREIGN|CHECK)", part, re.I):
                column, closed = _column(raw[add.end() :], place)
                t["columns"].append(column)
                if closed:
                    t["values_of"].append({"column": column["name"], "values": closed})
            elif re.match(r"\s*ADD\b", part, re.I):
                _table_constraint(t, re.sub(r"(?i)^\s*ADD\s+", "", raw))
            elif drop := re.match(rf"\s*DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?({_ID})", part, re.I):
                t["columns"] = [c for c in t["columns"] if c["name"] != _name(drop[1])]
            elif to := re.match(rf"\s*RENAME\s+(?:COLUMN\s+)?({_ID})\s+TO\s+({_ID})", part, re.I):
                for c in t["columns"]:
                    c["name"] = _name(to[2]) if c["name"] == _name(to[1]) else c["name"]
            elif null := re.match(rf"\s*ALTER\s+(?:COLUMN\s+)?({_ID})\s+(SET|DROP)\s+NOT\s+NULL", part, re.I):
                for c in t["columns"]:
                    c["nullable"] = null[2].upper() == "DROP" if c["name"] == _name(null[1]) else c["nullable"]
    for m in re.finditer(rf"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?({_ID})", seen, re.I):
        tables.pop(_name(m[1]), None)
    for t in tables.values():
        for c in t["columns"]:
            closed = enums.get(_name(c["type_name"].split("(")[0]).lower())
            if closed:
                t["values_of"].append({"column": c["name"], "values": closed})
    return list(tables.values())


def _table_constraint(t: dict, raw: str) -> None:
    """Carry a table constraint to the columns it names."""
    body = re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", raw)
    names = [_name(x) for x in body[1].split(",")] if body else []
    ref = re.search(rf"REFERENCES\s+({_ID})\s*(?:\(([^)]*)\))?", raw, re.I)
    for c in t["columns"]:
        if c["name"] in names:
            if re.search(r"PRIMARY\s+KEY", raw, re.I):
                c["primary_key"], c["nullable"] = True, False
            elif re.search(r"FOREIGN\s+KEY", raw, re.I) and ref:
                far = [_name(x) for x in (ref[2] or "id").split(",")]
                c["references"] = f"{_name(ref[1])}.{far[min(names.index(c['name']), len(far) - 1)]}"
            elif re.search(r"\bUNIQUE\b", raw, re.I) and len(names) == 1:
                c["unique"] = True
        elif re.search(r"\bCHECK\b", raw, re.I) and body and (inside := re.search(rf"\b{re.escape(c['name'])}\b[\"`]?\s+IN\s*\(", body[1], re.I)):
            t["values_of"].append({"column": c["name"], "values": _values(body[1][inside.end() :])})


def prisma(text: str) -> list[dict]:
    """Models of a Prisma schema; relations become references of the columns that hold them."""
    enums = {m[1]: re.findall(r"(?m)^\s*(\w+)\s*(?:@.*)?$", m[2]) for m in re.finditer(r"(?ms)^enum\s+(\w+)\s*\{(.*?)^\}", text)}
    bodies = list(re.finditer(r"(?ms)^model\s+(\w+)\s*\{\n?(.*?)^\}", text))
    mapped = {m[1]: (re.search(r'@@map\("([^"]+)"\)', m[2]) or [None, m[1]])[1] for m in bodies}
    out = []
    for m in bodies:
        start, columns, refs, closed = text.count("\n", 0, m.start(2)) + 1, [], {}, []
        keys = re.search(r"@@id\(\[([^\]]*)\]", m[2])
        for n, line in enumerate(m[2].split("\n")):
            f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$", re.sub(r"//.*", "", line))
            if not f or f[1].startswith("@"):
                continue
            if f[2] in mapped:
                rel = re.search(r"fields:\s*\[([^\]]*)\].*?references:\s*\[([^\]]*)\]", f[5])
                if rel:
                    refs |= {a.strip(): f"{mapped[f[2]]}.{b.strip()}" for a, b in zip(rel[1].split(","), rel[2].split(","), strict=False)}
                continue
            own = re.search(r'@map\("([^"]+)"\)', f[5])
            default = re.search(r"@default\((.*)\)", f[5])
            column = {"name": own[1] if own else f[1], "type_name": f[2] + (f[3] or ""), "primary_key": "@id" in f[5] or bool(keys and f[1] in re.split(r"\s*,\s*", keys[1])), "nullable": bool(f[4]), "unique": "@unique" in f[5], "references": None, "default": default and default[1].split(") @")[0], "constraints": [], "line": start + n}
            columns.append((f[1], column))
            if f[2] in enums:
                closed.append({"column": column["name"], "values": enums[f[2]]})
        for field, column in columns:
            column["references"] = refs.get(field)
        out.append({"table": mapped[m[1]], "source": "prisma", "line": text.count("\n", 0, m.start()) + 1, "columns": [c for _, c in columns], "values_of": closed})
    return out


def alembic(text: str) -> list[dict]:
    """Tables that the upgrade of an Alembic migration creates or extends."""
    tree = ast.parse(text)
    body = next((f for f in tree.body if isinstance(f, ast.FunctionDef) and f.name == "upgrade"), None)
    tables: dict[str, dict] = {}
    said = lambda e: e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None

    def column(call: ast.Call) -> dict:
        kw = {k.arg: k.value for k in call.keywords}
        flag = lambda n, default: kw[n].value if n in kw and isinstance(kw[n], ast.Constant) else default
        ref = next((said(a.args[0]) for a in call.args[1:] if isinstance(a, ast.Call) and ast.unparse(a.func).endswith("ForeignKey") and a.args), None)
        kind = next((ast.unparse(a).removeprefix("sa.").removesuffix("()") for a in call.args[1:] if not ast.unparse(a).startswith(("sa.ForeignKey", "ForeignKey"))), "")
        default = kw.get("server_default") or kw.get("default")
        key = bool(flag("primary_key", False))
        return {"name": said(call.args[0]), "type_name": kind, "primary_key": key, "nullable": bool(flag("nullable", not key)), "unique": bool(flag("unique", False)), "references": ref, "default": ast.unparse(default).strip("'\"") if default else None, "constraints": [], "line": call.lineno}

    for call in (n for n in ast.walk(body) if isinstance(n, ast.Call)) if body else ():
        name = ast.unparse(call.func)
        if not name.startswith("op.") or not call.args or said(call.args[0]) is None:
            continue
        t = tables.setdefault(said(call.args[0]), {"table": said(call.args[0]), "source": "alembic", "line": call.lineno, "columns": [], "values_of": []})
        columns = [a for a in call.args[1:] if isinstance(a, ast.Call) and ast.unparse(a.func).endswith("Column")]
        if name in ("op.create_table", "op.add_column"):
            t["columns"] += [column(c) for c in columns if c.args and said(c.args[0])]
        elif name == "op.drop_column" and len(call.args) > 1:
            t["columns"] = [c for c in t["columns"] if c["name"] != said(call.args[1])]
        elif name == "op.drop_table":
            tables.pop(said(call.args[0]))
    return [t for t in tables.values() if t["columns"]]


def _yes(x) -> bool:
    return str(x).lower() == "true"


def liquibase(text: str, path: str) -> list[dict]:
    """Tables of one changelog, its changes replayed in order. Includes are followed by the order of `includes`."""
    changes: list[tuple[str, dict, list[dict], int]] = []
    if path.endswith(".xml"):
        for e in _xml(text).iter():
            name = _local(e.tag)
            if name in ("createTable", "addColumn", "dropColumn", "dropTable", "renameColumn", "addForeignKeyConstraint", "addPrimaryKey", "addUniqueConstraint", "addNotNullConstraint"):
                columns = [{**c.attrib, "constraints": {k: v for x in c if _local(x.tag) == "constraints" for k, v in x.attrib.items()}} for c in e if _local(c.tag) == "column"]
                key = e.get("tableName") or e.get("baseTableName")
                changes.append((name, dict(e.attrib), columns, text.count("\n", 0, max(text.find(f'ableName="{key}"'), 0)) + 1))
    else:
        doc = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
        for entry in (doc or {}).get("databaseChangeLog") or ():
            for change in (entry.get("changeSet") or {}).get("changes") or () if isinstance(entry, dict) else ():
                for name, given in change.items():
                    if isinstance(given, dict):
                        key = given.get("tableName") or given.get("baseTableName")
                        changes.append((name, given, [c.get("column", c) for c in given.get("columns") or ()], text.count("\n", 0, max(text.find(str(key)), 0)) + 1))
    tables: dict[str, dict] = {}
    for name, given, columns, line in changes:
        key = given.get("tableName") or given.get("baseTableName")
        t = tables.setdefault(key, {"table": key, "source": "liquibase", "line": line, "columns": [], "values_of": []})
        find = {c["name"]: c for c in t["columns"]}
        if name in ("createTable", "addColumn"):
            for c in columns:
                k = c.get("constraints") or {}
                ref = re.match(r"(\w+)\s*\(\s*(\w+)", str(k.get("references", "")))
                pk = _yes(k.get("primaryKey"))
                default = next((str(v) for x, v in c.items() if x.startswith("defaultValue")), None)
                t["columns"].append({"name": c.get("name"), "type_name": str(c.get("type", "")), "primary_key": pk, "nullable": not pk and not (k.get("nullable") is not None and not _yes(k["nullable"])), "unique": _yes(k.get("unique")), "references": f"{ref[1]}.{ref[2]}" if ref else None, "default": default, "constraints": [], "line": line})
        elif name == "dropTable":
            tables.pop(key)
        elif name == "dropColumn":
            t["columns"] = [c for c in t["columns"] if c["name"] != given.get("columnName")]
        elif name == "renameColumn" and given.get("oldColumnName") in find:
            find[given["oldColumnName"]]["name"] = given.get("newColumnName")
        elif name == "addForeignKeyConstraint" and given.get("baseColumnNames") in find:
            find[given["baseColumnNames"]]["references"] = f"{given.get('referencedTableName')}.{given.get('referencedColumnNames')}"
        elif name in ("addPrimaryKey", "addUniqueConstraint", "addNotNullConstraint"):
            for c in str(given.get("columnNames") or given.get("columnName")).split(","):
                if c.strip() in find:
                    find[c.strip()] |= {"addPrimaryKey": {"primary_key": True, "nullable": False}, "addUniqueConstraint": {"unique": True}, "addNotNullConstraint": {"nullable": False}}[name]
    return [t for t in tables.values() if t["columns"]]


def includes(text: str, path: str) -> list[str]:
    """The files that a master changelog includes, in order."""
    if path.endswith(".xml"):
        return [e.get("file") or e.get("path") for e in _xml(text).iter() if _local(e.tag) in ("include", "includeAll")]
    doc = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    entries = (doc or {}).get("databaseChangeLog") or ()
    return [(e.get("include") or e.get("includeAll") or {}).get("file") or (e.get("includeAll") or {}).get("path") for e in entries if isinstance(e, dict) and ("include" in e or "includeAll" in e)]


def parse(path: str, text: str) -> list[dict]:
    if path.endswith(".sql"):
        return sql_tables(text)
    if path.endswith(".prisma"):
        return prisma(text)
    if path.endswith(".py"):
        return alembic(text)
    return liquibase(text, path)


def tables(files: DataFrame) -> DataFrame:
    """Table declarations of every schema file, a row each: merge them in path order with :func:`merged`."""
    p, c = F.col("path"), F.col("content")
    changelog = p.rlike(r"\.(xml|ya?ml|json)$") & F.contains(c, F.lit("databaseChangeLog"))
    return extract(files, parse, DDL, p.rlike(r"\.(sql|prisma)$") | (p.endswith(".py") & F.contains(c, F.lit("op.create_table")) | p.endswith(".py") & F.contains(c, F.lit("op.add_column"))) | changelog)


def merged(declared: DataFrame) -> DataFrame:
    """One row for each (repo, table): columns of all declarations in path order, the first definition of a column wins.

    The fold is ordered by path and line, whatever the order in which files were read. System catalogues are left out.
    """
    kept = declared.where("error is null and `table` is not null").where(~F.col("table").rlike(r"^(pg_|information_schema|sqlite_)"))
    listed = kept.groupBy("repo", "table").agg(F.array_sort(F.collect_list(F.struct("path", "line", "source", "columns", "values_of"))).alias("d"))
    flat = F.flatten(F.transform("d", lambda x: F.transform(x["columns"], lambda c: F.struct(x["path"].alias("path"), c.alias("c")))))
    once = F.aggregate(flat, F.slice(flat, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y["c"]["name"]) == F.lower(x["c"]["name"])), a).otherwise(F.array_append(a, x)))
    return listed.select(
        "repo", "table", F.array_join(F.array_distinct(F.transform("d", lambda x: x["source"])), "+").alias("source"), F.element_at("d", 1)["path"].alias("path"), F.element_at("d", 1)["line"].alias("line"),
        F.transform(once, lambda x: x["c"]).alias("columns"), F.flatten(F.transform("d", lambda x: x["values_of"])).alias("values_of"),
    )
