"""Entities that code declares, what it reads and writes, and the state changes it makes."""

from __future__ import annotations

import ast
import re

from factloom.extract.code import Source
from factloom.sources import catalog
from factloom.sources.schemas import blank, close, split_top

ENTITY = (
    "name string, table string, source string, line int, columns array<struct<name:string,type_name:string,primary_key:boolean,nullable:boolean,unique:boolean,references:string,default:string,constraints:array<string>,line:int>>, "
    "values_of array<struct<column:string,values:array<string>>>"
)
ACCESS = "line int, symbol string, table string, mode string, sets array<struct<column:string,value:string>>, wheres array<struct<column:string,value:string>>, conditions array<string>, inserted array<struct<column:string,value:string>>"


def snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


def plural(name: str) -> str:
    if re.search(r"[^aeiou]y$", name):
        return name[:-1] + "ies"
    return name + ("es" if re.search(r"(s|x|z|ch|sh)$", name) else "s")


_SQL = re.compile(r"\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|WITH\b.*\bAS\s*\()", re.I | re.S)
_NOT_TABLES = set("the a an this that these those all any each one your our its their where select set values only lateral unnest".split())


def is_sql(text: str) -> bool:
    return bool(_SQL.match(text))


def conditions(where: str) -> list[str]:
    """The conditions that AND joins at the outer level."""
    out, depth, begin, low = [], 0, 0, blank(where).lower()
    for i in range(len(where)):
        depth += (where[i] == "(") - (where[i] == ")")
        if not depth and re.match(r"\sand\s", low[i : i + 5]):
            out.append(where[begin:i])
            begin = i + 5
    return [re.sub(r"\s+", " ", c).strip() for c in [*out, where[begin:]] if c.strip()]


def statement(sql: str) -> dict | None:
    """Kind, target, reads, sets, wheres, conditions and inserted values of an SQL text; null if it names no table."""
    if not is_sql(sql):
        return None
    flat = re.sub(r"--[^\n]*", "", sql)
    ctes = {m.lower() for m in re.findall(r"(?:\bWITH(?:\s+RECURSIVE)?|,)\s+(\w+)\s+AS\s*\(", flat, re.I)}
    table = r"(?:ONLY\s+)?[\"`\[]?(?:\w+[\"`\]]?\.[\"`\[]?)?(\w+)"
    write = re.search(rf"\b(INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+{table}", flat, re.I)
    target = write[2] if write else None
    reads = []
    for m in re.finditer(rf"\b(?:FROM|JOIN)\s+{table}(?!\s*\()", flat, re.I):
        if m[1].lower() not in _NOT_TABLES | ctes and m[1] != target and m[1] not in reads:
            reads.append(m[1])
    if not target and not reads or target and target.lower() in _NOT_TABLES:
        return None
    value = r"('(?:[^']|'')*'|[\w.$:@%?{}]+(?:\([^()]*\))?)"
    pairs = lambda text, sep: [{"column": m[1], "value": m[2]} for _, p in split_top(text, sep) if (m := re.match(rf"\s*(?:\w+\.)?[\"`]?(\w+)[\"`]?\s*=\s*{value}", p))]
    sets = re.search(r"\bSET\s+(.*?)(?:\bWHERE\b|\bRETURNING\b|\bFROM\b|\bON\s+CONFLICT\b|$)", flat, re.I | re.S) if write and write[1].upper() == "UPDATE" else None
    where = re.search(r"\bWHERE\s+(.*?)(?:\bRETURNING\b|\bORDER\s+BY\b|\bGROUP\s+BY\b|\bLIMIT\b|;|$)", flat, re.I | re.S)
    every = conditions(where[1]) if where else []
    wheres = [p for c in every for p in pairs(c, "\0")]
    for c in every:
        if m := re.match(r"(?:\w+\.)?(\w+)\s+IN\s*\((.*)\)$", c, re.I | re.S):
            wheres += [{"column": m[1], "value": v} for v in re.findall(r"'(?:[^']|'')*'", m[2])]
    inserted = []
    if write and write[1].upper().startswith("INSERT") and (m := re.search(rf"INTO\s+{table}\s*\(([^)]*)\)\s*VALUES\s*\(", flat, re.I)):
        values = [v.strip() for _, v in split_top(flat[m.end() : close(flat, m.end() - 1)])]
        inserted = [{"column": c.strip().strip('"`'), "value": v} for c, v in zip(m[2].split(","), values, strict=False)]
    kind = "write" if write else "read"
    return {"kind": kind, "target": target, "reads": reads, "sets": pairs(sets[1], ",") if sets else [], "wheres": wheres, "conditions": every, "inserted": inserted}


def business_conditions(given: list[str], state: str | None = None) -> list[str]:
    """Conditions that are rules: no keys and parameters, nothing about the state column."""
    return [c for c in given if not re.match(rf"(?:\w+\.)?(?:id|\w+_id|uuid{'|' + state if state else ''})\s*(?:=|IN\b)", c, re.I) and not re.search(r"=\s*(?:\$\d+|\?|:\w+|%s)$", c)]


def _symbol_of(path: str, text: str):
    """What function holds a line."""
    from factloom.extract.code import parse

    facts = parse(path, text)
    inside = [s for s in facts[0]["symbols"] if s["kind"] in ("function", "method")] if facts else []

    def find(line: int) -> str | None:
        held = [s for s in inside if s["start_line"] <= line <= s["end_line"]]
        return min(held, key=lambda s: s["end_line"] - s["start_line"])["name"] if held else None

    return find


def literals(path: str, text: str) -> list[tuple[int, str]]:
    """(line, value) of a source file's whole string literals; parts that the compiler joins are joined."""
    if path.endswith(".py"):
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return []
        out = [(n.lineno, n.value) for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        return out + [(n.lineno, "".join(v.value if isinstance(v, ast.Constant) else "?" for v in n.values)) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr)]
    language = catalog.language_of(path)
    if not language:
        return []
    src = Source(text, language)
    out: list[tuple[int, str]] = []
    end = None
    for at, said in src.literals:
        if end is not None and re.fullmatch(r"\s*\+\s*", src.code[end:at]):
            out[-1] = (out[-1][0], out[-1][1] + said)
        else:
            out.append((src.line(at), said))
        end = src.code.find(src.code[at] if src.code[at] in "\"'`" else '"', at + len(said) + 1) + 1 or None
    return out


def accesses(path: str, text: str) -> list[dict]:
    """What the SQL in a source file's literals reads and writes."""
    holder, out = None, []
    for line, said in literals(path, text):
        if not is_sql(said):
            continue
        found = statement(said)
        if not found:
            continue
        holder = holder or _symbol_of(path, text)
        base = {"line": line, "symbol": holder(line), "sets": found["sets"], "wheres": found["wheres"], "conditions": found["conditions"], "inserted": found["inserted"]}
        if found["target"]:
            out.append({**base, "table": found["target"], "mode": "write"})
        out += [{"line": line, "symbol": base["symbol"], "table": t, "mode": "read", "sets": [], "wheres": [], "conditions": found["conditions"], "inserted": []} for t in found["reads"]]
    return out


def _col(name, kind, line, key=False, null=False, unique=False, ref=None, default=None) -> dict:
    return {"name": name, "type_name": kind or "", "primary_key": key, "nullable": null, "unique": unique, "references": ref, "default": default, "constraints": [], "line": line}


def _python(text: str) -> list[dict]:
    """SQLModel, SQLAlchemy and Django."""
    tree = ast.parse(text)
    classes = [c for c in ast.walk(tree) if isinstance(c, ast.ClassDef)]
    enums = {c.name: [n.value.value for n in c.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant)] for c in classes if any("Enum" in ast.unparse(b) or b_name in ("TextChoices",) for b in c.bases for b_name in [ast.unparse(b).split(".")[-1]])}
    out = []
    for c in classes:
        bases, keywords = [ast.unparse(b) for b in c.bases], {k.arg: ast.unparse(k.value) for k in c.keywords}
        django = any(b.endswith("models.Model") or b == "Model" for b in bases)
        model = keywords.get("table") == "True"
        named = next((n.value.value for n in c.body if isinstance(n, ast.Assign) and ast.unparse(n.targets[0]) == "__tablename__" and isinstance(n.value, ast.Constant)), None)
        if not (django or model or named):
            continue
        meta = next((n for n in c.body if isinstance(n, ast.ClassDef) and n.name == "Meta"), None)
        table = named or next((n.value.value for n in (meta.body if meta else ()) if isinstance(n, ast.Assign) and ast.unparse(n.targets[0]) == "db_table"), None) or c.name.lower()
        columns, closed = [], []
        for n in c.body:
            name = ast.unparse(n.targets[0]) if isinstance(n, ast.Assign) else ast.unparse(n.target) if isinstance(n, ast.AnnAssign) else None
            if not name or name.startswith("__") or "Relationship" in ast.unparse(n) or "relationship(" in ast.unparse(n):
                continue
            call = n.value if isinstance(n.value, ast.Call) else None
            kind = ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else None
            if not (call or model and kind):
                continue
            made, kw = (ast.unparse(call.func).split(".")[-1], {k.arg: ast.unparse(k.value).strip("'\"") for k in call.keywords}) if call else ("", {})
            if django:
                if not made.endswith(("Field", "Key")):
                    continue
                ref = None
                if made in ("ForeignKey", "OneToOneField") and call.args:
                    ref, name = ast.unparse(call.args[0]).strip("'\"").split(".")[-1].lower() + ".id", name + "_id"
                columns.append(_col(name, made.removesuffix("Field"), n.lineno, kw.get("primary_key") == "True", kw.get("null") == "True", kw.get("unique") == "True", ref, kw.get("default")))
                choices = kw.get("choices", "").split(".")[0]
                if choices in enums:
                    closed.append({"column": name, "values": enums[choices]})
            elif made in ("Column", "mapped_column") or model:
                inner = [ast.unparse(a) for a in call.args] if call else []
                foreign = next((re.search(r"ForeignKey\(['\"]([\w.]+)", a)[1] for a in inner if re.search(r"ForeignKey\(['\"]([\w.]+)", a)), kw.get("foreign_key"))
                plain = re.sub(r"^Mapped\[(.*)\]$", r"\1", kind or "")
                key = kw.get("primary_key") == "True"
                null = kw.get("nullable") == "True" or (kw.get("nullable") is None and not key and ("None" in plain or "Optional" in plain or (made == "Column" and not kind)))
                shown = next((a.split("(")[0].split(".")[-1] for a in inner if not a.startswith(("ForeignKey", "sa.ForeignKey", "'", '"'))), None) or re.sub(r"Optional\[(.*)\]|(.*?)\s*\|\s*None", lambda m: m[1] or m[2], plain)
                default = kw.get("default") or kw.get("server_default") or (ast.unparse(n.value).strip("'\"") if n.value is not None and not call else None)
                columns.append(_col(name, shown, n.lineno, key, null, kw.get("unique") == "True", foreign, default))
                enum = next((e for e in enums if re.search(rf"\b{e}\b", " ".join([plain, *inner]))), None)
                if enum:
                    closed.append({"column": name, "values": enums[enum]})
        if django and not any(x["primary_key"] for x in columns):
            columns.insert(0, _col("id", "BigAuto", c.lineno, True))
        out.append({"name": c.name, "table": table, "source": "django" if django else "sqlmodel" if model else "sqlalchemy", "line": c.lineno, "columns": columns, "values_of": closed})
    return out


def _jvm(path: str, text: str, language: str) -> list[dict]:
    """JPA, Spring Data and Mongo documents in Java and Kotlin; Exposed tables."""
    src, out = Source(text, language), []
    enums = {m[1]: re.findall(r"\b([A-Z][A-Z0-9_]*)\b", re.split(r";", src.code[m.end() : close(src.code, m.end() - 1, "{}")])[0]) for m in re.finditer(r"\benum\s+(?:class\s+)?(\w+)[^{]*\{", src.code)}
    for m in re.finditer(r"@(Entity|Document|MappedEntity|Table)\b", src.code):
        head = re.compile(r"\b(?:class|record)\s+(\w+)").search(src.code, m.end())
        if not head or any(e["name"] == head[1] for e in out) or "{" in src.code[m.end() : head.start()]:
            continue
        begin = max(src.code.rfind("}", 0, m.start()), src.code.rfind(";", 0, m.start())) + 1
        marks = src.text[begin : head.start()]
        named = re.search(r"@Table\s*\([^)]*?name\s*=\s*\"(\w+)\"|@(?:Table|Document|MappedEntity)\s*\(\s*(?:collection\s*=\s*|value\s*=\s*)?\"(\w+)\"", marks)
        document = "@Document" in marks
        table = (named[1] or named[2]) if named else head[1][0].lower() + head[1][1:] if document else snake(head[1])
        opened = re.compile(r"[({]").search(src.code, head.end())
        body_at = opened.start() if opened else head.end()
        pair = "()" if opened and opened[0] == "(" else "{}"
        body = src.code[body_at + 1 : close(src.code, body_at, pair)]
        if language == "Kotlin" or pair == "()":
            fields = re.finditer(r"((?:@(?:\w+:)?\w+(?:\([^)]*\))?\s*)*)(?:(?:private|public|override|lateinit)\s+)*(?:val|var)\s+(?P<n>\w+)\s*:\s*(?P<t>[\w<>.]+\??)(?:\s*=\s*(?P<d>[^,\n)]+))?" if language == "Kotlin" else r"((?:@\w+(?:\([^)]*\))?\s*)*)(?P<t>[\w<>.]+)\s+(?P<n>\w+)(?P<d>(?!.))?\s*(?:,|$)", body)
        else:
            fields = re.finditer(r"((?:@\w+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)(?:(?:private|protected|public|final)\s+)+(?P<t>[\w.]+(?:<[^;=()]*>)?)\s+(?P<n>\w+)\s*(?:=\s*(?P<d>[^;]+))?;", body)
        columns, closed = [], []
        for f in fields:
            at = body_at + 1 + f.start("n")
            marks_of = src.text[body_at + 1 + f.start(1) : body_at + 1 + f.end(1)] if f[1] else ""
            kind = f["t"]
            if "static" in f[0] or re.search(r"@(OneToMany|ManyToMany|Transient)\b", marks_of):
                continue
            renamed = re.search(r"@(?:Column|Field|JoinColumn)\s*\(\s*(?:[^)]*?name\s*=\s*)?\"(\w+)\"", marks_of)
            relation = re.search(r"@(ManyToOne|OneToOne)\b", marks_of)
            name = renamed[1] if renamed else (f["n"] if document else snake(f["n"])) + ("_id" if relation else "")
            key = bool(re.search(r"@(?:Id|EmbeddedId|BsonId)\b", marks_of))
            null = kind.endswith("?") if language == "Kotlin" else not (key or re.search(r"nullable\s*=\s*false|@NotNull|@NotBlank|optional\s*=\s*false", marks_of) or kind in ("int", "long", "boolean", "double", "float"))
            bare = kind.rstrip("?")
            default = re.search(r"(?:\w+\.)?([\w\"'.-]+)$", src.text[body_at + 1 + f.start("d") : body_at + 1 + f.end("d")].strip()) if f["d"] else None
            columns.append(_col(name, bare, src.line(at), key, null, bool(re.search(r"unique\s*=\s*true", marks_of)), f"{snake(bare)}.id" if relation else None, default and default[1].strip('"')))
            if bare in enums:
                closed.append({"column": name, "values": enums[bare]})
        out.append({"name": head[1], "table": table, "source": "mongo" if document else "jpa", "line": src.line(head.start(1)), "columns": columns, "values_of": closed})
    if language == "Kotlin":
        for m in re.finditer(r"\bobject\s+(\w+)\s*:\s*(\w*Table)\s*(?:<[^>]*>)?\(\s*(?:\"[^\"]*\")?[^)]*\)\s*\{", src.code):
            name = src.literal(src.code.index("(", m.start()) + 1) or m[1]
            body_at = m.end() - 1
            columns = [_col("id", "integer", src.line(m.start()), True)] if m[2] != "Table" else []
            for f in re.finditer(r"\bval\s+(\w+)(?:\s*:\s*[^=\n]+)?\s*=\s*(\w+)\s*(?:<[^>]*>)?\(([^\n]*)", src.code[body_at : close(src.code, body_at, "{}")]):
                at = body_at + f.start(1)
                rest = src.text[body_at + f.start(3) : body_at + f.end(3)]
                column = src.literal(body_at + f.start(3)) or snake(f[1])
                ref = re.search(r"references?\(\s*(?:\"\w+\",\s*)?(\w+)", rest) if f[2] != "reference" else re.search(r",\s*(\w+)", rest)
                columns.append(_col(column, f[2], src.line(at), "primaryKey" in rest, ".nullable()" in rest, "uniqueIndex" in rest, f"{snake(ref[1])}.id" if ref else None))
            out.append({"name": m[1], "table": name, "source": "exposed", "line": src.line(m.start()), "columns": columns, "values_of": []})
    return out


def _script(text: str, language: str) -> list[dict]:
    """TypeORM entities and Drizzle tables."""
    src, out = Source(text, language), []
    enums = {m[1]: re.findall(r"=\s*[\"'](\w+)[\"']", src.text[m.end() : close(src.code, m.end() - 1, "{}")]) for m in re.finditer(r"\benum\s+(\w+)\s*\{", src.code)}
    for m in re.finditer(r"@Entity\s*\(\s*", src.code):
        head = re.compile(r"class\s+(\w+)[^{]*\{").search(src.code, m.end())
        if not head:
            continue
        named = src.literal(m.end()) or (re.search(r"name\s*:\s*[\"'](\w+)", src.text[m.end() : head.start()]) or [None, snake(head[1])])[1]
        body_at, columns, closed = head.end() - 1, [], []
        body = src.code[body_at : close(src.code, body_at, "{}")]
        for f in re.finditer(r"((?:@\w+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*)+)(?:(?:public|private|readonly)\s+)*(\w+)[?!]?\s*:\s*([\w\[\]| ]+)", body):
            marks = src.text[body_at + f.start(1) : body_at + f.end(1)]
            if re.search(r"@(OneToMany|ManyToMany)\b", marks) or not re.search(r"@(\w*Column|ManyToOne|OneToOne)\b", marks):
                continue
            renamed = re.search(r"name\s*:\s*[\"'](\w+)", marks)
            relation = re.search(r"@(?:ManyToOne|OneToOne)\s*\(\s*\(\)\s*=>\s*(\w+)", marks)
            kind = re.search(r"Column\s*\(\s*[\"'](\w+)|type\s*:\s*[\"'](\w+)", marks)
            default = re.search(r"default\s*:\s*[\"']?([\w.()]+)", marks)
            column = renamed[1] if renamed else f[2] + ("Id" if relation else "")
            columns.append(_col(column, (kind[1] or kind[2]) if kind else f[3].strip(), src.line(body_at + f.start(2)), "Primary" in marks, "nullable: true" in marks, "unique: true" in marks, f"{snake(relation[1])}.id" if relation else None, default and default[1].split(".")[-1]))
            enum = re.search(r"enum\s*:\s*(\w+)", marks)
            if enum and enum[1] in enums:
                closed.append({"column": column, "values": enums[enum[1]]})
        out.append({"name": head[1], "table": named, "source": "typeorm", "line": src.line(head.start(1)), "columns": columns, "values_of": closed})
    for m in re.finditer(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\s*\(\s*", src.code):
        body_at, columns = src.code.find("{", m.end()), []
        inner = src.code[body_at + 1 : close(src.code, body_at, "{}")]
        for at, part in split_top(inner):
            f = re.match(r"\s*(\w+)\s*:\s*(\w+)\s*\(", part)
            if f:
                place = body_at + 1 + at
                ref = re.search(r"references\(\s*\(\)\s*=>\s*(\w+)\.(\w+)", part)
                default = re.search(r"\.default\(\s*[\"']?([\w.]+)", src.text[place : place + len(part)])
                columns.append(_col(src.literal(place + f.end()) or f[1], f[2], src.line(place + f.start(1)), ".primaryKey(" in part, ".notNull(" not in part and ".primaryKey(" not in part, ".unique(" in part, f"{snake(ref[1])}.{ref[2]}" if ref else None, default and default[1]))
        out.append({"name": m[1], "table": src.literal(m.end()) or m[1], "source": "drizzle", "line": src.line(m.start()), "columns": columns, "values_of": []})
    return out


def _go(text: str) -> list[dict]:
    """GORM models: structs with gorm tags or a table name."""
    src, out = Source(text, "Go"), []
    named = {m[1]: m[2] for m in re.finditer(r"func\s+\(\w*\s*\*?(\w+)\)\s+TableName\(\)\s+string\s*\{\s*return\s+\"(\w+)\"", text)}
    for m in re.finditer(r"type\s+(\w+)\s+struct\s*\{", src.code):
        body = text[m.end() : close(src.code, m.end() - 1, "{}")]
        if not re.search(r'gorm:"|gorm\.Model\b', body) and m[1] not in named:
            continue
        columns, start = [], src.line(m.end())
        for n, line in enumerate(body.split("\n")):
            if re.match(r"\s*gorm\.Model\s*$", line):
                columns += [_col("id", "uint", start + n, True), _col("created_at", "time.Time", start + n), _col("updated_at", "time.Time", start + n), _col("deleted_at", "gorm.DeletedAt", start + n, null=True)]
            f = re.match(r"\s*(\w+)\s+(\*?[\w.\[\]]+)\s*(?:`(.*)`)?", line)
            if not f or not f[1][0].isupper():
                continue
            tag = (re.search(r'gorm:"([^"]*)"', f[3] or "") or [None, ""])[1]
            if tag == "-" or f[2].startswith("[]") and f[2] != "[]byte" or "foreignKey:" in tag:
                continue
            renamed, default = re.search(r"column:(\w+)", tag), re.search(r"default:'?([\w.()-]+)", tag)
            key = "primaryKey" in tag or "primary_key" in tag or f[1] == "ID"
            columns.append(_col(renamed[1] if renamed else snake(f[1]), f[2].lstrip("*"), start + n, key, f[2].startswith("*"), "unique" in tag.lower(), None, default and default[1]))
        out.append({"name": m[1], "table": named.get(m[1], plural(snake(m[1]))), "source": "gorm", "line": src.line(m.start()), "columns": columns, "values_of": []})
    return out


def _rust(text: str) -> list[dict]:
    """Diesel's table! blocks."""
    src, out = Source(text, "Rust"), []
    for m in re.finditer(r"(?:diesel::)?table!\s*\{", src.code):
        body = src.code[m.end() : close(src.code, m.end() - 1, "{}")]
        head = re.search(r"(\w+)\s*(?:\(([\w\s,]+)\))?\s*\{", body)
        if head:
            keys = [k.strip() for k in (head[2] or "id").split(",")]
            columns = [_col(f[1], re.sub(r"Nullable<(.*)>", r"\1", f[2]), src.line(m.end() + head.end() + f.start(1)), f[1] in keys, f[2].startswith("Nullable")) for f in re.finditer(r"(\w+)\s*->\s*([\w<>]+)", body[head.end() :])]
            out.append({"name": head[1], "table": head[1], "source": "diesel", "line": src.line(m.end() + head.start()), "columns": columns, "values_of": []})
    return out


def _csharp(text: str) -> list[dict]:
    """EF Core: classes that a DbSet names, or that have a table attribute."""
    src, out = Source(text, "C#"), []
    sets = {m[1]: m[2] for m in re.finditer(r"DbSet<(\w+)>\s+(\w+)", src.code)}
    for m in re.finditer(r"\bclass\s+(\w+)[^{]*\{", src.code):
        above = src.text[max(src.code.rfind("}", 0, m.start()), src.code.rfind(";", 0, m.start()), 0) : m.start()]
        named = re.search(r"\[Table\(\s*\"(\w+)\"", above)
        if not named and m[1] not in sets:
            continue
        columns = []
        body_at = m.end() - 1
        for f in re.finditer(r"((?:\[[^\]]*\]\s*)*)public\s+(?:required\s+|virtual\s+)?([\w<>]+\??)\s+(\w+)\s*\{\s*get", src.code[body_at : close(src.code, body_at, "{}")]):
            marks = src.text[body_at + f.start(1) : body_at + f.end(1)]
            if re.match(r"(?:I?Collection|I?List|ICollection|IEnumerable)<", f[2]) or f[2].rstrip("?") in sets:
                continue
            renamed = re.search(r"\[Column\(\s*\"(\w+)\"", marks)
            key = "[Key]" in marks or f[3] in ("Id", m[1] + "Id")
            columns.append(_col(renamed[1] if renamed else f[3], f[2].rstrip("?"), src.line(body_at + f.start(3)), key, f[2].endswith("?")))
        out.append({"name": m[1], "table": named[1] if named else sets[m[1]], "source": "efcore", "line": src.line(m.start()), "columns": columns, "values_of": []})
    return out


def entities(path: str, text: str) -> list[dict]:
    """Entities that a source file declares."""
    language = catalog.language_of(path)
    if language == "Python":
        try:
            return _python(text)
        except SyntaxError:
            return []
    if language in ("Java", "Kotlin"):
        return _jvm(path, text, language)
    if language in ("TypeScript", "JavaScript"):
        return _script(text, language)
    return {"Go": _go, "Rust": _rust, "C#": _csharp}[language](text) if language in ("Go", "Rust", "C#") else []


_WRITES = r"(?:save|insert|update|delete|create|remove|persist|merge|add|upsert|destroy|commit|put|store)\w*"
_READS = r"(?:find|get|select|query|list|count|exists|first|filter|all|load|fetch|one|scalar|where)\w*"


def orm_accesses(path: str, text: str, names: dict[str, str]) -> list[dict]:
    """Reads and writes through mapped classes: a line that names one, or a variable of its type, and calls a verb.

    `names` maps a class to its table. A read within three lines of a write of the same table in the same function
    is the same statement and is left out.
    """
    language = catalog.language_of(path)
    if not language or not any(n in text for n in names):
        return []
    code = text if language == "Python" else Source(text, language).code
    holder, out = _symbol_of(path, text), []
    held: dict[str, str] = {}
    for name in names:
        for m in re.finditer(rf"(\w+)\s*(?::=|=)\s*&?(?:new\s+)?{name}\s*[({{]|(\w+)\s*:\s*(?:\w+<)?{name}\b|\b(?:\w+<)?{name}(?:Repository|Dao)?>?\s+(\w+)\b|(\w+)\s*:\s*{name}Repository", code):
            held[next(g for g in m.groups() if g)] = name
        for m in re.finditer(rf"\b(?:class|interface)\s+(\w+)[^{{]*<\s*{name}\b", code):
            held[m[1]] = name
    for n, line in enumerate(code.split("\n"), 1):
        if re.match(r"\s*(?:import|from|use|using|package|@|class|export\s+class|type\s)", line):
            continue
        for word, name in [*((x, x) for x in names), *held.items()]:
            if not re.search(rf"\b{re.escape(word)}\b", line):
                continue
            write = re.search(rf"\b{re.escape(word)}\b.*?\.{_WRITES}\s*\(|\.{_WRITES}\s*\([^)]*\b{re.escape(word)}\b", line)
            read = re.search(rf"\b{re.escape(word)}\b.*?\.{_READS}\s*\(|\.{_READS}\s*\([^)]*\b{re.escape(word)}\b|\bselect\(\s*{re.escape(word)}\b", line)
            mode = "write" if write else "read" if read else None
            if mode:
                row = {"line": n, "symbol": holder(n), "table": names[name], "mode": mode, "sets": [], "wheres": [], "conditions": [], "inserted": []}
                if not any(x["line"] == n and x["table"] == row["table"] for x in out):
                    out.append(row)
                break
    return [r for r in out if r["mode"] == "write" or not any(w["mode"] == "write" and w["table"] == r["table"] and w["symbol"] == r["symbol"] and 0 < r["line"] - w["line"] <= 3 for w in out)]


#: A type whose name ends so hands out an entity's rows.
_REPOSITORIES = ("Repository", "Dao", "Store")
CLASS = "name string, params array<string>, parent string, args array<string>, uses array<struct<line:int,symbol:string,mode:string,param:string>>"


def _generic(text: str) -> tuple[str, list[str]]:
    """A type's name and its arguments' names."""
    m = re.match(r"\s*([\w.]+)\s*(?:<(.*)>)?", text, re.S)
    if not m:
        return "", []
    inner = [p.strip() for _, p in split_top(m[2].replace("<", "(").replace(">", ")"))] if m[2] else []
    return m[1].split(".")[-1], [re.match(r"(?:\?\s*extends\s+)?([\w.]*)", p)[1].split(".")[-1] for p in inner]


def classes(path: str, text: str) -> list[dict]:
    """Java classes with their type parameters, their parent and its arguments, and what they read and write through
    a repository that an abstract method hands out or a variable whose type is one of their parameters."""
    if catalog.language_of(path) != "Java":
        return []
    src, out, holder = Source(text, "Java"), [], _symbol_of(path, text)
    nested = r"<((?:[^<>]|<[^<>]*>)*)>"
    for m in re.finditer(rf"\bclass\s+(\w+)\s*(?:{nested})?\s*(?:extends\s+([\w.]+\s*(?:{nested})?))?[^{{;]*(\{{)", src.code):
        begin, end = m.end(), close(src.code, m.start(5), "{}")
        params = [re.match(r"\s*(\w*)", p)[1] for p in re.sub(r"<[^<>]*>", "", m[2] or "").split(",")] if m[2] else []
        parent, args = _generic(m[3]) if m[3] else (None, [])
        body, stores, values = src.code[begin:end], {}, {}
        for a in re.finditer(rf"\babstract\s+([\w.]+\s*{nested})\s+(\w+)\s*\(", body):
            kind, inner = _generic(a[1])
            of = next((x for x in inner if x in params), None)
            if kind.endswith(_REPOSITORIES) and of:
                stores[rf"\b{a[3]}\s*\(\s*\)"] = of
                for v in re.finditer(rf"(\w+)\s*=\s*{a[3]}\s*\(\s*\)\s*;", body):
                    stores[rf"\b{v[1]}"] = of
        for p in params:
            for v in re.finditer(rf"[(,;{{]\s*(?:final\s+)?{p}\s+(\w+)\s*[,)=;]", body):
                values[rf"\b{v[1]}\b"] = p
        uses = []
        kinds = [("write", rf"{x}\s*\.{_WRITES}\s*\(", of) for x, of in stores.items()] + [("write", rf"\.{_WRITES}\s*\([^)]*{x}", of) for x, of in values.items()] + [("read", rf"{x}\s*\.{_READS}\s*\(", of) for x, of in stores.items()]
        for n, line in enumerate(body.split("\n"), src.line(begin)):
            mode, _, of = next((k for k in kinds if re.search(k[1], line)), (None, None, None))
            if mode:
                uses.append({"line": n, "symbol": holder(n), "mode": mode, "param": of})
        if params or parent or uses:
            out.append({"name": m[1], "params": params, "parent": parent, "args": args, "uses": uses})
    return out
