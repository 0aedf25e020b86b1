"""Data shapes that requests and responses are made of: names, wire names, types, what is required, and validation rules."""

from __future__ import annotations

import ast
import re

from factloom.extract.code import Source
from factloom.sources import catalog
from factloom.sources.schemas import close, split_top

MODEL = "name string, line int, fields array<struct<name:string,code_name:string,type_name:string,required:boolean,rules:array<string>,line:int>>, parents array<string>"


def _field(name: str, code: str, kind: str | None, required: bool, line: int, rules=()) -> dict:
    return {"name": name, "code_name": code, "type_name": (kind or "").strip() or None, "required": required, "rules": list(rules), "line": line}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def _python(text: str) -> list[dict]:
    out = []
    for c in (n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.ClassDef)):
        marks = [ast.unparse(d).split("(")[0].split(".")[-1] for d in c.decorator_list]
        fields = []
        for n in c.body:
            if not isinstance(n, ast.AnnAssign) or not isinstance(n.target, ast.Name) or n.target.id.startswith("_"):
                continue
            kind, call = ast.unparse(n.annotation), n.value if isinstance(n.value, ast.Call) else None
            given = {k.arg: ast.unparse(k.value).strip("'\"") for k in call.keywords} if call else {}
            absent = n.value is None or (call and call.args and ast.unparse(call.args[0]) == "...") or (call and "default" not in given and "default_factory" not in given and not call.args)
            rules = [f"{k} {given[k]}" for k in ("gt", "ge", "lt", "le", "min_length", "max_length", "pattern") if k in given]
            fields.append(_field(given.get("alias") or given.get("serialization_alias") or n.target.id, n.target.id, kind, bool(absent) and "None" not in kind and "Optional" not in kind, n.lineno, rules))
        if fields and (c.bases or "dataclass" in marks):
            out.append({"name": c.name, "line": c.lineno, "fields": fields, "parents": [ast.unparse(b).split(".")[-1] for b in c.bases]})
    return out


def _script(text: str, language: str) -> list[dict]:
    src, out = Source(text, language), []
    for m in re.finditer(r"\b(?:interface|class)\s+(\w+)\s*(?:<[^{>]*>)?(?:\s+extends\s+([\w\s,.<>]+?))?(?:\s+implements\s+[\w\s,.<>]+?)?\s*\{|\btype\s+(\w+)\s*(?:<[^=]*>)?=\s*(?:[\w<>]+\s*&\s*)*\{", src.code):
        opened = m.end() - 1
        body, fields = src.code[opened + 1 : close(src.code, opened, "{}")], []
        depth, at = 0, 0
        for piece in re.split(r"([{};,\n])", body):
            if not depth and (f := re.match(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|readonly)\s+)*[\"']?(\w+)[\"']?(\?|!)?\s*:\s*(.+?)\s*$", piece, re.S)) and "(" not in f[1]:
                fields.append(_field(f[1], f[1], f[3], f[2] != "?", src.line(opened + 1 + at + f.start(1))))
            depth += (piece == "{") - (piece == "}")
            at += len(piece)
        if fields:
            out.append({"name": m[1] or m[3], "line": src.line(m.start()), "fields": fields, "parents": [p.split("<")[0].strip() for p in (m[2] or "").split(",") if p.strip()]})
    for m in re.finditer(r"\b(?:const|let)\s+(\w+?)(?:Schema)?\s*=\s*z\s*\.\s*(?:strictObject|object)\s*\(\s*\{", src.code):
        opened, fields = m.end() - 1, []
        for at, part in split_top(src.code[opened + 1 : close(src.code, opened, "{}")]):
            f = re.match(r"\s*(\w+)\s*:\s*z\s*\.\s*(\w+)", part)
            if f:
                rules = re.findall(r"\.(min|max|length|email|uuid|positive|int|regex)\(([^)]*)\)", part)
                fields.append(_field(f[1], f[1], f[2], ".optional(" not in part, src.line(opened + 1 + at + f.start(1)), [f"{r} {v}".strip() for r, v in rules]))
        if fields:
            out.append({"name": m[1], "line": src.line(m.start()), "fields": fields, "parents": []})
    return out


def _go(text: str) -> list[dict]:
    src, out = Source(text, "Go"), []
    for m in re.finditer(r"type\s+(\w+)\s+struct\s*\{", src.code):
        body, fields, parents = text[m.end() : close(src.code, m.end() - 1, "{}")], [], []
        for n, line in enumerate(body.split("\n")):
            f = re.match(r"\s*([A-Z]\w*)\s+(\*?[\w.\[\]*]+)\s*(?:`(.*)`)?", line)
            if f:
                tag = re.search(r'json:"([^",]*)(,omitempty)?', f[3] or "")
                rules = re.search(r'(?:validate|binding):"([^"]*)"', f[3] or "")
                if not tag or tag[1] != "-":
                    fields.append(_field((tag and tag[1]) or f[1], f[1], f[2], not (tag and tag[2]) and not f[2].startswith("*"), src.line(m.end()) + n, rules[1].split(",") if rules else ()))
            elif e := re.match(r"\s*\*?(?:\w+\.)?([A-Z]\w*)\s*$", line):
                parents.append(e[1])
        if fields or parents:
            out.append({"name": m[1], "line": src.line(m.start()), "fields": fields, "parents": parents})
    return out


def _rust(text: str) -> list[dict]:
    src, out = Source(text, "Rust"), []
    for m in re.finditer(r"\bstruct\s+(\w+)\s*(?:<[^{]*>)?\s*\{", src.code):
        above = text[max(src.code.rfind("}", 0, m.start()), src.code.rfind(";", 0, m.start()), 0) : m.start()]
        style = re.search(r'rename_all\s*=\s*"(\w+)"', above)
        opened, fields = m.end() - 1, []
        body = src.code[opened + 1 : close(src.code, opened, "{}")]
        for at, part in split_top(body):
            f = re.search(r"(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*(.+?)\s*$", re.sub(r"#\[[^\]]*\]", lambda x: " " * len(x[0]), part), re.S)
            if f:
                raw = src.text[opened + 1 + at : opened + 1 + at + len(part)]
                renamed = re.search(r'rename\s*=\s*"([^"]+)"', raw)
                name = renamed[1] if renamed else _camel(f[1]) if style and style[1] == "camelCase" else f[1]
                fields.append(_field(name, f[1], f[2], not f[2].startswith("Option") and "default" not in raw, src.line(opened + 1 + at + f.start(1))))
        if fields:
            out.append({"name": m[1], "line": src.line(m.start()), "fields": fields, "parents": []})
    return out


def _jvm(text: str, language: str) -> list[dict]:
    src, out = Source(text, language), []
    rule = lambda marks: [x for x in re.findall(r"@(?:field:)?((?:NotNull|NotBlank|NotEmpty|Size|Min|Max|Positive|Email|Pattern|PositiveOrZero|Past|Future)(?:\([^)]*\))?)", marks)]
    for m in re.finditer(r"\b(?:class|record)\s+(\w+)(?:<[^>{(]*>)?\s*(?:extends\s+(\w+)[^{(]*)?(?=[({]|\s+implements|\s*:)", src.code):
        opened = re.compile(r"[({]").search(src.code, m.end())
        if not opened:
            continue
        fields, begin = [], opened.end()
        body = src.code[begin : close(src.code, opened.start(), "()" if opened[0] == "(" else "{}")]
        if opened[0] == "(":
            parts = [(a, p, re.search(r"(?:val|var)\s+(\w+)\s*:\s*([\w<>?., ]+)", p) if language == "Kotlin" else re.search(r"([\w.]+(?:<.*>)?)\s+(\w+)\s*$", p)) for a, p in split_top(body)]
            for at, part, f in parts:
                if f:
                    name, kind = (f[1], f[2]) if language == "Kotlin" else (f[2], f[1])
                    raw = src.text[begin + at : begin + at + len(part)]
                    renamed = re.search(r'@(?:\w+:)?(?:JsonProperty|SerialName)\(\s*(?:value\s*=\s*)?"([^"]+)"', raw)
                    fields.append(_field(renamed[1] if renamed else name, name, kind, not kind.strip().endswith("?") and "=" not in part, src.line(begin + at + f.start()), rule(raw)))
        else:
            for f in re.finditer(r"((?:@\w+(?:\([^()]*\))?\s*)*)(?:private|public|protected)\s+(?:final\s+)?([\w.]+(?:<[^;=()]*>)?)\s+(\w+)\s*(?:=[^;]*)?;", body):
                raw = src.text[begin + f.start() : begin + f.end()]
                renamed = re.search(r'JsonProperty\(\s*(?:value\s*=\s*)?"([^"]+)"', raw)
                fields.append(_field(renamed[1] if renamed else f[3], f[3], f[2], bool(re.search(r"@Not(?:Null|Blank|Empty)", raw)), src.line(begin + f.start(3)), rule(raw)))
        if fields:
            out.append({"name": m[1], "line": src.line(m.start()), "fields": fields, "parents": [m[2]] if m[2] else []})
    return out


def _csharp(text: str) -> list[dict]:
    src, out = Source(text, "C#"), []
    for m in re.finditer(r"\b(?:class|record)\s+(\w+)\s*(\()?", src.code):
        fields = []
        if m[2]:
            for at, part in split_top(src.code[m.end() : close(src.code, m.end() - 1)]):
                f = re.search(r"([\w<>?]+)\s+(\w+)(?:\s*=.*)?$", part.strip(), re.S)
                if f:
                    fields.append(_field(f[2][0].lower() + f[2][1:], f[2], f[1], not f[1].endswith("?"), src.line(m.end() + at)))
        else:
            opened = src.code.find("{", m.end())
            if opened < 0:
                continue
            for f in re.finditer(r"public\s+(?:required\s+)?([\w<>?]+)\s+(\w+)\s*\{\s*get", src.code[opened : close(src.code, opened, "{}")]):
                fields.append(_field(f[2][0].lower() + f[2][1:], f[2], f[1], not f[1].endswith("?"), src.line(opened + f.start(2))))
        if fields:
            out.append({"name": m[1], "line": src.line(m.start()), "fields": fields, "parents": []})
    return out


def models(path: str, text: str) -> list[dict]:
    """The data shapes that a source file declares."""
    language = catalog.language_of(path)
    if language == "Python":
        try:
            return _python(text)
        except SyntaxError:
            return []
    if language in ("TypeScript", "JavaScript"):
        return _script(text, language)
    if language in ("Java", "Kotlin"):
        return _jvm(text, language)
    return {"Go": _go, "Rust": _rust, "C#": _csharp}[language](text) if language in ("Go", "Rust", "C#") else []


