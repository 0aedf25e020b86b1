"""Symbols, imports, strings, calls, annotations and entry points of a source file.

Python is read by its own parser. The other languages are read from a view of the text in which comments and the
contents of strings are blanked without moving anything, so patterns see code only and offsets are those of the file.
This is an approximation by tokens, not a grammar: nesting is followed by brackets, names by declarations.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources import catalog
from factloom.sources.files import extract, with_language
from factloom.sources.schemas import close

FACTS = (
    "language string, line_count int, has_syntax_errors boolean, package string, module_doc string, "
    "symbols array<struct<name:string,kind:string,start_line:int,end_line:int,exported:boolean,doc:string,params:array<string>,owner:string,receiver:string,receiver_type:string>>, "
    "imports array<struct<specifier:string,line:int>>, strings array<struct<value:string,line:int>>, calls array<struct<name:string,callee:string,line:int,type_args:array<string>>>, types array<struct<name:string,port:boolean,fields:array<struct<name:string,type:string>>,methods:array<string>>>, "
    "annotations array<struct<name:string,arguments:string,line:int,target:string,owner:string>>, entry_points array<struct<symbol:string,start_line:int,end_line:int,reason:string>>"
)
#: Characters of a string literal and of an annotation's arguments that are kept; fixed values.
MAX_STRING, MAX_ARGUMENTS = 240, 400

_COMMENTS = {"hash": r"#[^\n]*", "slash": r"//[^\n]*|/\*.*?\*/"}
_STRINGS = {
    "Rust": r'r#*".*?"#*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'', "Go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', "Java": r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "Kotlin": r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', "C#": r'@"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', "TypeScript": r'`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_STRINGS["JavaScript"] = _STRINGS["TypeScript"]


class Source:
    """A text with its lines, its blanked view and its string literals."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.literals: list[tuple[int, str]] = []
        pattern = re.compile(f"(?P<s>{_STRINGS.get(language, _STRINGS['Java'])})|(?P<c>{_COMMENTS['slash']})", re.S)

        def gone(m: re.Match) -> str:
            x = m[0]
            if m.lastgroup == "c" or m["c"]:
                return re.sub(r"[^\n]", " ", x)
            if len(x) > 1:
                self.literals.append((m.start(), re.sub(r"^[r@$]?#*(?:\"\"\"|[\"'`])|(?:\"\"\"|[\"'`])#*$", "", x)))
            return x[0] + re.sub(r"[^\n]", " ", x[1:-1]) + x[-1]

        self.code = pattern.sub(gone, text)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def literal(self, at: int) -> str | None:
        """The string literal that begins at an offset, blanks skipped."""
        m = re.compile(r"\s*").match(self.text, at)
        i = bisect_right(self.literals, (m.end(), "\U0010ffff")) - 1
        return self.literals[i][1] if i >= 0 and self.literals[i][0] == m.end() else None

    def block_end(self, at: int) -> int:
        """The line of the bracket that closes the first `{` after an offset, or of the statement's end."""
        m = re.compile(r"[{;]").search(self.code, at)
        if not m or m[0] == ";":
            return self.line(m.start() if m else at)
        return self.line(close(self.code, m.start(), "{}"))

    def doc(self, line: int) -> str | None:
        """The comment right above a line, without its marks."""
        out = []
        for n in range(line - 2, -1, -1):
            s = self.text[self.starts[n] : self.starts[n + 1] if n + 1 < len(self.starts) else None].strip()
            if re.match(r"(///?|/?\*+|\*/|//!)", s):
                out.append(re.sub(r"^(?:///?!?|/\*+|\*+/|\*)\s?|\*/$", "", s).strip())
            elif not (out == [] and s.startswith(("@", "#[", "["))):
                break
        return " ".join(x for x in reversed(out) if x) or None


#: What declares a symbol: kind and pattern with the groups `name` and, for functions, `p` at the opening bracket.
_DECLARED = {
    "Rust": [("function", r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S+\s+)*fn\s+(?P<name>\w+)\s*(?:<[^{;(]*>)?(?P<p>\()"), ("struct", r"(?P<pub>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"(?P<pub>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"(?P<pub>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)")],
    "Go": [("function", r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<p>\()"), ("struct", r"type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"type\s+(?P<name>\w+)\s+interface\b")],
    "TypeScript": [("function", r"(?P<pub>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+(?P<name>\w+)\s*(?:<[^{;(]*>)?(?P<p>\()"), ("function", r"(?P<pub>export\s+)?(?:const|let)\s+(?P<name>\w+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:<[^(]*>)?(?P<p>\()(?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>)"), ("class", r"(?P<pub>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("interface", r"(?P<pub>export\s+)?interface\s+(?P<name>\w+)"), ("enum", r"(?P<pub>export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"), ("type", r"(?P<pub>export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?="), ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|override)\s+)*(?P<name>(?!if|for|while|switch|return|catch|function|constructor)\w+)\s*(?:<[^(]*>)?(?P<p>\()(?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={;\n]+)?\{)")],
    "Java": [("class", r"(?P<pub>public\s+)?(?:(?:abstract|final|static|sealed)\s+)*(?:class|record)\s+(?P<name>\w+)"), ("interface", r"(?P<pub>public\s+)?(?:sealed\s+)?interface\s+(?P<name>\w+)"), ("enum", r"(?P<pub>public\s+)?enum\s+(?P<name>\w+)"), ("method", r"(?m)^[ \t]+(?P<pub>public\s+)?(?:(?:protected|private|static|final|abstract|synchronized|default)\s+)*(?:<[^>]*>\s+)?(?!return|new|throw|else)[\w.]+(?:<[^;{}()]*>)?(?:\[\])*\s+(?P<name>(?!if|for|while|switch|catch)\w+)\s*(?P<p>\()")],
    "Kotlin": [("class", r"(?:(?P<pub>public)\s+|(?:private|internal|open|abstract|data|sealed|enum|annotation|inner|value)\s+)*(?:class|object)\s+(?P<name>\w+)"), ("interface", r"interface\s+(?P<name>\w+)"), ("function", r"(?:(?:public|private|internal|override|suspend|inline|open|protected|operator)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*(?P<p>\()")],
    "C#": [("class", r"(?P<pub>public\s+)?(?:(?:internal|private|protected|abstract|sealed|static|partial)\s+)*(?:class|record(?:\s+struct)?|struct)\s+(?P<name>\w+)"), ("interface", r"(?P<pub>public\s+)?(?:partial\s+)?interface\s+(?P<name>\w+)"), ("enum", r"(?P<pub>public\s+)?enum\s+(?P<name>\w+)"), ("method", r"(?m)^[ \t]+(?:(?P<pub>public)|internal|private|protected|static)\s+(?:(?:internal|protected|static|virtual|override|async|sealed|abstract|new|partial)\s+)*(?!class|record|struct|interface|enum|new)[\w.]+(?:<[^;{}()]*>)?\??(?:\[\])*\s+(?P<name>\w+)\s*(?:<[^>(]*>)?(?P<p>\()")],
}
_DECLARED["JavaScript"] = _DECLARED["TypeScript"]
_IMPORTS = {
    "Rust": r"(?m)^\s*(?:pub\s+)?use\s+(?P<s>[\w:]+)", "Java": r"(?m)^\s*import\s+(?:static\s+)?(?P<s>[\w.*]+)", "Kotlin": r"(?m)^\s*import\s+(?P<s>[\w.*]+)", "C#": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<s>[\w.]+)\s*;",
}
_KEYWORDS = set("if for while switch return catch match fn func function new sizeof typeof await yield super this else do try when in is as not and or lambda print".split())


def _params(src: Source, at: int) -> list[str]:
    from factloom.sources.schemas import split_top

    body = src.text[at + 1 : close(src.code, at)]
    return [re.sub(r"\s+", " ", p).strip() for _, p in split_top(body)]


def _last_names(text: str) -> list[str]:
    """The last name of every part of a list of types."""
    return [names[-1] for part in text.strip("<>[]:").split(",") if (names := re.findall(r"[A-Za-z_]\w*", part))]


def go_types(src: Source) -> list[dict]:
    """Structs and interfaces with their fields and methods; a field without a name is an embedded type."""
    out = []
    for m in re.finditer(r"(?m)^\s*(?:type\s+)?(\w+)\s*(?:\[[^\]]*\]\s*)?(struct|interface)\s*(\{)", src.code):
        end, depth, fields, methods = close(src.code, m.start(3), "{}"), 0, [], []
        for line in src.code[m.end() : end].split("\n"):
            plain, outer = re.sub(r"`[^`]*`", "", line).strip(), depth
            depth += line.count("{") - line.count("}")
            if outer or not plain:
                continue
            if m[2] == "interface":
                methods += re.findall(r"^(\w+)\s*\(", plain)
            elif inner := re.match(r"\*?(?:\w+\.)?(\w+)(?:\[.*\])?$", plain):
                fields.append({"name": None, "type": inner[1]})
            elif named := re.match(r"((?:\w+\s*,\s*)*\w+)\s+[*\[\]]*(?:\w+\.)?(\w+)", plain):
                fields += [{"name": n.strip(), "type": named[2]} for n in named[1].split(",")]
        out.append({"name": m[1], "port": m[2] == "interface", "fields": fields, "methods": methods})
    return out


def braces(path: str, text: str, language: str) -> dict:
    """Facts of a file of a language with braces."""
    src = Source(text, language)
    code, symbols = src.code, []
    for kind, pattern in _DECLARED[language]:
        for m in re.finditer(rf"(?<![\w.]){pattern}" if not pattern.startswith("(?m)") else pattern, code):
            name, start = m["name"], src.line(m.start("name"))
            if name in _KEYWORDS or any(s["name"] == name and s["start_line"] == start for s in symbols):
                continue
            exported = name[:1].isupper() if language == "Go" else language == "Kotlin" or bool(m.groupdict().get("pub"))
            has_params = m.groupdict().get("p")
            after = close(code, m.start("p")) if has_params else m.end()
            taken = re.match(r"func\s+\(\s*(?:(\w+)\s+)?\*?\s*(\w+)", m[0]) if language == "Go" and kind == "function" else None
            symbols.append({"receiver": taken and taken[1], "receiver_type": taken and taken[2], "name": name, "kind": kind, "start_line": start, "end_line": src.block_end(after), "exported": exported, "doc": src.doc(start), "params": _params(src, m.start("p")) if has_params else []})
    symbols.sort(key=lambda s: (s["start_line"], -s["end_line"]))
    owners = [s for s in symbols if s["kind"] in ("class", "interface", "trait", "struct", "enum") and s["end_line"] > s["start_line"]]
    for s in symbols:
        inside = [o for o in owners if o is not s and o["start_line"] <= s["start_line"] <= o["end_line"]]
        s["owner"] = min(inside, key=lambda o: o["end_line"] - o["start_line"])["name"] if inside else None
    if language in ("TypeScript", "JavaScript"):
        imports = [(m.start(), src.literal(m.end())) for m in re.finditer(r"(?:\bfrom|\bimport|\brequire\s*\()\s*(?=[\"'])", code)]
    elif language == "Go":
        blocks = [(m.start(), close(code, m.end() - 1)) for m in re.finditer(r"(?m)^import\s*\(", code)] + [(m.start(), code.find("\n", m.start())) for m in re.finditer(r"(?m)^import\s+[\w.]*\s*\"", code)]
        imports = [(at, said) for at, said in src.literals if any(a <= at <= b for a, b in blocks)]
    else:
        imports = [(m.start("s"), m["s"].rstrip(".*").rstrip(":")) for m in re.finditer(_IMPORTS[language], code)]
    package = re.search(r"(?m)^\s*(?:package|namespace)\s+([\w.]+)", code)
    typed = r"::<[^>]*>|<[\w,. ]+>" + (r"|\[[\w*., \[\]]+\](?=\()" if language == "Go" else "")
    calls = [{"name": m[2], "callee": (m[1] or "") + m[2], "line": src.line(m.start(2)), "type_args": _last_names(m[3] or "")} for m in re.finditer(rf"((?:\w+(?:\(\))?(?:\.|::|\?\.|->))*)(\w+)\s*({typed})?\(", code) if m[2] not in _KEYWORDS]
    declared = {(s["name"], s["start_line"]) for s in symbols}
    calls = [c for c in calls if (c["name"], c["line"]) not in declared]
    annotations = []
    marks = {"Java": r"@([\w.]+)\s*(\()?", "Kotlin": r"@(?:\w+:)?([\w.]+)\s*(\()?", "TypeScript": r"(?m)^\s*@(\w+)\s*(\()?", "C#": r"(?m)^\s*\[(?:\w+:\s*)?(\w+)\s*(\()?", "Rust": r"#!?\[([\w:]+)\s*(\()?"}.get(language)
    for m in re.finditer(marks, code) if marks else ():
        if m[1] == "interface":
            continue
        end = close(code, m.start(2)) if m[2] else m.end()
        line = src.line(m.start(1))
        target = next((s for s in symbols if s["start_line"] >= src.line(end)), None)
        annotations.append({"name": m[1].split(".")[-1], "arguments": text[m.end(2) : end].strip()[:MAX_ARGUMENTS] if m[2] else "", "line": line, "target": target and target["name"], "owner": target and target["owner"]})
    entries = [{"symbol": s["name"], "start_line": s["start_line"], "end_line": s["end_line"], "reason": "main function"} for s in symbols if s["name"] in ("main", "Main") and s["kind"] in ("function", "method")]
    if language in ("TypeScript", "JavaScript"):
        entries += [{"symbol": "listen", "start_line": src.line(m.start()), "end_line": src.line(m.start()), "reason": "server listens"} for m in re.finditer(r"\.listen\s*\(", code)][:1]
    head = re.match(r"\s*((?:(?://[!/]?[^\n]*\n)|(?:/\*.*?\*/\s*))+)", text, re.S)
    doc = " ".join(x for x in (re.sub(r"^\s*(?://[!/]?|/\*+|\*+/|\*)\s?|\*/\s*$", "", y).strip() for y in head[1].splitlines()) if x) if head else None
    return {
        "language": language, "line_count": text.count("\n") + (not text.endswith("\n") and bool(text)), "has_syntax_errors": code.count("{") != code.count("}"), "package": package and package[1], "module_doc": doc, "symbols": symbols,
        "imports": [{"specifier": s, "line": src.line(at)} for at, s in imports if s], "strings": [{"value": s[:MAX_STRING], "line": src.line(at)} for at, s in src.literals], "calls": calls, "annotations": annotations, "entry_points": entries, "types": go_types(src) if language == "Go" else [],
    }


def python(path: str, text: str) -> dict:
    """Facts of a Python file."""
    lines = text.count("\n") + (not text.endswith("\n") and bool(text))
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return {"language": "Python", "line_count": lines, "has_syntax_errors": True, "symbols": [], "imports": [], "strings": [], "calls": [], "annotations": [], "entry_points": []}
    symbols, imports, strings, calls, annotations, entries = [], [], [], [], [], []

    def visit(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(n, ast.ClassDef)
                params = [] if is_class else [ast.unparse(a) for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs)]
                symbols.append({"name": n.name, "kind": "class" if is_class else "method" if owner else "function", "start_line": n.lineno, "end_line": n.end_lineno, "exported": not n.name.startswith("_"), "doc": ast.get_docstring(n), "params": params, "owner": owner})
                for d in n.decorator_list:
                    call = d if isinstance(d, ast.Call) else None
                    args = ", ".join([*(ast.unparse(a) for a in call.args), *(f"{k.arg}={ast.unparse(k.value)}" for k in call.keywords)]) if call else ""
                    annotations.append({"name": ast.unparse(call.func if call else d), "arguments": args[:MAX_ARGUMENTS], "line": d.lineno, "target": n.name, "owner": owner})
                visit(n, n.name if is_class else owner)
                continue
            if isinstance(n, ast.Import):
                imports.extend({"specifier": a.name, "line": n.lineno} for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports.append({"specifier": "." * n.level + (n.module or ""), "line": n.lineno})
            elif isinstance(n, ast.Constant) and isinstance(n.value, str):
                strings.append({"value": n.value[:MAX_STRING], "line": n.lineno})
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
                callee = ast.unparse(n.func)
                calls.append({"name": callee.rsplit(".", 1)[-1], "callee": callee[:200], "line": n.lineno})
            elif isinstance(n, ast.If) and ast.unparse(n.test).replace('"', "'") == "__name__ == '__main__'":
                entries.append({"symbol": "__main__", "start_line": n.lineno, "end_line": n.end_lineno, "reason": "script entry"})
            visit(n, owner)

    visit(tree, None)
    if path.endswith("__main__.py") and not entries:
        entries.append({"symbol": "__main__", "start_line": 1, "end_line": max(lines, 1), "reason": "package entry"})
    return {"language": "Python", "line_count": lines, "has_syntax_errors": False, "module_doc": ast.get_docstring(tree), "symbols": symbols, "imports": imports, "strings": strings, "calls": calls, "annotations": annotations, "entry_points": entries}


def parse(path: str, text: str) -> list[dict]:
    language = catalog.language_of(path)
    return [python(path, text) if language == "Python" else braces(path, text, language)] if language else []


def facts(files: DataFrame) -> DataFrame:
    """One row of nested facts for each file of a language that is read."""
    return extract(with_language(files).where("language is not null"), parse, FACTS)


def table(found: DataFrame, name: str) -> DataFrame:
    """One of the long tables: symbols, imports, strings, calls, annotations, entry_points, with repo, path and pos."""
    return found.select("repo", "path", "language", F.posexplode(name).alias("pos", "_x")).select("repo", "path", "language", "pos", "_x.*")
