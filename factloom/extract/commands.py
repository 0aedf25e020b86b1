"""The command line surface that a Rust program declares with derive macros."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.extract.code import Source
from factloom.sources.schemas import close, split_top

COMMAND = "program string, name string, about string, line int, args array<struct<name:string,kind:string,type_name:string,default:string,required:boolean,doc:string,line:int>>"


def _kebab(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).replace("_", "-").lower()


def commands(path: str, text: str) -> list[dict]:
    """Commands with their arguments: parsers and argument structs, and the variants of subcommand enums."""
    if not path.endswith(".rs") or "clap" not in text and "#[arg" not in text and "#[command" not in text:
        return []
    src, groups, out = Source(text, "Rust"), {}, []

    def args_of(begin: int, body: str) -> list[dict]:
        made = []
        for at, part in split_top(body):
            bare = re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m[0]), part)
            f = re.search(r"(?:pub\s+)?(\w+)\s*:\s*(.+?)\s*$", bare, re.S)
            if not f:
                continue
            raw = src.text[begin + at : begin + at + len(part)]
            marks = " ".join(re.findall(r"#\[(?:arg|clap)\(([^\]]*)\)\]", raw))
            if re.search(r"#\[(?:command|clap)\(\s*(?:subcommand|flatten)", raw) or "flatten" in marks:
                continue
            line = src.line(begin + at + f.start(1))
            kind = "flag" if f[2] == "bool" else "option" if re.search(r"\b(?:long|short)\b", marks) else "argument"
            default = re.search(r"default_value(?:_t)?\s*=\s*\"?([^\",)]+)", marks)
            made.append({"name": ("--" if kind != "argument" else "") + _kebab(f[1]), "kind": kind, "type_name": re.sub(r"^(?:Option|Vec)<(.*)>$", r"\1", f[2]), "default": default and default[1].strip(), "required": not default and kind != "flag" and not f[2].startswith(("Option", "Vec")), "doc": src.doc(line), "line": line})
        return made

    for m in re.finditer(r"#\[derive\(([^)]*)\)\]", src.code):
        head = re.compile(r"(?:\s*#\[[^\]]*\])*\s*(?:pub\s+)?(struct|enum)\s+(\w+)\s*\{").match(src.code, m.end())
        if not head or not re.search(r"\b(Parser|Args|Subcommand)\b", m[1]):
            continue
        body = src.code[head.end() : close(src.code, head.end() - 1, "{}")]
        line = src.line(head.start(2))
        named = re.search(r"name\s*=\s*\"([\w-]+)\"", src.text[m.end() : head.start(2)])
        if head[1] == "struct":
            groups[head[2]] = args_of(head.end(), body)
            if "Parser" in m[1]:
                out.append({"program": named[1] if named else _kebab(head[2]), "name": "", "about": src.doc(src.line(m.start())), "line": line, "args": groups[head[2]]})
        else:
            for at, part in split_top(body):
                v = re.search(r"(\w+)\s*(?:([({])|$)", re.sub(r"#\[[^\]]*\]", lambda x: " " * len(x[0]), part).rstrip())
                if v:
                    place = head.end() + at + v.start(1)
                    inner = part[v.end() :].rstrip().rstrip(")}") if v[2] else ""
                    args = args_of(head.end() + at + v.end(), inner) if v[2] == "{" else [("group", inner.strip().split("::")[-1])] if v[2] else []
                    out.append({"program": None, "name": _kebab(v[1]), "about": src.doc(src.line(place)), "line": src.line(place), "args": args})
    program = next((c["program"] for c in out if c["program"]), None)
    for c in out:
        c["program"] = c["program"] or program
        c["args"] = [a for x in c["args"] for a in (groups.get(x[1], []) if isinstance(x, tuple) else [x])]
    return out


def surface(files: DataFrame) -> DataFrame:
    """The commands of all files, as rows."""
    from factloom.sources.files import extract

    return extract(files, commands, COMMAND, F.col("path").endswith(".rs") & F.col("content").rlike(r"clap|#\[(?:arg|command)"))
