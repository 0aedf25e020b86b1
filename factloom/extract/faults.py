"""What Java and Kotlin code throws, and the status that an exception is answered with."""

from __future__ import annotations

import re

from factloom.extract.api import status_of
from factloom.extract.code import Source, braces
from factloom.sources import catalog
from factloom.sources.schemas import close, split_top

FAULT = "kind string, name string, status int, line int, symbol string, start int"

#: Exceptions of the usual frameworks and their statuses; fixed values.
KNOWN = {
    "BadRequestException": 400, "MethodArgumentNotValidException": 400, "ConstraintViolationException": 400, "HttpMessageNotReadableException": 400, "NotAuthorizedException": 401, "AuthenticationException": 401, "UnauthorizedException": 401,
    "ForbiddenException": 403, "AccessDeniedException": 403, "NotFoundException": 404, "EntityNotFoundException": 404, "NotAllowedException": 405, "NotAcceptableException": 406, "NotSupportedException": 415, "ServiceUnavailableException": 503, "InternalServerErrorException": 500,
}
#: Exceptions that only their arguments give a status; fixed values.
BY_ARGUMENT = ("ResponseStatusException", "WebApplicationException", "ClientErrorException", "ServerErrorException", "HttpStatusException")
#: Methods of response builders that give an error; fixed values.
BUILDERS = {"notFound": 404, "badRequest": 400, "unprocessableEntity": 422, "unauthorized": 401, "forbidden": 403, "serverError": 500, "internalServerError": 500, "conflict": 409}


def _named(text: str) -> int | None:
    """The status that an argument names: a constant of a status type, or a number."""
    m = re.search(r"Status(?:Code)?\.(\w+)", text) or re.search(r"(?<![\w\"])([45]\d\d)(?![\w\"])", text) or re.match(r"\s*(?:(?:value|code)\s*=\s*)?([A-Z][A-Z_]+)\b", text)
    return status_of(m[1]) if m else None


def _answered(body: str) -> int | None:
    """The first error status in a method's text."""
    for m in re.finditer(r"Status(?:Code)?\.(\w+)|\.?\bstatus\s*\(\s*(\d{3})|\.\s*(\w+)\s*\(", body):
        status = BUILDERS.get(m[3]) if m[3] else status_of(m[1] or m[2])
        if status and status >= 400:
            return status
    return None


def faults(path: str, text: str) -> list[dict]:
    """Rows of three kinds: `status`, an exception class marked with one; `advice`, an exception that this unit answers
    with one; `throw`, an exception with the status of its arguments, if any, in the method that begins at `start`."""
    language = catalog.language_of(path)
    if language not in ("Java", "Kotlin"):
        return []
    src, facts, out = Source(text, language), braces(path, text, language), []
    methods = [s for s in facts["symbols"] if s["kind"] in ("function", "method")]
    types = {s["name"] for s in facts["symbols"] if s["kind"] in ("class", "interface")}
    marks: dict[str, list[dict]] = {}
    for a in facts["annotations"]:
        marks.setdefault(a["name"], []).append(a)
    advising = {a["target"] for name in ("ControllerAdvice", "RestControllerAdvice") for a in marks.get(name, ())}
    body = lambda s: "\n".join(text.split("\n")[s["start_line"] - 1 : s["end_line"]])
    for a in marks.get("ResponseStatus", ()):
        status = _named(a["arguments"])
        if a["target"] in types and a["target"].endswith(("Exception", "Error")) and status:
            out.append({"kind": "status", "name": a["target"], "status": status, "line": a["line"]})
    for a in marks.get("ExceptionHandler", ()):
        method = next((s for s in methods if s["name"] == a["target"] and s["start_line"] >= a["line"]), None)
        if not method or method["owner"] not in advising:
            continue
        handled = re.findall(r"(\w+)\s*(?:\.class|::class)", a["arguments"]) or re.findall(r"(\w*Exception)\b", " ".join(method["params"]))
        own = next((_named(r["arguments"]) for r in marks.get("ResponseStatus", ()) if r["target"] == method["name"] and abs(r["line"] - a["line"]) <= 3), None)
        status = own or _answered(body(method))
        out += [{"kind": "advice", "name": x, "status": status, "line": a["line"]} for x in dict.fromkeys(handled) if status]
    for m in re.finditer(r"\bclass\s+(\w+)[^{]*\bExceptionMapper\s*<\s*([\w.]+)\s*>", src.code):
        method = next((s for s in methods if s["name"] == "toResponse" and s["owner"] == m[1]), None)
        status = _answered(body(method)) if method else None
        if status:
            out.append({"kind": "advice", "name": m[2].split(".")[-1], "status": status, "line": method["start_line"]})
    for m in re.finditer(r"\bthrow\s+new\s+([\w.]+)\s*(\()" if language == "Java" else r"\bthrow\s+([\w.]+)\s*(\()", src.code):
        name, line = m[1].split(".")[-1], src.line(m.start())
        status = next((s for s in (_named(p) for _, p in split_top(src.text[m.end() : close(src.code, m.start(2))]) if not p.strip().startswith('"')) if s), None)
        held = [s for s in methods if s["start_line"] <= line <= s["end_line"]]
        inner = min(held, key=lambda s: s["end_line"] - s["start_line"]) if held else None
        if inner and (status or name not in BY_ARGUMENT):
            out.append({"kind": "throw", "name": name, "status": status, "line": line, "symbol": inner["name"], "start": inner["start_line"]})
    return out
