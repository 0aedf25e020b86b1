"""HTTP operations that a unit serves and calls that it makes, read from the texts of all of its files.

Routes belong to routers, routers are mounted on others under a prefix; the prefixes of a route are those of all paths
of mounts from its router up to an application. A chain deeper than eight, or one that ends at a router that nothing
mounts, gives a route whose path is partial.
"""

from __future__ import annotations

import ast
import re

from factloom.extract.code import Source
from factloom.sources import catalog
from factloom.sources.schemas import close, split_top

OPERATION = (
    "file string, line int, framework string, method string, path string, path_partial boolean, handler string, params array<struct<name:string,location:string,type_name:string,required:boolean>>, "
    "request_type string, response_type string, response_fields array<string>, collection boolean, success_status int, errors array<int>, auth array<struct<kind:string,detail:string>>, summary string, end_line int"
)
CALL = "file string, line int, method string, path string, target_host string, caller string, reads array<string>, response_type string"
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
MOST_MOUNTS = 8

#: Names of HTTP statuses; fixed values.
STATUS = {
    "OK": 200, "CREATED": 201, "ACCEPTED": 202, "NO_CONTENT": 204, "MOVED_PERMANENTLY": 301, "FOUND": 302, "SEE_OTHER": 303, "NOT_MODIFIED": 304, "BAD_REQUEST": 400, "UNAUTHORIZED": 401, "PAYMENT_REQUIRED": 402, "FORBIDDEN": 403, "NOT_FOUND": 404,
    "METHOD_NOT_ALLOWED": 405, "NOT_ACCEPTABLE": 406, "REQUEST_TIMEOUT": 408, "CONFLICT": 409, "GONE": 410, "PRECONDITION_FAILED": 412, "UNPROCESSABLE_ENTITY": 422, "UNPROCESSABLE_CONTENT": 422, "TOO_MANY_REQUESTS": 429, "INTERNAL_SERVER_ERROR": 500, "NOT_IMPLEMENTED": 501,
    "BAD_GATEWAY": 502, "SERVICE_UNAVAILABLE": 503, "GATEWAY_TIMEOUT": 504,
}
_SQUEEZED = {k.replace("_", "").lower(): v for k, v in STATUS.items()}


def status_of(name: str) -> int | None:
    """The status that a constant of any language names: `HttpStatus.NOT_FOUND`, `StatusNotFound`, `Status404NotFound`, `404`."""
    last = name.strip().split(".")[-1].split("::")[-1]
    digits = re.search(r"(?<!\d)([1-5]\d\d)(?!\d)", last)
    return int(digits[1]) if digits else _SQUEEZED.get(re.sub(r"^(?:Status|HTTP_?)|_", "", last, flags=re.I).lower())


def parameter(segment: str) -> str:
    m = re.match(r"(?::|\*|\$|<(?:\w+:)?|\{\*?|\[(?:\.\.\.)?)([A-Za-z_]\w*)", segment)
    return f"{{{m[1]}}}" if m else segment


def join(*parts: str) -> str:
    """Parts of a route as one path; text in front of a parameter in a segment stays."""
    return "/" + "/".join(parameter(s) for p in parts for s in (p or "").split("/") if s)


def unwrap(kind: str | None) -> tuple[str | None, bool]:
    """The type inside `Promise<List<T>>`, `T[]`, `Option<T>`, `T | null` and the like, eight levels deep, and whether it is many."""
    many = False
    for _ in range(8):
        kind = (kind or "").strip().strip("&*?")
        if not kind or kind in ("void", "None", "null", "unknown", "any", "Void", "Unit", "()", "object", "undefined"):
            return None, many
        if kind.endswith("[]") or kind.startswith("[]"):
            kind, many = kind.removesuffix("[]").removeprefix("[]"), True
            continue
        alternatives = [a.strip() for _, a in split_top(kind, "|") if a.strip() not in ("null", "undefined", "None")]
        if len(alternatives) > 1:
            return None, many
        kind = alternatives[0] if alternatives else ""
        m = re.match(r"([\w.:]+)\s*[<\[](.*)[>\]]$", kind, re.S)
        if not m:
            return kind.rsplit("::", 1)[-1].rsplit(".", 1)[-1] or None, many
        outer = m[1].rsplit(".", 1)[-1].rsplit("::", 1)[-1]
        inner = [p.strip() for _, p in _generic(m[2])]
        many |= outer.lower() in ("list", "vec", "array", "set", "flux", "collection", "iterable", "sequence", "page", "ienumerable", "icollection", "ilist", "flow", "multi", "slice", "tuple", "readonlyarray")
        if outer in ("Record", "Map", "dict", "HashMap", "Dictionary", "Dict"):
            return None, many
        kind = inner[0] if inner else ""
    return kind or None, many


def _generic(text: str) -> list[tuple[int, str]]:
    return [(a, p) for a, p in split_top(text.replace("<", "[").replace(">", "]"))]


def auth_of(name: str) -> tuple[str, str] | None:
    """What a guard, dependency or middleware of this name asks for; `author` is not `auth`."""
    low = re.sub(r"authors?(?=[^a-z]|$)", "", name.lower())
    if re.search(r"role|hasauthority|admin", low):
        return "role", name
    if "scope" in low:
        return "scope", name
    if re.search(r"api_?key", low):
        return "api-key", name
    return ("authenticated", name) if re.search(r"auth|jwt|login|current_?user|session|token|^require_?(?:user|customer|member|account|owner|permission)|principal", low) else None


def excluded(path: str) -> str | None:
    """Why a route is operational rather than part of the contract; null if it isn't. Routes about one resource never are."""
    parts = [p for p in path.split("/") if p]
    if not parts or any("{" in p for p in parts[:-1]):
        return None
    if any(p in ("metrics", "pprof", "debug", "healthz", "livez", "readyz") for p in parts):
        return "metrics / debugging" if any(p in ("metrics", "pprof", "debug") for p in parts) else "health / liveness probe"
    if parts[-1] in ("health", "healthcheck", "health-check", "ping", "live", "ready", "liveness", "readiness", "status", "up", "alive", "heartbeat"):
        return "health / liveness probe"
    return "documentation" if parts[0] in ("docs", "swagger", "openapi.json", "redoc", "swagger-ui", "api-docs", "v3") and "docs" in path + "docs"[: 4 * (parts[0] != "v3")] else None


class Unit:
    """Routes, routers and mounts gathered from a unit's files."""

    def __init__(self):
        self.routes: list[dict] = []
        self.mounts: list[tuple[str, str, str | None]] = []  # parent router, child router, prefix
        self.apps: set[str] = set()
        self.own: dict[str, str] = {}  # prefix that a router was made with
        self.guards: dict[str, list[tuple[str, str]]] = {}
        self.calls: list[dict] = []

    def route(self, router: str | None, method: str, path: str, **more) -> None:
        self.routes.append({"router": router, "method": method.upper(), "path": path, **more})

    def prefixes(self, router: str | None, depth: int = 0) -> list[tuple[str, bool, list]]:
        """(prefix, partial, guards) of every way up from a router."""
        if router is None or router in self.apps and not any(c == router and not p.endswith("#default") for p, c, _ in self.mounts):
            return [(self.own.get(router or "", ""), False, self.guards.get(router or "", []))]
        up = [(p, x) for p, c, x in self.mounts if c == router]
        if not up or depth > MOST_MOUNTS:
            return [(self.own.get(router, ""), router not in self.apps, self.guards.get(router, []))]
        out, seen = [], set()
        for parent, prefix in up:
            for above, partial, guards in self.prefixes(parent, depth + 1):
                whole = join(above, prefix or "", self.own.get(router, ""))
                if whole not in seen:
                    seen.add(whole)
                    out.append((whole, partial or prefix is None, [*guards, *self.guards.get(router, [])]))
        return out

    def operations(self) -> list[dict]:
        out = []
        for r in self.routes:
            for prefix, partial, guards in self.prefixes(r["router"]):
                path = join(prefix, r["path"])
                auth = list(dict.fromkeys([*guards, *r.get("auth", [])]))
                known = {p["name"] for p in r.get("params", [])}
                params = [{"name": n, "location": "path", "type_name": None, "required": True} for n in re.findall(r"\{(\w+)\}", path) if n not in known]
                kind, many = unwrap(r.get("response"))
                out.append({
                    "file": r["file"], "line": r["line"], "framework": r["framework"], "method": r["method"], "path": path, "path_partial": partial, "handler": r.get("handler"), "params": [*params, *r.get("params", [])], "request_type": unwrap(r.get("request"))[0],
                    "response_type": kind, "response_fields": r.get("answers") or [], "collection": many, "success_status": r.get("status") or (200 if kind else None), "errors": sorted(set(r.get("errors", []))), "auth": [{"kind": k, "detail": d} for k, d in auth], "summary": r.get("summary"), "end_line": r.get("end_line"),
                })
        return out


def _key(file: str, name: str) -> str:
    return f"{file}#{name}"


def _python(unit: Unit, files: dict[str, str]) -> None:
    modules = {p.removesuffix(".py").removesuffix("/__init__").replace("/", "."): p for p in files if p.endswith(".py")}
    trees: dict[str, ast.Module] = {}
    walked: dict[str, list[ast.AST]] = {}  # every node, in the order of a walk
    members: dict[str, set[str]] = {}  # values of string attributes of classes, by name
    for path, text in files.items():
        if path.endswith(".py"):
            try:
                trees[path] = ast.parse(text)
            except SyntaxError:
                continue
            walked[path] = list(ast.walk(trees[path]))
            for c in (n for n in walked[path] if isinstance(n, ast.ClassDef)):
                for n in c.body:
                    target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None
                    if isinstance(target, ast.Name) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                        members.setdefault(target.id, set()).add(n.value.value)
    for path, tree in trees.items():
        imported: dict[str, str] = {}
        consts = {t.id: n.value.value for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) for t in n.targets if isinstance(t, ast.Name)}
        here = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".").split(".")
        for n in walked[path]:
            if isinstance(n, ast.ImportFrom):
                base = ".".join([*here[: len(here) - n.level + path.endswith("__init__.py")], *([n.module] if n.module else [])]) if n.level else n.module or ""
                for a in n.names:
                    for found in (f"{base}.{a.name}" if base else a.name, base):
                        file = modules.get(found) or next((p for m, p in modules.items() if m.endswith("." + found)), None)
                        if file:
                            imported[a.asname or a.name] = _key(file, "*" if found.endswith("." + a.name) and file.removesuffix(".py").endswith(a.name) else a.name)
                            break

        def said(e) -> str | None:
            if isinstance(e, ast.Constant) and isinstance(e.value, str):
                return e.value
            if isinstance(e, ast.Name):
                return consts.get(e.id)
            if isinstance(e, ast.Attribute) and len(members.get(e.attr, ())) == 1:
                return next(iter(members[e.attr]))
            if isinstance(e, ast.JoinedStr):
                parts = [said(v) if isinstance(v, ast.Constant) else "{" + re.sub(r"\W", "", ast.unparse(v.value).split(".")[-1]) + "}" for v in e.values]
                return "".join(p or "" for p in parts)
            if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
                a, b = said(e.left), said(e.right)
                return None if a is None and b is None else (a if a is not None else "{param}") + (b if b is not None else "{param}")
            return None

        def router(e) -> str:
            name = ast.unparse(e)
            if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id in imported:
                return _key(imported[e.value.id].split("#")[0], e.attr)
            return imported.get(name, _key(path, name))

        def guards(call: ast.Call) -> list[tuple[str, str]]:
            given = next((k.value for k in call.keywords if k.arg == "dependencies"), None)
            names = [ast.unparse(c.args[0]) for c in ast.walk(given) if isinstance(c, ast.Call) and ast.unparse(c.func).split(".")[-1] in ("Depends", "Security") and c.args] if given else []
            return [a for a in map(auth_of, names) if a]

        for n in walked[path]:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.targets[0], ast.Name):
                kind = ast.unparse(n.value.func).split(".")[-1]
                kw = {k.arg: k.value for k in n.value.keywords}
                key = _key(path, n.targets[0].id)
                if kind in ("FastAPI", "Flask", "Starlette"):
                    unit.apps.add(key)
                    unit.guards[key] = guards(n.value)
                elif kind in ("APIRouter", "Blueprint"):
                    unit.own[key] = said(kw.get("prefix") or kw.get("url_prefix")) or ""
                    unit.guards[key] = guards(n.value)
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("include_router", "register_blueprint") and n.args:
                prefix = next((k.value for k in n.keywords if k.arg in ("prefix", "url_prefix")), None)
                unit.mounts.append((router(n.func.value), router(n.args[0]), "" if prefix is None else said(prefix)))
                if n.func.attr == "include_router":
                    unit.guards.setdefault(router(n.args[0]), []).extend(guards(n))
        for f in walked[path]:
            if not isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                continue
            for d in f.decorator_list:
                if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and (d.func.attr in VERBS or d.func.attr in ("route", "api_route"))):
                    continue
                at = said(d.args[0])
                if at is None:
                    continue
                kw = {k.arg: k.value for k in d.keywords}
                flask = d.func.attr == "route"
                methods = [said(m) for m in kw["methods"].elts] if "methods" in kw and isinstance(kw["methods"], ast.List | ast.Tuple) else ["GET"] if d.func.attr in ("route", "api_route") else [d.func.attr]
                params, request, auth = [], None, []
                defaults = dict(zip([a.arg for a in f.args.args][::-1], f.args.defaults[::-1], strict=False)) | {a.arg: v for a, v in zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True) if v is not None}
                for a in (*f.args.args, *f.args.kwonlyargs):
                    if a.arg in ("self", "request", "response"):
                        continue
                    kind = ast.unparse(a.annotation) if a.annotation else None
                    given = ast.unparse(defaults[a.arg]) if a.arg in defaults else ""
                    text_of = f"{kind or ''} {given}"
                    if m := re.search(r"(?:Depends|Security)\((\w[\w.]*)", text_of):
                        auth += [x for x in [auth_of(m[1])] if x]
                    elif f"{{{a.arg}}}" in join(at):
                        params.append({"name": a.arg, "location": "path", "type_name": kind, "required": True})
                    elif flask:
                        continue
                    elif kind and re.match(r"(?:Annotated\[)?(?:list\[)?[A-Z]\w*", kind) and not re.match(r"(?:Optional|List|Dict|Annotated\[(?:str|int|float|bool))", kind) and "Query" not in text_of and "Header" not in text_of:
                        request = kind.removeprefix("Annotated[").split(",")[0]
                    elif kind:
                        params.append({"name": a.arg, "location": "header" if "Header" in text_of else "query", "type_name": kind, "required": a.arg not in defaults or given == "Query(...)"})
                raised = [status_of(ast.unparse(c.args[0] if c.args else next((k.value for k in c.keywords if k.arg == "status_code"), c))) for c in ast.walk(f) if isinstance(c, ast.Call) and ast.unparse(c.func).split(".")[-1] in ("HTTPException", "abort")]
                response = ast.unparse(kw["response_model"]) if "response_model" in kw else ast.unparse(f.returns) if f.returns and not flask else None
                status = status_of(ast.unparse(kw["status_code"])) if "status_code" in kw else None
                given = [x.value for x in ast.walk(f) if isinstance(x, ast.Return) and isinstance(x.value, ast.Dict)]
                answers = list(dict.fromkeys(k.value for d_ in given for k in d_.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)))
                for method in methods:
                    unit.route(router(d.func.value), method or "ANY", at, file=path, line=f.lineno, framework="Flask" if flask else "FastAPI", handler=f.name, params=params, request=request, response=response, status=status, errors=[r for r in raised if r], auth=auth, answers=answers, summary=(ast.get_docstring(f) or "").split("\n")[0] or None)
        owner = lambda line: min((f for f in walked[path] if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and f.lineno <= line <= f.end_lineno), key=lambda f: f.end_lineno - f.lineno, default=None)
        for c in walked[path]:
            if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and c.func.attr in VERBS and c.args:
                base = ast.unparse(c.func.value)
                if re.search(r"(?i)^(requests|httpx)\b|client|session|http|api$", base) and _key(path, base) not in unit.apps and base not in ("app", "router"):
                    url = said(c.args[0])
                    inside = owner(c.lineno)
                    if url and "/" in url:
                        reads = sorted({x.slice.value for x in ast.walk(inside) if isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str)}) if inside else []
                        _call(unit, path, c.lineno, c.func.attr, url, inside and inside.name, reads, None)


def _call(unit: Unit, file: str, line: int, method: str, url: str, caller: str | None, reads: list[str], response: str | None) -> None:
    """Note a call; parameters in front of the path are its host."""
    host = re.match(r"[a-z]+://([^/:{}?#]+)", url)
    bare = re.sub(r"^[a-z]+://[^/]*", "", url)
    bare = re.sub(r"^(?:\{[^}]*\})+(?=/|$)", "", bare).split("?")[0].split("#")[0]
    if bare.startswith("/"):
        unit.calls.append({"file": file, "line": line, "method": method.upper(), "path": join(bare), "target_host": host and host[1], "caller": caller, "reads": reads, "response_type": response})


def _template(said: str) -> str:
    """A template literal with its parts as parameters."""
    return re.sub(r"\$\{([^}]*)\}", lambda m: "{" + (re.sub(r"\W", "", re.split(r"[.(\s]", m[1].strip())[-1]) or "param") + "}", said)


def _function_at(src: Source, facts: list[dict], line: int) -> str | None:
    inside = [s for s in facts if s["kind"] in ("function", "method") and s["start_line"] <= line <= s["end_line"]]
    return min(inside, key=lambda s: s["end_line"] - s["start_line"])["name"] if inside else None


def _script(unit: Unit, files: dict[str, str]) -> None:
    """TypeScript and JavaScript: Express, Fastify, Hono and NestJS; fetch and axios-like clients."""
    from factloom.extract.code import braces

    for path, text in files.items():
        language = catalog.language_of(path)
        if language not in ("TypeScript", "JavaScript"):
            continue
        src = Source(text, language)
        symbols = braces(path, text, language)["symbols"]
        imported: dict[str, str] = {}
        for m in re.finditer(r"import\s+(?:type\s+)?([\w$]+)?\s*,?\s*(?:\{([^}]*)\})?\s*from\s*(?=[\"'])|(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\s*\(", src.code):
            spec = src.literal(m.end())
            file = _resolve(path, spec, files) if spec and spec.startswith(".") else None
            if file:
                for whole in (m[1], m[3]):
                    if whole:
                        imported[whole] = _key(file, "default")
                for part in (m[2] or m[4] or "").split(","):
                    name, _, local = part.strip().partition(" as ")
                    if name:
                        imported[(local or name).strip()] = _key(file, name.strip())
        default = re.search(r"export\s+default\s+([\w$]+)\s*;?\s*$|module\.exports\s*=\s*([\w$]+)", src.code, re.M)
        if default:
            unit.mounts.append((_key(path, "default"), _key(path, default[1] or default[2]), ""))
        names = set()
        for m in re.finditer(r"(?:const|let|var)\s+([\w$]+)(?:\s*:\s*[\w.<>]+)?\s*=\s*(?:new\s+)?(?:await\s+)?(express\.Router|Router|Hono|express|fastify|Fastify)\s*(?:<[^(]*>)?\s*\(", src.code):
            names.add(m[1])
            key = _key(path, m[1])
            if m[2] in ("express", "fastify", "Fastify", "Hono"):
                unit.apps.add(key)
        local = lambda n: imported.get(n, _key(path, n))
        for m in re.finditer(r"\b([\w$]+)\s*\.\s*(?:use|route|register)\s*\(\s*", src.code):
            if m[1] not in names and m[1] not in ("app", "router", "server", "fastify", "instance"):
                continue
            body = src.code[m.end() : close(src.code, src.code.index("(", m.start()))]
            parts = split_top(body)
            prefix = src.literal(m.end())
            for at, part in parts[1 if prefix is not None else 0 :]:
                child = re.match(r"\s*([\w$]+)\s*(\(.*\))?\s*$", part, re.S)
                if child and (child[1] in names or child[1] in imported):
                    given = re.search(r"prefix\s*:\s*", body)
                    unit.mounts.append((local(m[1]), local(child[1]), prefix if prefix is not None else (src.literal(m.end() + given.end()) if given else "")))
                    if imported.get(child[1]) and not imported[child[1]].endswith("#default"):
                        file, name = imported[child[1]].split("#")
                        for r in re.finditer(rf"(?:function\s+{name}\b|\b{name}\s*=)[^{{]*\{{", Source(files[file], "TypeScript").code):
                            inner = re.search(r"(?:const|let)\s+([\w$]+)\s*=\s*(?:express\.)?Router", files[file][r.end() :])
                            if inner:
                                unit.mounts.append((imported[child[1]], _key(file, inner[1]), ""))
                elif guard := auth_of(part.strip().split("(")[0]):
                    unit.guards.setdefault(local(m[1]), []).append(guard)
        framework = next((f for mark, f in (("fastify", "Fastify"), ("hono", "Hono"), ("express", "Express")) if re.search(rf"[\"']{mark}[\"']", text)), None)
        for m in re.finditer(r"\b([\w$]+)\s*\.\s*(get|post|put|patch|delete|all|options|head)\s*(?:<[^()]*>)?\(\s*(?=[\"'`])", src.code):
            at = src.literal(m.end())
            if at is None or not (at.startswith("/") or at in ("", "*")) or not (m[1] in names or m[1] in ("app", "router", "server", "fastify", "instance", "api")) or not (framework or names):
                continue
            opened = src.code.index("(", m.end(2))
            end = close(src.code, opened)
            body = src.text[opened:end]
            parts = [p.strip() for _, p in split_top(src.code[opened + 1 : end])]
            handler = re.match(r"(?:async\s+)?([\w$.]+)$", parts[-1])
            auth = [a for a in (auth_of(p.split("(")[0]) for p in parts[1:-1]) if a]
            named = next((s for s in symbols if handler and s["name"] == handler[1].split(".")[-1] and s["kind"] in ("function", "method")), None)
            if named:  # a handler of this file that the route names
                body += "\n" + "\n".join(text.split("\n")[named["start_line"] - 1 : named["end_line"]])
            errors = [int(s) for s in re.findall(r"(?:status|code)\s*\(\s*([45]\d\d)|,\s*([45]\d\d)\s*\)", body) for s in s if s]
            ok = re.search(r"(?:status|code|sendStatus)\s*\(\s*(2\d\d)|,\s*(2\d\d)\s*\)", body)
            request = re.search(r"(\w+?)(?:Schema)?\.(?:parse|safeParse|parseAsync)\s*\(\s*(?:req|request|c\.req|ctx)", body) or re.search(r"Request<[^<>]*?,[^<>]*?,\s*(\w+)", body)
            answers = []
            for j in re.finditer(r"(?:(?:status|code)\s*\(\s*(\d+)\s*\)\s*)?\.\s*(?:json|send)\s*\(\s*\{", body):
                tail = body[close(body, j.end() - 1, "{}") :][:20]
                if (j[1] or re.match(r"\}\s*,\s*(\d+)", tail) and re.match(r"\}\s*,\s*(\d+)", tail)[1] or "200") < "400":
                    answers += [k[1] for _, part in split_top(body[j.end() : close(body, j.end() - 1, "{}")]) if (k := re.match(r"\s*[\"']?(\w+)", part))]
            query = [{"name": n, "location": "query", "type_name": None, "required": False} for n in dict.fromkeys(re.findall(r"\breq(?:uest)?\.query\.(\w+)", body))]
            unit.route(local(m[1]) if m[1] in names or m[1] in imported else None, "ANY" if m[2] == "all" else m[2], at, file=path, line=src.line(m.start(2)), end_line=src.line(end - 1), framework=framework or "Express", handler=handler and handler[1], params=query, request=request and request[1], status=int(ok[1] or ok[2]) if ok else None, errors=errors, auth=auth, answers=list(dict.fromkeys(answers)), summary=src.doc(src.line(m.start())))
        for c in re.finditer(r"@Controller\s*\(\s*", src.code):
            base = src.literal(c.end()) or ""
            after = re.compile(r"class\s+\w+[^{]*\{").search(src.code, c.end())
            end = close(src.code, after.end() - 1, "{}") if after else len(src.code)
            for m in re.finditer(r"@(Get|Post|Put|Patch|Delete|All|Head|Options)\s*\(\s*", src.code[c.end() : end]):
                at = c.end() + m.end()
                sig = re.compile(r"(?:async\s+)?(\w+)\s*\(").search(src.code, close(src.code, at - 1) if src.code[at - 1] == "(" else at)
                while sig and sig[1] in ("HttpCode", "UseGuards", "Roles", "ApiOperation"):
                    sig = re.compile(r"(?:async\s+)?(\w+)\s*\(").search(src.code, close(src.code, sig.end() - 1))
                head = src.text[c.end() + m.start() : sig.start()] if sig else ""
                args = src.text[sig.end() : close(src.code, sig.end() - 1)] if sig else ""
                request = re.search(r"@Body\([^)]*\)\s*\w+\s*:\s*([\w<>\[\]]+)", args)
                returns = re.compile(r"\)\s*:\s*([^{;]+)\{").match(src.code, close(src.code, sig.end() - 1)) if sig else None
                params = [{"name": n, "location": k.lower() if k != "Param" else "path", "type_name": t, "required": k == "Param"} for k, n, t in re.findall(r"@(Query|Param|Headers)\(\s*['\"](\w+)['\"][^)]*\)\s*\w+\??\s*:\s*([\w<>\[\]]+)", args)]
                code = re.search(r"HttpCode\(\s*([\w.]+)", head)
                guards = [a for a in (auth_of(g) for g in re.findall(r"@UseGuards\(([^)]*)\)", head + src.text[max(0, c.start() - 200) : c.start()])) if a]
                unit.route(None, "ANY" if m[1] == "All" else m[1], join(base, src.literal(at) or ""), file=path, line=src.line(c.end() + m.start()), framework="NestJS", handler=sig and sig[1], params=params, request=request and request[1], response=returns and returns[1], status=status_of(code[1]) if code else None, auth=guards)
        for m in re.finditer(r"\b(?:(fetch)|([\w$.]*(?:axios|[cC]lient|[hH]ttp|api)[\w$]*)\s*\.\s*(get|post|put|patch|delete)|(axios))\s*(?:<([^()]*)>)?\(\s*(?=[\"'`])", src.code):
            url = src.literal(m.end())
            if url is None:
                continue
            opened = src.code.index("(", m.end() - 1 if src.code[m.end() - 1] == "(" else m.start())
            body = src.text[opened : close(src.code, opened)]
            verb = m[3] or (re.search(r"method\s*:\s*[\"'](\w+)", body) or [None, "GET"])[1]
            line = src.line(m.start())
            inside = [s for s in symbols if s["kind"] in ("function", "method") and s["start_line"] <= line <= s["end_line"]]
            fn = min(inside, key=lambda s: s["end_line"] - s["start_line"]) if inside else None
            span = "\n".join(text.split("\n")[fn["start_line"] - 1 : fn["end_line"]]) if fn else body
            returns = re.search(r"\bas\s+(?:Promise<)?(\w+)|\)\s*:\s*Promise<([\w\[\]<>]+)>", span)
            unit_url = _template(url)
            if "/" in unit_url:
                _call(unit, path, line, verb, unit_url if unit_url.startswith(("/", "http", "{")) else "/" + unit_url, fn and fn["name"], [], m[5] or (returns and (returns[1] or returns[2])))


def _resolve(path: str, spec: str, files: dict[str, str]) -> str | None:
    parts = path.split("/")[:-1]
    for p in spec.split("/"):
        parts = parts[:-1] if p == ".." else parts if p == "." else [*parts, p]
    base = "/".join(parts)
    stem = re.sub(r"\.[mc]?jsx?$", "", base)
    ends = (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")
    return next((c for c in (base, *(base + e for e in ends), *(stem + e for e in ends)) if c in files), None)


def _go(unit: Unit, files: dict[str, str]) -> None:
    """net/http, chi, gin and gorilla; http.NewRequest and http.Get/Post."""
    from factloom.extract.code import braces

    consts: dict[str, str] = {}
    for path, text in files.items():
        if path.endswith(".go"):
            consts |= {m[1]: m[2] for m in re.finditer(r"(?m)^\s*(?:const\s+)?(\w+)(?:\s+string)?\s*=\s*\"([^\"\n]*)\"\s*$", text)}
    for path, text in files.items():
        if not path.endswith(".go"):
            continue
        src = Source(text, "Go")
        symbols = braces(path, text, "Go")["symbols"]
        framework = next((f for mark, f in (("gin-gonic/gin", "Gin"), ("go-chi/chi", "chi"), ("gorilla/mux", "gorilla/mux"), ("labstack/echo", "Echo"), ("gofiber/fiber", "Fiber")) if mark in text), "net/http")
        scope_of = lambda at: _function_at(src, symbols, src.line(at))

        def said(raw: str) -> str | None:
            """A string put together from literals and constants."""
            parts = [p.strip() for _, p in split_top(raw, "+")]
            got = [p[1:-1] if re.fullmatch(r"\"[^\"]*\"|`[^`]*`", p) else consts.get(p.split(".")[-1]) for p in parts]
            return None if not got or None in got else "".join(got)

        def first(opened: int) -> str | None:
            parts = split_top(src.text[opened + 1 : close(src.code, opened)])
            return said(parts[0][1].strip()) if parts else None

        groups: dict[tuple[str, str | None], str] = {}
        for m in re.finditer(r"(\w+)\s*:?=\s*(\w+)\.(?:Group|PathPrefix)\s*\(", src.code):
            scope = scope_of(m.start())
            groups[(m[1], scope)] = join(groups.get((m[2], scope), ""), first(m.end() - 1) or "")
        nested = []  # chi: r.Route("/x", func(r chi.Router) { ... })
        for m in re.finditer(r"\.Route\s*\(", src.code):
            nested.append((m.end() - 1, close(src.code, m.end() - 1), first(m.end() - 1)))
        for s in symbols:
            if s["kind"] == "function":
                unit.apps.add(f"go#{s['name']}")
        for m in re.finditer(r"\b(\w+)\.Mount\s*\(", src.code):
            parts = split_top(src.code[m.end() : close(src.code, m.end() - 1)])
            child = re.match(r"\s*(?:\w+\.)?(\w+)\s*\(", parts[-1][1]) if len(parts) > 1 else None
            above = [p for a, b, p in nested if a < m.start() < b]
            if child:
                unit.mounts.append((f"go#{scope_of(m.start())}", f"go#{child[1]}", None if None in above else join(*above, first(m.end() - 1) or "")))

        def handled(args: str) -> str | None:
            last = split_top(args)[-1][1].strip() if split_top(args) else ""
            inner = re.match(r"[\w.]+\((.*)\)$", last, re.S)
            return (handled(inner[1]) if inner and not last.startswith("func") else re.sub(r"^.*\.", "", last) if re.fullmatch(r"[\w.]+", last) else None)

        for m in re.finditer(r"\b(\w+)(?:\(\))?\s*\.\s*(Get|Post|Put|Patch|Delete|GET|POST|PUT|PATCH|DELETE|Any|Handle|HandleFunc|Method)\s*\(\s*(?=[\"`]|http\.Method)", src.code):
            if m[1] in ("http", "client", "httpClient") and m[2] in ("Get", "Post"):
                continue
            opened = src.code.index("(", m.end(2))
            end = close(src.code, opened)
            at, verb = src.literal(m.end()), m[2].upper()
            body = src.text[opened + 1 : end]
            if m[2] in ("Handle", "HandleFunc"):
                said = re.match(r"(?:(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+)?(.*)$", at or "")
                verb, at = said[1] or (re.match(r"\s*\.Methods\(\s*(?:http\.Method|\")(\w+)", src.text[end + 1 :]) or [None, "ANY"])[1].upper(), said[2]
            if at is None or not at.startswith("/") and at != "":
                continue
            scope = scope_of(m.start())
            above = [p for a, b, p in nested if a < m.start() < b]
            prefix = join(*(p or "" for p in above), groups.get((m[1], scope), ""))
            router = f"go#{scope}" if scope else None
            if None in above:  # a prefix that isn't known
                unit.mounts.append(("go#?", f"{router}?", None))
                router = f"{router}?"
            handler = handled(src.code[opened + 1 : end]) if "func" not in src.code[opened:end].split(",")[-1] else None
            fn = next((s for s in symbols if s["name"] == handler), None)
            span = "\n".join(text.split("\n")[fn["start_line"] - 1 : fn["end_line"]]) if fn else body
            statuses = [s for s in (status_of(x) for x in re.findall(r"http\.Status(\w+)", span)) if s]
            request = re.search(r"(?:Decode|ShouldBindJSON|BindJSON|Bind)\(\s*&(\w+)\)", span)
            kind = re.search(rf"(?:var\s+{request[1]}\s+|{request[1]}\s*:?=\s*&?)([\w.]+)", span) if request else None
            response = re.search(r"(?:Encode|JSON)\(\s*(?:http\.Status\w+|\d+)?,?\s*&?(\w[\w.]*)\{", span)
            unit.route(router, "ANY" if verb in ("ANY", "METHOD") else verb, join(prefix, at.removesuffix("{$}")), file=path, line=src.line(m.start(2)), end_line=src.line(end - 1), framework=framework, handler=handler, request=kind and kind[1], response=response and response[1], status=next((s for s in statuses if s < 300), None), errors=[s for s in statuses if s >= 400], summary=fn and fn["doc"], auth=[a for a in [auth_of(m[1])] if a])
        for m in re.finditer(r"http\.(NewRequestWithContext|NewRequest|Get|Post)\s*\(", src.code):
            parts = [p for _, p in split_top(src.text[m.end() : close(src.code, m.end() - 1)])]
            parts = parts[1:] if m[1] == "NewRequestWithContext" else parts
            verb = re.sub(r"http\.Method|[\"\s]", "", parts[0]).upper() if m[1].startswith("New") and parts else m[1].upper()
            raw = parts[1 if m[1].startswith("New") else 0] if len(parts) > m[1].startswith("New") else ""
            line = src.line(m.start())
            url = _concat(raw, "+", r"fmt\.Sprintf")
            if url:
                _call(unit, path, line, verb, url, _function_at(src, symbols, line), [], None)


def _concat(raw: str, plus: str, printf: str) -> str | None:
    """A URL put together from literals and expressions."""
    m = re.match(rf"\s*&?(?:{printf})\s*!?\((.*)\)\s*$", raw.strip(), re.S)
    if m:
        parts = [p.strip() for _, p in split_top(m[1])]
        lit = re.fullmatch(r"[\"`](.*)[\"`]", parts[0], re.S) if parts else None
        if not lit:
            return None
        names = iter(parts[1:])
        return re.sub(r"%[sdvq]|\{\}", lambda _: "{" + (re.sub(r"\W", "", next(names, "param").split(".")[-1]) or "param") + "}", lit[1])
    out = ""
    for _, p in split_top(raw, plus):
        lit = re.fullmatch(r"\s*[\"`'](.*)[\"`']\s*", p, re.S)
        out += lit[1] if lit else "{" + (re.sub(r"\W", "", p.split(".")[-1]) or "param") + "}"
    return out if "/" in out else None


def _rust(unit: Unit, files: dict[str, str]) -> None:
    """axum routers with nests, actix attributes and scopes; reqwest clients."""
    from factloom.extract.code import braces

    for path, text in files.items():
        if not path.endswith(".rs"):
            continue
        src = Source(text, "Rust")
        symbols = braces(path, text, "Rust")["symbols"]
        at_line = lambda m: src.line(m.start())

        def typed(name: str) -> dict:
            fn = next((s for s in symbols if s["name"] == name), None)
            if not fn:
                return {}
            span = "\n".join(text.split("\n")[fn["start_line"] - 1 : fn["end_line"]])
            sig = span.split("{")[0]
            body, returns = re.search(r"Json\(?\w*\)?\s*:\s*(?:web::)?Json<([\w:<>]+?)>(?=\s*[,)])", sig), re.search(r"->\s*(.+)$", sig.strip(), re.S)
            opened = returns[1].find("Json<") if returns else -1
            answer = (None, returns[1][opened + 5 : close(returns[1], opened + 4, "<>")]) if opened >= 0 else None
            statuses = [s for s in (status_of(x) for x in re.findall(r"StatusCode::(\w+)", span)) if s]
            return {"request": body and body[1], "response": answer and answer[1], "status": next((s for s in statuses if s < 300), None), "errors": [s for s in statuses if s >= 400], "summary": fn["doc"]}

        for m in re.finditer(r"\.route\s*\(\s*(?=\")", src.code):
            opened = src.code.index("(", m.start())
            end = close(src.code, opened)
            fn = _function_at(src, symbols, at_line(m))
            for v in re.finditer(r"\b(get|post|put|patch|delete|any)\s*\(\s*([\w:]+)", src.code[opened:end]):
                name = v[2].split("::")[-1]
                unit.route(f"rust#{fn}", "ANY" if v[1] == "any" else v[1], src.literal(m.end()) or "", file=path, line=at_line(m), framework="Axum", handler=name, **typed(name))
        for m in re.finditer(r"\.(nest|merge)\s*\(\s*", src.code):
            opened = src.code.index("(", m.start())
            body = src.code[opened + 1 : close(src.code, opened)]
            child = re.search(r"(\w+)\s*\([^()]*\)\s*,?\s*$", body.strip())
            if child:
                unit.mounts.append((f"rust#{_function_at(src, symbols, at_line(m))}", f"rust#{child[1]}", src.literal(m.end()) if m[1] == "nest" else ""))
        for s in symbols:
            if s["kind"] == "function" and "axum" in text + "".join(files.get(p, "") for p in files if p.endswith("main.rs")):
                unit.apps.add(f"rust#{s['name']}")
        for m in re.finditer(r"#\[(?:\w+::)?(get|post|put|patch|delete)\s*\(\s*(?=\")", src.code):
            fn = re.compile(r"fn\s+(\w+)").search(src.code, m.end())
            unit.route(None, m[1], src.literal(m.end()) or "", file=path, line=at_line(m), framework="Actix Web", handler=fn and fn[1], **(typed(fn[1]) if fn else {}))
        for m in re.finditer(r"\b(\w*client\w*|reqwest|http)\s*(?:\.|::)\s*(get|post|put|patch|delete)\s*\(", src.code):
            url = _concat(src.text[m.end() : close(src.code, m.end() - 1)], "+", r"format")
            if url:
                _call(unit, path, at_line(m), m[2], url, _function_at(src, symbols, at_line(m)), [], None)


_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "ANY", "GET": "GET", "POST": "POST", "PUT": "PUT", "PATCH": "PATCH", "DELETE": "DELETE", "Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE"}


def _strings(args: str) -> list[str]:
    return re.findall(r'"((?:\\.|[^"\\])*)"', args)


def _jvm(unit: Unit, files: dict[str, str]) -> None:
    """Spring MVC and WebFlux, JAX-RS, Micronaut; Ktor routes; Feign and template clients."""
    from factloom.extract.code import braces

    for path, text in files.items():
        language = catalog.language_of(path)
        if language not in ("Java", "Kotlin"):
            continue
        src = Source(text, language)
        facts = braces(path, text, language)
        symbols, marks = facts["symbols"], facts["annotations"]
        classes = [s for s in symbols if s["kind"] in ("class", "interface")]
        methods = [s for s in symbols if s["kind"] in ("method", "function")]
        for c in classes:
            before = max((s["end_line"] for s in classes if s["end_line"] < c["start_line"]), default=0)
            own = {a["name"]: a["arguments"] for a in marks if before < a["line"] <= c["start_line"]}
            framework = "Micronaut" if "micronaut" in text and "Controller" in own else "JAX-RS" if "Path" in own or "RegisterRestClient" in own else "Spring MVC" if own.keys() & {"RestController", "Controller", "FeignClient", "RequestMapping"} else None
            if not framework:
                continue
            base = _strings(own.get("Path") or own.get("RequestMapping") or (own.get("Controller", "") if framework == "Micronaut" else "")) or [""]
            client = own.get("FeignClient") if "FeignClient" in own else own.get("RegisterRestClient")
            guard = [auth_of(k) or ("role", v) for k, v in own.items() if k in ("PreAuthorize", "RolesAllowed", "Secured", "Authenticated")]
            last = c["start_line"]
            for f in sorted((f for f in methods if f["owner"] == c["name"]), key=lambda f: f["start_line"]):
                mine = [a for a in marks if last < a["line"] <= f["start_line"]]
                last = f["start_line"]
                verbs = [a for a in mine if a["name"] in _MAPPINGS]
                if not verbs:
                    continue
                more = {a["name"]: a["arguments"] for a in mine}
                v = verbs[0]
                args = v["arguments"]
                named = re.findall(r"RequestMethod\.(\w+)", args)
                sub = _strings(more.get("Path", "")) if framework == "JAX-RS" else _strings(re.sub(r"(?:produces|consumes|params|headers|name)\s*=\s*(?:\{[^}]*\}|\"[^\"]*\"|[\w.]+)", "", args))
                params, request = [], None
                for p in f["params"]:
                    kind, name = (re.search(r":\s*([\w<>?\[\], ]+)", p), re.search(r"(\w+)\s*:", p)) if language == "Kotlin" else (re.search(r"([\w.]+(?:<.*>)?(?:\[\])?)\s+\w+$", p), re.search(r"(\w+)$", p))
                    tag = re.search(r"@(PathVariable|PathParam|RequestParam|QueryParam|QueryValue|RequestHeader|HeaderParam|RequestBody|Body)", p)
                    kind = kind[1].strip() if kind else None
                    label = (_strings(p) or [name[1] if name else ""])[0]
                    if tag and tag[1] in ("RequestBody", "Body") or not tag and framework == "JAX-RS" and v["name"] in ("POST", "PUT", "PATCH") and "@" not in p:
                        request = kind
                    elif tag:
                        place = {"P": "path", "Q": "query", "H": "header"}.get(tag[1][0], "query") if not tag[1].startswith("Request") else "header" if tag[1] == "RequestHeader" else "query"
                        params.append({"name": label, "location": place, "type_name": kind, "required": "required = false" not in p and "defaultValue" not in p})
                line_text = text.split("\n")[f["start_line"] - 1]
                returns = re.search(rf"(?:public|protected|private)?\s*((?:[\w.]+)(?:<.*>)?(?:\[\])?)\s+{f['name']}\s*\(", line_text) if language == "Java" else re.search(r"\)\s*:\s*([\w<>?, ]+?)\s*(?:=|\{|$)", line_text)
                kind = re.sub(r"^(?:ResponseEntity|Mono|Uni|HttpResponse|CompletableFuture)<(.*)>$", r"\1", returns[1].strip()) if returns else None
                status = status_of(more["ResponseStatus"]) if "ResponseStatus" in more else None
                span = "\n".join(text.split("\n")[f["start_line"] - 1 : f["end_line"]])
                errors = [s for s in (status_of(x) for x in re.findall(r"HttpStatus\.(\w+)|Response\.Status\.(\w+)", span) for x in x if x) if s and s >= 400]
                auth = [x for x in [*guard, *[auth_of(k) or ("role", a) for k, a in more.items() if k in ("PreAuthorize", "RolesAllowed", "Secured")]] if x]
                for method in named or [_MAPPINGS[v["name"]]]:
                    for b in base:
                        for s in sub or [""]:
                            if client is not None:
                                host = _strings(client)
                                unit.calls.append({"file": path, "line": f["start_line"], "method": method, "path": join(b, s), "target_host": host[0] if host else None, "caller": f["name"], "reads": [], "response_type": unwrap(kind)[0]})
                            else:
                                unit.route(None, method, join(b, s), file=path, line=f["start_line"], framework=framework, handler=f["name"], params=params, request=request, response=kind, status=status, errors=errors, auth=auth, summary=f["doc"])
        if "web.reactive.function.server" in text or "web.servlet.function" in text or "coRouter" in text:
            spans = [(m.end() - 1, close(src.code, m.end() - 1), src.literal(m.end()) or "") for m in re.finditer(r"\.?\b(?:path|nest)\s*\(\s*(?:path\s*\()?", src.code)]
            spans += [(src.code.index("{", m.end()), close(src.code, src.code.index("{", m.end()), "{}"), src.literal(m.start() + 1) or "") for m in re.finditer(r"[^\w\"](?=\"[^\"\n]*\"\s*\.nest\s*\{)", src.code) if "{" in src.code[m.end() :]]
            for m in re.finditer(r"\b(GET|POST|PUT|PATCH|DELETE)\s*\(\s*(?=\")", src.code):
                tail = src.code[m.end() : m.end() + 160]
                handler = re.search(r"(?:::)(\w+)", tail.split(";")[0].split(".GET")[0].split(".POST")[0])
                unit.route(None, m[1], join(*(p for a, b, p in spans if a < m.start() < b), src.literal(m.end()) or ""), file=path, line=src.line(m.start(1)), framework="Spring WebFlux", end_line=src.line(close(src.code, src.code.index("(", m.end(1))) - 1), handler=handler and handler[1])
        if language == "Kotlin" and "io.ktor" in text:
            spans = [(m.start(), close(src.code, src.code.index("{", m.end()), "{}"), src.literal(m.end()) or "") for m in re.finditer(r"\broute\s*\(\s*(?=\")", src.code) if "{" in src.code[m.end() :]]
            for m in re.finditer(r"\b(get|post|put|patch|delete)\s*(?:<(\w+)>\s*)?\(\s*(?=\")|\b(get|post|put|patch|delete)\s*(?=\{)", src.code):
                verb, opened = m[1] or m[3], src.code.find("{", m.end() - (not m[1]))
                if opened < 0:
                    continue
                end = close(src.code, opened, "{}")
                body = src.text[m.start() : end]
                request, response = re.search(r"receive<(\w+)>", body), re.search(r"respond\((?:HttpStatusCode\.\w+,\s*)?(\w+)\(", body)
                statuses = [s for s in (status_of(x) for x in re.findall(r"HttpStatusCode\.(\w+)", body)) if s]
                unit.route(None, verb, join(*(p for a, b, p in spans if a < m.start() < b), src.literal(m.end()) if m[1] else ""), file=path, line=src.line(m.start()), end_line=src.line(end - 1), framework="Ktor", request=request and request[1], response=response and response[1], status=next((s for s in statuses if s < 300), None), errors=[s for s in statuses if s >= 400])
        for m in re.finditer(r"\b\w*[rR]est[tT]emplate\s*\.\s*(get|post|put|patch|delete|exchange)\w*\s*\(", src.code):
            parts = [p for _, p in split_top(src.text[m.end() : close(src.code, m.end() - 1)])]
            url = _concat(parts[0], "+", r"String\.format") if parts else None
            verb = (re.search(r"HttpMethod\.(\w+)", " ".join(parts)) or [None, "GET"])[1] if m[1] == "exchange" else m[1]
            if url:
                _call(unit, path, src.line(m.start()), verb, url, _function_at(src, symbols, src.line(m.start())), [], (re.search(r"(\w+)(?:\.class|::class)", " ".join(parts)) or [None, None])[1])


def _csharp(unit: Unit, files: dict[str, str]) -> None:
    """ASP.NET Core controllers and minimal APIs."""
    from factloom.extract.code import braces

    for path, text in files.items():
        if not path.endswith(".cs"):
            continue
        src = Source(text, "C#")
        facts = braces(path, text, "C#")
        symbols = facts["symbols"]
        for c in (s for s in symbols if s["kind"] == "class" and s["name"].endswith("Controller")):
            above = [a for a in facts["annotations"] if a["line"] <= c["start_line"]]
            base = next((_strings(a["arguments"]) for a in reversed(above) if a["name"] == "Route"), None) or [""]
            base = base[0].replace("[controller]", c["name"].removesuffix("Controller").lower())
            last = c["start_line"]
            for f in sorted((f for f in symbols if f["owner"] == c["name"] and f["kind"] == "method"), key=lambda f: f["start_line"]):
                mine = [a for a in facts["annotations"] if last < a["line"] <= f["start_line"]]
                last = f["start_line"]
                for a in (a for a in mine if re.fullmatch(r"Http(Get|Post|Put|Patch|Delete)", a["name"])):
                    sub = (_strings(a["arguments"]) or next((_strings(x["arguments"]) for x in mine if x["name"] == "Route"), None) or [""])[0]
                    sub = re.sub(r"\{(\w+)[:?=][^}]*\}", r"{\1}", sub)
                    line = text.split("\n")[f["start_line"] - 1]
                    returns = re.search(rf"(?:async\s+)?([\w.]+(?:<.*>)?)\s+{f['name']}\s*\(", line)
                    kind = re.sub(r"^Task<(.*)>$", r"\1", returns[1]) if returns else None
                    kind = re.sub(r"^ActionResult<(.*)>$", r"\1", kind) if kind else None
                    body = next((re.search(r"([\w<>]+)\s+\w+$", p) for p in f["params"] if "FromBody" in p or a["name"] in ("HttpPost", "HttpPut", "HttpPatch") and re.match(r"[A-Z]\w*(?:Request|Dto|Command|Input|Model)\b", p)), None)
                    produced = [s for x in mine if x["name"] == "ProducesResponseType" for s in [status_of(x["arguments"])] if s]
                    auth = [("role" if "Roles" in x["arguments"] else "authenticated", x["arguments"] or "Authorize") for x in [*above, *mine] if x["name"] == "Authorize"]
                    unit.route(None, a["name"][4:], join(base, sub), file=path, line=f["start_line"], framework="ASP.NET Core", handler=f["name"], request=body and body[1], response=None if kind in ("IActionResult", "ActionResult", "Task") else kind, status=next((s for s in produced if s < 300), None), errors=[s for s in produced if s >= 400], auth=auth, summary=f["doc"])
        groups: dict[str, str] = {}
        for m in re.finditer(r"(?:var|RouteGroupBuilder)\s+(\w+)\s*=\s*(\w+)\.MapGroup\s*\(\s*", src.code):
            groups[m[1]] = join(groups.get(m[2], ""), src.literal(m.end()) or "")
        for m in re.finditer(r"\b(\w+)\.Map(Get|Post|Put|Patch|Delete)\s*\(\s*", src.code):
            at = src.literal(m.end())
            if at is None:
                continue
            opened = src.code.index("(", m.end(2))
            parts = [p.strip() for _, p in split_top(src.code[opened + 1 : close(src.code, opened)])]
            handler = parts[1] if len(parts) > 1 and re.fullmatch(r"[\w.]+", parts[1]) else None
            tail = src.text[close(src.code, opened) : close(src.code, opened) + 200]
            kind = re.search(r"\.Produces<([\w<>]+)>", tail)
            unit.route(None, m[2], join(groups.get(m[1], ""), re.sub(r"\{(\w+)[:?=][^}]*\}", r"{\1}", at)), file=path, line=src.line(m.start(2)), end_line=src.line(close(src.code, opened) - 1), framework="ASP.NET Core", handler=handler, response=kind and kind[1], auth=[("authenticated", "RequireAuthorization")] if ".RequireAuthorization(" in tail.split(";")[0] else [])


def read_unit(files: dict[str, str]) -> tuple[list[dict], list[dict]]:
    """Operations and calls of a unit of files, in order of file and line."""
    unit = Unit()
    ordered = dict(sorted(files.items()))
    for read in (_python, _script, _go, _rust, _jvm, _csharp):
        read(unit, ordered)
    order = lambda r: (r["file"], r["line"], r["method"], r["path"])
    return sorted(unit.operations(), key=order), sorted(unit.calls, key=order)
