"""Commands over a source tree. Exit codes: 0 done, 1 a check failed, 2 wrong use or unreadable input."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

SPARK = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}


def session():
    """The active session, or a local one."""
    import os

    from pyspark.sql import SparkSession

    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    active = SparkSession.getActiveSession()
    if active is None:
        active = SparkSession.builder.master("local[*]").appName("factloom").config(map=SPARK).getOrCreate()
        active.sparkContext.setLogLevel("ERROR")
    return active


def _scan(root: str, include_tests: bool = False, allow_partial: bool = True):
    from factloom.plans.flows import flows
    from factloom.plans.scan import scan
    from factloom.sources.files import coverage, read_tree, refuse_unread

    files = read_tree(session(), root, include_tests=include_tests)
    refuse_unread(files, allow_partial)
    model = scan(files)
    return files, model, flows(model), coverage(files)


def _json(df) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


def report(model, flows) -> dict:
    """The whole scan as one document."""
    kept = ("units", "infra", "relationships", "operations", "models", "excluded", "client_calls", "entities", "accesses", "state_machines", "transitions", "events", "workloads", "topology", "overlays", "configuration", "summaries", "commands")
    return {name: sorted(_json(df), key=lambda r: json.dumps(r, sort_keys=True)) for name, df in model.tables().items() if name in kept} | {"flows": _json(flows)}


def _book(root: str, allow_partial: bool) -> dict[str, str]:
    from factloom.sinks import book
    from factloom.sources import config, git

    given = config.settings(root)
    _, model, found, read = _scan(root, allow_partial=allow_partial)
    commit = git.described_commit(root, str(Path(given["out"]).relative_to(given["root"])))
    at = (git.git(root, "show", "-s", "--format=%cI", commit) or "").strip() if commit else ""
    return book.plan(model, found, read, **({"commit": commit, "at": at} if commit and at else {}))


def verify(root: str, places: list[str]) -> list[dict]:
    """The state of each `path:LINE[-END]`."""
    from factloom.plans.validate import evidence_checks
    from factloom.sources import git, specs

    spark, rows, files = session(), [], []
    tracked = set((git.git(root, "ls-files") or "").splitlines())
    for n, p in enumerate(places):
        path, start, end = specs.pin(p)
        rows.append((str(n), "", path, start, end, None))
        full = (Path(root) / path).resolve()
        if full.is_relative_to(Path(root).resolve()) and full.is_file():
            files.append(("", path, full.read_text(errors="replace").splitlines(), path in tracked if tracked else None))
    cited = spark.createDataFrame(rows, "id string, repo string, path string, start int, end int, symbol string")
    known = spark.createDataFrame(list({f[1]: f for f in files}.values()), "repo string, path string, lines array<string>, tracked boolean")
    changed = git.hunks(spark, root, "HEAD", "") if tracked else spark.createDataFrame([], "repo string, path string, lo int, hi int")
    found = evidence_checks(cited, known, changed).orderBy("id").collect()
    return [{"place": places[int(r["id"])], "state": r["state"]} for r in found]


def validate(path: str, strict: bool = False) -> list[dict]:
    """Findings on a diagram document; those of its schema first."""
    from factloom.plans import validate as checks
    from factloom.sources import specs

    text = Path(path).read_text()
    errors = specs.diagram_errors(text)
    if errors:
        return [{"code": "ERR_SCHEMA", "severity": "error", "path": at, "message": said} for at, said in errors]
    return [r.asDict() for r in checks.validate(*specs.diagram_tables(session(), Path(path).stem, text), strict=strict).collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description="Evidence-backed facts of software systems.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *args) -> None:
        c = sub.add_parser(name, help=said)
        for flags, more in args:
            c.add_argument(*flags, **more)

    repo = (["--repo"], {"default": "."})
    as_json = (["--json"], {"action": "store_true"})
    command("init", "write a settings file", repo)
    command("analyze", "scan a tree", repo, as_json, (["--include-tests"], {"action": "store_true"}), (["--emit-ir"], {"metavar": "FILE"}))
    command("validate", "check a diagram document", (["document"], {}), (["--strict"], {"action": "store_true"}), as_json)
    command("render", "draw a diagram document", (["document"], {}), (["--format"], {"choices": ["svg", "html"], "default": "svg"}), (["--out"], {}))
    command("export", "a diagram document for draw.io", (["document"], {}), (["--format"], {"choices": ["drawio", "drawio-csv"], "default": "drawio"}), (["--out"], {}))
    command("generate", "write the book", repo, (["--out"], {}), (["--allow-partial"], {"action": "store_true"}))
    command("check", "compare the book with the tree", repo, (["--out"], {}), (["--allow-partial"], {"action": "store_true"}))
    command("diff", "what changed between two revisions", repo, (["--base"], {"required": True}), (["--head"], {"default": "HEAD"}), as_json, (["--exit-code"], {"action": "store_true"}), (["--record"], {"metavar": "RELEASE"}))
    command("spec", "requirements and rules", repo, (["--format"], {"choices": ["json", "openspec"], "default": "json"}), (["--out"], {}))
    command("conform", "specifications against code", repo, as_json)
    command("verify", "places in files", (["places"], {"nargs": "+", "metavar": "FILE:LINE[-END]"}), repo)
    command("score", "the specification score", repo)
    command("schema", "the JSON Schema of diagram documents")
    command("serve", "answer requests on standard input", repo)
    return p


def _out(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text)
    else:
        print(text)


def run(args: argparse.Namespace) -> int:
    from factloom.sinks import book, figures
    from factloom.sources import config, git, specs

    if args.command == "init":
        target = Path(args.repo) / "factloom.toml"
        if target.exists():
            raise ValueError(f"{target} exists")
        target.write_text('out = "docs/architecture"\n')
    elif args.command == "schema":
        print(json.dumps(specs.json_schema(), indent=2))
    elif args.command == "analyze":
        from factloom.plans import draft

        _, model, found, read = _scan(args.repo, args.include_tests)
        if args.emit_ir:
            Path(args.emit_ir).write_text(json.dumps(draft.system(model), indent=2))
        if args.json:
            print(json.dumps(report(model, found), indent=2, sort_keys=True))
        else:
            row = read.first()
            print(f"{row['read']} files read, {row['unread']} not ({row['census'] or 'none'}); {model.units.count()} containers, {model.operations.count()} operations, {model.entities.count()} entities, {found.count()} flows")
    elif args.command == "validate":
        found = validate(args.document, args.strict)
        print(json.dumps(found, indent=2) if args.json else "\n".join(f"{f['severity']} {f['code']}: {f['message']}" for f in found) or "valid")
        return int(any(f["severity"] == "error" for f in found))
    elif args.command in ("render", "export"):
        found = [f for f in validate(args.document) if f["severity"] == "error"]
        if found:  # nothing is written for an invalid document
            print("\n".join(f"{f['code']}: {f['message']}" for f in found), file=sys.stderr)
            return 1
        document = json.loads(Path(args.document).read_text())
        _out({"svg": figures.svg, "html": figures.figure_html, "drawio": figures.drawio, "drawio-csv": figures.drawio_csv}[args.format](document), args.out)
    elif args.command in ("generate", "check"):
        folder = args.out or config.settings(args.repo)["out"]
        files = _book(args.repo, args.allow_partial)
        found = book.write(files, folder) if args.command == "generate" else book.check(files, folder)
        for verb, names in found.items():
            print(f"{verb}: {len(names)}" + ("" if args.command == "generate" else "".join(f"\n  {n}" for n in names)))
        return int(args.command == "check" and any(found.values()))
    elif args.command == "diff":
        from factloom.plans.scan import diff, scan
        from factloom.sources.files import read_tree

        with git.worktree(args.repo, args.base) as a, git.worktree(args.repo, args.head) as b:
            changes = diff(scan(read_tree(session(), a)), scan(read_tree(session(), b))).collect()
        if args.record:
            target = Path(config.settings(args.repo)["out"]) / "history.json"
            target.parent.mkdir(parents=True, exist_ok=True)
            date = (git.git(args.repo, "show", "-s", "--format=%cI", args.head) or "").strip()
            entry = {"release": args.record, "date": date, "changes": [c.asDict() for c in changes]}
            target.write_text(json.dumps(specs.history(target.read_text() if target.exists() else None, entry), indent=1))
        print(json.dumps([c.asDict() for c in changes], indent=2) if args.json else book.diff_markdown(changes))
        return int(args.exit_code and bool(changes))
    elif args.command == "spec":
        _, model, _, _ = _scan(args.repo)
        if args.format == "json":
            _out(json.dumps(book.behaviour(model), indent=2), args.out)
        else:
            with_out = args.out or tempfile.mkdtemp(prefix="factloom-spec-")
            book.write(book.openspec(model), with_out)
            print(with_out)
    elif args.command == "conform":
        from factloom.plans.scan import conform

        files, model, _, _ = _scan(args.repo, include_tests=True)
        found = conform(specs.declared(files), model).orderBy("path", "method").collect()
        print(json.dumps([r.asDict() for r in found], indent=2) if args.json else "\n".join(f"{r['verdict']}: {r['method'] or '-'} {r['path'] or '-'}" for r in found))
        return int(any(r["verdict"] in ("missing", "partial") for r in found))
    elif args.command == "verify":
        found = verify(args.repo, args.places)
        print("\n".join(f"{f['state']}: {f['place']}" for f in found))
        return int(any(f["state"] != "verified" for f in found))
    elif args.command == "score":
        from factloom.plans.score import score

        _, model, found, read = _scan(args.repo)
        print(json.dumps(score(model, read, found).first().asDict(), indent=2))
    elif args.command == "serve":
        serve(args.repo)
    return 0


TOOLS = {
    "scan": ("Facts of a source tree.", {"repo": "string"}), "compile": ("Check a diagram document and draw it.", {"document": "string", "format": "string"}),
    "book": ("Write the book of a source tree.", {"repo": "string", "out": "string"}), "verify": ("The state of places in files.", {"repo": "string", "places": "array"}),
}


def answer(request: dict, root: str) -> dict | None:
    """The response to one JSON-RPC request; a tool that fails is a result that says so."""
    from factloom.sinks import book, figures

    key, method, given = request.get("id"), request.get("method"), request.get("params") or {}
    done = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    if method == "initialize":
        return done({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "factloom", "version": "1"}})
    if method == "tools/list":
        return done({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p) in TOOLS.items()]})
    if method != "tools/call":
        return None if key is None else {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no such method: {method}"}}
    try:
        name, args = given.get("name"), given.get("arguments") or {}
        repo = args.get("repo") or root
        if name == "scan":
            _, model, found, _ = _scan(repo)
            said = json.dumps(report(model, found), sort_keys=True)
        elif name == "compile":
            with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
                f.write(args["document"])
                f.flush()
                bad = [x for x in validate(f.name) if x["severity"] == "error"]
            document = None if bad else json.loads(args["document"])
            said = json.dumps(bad) if bad else figures.drawio(document) if args.get("format") == "drawio" else figures.svg(document)
        elif name == "book":
            said = json.dumps(book.write(_book(repo, True), args["out"]))
        elif name == "verify":
            said = json.dumps(verify(repo, args["places"]))
        else:
            raise ValueError(f"no such tool: {name}")
        return done({"content": [{"type": "text", "text": said}], "isError": False})
    except Exception as e:  # noqa: BLE001  a tool's failure is its result
        return done({"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"[:2000]}], "isError": True})


def serve(root: str) -> None:
    """One request a line on standard input, one response a line on standard output."""
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            response = answer(request, root)
        if response is not None:
            print(json.dumps(response), flush=True)


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError) as e:
        print(f"factloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
