"""Facts from git, read by a child process that runs no hooks and reads no configuration but the repository's format."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SAFE = ["-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-c", "diff.external=", "-c", "protocol.allow=never", "-c", "core.pager=cat"]


def git(root: str, *args: str) -> str | None:
    """The output of a git command, null if it failed. Arguments that start with a dash come from this module only."""
    env = {"PATH": "/usr/local/bin:/usr/bin:/bin", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_TERMINAL_PROMPT": "0", "HOME": "/nonexistent", "LC_ALL": "C"}
    done = subprocess.run(["git", *SAFE, "-C", root, *args], capture_output=True, text=True, env=env, timeout=120)
    return done.stdout if done.returncode == 0 else None


def snapshot(root: str) -> dict:
    """head, branch, tag, remote, prefix and dirty files of the repository that holds `root`; all null outside of one."""
    line = lambda *a: (git(root, *a) or "").strip() or None
    branch = line("rev-parse", "--abbrev-ref", "HEAD")
    dirty = git(root, "status", "--porcelain", "--untracked-files=no") or ""
    return {
        "head": line("rev-parse", "HEAD"), "branch": None if branch == "HEAD" else branch, "tag": line("describe", "--tags", "--exact-match"), "remote": line("config", "--get", "remote.origin.url"),
        "prefix": line("rev-parse", "--show-prefix"), "dirty": sorted(x[3:] for x in dirty.splitlines()),
    }


def described_commit(root: str, out: str) -> str | None:
    """The last commit that touched anything outside the output folder."""
    return (git(root, "log", "-1", "--format=%H", "--", ".", f":(exclude){out}") or "").strip() or None


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(path, lo, hi): the new side's ranges of a unified diff; a pure deletion is one line, the one it happened at."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif path and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            lo, n = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, max(lo, 1), max(lo + n - 1, lo, 1)))
    return out


def hunks(spark: SparkSession, root: str, base: str, repo: str | None = None) -> DataFrame:
    """repo, path, lo, hi of what changed since `base`, the working tree included."""
    if not re.fullmatch(r"[\w./~^@{}-]+", base) or base.startswith("-"):
        raise ValueError(f"not a revision: {base!r}")
    diff = git(root, "diff", "--no-ext-diff", "--no-textconv", "-U0", "--relative", base, "--") or ""
    return spark.createDataFrame([(repo, *h) for h in parse_hunks(diff)], "repo string, path string, lo int, hi int")


@contextmanager
def worktree(root: str, rev: str):
    """A detached worktree at a revision, removed afterwards."""
    if not re.fullmatch(r"[\w./~^@{}-]+", rev) or rev.startswith("-"):
        raise ValueError(f"not a revision: {rev!r}")
    folder = tempfile.mkdtemp(prefix="factloom-rev-")
    at = str(Path(folder, "tree"))
    try:
        if git(root, "worktree", "add", "--detach", "--force", at, rev) is None:
            raise ValueError(f"no such revision: {rev}")
        prefix = (git(root, "rev-parse", "--show-prefix") or "").strip()
        yield str(Path(at, prefix))
    finally:
        git(root, "worktree", "remove", "--force", at)
        shutil.rmtree(folder, ignore_errors=True)
