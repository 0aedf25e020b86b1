"""JSON Patch: add, remove and replace, on a copy."""

from __future__ import annotations

import copy


def _steps(path: str) -> list[str]:
    if path and not path.startswith("/"):
        raise ValueError(f"not a JSON pointer: {path!r}")
    return [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]


def apply(document, operations: list[dict]):
    """`document` after the operations, in order; an operation on a place that doesn't exist is an error."""
    out = copy.deepcopy(document)
    for op in operations:
        steps, kind = _steps(op["path"]), op["op"]
        if kind not in ("add", "remove", "replace"):
            raise ValueError(f"unknown operation: {kind}")
        if not steps:
            if kind == "remove":
                raise ValueError("the whole document can't be removed")
            out = copy.deepcopy(op["value"])
            continue
        at = out
        for s in steps[:-1]:
            at = at[int(s)] if isinstance(at, list) else at[s]
        last = steps[-1]
        if isinstance(at, list):
            n = len(at) if last == "-" else int(last)
            if not 0 <= n <= len(at) - (kind != "add"):
                raise IndexError(op["path"])
            if kind == "add":
                at.insert(n, copy.deepcopy(op["value"]))
            elif kind == "remove":
                del at[n]
            else:
                at[n] = copy.deepcopy(op["value"])
        elif kind != "add" and last not in at:
            raise KeyError(op["path"])
        elif kind == "remove":
            del at[last]
        else:
            at[last] = copy.deepcopy(op["value"])
    return out
