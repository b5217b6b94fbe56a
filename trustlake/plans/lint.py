"""An architecture linter: who may write, and how time and tables are named."""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass

# Rule codes.
RULES = {
    "TL000": "the file can't be parsed",
    "TL001": "a frame is written outside the lake's writer",
    "TL002": "SQL text that changes tables",
    "TL003": "a local clock without a time zone",
    "TL004": "rows are collected to the driver in a loop",
    "TL005": "a row-at-a-time Python UDF",
    "TL006": "a pinned snapshot is left by a three-part table name",
    "TL007": "a check is built from a string",
    "TL008": "an RDD is used where a frame would do",
}
_SINKS = {"saveAsTable", "insertInto", "save", "parquet", "csv", "json", "orc", "text"}
_ALLOWED = ("sources/", "operators/graph")


@dataclass(frozen=True)
class Finding:
    code: str
    path: str
    line: int

    def __str__(self) -> str:
        return f"{self.path}:{self.line}: {self.code} {RULES[self.code]}"


def _chain(node: ast.AST) -> list[str]:
    out = []
    while isinstance(node, (ast.Attribute, ast.Call)):
        if isinstance(node, ast.Attribute):
            out.append(node.attr)
            node = node.value
        else:
            node = node.func
    return [*([node.id] if isinstance(node, ast.Name) else []), *reversed(out)]


def scan_source(source: str, path: str) -> list[Finding]:
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [Finding("TL000", path, e.lineno or 0)]
    allowed, found = any(a in path.replace(os.sep, "/") for a in _ALLOWED), []
    lines = source.split("\n")

    def add(code: str, node: ast.AST) -> None:
        if f"noqa: {code}" not in lines[node.lineno - 1]:
            found.append(Finding(code, path, node.lineno))

    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            chain = _chain(node.func)
            if "write" in chain[:-1] and chain[-1] in _SINKS and not allowed:
                add("TL001", node)
            if chain[-1:] == ["now"] and not node.args and not node.keywords and "datetime" in chain:
                add("TL003", node)
            if chain[-1:] == ["utcnow"]:
                add("TL003", node)
            if chain[-1:] == ["udf"]:
                add("TL005", node)
            if chain[-1:] == ["sql"] and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                words = node.args[0].value.split()
                if words and words[0].upper() in {"INSERT", "DELETE", "UPDATE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE"}:
                    add("TL002", node)
                if any(w.lower().startswith("lake.") and w.count(".") == 2 for w in words):
                    add("TL006", node)
        if isinstance(node, ast.For) and any(isinstance(x, ast.Call) and _chain(x.func)[-1:] == ["collect"] for x in ast.walk(node.iter)) and not allowed:
            add("TL004", node)
        if isinstance(node, ast.Attribute) and node.attr == "rdd" and not allowed:
            add("TL008", node)
        if isinstance(node, ast.FunctionDef) and any(_chain(d.func if isinstance(d, ast.Call) else d)[-1:] == ["check"] for d in node.decorator_list):
            if any(isinstance(r.value, ast.Constant) and isinstance(r.value.value, str) for r in ast.walk(node) if isinstance(r, ast.Return) and r.value):
                add("TL007", node)
    return sorted(found, key=lambda f: (f.line, f.code))


def scan_paths(*paths: str) -> list[Finding]:
    out = []
    for top in paths:
        files = [top] if os.path.isfile(top) else sorted(os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs if f.endswith(".py"))
        for f in files:
            with open(f) as s:
                out += scan_source(s.read(), f)
    return out
