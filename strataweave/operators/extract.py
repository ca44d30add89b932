"""Extractors: source files to nodes and edges, one function per language behind a registry.

An extractor takes (path, text) and yields rows (kind, qualified_name, name, label, type, target, line): kind `node` or
`edge`.  Files are read in Arrow batches where they lie; an extractor that fails on a file yields an `error` row for it."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROW = "project string, path string, kind string, qualified_name string, name string, label string, type string, target string, line int"
Rows = Iterator[tuple]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def python(path: str, text: str) -> Rows:
    """Classes, functions, methods, imports and calls."""
    module = re.sub(r"\.py$", "", path.replace("\\", "/")).replace("/", ".")
    tree = ast.parse(text.lstrip("﻿"))

    def visit(node: ast.AST, owner: str, inside: str | None) -> Rows:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                qn = f"{owner}.{child.name}"
                label = "Class" if isinstance(child, ast.ClassDef) else "Method" if isinstance(node, ast.ClassDef) else "Function"
                yield ("node", qn, child.name, label, None, None, child.lineno)
                yield ("edge", owner, None, None, "DEFINES_METHOD" if label == "Method" else "DEFINES", qn, child.lineno)
                if isinstance(child, ast.ClassDef):
                    for b in child.bases:
                        yield ("edge", qn, None, None, "INHERITS", ast.unparse(b), child.lineno)
                yield from visit(child, qn, inside if label == "Class" else qn)
            else:
                if isinstance(child, ast.Import):
                    for a in child.names:
                        yield ("edge", module, None, None, "IMPORTS", a.name, child.lineno)
                elif isinstance(child, ast.ImportFrom):
                    yield ("edge", module, None, None, "IMPORTS", "." * child.level + (child.module or ""), child.lineno)
                elif isinstance(child, ast.Call):
                    yield ("edge", inside or module, None, None, "CALLS", ast.unparse(child.func), child.lineno)
                yield from visit(child, owner, inside)

    yield ("node", module, module.rpartition(".")[2], "Module", None, None, 1)
    yield from visit(tree, module, None)


_SQL_NAME = r'((?:\[[^\]]+\]|"[^"]+"|`[^`]+`|\w+)(?:\.(?:\[[^\]]+\]|"[^"]+"|`[^`]+`|\w+))*)'


def sql(path: str, text: str) -> Rows:
    """Tables, views, routines and indexes created; tables read, written and routines executed."""
    clean = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'", lambda m: " " * len(m.group()), text)
    name = lambda s: re.sub(r'[\[\]"`]', "", s)
    owner = path
    labels = {"table": "Table", "view": "View", "procedure": "StoredProcedure", "proc": "StoredProcedure", "function": "Function", "index": "Index"}
    for m in re.finditer(rf"(?i)\bcreate\s+(?:or\s+\w+\s+)?(?:unique\s+|temporary\s+)?(table|view|procedure|proc|function|index)\s+(?:if\s+not\s+exists\s+)?{_SQL_NAME}", clean):
        yield ("node", name(m[2]), name(m[2]).rpartition(".")[2], labels[m[1].lower()], None, None, _line(clean, m.start()))
        yield ("edge", path, None, None, "DEFINES", name(m[2]), _line(clean, m.start()))
    for kind, pattern in (("READS", rf"(?i)\b(?:from|join)\s+{_SQL_NAME}"), ("WRITES", rf"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+{_SQL_NAME}"), ("EXECUTES", rf"(?i)\bexec(?:ute)?\s+{_SQL_NAME}")):
        for m in re.finditer(pattern, clean):
            if name(m[1]).lower() not in ("select", "set", "values"):
                yield ("edge", owner, None, None, kind, name(m[1]), _line(clean, m.start()))


def terraform(path: str, text: str) -> Rows:
    """Resources, data, modules, variables and outputs; references between them."""
    clean = re.sub(r"(?m)#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/", " ", text)
    for m in re.finditer(r'(?m)^\s*(resource|data|module|variable|output|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', clean):
        kind, a, b = m[1], m[2], m[3]
        qn = {"resource": f"{a}.{b}", "data": f"data.{a}.{b}", "variable": f"var.{a}"}.get(kind, f"{kind}.{a}")
        yield ("node", qn, b or a, "Terraform" + kind.capitalize(), None, None, _line(clean, m.start()))
        depth, i = 1, m.end()
        while i < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[i], 0)
            i += 1
        for ref in sorted(set(re.findall(r"\b(var\.\w+|module\.\w+|data\.\w+\.\w+|(?:aws|azurerm|google|kubernetes)_\w+\.\w+)", clean[m.end() : i]))):
            if ref != qn:
                yield ("edge", qn, None, None, "REFERENCES", ref, _line(clean, m.start()))


def csharp(path: str, text: str) -> Rows:
    """A pattern-grade subset: namespaces, types, methods, base types, routes, published and consumed messages."""
    clean = re.sub(r'//[^\n]*|/\*[\s\S]*?\*/', lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ns = (re.search(r"\bnamespace\s+([\w.]+)", clean) or ["", ""])[1]
    owner = path
    for m in re.finditer(r"\b(class|interface|record|struct|enum)\s+(\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?\s*(?::\s*([^{;]+))?|\b(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\],.?]+\s+(\w+)\s*\(([^)]*)\)\s*(?:\{|=>)", clean):
        if m[1]:
            owner = f"{ns}.{m[2]}" if ns else m[2]
            yield ("node", owner, m[2], m[1].capitalize(), None, None, _line(clean, m.start()))
            for b in re.findall(r"[\w.]+(?:<[^>]*>)?", m[3] or ""):
                yield ("edge", owner, None, None, "IMPLEMENTS" if re.match(r"I[A-Z]", b) else "INHERITS", b, _line(clean, m.start()))
        elif m[4] not in ("if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new"):
            yield ("node", f"{owner}.{m[4]}", m[4], "Method", None, None, _line(clean, m.start()))
            yield ("edge", owner, None, None, "DEFINES_METHOD", f"{owner}.{m[4]}", _line(clean, m.start()))
    for m in re.finditer(r'\[Http(Get|Post|Put|Delete|Patch)(?:\("([^"]*)"\))?\]', clean):
        yield ("node", f"{m[1].upper()}:{m[2] or ''}", f"{m[1].upper()} {m[2] or ''}", "Route", None, None, _line(clean, m.start()))
    for kind, pattern in (("PUBLISHES", r"\.Publish(?:Async)?<(\w+)>|\.Publish(?:Async)?\(\s*new\s+(\w+)"), ("CONSUMES", r"IConsumer<(\w+)>")):
        for m in re.finditer(pattern, clean):
            yield ("edge", owner, None, None, kind, next(g for g in m.groups() if g), _line(clean, m.start()))


# Declarations, and imports, of languages that are read by pattern: (label, pattern with the name).
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "go": [("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"), ("Class", r"^type\s+(\w+)\s+struct\b"), ("Interface", r"^type\s+(\w+)\s+interface\b")],
    "java": [("Class", r"\b(?:class|record|enum)\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(")],
    "rs": [("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("Interface", r"^\s*(?:pub\s+)?trait\s+(\w+)")],
    "ts": [("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Function", r"\bfunction\s+(\w+)"), ("Method", r"^\s+(?:(?:public|private|protected|static|async)\s+)*(?!if|for|while|switch|catch|return|function\b)(\w+)\s*\([^)]*\)\s*(?::[^{;]+)?\{")],
    "rb": [("Class", r"^\s*(?:class|module)\s+([\w:]+)"), ("Method", r"^\s*def\s+(?:self\.)?([\w?!]+)")],
    "php": [("Class", r"\b(?:class|trait)\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Function", r"\bfunction\s+(\w+)\s*\(")],
    "c": [("Function", r"^(?:[\w*]+\s+)+\**(\w+)\s*\([^;{]*\)\s*\{"), ("Class", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{")],
    "sh": [("Function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{")],
    "cfm": [("Function", r'(?i)<cffunction\b[^>]*\bname\s*=\s*"(\w+)"'), ("Class", r'(?i)<cfcomponent\b[^>]*\bdisplayname\s*=\s*"([^"]+)"')],
}
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "java": r"^import\s+(?:static\s+)?([\w.*]+);", "rs": r"^\s*use\s+([\w:]+)", "ts": r"""\bfrom\s+['"]([^'"]+)['"]""", "rb": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "php": r"^use\s+([\w\\\\]+)",
    "c": r'^\s*#include\s+[<"]([^>"]+)[>"]', "sh": r"^\s*(?:source|\.)\s+(\S+)", "cfm": r'(?i)<cfinclude\b[^>]*\btemplate\s*=\s*"([^"]+)"',
}
_ALIKE = {"js": "ts", "tsx": "ts", "jsx": "ts", "h": "c", "cpp": "c", "cc": "c", "hpp": "c", "bash": "sh", "cfc": "cfm"}


def by_pattern(kind: str) -> Callable[[str, str], Rows]:
    """An extractor of declarations and imports, by the patterns of one language, outside comments."""

    def run(path: str, text: str) -> Rows:
        comment = r"(?m)^\s*#(?!include).*" if kind in ("rb", "sh") else r"(?m)(?<![:'\"])//[^\n]*|/\*[\s\S]*?\*/"
        clean = re.sub(comment, lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        owner = path
        found = sorted((m.start(1), label, m[1]) for label, p in DECLARATIONS[kind] for m in re.finditer(p, clean, re.M))
        for at, label, name in found:
            qn = f"{owner if label == 'Method' else path}::{name}"
            yield ("node", qn, name, label, None, None, _line(clean, at))
            yield ("edge", owner if label == "Method" else path, None, None, "DEFINES_METHOD" if label == "Method" else "DEFINES", qn, _line(clean, at))
            if label in ("Class", "Interface"):
                owner = qn
        for m in re.finditer(IMPORTS[kind], clean, re.M):
            yield ("edge", path, None, None, "IMPORTS", m[1], _line(clean, m.start()))

    return run


def ansible(path: str, text: str) -> Rows:
    """Plays, tasks, roles and what they include, notify and template."""
    owner = path
    for i, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*-\s+name:\s*(.+?)\s*$", line):
            owner = f"{path}::{m[1].strip(chr(34) + chr(39))}"
            yield ("node", owner, m[1].strip("\"'"), "AnsibleTask", None, None, i)
            yield ("edge", path, None, None, "DEFINES", owner, i)
        elif m := re.match(r"\s*(?:-\s+)?(hosts|notify|src|role|include_tasks|import_tasks|import_playbook)\s*:\s*([^\s#][^#]*?)\s*$", line):
            kind = {"hosts": "TARGETS", "notify": "NOTIFIES", "src": "TEMPLATES", "role": "INCLUDES"}.get(m[1], "INCLUDES")
            yield ("edge", owner, None, None, kind, m[2].strip("\"'"), i)
        elif m := re.match(r"\s*(?:ansible\.builtin\.)?(?:include|import)_role:\s*$", line):
            yield ("edge", owner, None, None, "INCLUDES", "role", i)


REGISTRY: dict[str, Callable[[str, str], Rows]] = {"py": python, "sql": sql, "tf": terraform, "cs": csharp, "yml": ansible, "yaml": ansible}
REGISTRY |= {k: by_pattern(k) for k in DECLARATIONS} | {k: by_pattern(v) for k, v in _ALIKE.items()}


def extract(files: DataFrame, registry: dict[str, Callable[[str, str], Rows]] | None = None) -> DataFrame:
    """files: (project, path, content). All rows of all files that an extractor is registered for; more can be passed in."""
    chosen = registry or REGISTRY

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for project, path, text in f.itertuples(index=False):
                get = chosen.get((path or "").rpartition(".")[2].lower())
                if get and text:
                    try:
                        out += [(project, path, *r) for r in get(path, text)]
                    except (SyntaxError, ValueError, RecursionError) as e:
                        out.append((project, path, "error", None, type(e).__name__, None, None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")], dtype=object)

    return files.select("project", "path", "content").mapInPandas(run, ROW)


def span_merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def diff_spans(diff: str) -> list[tuple[str, int, int]]:
    """(path, first, last) of the changed lines of the new files of a unified diff, merged."""
    per: dict[str, list[tuple[int, int]]] = {}
    path = ""
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].split("\t")[0].strip())
        m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)
        if m and path and path != "/dev/null":
            first, n = int(m[1]), int(m[2] if m[2] is not None else 1)
            per.setdefault(path, []).append((first, first + max(n, 1) - 1))
    return [(p, a, b) for p, s in per.items() for a, b in span_merge(s)]


def first_json(text: str) -> str | None:
    """The first balanced JSON object or array of a model's answer, without thinking tags and fences."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    fenced = re.search(r"(?s)```(?:json)?\s*(.*?)```", text)
    body = fenced[1] if fenced else text
    for m in re.finditer(r"[\[{]", body):
        depth, inside, i = 0, False, m.start()
        while i < len(body):
            c = body[i]
            if inside:
                i += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    return body[m.start() : i + 1]
            i += 1
    return None


def complexity(text: str, braces: bool = True) -> tuple[int, float, int, int, int]:
    """(deepest nesting, share of lines at depth 3 or more, functions, lines, branches) of one file."""
    lines = [x for x in text.splitlines() if x.strip()]
    depth, deepest, deep, functions, branches = 0, 0, 0, 0, 0
    widths = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) for x in lines]
    steps = [b - a for a, b in zip(widths, widths[1:]) if 0 < b - a <= 8]
    unit = max(set(steps), key=steps.count) if steps else 4
    for line, width in zip(lines, widths):
        at = depth if braces else width // unit
        deepest, deep = max(deepest, at), deep + (at >= 3)
        functions += bool(re.search(r"\b(def|function|func|fn)\b|\b(public|private|protected|internal)\b[^=;]*\([^;]*$", line))
        branches += len(re.findall(r"\b(if|elif|switch|match|case)\b", line))
        depth = max(0, depth + line.count("{") - line.count("}"))
    return deepest, deep / len(lines) if lines else 0.0, functions, len(lines), branches
