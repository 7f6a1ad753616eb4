"""Python source by its own syntax tree."""

from __future__ import annotations

import ast
import io
import tokenize

from .shapes import Class, Function, Parsed, clusters

_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_SKIP_MARKS = ("skip", "skipif", "skipIf", "skipUnless", "xfail")


def parse(source: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = source.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    parents = {c: p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}
    for node in ast.walk(tree):
        if isinstance(node, _SCOPES):
            body = node.body if isinstance(node.body, list) else [node.body]
            out.functions.append(Function(_name(node, parents), offsets[node.lineno - 1] + node.col_offset, node.lineno, node.end_lineno or node.lineno, 1 + _points(body), _cognitive(body, 0, lines)))
        elif isinstance(node, ast.ClassDef) and (found := _class(node)):
            out.classes.append(found)
    out.functions.sort(key=lambda f: f.start)
    out.tests, out.skipped = _tests(tree)
    try:
        skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
        out.tokens = [(t.string, t.start[0]) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in skip and t.string.strip()]
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def _name(node: ast.AST, parents: dict[ast.AST, ast.AST]) -> str:
    if not isinstance(node, ast.Lambda):
        return node.name
    up = parents.get(node)
    if isinstance(up, ast.Assign) and isinstance(up.targets[0], ast.Name):
        return up.targets[0].id
    if isinstance(up, ast.Dict) and node in up.values:
        k = up.keys[up.values.index(node)]
        if isinstance(k, ast.Constant):
            return str(k.value)
    return f"<anonymous@{node.lineno}>"


def _points(nodes: list[ast.AST]) -> int:
    n = 0
    for node in nodes:
        if isinstance(node, _SCOPES):
            continue
        n += isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp))
        n += _points(list(ast.iter_child_nodes(node)))
    return n


def _cognitive(nodes: list[ast.AST], depth: int, lines: list[str]) -> int:
    return sum(_weigh(n, depth, lines) for n in nodes)


def _weigh(node: ast.AST, depth: int, lines: list[str]) -> int:
    if isinstance(node, _SCOPES):
        return 0
    if isinstance(node, ast.If):
        total = 1 + depth + _cognitive([node.test, *node.body], depth + 1, lines)
        rest = node.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and lines[rest[0].lineno - 1].lstrip().startswith("elif"):
            branch = rest[0]  # every branch stands inside the first condition
            total += 2 + depth + _cognitive([branch.test, *branch.body], depth + 2, lines)
            rest = branch.orelse
        return total + (1 + _cognitive(rest, depth + 1, lines) if rest else 0)
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match)):
        other = getattr(node, "orelse", [])
        inner = [c for c in ast.iter_child_nodes(node) if c not in other]
        return 1 + depth + _cognitive(inner, depth + 1, lines) + (1 + _cognitive(other, depth + 1, lines) if other else 0)
    if isinstance(node, ast.IfExp):
        return 1 + depth + _cognitive(list(ast.iter_child_nodes(node)), depth, lines)
    return _cognitive(list(ast.iter_child_nodes(node)), depth, lines)


def _class(node: ast.ClassDef) -> Class | None:
    methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if not methods:
        return None
    names = [m.name for m in methods]
    fields: dict[str, set[str]] = {}
    calls: dict[str, set[str]] = {}
    for m in methods:
        me = m.args.args[0].arg if m.args.args else "self"
        called = {id(c.func) for c in ast.walk(m) if isinstance(c, ast.Call)}
        for a in ast.walk(m):
            if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) and a.value.id == me:
                (calls if id(a) in called else fields).setdefault(m.name, set()).add(a.attr)
    unique = list(dict.fromkeys(names))
    return Class(node.name, node.lineno, node.end_lineno or node.lineno, names, clusters(unique, fields, calls))


def _tests(tree: ast.AST) -> tuple[int, int]:
    total = skipped = 0

    def visit(nodes: list[ast.stmt], off: bool) -> None:
        nonlocal total, skipped
        for n in nodes:
            marked = off or any(any(isinstance(x, ast.Attribute) and x.attr in _SKIP_MARKS or isinstance(x, ast.Name) and x.id in _SKIP_MARKS for x in ast.walk(d)) for d in getattr(n, "decorator_list", []))
            if isinstance(n, ast.ClassDef):
                visit(n.body, marked)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test"):
                body = [s.value.func for s in n.body if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call)]
                own = any(isinstance(f, ast.Attribute) and f.attr in ("skip", "skipTest") for f in body)
                total += 1
                skipped += marked or own

    visit(getattr(tree, "body", []), False)
    return total, skipped
