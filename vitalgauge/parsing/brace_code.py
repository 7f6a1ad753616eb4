"""Rust, Go, Scala, JavaScript and TypeScript by a lexer and their braces.

An approximation of a grammar: comments and strings are set aside exactly, functions and
control structures are told by their keywords and the block that follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .shapes import Class, Function, Parsed, clusters, switches

_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<str>r\#*"(?:.|\n)*?"\#*|\"\"\"(?:.|\n)*?\"\"\"|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*')
    |(?P<word>[A-Za-z_$][\w$]*!?)
    |(?P<num>\d[\w.]*)
    |(?P<op>=>|->|::|\?\?|\?\.|&&|\|\||[-+*/%<>=!&|^]=|[^\s\w])""",
    re.S | re.X,
)
NEST = {"for", "while", "do", "switch", "catch", "loop", "match", "select", "try"}
POINTS = {
    "rust": {"if", "while", "for", "loop"}, "go": {"if", "for", "case"}, "scala": {"if", "while", "for", "case", "catch"},
    "js": {"if", "for", "while", "do", "case", "catch"},
}
NESTS = {
    "rust": {"while", "for", "loop", "match"}, "go": {"for", "switch", "select"}, "scala": {"for", "while", "match", "try"},
    "js": {"for", "while", "do", "switch", "catch"},
}
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "do", "else", "with", "new", "typeof", "await", "match"}


@dataclass
class Token:
    text: str
    at: int
    line: int
    kind: str


def lex(source: str, language: str) -> list[Token]:
    out, line, at, i = [], 1, 0, 0
    while i < len(source):
        m = _LEX.match(source, i)
        if not m:
            i += 1
            continue
        text, kind = m[0], m.lastgroup or "op"
        if kind == "str" and language == "rust" and text[0] == "'" and not re.fullmatch(r"'(?:\\.+|[^'\\])'", text):
            text, kind = "'", "op"  # a lifetime
        if kind != "skip":
            out.append(Token(text, at, line, kind))
        line += text.count("\n")
        at += len(text.encode())
        i += len(text)
    return out


def parse(source: str, language: str) -> Parsed:
    kind = language if language in POINTS else "js"
    ts = lex(source, kind)
    out = Parsed(tokens=[(t.text, t.line) for t in ts])
    heads = _heads(ts, kind)
    spans = [(h, name, *_body(ts, after)) for h, name, after in heads]
    inner = sorted((h, end) for h, _, _, end in spans)
    for h, name, begin, end in spans:
        f = Function(name or f"<anonymous@{ts[h].line}>", ts[h].at, ts[h].line, ts[min(end, len(ts) - 1)].line)
        _score(ts, begin, end, kind, [(a, b) for a, b in inner if begin < a and b <= end and a != h], f)
        out.functions.append(f)
    out.functions.sort(key=lambda f: f.start)
    out.classes = _classes(ts, kind)
    out.tests, out.skipped = _tests(ts, kind)
    return out


def _match(ts: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at ``i``."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for k in range(i, len(ts)):
        if ts[k].kind == "op":
            depth += ts[k].text in pairs
            depth -= ts[k].text in pairs.values()
            if not depth:
                return k
    return len(ts) - 1


def _body(ts: list[Token], i: int) -> tuple[int, int]:
    """From after a head to the end of its block, or of its one expression."""
    depth = 0
    while i < len(ts):
        t = ts[i].text
        if t == "{" and depth == 0:
            return i, _match(ts, i)
        if t in "([" and ts[i].kind == "op":
            i = _match(ts, i)
        elif t == ";" or (t in ")],}" and ts[i].kind == "op"):
            return i, i
        elif t in ("=", "=>") and ts[i].kind == "op" and i + 1 < len(ts):
            if ts[i + 1].text == "{":
                return i + 1, _match(ts, i + 1)
            k, line = i + 1, ts[i + 1].line
            while k + 1 < len(ts) and ts[k].text not in (";", ",") and not (ts[k].text in ")]}" and ts[k].kind == "op"):
                k = _match(ts, k) + 1 if ts[k].text in "([{" and ts[k].kind == "op" else k + 1
                if k < len(ts) and ts[k].line > line and ts[k - 1].kind != "op":
                    break
            return i + 1, max(i + 1, k - 1)
        i += 1
    return len(ts) - 1, len(ts) - 1


def _heads(ts: list[Token], kind: str) -> list[tuple[int, str, int]]:
    """(first token, name, first token after name and parameters) of each function."""
    out = []
    for i, t in enumerate(ts):
        nxt = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind == "word" and nxt:
            if t.text == {"rust": "fn", "scala": "def"}.get(kind) and nxt.kind == "word":
                out.append((i, nxt.text, i + 2))
            elif kind == "go" and t.text == "func":
                k = i + 1
                if nxt.text == "(" and (e := _match(ts, k) + 1) < len(ts) and ts[e].kind == "word" and e + 1 < len(ts) and ts[e + 1].text == "(":
                    k = e
                name = ts[k].text if ts[k].kind == "word" else _bound(ts, i)
                out.append((i, name, k + 1 if ts[k].kind == "word" else k))
            elif kind == "js" and t.text == "function":
                k = i + 1 + (nxt.text == "*")
                named = ts[k].kind == "word"
                out.append((i, ts[k].text if named else _bound(ts, i), k + named))
            elif kind == "js" and nxt.text == "(" and t.text not in _NO_METHOD and (i == 0 or ts[i - 1].text not in (".", "function", "new")):
                e = _match(ts, i + 1) + 1
                if e < len(ts) and (ts[e].text == "{" or ts[e].text == ":" and _typed(ts, e)) and (i == 0 or ts[i - 1].text in "{};" or ts[i - 1].text in ("async", "static", "get", "set", "public", "private", "protected", "*", ",", "readonly")):
                    out.append((i, t.text, i + 1))
        elif kind in ("js", "scala") and t.text == "=>" and not (kind == "scala" and _in_case(ts, i)):
            start = i - 1
            if ts[start].text == ")":
                depth = 0
                while start >= 0:
                    depth += (ts[start].text == ")") - (ts[start].text == "(")
                    if not depth:
                        break
                    start -= 1
            out.append((max(start, 0), _bound(ts, max(start, 0)), i))
    return out


def _typed(ts: list[Token], i: int) -> bool:
    while i < len(ts) and ts[i].text not in (";", "}", "=", ")"):
        if ts[i].text == "{":
            return True
        i += 1
    return False


def _in_case(ts: list[Token], i: int) -> bool:
    while i > 0 and ts[i].text not in ("{", "}", ";") and ts[i].line >= ts[i - 1].line:
        if ts[i].text == "case":
            return True
        i -= 1
    return ts[i].text == "case"


def _bound(ts: list[Token], i: int) -> str:
    """The name that an anonymous function is bound to."""
    while i > 0 and ts[i - 1].text in ("async", "*"):
        i -= 1
    if i >= 2 and ts[i - 1].text in ("=", ":", ":=") and ts[i - 2].kind == "word":
        return ts[i - 2].text
    return ""


def _score(ts: list[Token], begin: int, end: int, kind: str, holes: list[tuple[int, int]], f: Function) -> None:
    points, nests = POINTS[kind], NESTS[kind]
    skip = {k for a, b in holes for k in range(a, b + 1)}
    levels: list[tuple[int, int]] = []  # (depth, end) of the control blocks around
    chain: list[str] = []
    i = begin
    match_ends: list[int] = []
    while i <= end and i < len(ts):
        if i in skip:
            i += 1
            continue
        while levels and i > levels[-1][1]:
            levels.pop()
        depth = len(levels)
        t, prev = ts[i], ts[i - 1].text if i else ""
        if t.kind == "word":
            if t.text in points and not (t.text == "while" and kind == "js" and prev == "}" and _ends_do(ts, i)) and not (kind == "scala" and t.text == "case" and i + 1 < len(ts) and ts[i + 1].text in ("class", "object")) and not (kind == "rust" and t.text == "for" and i + 1 < len(ts) and ts[i + 1].text == "<"):
                f.ccn += 1
            if t.text == "if":
                chained = prev == "else"
                f.cognitive += 1 if chained else 1 + depth
                if not chained:
                    levels.append((depth + 1, _chain_end(ts, i, end)))
            elif t.text == "else" and not (i + 1 < len(ts) and ts[i + 1].text == "if"):
                f.cognitive += 1
            elif t.text in nests and not (t.text == "while" and _ends_do(ts, i)):
                f.cognitive += 1 + depth
                b = _body(ts, i + 1)
                levels.append((depth + 1, b[1]))
                if t.text == "match" and kind == "rust":
                    match_ends.append(b[1])
            elif t.text in ("goto", "throw") and (kind, t.text) in (("go", "goto"), ("scala", "throw")):
                f.cognitive += 1 + depth
        elif t.text in ("&&", "||", "??"):
            f.ccn += 1
            chain.append(t.text)
        elif t.text == "?" and kind == "rust":
            f.ccn += 1
            f.cognitive += 1 + depth
        elif t.text == "?" and kind == "js" and i + 1 < len(ts) and ts[i + 1].text not in (":", ")", ",", "=") and any(x.text == ":" for x in ts[i + 1 : i + 80]):
            f.ccn += 1
            f.cognitive += 1 + depth
        elif t.text == "=>" and kind == "rust":
            f.ccn += 1
        if chain and t.kind == "op" and t.text in ("{", "}", ";", ","):
            f.cognitive += switches(chain)
            chain = []
        i += 1
    f.cognitive += switches(chain)


def _ends_do(ts: list[Token], i: int) -> bool:
    if ts[i - 1].text != "}":
        return False
    depth, k = 0, i - 1
    while k >= 0:
        depth += (ts[k].text == "}") - (ts[k].text == "{")
        if not depth:
            break
        k -= 1
    return k > 0 and ts[k - 1].text == "do"


def _chain_end(ts: list[Token], i: int, end: int) -> int:
    """The end of an ``if`` with all its ``else`` parts."""
    _, e = _body(ts, i + 1)
    while e + 1 < len(ts) and ts[e + 1].text == "else":
        k = e + 2
        _, e = _body(ts, k + 1 if k < len(ts) and ts[k].text == "if" else k)
    return min(e, end)


def _classes(ts: list[Token], kind: str) -> list[Class]:
    word, me = {"js": ("class", "this"), "rust": ("impl", "self")}.get(kind, ("", ""))
    out = []
    for i, t in enumerate(ts):
        if not word or t.text != word or t.kind != "word":
            continue
        begin, end = _body(ts, i + 1)
        head = [x.text for x in ts[i + 1 : begin] if x.kind == "word"]
        if begin == end or not head:
            continue
        name = head[head.index("for") + 1] if "for" in head[:-1] else head[0]
        own = [(h, n, *_body(ts, a)) for h, n, a in _heads(ts[: end + 1], kind) if begin < h and _depth(ts, begin, h) == 1 and n and ts[h].text != "=>"]
        methods = list(dict.fromkeys(n for _, n, _, _ in own))
        if not methods:
            continue
        fields: dict[str, set[str]] = {}
        calls: dict[str, set[str]] = {}
        for _, n, b, e in own:
            for k in range(b, e - 1):
                if ts[k].text == me and ts[k + 1].text == "." and ts[k + 2].kind == "word":
                    called = k + 3 < len(ts) and ts[k + 3].text == "("
                    (calls if called else fields).setdefault(n, set()).add(ts[k + 2].text)
        out.append(Class(name, t.line, ts[end].line, [n for _, n, _, _ in own], clusters(methods, fields, calls)))
    return out


def _depth(ts: list[Token], begin: int, i: int) -> int:
    return sum((t.text == "{") - (t.text == "}") for t in ts[begin:i] if t.kind == "op")


def _tests(ts: list[Token], kind: str) -> tuple[int, int]:
    total = skipped = 0
    for i, t in enumerate(ts):
        n = [x.text for x in ts[i + 1 : i + 4]] + [""] * 3
        if kind == "js" and t.kind == "word" and (i == 0 or ts[i - 1].text != "."):
            if t.text in ("it", "test", "describe", "xit", "xtest", "xdescribe") and n[0] in ("(", "."):
                off = t.text[0] == "x" or n[0] == "." and n[1] in ("skip", "todo")
                if n[0] == "(" or off or n[1] in ("only", "each", "concurrent"):
                    total += 1
                    skipped += off
        elif kind == "rust" and t.text == "#" and n[0] == "[":
            attrs, k = [], i
            if ts[i - 1].text == "]" and i and _attribute_before(ts, i):
                continue
            while k + 1 < len(ts) and ts[k].text == "#" and ts[k + 1].text == "[":
                e = _match(ts, k + 1)
                attrs.append([x.text for x in ts[k + 2 : e]])
                k = e + 1
            if any(a and a[-1] == "test" or a[:1] == ["test"] or "test" in a[:3] and a[0] != "cfg" for a in attrs):
                total += 1
                skipped += any(a[:1] == ["ignore"] for a in attrs)
        elif kind == "go" and t.text == "func" and re.match("Test[A-Z_0-9]|Test$", n[0]):
            b, e = _body(ts, i + 2)
            total += 1
            skipped += any(ts[k].text in ("Skip", "Skipf", "SkipNow") and ts[k - 1].text == "." for k in range(b, e))
        elif kind == "scala" and t.text in ("test", "it", "ignore") and n[0] == "(" and (i == 0 or ts[i - 1].text != "."):
            total += 1
            skipped += t.text == "ignore"
    return total, skipped


def _attribute_before(ts: list[Token], i: int) -> bool:
    depth, k = 0, i - 1
    while k >= 0:
        depth += (ts[k].text == "]") - (ts[k].text == "[")
        if not depth:
            return k > 0 and ts[k - 1].text == "#"
        k -= 1
    return False
