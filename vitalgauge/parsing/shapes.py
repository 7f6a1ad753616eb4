"""What a parser finds in one file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Function:
    name: str
    start: int
    start_line: int
    end_line: int
    ccn: int = 1
    cognitive: int = 0


@dataclass
class Class:
    name: str
    start_line: int
    end_line: int
    methods: list[str]
    clusters: int


@dataclass
class Parsed:
    functions: list[Function] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    tokens: list[tuple[str, int]] = field(default_factory=list)  # (text, line)
    tests: int = 0
    skipped: int = 0


def clusters(methods: list[str], fields: dict[str, set[str]], calls: dict[str, set[str]]) -> int:
    """Groups of methods that share a field or call each other."""
    up = {m: m for m in methods}

    def root(m: str) -> str:
        while up[m] != m:
            m = up[m]
        return m

    seen: dict[str, str] = {}
    for m in methods:
        for f in fields.get(m, ()):
            up[root(m)] = root(seen.setdefault(f, m))
        for c in calls.get(m, ()):
            if c in up:
                up[root(m)] = root(c)
    return len({root(m) for m in methods})


def switches(ops: list[str]) -> int:
    """A chain of logical operators: 1, and 1 for each change of operator."""
    return 1 + sum(a != b for a, b in zip(ops, ops[1:], strict=False)) if ops else 0
