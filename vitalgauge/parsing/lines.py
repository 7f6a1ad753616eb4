"""Lines of code, comment and nothing."""

from __future__ import annotations

COMMENTS = {
    "python": ("#", None), "shell": ("#", None), "yaml": ("#", None), "toml": ("#", None), "sql": ("--", ("/*", "*/")), "json": (None, None),
    **dict.fromkeys(("go", "javascript", "jsx", "rust", "scala", "tsx", "typescript"), ("//", ("/*", "*/"))),
}
LITERATE = ("markdown",)


def count(source: str, language: str) -> tuple[int, int, int]:
    """(code, comment, blank) lines of a file; prose counts as comment."""
    line_mark, block = COMMENTS.get(language, (None, None))
    code = comment = blank = 0
    inside = False
    for line in source.splitlines():
        text = line.strip()
        if not text:
            blank += 1
        elif language in LITERATE:
            comment += 1
        elif inside:
            comment += 1
            inside = block[1] not in text
        elif line_mark and text.startswith(line_mark):
            comment += 1
        elif block and text.startswith(block[0]):
            comment += 1
            inside = block[1] not in text[len(block[0]) :]
        else:
            code += 1
            if block and text.rfind(block[0]) > text.rfind(block[1]) and text.count('"') % 2 == 0 and not (line_mark and line_mark in text.split(block[0])[0]):
                inside = True
    return code, comment, blank
