"""Reading Markdown.  What SQL functions can say is a column expression; the scanners that look
for a matching bracket or backtick run are Arrow functions over batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

LINKS = ArrayType(StructType([StructField("line", LongType()), StructField("target", StringType())]))
NAMES = ArrayType(StructType([StructField("line", LongType()), StructField("name", StringType())]))


def lines_of(body: Column) -> Column:
    """array<struct(line, text)>: the lines, numbered from 1, without the empty piece after a last
    line end."""
    parts = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "\r?\n$", ""), "\r?\n")
    parts = F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)
    return F.transform(parts, lambda t, i: F.struct((i + 1).cast("long").alias("line"), t.alias("text")))


def prose_of(body: Column) -> Column:
    """:func:`lines_of` without fences and what they hold.

    A running count of the fences before each line, kept in the row: a document's lines
    aren't shuffled or sorted.
    """
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line:bigint,text:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fence = x["text"].rlike(r"^\s*(```|~~~)")
        keep = ~fence & ~state["inside"]
        return F.struct((state["inside"] != fence).alias("inside"), F.when(keep, F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"))

    simple = ~F.coalesce(body, F.lit("")).rlike(r"(?m)^\s*(```|~~~)")
    return F.when(simple, lines_of(body)).otherwise(F.aggregate(lines_of(body), start, step, lambda s: s["out"]))


def prose_lines(docs: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """key, line, text of the lines outside fences."""
    return docs.select(key, F.explode(prose_of(F.col(body))).alias("x")).select(key, "x.line", "x.text")


def fence_state(lines: DataFrame, key: str, line: str = "line", text: str = "text") -> DataFrame:
    """Adds ``inside``: whether a line of an exploded document lies in a fence."""
    w = Window.partitionBy(key).orderBy(line)
    mark = F.col(text).rlike(r"^\s*(```|~~~)").cast("int")
    return lines.withColumn("inside", (F.sum(mark).over(w) - mark) % 2 == 1)


def slug(heading: Column) -> Column:
    """ASCII letters and digits in lower case; runs of blanks, hyphens and underscores are one
    hyphen, which doesn't end the slug; the rest goes."""
    kept = F.regexp_replace(heading, r"[^A-Za-z0-9\s_-]", "")
    return F.regexp_replace(F.lower(F.regexp_replace(kept, r"[\s_-]+", "-")), "-+$", "")


def is_external(target: Column) -> Column:
    return target.rlike(r"^(https?://|mailto:|ftp://|//)")


def marker_count(text: Column, markers: tuple[str, ...]) -> Column:
    """Whole occurrences of each marker, summed; case counts."""
    out = F.lit(0)
    for m in markers:
        out = out + F.regexp_count(text, F.lit(re.escape(m)))
    return out


def _close(text: str, at: int, mark: str) -> int:
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == mark:
            return at
        else:
            at += 1
    return -1


def line_links(text: str) -> list[str]:
    """Targets of ``[text](target "title")`` on a line; images and escaped brackets are none."""
    out, i = [], 0
    while (i := text.find("[", i)) >= 0:
        if text[i - 1 : i] in ("\\", "!"):
            i += 1
            continue
        end = _close(text, i + 1, "]")
        if end < 0:
            break
        if text[end + 1 : end + 2] != "(":
            i = end + 1
            continue
        stop = _close(text, end + 2, ")")
        if stop < 0:
            break
        raw = text[end + 2 : stop]
        out.append((raw.split() or [raw])[0])
        i = stop + 1
    return out


def without_code(line: str) -> str:
    """Spans between backtick runs of equal length are blanked; a run that nothing closes
    blanks the rest of the line."""
    out, i = [], 0
    for m in iter(lambda: re.compile("`+").search(line, i), None):
        out.append(line[i : m.start()])
        close = next((c for c in re.finditer("`+", line[m.end() :]) if len(c[0]) == len(m[0])), None)
        end = m.end() + close.end() if close else len(line)
        out.append(" " * (end - m.start()))
        i = end
    return "".join(out) + line[i:]


def inline_names(line: str) -> list[str]:
    """What stands between single backticks and may name a definition.  Spans of doubled backticks
    are passed over; a backtick that nothing closes ends the line."""
    out, i = [], 0
    while (i := line.find("`", i)) >= 0:
        if line[i + 1 : i + 2] == "`":
            end = line.find("``", i + 2)
            if end < 0:
                break
            i = end + 2
            continue
        end = line.find("`", i + 1)
        if end < 0:
            break
        span = line[i + 1 : end]
        if is_name(span) and names_definition(span):
            out.append(span)
        i = end + 1
    return out


def is_name(text: str) -> bool:
    """Two or more of letters, digits and ``_ : . < > -``, with a letter, that isn't a hex digest."""
    if not re.fullmatch(r"[A-Za-z0-9_:.<>-]{2,}", text) or not re.search("[A-Za-z]", text):
        return False
    return not (len(text) >= 4 and re.fullmatch("[0-9A-Fa-f]+", text) and re.search("[0-9]", text))


def names_definition(text: str) -> bool:
    """Whether a name may be one that source code defines: no flag, package, file, module path,
    settings key or parameterised type."""
    if re.search("[-<>]|:$", text) or re.search(r"\.[a-z]{2,5}$", text):
        return False
    if "::" in text:
        return not all(part[:1].isascii() and part[:1].islower() for part in text.split("::"))
    return "." not in text or re.search("[A-Z]", text) is not None


@F.pandas_udf(LINKS)
def links(prose: pd.Series) -> pd.Series:
    """Of a column of :func:`prose_of`."""
    return prose.map(lambda rows: [{"line": r["line"], "target": t} for r in rows for t in line_links(r["text"])])


@F.pandas_udf(NAMES)
def names(prose: pd.Series) -> pd.Series:
    return prose.map(lambda rows: [{"line": r["line"], "name": n} for r in rows for n in inline_names(r["text"])])


@F.pandas_udf(StringType())
def blanked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or "`" not in t else without_code(t))
