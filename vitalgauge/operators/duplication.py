"""Copied stretches of tokens.  Input: tokens(path, pos, token, line); positions from 0.

Windows are hashed in the row of their file, shared windows are found by one aggregation of
hashes, and only files that share a window go on.  Files that share windows, directly or
over others, are worked through together, in path order, as the greedy merge asks.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .spread import spread

BLOCKS = "block long, tokens long, path string, start_line long, end_line long, start_pos long"


def words_of(text: Column) -> Column:
    """The word tokens of prose: runs of letters, digits and underscores, ASCII in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def prose_tokens(docs: DataFrame) -> DataFrame:
    """path, tokens, lines: the words of (path, body) and the line of each, from 1."""
    lines = F.split(F.coalesce("body", F.lit("")), "\n")
    marked = F.flatten(F.transform(lines, lambda text, i: F.transform(words_of(text), lambda w: F.struct(w.alias("token"), (i + 1).cast("long").alias("line")))))
    return docs.select("path", marked.alias("w")).select("path", F.col("w.token").alias("tokens"), F.col("w.line").alias("lines"))


def windows(files: DataFrame, size: int) -> DataFrame:
    """path, pos, h of each run of ``size`` tokens; files: path, tokens array<string>.  A file
    shorter than a window has none."""
    rows = files.where(F.size("tokens") >= size).select("path", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t"))
    hashed = F.expr(f"transform(sequence(0, size(t) - {size}), i -> struct(cast(i as bigint) as pos, xxhash64(slice(t, i + 1, {size})) as h))")
    return rows.select("path", F.explode(hashed).alias("w")).select("path", "w.pos", "w.h")


def shared_windows(files: DataFrame, size: int) -> DataFrame:
    """h, times, files, first of the windows that occur at least twice.

    Most windows occur once, so nothing is gained by summing before the shuffle; they are dealt out
    once, by their hashes, and all that is asked of them is found where they are.
    """
    dealt = spread(windows(files, size).select("h", "path"), "h")
    repeated = dealt.withColumn("times", F.count("*").over(Window.partitionBy("h"))).where("times >= 2")
    per = repeated.groupBy("h", "path").agg(F.first("times").alias("times"))
    return per.groupBy("h").agg(F.first("times").alias("times"), F.count("path").alias("files"), F.min("path").alias("first"))


def shared_in_files(files: DataFrame, size: int) -> DataFrame:
    """path, windows, shared: a file's windows, and how many of them occur at least twice in all
    files.  What a file has is known from its length, so only shared windows go back to their files."""
    dealt = spread(windows(files, size).select("h", "path"), "h")
    shared = dealt.withColumn("times", F.count("*").over(Window.partitionBy("h"))).where("times >= 2").groupBy("path").agg(F.count("*").alias("n"))
    all_ = files.where(F.size("tokens") >= size).groupBy("path").agg(F.sum(F.size("tokens") - F.lit(size - 1)).cast("long").alias("windows"))
    one = shared.select(F.col("path").alias("of"), "n")
    return all_.join(one, F.col("path").eqNullSafe(F.col("of")), "left").select("path", "windows", F.coalesce("n", F.lit(0)).alias("shared"))


def greedy(tokens: list[list[str]], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Blocks (length, [(file, start)]) of token lists, in order of their first place.

    A window that an earlier block covers starts none; a block is extended while all its
    places agree.
    """
    ids: dict[str, int] = {}
    seqs = [[ids.setdefault(t, len(ids)) for t in f] for f in tokens]
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for f, s in enumerate(seqs):
        for i in range(len(s) - size + 1):
            places.setdefault(tuple(s[i : i + size]), []).append((f, i))
    done: set[tuple[int, int]] = set()
    out = []
    for f, s in enumerate(seqs):
        for i in range(len(s) - size + 1):
            if (f, i) in done:
                continue
            here = [p for p in places[tuple(s[i : i + size])] if p not in done]
            if len(here) < 2:
                continue
            n = size
            while len({seqs[g][j + n] if j + n < len(seqs[g]) else -1 - g for g, j in here}) == 1 and here[0][1] + n < len(seqs[here[0][0]]):
                n += 1
            for g, j in here:
                done.update((g, c) for c in range(j, j + n - size + 1))
            out.append((n, here))
    return out


def blocks(files: DataFrame, size: int) -> DataFrame:
    """block, tokens, path, start_line, end_line, start_pos: a row for each place of each block.

    files: path, tokens array<string>, lines array<long>.  A component of files that share
    windows is one group; the files in it are what one task holds.
    """
    w = windows(files, size)
    by = w.groupBy("h").agg(F.count("*").alias("n"), F.min("path").alias("hub"))
    edges = w.join(by.where("n >= 2").drop("n"), "h").select("path", "hub").distinct()
    groups = graphs.components(edges.select(F.col("path").alias("a"), F.col("hub").alias("b")))
    rows = files.join(groups.select(F.col("node").alias("path"), F.col("label").alias("component")), "path").select("component", "path", "tokens", "lines")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=pdf["path"].str.split("/")).sort_values("k", kind="stable")
        paths, lines = pdf["path"].tolist(), pdf["lines"].tolist()
        out = []
        for b, (n, at) in enumerate(greedy([list(t) for t in pdf["tokens"]], size)):
            out += [(b, n, paths[f], int(lines[f][i]), int(lines[f][i + n - 1]), i) for f, i in at]
        return pd.DataFrame(out, columns=["block", "tokens", "path", "start_line", "end_line", "start_pos"])

    return rows.groupBy("component").applyInPandas(lambda key, pdf: merge(pdf).assign(component=key[0]), "component string, " + BLOCKS)


def rollup(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, total, duplicated, pct of every scanned file, those without a copy too."""
    per = blocks.groupBy("path").agg(F.sum("tokens").alias("dup"))
    out = files.select("path", F.size("tokens").cast("long").alias("total")).join(per, "path", "left")
    out = out.select("path", "total", F.least("total", F.coalesce("dup", F.lit(0))).alias("duplicated"))
    return out.withColumn("pct", F.when(F.col("total") == 0, 0.0).otherwise(F.lit(100.0) * F.col("duplicated") / F.col("total")))


def tokens_of(lines: Iterable[tuple[int, list[str]]]) -> tuple[list[str], list[int]]:
    pairs = [(t, n) for n, ts in lines for t in ts]
    return [t for t, _ in pairs], [n for _, n in pairs]
