"""Document fingerprints as invertible Bloom lookup tables, with SQL functions alone.

A text is the set of 64-bit digests of its paragraphs: its lines, and in a line its sentences, in
any script (``SENTENCES``).  A table is some groups of 3 x ``WIDTH`` cells; a digest is in one group
and there in one cell of each of the three rows.  A cell has the number of its digests, their
xor and the xor of their check sums.  Two tables subtract cell by cell, which leaves the digests
that only one has, and peeling takes out the digest of a cell that has just one until none
is left (:func:`peel`).

Digests are exploded to rows and cells are sums and xors of a hash aggregate, so building a table is
compiled code whose time grows with the digests; only what a subtraction leaves is peeled.
The fingerprint is a table of ``GROUPS`` groups, whatever the text.  When the difference of two is more
than it can give back, a larger one is made with a group for each ``LOAD`` digests; of
that the groups that fail are dealt over ``FINER`` groups each, by other bits, and so on until none fails.

The digests of a row are written in buckets by (doc_id, hash of the text), so the aggregates of
all levels need no shuffle, and a doc_id on many rows is in many buckets.

Defined cases: a null text is an empty text, which has no digests; two empty texts are
alike (1.0); a null doc_id is the smallest; rows with the same doc_id have the same next
document, and as a next document such a doc_id stands with its largest text; equal rows are
worked through once and each returned; one document alone is its own next; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept, parallelism

WIDTH, GROUPS, LOAD, FINER, ROUNDS = 4, 2, 2, 4, 6
_NONE = -(1 << 63)
SALTS = 32
KEY = ["k", "h"]
#: Where a text is cut: at line ends, after each mark that ends a sentence (and a closing quote or
#: bracket) before blanks, and after the marks of scripts that are written without blanks.
#: Three expressions that cut alike: of ASCII alone, of any script with blanks, and of all.
_MARKS, _CLOSERS = r"\u2026\u0589\u061F\u06D4\u0964\u0965\u104B\u1362\u17D4", r"\u00BB\u2019\u201D"
_SOLID = "\u3002\uff01\uff1f\uff61"


def _cuts(blank: str, marks: str, closers: str) -> str:
    return rf"\n|{blank}(?<=[.!?{marks}][\x22\x27)\]{closers}]?{blank}){blank}*"


PLAIN, BLANKS = _cuts(r"[ \t]", "", ""), _cuts(r"[ \t\u00A0\u3000]", _MARKS, _CLOSERS)
SENTENCES = BLANKS + rf"|(?<=[{_SOLID}])(?![{_SOLID}\u300D\u300F\u2019\u201D\uFF09])"


def digests(text: str) -> str:
    """The distinct paragraph digests of a text expression."""
    split = ["split({}, '{}')".format(text, p.replace("\\", "\\\\")) for p in (PLAIN, SENTENCES, BLANKS)]
    solid = " OR ".join(f"contains({text}, '{c}')" for c in _SOLID)
    parts = f"CASE WHEN octet_length({text}) = char_length({text}) THEN {split[0]} WHEN {solid} THEN {split[1]} ELSE {split[2]} END"
    return f"array_distinct(transform(filter({parts}, p -> p <> ''), p -> xxhash64(p)))"


def let(name: str, value: str, body: str) -> str:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def place(x: str, row: int, level: int) -> str:
    """The cell of a digest in a row of its group's table, of all 3 * WIDTH cells."""
    return f"{row * WIDTH} + cast(shiftrightunsigned(xxhash64({x}, {level}), {4 * row}) & {WIDTH - 1} AS INT)"


def group(x: str, groups: str, level: int) -> str:
    """The group of a digest: at level 0 of the fingerprint's, at level 1 of as many as the sets may
    need; at a later one its group before is dealt over ``FINER``."""
    part = f"shiftrightunsigned(xxhash64({x}, {level}), 16)"
    if level == 0:
        return f"pmod({part}, {GROUPS}L)"
    return f"pmod({part}, {groups})" if level == 1 else f"({group(x, groups, level - 1)}) * {FINER}L + pmod({part}, {FINER}L)"


def tables(items: DataFrame, keys: list[str], groups: str, level: int) -> DataFrame:
    """keys, g, cells array<struct<n,k,c>>: of items (keys, s, x), digests with signs, and the columns
    that ``groups`` is made of."""
    items = items.select("*", F.expr(group("x", groups, level)).alias("g"), F.expr("xxhash64(x)").alias("c"), *(F.expr(place("x", r, level)).alias(f"at{r}") for r in range(3)))
    cells = []
    for j in range(3 * WIDTH):
        here = f"at{j // WIDTH} = {j}"
        cells += [F.expr(f"sum(if({here}, s, 0))").alias(f"n{j}"), F.expr(f"bit_xor(if({here}, x, 0L))").alias(f"k{j}"), F.expr(f"bit_xor(if({here}, c, 0L))").alias(f"c{j}")]
    cells = items.groupBy(*keys, "g").agg(*cells)
    left = " OR ".join(f"n{j} <> 0 OR k{j} <> 0 OR c{j} <> 0" for j in range(WIDTH))  # each digest is in the first row
    every = ", ".join(f"named_struct('n', cast(n{j} AS INT), 'k', k{j}, 'c', c{j})" for j in range(3 * WIDTH))
    return cells.where(left).select(*keys, "g", F.expr(f"array({every})").alias("cells"))


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> named_struct('n', u.n - v.n, 'k', u.k ^ v.k, 'c', u.c ^ v.c))"


def peel(cells: str, level: int) -> str:
    """array<struct<s,x>>: the digests that only the one (s = 1) or the other side has (-1); null
    where a cell is left.

    All is found in one look when what the pure cells hold adds up to the first row.
    """
    pure = "array_distinct(transform(filter({c}, c -> abs(c.n) = 1 AND c.c = xxhash64(c.k)), c -> named_struct('s', c.n, 'x', c.k)))"
    first = f"slice({cells}, 1, {WIDTH})"
    total = lambda array, of: f"aggregate({array}, 0L, (a, i) -> a ^ {of})"
    whole = f"{total('once', 'i.x')} = {total(first, 'i.k')} AND {total('once', 'xxhash64(i.x)')} = {total(first, 'i.c')}"
    inside = " OR ".join(f"j = {place('i.x', r, level)}" for r in range(3))
    less = f"transform(st.t, (c, j) -> aggregate(filter(found, i -> {inside}), c, (a, i) -> named_struct('n', a.n - i.s, 'k', a.k ^ i.x, 'c', a.c ^ xxhash64(i.x))))"
    step = let("found", pure.format(c="st.t"), f"if(size(found) = 0, st, named_struct('t', {less}, 'out', concat(st.out, found)))")
    slow = let("e", f"aggregate(sequence(1, {ROUNDS}), named_struct('t', {cells}, 'out', slice(once, 1, 0)), (st, r) -> {step})", "if(exists(e.t, c -> c.n <> 0 OR c.k <> 0 OR c.c <> 0), NULL, e.out)")
    return let("once", pure.format(c=cells), f"if({whole}, once, {slow})")


def outcome(parts: DataFrame, keys: list[str], level: int) -> DataFrame:
    """keys, only_a, only_b (how many digests), failed array<long>: of the subtracted tables (keys, g, cells)."""
    peeled = parts.select(*keys, "g", F.expr(peel("cells", level)).alias("found"))
    count = lambda sign: F.sum(F.coalesce(F.expr(f"size(filter(found, i -> i.s = {sign}))"), F.lit(0)))
    return peeled.groupBy(*keys).agg(count(1).alias("only_a"), count(-1).alias("only_b"), F.collect_list(F.when(F.col("found").isNull(), F.col("g"))).alias("failed"))


def differences(sets: DataFrame, pairs: list[tuple[str, str]], s: Scratch) -> DataFrame:
    """k, h, pair, only_a, only_b: how many digests only the one and only the other of two columns
    of digests has, where they differ; ``pairs`` are names of columns of (k, h, ...)."""
    keys = [*KEY, "pair"]
    names = sorted({c for p in pairs for c in p})
    items = sets.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("set"), F.col(c).alias("d")) for i, c in enumerate(names)))).alias("u")).select(*KEY, F.col("u.set").alias("set"), F.lit(1).alias("s"), F.explode("u.d").alias("x"))
    prints = tables(items, [*KEY, "set"], "", 0).groupBy(*KEY, "g").agg(F.collect_list(F.struct("set", "cells")).alias("t"))
    none = "array_repeat(named_struct('n', 0, 'k', 0L, 'c', 0L), {})".format(3 * WIDTH)
    side = lambda c: f"coalesce(get(filter(t, u -> u.set = {names.index(c)}), 0).cells, {none})"
    minus = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), F.expr(subtract(side(a), side(b))).alias("cells")) for i, (a, b) in enumerate(pairs)))).alias("u")
    parts = prints.select(*KEY, "g", minus).select(*KEY, "g", "u.pair", "u.cells").where("exists(cells, c -> c.n <> 0 OR c.k <> 0 OR c.c <> 0)")
    now = s.kept(outcome(parts, keys, 0), "peeled-0")
    done, level = [now.where("size(failed) = 0").select(*keys, "only_a", "only_b")], 0
    while not (open_ := now.where("size(failed) > 0")).isEmpty():
        level += 1
        rows = sets.join(open_.select(*keys, "failed"), KEY)
        way = [F.struct(F.lit(i).alias("p"), F.lit(sign).alias("s"), F.col(c).alias("d"), F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / LOAD)).cast("long").alias("groups")) for i, (a, b) in enumerate(pairs) for sign, c in ((1, a), (-1, b))]
        rows = rows.select(*keys, "failed", F.explode(F.array(*way)).alias("u")).where("u.p = pair").select(*keys, "failed", F.col("u.s").alias("s"), F.col("u.groups").alias("groups"), F.explode("u.d").alias("x"))
        if level > 1:  # what was peeled in other groups isn't looked at again
            rows = rows.where(F.expr(f"array_contains(failed, {group('x', 'groups', level - 1)})"))
        now = s.kept(outcome(tables(rows.drop("failed"), keys, "groups", level), keys, level), f"peeled-{level}")
        done.append(now.select(*keys, "only_a", "only_b"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.groupBy(*keys).agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def hexed(table: str, n: str) -> Column:
    cell = "concat(lpad(hex(c.n), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0'))"
    return F.lower(F.expr(f"concat(lpad(hex({n}), 8, '0'), array_join(transform({table}, c -> {cell}), ''))"))


def neighbours(df: DataFrame, s: Scratch) -> DataFrame:
    """k, user, need, times: for each key of (k, need), the key just above it (of the smallest:
    itself at the top's place, so the largest is used by the smallest), that key's ``need``,
    and the rows that the key has.

    Keys are dealt over ranges whose bounds are quantiles of all of them; only the bounds and
    the ends of the ranges, one a range, come to the driver.
    """
    spark = df.sparkSession
    ids = s.kept(df.groupBy("k").agg(F.max("need").alias("need"), F.count("*").alias("times")), "ids")
    parts = parallelism(df)
    bounds = sorted({int(x) for x in (ids.select(F.expr(f"percentile_approx(k, array({', '.join(f'{i / parts!r}D' for i in range(1, parts))}), 10000)").alias("q")).first()["q"] or [])}) if parts > 1 else []
    bucket = F.expr(f"size(filter(array({', '.join(_long(b) for b in bounds)}), b -> b <= k))") if bounds else F.lit(0)
    ids = ids.withColumn("bucket", bucket)
    ends = {r["bucket"]: r for r in ids.groupBy("bucket").agg(F.max("k").alias("hi"), F.min(F.struct("k", "need")).alias("lo")).collect()}
    order = sorted(ends)
    if not order:
        return spark.range(0).selectExpr("id AS k", "id AS user", "id AS need", "id AS times")
    above = {b: ends[order[(i + 1) % len(order)]]["lo"] for i, b in enumerate(order)}
    user = "array(" + ", ".join(_long(above[b]["k"]) if b in above else "NULL" for b in range(len(bounds) + 1)) + ")"
    need = "array(" + ", ".join(_long(above[b]["need"]) if b in above else "NULL" for b in range(len(bounds) + 1)) + ")"
    w = Window.partitionBy("bucket").orderBy("k")
    return ids.select("k", "times", F.coalesce(F.lead("k").over(w), F.expr(f"element_at({user}, bucket + 1)")).alias("user"), F.coalesce(F.lead("need").over(w), F.expr(f"element_at({need}, bucket + 1)")).alias("need"))


def _long(x: int) -> str:
    return f"{x}L" if x > _NONE else f"cast('{x}' AS BIGINT)"


def _long(x: int) -> str:
    return f"{x}L" if x > _NONE else f"cast('{x}' AS BIGINT)"


def next_of(rows: DataFrame, nav: DataFrame) -> DataFrame:
    """k, head, next_d: what each document needs of its next one, the first characters and the
    digests.  Keys on several rows stand with their largest text, taken in ``SALTS`` parts."""
    take = [F.col("user").alias("k"), F.expr("left(text, cast(need AS INT))").alias("head"), F.expr(digests("text")).alias("next_d")]
    out = rows.join(nav.where("times = 1"), "k").select(take)
    several = nav.where("times > 1")
    if several.isEmpty():
        return out
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    top = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, ["k", "salt"]).groupBy("k", "salt", "user", "need").agg(F.max("text").alias("text"))
    return out.union(top.groupBy("k", "user", "need").agg(F.max("text").alias("text")).select(take))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The text is shuffled once, by doc_id, for both joins; the next document sends its needed characters and its
    digests.
    """
    spark, name = df.sparkSession, "digests_" + uuid.uuid4().hex
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NONE)).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    with Scratch(spark, "fingerprints") as s:
        nav = s.kept(neighbours(rows.select("k", F.expr("cast(char_length(text) div 3 AS BIGINT)").alias("need")), s), "neighbours")
        out = rows.join(next_of(rows, nav), "k").withColumns({"h": F.xxhash64("text"), "n": F.char_length("text")})
        out = out.withColumn("edited", F.expr("concat(left(text, n - n div 3), left(head, cast(n div 3 AS INT)))"))
        out = out.select(*KEY, "n", F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("text")).alias("own_d"), F.expr(digests("edited")).alias("edited_d"), "next_d")
        buckets = min(parallelism(df), 10_000)
        out = out.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).format("parquet").option("path", f"{s.path}/digests")
        out.saveAsTable(name)
        try:
            return kept(_judged(spark.table(name), s), "fingerprints", "zstd")  # hex digits, which lz4 leaves as they are
        finally:
            spark.sql(f"DROP TABLE {name}")


def _judged(table: DataFrame, s: Scratch) -> DataFrame:
    """The result, of the written digests.  Equal rows go on as one, with their number."""
    once = ["n", "edited_sha256", "own_d", "edited_d", "next_d"]
    sets = table.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("n"))).where("nth = 1").drop("nth")
    diff = differences(sets, [("own_d", "edited_d"), ("own_d", "next_d")], s).groupBy(*KEY).agg(*(F.sum(F.when(F.col("pair") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in (0, 1) for c in ("only_a", "only_b")))
    items = sets.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("set"), F.col(c).alias("d")) for i, c in enumerate(("own_d", "edited_d"))))).alias("u")).select(*KEY, F.col("u.set").alias("set"), F.lit(1).alias("s"), F.explode("u.d").alias("x"))
    prints = tables(items, [*KEY, "set"], "", 0).groupBy(*KEY).agg(F.collect_list(F.struct("set", "g", "cells")).alias("t"))
    none = "array_repeat(named_struct('n', 0, 'k', 0L, 'c', 0L), {})".format(3 * WIDTH)
    cells = lambda i: "concat(" + ", ".join(f"coalesce(get(filter(t, u -> u.set = {i} AND u.g = {g}), 0).cells, {none})" for g in range(GROUPS)) + ")"
    likeness = lambda i: F.expr(f"if(size(own_d) + coalesce(only_b{i}, 0) = 0, 1D, (size(own_d) - coalesce(only_a{i}, 0)) / cast(size(own_d) + coalesce(only_b{i}, 0) AS DOUBLE))")
    return table.select(*KEY, *once).join(prints, KEY, "left").join(diff, KEY, "left").select(
        F.nullif(F.col("k"), F.lit(_NONE)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        hexed(cells(0), "size(own_d)").alias("fingerprint"),
        hexed(cells(1), "size(edited_d)").alias("edited_fingerprint"),
        likeness(0).alias("near_edited"),
        likeness(1).alias("near_next"),
    )
