"""Near-duplicates: an inverted join over the coordinates of MinHash signatures.

1. Each text becomes the set of its distinct word shingles.  Texts with the same set are
   one class, which the smallest doc_id stands for; a doc_id on several texts links their
   classes.
2. A class has a signature of ``COORDINATES`` minima.  Two sets of similarity s agree in
   each coordinate with probability s; the match threshold T is the largest for which a
   pair exactly at the wanted similarity stays below T with a probability under ``LOSS``.
3. Coordinates are posted under (coordinate, value).  Values posted once can't match, so a
   class needs T values that others share.  Its rarest values are posted alone: pairs
   with T matches meet in one of the ``COORDINATES - T + 1`` rarest (prefix).
4. Each posting list is led by its most shared class; the lists of one leader are merged
   into one star, so lists led by the same class are gone through once.  Each member's
   collisions with its leader are counted, and those with T or more are compared on their
   full sets.  What is linked there is one component already.
5. Stars all of whose members are one component are done.  In the others pairs of different
   components are left, none of them between two members that the leader's component has.
   Members are dealt into blocks, the collisions of each two blocks are counted by merging
   their coordinates (:func:`collisions`), and members without a candidate go.
6. The full sets of the rest are compared block by block, the blocks by bytes of text;
   a pair that is connected by then is passed over, so a spanning forest is returned.
7. Components of all links.

Defined cases: a text that is null, empty or without words has an empty set and links with
nothing; fewer words than a shingle are one shingle; rows with the same doc_id are one
document; a null doc_id links with nothing; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, kept, parallelism, utf8
from .graph import components
from .shingles import set_digests, shingle_sets, signatures
from .tokens import pairs

COORDINATES, LOSS = 32, 1e-8
#: Members of a block whose signatures meet, and bytes of text of a block whose sets meet.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 1 << 20
#: Members of one leader that one task compares with it.
LED = 256
RUN_BYTES = 1 << 20


def match_threshold(similarity: float, coordinates: int = COORDINATES, loss: float = LOSS) -> int:
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > loss:
            break
        t += 1
    return max(1, t)


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return pairs(df, key, text).withColumn("t", F.xxhash64("text"))


def shingle_classes(df: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, d1, d2 (128 bits of the set; null: empty),
    n_bytes of the text, signature array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in cut(at, RUN_BYTES):
                sets, n = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                real = n > 0
                row = np.cumsum(real) - 1
                d = [pa.array(x.view(np.int64)[np.maximum(row, 0)] if len(x) else np.zeros(j - i, np.int64), mask=~real) for x in set_digests(sets, n)]
                sig = signatures(sets, n, COORDINATES).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real) * COORDINATES]), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n), *d, pa.array(np.diff(at[i : j + 1])), lists], ["doc_id", "t", "n_shingles", "d1", "d2", "n_bytes", "signature"])

    return hashed(df, key, text).mapInArrow(run, "doc_id long, t long, n_shingles long, d1 long, d2 long, n_bytes long, signature array<int>")


def stars(classes: DataFrame, t: int, s: Scratch) -> DataFrame:
    """leader, member: members of the posting lists led by a class, without itself."""
    posted = classes.select("cid", F.posexplode("signature").alias("c", "v"))
    posted = posted.select("cid", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v").cast("long")).alias("k"))
    shared = posted.groupBy("k").agg(F.count("*").alias("df")).where("df > 1")
    mine = posted.join(shared, "k").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ks"), F.sum("df").alias("weight"))
    mine = mine.where(F.size("ks") >= t).select("cid", "weight", F.slice("ks", F.lit(1), F.size("ks") - F.lit(t - 1)).alias("ks"))
    mine = s.kept(mine.select("cid", "weight", F.explode("ks.k").alias("k")), "prefix")
    leaders = mine.groupBy("k").agg(F.max(F.struct("weight", -F.col("cid"))).alias("top"), F.count("*").alias("n")).where("n > 1").select("k", (-F.col("top.col2")).alias("leader"))
    out = s.kept(mine.join(leaders, "k").where("cid <> leader").select("leader", F.col("cid").alias("member")).distinct(), "stars")
    s.drop(mine)
    return out


def matches(a: str, b: str) -> Column:
    """How many coordinates of two signature columns agree."""
    return F.expr(" + ".join(f"if({a}[{c}] = {b}[{c}], 1, 0)" for c in range(COORDINATES)))


def led(df: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int, t: int, key: str, text: str, s: Scratch) -> DataFrame:
    """a, b: links between a leader and members of its star, on the full sets of their texts.

    A leader of many members is repeated for each ``LED`` of them, so it is compared in many tasks.
    """
    near = members.join(classes.select(F.col("cid").alias("member"), F.col("signature").alias("x"), F.col("n_shingles").alias("n")), "member")
    near = near.join(classes.select(F.col("cid").alias("leader"), F.col("signature").alias("y"), F.col("n_shingles").alias("m")), "leader")
    near = near.where(F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)") & (matches("x", "y") >= t))
    near = s.kept(near.select("leader", "member"), "near")
    texts = texts_of(df, classes, near.select(F.explode(F.array("leader", "member")).alias("cid")), key, text)
    sizes = near.groupBy("leader").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts"))
    dealt = near.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.col("member").alias("cid"), F.lit(1).alias("led"))
    own = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("cid"), F.lit(0).alias("led"))
    rows = own.union(dealt).join(texts, "cid")
    rows = rows.repartition(parallelism(df), "leader", "part").sortWithinPartitions("leader", "part", "led").select("text", "cid", "leader", "part", "led")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for b in batches:
            member, leader, led = (b.column(k).to_pylist() for k in (1, 2, 4))
            out: list[tuple[int, int]] = []
            for k, own in sets_of(b, width):
                if not led[k]:
                    head = own
                elif alike(head, own, percent):
                    out.append((leader[k], member[k]))
            yield edges(out)

    return rows.mapInArrow(run, "a long, b long")


def texts_of(df: DataFrame, classes: DataFrame, cids: DataFrame, key: str, text: str) -> DataFrame:
    """cid, text: one text of each of these classes, which its smallest doc_id has."""
    wanted = classes.select("cid", F.col("rep").alias("doc_id"), "t").join(cids.distinct(), "cid")
    return hashed(df, key, text).join(wanted, ["doc_id", "t"]).groupBy("cid").agg(F.first("text").alias("text"))


def sets_of(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of the rows (text, ...), which have a shingle each."""
    data, at = utf8(b.column(0))
    for i, j in cut(at, RUN_BYTES):
        sets, n = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
        yield from zip(range(i, j), np.split(sets, np.cumsum(n)[:-1]), strict=True)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def collisions(a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) of two blocks of signatures with ``t`` equal coordinates.

    The coordinates' posting lists are merged in ascending order of their collisions.  A
    pair that none of the first ``coordinates - t + 1`` lists has can't reach ``t`` (prefix);
    for the others the longer lists are only looked up, and a pair is left as soon as
    too few of them remain (skip).
    """
    width = a.shape[1]
    hits = np.array([_collide(a[:, c], b[:, c]) for c in range(width)])
    order = np.argsort(hits, kind="stable")
    n = np.zeros((len(a), len(b)), np.int8)
    for c in order[: width - t + 1]:
        n += a[:, c, None] == b[None, :, c]
    x, y = np.nonzero(n)
    n = n[x, y].astype(np.int16)
    for left, c in zip(range(t - 2, -1, -1), order[width - t + 1 :], strict=True):
        n += a[x, c] == b[y, c]
        go = n + left >= t
        x, y, n = x[go], y[go], n[go]
    return x, y


def _collide(x: np.ndarray, y: np.ndarray) -> int:
    values, n = np.unique(x, return_counts=True)
    others, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(n[i].astype(np.int64) @ m[j])


def mixed(members: DataFrame, labels: DataFrame, s: Scratch) -> DataFrame:
    """leader, member, label, apart: the members, leaders among them, of the stars with members of
    several components; apart: not of the leader's component."""
    every = members.union(members.select("leader", F.col("leader").alias("member")).distinct())
    every = every.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    stars = every.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("leader") == F.col("member"), F.col("label"))).alias("own")).where("lo <> hi")
    return s.kept(every.join(stars.select("leader", "own"), "leader").select("leader", "member", "label", (F.col("label") != F.col("own")).alias("apart")), "mixed")


def dealt(members: DataFrame, blocks: DataFrame, bins: str) -> DataFrame:
    """leader, i, j, side and the members' columns: each pair of a star's members of which one is
    apart meets in one block pair; blocks: leader, ``bins``.  A member that isn't apart goes
    to the side of one apart alone, so it is in none of its own kind's pairs."""
    rows = members.join(blocks, "leader").withColumn("mine", F.pmod(F.xxhash64("member"), F.col(bins)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(bins) - 1)))
    # (i, j, kind): kind 0 has the apart of both blocks, kind 1 the apart of i with the rest of j
    inner = rows.where("apart").select("leader", F.lit(0).alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"), *members.columns[1:])
    outer = rows.select("leader", F.lit(1).alias("kind"), F.when(F.col("apart"), F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(F.col("apart"), F.col("other")).otherwise(F.col("mine")).alias("j"), (~F.col("apart")).alias("side"), *members.columns[1:])
    return inner.union(outer)


GROUP = ["leader", "kind", "i", "j"]


def candidates(members: DataFrame, classes: DataFrame, percent: int, t: int) -> DataFrame:
    """leader, member: those with a candidate, a member of another component of the star with ``t``
    collisions and a set of fitting size."""
    rows = members.join(classes.select(F.col("cid").alias("member"), "n_shingles", "signature"), "member").select("leader", "member", "label", "apart", "n_shingles", "signature")
    blocks = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("bins"))
    rows = dealt(rows, blocks, "bins").repartition(parallelism(members), *GROUP).sortWithinPartitions(*GROUP)
    rows = rows.select(*GROUP, "side", "member", "label", "n_shingles", "signature")

    def find(held: dict[bool, list[tuple]], across: bool) -> list[int]:
        if across and not (held[False] and held[True]):
            return []
        left, right = (held[False], held[True]) if across else (held[False] + held[True],) * 2
        if not left:
            return []
        (m1, l1, n1, s1), (m2, l2, n2, s2) = (tuple(np.array(c) for c in zip(*h, strict=True)) for h in (left, right))
        x, y = collisions(s1, s2, t)
        ok = (l1[x] != l2[y]) & (100 * np.minimum(n1[x], n2[y]) >= percent * np.maximum(n1[x], n2[y]))
        return np.unique(np.concatenate([m1[x[ok]], m2[y[ok]]])).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def flush() -> pa.RecordBatch:
            got = find(held, now[1] == 1 or now[2] != now[3]) if now else []
            held[False].clear()
            held[True].clear()
            return pa.RecordBatch.from_arrays([pa.array([now[0] if now else 0] * len(got), pa.int64()), pa.array(got, pa.int64())], ["leader", "member"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(8)]
            sig = b.column(8).flatten().to_numpy().reshape(b.num_rows, -1)
            for k, group in enumerate(zip(*cols[:4], strict=True)):
                if group != now:
                    yield flush()
                    now = group
                held[cols[4][k]].append((cols[5][k], cols[6][k], cols[7][k], sig[k]))
        yield flush()

    return rows.mapInArrow(run, "leader long, member long").distinct()


class _Forest:
    def __init__(self, labels: list[int]):
        self.up: dict[int, int] = {x: x for x in labels}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(left: list[tuple], right: list[tuple] | None, t: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over labels, of the pairs of two blocks (or of one) that are alike.

    Members are (label, signature, shingles).  The pairs with most collisions come
    first, and a pair whose components are connected by then is passed over.
    """
    both = left + (right or [])
    if not left or (right is not None and not right):
        return []
    forest = _Forest([m[0] for m in both])
    a, b = np.stack([m[1] for m in left]), np.stack([m[1] for m in (left if right is None else right)])
    x, y = collisions(a, b, t)
    if right is None:
        x, y = x[x < y], y[x < y]
    order = np.argsort(-(a[x] == b[y]).sum(1), kind="stable") if len(x) else []
    out = []
    for k in order:
        p, q = left[x[k]], (left if right is None else right)[y[k]]
        if forest.root(p[0]) != forest.root(q[0]) and alike(p[2], q[2], percent):
            forest.join(p[0], q[0])
            out.append((p[0], q[0]))
    return out


def confirm(df: DataFrame, members: DataFrame, classes: DataFrame, width: int, percent: int, t: int, key: str, text: str) -> DataFrame:
    """a, b: the labels of components that members (leader, member, label, apart) link."""
    texts = texts_of(df, classes, members.select(F.col("member").alias("cid")), key, text)
    weigh = classes.select(F.col("cid").alias("member"), "n_bytes")
    blocks = members.join(weigh, "member").groupBy("leader").agg(F.ceil(F.sum("n_bytes") / BLOCK_BYTES).cast("int").alias("bins"))
    rows = dealt(members, blocks, "bins").join(texts.withColumnRenamed("cid", "member"), "member")
    rows = rows.repartition(parallelism(df), *GROUP).sortWithinPartitions(*GROUP).select("text", "label", "side", *GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def flush() -> list[tuple[int, int]]:
            across = now is not None and (now[1] == 1 or now[2] != now[3])
            found = links(held[False], held[True], t, percent) if across else links(held[False] + held[True], None, t, percent)
            held[False].clear()
            held[True].clear()
            return found

        for b in batches:
            label, side = b.column(1).to_pylist(), b.column(2).to_pylist()
            group = list(zip(*(b.column(k).to_pylist() for k in range(3, 7)), strict=True))
            out: list[tuple[int, int]] = []
            for k, own in sets_of(b, width):
                if group[k] != now:
                    out += flush()
                    now = group[k]
                held[side[k]].append((label[k], signatures(own, np.array([len(own)]), COORDINATES)[0], own))
            yield edges(out)
        yield edges(flush())

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    t = match_threshold(percent / 100)
    with Scratch(df.sparkSession, "near") as s:
        sets = s.kept(shingle_classes(df, width, key, text), "sets")
        real = sets.where("d1 is not null and doc_id is not null")
        classes = real.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("top"), F.first("signature").alias("signature"), F.max("n_shingles").alias("n_shingles"), F.max("n_bytes").alias("n_bytes"))
        classes = s.kept(classes.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", F.col("top.doc_id").alias("rep"), F.col("top.t").alias("t"), "signature", "n_shingles", "n_bytes"), "classes")
        members = stars(classes, t, s)
        labels = components(led(df, classes, members, width, percent, t, key, text, s).union(same_document(real, classes)), s)
        rest = mixed(members, labels, s)
        rest = s.kept(rest.join(candidates(rest, classes, percent, t), ["leader", "member"]), "candidates")
        if not rest.isEmpty():
            more = components(confirm(df, rest, classes, width, percent, t, key, text), s)  # between labels
            labels = labels.union(more.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti"))
            labels = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
        named = classes.join(labels, classes["cid"] == labels["node"], "left").select("d1", "d2", "rep", F.coalesce("label", "cid").alias("label"))
        smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = named.join(smallest, "label").select("d1", "d2", "component_id")
        out = sets.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        return kept(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")


def same_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the classes of a doc_id whose rows have several sets."""
    several = sets.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id")
    mine = sets.join(several, "doc_id").select("doc_id", "d1", "d2").distinct().join(classes.select("d1", "d2", "cid"), ["d1", "d2"])
    return mine.join(mine.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))
