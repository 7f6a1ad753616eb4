"""Toxicity with a factorization machine over hashed terms.

A text is the set of its terms, hashed to ``BITS`` bits.  The score is the logistic
function of  w0 + sum of w_i + half of (|sum of v_i|^2 - sum of |v_i|^2),  so two terms
that mean little alone may mean much together.  It is learned with Adagrad from at most
``SAMPLE`` labelled rows of each class outside the held-out fifth.  A term's weight and factors
are scaled by what the rows can tell of it (:func:`evidence`): near 1 if its rows differ between
the classes, or if it is frequent, so that its pairs can be learned though it tells nothing alone,
and near 0 for a rare word like any other, so that long texts don't drown in their noise.

Defined cases: a null text is an empty text, whose score is that of w0; a null label is
no label; a doc_id that is labelled twice is learned twice, one on several rows with its
largest text; without labels of both kinds
every score is the share of the positive ones (0 without any); an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8
from .samples import held_out, sample
from .shingles import distinct_terms
from .tokens import pairs

BITS, FACTORS, SAMPLE, RUN_BYTES = 20, 4, 10_000, 1 << 20
#: The likelihood ratio, and the share of all rows, at which a term counts half.
RATIO, FREQUENT = 15.0, 0.2


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = np.full(len(n), self.w0)
        some = n > 0
        if some.any():
            at = (np.cumsum(n) - n)[some]
            v = self.v[terms]
            s = np.add.reduceat(v, at)
            z[some] += np.add.reduceat(self.w[terms], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(terms: np.ndarray, n: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """For each term, 0 to 1: 1 - (1 - g)(1 - h), g by how its rows differ between the classes, h by
    the share of rows that have it; fourth powers, without a threshold."""
    mark, pos, both = np.repeat(y == 1, n), np.zeros(size), np.zeros(size)
    for s in range(0, len(terms), 1 << 20):  # a count's own copies stay small
        part = terms[s : s + (1 << 20)]
        pos += np.bincount(part[mark[s : s + (1 << 20)]], minlength=size)
        both += np.bincount(part, minlength=size)
    share, ratio = y.mean(), np.zeros(size)
    for part, total, p in ((pos, both, share), (both - pos, both, 1 - share), (y.sum() - pos, len(y) - both, share), ((len(y) - y.sum()) - (both - pos), len(y) - both, 1 - share)):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio += np.where(part > 0, 2 * part * np.log(part / (total * p)), 0)
    g, h = (x**4 / (x**4 + half**4) for x, half in ((np.maximum(ratio, 0), RATIO), (both / len(y), FREQUENT)))
    return (1 - (1 - g) * (1 - h)).astype(np.float32)


def learn(terms: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 20, steps: int = 1000, batch: int = 64, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> Machine:
    """At least ``epochs`` times over the rows and ``steps`` batches."""
    rng = np.random.default_rng(seed)
    out = Machine(0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    share = float(np.mean(y)) if len(y) else 0.0
    if not 0 < share < 1:
        out.w0 = 30.0 if share else -30.0
        return out
    seen = np.zeros(1 << BITS, bool)
    seen[terms] = True
    names, number = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
    own = number[terms]
    scale = evidence(own, n, y, len(names))
    use = scale[own] > 1e-3  # a smaller scale moves no score
    at = np.append(np.int32(0), np.cumsum(use, dtype=np.int32))[np.append(0, np.cumsum(n))].astype(np.int64)
    own = own[use]
    del use, number, seen
    w, v = np.zeros(len(names), np.float32), rng.normal(0, 0.02, (len(names), FACTORS)).astype(np.float32)
    w0, gw, gv, g0 = float(np.log(share / (1 - share))), np.full_like(w, 1e-2), np.full_like(v, 1e-2), 1.0
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            size = at[pick + 1] - at[pick]
            t = own[np.arange(int(size.sum())) + np.repeat(at[pick] - (np.cumsum(size) - size), size)]
            if not len(t):
                continue
            doc, x = np.repeat(np.arange(len(pick)), size), scale[t]
            some = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[some]
            vt = v[t] * x[:, None]
            total = np.zeros((len(pick), FACTORS), np.float32)
            total[some] = np.add.reduceat(vt, first)
            z = np.full(len(pick), w0)
            z[some] += np.add.reduceat(w[t] * x, first)
            z[some] += 0.5 * ((total[some] ** 2).sum(1) - np.add.reduceat((vt * vt).sum(1), first))
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            ids, inv = np.unique(t, return_inverse=True)
            part = err[doc] * x
            dw = np.bincount(inv, part, len(ids)).astype(np.float32) + decay * w[ids]
            part = part[:, None] * (total[doc] - vt)
            dv = np.stack([np.bincount(inv, part[:, f], len(ids)) for f in range(FACTORS)], 1).astype(np.float32) + decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= rate * dv / np.sqrt(gv[ids])
            d0 = float(err.sum())
            g0 += d0 * d0
            w0 -= rate * d0 / g0**0.5
    real = scale > 1e-3
    out.w0, out.w[names[real]], out.v[names[real]] = w0, (w * scale)[real], (v * scale[:, None])[real]
    return out


def features(df: DataFrame) -> DataFrame:
    """y, terms of (doc_id, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in cut(at, RUN_BYTES):
                terms, n = distinct_terms(data[at[i] : at[j]], at[i : j + 1] - at[i], BITS)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(terms))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), lists], ["doc_id", "y", "terms"])

    return df.mapInArrow(run, "doc_id long, y int, terms array<int>")


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Machine:
    """At most ``most`` labelled rows of each class, whose ids are what is broadcast and whose
    hashed terms are what the driver gets."""
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    counts = marks.where(~held_out()).agg(F.count_if(F.expr("y = 1")).alias("pos"), F.count_if(F.expr("y = 0")).alias("neg")).first()
    picked = sample(marks.where("y = 1"), most).union(sample(marks.where("y = 0"), most))
    ids = picked.select("doc_id").distinct()
    rows = pairs(df, key, text).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    got = features(rows).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not got.num_rows:
        return learn(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    lists = got["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    y = got["y"].to_numpy()
    terms, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    del got, lists
    machine = learn(terms, n, y)
    all_pos, all_neg, pos, neg = counts["pos"] or 0, counts["neg"] or 0, int(y.sum()), int((y == 0).sum())
    if min(all_pos, all_neg, pos, neg) > 0:  # the classes' shares among all labels, not in the sample
        machine.w0 += float(np.log(all_pos / all_neg) - np.log(pos / neg))
    return machine


def score(df: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, for each row and its whole text."""
    model = df.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # 2**BITS rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in cut(at, RUN_BYTES):
                s = m.score(*distinct_terms(data[at[i] : at[j]], at[i : j + 1] - at[i], BITS))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s)], ["doc_id", "score"])

    return pairs(df, key, text).mapInArrow(run, "doc_id long, score double")


def judge(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(df, train(df, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores under 0.5, with all their columns."""
    model = df.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for b in batches:
            data, at = utf8(b.column(place))
            s = [m.score(*distinct_terms(data[at[i] : at[j]], at[i : j + 1] - at[i], BITS)) for i, j in cut(at, RUN_BYTES)]
            if s:
                yield b.filter(pa.array(np.concatenate(s) < 0.5))

    return df.mapInArrow(run, df.schema)
