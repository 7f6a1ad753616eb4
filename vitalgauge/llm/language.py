"""Language identification with a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes, the last one filled with zeros.  In a
window each byte has an embedding; filters of several widths run over it, their largest
outputs go to a softmax.  A text's logits are the mean of its windows' logits, weighted by
their bytes, so all of it counts.  Learned in numpy outside the held-out fifth: by :func:`train`
from all windows of at most ``SAMPLE`` rows, by :func:`train_whole` from those of all rows.

Beside the languages the network has a class for text of none: it learns it from windows of the
same rows whose bytes are in random order.  A predicted language is always one of the rows';
:func:`keep_known` rejects texts that are likelier of none than nearly all held-out rows are.

For prediction an embedding and a filter's tap are one table by byte, and the taps of two
neighbours one table by byte pair; a filter is then a sum of two or fewer looked-up rows.

Defined cases: a null text, an empty one and one without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; repeated rows are each judged; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, utf8
from .samples import held_out, sample
from .tokens import pairs

WINDOW, EMBEDDING, FILTERS, WIDTHS = 192, 8, 16, (2, 3, 4)
SAMPLE, RUN_BYTES = 3_000, 96 << 10
#: Windows of a group of rows that one task learns from, and by how much groups get more from
#: round to round.
GROUP, FASTER = 40_000, 4
#: Parameters are added up as whole multiples of this, so the order of groups doesn't count.
GRAIN = 2.0**-24
#: Of the windows of a batch this share is put in random order; and the share of held-out rows that
#: the limit for texts of no language may reject.
SCRAMBLED, REJECTED = 0.2, 0.001
#: Bytes under which a text is too short to be told from one of no language.
SHORT = 24
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] = _LOW[97:123]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    names: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    taps: list[np.ndarray]  # each width x EMBEDDING x FILTERS
    bias: np.ndarray  # FILTERS * len(WIDTHS)
    out: np.ndarray  # FILTERS * len(WIDTHS) x (languages and none)
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embedding, *self.taps, self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, rows by byte pair (two taps) and by byte (the odd tap)."""
        t = []
        for k, w in enumerate(self.taps):
            one = [np.ascontiguousarray(self.embedding @ tap, np.float32) for tap in w]
            one[0] = one[0] + self.bias[k * FILTERS : (k + 1) * FILTERS]
            two = [(one[i][:, None, :] + one[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, len(one) - 1, 2)]
            t.append([*two, *([one[-1]] if len(one) % 2 else [])])
        return t


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts, the text of each, and its bytes that count."""
    size = np.diff(at)
    n = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(n)), n)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    real = np.minimum(WINDOW, size[doc] - begin)
    place = (at[:-1][doc] + begin)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < real[:, None]
    out = np.zeros((len(doc), WINDOW), np.uint8)
    out[inside] = _LOW[data[place[inside]]]
    return out, doc, real


def pooled(x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    pair = x[:, :-1].astype(np.uint16) << 8
    pair |= x[:, 1:]
    out = np.empty((len(x), FILTERS * len(tables)), np.float32)
    for k, (parts, width) in enumerate(zip(tables, WIDTHS, strict=True)):
        n = WINDOW - width + 1
        total = None
        for p, t in enumerate(parts):
            index = pair[:, 2 * p : 2 * p + n] if len(t) == 65536 else x[:, 2 * p : 2 * p + n]
            rows = t.take(index, axis=0)
            total = rows if total is None else np.add(total, rows, out=total)
        out[:, k * FILTERS : (k + 1) * FILTERS] = total.max(axis=1)
    return np.maximum(out, 0, out=out)


def scrambled(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each window's bytes in random order, its zeros at the end."""
    order = np.argsort(np.where(x > 0, rng.random(x.shape), 2.0), axis=1)
    return np.take_along_axis(x, order, 1)


def untrained(names: list[str], rng: np.random.Generator) -> Network:
    c, width = len(names) + 1, FILTERS * len(WIDTHS)
    return Network(names, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(width, np.float32), rng.normal(0, 0.1, (width, c)).astype(np.float32), np.zeros(c, np.float32))


def learn(x: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 2, steps: int = 600, batch: int = 64, rate: float = 0.003, seed: int = 11, start: Network | None = None) -> Network:
    """Adam on the cross entropy of single windows, at least ``epochs`` times over them and ``steps``
    batches; from a copy of ``start`` if given."""
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    net = copy.deepcopy(start) if start else untrained(names, rng)
    params = net.params()
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-steps * batch // max(1, len(y))))):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            xb, yb, b = x[pick], y[pick].copy(), len(pick)
            mixed = int(b * SCRAMBLED)
            xb[:mixed], yb[:mixed] = scrambled(xb[:mixed], rng), len(names)
            e = net.embedding[xb]
            hidden, arg = np.empty((b, width), np.float32), []
            for k, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                z = sum(e[:, j : j + n] @ net.taps[k][j] for j in range(w))
                top = z.argmax(1)
                arg.append(top)
                hidden[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(z, top[:, None], 1)[:, 0]
            hidden += net.bias
            on = hidden > 0
            act = np.where(on, hidden, 0)
            logits = act @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), yb] -= 1
            p /= b
            dh = np.where(on, p @ net.out.T, 0).astype(np.float32)
            de = np.zeros((256, EMBEDDING), np.float32)
            dtaps = []
            for k, w in enumerate(WIDTHS):
                d, g = dh[:, k * FILTERS : (k + 1) * FILTERS], np.empty_like(net.taps[k])
                for j in range(w):
                    at = arg[k] + j  # each filter's place in each window
                    seen = xb[np.arange(b)[:, None], at]
                    g[j] = np.einsum("bfe,bf->ef", net.embedding[seen], d)
                    np.add.at(de, seen.ravel(), (d[:, :, None] * net.taps[k][j].T[None]).reshape(-1, EMBEDDING))
                dtaps.append(g)
            grads = [de, *dtaps, dh.sum(0), act.T @ p, p.sum(0)]
            step += 1
            for q, g, a, v in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Network | None:
    """From at most ``most`` rows; their ids are what is broadcast and their windows what the driver
    gets.  A doc_id on several rows is learned with its largest text.  None without a labelled row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    picked = sample(rows.select("doc_id", "lang").where("doc_id is not null and lang is not null"), most).select("doc_id").distinct()
    rows = rows.where("lang is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("top")).select("doc_id", "top.text", "top.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in cut(at, RUN_BYTES):
                x, doc, _ = windows(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.bincount(doc, minlength=j - i)
                nth = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                ids, langs = b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), langs.take(pa.array(doc)), pa.array(nth), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "nth", "bytes"])

    got = rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, nth long, bytes binary").toArrow().sort_by([("doc_id", "ascending"), ("nth", "ascending")])
    if not got.num_rows:
        return None
    langs = got["lang"].to_pylist()
    names = sorted(set(langs))
    x = np.frombuffer(b"".join(got["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return learn(x, np.array([names.index(v) for v in langs]), names)


def _labelled(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")


def train_whole(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """From all windows of all labelled rows outside the held-out fifth.  Rows are dealt into groups
    of about ``GROUP`` windows by a hash.  The first group starts the network; in each later round
    ``FASTER`` times as many groups as before go on from it at once, and it becomes the mean of
    theirs, weighted by windows.  How rows lie in partitions changes nothing; the driver gets a sum of
    parameters from each task.  None without a labelled row."""
    rows = _labelled(df, key, text, lang).where(~held_out())
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / WINDOW))
    names, size = rows.agg(F.sort_array(F.collect_set("lang")), F.sum(n)).first()
    if not names:
        return None
    groups = -(-size // GROUP)
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "text")).withColumn("part", F.pmod("deal", F.lit(groups)))
    net, begin, end = None, 0, 1
    while begin < groups:
        net = _mean_of_groups(rows.where((F.col("part") >= begin) & (F.col("part") < end)), names, net)
        begin, end = end, end * FASTER
    return net


def _mean_of_groups(rows: DataFrame, names: list[str], start: Network | None) -> Network | None:
    """``start`` taught by each group on its own, and the mean of what comes out."""
    model = rows.sparkSession.sparkContext.broadcast(start)
    most, how = 2 * GROUP, {"epochs": 1, "steps": 0} if start else {}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in batches:
            data, at = utf8(b.column(1))
            part, y = b.column(0).to_numpy(), pc.index_in(b.column(2), pa.array(names)).to_numpy()
            for i, j in cut(at, RUN_BYTES):
                for s in range(at[i], max(at[j], at[i] + 1), RUN_BYTES):  # a long text's windows come in several runs
                    e = min(at[j], s + RUN_BYTES)
                    x, doc, _ = windows(data[s:e], np.clip(at[i : j + 1], s, e) - s)
                    for p in np.unique(part[i:j]):
                        of = part[i:j][doc] == p
                        yield p, x[of], y[i:j][doc[of]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = 0, 0
        for _, group in groupby(runs(batches), key=lambda r: r[0]):
            m, xs, ys, held, n = model.value, [], [], 0, 0
            for _, x, y in group:
                if held and held + len(x) > most:  # equal rows, or a very long one: one after the other
                    m, n, xs, ys, held = learn(np.concatenate(xs), np.concatenate(ys), names, **how, start=m), n + held, [], [], 0
                xs.append(x)
                ys.append(y)
                held += len(x)
            m, n = learn(np.concatenate(xs), np.concatenate(ys), names, **how, start=m), n + held
            total += np.rint(np.concatenate([q.ravel() for q in m.params()]) / GRAIN).astype(np.int64) * n
            count += n
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    dealt = rows.repartition("part").sortWithinPartitions("part", "deal", "doc_id", "text", "lang").select("part", "text", "lang")
    got = dealt.mapInArrow(run, "n long, total binary").collect()
    if not got:
        return start
    mean = sum(np.frombuffer(r["total"], np.int64) for r in got) / sum(r["n"] for r in got) * GRAIN
    net = untrained(names, np.random.default_rng(0))
    for q in net.params():
        q[...], mean = mean[: q.size].reshape(q.shape), mean[q.size :]
    return net


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[at]) > 0
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
    return out


def predict(df: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and none (0 to 1, that it is of no language), for each row and its
    whole text."""
    model = df.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables = m.tables() if m else None
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in cut(at, RUN_BYTES):
                lang, score, none = guess(m, tables, data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array(none)], ["doc_id", "lang_pred", "score", "none"])

    return pairs(df, key, text).mapInArrow(run, "doc_id long, lang_pred string, score double, none double")


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def guess(m: Network | None, tables: list[list[np.ndarray]] | None, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest language, its score among the languages, and the score of none: 1 for a text
    without a letter, 0 for one of under ``SHORT`` bytes."""
    real = _has_letter(data, at)
    if m is None:
        return ["und"] * len(real), np.zeros(len(real)), np.ones(len(real))
    total = np.zeros((len(real), len(m.names) + 1))
    x, doc, size = windows(data, at)
    step = RUN_BYTES // WINDOW  # a long text's windows come in several runs
    for s in range(0, len(x), step):
        logits = pooled(x[s : s + step], tables) @ m.out + m.out_bias
        np.add.at(total, doc[s : s + step], logits * size[s : s + step, None])
    total /= np.maximum(1, np.diff(at))[:, None]
    p = softmax(total[:, :-1])
    best = p.argmax(1)
    lang = [m.names[k] if ok else "und" for k, ok in zip(best.tolist(), real.tolist(), strict=True)]
    return lang, np.where(real, p[np.arange(len(p)), best], 0.0), np.where(real, np.where(np.diff(at) < SHORT, 0.0, softmax(total)[:, -1]), 1.0)


def judge(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(df, train(df)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def limit(df: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score of none that at most ``REJECTED`` of the labelled held-out rows with a letter
    exceed, 0.5 at least.  All of those rows are scored, and the rank is exact."""
    rows = _labelled(df, key, text, lang).where(held_out())
    with Scratch(df.sparkSession, "limit") as scratch:
        scores = scratch.kept(predict(rows, net).where("lang_pred <> 'und'").select("none"), "none")
        top = scores.orderBy(F.desc("none")).offset(int(scores.count() * REJECTED)).first()
    return max(0.5, top["none"] if top else 0.0)


def keep_known(df: DataFrame, net: Network | None, most: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` with a letter whose score of none is ``most`` or less, with all their
    columns.  Without a network there is no row whose language is known."""
    model = df.sparkSession.sparkContext.broadcast(net)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables = m.tables() if m else None
        for b in batches:
            data, at = utf8(b.column(place))
            keep: list[bool] = []
            for i, j in cut(at, RUN_BYTES):
                lang, _, none = guess(m, tables, data[at[i] : at[j]], at[i : j + 1] - at[i])
                keep += [v != "und" and s <= most for v, s in zip(lang, none.tolist(), strict=True)]
            if keep:
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
