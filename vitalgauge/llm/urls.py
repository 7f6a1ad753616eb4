"""URL filter: host and path rules, and for the rest naive Bayes over segmented words.

Names such as ``cheappills`` are split into words by the Viterbi path of a unigram model.
Its words are the lists of ``url_words`` and all pieces of the table's own hosts and paths
that aren't made of shorter words, weighed by how often they occur.  A multinomial naive Bayes
model scores the words of host and path, a path's words apart from a host's.  It is learned from
the rows that the rules decide, on all hosts but a fifth (crc32 of the host), on which its
agreement with the rules can be measured (:func:`agreement`); the marks of ``url_words`` have prior
odds, on hosts and paths alike.  An unknown word tells nothing.

Words are counted in ``SLOTS`` slots by their crc32, so what the driver and each worker hold is bounded
whatever the table; nothing is left out for being rare.

Defined cases: a null url, or one without ``://``, has an empty host and path, is under no
rule and scores the prior, 0 or less, which is allowed; repeated rows are each judged; an empty
table gives an empty table; other columns are not looked at; a run of over ``WORD_LONGEST``
letters, more than a host's label may have, is one word and isn't split.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_words import COMMON, MARKS

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SLOTS, WORD_LONGEST = 1 << 20, 63
#: What a mark of weight 1 adds to the log odds, and the log odds at which a page is blocked.
MARK, BLOCK = math.log(30), math.log(3)
#: Occurrences that a word is taken to have beside those that are seen, which tell nothing.
PRIOR = 10.0
_PIECE = re.compile(r"[a-z]+|[0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) & (SLOTS - 1)


@dataclass
class Segmenter:
    """Splits a piece of letters into the words of highest joint probability; letters that no
    word covers stay together, at a price by their number.  ``cost`` is by slot."""

    cost: dict[int, float]
    unknown: float

    def knows(self, word: str) -> bool:
        return slot(word) in self.cost

    def split(self, piece: str) -> list[str]:
        if len(piece) > WORD_LONGEST:
            return [piece]
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # cost, where the last word began, known
        for end in range(1, len(piece) + 1):
            options = []
            for at in range(end):
                c = self.cost.get(slot(piece[at:end]))
                if c is not None:
                    options.append((best[at][0] + c, at, True))
                elif at == 0 or best[at][2]:
                    options.append((best[at][0] + self.unknown + 2.3 * (end - at), at, False))
            best.append(min(options))
        out, end = [], len(piece)
        while end:
            out.append(piece[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def lexicon() -> Segmenter:
    """Of the given words alone, all as likely."""
    words = {slot(w) for w in [*COMMON, *MARKS]}
    return Segmenter(dict.fromkeys(words, math.log(len(words))), math.log(len(words)))


def segmenter(pieces: dict[int, int]) -> Segmenter:
    """``pieces``: how often the table's words occur, by slot."""
    counts = {slot(w): 2.0 for w in [*COMMON, *MARKS] if len(w) > 1}
    for k, n in pieces.items():
        counts[k] = counts.get(k, 1.0) + math.log1p(n)
    total = sum(counts.values())
    return Segmenter({k: math.log(total / n) for k, n in counts.items()}, math.log(total))


@dataclass
class Bayes:
    """log of how much likelier a word is on a blocked page, by slot, and the same of the classes."""

    prior: float
    words: dict[int, float]

    def score(self, words: Sequence[str]) -> float:
        return self.prior + sum(self.words.get(slot(w), 0.0) for w in words)


def tokens(host: str, path: str, seg: Segmenter) -> list[str]:
    """Words of the host, then of the path, whose words have their own counts."""
    out = []
    for mark, text in (("", host), ("/", path.lower())):
        for p in _PIECE.findall(text):
            out += [mark + "#"] if p[0].isdigit() else [mark + w for w in seg.split(p)]
    return out


def _cached(cache: dict[str, list[str]], host: str, seg: Segmenter) -> list[str]:
    if host not in cache:
        if len(cache) >= 100_000:
            cache.clear()
        cache[host] = tokens(host, "", seg)
    return cache[host]


def held_out(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % 5 == 0


def _words(rows: DataFrame) -> dict[int, int]:
    """How often pieces of hosts and paths that aren't made of given words occur, by slot."""
    pieces = rows.select(F.explode(F.expr(r"regexp_extract_all(concat(host, ' ', lower(path)), '([a-z]+)', 1)")).alias("piece"))
    pieces = pieces.where(F.length("piece").between(3, WORD_LONGEST)).groupBy("piece").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = lexicon()
        for b in batches:
            n: dict[int, int] = {}
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if seg.knows(p) or len(seg.split(p)) == 1:
                    n[slot(p)] = n.get(slot(p), 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["slot", "n"])

    return {r["slot"]: r["n"] for r in pieces.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # SLOTS rows at most


def _fit(rows: DataFrame, seg: Segmenter) -> Bayes:
    """Counts each word on the blocked and allowed pages of (host, path, bad), all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for b in batches:
            count: dict[tuple[int, bool], int] = {}
            for h, p, bad in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for k in [*map(slot, _cached(cache, h, seg) + tokens("", p, seg)), -1]:  # -1: pages
                    count[k, bad] = count.get((k, bad), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.int64()), pa.array([x for _, x in count], pa.bool_()), pa.array(list(count.values()), pa.int64())], ["slot", "bad", "n"])

    n = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0))
    found = rows.mapInArrow(run, "slot long, bad boolean, n long").groupBy("slot").agg(n(True).alias("bad"), n(False).alias("good")).collect()  # SLOTS rows at most
    counts = {r["slot"]: (float(r["bad"]), float(r["good"])) for r in found}
    bad_pages, good_pages = counts.pop(-1, (0.0, 0.0))
    bad, good = (sum(n[k] for n in counts.values()) + 1 for k in (0, 1))
    share = bad / (bad + good)  # PRIOR occurrences of a word are dealt as the classes' words are
    words = {k: math.log((b + PRIOR * share) / bad) - math.log((g + PRIOR * (1 - share)) / good) for k, (b, g) in counts.items()}
    for mark in ("", "/"):
        for w, weight in MARKS.items():
            words[slot(mark + w)] = words.get(slot(mark + w), 0.0) + weight * MARK
    return Bayes(min(0.0, math.log((bad_pages + 1) / (good_pages + 1))), words)


def train(rows: DataFrame) -> tuple[Segmenter, Bayes]:
    """From (page_id, host, path, fit): the words of all rows, then the counts of those that a rule decides."""
    seg = segmenter(_words(rows))
    decided = rows.where(F.col("fit").isNotNull() & ~held_out(F.col("host"))).select("host", "path", (F.col("fit.verdict") == "block").alias("bad"))
    return seg, _fit(decided, seg)


def parsed(df: DataFrame, rules: Sequence[tuple[str, str, str]], key: str, url: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return rows.withColumn("fit", rule(F.col("host"), F.col("path"), rules))


def agreement(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> tuple[int, float]:
    """On the hosts that were kept out: the pages that a rule decides, and the share of them on which the method agrees."""
    out = judge(df, rules, key, url).where(F.col("rule").isNotNull() & held_out(F.col("host")))
    same = F.avg(((F.col("score") >= BLOCK) == (F.col("verdict") == "block")).cast("int"))
    n, share = out.agg(F.count("*"), same).first()
    return n, share or 0.0


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of the method, rule or not)."""
    rows = parsed(df, rules, key, url)
    seg, model = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for b in batches:
            score = [model.score(_cached(cache, h, seg) + tokens("", p, seg)) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score, pa.float64())], ["page_id", "host", "path", "score"])

    out = rows.select("page_id", "host", "path").mapInArrow(run, "page_id long, host string, path string, score double").withColumn("fit", rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") >= BLOCK, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "score")
