"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgauge.llm import exact_dedup, minhash
from vitalgauge.llm.common import fresh
from vitalgauge.llm.graph import components


def shingles(text, width):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    """Smallest doc_id reachable; rows with the same doc_id are one document."""
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    got = minhash.near_duplicates(docs, width, percent).collect()
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(data, width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, width)) for i, t in data}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def family(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            t[at] = f"e{rng.integers(0, 10**9)}"
        out.append(" ".join(t))
    return out


def test_large_groups_of_near_copies_are_cut_into_blocks(spark, monkeypatch):
    for name, value in (("LED", 16), ("BLOCK_MEMBERS", 8), ("BLOCK_BYTES", 4096)):
        monkeypatch.setattr(minhash, name, value)
    texts = family(1, 90, 120, 9) + family(2, 30, 60, 4) + family(3, 40, 15, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(list(enumerate(texts)), 3, 85)


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["component_id"] == 3
    assert not by[4]["kept"]
    assert by[1]["kept"] and by[2]["kept"] and by[9]["n_shingles"] == 0
    assert by[None]["component_id"] is None
    assert minhash.near_duplicates(none, 3, 85).count() == 0


def test_match_threshold():
    """By the definition: below T with a probability of at most LOSS, which T + 1 would exceed."""
    below = lambda s, t: sum(comb(minhash.COORDINATES, k) * s**k * (1 - s) ** (minhash.COORDINATES - k) for k in range(t))
    for s in (0.85, 0.8, 0.5):
        t = minhash.match_threshold(s)
        assert below(s, t) <= minhash.LOSS < below(s, t + 1)
    assert [minhash.match_threshold(x) for x in (0.85, 0.8)] == [13, 11]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    df = spark.createDataFrame([*path, (100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(df.limit(0)).count() == 0


def test_a_document_on_several_texts_links_them(spark):
    """The rows of 7 join the classes of 3 and 5, whichever of them stands for its class."""
    base, other = family(11, 2, 60, 0)[0], family(12, 1, 60, 0)[0]
    near = base.rsplit(" ", 1)[0] + " z"
    for rows in ([(3, base), (7, near), (7, other), (5, other)], [(9, base), (7, near), (7, other), (8, other), (2, "alone")], [(7, base), (7, base), (7, other), (7, None), (7, "")]):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 3, 85)


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate({97: "b", 98: "a"})


def test_words_that_collide_under_sums_of_powers_stay_apart(spark):
    from vitalgauge.llm.shingles import distinct_terms, word_hashes

    for n in (8, 200, 1024, 2048, 4096):
        data = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
        h, words = word_hashes(data, np.array([0, len(data)]))
        assert words.tolist() == [2] and h[0] != h[1]
        assert distinct_terms(data, np.array([0, len(data)]), 20)[1][0] > 2
    rows = [(k, w) for k, w in enumerate(thue_morse(1024))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert all(r["kept"] for r in got)


def test_recall_at_the_threshold():
    """Of 20,000 pairs just at the similarity all have T collisions, as LOSS promises."""
    from vitalgauge.llm.shingles import signatures

    rng = np.random.default_rng(8)
    for percent in (85, 80):
        t, size = minhash.match_threshold(percent / 100), 185
        own = size * (100 - percent) // (100 + percent)  # shingles of either side alone
        lost = 0
        for _ in range(20):
            sets = rng.integers(1, 2**63, (1000, size + own)).astype(np.uint64)
            left, right = sets[:, :size], sets[:, own:]
            sig = [signatures(np.sort(x, 1).ravel(), np.full(1000, size), minhash.COORDINATES) for x in (left, right)]
            assert 100 * (size - own) >= percent * (size + own) > 100 * (size - own - 2)
            lost += int(((sig[0] == sig[1]).sum(1) < t).sum())
        assert lost == 0


def test_collisions_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    for wide in (3, 40, 4000):
        a, b = (rng.integers(0, wide, (n, minhash.COORDINATES)).astype(np.uint32) for n in (70, 50))
        b[:20] = np.where(rng.random((20, minhash.COORDINATES)) < 0.5, a[:20], b[:20])
        for t in (1, 11, 13, 32):
            x, y = minhash.collisions(a, b, t)
            assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero((a[:, None] == b[None]).sum(2) >= t)), strict=True))


def test_links_are_a_forest_over_components():
    texts = family(5, 40, 80, 8)
    sets = [np.unique(np.array([hash(s) & 0xFFFFFFFFFFFF for s in shingles(t, 3)], np.uint64)) for t in texts]
    from vitalgauge.llm.shingles import signatures

    sig = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 32)
    members = [(k // 2, sig[k], sets[k]) for k in range(40)]
    up = {k: k // 2 for k in range(40)}

    def root(groups):
        parent = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for a, b in groups:
            parent[find(up[a])] = find(up[b])
        return {frozenset(k for k in range(40) if find(up[k]) == r) for r in {find(up[k]) for k in range(40)}}

    all_pairs = [(a, b) for a, b in combinations(range(40), 2) if minhash.alike(sets[a], sets[b], 85)]
    found = [(2 * a, 2 * b) for a, b in minhash.links(members, None, 13, 85)]
    assert root(found) == root(all_pairs)
    assert len(found) == 20 - len(root(all_pairs))
    across = [(2 * a, 2 * b) for a, b in minhash.links(members[:15], members[15:], 13, 85)]
    assert root(across) == root([(a, b) for a, b in all_pairs if a < 15 <= b])


def test_exact_dedup(spark, odd, none, docs):
    for df in (docs, odd, none):
        got = exact_dedup.dedup(df, exact_dedup.DigestIndex(spark, fresh(spark, "index"))).collect()
        groups = {}
        for r in df.collect():
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(r["doc_id"])
        assert len(got) == sum(map(len, groups.values()))
        for r in got:
            ids = groups[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in got) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_the_index_outlives_a_batch(spark, docs):
    path = fresh(spark, "index")
    first = exact_dedup.dedup(docs.where("doc_id < 100"), exact_dedup.DigestIndex(spark, path, 4)).collect()
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path, 4).name}")  # another session knows no table
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = exact_dedup.dedup(docs, again).collect()
    known = {r["text_sha256"]: r["keep_id"] for r in first}
    assert all(not r["kept"] and r["keep_id"] == known[r["text_sha256"]] for r in second if r["text_sha256"] in known)
    assert again.rows().count() == len({r["text_sha256"] for r in second})
    assert again.buckets == 4 == exact_dedup.DigestIndex(spark, path, 9).buckets
    plan = again.unseen(spark.createDataFrame([], "digest binary, keep_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_a_batch_that_is_repeated(spark, docs):
    """As after a run that was lost when it had appended: the same rows, and nothing twice."""
    index = exact_dedup.DigestIndex(spark, fresh(spark, "index"))
    exact_dedup.dedup(docs.where("doc_id < 50"), index, batch="a")
    runs = [sorted(map(tuple, exact_dedup.dedup(docs, index, batch="b").drop("row_no").collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    assert index.rows().count() == index.rows().select("digest").distinct().count() == len({r[4] for r in runs[0]})
    assert not any(r[3] for r in exact_dedup.dedup(docs, index, batch="c").drop("row_no").collect())


def test_kept_rows_keep_their_columns(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = exact_dedup.kept_rows(df, exact_dedup.DigestIndex(spark, fresh(spark, "index")))
    assert out.columns == df.columns
    assert out.count() == 11


def test_rows_stay_whatever_the_order_of_a_second_scan(spark, tmp_path):
    """The files are packed one way when the digests are made and another when the rows are read."""
    spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 150, repeat(' x', cast(id % 150 % 7 AS INT) * 50)) AS text").repartition(6, "doc_id").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    want = sorted(r[0] for r in df.groupBy("text").agg(F.max("doc_id")).select("max(doc_id)").collect())
    key, least = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    was = {k: spark.conf.get(k) for k in (key, least)}
    try:
        spark.conf.set(key, "1g")
        spark.conf.set(least, "0")
        out = exact_dedup.kept_rows(df, exact_dedup.DigestIndex(spark, fresh(spark, "digest-index")))
        spark.conf.set(key, "500")
        assert sorted(r["doc_id"] for r in out.collect()) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
