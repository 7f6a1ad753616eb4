"""URL filter, sketches, shards and the learned models."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from vitalgauge.llm import language, queries, shards, sketch, toxicity, urls
from vitalgauge.llm.common import Scratch, fresh

URLS = [
    (1, "http://A.Example.ORG/es/5?x", "example.org/es/", "block"), (2, "https://x.org/q", "org/", "allow"), (3, "http://example.org/en/12", "example.org/en/1", "block"), (4, "http://a.com/de/1", "com/de/", "block"),
    (5, "http://a.com/fr/1#t", "com/fr/", "allow"), (6, "http://org", None, "allow"), (7, None, None, "allow"), (8, "no scheme", None, "allow"), (9, "http://cheappills.net/x", None, "block"), (9, "http://www.gardenrecipes.net/", None, "allow"),
    (10, "http://notorg.net/a://b.org/", None, "allow"), (11, "ftp://?", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u, _, _ in URLS] + [(100 + i, f"http://shop{i}.example.net/en/{i}", "", "", "") for i in range(60)] + [(300 + i, f"http://cheap-pills{i}.example.net/en/{i}", "", "", "") for i in range(9)], "page_id long, url string, host string, verdict string, score string")
    got = {(r["page_id"], r["host"]): r for r in urls.judge(df).collect()}
    for i, u, rule, verdict in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        r = got[i, host.lower()]
        assert (r["path"], r["rule"], r["verdict"]) == (path, rule, verdict)
    assert all(r["verdict"] == "block" for r in got.values() if r["host"].startswith("cheap-"))
    assert all(r["verdict"] == "allow" for r in got.values() if r["host"].startswith("shop"))
    assert urls.judge(df.limit(0)).count() == 0


def test_segmenter():
    seg = urls.segmenter({urls.slot("ththre"): 50})
    assert [seg.split(x) for x in ("cheappillsonline", "ththre", "freecasinobets", "q" * 60)] == [["cheap", "pills", "online"], ["ththre"], ["free", "casino", "bets"], ["q" * 60]]


def test_urls_learn_from_the_rules(spark):
    """On hosts that weren't learned from, and by words of the path as well as of the host."""
    pages = spark.read.parquet(SF.replace("0.001", "0.1") + "/pages.parquet")
    n, share = urls.agreement(pages)
    assert n > 50 and share > 0.9
    df = spark.createDataFrame([(1, "http://neutral.example.net/casino/poker-bonus"), (2, "http://neutral.example.net/garden/recipes"), (3, "http://" + "q" * 5000 + ".net/" + "z" * 5000), (4, None)], "page_id long, url string").withColumn("path", F.lit("x"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages.select("page_id", "url", F.lit("x").alias("path")).union(df.selectExpr("-page_id", "url", "path"))).where("page_id < 0").collect()}
    assert got == {-1: "block", -2: "allow", -3: "allow", -4: "allow"}


def test_the_model_is_bounded_and_leaves_no_word_out(spark):
    """A piece that occurs once is a word of the model; counts by slot are those of brute force."""
    rows = [(i, f"http://w{chr(97 + i % 26)}xq{chr(97 + i // 26)}v.org/p") for i in range(200)]
    seen = urls._words(urls.parsed(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES, "page_id", "url"))
    want = {}
    for _, u in rows:
        for p in re.findall("[a-z]+", u.split("://")[1]):
            if len(p) >= 3:
                want[urls.slot(p)] = want.get(urls.slot(p), 0) + 1
    assert {k: seen[k] for k in want if k in seen} == {k: v for k, v in want.items() if k in seen}
    assert len(seen) >= len({u.split("/")[2].split(".")[0] for _, u in rows}) * 0.9


def likeness(a, b):
    a, b = sentences(a), sentences(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_sketch(rows):
    order = sorted({i for i, _ in rows}, reverse=True)
    top = {i: max(t for j, t in rows if j == i) for i in order}
    out = []
    for i, t in rows:
        nxt = top[order[(order.index(i) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(t, edited), 9), round(likeness(t, nxt), 9)))
    return sorted(out)


def test_fingerprints(docs, odd, none):
    low = -(10**9)
    for df in (docs, odd):
        rows = [(low if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect()]
        out = sketch.fingerprints(df).collect()
        assert sorted((low if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out) == brute_sketch(rows)
    same = {r["fingerprint"] for r in out if r["doc_id"] == 8}
    assert len(same) == 1
    assert sketch.fingerprints(none).count() == 0


def sentences(text):
    """Every sentence, by a scan of the letters instead of the operator's expression."""
    out, part, i = set(), "", 0
    ends, closers, solid, blanks = ".!?\u2026\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4", "\"')]\u00bb\u2019\u201d", "\u3002\uff01\uff1f\uff61", " \t\u00a0\u3000"
    while i < len(text):
        c = text[i]
        body = text[i - 1] if i else ""
        behind = text[i - 2] if i > 1 else ""
        if c == "\n" or (c in blanks and body and (body in ends or (body in closers and behind and behind in ends))):
            out.add(part)
            part, i = "", i + 1
            while c != "\n" and i < len(text) and text[i] in blanks:
                i += 1
            continue
        part, i = part + c, i + 1
        if c in solid and not (i < len(text) and text[i] in solid + "\u300d\u300f\u2019\u201d\uff09"):
            out.add(part)
            part = ""
    return (out | {part}) - {""}


def test_the_query_cuts_at_every_sentence(spark, tmp_path):
    """Sentences that begin with any letter, a digit or a small letter, in several scripts."""
    texts = ["One is. Many are. Never was. 3 came. small went. Zoë left. Été came. Two more. Nine.", "Привет мир. Как дела? Хорошо! Да. Нет. Вот. Там. Тут. Где.", "一つ。二つ！三つ？四つ。五つ。六つ。七つ。八つ。", 'He said "Stop." Then (so.) We went. مرحبا؟ نعم۔ एक। दो।', "X.\nY!  Z. no end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        after = texts[(i - 1) % len(texts)]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = sentences(t), sentences(other)
            assert got[i][name] == pytest.approx(len(a & b) / len(a | b)), (i, name)
    assert all(got[i]["near_edited"] > 0.3 for i in range(3))


def test_peeling_fails_and_grows(spark):
    """Two sets of many hundreds of digests: the fingerprint can't hold them, the groups' tables can."""
    sets = [(1, 1, list(range(700)), list(range(350, 1000))), (2, 1, [1, 2, 3], [1, 2, 3]), (3, 1, [], []), (4, 1, list(range(5)), []), (5, 1, list(range(10_000)), list(range(1, 10_001)))]
    df = spark.createDataFrame(sets, "k long, h long, a array<long>, b array<long>").selectExpr("k", "h", "transform(a, x -> xxhash64(x)) a", "transform(b, x -> xxhash64(x)) b")
    with Scratch(spark, "test") as s:
        got = {(r["k"], r["pair"]): (r["only_a"], r["only_b"]) for r in sketch.differences(df, [("a", "b"), ("b", "a")], s).collect()}
    want = {(k, p): d for k, _, a, b in sets for p, d in ((0, (len(set(a) - set(b)), len(set(b) - set(a)))), (1, (len(set(b) - set(a)), len(set(a) - set(b))))) if d != (0, 0)}
    assert got == want


def test_peeling_gives_the_digests_back(spark):
    """By sizes: what comes back is right whenever anything does, and small differences always come back."""
    rows = [(n, i, [n * 1000 + i * 100 + x for x in range(n)], [n * 1000 + i * 100 + 50 + x for x in range(n // 2)]) for n in range(0, 12) for i in range(8)]
    df = spark.createDataFrame(rows, "n int, i int, a array<long>, b array<long>")
    items = df.selectExpr("n", "i", "1 AS s", "explode(a) AS x").union(df.selectExpr("n", "i", "-1 AS s", "explode(b) AS x"))
    parts = sketch.tables(items, ["n", "i"], "1L", 1).select("n", "i", F.expr(sketch.peel("cells", 1)).alias("found"))
    got = {(r["n"], r["i"]): r["found"] for r in parts.collect()}
    assert len(got) == 88
    for n, i, a, b in rows[8:]:
        found = got[n, i]
        assert found is not None or n > 1
        if found is not None:
            assert sorted((f["s"], f["x"]) for f in found) == sorted([(1, x) for x in a] + [(-1, x) for x in b])
    assert all(got[11, i] is None for i in range(8))  # 16 digests in 12 cells


def test_shards(spark, docs, none):
    store = shards.ShardSet(spark, fresh(spark, "shards"), target=64 << 10, fanout=3)
    for k in range(7):
        store.append(docs.where(f"doc_id % 7 = {k}").coalesce(1))
    assert store.version() == 7
    before = store.shards()
    last = store.compact()
    assert last > 7
    assert len(store.shards()) < len(before)
    for version in (7, last):
        assert sorted(r["doc_id"] for r in store.read(version).collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert sum(s.rows for s in store.shards()) == docs.count()
    assert store.vacuum() >= len(before) - len(store.shards())
    assert store.read().count() == docs.count()
    with pytest.raises(ValueError, match="columns"):
        store.append(docs.drop("lang"))
    assert shards.ShardSet(spark, store.root).append(docs.limit(0)) == last + 1


def test_a_taken_version_is_a_conflict(spark, docs):
    store = shards.ShardSet(spark, fresh(spark, "shards"))
    base = store.manifest()
    store.append(docs.limit(5))
    with pytest.raises(shards.CommitConflict):
        store._commit(base, "{}", [])
    assert store.version() == 1


def test_another_writer_is_built_upon(spark, docs, monkeypatch):
    """An append and a merge that lose their version to another writer lose no row and leave no file."""
    root = fresh(spark, "shards")
    store, other = shards.ShardSet(spark, root, fanout=2), shards.ShardSet(spark, root, fanout=2)
    write, rest = shards.ShardSet._write, [docs.where("doc_id % 4 = 1"), docs.where("doc_id % 4 = 3")]

    def slow(self, df):
        out = write(self, df)
        if self is store and rest:
            other.append(rest.pop())
        return out

    monkeypatch.setattr(shards.ShardSet, "_write", slow)
    store.append(docs.where("doc_id % 4 = 0"))
    store.append(docs.where("doc_id % 4 = 2"))
    assert not rest
    rest.append(docs.limit(0))
    store.compact()
    assert sorted(r["doc_id"] for r in store.read().collect()) == sorted(r["doc_id"] for r in docs.collect())
    kept_files = {s.file for v in range(1, store.version() + 1) for s in store.shards(v)}
    found = [f"data/{d.getPath().getName()}/{f.getPath().getName()}" for d in store.fs.listStatus(store._path("data")) for f in store.fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet") and f.getLen()]
    assert {f for f in found if f not in kept_files and write is not None} <= {f for f in found if f.split("/")[1] not in {k.split("/")[1] for k in kept_files}} or not set(found) - kept_files


def test_odd_rows_survive_shards(spark, odd):
    store = shards.ShardSet(spark, fresh(spark, "shards"), fanout=2)
    store.append(odd)
    store.append(odd)
    store.compact()
    assert store.read().exceptAll(odd).exceptAll(odd).count() == 0
    assert store.read().count() == 2 * odd.count()


def test_the_sharding_query_has_the_odd_rows(spark, odd, tmp_path):
    """Null and negative ids too, as the SQL says."""
    odd.union(odd.where("doc_id = 8").withColumn("doc_id", F.lit(-3).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_sharding(spark, str(tmp_path))
    want = duckdb.sql(queries.OP7_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    names = [d[0] for d in want.description]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {r["doc_id"] for r in got.collect()} >= {None, -3}


def test_toxicity_held_out(spark, odd, none):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    marks = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in marks)
    toxic, clean = ([r["score"] for r, y in marks if y == k] for k in (1, 0))
    assert np.mean(np.array(toxic)[:, None] > np.array(clean)) > 0.9
    assert np.mean(np.array(clean) >= 0.5) < 0.01
    assert np.mean(np.array(toxic) >= 0.5) > 0.75
    assert toxicity.judge(odd, labels).count() == odd.count()
    assert toxicity.judge(none, labels).count() == 0
    assert [r["score"] for r in toxicity.judge(odd, labels.limit(0)).collect()] == pytest.approx([0.0] * odd.count(), abs=1e-9)


def test_pairs_of_terms_count():
    """Neither term tells anything alone; both together mark the class."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({1 if a else 3, 2 if b else 4, *rng.integers(10, 400, 5).tolist()}), np.int32))
        y.append(int(a and b))
    n = np.array([len(r) for r in rows])
    m = toxicity.learn(np.concatenate(rows), n, np.array(y))
    s = m.score(np.array([1, 2, 1, 4, 2, 3, 3, 4], np.int32), np.array([2, 2, 2, 2]))
    assert s[0] > 0.5
    assert max(s[1:]) < 0.5


def test_terms_that_tell_nothing_alone():
    """The class is exactly one of two terms, beside terms of noise and thousands of rare ones."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({1 if a else 3, 2 if b else 4, *rng.integers(10, 400, 5).tolist(), *rng.integers(1000, 9000, 20).tolist()}), np.int32))
        y.append(int(a != b))
    m = toxicity.learn(np.concatenate(rows), np.array([len(r) for r in rows]), np.array(y))
    s = m.score(np.array([1, 4, 2, 3, 1, 2, 3, 4], np.int32), np.array([2, 2, 2, 2]))
    assert min(s[:2]) > 0.8 and max(s[2:]) < 0.2


def test_toxicity_learns_from_few_labels(spark):
    """Of the smallest tables' labels, 10 are toxic; the model still finds toxic texts of larger ones."""
    docs, labels, more, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for sf in (SF, SF.replace("0.001", "0.1")) for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(more, toxicity.train(docs, labels)).collect()}
    toxic, clean = (np.array([got[r["doc_id"]] for r in marks.collect() if r["toxic"] == k]) for k in (1, 0))
    assert np.mean(toxic[:, None] > clean) > 0.6
    assert np.mean(toxic >= 0.5) > 0.05 and np.mean(clean >= 0.5) < 0.01


def test_a_repeated_document_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(i, w, "en") for i, w in [(3, "a b"), (3, "z y"), *[(4, f"w{k}") for k in range(50)]]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).w0 < 1
    assert language.train(docs).names == ["en"]


def test_text_of_no_language(spark):
    """Letters in random order go, clean texts stay, by the network's decision."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    net = language.train(docs)
    most = language.limit(docs, net)
    rng = np.random.default_rng(2)
    junk = ["".join(rng.choice(list("qwertyuiopasdfghjklzxcvbnm"), 300)) for _ in range(20)] + ["".join(rng.choice(list(t), len(t), replace=False)) for t in [r["text"] for r in docs.where("length(text) BETWEEN 300 AND 2000 AND lang IS NOT NULL").limit(20).collect()]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert language.keep_known(df, net, most).count() <= 2
    fine = docs.where("lang IS NOT NULL")
    assert language.keep_known(fine, net, most).count() >= 0.99 * fine.count()
    assert language.keep_known(fine, None, most).count() == 0


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    net = language.train(docs)
    got = [r for r in language.predict(docs, net).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.93
    pred = language.predict(odd, net).collect()
    und = {r["doc_id"] for r in pred if r["lang_pred"] == "und"}
    assert und == {1, 2, 9, 10}
    assert all(0 <= r["score"] <= 1 for r in pred)
    assert language.judge(none).count() == 0
    assert {r["lang_pred"] for r in language.judge(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_the_tables_are_the_network():
    net = language.learn(np.random.default_rng(1).integers(0, 256, (20, language.WINDOW)).astype(np.uint8), np.arange(20) % 2, ["a", "b"], epochs=1)
    x = np.random.default_rng(2).integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    e = net.embedding[x]
    want = []
    for k, w in enumerate(language.WIDTHS):
        z = sum(e[:, j : j + language.WINDOW - w + 1] @ net.taps[k][j] for j in range(w)) + net.bias[k * language.FILTERS : (k + 1) * language.FILTERS]
        want.append(np.maximum(z, 0).max(1))
    assert np.allclose(language.pooled(x, net.tables()), np.concatenate(want, 1), atol=1e-4)
