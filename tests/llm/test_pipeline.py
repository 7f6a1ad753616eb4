"""The pipeline against its own operators, stage by stage."""

from __future__ import annotations

import corpus_pipeline as p
import duckdb
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from vitalgauge.llm import language, queries
from vitalgauge.llm.common import kept
from vitalgauge.llm.samples import held_out


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        now = kept(stage(spark, now, SF), "stage")
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[3] < sizes[2]  # copies
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert now.select(low.alias("t")).distinct().count() == sizes[-1]
    packed = p.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_odd_rows_pass_all_stages(spark, odd, none):
    for df in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        now = kept(df, "stage")
        for _, stage in p.STAGES[:-1]:
            now = kept(stage(spark, now, SF), "stage")
            assert now.columns == df.columns
        ids = {r["doc_id"] for r in now.collect()}
        assert ids == ({4, 5, 6, 7, 8, None, 11} if df.count() else set())
        assert p.STAGES[-1][1](spark, now, SF).count() >= len(ids)


def test_the_language_stage_uses_all_rows(spark, monkeypatch):
    """A language of late rows is learned; random letters of late held-out rows move the limit."""
    monkeypatch.setattr(language, "GROUP", 4_000, raising=False)  # four groups
    rng, words = np.random.default_rng(4), {"en": "the house and this water with that people from work".split(), "xx": "żółw ćma ślad łąka mąka dźwig gęś kość źrebak ręka".split()}
    order = [(r["doc_id"], r["h"]) for r in spark.range(20_000).toDF("doc_id").withColumn("h", held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows, seen = [], {True: 0, False: 0}
    for i, held in order:
        seen[held] += 1
        late = seen[held] > 3_000
        lang = "xx" if late and i % 2 else "en"
        text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 40)) if held and late and i % 10 == 0 else " ".join(rng.choice(words[lang], 8))
        rows.append((i, text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    got = []
    monkeypatch.setattr(language, "keep_known", lambda df, net, most: got.append((net, most)) or df)
    p.drop_unknown_language(spark, docs, SF)
    p.drop_unknown_language(spark, docs.repartition(7), SF)
    (net, most), (other, same) = got
    assert net.names == ["en", "xx"]
    none = sorted((r["none"] for r in language.predict(docs.where(held_out()), net).collect()), reverse=True)
    assert most == none[len(none) // 1_000] > 0.5
    fine = language.predict(docs.where("lang = 'xx'"), net).collect()
    assert np.mean([r["lang_pred"] == "xx" for r in fine]) > 0.9
    assert most == same and all(np.array_equal(a, b) for a, b in zip(net.params(), other.params(), strict=True))


def test_a_long_text_is_learned_in_pieces(spark, monkeypatch):
    """Windows of equal rows and of a long text all arrive, also where one group gets them all."""
    monkeypatch.setattr(language, "GROUP", 300)
    seen = spark.sparkContext.accumulator(0)

    def learn(x, y, names, start=None, **how):
        seen.add(len(y))
        return start or language.untrained(names, np.random.default_rng(1))

    monkeypatch.setattr(language, "learn", learn)
    docs = spark.createDataFrame([(1, "ab " * 70_000, "en"), (3, None, "en"), (3, "", "de"), *[(4, "same text", "de")] * 900, (None, "no id", "en")], "doc_id long, text string, lang string")
    learned = docs.where(~held_out()).selectExpr("doc_id", "greatest(1, ceil(length(coalesce(text, '')) / 192)) n").groupBy().sum("n").first()[0]
    assert language.train_whole(docs).names == ["de", "en"]
    assert seen.value == learned > 1_900


def test_oracle_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == want
        assert sorted(df.columns) == sorted(names)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
