"""The automaton, token files and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vitalgauge.llm import packing, token_files, tokens
from vitalgauge.llm.bpe import Automaton, gadget_arcs
from vitalgauge.llm.encode import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'", "'s", "'re", "'LL", "x", "1", "23", "²", "!", "!!", "é", "É", "İ", "Σ", "ς", "\u00a0", "\u3000", "中文", "😀", "<|endoftext|>", "<|", "\x1c", "\x00", "\uffff", "_", "-", "Ⅷ", "ﬁ", "aaaa", "====", "    ", "e\u0301", "가"]


def expected(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(1500)] + ["", "'", " 's", "a" * 700, "!" * 500, " " * 300, "ab" * 300]
    got = Encoder(path).encode(list(texts))
    assert [g.tolist() for g in got] == expected(path, texts)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_whose_hashes_collide(path):
    """Thue-Morse words and their mirrors have equal sums of powers modulo 2**64."""
    texts = []
    for n in (1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        texts += [a, a.translate({97: "b", 98: "a"})]
    e = Encoder(path)
    for batch in ([texts], [[t] for t in texts]):
        for some in batch:
            assert [g.tolist() for g in e.encode(list(some))] == expected(path, some)


def test_arcs_are_those_of_explicit_gadgets(tmp_path):
    """Small random merge lists: the arcs read off the spines, and whole encodings."""
    rng = random.Random(5)
    for k in range(60):
        names = ["a", "b", "c"][: rng.choice([1, 2, 3])]
        base, merges = len(names), []
        while len(merges) < 12:
            u, v = rng.choice(names), rng.choice(names)
            if u + v not in names:
                merges.append((u, v))
                names.append(u + v)
        vocab = {t: i for i, t in enumerate(names)}
        (file := tmp_path / f"{k}.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": [list(m) for m in merges]}, "added_tokens": []}))
        auto = Automaton(str(file))
        arcs = gadget_arcs(base, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        made = {*range(base), *(t for _, t in arcs)} | {vocab[u + v] for u, v in merges if _joined("".join((u, v)), merges) == [u + v]}
        live = sorted(t for t in made if _joined(names[t], merges) == [names[t]])
        x, y = (np.array(z) for z in zip(*((a, b) for a in live for b in live), strict=True))
        assert auto.arc(x, y).tolist() == [(a, b) in arcs for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        words = ["".join(rng.choices(names[:base], k=rng.randint(1, 30))) for _ in range(60)]
        ids, n = auto.encode_words(np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words]))
        assert [[names[i] for i in part] for part in np.split(ids, np.cumsum(n)[:-1])] == [_joined(w, merges) for w in words]


def _joined(word, merges):
    """Merges by rank, leftmost first."""
    parts = list(word)
    for u, v in merges:
        out = []
        for p in parts:
            if out and out[-1] == u and p == v:
                out[-1] = u + v
                out.append("")  # a joined token takes part in no second join of its rank
            else:
                if out and out[-1] == "":
                    out.pop()
                out.append(p)
        parts = [p for p in out if p]
    return parts


def test_a_full_memo_is_emptied(monkeypatch):
    import vitalgauge.llm.encode as m

    monkeypatch.setattr(m, "MEMO_BITS", 6)
    texts = [f"w{i} x{i}y z{i}" for i in range(20)]
    e = Encoder(BYTE)
    assert [g.tolist() for t in texts for g in e.encode([t])] == expected(BYTE, texts)


def test_round_trip(odd, none):
    got = tokens.round_trip(odd, WORD).collect()
    tk = Tokenizer.from_file(WORD)
    want = []
    for r in odd.collect():
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.round_trip(none, WORD).count() == 0
    ids = tokens.encode_documents(odd, WORD)
    back = tokens.decode_documents(ids, WORD)
    assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in back.collect()) == sorted(w[3] for w in want)


def test_token_files(spark, docs, odd, none, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, WORD, 1, metadata=["lang"])
    rows = {r["doc_id"]: r for r in token_files.checksums(token_files.read_token_files(spark, path, columns=("doc_id", "start", "n_tokens", "ids"))).collect()}
    start = 0
    for r, ids in zip(data := docs.orderBy("doc_id").collect(), expected(WORD, [r["text"] for r in data]), strict=True):
        ids = [*ids, 1]
        assert tuple(rows[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for file in (tmp_path / "t").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {c.path_in_schema: c for c in map(group.column, range(group.num_columns))}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        for name in ("doc_id", "local_start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and "RLE_DICTIONARY" not in columns[name].encodings
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
    some = token_files.read_token_files(spark, path, 10, 12, ("doc_id", "meta_lang"))
    assert sorted(r["doc_id"] for r in some.collect()) == [10, 11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan
    assert "ids" not in plan.split("ReadSchema:")[1]
    for name, df, n in (("odd", odd, odd.count()), ("none", none, 0)):
        token_files.write_token_files(df, f"{path}{name}", WORD, 1)
        assert token_files.checksums(token_files.read_token_files(spark, f"{path}{name}", columns=("doc_id", "start", "n_tokens", "ids"))).count() == n


def check_packing(got, ids_of, capacity=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in [*pieces.values(), *sequences.values()]:
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: len(v) for k, v in ids_of.items()}
    sizes = [sum(n for _, n in v) for v in sequences.values()]
    assert all(n <= capacity and n & (n - 1) == 0 for n in sizes)


def test_packing(docs, odd, none):
    data = docs.collect()
    check_packing(packing.pack_documents(docs, BYTE).collect(), {r["doc_id"]: [*i, 0] for r, i in zip(data, expected(BYTE, [r["text"] for r in data]), strict=True)})
    got = packing.pack_documents(odd, BYTE)
    assert got.selectExpr("sum(length)").first()[0] == sum(len(i) + 1 for i in expected(BYTE, [r["text"] or "" for r in odd.collect()]))
    assert packing.pack_documents(none, BYTE).count() == 0


def test_packing_plan_balances_cost():
    sizes = np.array([600, 600, 500, 500, 300, 300, 124, 100, 48, 3000])
    pieces, n = packing.plan(sizes)
    assert pieces[:, 2].sum() == sizes.sum()
    cost = defaultdict(float)
    for _, _, length, seq, _ in pieces:
        cost[seq] += length + length**2 / 1024
    assert n == len(cost)
    # the last ids' sequences are shorter powers of two, which cost less by design
    shared = [c for s, c in cost.items() if (pieces[:, 3] == s).sum() > 1 and pieces[pieces[:, 3] == s, 2].sum() == packing.CAPACITY]
    assert len(shared) == 3
    assert max(shared) - min(shared) < 700
