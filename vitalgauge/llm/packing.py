"""Packing documents into sequences for training, balanced by the cost of attention.

The cost of a piece of n ids is ``n + n * n / QUADRATIC``: a linear part and the
attention's square.  Documents are taken block by block from their partition, so no
shuffle and no sort of all rows is needed.  In a block, what fills a sequence alone is
cut off first; the rests, in descending order, each go to the sequence of lowest cost
that still has room for it; the few that fit nowhere are cut to fill the gaps, again
lowest cost first.  What then remains is less than one sequence and becomes sequences
whose lengths are powers of two.  So no id is padding.

Defined cases: a null text is an empty text, which is its end id alone; null doc_ids
are kept; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encode import encoder
from .tokens import pairs

CAPACITY, QUADRATIC, BLOCK_IDS = 1024, 1024, 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan(sizes: np.ndarray, capacity: int = CAPACITY, quadratic: int = QUADRATIC) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) of documents with these sizes, and
    the number of sequences.  ``capacity`` is a power of two."""
    whole, rest = sizes // capacity, sizes % capacity
    doc = np.repeat(np.arange(len(sizes)), whole)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    n_full = len(doc)
    full = np.stack([doc, begin * capacity, np.full(n_full, capacity), np.arange(n_full), np.zeros(n_full, np.int64)], 1).astype(np.int64)
    bins = int(rest.sum()) // capacity
    cost, room = np.zeros(bins), np.full(bins, capacity)
    out: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []
    for d in np.argsort(-rest, kind="stable"):
        n = int(rest[d])
        if not n:
            break
        k = int(np.argmin(np.where(room >= n, cost, np.inf))) if bins else 0
        if not bins or room[k] < n:
            over.append((int(d), int(sizes[d]) - n, n))
            continue
        out.append((int(d), int(sizes[d]) - n, n, n_full + k, capacity - int(room[k])))
        room[k] -= n
        cost[k] += n + n * n / quadratic
    gaps = [(n_full + int(k), capacity - int(room[k]), int(room[k])) for k in np.argsort(cost, kind="stable") if room[k]]
    left = sum(n for _, _, n in over) - sum(g[2] for g in gaps)
    seq = n_full + bins
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            gaps.append((seq, 0, 1 << bit))
            seq += 1
    g = 0
    for d, at, n in over:
        while n:
            s, offset, free = gaps[g]
            take = min(n, free)
            out.append((d, at, take, s, offset))
            at, n = at + take, n - take
            gaps[g] = (s, offset + take, free - take)
            g += take == free
    return np.concatenate([full, np.array(out, np.int64).reshape(-1, 5)]), seq


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id holds the partition and the sequence's number in it; a lost task, run again
    on the same partition, gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(tokenizer), TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            keys = pa.concat_arrays([h[0] for h in held])
            sizes, flat = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
            pieces, used = plan(sizes, capacity)
            doc, start, length, seq, offset = pieces.T
            at = (np.cumsum(sizes) - sizes)[doc] + start
            data = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (sizes[doc], seq + first, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            first += used
            held.clear()
            return out

        for b in batches:
            for i, j, ids, n in enc.blocks(b.column(1).to_pylist()):
                held.append((b.column(0).slice(i, j - i), np.insert(ids, np.cumsum(n), end_id), n + 1))
                total += len(held[-1][1])
                if total >= BLOCK_IDS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return pairs(df, key, text).mapInArrow(run, SCHEMA)
