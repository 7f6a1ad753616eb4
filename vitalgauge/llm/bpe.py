"""Byte pair encoding as a deterministic automaton over tokens.

The merge list is compiled by adding one gadget per merge, in rank order.  Before
any merge every token may follow every other one.  The gadget of merge ``r``,
``(u, v) -> w``, splits the state reached by ``u``: the copy loses its arc ``v``,
and every state with an arc ``u`` gains an arc ``w`` that ends where ``v`` ended.
So the state after a token is the state of its right part at the time of its merge
plus the arcs it lost later, and an arc ``w`` exists where its left part's arc
existed at that time.  The automaton is held in that form (merge table, left and
right part of each token, rank of each gadget), which is linear in the merge list,
and the existence of one arc is read off the two spines (:meth:`Automaton.arc`).  The states
are not written out one by one; tests hold ``arc`` against an automaton whose gadgets are
built explicitly, one after another (:func:`gadget_arcs`).

The automaton accepts exactly one token path for each byte string.  Encoding walks
the bytes of many words side by side through a goto table over the arc labels
(tokens); at each byte the one token is kept whose label ends there and whose arc
leaves the state of the token before it.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(-1)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return {k: out[k] for k in sorted(out)}


class PairTable:
    """Open-addressed map from two token ids to an int32; -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray, bits: int = 18):
        while len(left) * 3 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.vals = np.full(1 << bits, -1, np.int32)
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            put = first[free[first]]
            self.keys[s[put]], self.vals[s[put]] = keys[todo[put]], value[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.vals[slot], _NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            s = (slot[todo] + 1) & self.mask
            slot[todo] = s
            found = self.keys[s]
            hit = found == keys[todo]
            out[todo[hit]] = self.vals[s[hit]]
            todo = todo[~hit & (found >= 0)]
        return out


class Automaton:
    """Compiled merges.  ``labels`` has the bytes of each token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.size = n
        chars, end = byte_symbols(), 256 if self.suffix else 0
        self.texts = [""] * n
        for text, i in [*vocab.items(), *self.special.items()]:
            self.texts[i] = text
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.rank = np.full(n, -1, np.int32)  # of the gadget that added the arc; -1: a byte
        a, b, w = (np.empty(len(merges), np.int32) for _ in range(3))
        symbols: dict[int, tuple[int, ...]] = {}
        for text, i in vocab.items():
            if len(text) == 1:
                symbols[i] = (chars[text],)
            elif self.suffix and len(text) == 1 + len(self.suffix) and text.endswith(self.suffix):
                symbols[i] = (chars[text[0]] + end,)
        for r, (u, v) in enumerate(merges):
            a[r], b[r] = vocab[u], vocab[v]
            w[r] = vocab[(u.removesuffix(self.suffix) if self.suffix else u) + v]
            if self.rank[w[r]] < 0 and w[r] not in symbols:
                symbols[int(w[r])] = symbols[int(a[r])] + symbols[int(b[r])]
                self.left[w[r]], self.right[w[r]], self.rank[w[r]] = a[r], b[r], r
            else:
                raise ValueError("two merges make the same token")
        self.gadgets = PairTable(a, b, np.arange(len(merges), dtype=np.int32))
        self.seen = np.full(1 << 19, -1, np.int64)  # arcs looked up lately, with the answer in the lowest bit
        self.length = np.zeros(n, np.int32)
        for i, s in symbols.items():
            self.length[i] = len(s)
        self._goto(symbols, 256 + end)
        self.symbols = 256 + end
        self._drop_unreachable(symbols)
        raw = [t.encode() for t in self.texts]
        self.text_len = np.array([len(x) for x in raw], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_len)])[:-1]
        self.text_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _goto(self, symbols: dict[int, tuple[int, ...]], width: int) -> None:
        """Goto and failure tables over the labels, and the labels that end in each node."""
        step: dict[int, int] = {}
        depth_nodes: list[list[tuple[int, int, int]]] = []
        token, nodes = [-1], 1
        for i, s in symbols.items():
            at = 0
            for d, c in enumerate(s):
                key = at * width + c
                to = step.get(key)
                if to is None:
                    to = step[key] = nodes
                    nodes += 1
                    token.append(-1)
                    while len(depth_nodes) <= d:
                        depth_nodes.append([])
                    depth_nodes[d].append((at, c, to))
                at = to
            token[at] = i
        fail = [0] * nodes
        for d, level in enumerate(depth_nodes):
            for at, c, to in level:
                f = at
                while d and f:
                    f = fail[f]
                    x = step.get(f * width + c)
                    if x is not None:
                        fail[to] = x
                        break
        ends = [0] * nodes  # the node itself or its nearest suffix that is a label
        after = [0] * nodes
        for level in depth_nodes:
            for _, _, to in level:
                ends[to] = to if token[to] >= 0 else ends[fail[to]]
                after[to] = ends[fail[to]]
        self.node_token = np.array(token, np.int32)
        self.fail, self.ends, self.after = (np.array(x, np.int32) for x in (fail, ends, after))
        keys = np.fromiter(step.keys(), np.int64, len(step))
        self.steps = PairTable(keys // width, keys % width, np.fromiter(step.values(), np.int32, len(step)))
        self.start = np.zeros(width, np.int32)
        for c in range(width):
            self.start[c] = step.get(c, 0)

    def _drop_unreachable(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """A label whose own halves never meet in an encoding is no candidate."""
        t = np.array([i for i in symbols if self.rank[i] >= 0], np.int64)
        # the halves' boundary must be free of arcs until the token's own gadget
        ok = self.arc(self.left[t], self.right[t], until=self.rank[t])
        while True:  # a half may itself be unreachable
            bad = np.zeros(self.size, bool)
            bad[t[~ok]] = True
            more = bad[self.left[t]] | bad[self.right[t]]
            if not (more & ok).any():
                break
            ok &= ~more
        bad = np.zeros(self.size + 1, bool)
        bad[t[~ok]] = True
        if bad.any():
            self.node_token[bad[self.node_token]] = -1
            for n in range(1, len(self.ends)):
                for x in (self.ends, self.after):
                    while x[n] and self.node_token[x[n]] < 0:
                        x[n] = self.ends[self.fail[x[n]]]

    def arc(self, first: np.ndarray, then: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether token ``then`` may follow token ``first``.

        Walks back through time: the pair on both sides of the boundary may not have
        a gadget older than the one that took either of them into a longer token.
        """
        first, then = first.astype(np.int32), then.astype(np.int32)
        out = np.ones(len(first), bool)
        limit = np.full(len(first), 1 << 30, np.int32) if until is None else until.astype(np.int32)
        at = np.arange(len(first))
        while len(at):
            r = self.gadgets.get(first, then)
            lost = (r >= 0) & (r < limit)
            out[at[lost]] = False
            x, y = self.rank[first], self.rank[then]
            go = ~lost & ((x >= 0) | (y >= 0))
            at, first, then, x, y = at[go], first[go], then[go], x[go], y[go]
            late = x > y  # the younger of the two is taken apart
            # a right part ties with an equal rank on its left: leftmost merges win
            limit = np.where(late, x, y + 1).astype(np.int32)
            first = np.where(late, self.right[first], first)
            then = np.where(late, then, self.left[then])
        return out

    def _arcs(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """:meth:`arc`, by way of a direct-mapped table of fixed size."""
        keys = (first.astype(np.int64) << 21) | (then.astype(np.int64) << 1)
        slot = ((keys.view(np.uint64) * _MULT) >> np.uint64(45)).astype(np.int64)
        got = self.seen[slot]
        out = (got & 1).astype(bool)
        new = np.flatnonzero((got | 1) != (keys | 1))
        if len(new):
            ok = self.arc(first[new], then[new])
            out[new] = ok
            self.seen[slot[new]] = keys[new] | ok
        return out

    def encode_words(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words: ``data`` is their bytes end to end.

        Returns the ids end to end and the number of ids of each word.
        """
        lens = lens.astype(np.int64)
        starts = np.cumsum(lens) - lens
        sym = data.astype(np.int64)
        if self.suffix:
            sym[(starts + lens - 1)[lens > 0]] += 256
        last = np.full(len(data), -1, np.int32)
        order = np.argsort(-lens, kind="stable")
        counts = np.bincount(lens, minlength=1)
        active = len(lens) - np.cumsum(counts)  # words longer than j
        state = np.zeros(len(lens), np.int32)
        for j in range(int(lens.max(initial=0))):
            n = int(active[j])
            word = order[:n]
            begin = starts[word]
            pos = begin + j
            s = sym[pos]
            if j:
                at, to = state[:n].copy(), np.empty(n, np.int32)
                todo = np.arange(n)
                while len(todo):
                    x = self.steps.get(at[todo], s[todo])
                    root = (x < 0) & (at[todo] == 0)
                    done = (x >= 0) | root
                    to[todo[done]] = np.where(root, 0, x)[done]
                    todo = todo[~done]
                    at[todo] = self.fail[at[todo]]
            else:
                to = self.start[s]
            state[:n] = to
            c = self.ends[to]
            todo = np.arange(n)
            while len(todo):
                node = c[todo]
                if not node.all():
                    raise ValueError("a byte has no token")
                t = self.node_token[node]
                before = pos[todo] - self.length[t]
                free = before < begin[todo]
                ok = free.copy()
                k = np.flatnonzero(~free)
                ok[k] = self._arcs(last[before[k]], t[k])
                last[pos[todo[ok]]] = t[ok]
                todo = todo[~ok]
                c[todo] = self.after[node[~ok]]
        # back along the arcs
        n_ids = np.zeros(len(lens), np.int64)
        at, word = starts + lens - 1, np.flatnonzero(lens > 0)
        at = at[word]
        trail: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            t = last[at]
            trail.append((word, t))
            n_ids[word] += 1
            at = at - self.length[t]
            go = at >= starts[word]
            at, word = at[go], word[go]
        ids = np.empty(int(n_ids.sum()), np.uint32)
        end = np.cumsum(n_ids) - 1
        for k, (word, t) in enumerate(trail):
            ids[end[word] - k] = t
        return ids, n_ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one space between them, as UTF-8."""
        if not len(ids):
            return b""
        n = self.text_len[ids] + 1
        out = np.full(int(n.sum()), 32, np.uint8)
        end = np.cumsum(n)
        take = n - 1
        k = np.arange(int(take.sum()))
        first = np.cumsum(take) - take
        within = k - np.repeat(first, take)
        out[within + np.repeat(end - n, take)] = self.text_bytes[within + np.repeat(self.text_at[ids], take)]
        return out[:-1].tobytes()


def gadget_arcs(symbols: int, merges: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """The pairs (token, token) of which the second may follow the first, by building each gadget.

    A state for each token that was read last; ``merges`` are (left, right, made) in rank order.
    Quadratic in the tokens, for small lists.
    """
    start = -1  # the state before the first token
    arcs: dict[int, set[int]] = {q: set(range(symbols)) for q in [start, *range(symbols)]}
    for u, v, w in merges:
        after = set(arcs[v])  # what may follow v may follow w
        met = v in arcs[u]
        arcs[u].discard(v)  # the copy of the state after u that has lost its arc v
        for out in arcs.values():
            if met and u in out:
                out.add(w)
        arcs[w] = after | ({w} if met and u in after else set())
    return {(q, t) for q, out in arcs.items() for t in out if q != start}
