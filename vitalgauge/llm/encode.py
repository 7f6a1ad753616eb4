"""Whole texts to token ids: pre-splitting, a bounded memo of words, the automaton.

Texts are cut into blocks of about :data:`BLOCK` characters.  In a block everything is
done with numpy over code points: classes, word boundaries, a 64-bit hash of each
word, and a look-up of the hash in a memo of words encoded before.  A word is held against
the memo's own letters, so one whose hash is another's is encoded by itself.  Words that are
not in the memo go to the automaton together.  The memo has a fixed capacity in words and in
letters; when it is full it is emptied, so memory is bounded and the result is the same.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from .bpe import Automaton

BLOCK = 400_000
MEMO_BITS, LETTERS = 21, 8 << 20
LETTER, NUMBER, OTHER, SPACE, EDGE = 0, 1, 2, 3, 4
_P = pow(0x5851F42D4C957F2D, 1, 1 << 64)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LETTER
        elif k == "N":
            kind[c] = NUMBER
    kind[_WHITE] = SPACE
    return kind


@cache
def lower_case() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class Powers:
    """Hashes of many slices of one array, by sums of powers modulo 2**64."""

    def __init__(self, multiplier: int = _P):
        self.p, self.q = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.p), ("down", self.q)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def slices(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """values: 64-bit, already mixed."""
        n = len(values)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


class Encoder:
    """``encode(texts)`` gives, for each text, the ids that the tokenizers library gives
    with ``add_special_tokens=False``.  A null counts as an empty text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.auto = Automaton(path)
        self.words_only = spec["pre_tokenizer"]["type"] == "Sequence"
        if not self.words_only and not spec["pre_tokenizer"].get("use_regex"):
            raise ValueError("an unknown way to split text")
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.auto.special, key=len, reverse=True)))
        self.powers = Powers()
        self.kind = classes()
        self.values = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.low = lower_case() if self.words_only else None
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << MEMO_BITS, np.uint64)
        self.entry = np.zeros(1 << MEMO_BITS, np.int32)
        self.used = 0
        self.at, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.store, self.stored = np.zeros(1 << 18, np.uint16), 0
        self.letters, self.lettered = np.zeros(1 << 18, np.uint32), 0
        self.letter_at, self.letter_count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The memo's entry of each hash, or -1."""
        mask = (1 << MEMO_BITS) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.entry[slot], np.int32(-1))
        todo = np.flatnonzero((found != h) & (found != 0))
        while len(todo):
            s = (slot[todo] + 1) & mask
            slot[todo] = s
            found = self.keys[s]
            hit = found == h[todo]
            out[todo[hit]] = self.entry[s[hit]]
            todo = todo[~hit & (found != 0)]
        return out

    def _add(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes words and keeps their ids and letters; the places of their entries."""
        line = cp.tobytes().decode("utf-32-le")
        words = [line[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        raw = [w.encode() for w in words]
        ids, n_ids = self.auto.encode_words(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
        letters, size = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), end - start
        first, n = self.used, len(words)
        while len(self.at) < first + n:
            size_now = 2 * len(self.at)
            for name in ("at", "count", "letter_at", "letter_count"):
                setattr(self, name, np.resize(getattr(self, name), size_now))
        while len(self.store) < self.stored + len(ids):
            self.store = np.resize(self.store, 2 * len(self.store))
        while len(self.letters) < self.lettered + len(letters):
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        new = slice(first, first + n)
        self.store[self.stored : self.stored + len(ids)] = ids
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        self.at[new], self.count[new] = self.stored + np.cumsum(n_ids) - n_ids, n_ids
        self.letter_at[new], self.letter_count[new] = self.lettered + np.cumsum(size) - size, size
        self.stored, self.lettered, self.used = self.stored + len(ids), self.lettered + len(letters), first + n
        return np.arange(first, first + n)

    def _strangers(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The words whose entry has other letters than they have."""
        size = end - start
        known = self.letter_count[found]
        out = known != size
        n = np.where(out, 0, size)
        last = np.cumsum(n)
        place = np.arange(int(last[-1]) if len(last) else 0, dtype=np.int32)
        place += np.repeat((start - (last - n)).astype(np.int32), n)
        differ = cp[place]
        place += np.repeat((self.letter_at[found] - start).astype(np.int32), n)
        differ = differ != self.letters[place]
        if differ.any():
            out[np.searchsorted(last, np.flatnonzero(differ), side="right")] = True
        return np.flatnonzero(out)

    def _learn(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << MEMO_BITS) - 1
        slot, todo = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == 0
            _, lead = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            put = lead[free[lead]]
            self.keys[s[put]], self.entry[s[put]] = h[todo[put]], entries[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & mask

    def _pieces(self, cp: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a block; edges: the places of its separators."""
        kind = self.kind[cp]
        kind[edges] = EDGE
        n = len(cp)
        change = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        begin = change.copy()
        space, other = kind == SPACE, kind == OTHER
        blank = np.zeros(n, bool)  # a character right after U+0020
        if self.words_only:
            begin |= kind == NUMBER
        else:
            blank[1:] = (cp[:-1] == 32) & space[:-1]
            tail = np.zeros(n, bool)  # the last white space before something else
            tail[:-1] = space[:-1] & ~space[1:] & (kind[1:] != EDGE)
            begin |= tail
            begin &= ~(blank & change & ~space & (kind != EDGE))
        mark = np.flatnonzero(other & (cp == 39) & begin)  # an apostrophe that begins a piece
        if len(mark):
            far = cp.take(np.arange(1, 3)[:, None] + mark, mode="clip")
            edge = kind.take(np.arange(1, 3)[:, None] + mark, mode="clip") != LETTER
            far = np.where(edge, 0, far)
            one = np.isin(far[0], [ord(c) for c in "stmd"])
            two = np.zeros(len(mark), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (far[0] == ord(a)) & (far[1] == ord(b))
            for size, which in ((1, one), (2, two)):
                m = mark[which]
                begin[m + 1] = False
                after = m + 1 + size
                after = after[after < n]
                begin[after[kind[after] == LETTER]] = True
        begin[edges] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        drop = kind[start] == EDGE
        if self.words_only:
            drop |= kind[start] == SPACE
        return start[~drop], end[~drop], kind

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.cumsum(lens + 1) - 1
        if self.words_only:
            high = np.maximum.reduceat(((cp >= 0x300) | (cp == 0x130)).view(np.uint8), edges - lens) > 0
            if high.any():
                for i in np.flatnonzero(high):
                    t = unicodedata.normalize("NFC", texts[i])
                    texts[i] = t.replace("İ", "i̇")
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
                edges = np.cumsum(lens + 1) - 1
            cp = self.low[cp]
        start, end, _ = self._pieces(cp, edges)
        h = self.powers.slices(self.values[cp], start, end)
        h |= h == 0
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            hashes, first = np.unique(h[new], return_index=True)
            if self.used + len(hashes) > (1 << MEMO_BITS) // 2 or self.lettered > LETTERS or self.stored > LETTERS:
                self._clear()
                new = np.arange(len(h))
                hashes, first = np.unique(h, return_index=True)
            first = new[first]
            self._learn(hashes, self._add(cp, start[first], end[first]))
            found[new] = self._find(h[new])
        odd = self._strangers(cp, start, end, found)
        if len(odd):
            found[odd] = self._add(cp, start[odd], end[odd])
        n = self.count[found].astype(np.int64)
        ends = np.cumsum(n)
        take = np.repeat(self.at[found] - (ends - n), n) + np.arange(int(n.sum()))
        ids = self.store[take]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, edges)]
        return ids, np.diff(upto, prepend=0)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first, last + 1, ids end to end as uint16, ids of each text)."""
        i = 0
        while i < len(texts):
            block, size, j = [], 0, i
            while j < len(texts) and (not block or size + len(texts[j] or "") <= BLOCK):
                block.append(texts[j] or "")
                size += len(block[-1])
                j += 1
            yield i, j, *self._with_special(block)
            i = j

    def _with_special(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any("<|" in t and self.special.search(t) for t in block):
            return self._block(block)
        parts, owner, marks = [], [], []  # marks: the id that follows each part, or -1
        for k, t in enumerate(block):
            at = 0
            for m in self.special.finditer(t):
                parts.append(t[at : m.start()])
                owner.append(k)
                marks.append(self.auto.special[m[0]])
                at = m.end()
            parts.append(t[at:])
            owner.append(k)
            marks.append(-1)
        ids, n = self._block(parts)
        cuts = np.split(ids, np.cumsum(n)[:-1])
        out, sizes = [], np.zeros(len(block), np.int64)
        for k, x, m in zip(owner, cuts, marks, strict=True):
            out.append(x)
            sizes[k] += len(x)
            if m >= 0:
                out.append(np.array([m], np.uint16))
                sizes[k] += 1
        return np.concatenate(out), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, ids, n in self.blocks(texts):
            out += np.split(ids, np.cumsum(n)[:-1])
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
