"""Byte-level BPE in numpy, exact, for a public vocabulary.

Text is split into words by the vocabulary's pattern with array operations over all code points of a batch. Equal words
are encoded once: words of up to 16 bytes are found in an open-addressing table whose keys hold all their bytes, longer
ones in a dictionary. Words not seen before go through the merge loop together: padded matrices, one per length bucket,
in which every row merges its leftmost pair of least rank each round, the ranks looked up in a hash table of pairs;
finished rows are compacted away. Words too long for a matrix take a heap over linked positions with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Rank that no pair has.
NO_RANK = np.int64(1 << 40)
#: Widest matrix; longer words are encoded one by one.
WIDEST = 256
#: Words kept between batches; the table starts anew beyond (results do not depend on it).
CACHE_WORDS = 400_000

# Code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings split off after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@dataclass(frozen=True)
class Vocabulary:
    """Ids of the single bytes and the merges (left id, right id) -> id, in order of rank."""

    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: a printable byte is itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    """A vocabulary from a tokenizers file (.json, with its merges) or a rank file (.tiktoken)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names, vocab = _byte_names(), model["vocab"]
        byte_ids = np.zeros(256, np.int32)
        for name, b in names.items():
            byte_ids[b] = vocab[name]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rows = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = []
        for word, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(word) > 1:
                a, b = _last_merge(ranks, word, rank)
                rows.append((ranks[a], ranks[b], rank))
    left, right, merged = (np.array(c, np.int32) for c in zip(*rows))
    return Vocabulary(byte_ids, left, right, merged)


def _last_merge(ranks: dict[bytes, int], word: bytes, limit: int) -> tuple[bytes, bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 2:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
        if best[0] >= limit:
            raise ValueError(f"no merge leads to {word!r}")
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank and id of its merge."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        n = len(vocabulary.left)
        self.bits = max(4, int(np.ceil(np.log2(max(2, 8 * n)))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int64)
        self.ids = np.full(size, -1, np.int32)
        keys = (vocabulary.left.astype(np.int64) << 20) | vocabulary.right
        pending, at = np.arange(n), self._slot(keys)
        self.probes = 0
        while len(pending):
            self.probes += 1
            free = self.keys[at[pending]] < 0
            slots, first = np.unique(at[pending[free]], return_index=True)
            won = pending[free][first]
            self.keys[slots], self.ranks[slots], self.ids[slots] = keys[won], won, vocabulary.merged[won]
            lost = np.ones(n, bool)
            lost[won] = False
            pending = pending[lost[pending]]
            at[pending] = (at[pending] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NO_RANK where there is no merge or an id is negative."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._slot(keys)
        found = self.keys[at]
        ok = found == keys
        slot = at.copy()
        open_ = ~ok & (found >= 0)
        for _ in range(self.probes):
            if not open_.any():
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            ok |= open_ & (found == keys)
            open_ &= ~ok & (found >= 0)
        ok &= (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[slot], NO_RANK), np.where(ok, self.ids[slot], -1)


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges to the rows of ``ids`` (padded with -1): (matrix, lengths)."""
    rows, width = ids.shape
    out, lengths = ids.copy(), (ids >= 0).sum(axis=1)
    live, m = np.arange(rows), ids.copy()
    while len(live) and m.shape[1] > 1:
        rank, new = pairs.lookup(m[:, :-1], m[:, 1:])
        at = rank.argmin(axis=1)  # the leftmost of the least
        each = np.arange(len(m))
        open_ = rank[each, at] < NO_RANK
        if not open_.all():
            done = ~open_
            out[live[done], : m.shape[1]] = m[done]
            out[live[done], m.shape[1] :] = -1
            live, m, at, new = live[open_], m[open_], at[open_], new[open_]
            each = np.arange(len(m))
            if not len(live):
                break
        m[each, at] = new[each, at]
        column = np.arange(m.shape[1] - 1)
        take = column + (column[None, :] > at[:, None])
        m = np.take_along_axis(m, take, axis=1)
        filled = int((m >= 0).sum(axis=1).max())
        m = m[:, :filled]
    if len(live):
        out[live, : m.shape[1]] = m
        out[live, m.shape[1] :] = -1
    return out, (out >= 0).sum(axis=1)


def merge_long(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """All merges of one long word: a heap of (rank, position) over linked positions."""
    n = len(ids)
    tok, nxt, prev, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r[0], i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := pairs.get((tok[i], tok[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or tok[i] != a or tok[j] != b:
            continue
        tok[i] = pairs[a, b][1]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if r := pairs.get((tok[i], tok[nxt[i]])):
                heapq.heappush(heap, (r[0], i, tok[i], tok[nxt[i]]))
        if prev[i] >= 0:
            p = prev[i]
            if r := pairs.get((tok[p], tok[i])):
                heapq.heappush(heap, (r[0], p, tok[p], tok[i]))
    return [t for t, ok in zip(tok, alive) if ok]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def word_starts(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions in ``cps`` where a word of the splitting pattern starts; texts begin at ``starts``."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cps]
    head = np.zeros(n, bool)
    head[starts[starts < n]] = True
    change = head.copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last blank before something, in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (cps[:-1] == 0x20) & ~head[1:]
    begin = last | (change & ~(after_blank & ~space))
    marks = np.flatnonzero((cps == 0x27) & begin)
    if len(marks):
        padded = np.append(cps, np.zeros(3, cps.dtype))
        ends = np.append(head, [True] * 4)
        for tail in CONTRACTIONS:
            size = len(tail)
            hit = np.ones(len(marks), bool)
            for k, ch in enumerate(tail, 1):
                hit &= (padded[marks + k] == ord(ch)) & ~ends[marks + k]
            at = marks[hit]
            begin[at + 1] = False
            rest = at[(at + size + 1 < n)] + size + 1
            more = rest[(kind[rest] == LETTER) & ~head[rest]]
            begin[more] = True
            marks = marks[~hit]
    return np.flatnonzero(begin)


class Encoder:
    """Encodes batches of texts; keeps the words it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pairs = vocabulary, PairTable(vocabulary)
        self._long_pairs: dict[tuple[int, int], tuple[int, int]] | None = None
        self._reset()

    def _reset(self) -> None:
        self.bits = 12
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.k1, self.k2, self.n = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)
        self.long: dict[bytes, int] = {}
        self.words = 0
        self.lengths, self.offsets, self.flat, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def encode_new(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the merge loop in buckets of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.array([len(w) for w in words])
        buckets = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for b in np.unique(buckets):
            at = np.flatnonzero(buckets == b)
            if sizes[at].max() > WIDEST:
                if self._long_pairs is None:
                    v = self.vocabulary
                    self._long_pairs = {(int(x), int(y)): (k, int(z)) for k, (x, y, z) in enumerate(zip(v.left, v.right, v.merged))}
                for i in at:
                    out[i] = np.array(merge_long([int(self.vocabulary.byte_ids[c]) for c in words[i]], self._long_pairs), np.int32)
                continue
            width = int(sizes[at].max())
            matrix = np.full((len(at), width), -1, np.int32)
            matrix[np.arange(width)[None, :] < sizes[at][:, None]] = self.vocabulary.byte_ids[np.frombuffer(b"".join(words[i] for i in at), np.uint8)]
            merged, lengths = merge_matrix(matrix, self.pairs)
            for k, i in enumerate(at):
                out[i] = merged[k, : lengths[k]]
        return out

    def _store(self, encoded: list[np.ndarray]) -> np.ndarray:
        """Numbers of new words."""
        first, m = self.words, len(encoded)
        sizes = np.array([len(e) for e in encoded], np.int32)
        while first + m > len(self.lengths):
            self.lengths, self.offsets = (np.concatenate([a, np.zeros_like(a)]) for a in (self.lengths, self.offsets))
            self.k1, self.k2, self.n = (np.concatenate([a, np.zeros_like(a)]) for a in (self.k1, self.k2, self.n))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lengths[first : first + m] = sizes
        self.offsets[first : first + m] = self.used + np.cumsum(sizes) - sizes
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(encoded)
        self.used += total
        self.words += m
        return np.arange(first, first + m)

    @staticmethod
    def _hash(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = k1 * np.uint64(0x9E3779B97F4A7C15) ^ (k2 + n) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def _find(self, h: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Number of each short word, -1 where unknown."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        same = (found >= 0) & (self.k1[found] == k1) & (self.k2[found] == k2) & (self.n[found] == n)
        result = np.where(same, found, -1)
        open_ = np.flatnonzero(~same & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            f = self.slots[at[open_]]
            same = (f >= 0) & (self.k1[f] == k1[open_]) & (self.k2[f] == k2[open_]) & (self.n[f] == n[open_])
            result[open_[same]] = f[same]
            open_ = open_[~same & (f >= 0)]
        return result

    def _insert(self, numbers: np.ndarray) -> None:
        h = self._hash(self.k1[numbers], self.k2[numbers], self.n[numbers].astype(np.uint64))
        pending, at = numbers, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(pending):
            free = self.slots[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            self.slots[slots] = pending[free][first]
            placed = np.zeros(len(pending), bool)
            placed[np.flatnonzero(free)[first]] = True
            pending, at = pending[~placed], (at[~placed] + 1) & (len(self.slots) - 1)

    def word_numbers(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word, words given as places in the bytes ``data`` (which ends in 16 zero bytes)."""
        if self.words > CACHE_WORDS:
            self._reset()
        numbers = np.full(len(begin), -1, np.int64)
        eight = np.ndarray((len(data) - 8,), np.dtype("<u8"), buffer=data, strides=(1,))
        short = np.flatnonzero(size <= 16)
        b, n = begin[short], size[short].astype(np.uint64)
        k1 = eight[b]
        small = n < 8
        k1[small] &= (np.uint64(1) << (np.uint64(8) * n[small])) - np.uint64(1)
        k2 = np.where(small, np.uint64(0), eight[np.maximum(b + size[short] - 8, 0)])
        h = self._hash(k1, k2, n)
        got = self._find(h, k1, k2, n)
        unknown = np.flatnonzero(got < 0)
        while len(unknown):
            _, first = np.unique(h[unknown], return_index=True)
            rep = unknown[first]
            words = [data[s : s + z].tobytes() for s, z in zip(b[rep].tolist(), n[rep].tolist())]
            new = self._store(self.encode_new(words))
            self.k1[new], self.k2[new], self.n[new] = k1[rep], k2[rep], n[rep]
            if 2 * self.words > len(self.slots):
                while 2 * self.words > (1 << self.bits):
                    self.bits += 1
                self.slots = np.full(1 << self.bits, -1, np.int32)
                self._insert(np.flatnonzero(self.n[: self.words] > 0))
            else:
                self._insert(new)
            got[unknown] = self._find(h[unknown], k1[unknown], k2[unknown], n[unknown])
            unknown = unknown[got[unknown] < 0]
        numbers[short] = got
        far = np.flatnonzero(size > 16)
        if len(far):
            words = [data[s : s + z].tobytes() for s, z in zip(begin[far].tolist(), size[far].tolist())]
            fresh = list({w for w in words if w not in self.long})
            if fresh:
                new = self._store(self.encode_new(fresh))
                self.n[new] = 0
                self.long.update(zip(fresh, new.tolist()))
            numbers[far] = [self.long[w] for w in words]
        return numbers

    def split(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, word lengths in ids, words per text) of the texts data[offsets[i]:offsets[i+1]]."""
        raw = np.frombuffer(data + bytes(16), np.uint8)
        body = raw[: len(data)]
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(texts, np.int64)
        if body.max() < 0x80:
            cps, place = body.astype(np.uint32), None
            heads = offsets[:-1]
        else:
            cps = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
            lead = (body & 0xC0) != 0x80
            place = np.flatnonzero(lead)
            heads = np.searchsorted(place, offsets[:-1])
        begin = word_starts(cps, np.asarray(heads))
        if place is not None:
            begin = place[begin]
        size = np.diff(np.append(begin, len(data)))
        numbers = self.word_numbers(raw, begin, size)
        words = np.diff(np.searchsorted(begin, offsets))
        return numbers, self.lengths[numbers], words

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        numbers, lengths, words = self.split(data, offsets)
        total = int(lengths.sum())
        ends = np.cumsum(lengths, dtype=np.int64)
        ids = self.flat[np.repeat(self.offsets[numbers] - (ends - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(words)])
        sums = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(sums)

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        _, lengths, words = self.split(data, offsets)
        sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], np.cumsum(words)])])
