"""Prediction by partial matching over bytes: frozen context trees that give exact code lengths.

One tree per class (language). A tree counts which byte follows which context of up to ``order`` bytes; contexts start
at the blank before a word and never reach over it, so the code length of a word depends on the word alone and each
distinct word is scored once; contexts that reach over blanks were tried and tell held-out pieces of lines apart no better. Escapes follow method C: in a context seen n times with d different successors, a known
byte has probability c / (n + d), anything else escapes with d / (n + d) to the context one byte shorter; below order 0
all 256 bytes and the end are equally likely. Statistics are frozen after training: scoring never changes them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import xxhash

#: Longest context in bytes.
ORDER = 5
_UNIFORM = 1.0 / 257


def _keys(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context key, context-and-byte key, word number) of every position of " word " that has ``order`` bytes before it.

    Keys hold the bytes themselves (up to 7), so no two contexts share one.
    """
    data = b"".join(b" " + w + b" " for w in words)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(begin, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(place >= max(order, 1))  # the first blank is context only
    ctx = np.zeros(len(at), np.uint64)
    for k in range(order, 0, -1):
        ctx = (ctx << np.uint64(8)) | raw[at - k]
    return ctx, (ctx << np.uint64(8)) | raw[at], owner[at] * (1 << 32) + place[at]


class Model:
    """Frozen trees of several classes, as sorted key arrays with one column per class."""

    def __init__(self, classes: list[str], texts: dict[str, Iterable[bytes]], order: int = ORDER) -> None:
        """``texts``: for each class its words, repeats counting."""
        self.classes, self.order = classes, order
        counts = {c: Counter(texts.get(c, ())) for c in classes}
        self.levels = []
        for k in range(order + 1):
            contexts: list[np.ndarray] = []
            successors: list[np.ndarray] = []
            tallies = []
            for c in classes:
                words, weight = list(counts[c]), np.array(list(counts[c].values()), np.float64)
                ctx, sym, owner = _keys(words, k) if words else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
                w = weight[owner >> 32] if words else np.zeros(0)
                s, inv = np.unique(sym, return_inverse=True)
                n = np.bincount(inv, w, len(s)) if len(s) else np.zeros(0)
                tallies.append((s, n))
                successors.append(s)
                contexts.append(ctx)
            sym_keys = np.unique(np.concatenate(successors)) if successors else np.zeros(0, np.uint64)
            c_sym = np.zeros((len(sym_keys) + 1, len(classes)), np.float32)
            for j, (s, n) in enumerate(tallies):
                c_sym[np.searchsorted(sym_keys, s), j] = n
            parent = sym_keys >> np.uint64(8)
            ctx_keys, inv = np.unique(parent, return_inverse=True)
            total = np.zeros((len(ctx_keys) + 1, len(classes)), np.float32)
            kinds = np.zeros_like(total)
            np.add.at(total, inv, c_sym[:-1])
            np.add.at(kinds, inv, (c_sym[:-1] > 0).astype(np.float32))
            self.levels.append((ctx_keys, total, kinds, sym_keys, c_sym))

    def mark(self) -> str:
        """A hash of the classes and all their counts: equal models have equal marks."""
        h = xxhash.xxh3_128(repr((self.classes, self.order)).encode())
        for level in self.levels:
            for a in level:
                h.update(np.ascontiguousarray(a).view(np.uint8).data)
        return h.hexdigest()

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word (with its end) in each class: (words, classes)."""
        out = np.zeros((len(words), len(self.classes)), np.float64)
        if not words:
            return out
        _, _, every = _keys(words, 0)
        p = np.full((len(every), len(self.classes)), _UNIFORM, np.float32)
        for k, (ctx_keys, total, kinds, sym_keys, c_sym) in enumerate(self.levels):
            if not len(ctx_keys):
                continue
            ctx, sym, where = _keys(words, k)
            rows = np.searchsorted(every, where)
            i = np.minimum(np.searchsorted(ctx_keys, ctx), len(ctx_keys) - 1)
            i = np.where(ctx_keys[i] == ctx, i, len(ctx_keys))
            j = np.minimum(np.searchsorted(sym_keys, sym), len(sym_keys) - 1)
            j = np.where(sym_keys[j] == sym, j, len(sym_keys))
            n, d, c = total[i], kinds[i], c_sym[j]
            whole = np.maximum(n + d, 1e-9)
            p[rows] = np.where(c > 0, c / whole, np.where(n > 0, d / whole * p[rows], p[rows]))
        np.add.at(out, every >> 32, -np.log2(p))
        return out
