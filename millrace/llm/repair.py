"""Re-Pair grammars of many token sequences at once, in numpy.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol, a rule, again and again. Here every
round replaces each pair that is more frequent than both neighbouring pairs (ties by a hash of what the pairs stand
for), so that a grammar of n tokens takes some log n rounds. Pairs are counted within each sequence, or over all
sequences of the call. Where pairs occur once, frequency has no say any more; ``finish`` goes on by the hashes alone, up
to one symbol a sequence. A rule's hash depends only on the tokens it stands for: equal stretches get equal rules in any
sequence and any call, apart from their edges, so that uses of a rule can be counted over a whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed mix of the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass
class Grammars:
    """Rules in the order they were made, and the symbols that were left when frequency had no say any more.

    Per use of a rule: ``of`` its sequence, ``hash`` and ``size`` of the tokens it stands for, ``uses`` its frequency when
    it was made (1 where hashes decided), ``above`` the use it went into (-1: none). Per sequence: ``tokens``; tokens
    ``covered`` by symbols of at least two tokens while frequency decided; those ``marked``: in such symbols that hold
    one of the marked tokens.
    """

    tokens: np.ndarray
    covered: np.ndarray
    marked: np.ndarray
    of: np.ndarray
    hash: np.ndarray
    size: np.ndarray
    uses: np.ndarray
    above: np.ndarray


def _counts(key: np.ndarray) -> np.ndarray:
    """How often each key occurs, at each of its places."""
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.cumsum(new) - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _chosen(at: np.ndarray, count: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """First places of the pairs to replace: stronger than both neighbours; of a run of one pair every second, from the left."""
    f, v = np.full(m + 1, -1, np.int64), np.zeros(m + 1, np.uint64)
    f[at], v[at] = count, value
    before = at - 1
    fb, vb = np.where(before >= 0, f[before], -1), np.where(before >= 0, v[before], 0)
    fa, va = f[at + 1], v[at + 1]
    over_before, over_after = (count > fb) | ((count == fb) & (value > vb)), (count > fa) | ((count == fa) & (value > va))
    like_before, like_after = (count == fb) & (value == vb), (count == fa) & (value == va)
    chosen = at[over_before & over_after]
    inside = like_before | like_after
    run = at[inside]
    if len(run):
        first, last = ~like_before[inside], ~like_after[inside]
        start = np.maximum.accumulate(np.where(first, run, 0))
        block = np.cumsum(first) - 1
        good = np.ones(block[-1] + 1, bool)
        np.logical_and.at(good, block, (~first | over_before[inside]) & (~last | over_after[inside]))
        chosen = np.union1d(chosen, run[good[block] & ((run - start) % 2 == 0)])
        chosen = chosen[np.concatenate([[True], np.diff(chosen) > 1])]
    return chosen


def _powers(sizes: np.ndarray) -> np.ndarray:
    """The base to the power of each size, modulo 2^64."""
    return np.cumprod(np.full(sizes.max(initial=1), _BASE, np.uint64))[sizes - 1]


def infer(hashes: np.ndarray, owner: np.ndarray, sequences: int, together: bool = False, finish: bool = False, mark: int | None = None) -> Grammars:
    """Grammars of ``sequences`` sequences; ``hashes``: the tokens as 64-bit words, ``owner``: the sequence of each, ascending.

    ``together``: pairs are counted over all sequences, else in each. ``finish``: see above. ``mark``: the marked token.
    No rule goes over the end of a sequence; empty sequences and no sequences at all are fine.
    """
    tokens = np.bincount(owner, minlength=sequences)
    h, n, own = hashes.astype(np.uint64), np.ones(len(hashes), np.int64), owner.astype(np.int64)
    holds = h == np.uint64(mark) if mark is not None else np.zeros(len(h), bool)
    use = np.full(len(h), -1, np.int64)
    made: list[tuple[np.ndarray, ...]] = []
    links: list[tuple[np.ndarray, np.ndarray]] = []
    total, by_count = 0, True
    covered = marked = np.zeros(sequences, np.int64)
    with np.errstate(over="ignore"):
        while True:
            m = len(h)
            at = np.flatnonzero(own[1:] == own[:-1]) if m > 1 else np.zeros(0, np.int64)
            whole = h[at] * _powers(n[at + 1]) + h[at + 1]
            value = scrambled(whole)
            count = np.ones(len(at), np.int64)
            if by_count and len(at):
                count = _counts(value if together else scrambled(value ^ own[at].astype(np.uint64) * np.uint64(_BASE)))
                again = count >= 2
                at, value, whole, count = at[again], value[again], whole[again], count[again]
            chosen = _chosen(at, count, value, m) if len(at) else at
            if not len(chosen):
                if not by_count:
                    break
                by_count = False
                covered = np.bincount(own, np.where(n >= 2, n, 0), sequences).astype(np.int64)
                marked = np.bincount(own, np.where((n >= 2) & holds, n, 0), sequences).astype(np.int64)
                if not finish:
                    break
                continue
            k = np.searchsorted(at, chosen)
            ids = total + np.arange(len(chosen))
            total += len(chosen)
            size = n[chosen] + n[chosen + 1]
            made.append((own[chosen], value[k], size, count[k]))
            for child in (use[chosen], use[chosen + 1]):
                links.append((child[child >= 0], ids[child >= 0]))
            h[chosen], n[chosen], use[chosen] = whole[k], size, ids
            holds[chosen] |= holds[chosen + 1]
            stay = np.ones(m, bool)
            stay[chosen + 1] = False
            h, n, own, use, holds = h[stay], n[stay], own[stay], use[stay], holds[stay]
    above = np.full(total, -1, np.int64)
    for child, parent in links:
        above[child] = parent
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    of, hash_, size, uses = (np.concatenate(c) for c in zip(empty, *made))
    return Grammars(tokens, covered, marked, of, hash_, size, uses, above)
