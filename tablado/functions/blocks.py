"""All like and all contained texts of two blocks: exact, with bounds computed for a text against a whole block.

What is matched is in both texts, so the difference of their letters as multisets bounds the Indel likeness.
The counts of letters are written as bits (bit (c, m) says that letter c occurs at least m times), of which the
most telling are compared by exclusive or; any choice of them is a lower bound.  What passes is measured by a
bit-parallel longest common subsequence, many pairs at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

#: Classes of letters and the most of each that are told apart.
CLASSES, LEVELS = 64, 6
#: Words of 64 bits of a text's letters.
WORDS = 3
#: Bits of a hash by which runs of letters are looked up.
TABLE = 22
#: Pairs that are measured at once.
PAIRS = 32_768


class Block:
    """Texts in order of length, with their letters one after the other."""

    def __init__(self, keys: Iterable[int], texts: Iterable[str]) -> None:
        rows = sorted(zip(keys, texts, strict=True), key=lambda r: (len(r[1]), r[0]))
        self.keys = np.array([k for k, _ in rows], dtype=np.int64)
        self.texts = [t for _, t in rows]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.letters = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.owners = np.repeat(np.arange(len(self.texts)), self.lengths)

    def bits(self) -> np.ndarray:
        """Whether a text has a letter of each class at least once, twice and so on."""
        at = self.owners * CLASSES + (self.letters & (CLASSES - 1))
        counts = np.minimum(np.bincount(at, minlength=len(self.texts) * CLASSES), LEVELS).astype(np.uint8)
        return (counts.reshape(-1, CLASSES, 1) > np.arange(LEVELS, dtype=np.uint8)).reshape(-1, CLASSES * LEVELS)


def _sketches(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The most telling bits of both blocks' letters, a row of words for each text, most telling first."""
    x, y = a.bits(), b.bits()
    share = (x.sum(0) + y.sum(0)) / (len(x) + len(y))
    chosen = np.argsort(-share * (1 - share), kind="stable")[: 64 * WORDS]
    pack = lambda bits: np.ascontiguousarray(np.packbits(bits[:, chosen], axis=1)).view(np.uint64).T.copy()
    return pack(x), pack(y)


def _common(a: Block, b: Block, codes: tuple[np.ndarray, np.ndarray, int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Letters of the longest common subsequence of the texts ``i`` of ``a`` and ``j`` of ``b``."""
    ca, cb, size = codes
    rows, at = np.unique(i, return_inverse=True)
    words = max(1, -(-int(a.lengths[rows].max(initial=0)) // 64))
    masks = np.zeros((words, len(rows), size), dtype=np.uint64)  # the last code stands for no letter
    for n, r in enumerate(rows.tolist()):
        own = ca[a.starts[r] : a.starts[r + 1]]
        place = np.arange(len(own))
        np.bitwise_or.at(masks, (place >> 6, n, own), np.uint64(1) << (place & 63).astype(np.uint64))
    full = np.bitwise_or.reduce(masks, axis=2)
    row = [full[w][at] for w in range(words)]
    start, length = b.starts[j], b.lengths[j]
    for p in range(int(length.max(initial=0))):
        c = cb[np.where(p < length, start + p, len(cb) - 1)]
        carry = None
        for w in range(words):
            r = row[w]
            u = r & masks[w][at, c]
            s = r + u
            over = s < r
            if carry is not None:
                s2 = s + carry
                over |= s2 < s
                s = s2
            carry = over.astype(np.uint64)
            row[w] = s | (r & ~u)
    left = sum(np.bitwise_count(row[w] & full[w][at]).astype(np.int64) for w in range(words))
    return a.lengths[i] - left


def like(a: Block, b: Block, least: float) -> np.ndarray:
    """(place in a, place in b) of all texts with an Indel likeness (0 to 1) of ``least`` or more; those that
    are a rounding error below may be among them."""
    none = np.zeros((0, 2), dtype=np.int64)
    if not a.texts or not b.texts:
        return none
    x, y = _sketches(a, b)
    letters, found = np.unique(np.r_[a.letters, b.letters], return_inverse=True)
    codes = found[: len(a.letters)], np.r_[found[len(a.letters) :], len(letters)], len(letters) + 1
    ratio = least / (2 - least)
    out, waiting, n = [none], [], 0

    def measured() -> None:
        i = np.concatenate([np.full(len(js), k) for k, js in waiting])
        j = np.concatenate([js for _, js in waiting])
        for s in range(0, len(i), PAIRS):
            p, q = i[s : s + PAIRS], j[s : s + PAIRS]
            good = 2 * _common(a, b, codes, p, q) >= least * (a.lengths[p] + b.lengths[q]) - 1e-6
            out.append(np.stack([p[good], q[good]], axis=1))
        waiting.clear()

    last, lo, hi, most = -1, 0, 0, None
    for k, length in enumerate(a.lengths.tolist()):
        if length != last:
            last = length
            lo, hi = np.searchsorted(b.lengths, [math.floor(length * ratio - 1e-9), math.ceil(length / ratio + 1e-9) + 1]) if ratio > 0 else (0, len(b.texts))
            most = np.floor((1 - least) * (b.lengths[lo:hi] + length) + 1e-6).astype(np.int64)
            small = np.minimum(most, 255).astype(np.uint8)
        if lo == hi:
            continue
        near = np.bitwise_count(y[0, lo:hi] ^ x[0, k])
        js = np.flatnonzero(near <= small)
        if not len(js):
            continue
        total = near[js].astype(np.int64)
        for w in range(1, WORDS):
            total += np.bitwise_count(y[w, lo:hi][js] ^ x[w, k])
            good = total <= most[js]
            js, total = js[good], total[good]
        if len(js):
            waiting.append((k, js + lo))
            n += len(js)
            if n >= PAIRS:
                measured()
                n = 0
    if waiting:
        measured()
    return np.concatenate(out)


def _grams(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the text) of every run of ``size`` letters."""
    n = len(b.letters) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + b.letters[i : n + i]
    whole = b.owners[:n] == b.owners[size - 1 : size - 1 + n]
    return h[whole], b.owners[:n][whole]


def held(inner: Block, outer: Block, longer_than: int) -> np.ndarray:
    """(place in inner, place in outer) of all texts longer than ``longer_than`` that another text holds.

    They meet on that run of the inner text's letters which the fewest outer texts have.  Texts of which some run is
    in no outer text are left out before anything is sorted, by a table of hashes that may only keep too many.
    """
    hi, oi = _grams(inner, longer_than + 1)
    ho, oo = (hi, oi) if inner is outer else _grams(outer, longer_than + 1)
    place = lambda h: (h >> np.uint64(64 - TABLE)).astype(np.int64)
    there = np.bincount(place(ho), minlength=1 << TABLE) > (1 if inner is outer else 0)
    whole = np.bincount(oi[~there[place(hi)]], minlength=len(inner.texts)) == 0
    hi, oi = hi[whole[oi]], oi[whole[oi]]
    asked = np.zeros(1 << TABLE, dtype=bool)
    asked[place(hi)] = True
    some = asked[place(ho)]
    ho, oo = ho[some], oo[some]
    order = np.argsort(ho, kind="stable")
    ho, oo = ho[order], oo[order]
    first = np.searchsorted(ho, hi)
    count = np.searchsorted(ho, hi, side="right") - first
    best = np.lexsort((count, oi))
    best = best[np.r_[True, oi[best][1:] != oi[best][:-1]]] if len(best) else best
    out = []
    for g in best[count[best] > 0].tolist():
        i = int(oi[g])
        t = inner.texts[i]
        out += [(i, j) for j in dict.fromkeys(oo[first[g] : first[g] + count[g]].tolist()) if (j != i or inner is not outer) and t in outer.texts[j]]
    return np.array(out, dtype=np.int64).reshape(-1, 2)
