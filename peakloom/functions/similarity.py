"""Similarities of many pairs of peak lists at once.

Lists are flat: ``row`` says to which pair a peak belongs, and the peaks of a pair stand together in order of m/z. All steps
run over whole batches of pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LN4 = math.log(4.0)
#: Scores up to this are rounding noise of lists that share no peak (fixed value).
ZERO = 1e-6
KINDS = ("entropy", "cosine", "greedy", "shifted", "modified")


class Peaks(NamedTuple):
    """The peaks of n rows: ``row``, ``mz`` and ``w`` of each peak."""

    n: int
    row: np.ndarray
    mz: np.ndarray
    w: np.ndarray

    @staticmethod
    def of_lists(mz: pa.Array, w: pa.Array) -> Peaks:
        """Of two list columns of equal lengths; nulls are empty lists."""
        size = mz.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype("f8")
        return Peaks(len(mz), np.repeat(np.arange(len(mz)), size), flat(mz), flat(w))

    def starts(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.n + 1))

    def take(self, rows: np.ndarray) -> Peaks:
        """The peaks of ``rows``, which may repeat, numbered anew."""
        s = self.starts()
        size = (s[1:] - s[:-1])[rows]
        at = np.arange(size.sum()) + np.repeat(s[rows] - np.cumsum(size) + size, size)
        return Peaks(len(rows), np.repeat(np.arange(len(rows)), size), self.mz[at], self.w[at])

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, minlength=self.n)

    def lists(self, x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.starts().astype("i4")), pa.array(x))


def clean(p: Peaks, prec: np.ndarray, floor: float = 0.01, top: int = 100, over: float = 0.5) -> Peaks:
    """Peaks up to the precursor (+ ``over``; all where it is NaN), at least ``floor`` of the strongest of these, the ``top`` strongest, base 1."""
    keep = ~(p.mz > (prec + over)[p.row]) & (p.mz > 0) & (p.w > 0) & np.isfinite(p.w)
    row, mz, w = p.row[keep], p.mz[keep], p.w[keep]
    base = np.zeros(p.n)
    np.maximum.at(base, row, w)
    keep = w >= floor * base[row]
    row, mz, w = row[keep], mz[keep], w[keep]
    order = np.lexsort((mz, -w, row))
    place = np.arange(len(order)) - np.searchsorted(row, row)
    kept = np.sort(order[place < top])
    return Peaks(p.n, row[kept], mz[kept], w[kept] / base[row[kept]])


def entropy_weights(p: Peaks, power: float = 1.0) -> Peaks:
    """Shares of the sum; below an entropy of 3 raised to 0.25 + 0.25 S, then shares again."""
    share = lambda x: x / np.where(t := p.sums(x), t, 1.0)[p.row]
    w = share(p.w**power)
    s = _entropy(p, w)
    low = (s < 3)[p.row]
    return p._replace(w=np.where(low, share(np.where(low, w ** (0.25 + 0.25 * np.minimum(s, 3.0))[p.row], w)), w))


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, -x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def _entropy(p: Peaks, w: np.ndarray) -> np.ndarray:
    return p.sums(_h(w))


def near(a: Peaks, b: Peaks, da: float, ppm: float = 0.0, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of all peaks of the same row within tolerance, b moved by its row's ``shift``; in order of a, then b."""
    mb = b.mz if shift is None else b.mz + shift[b.row]
    tol = np.maximum(da, a.mz * ppm * 1e-6)
    wide = max(1.0, float(np.max(np.abs(a.mz), initial=0.0)), float(np.max(np.abs(mb), initial=0.0))) * 4 + 4 * float(np.max(tol, initial=da))
    # one sorted axis for all rows; a little slack, as its numbers are larger, then the exact test
    at, slack = mb + b.row * wide, 1e-6 + a.n * wide * 1e-15
    lo, hi = np.searchsorted(at, a.mz + a.row * wide - tol - slack, "left"), np.searchsorted(at, a.mz + a.row * wide + tol + slack, "right")
    many = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(a.mz)), many)
    j = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
    ok = (a.row[i] == b.row[j]) & (np.abs(a.mz[i] - mb[j]) <= tol[i])
    return i[ok], j[ok]


def walk(a: Peaks, b: Peaks, da: float, ppm: float = 0.0, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a walk through both lists of each row: each peak of a in turn takes the first peak of b that fits and comes after those taken."""
    i, j = near(a, b, da, ppm, shift)
    if not len(i):
        return i, j
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    who, lo, hi = i[first], j[first], np.r_[j[first[1:] - 1], j[-1]] + 1
    row = a.row[who]
    # where the ranges of a row don't overlap, each takes its first
    clash = np.r_[False, (row[1:] == row[:-1]) & (lo[1:] < hi[:-1])]
    taken = lo.copy()
    if clash.any():
        slow = np.isin(row, np.unique(row[clash]))
        at = np.flatnonzero(slow)
        begin = np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])
        size = np.diff(np.r_[begin, len(at)])
        last = np.full(len(begin), -1)
        for k in range(int(size.max())):
            live = np.flatnonzero(size > k)
            e = at[begin[live] + k]
            t = np.maximum(lo[e], last[live] + 1)
            fits = t < hi[e]
            taken[e] = np.where(fits, t, -1)
            last[live] = np.where(fits, t, last[live])
    ok = taken >= 0
    return who[ok], taken[ok]


def entropy(a: Peaks, b: Peaks, da: float = 0.02, ppm: float = 0.0, shift: np.ndarray | None = None) -> np.ndarray:
    """1 - (2 S_AB - S_A - S_B) / ln 4 of lists whose weights sum to one; between 0 and 1, and 0 where a list is empty.

    With ``shift`` what a direct walk leaves over may also meet at m/z + shift: pairs of a second walk, over all peaks of b
    moved, count where neither peak was taken by the first.
    """
    i, j = walk(a, b, da, ppm)
    if shift is not None:
        x, y = walk(a, b, da, ppm, np.where(np.abs(shift) < 1e-4, 0.0, shift))
        got_a, got_b = np.zeros(len(a.mz), bool), np.zeros(len(b.mz), bool)
        got_a[i], got_b[j] = True, True
        free = ~(got_a[x] | got_b[y])
        i, j = np.concatenate([i, x[free]]), np.concatenate([j, y[free]])
    alone_a, mixed_b = 0.5 * a.w, 0.5 * b.w
    mixed_b[j] += alone_a[i]
    alone_a[i] = 0.0
    s = 1 - (2 * (_entropy(a, alone_a) + _entropy(b, mixed_b)) - _entropy(a, a.w) - _entropy(b, b.w)) / LN4
    full = (np.bincount(a.row, minlength=a.n) > 0) & (np.bincount(b.row, minlength=b.n) > 0)
    return np.where(full, np.clip(s, 0.0, 1.0), 0.0)


def cosine(a: Peaks, b: Peaks, da: float = 0.02, ppm: float = 0.0) -> np.ndarray:
    """The cosine of two lists whose peaks are paired by a walk."""
    i, j = walk(a, b, da, ppm)
    return _normed(a, b, np.bincount(a.row[i], a.w[i] * b.w[j], minlength=a.n))


def _normed(a: Peaks, b: Peaks, dot: np.ndarray) -> np.ndarray:
    size = np.sqrt(a.sums(a.w**2) * b.sums(b.w**2))
    return np.where(size > 0, dot / np.where(size > 0, size, 1.0), 0.0)


def modified(a: Peaks, b: Peaks, shift: np.ndarray, da: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(score, matches): peaks within ``da`` directly or at b + shift, paired one to one by the largest product.

    Of equal products the later pair goes first, moved ones being later than direct ones. Where the shift is within the
    tolerance only direct pairs count. A pair is taken as soon as no better one is left for either of its peaks, which gives
    the same as going through all pairs in order.
    """
    moved = np.abs(shift) > da
    i, j = near(a, b, da)
    x, y = near(a, b, da, shift=np.where(moved, shift, 0.0))
    x, y = x[moved[a.row[x]]], y[moved[a.row[x]]]
    i, j = np.concatenate([i, x]), np.concatenate([j, y])
    gain = a.w[i] * b.w[j]
    place = np.argsort(gain, kind="stable")[::-1]
    i, j, gain = i[place], j[place], gain[place]
    dot, count = np.zeros(a.n), np.zeros(a.n, "i8")
    best_a, best_b = np.empty(len(a.mz), "i8"), np.empty(len(b.mz), "i8")
    while len(i):
        best_a[i[::-1]] = np.arange(len(i))[::-1]
        best_b[j[::-1]] = np.arange(len(j))[::-1]
        k = np.arange(len(i))
        top = (best_a[i] == k) & (best_b[j] == k)
        np.add.at(dot, a.row[i[top]], gain[top])
        np.add.at(count, a.row[i[top]], 1)
        gone_a, gone_b = np.zeros(len(a.mz), bool), np.zeros(len(b.mz), bool)
        gone_a[i[top]], gone_b[j[top]] = True, True
        left = ~(gone_a[i] | gone_b[j])
        i, j, gain = i[left], j[left], gain[left]
    return _normed(a, b, dot), count


def score(kind: str, a: Peaks, b: Peaks, prec_a: np.ndarray, prec_b: np.ndarray, da: float = 0.02, ppm: float = 0.0) -> np.ndarray:
    """Scores of all pairs; those within rounding noise are 0."""
    if kind == "entropy":
        s = entropy(a, b, da, ppm)
    elif kind == "cosine":
        s = cosine(a, b, da, ppm)
    elif kind == "greedy":  # one to one by the largest product, as the modified cosine without a shift
        s = modified(a, b, np.zeros(a.n), da)[0]
    elif kind == "shifted":
        s = entropy(a, b, da, ppm, prec_a - prec_b)
    elif kind == "modified":
        s = modified(a, b, prec_a - prec_b, da)[0]
    else:
        raise ValueError(kind)
    return np.where(s > ZERO, s, 0.0)
