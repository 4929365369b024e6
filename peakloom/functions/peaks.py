"""Peak lists in Arrow batches: flat arrays, cleaned and sorted, and the overlap of two lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

#: Slack for sums and differences of decimals that doubles can't hold exactly.
EPS = 1e-9


def flat_peaks(mz: pa.Array, it: pa.Array, shares: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, m/z, share of the row's sum or else intensity, row starts) of two list columns.

    Peaks come sorted by row and m/z. Peaks with a null, NaN or infinite value or without a positive intensity are left out;
    a row whose lists are null or of different lengths has none.
    """
    n = len(mz)
    size_m = np.nan_to_num(mz.value_lengths().to_numpy(zero_copy_only=False).astype("f8"), nan=0).astype("i8")
    size_i = np.nan_to_num(it.value_lengths().to_numpy(zero_copy_only=False).astype("f8"), nan=0).astype("i8")
    m = mz.flatten().to_numpy(zero_copy_only=False).astype("f8")
    a = it.flatten().to_numpy(zero_copy_only=False).astype("f8")
    good = size_m == size_i
    row = np.repeat(np.arange(n), size_m)
    if not good.all():
        m, row = m[good[row]], row[good[row]]
        a = a[good[np.repeat(np.arange(n), size_i)]]
    ok = np.isfinite(m) & np.isfinite(a) & (a > 0)
    m, a, row = m[ok], a[ok], row[ok]
    order = np.lexsort((m, row))
    m, a, row = m[order], a[order], row[order]
    if shares:
        a = a / np.bincount(row, a, minlength=n)[row]
    starts = np.searchsorted(row, np.arange(n + 1))
    return row, m, a, starts


def overlap(ma: np.ndarray, a: np.ndarray, mb: np.ndarray, b: np.ndarray, tol: float) -> float:
    """The largest sum of sqrt(a*b) over one-to-one pairs of peaks within ``tol``, by dynamic programming in that band."""
    if not len(ma) or not len(mb):
        return 0.0
    lo, hi = np.searchsorted(mb, ma - tol - EPS, "left"), np.searchsorted(mb, ma + tol + EPS, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return 0.0
    lo, hi = lo[hit], hi[hit]
    if (hi - lo == 1).all() and (np.diff(lo) > 0).all():
        return float(np.sqrt(a[hit] * b[lo]).sum())
    best, filled = np.zeros(len(mb) + 1), int(lo[0])
    ra, rb = np.sqrt(a), np.sqrt(b)
    for i, l, h in zip(hit.tolist(), lo.tolist(), hi.tolist()):
        if h > filled:
            best[filled + 1 : h + 1] = best[filled]
            filled = h
        gain = best[l:h] + ra[i] * rb[l:h]
        best[l + 1 : filled + 1] = np.maximum(best[l + 1 : filled + 1], np.concatenate([np.maximum.accumulate(gain), np.full(filled - h, gain.max())]))
    return float(best[filled])


def log2_clamp(x: float, low: int, high: int) -> int:
    return max(low, min(high, math.ceil(math.log2(max(2.0, x)))))
