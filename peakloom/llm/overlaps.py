"""Spectra that stand, exactly or almost, both in an evaluation table and in the training table.

A spectrum is a string of peaks in order of m/z. Two of them match when the overlap of their peaks reaches ``THRESHOLD``. By
the Cauchy-Schwarz inequality their paired peaks then hold at least THRESHOLD squared of either's intensity, so at most
1 - THRESHOLD squared may be lost to edits. An evaluation string is cut into segments of one peak; a training string picks
segments that hold more than may be lost, the rarest first, so that at least ``need`` of them must reappear at an allowed
position (m/z and precursor within tolerance). Pairs that share so many are verified by banded dynamic programming. No
matching pair can be missed.

Both tables are shuffled once, by cells of the precursor; segments and pairs are formed in the task that holds a cell and
never leave it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.peaks import EPS, flat_peaks, log2_clamp, overlap
from peakloom.functions.similarity import Peaks, near
from peakloom.session import cut

TOLERANCE, THRESHOLD = 0.02, 0.9
#: Segments that have to reappear, where a spectrum has enough of them.
NEED = 3
#: Training strings of a cell of the precursor that one task gets, shared segments that are held at once, and peaks of pairs that are compared at once.
ROWS, SHARED, PEAKS = 65_536, 250_000, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    k = key.astype("u8")
    k = (k ^ (k >> np.uint64(31))) * _MIX
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (k >> np.uint64(64 - bits)).astype("i8")


def _key(prec_bin: np.ndarray, mz_bin: np.ndarray) -> np.ndarray:
    return (prec_bin.astype("i8") << 32) ^ mz_bin.astype("i8")


def _bins(x: np.ndarray, width: float, slack: float = 0.0) -> np.ndarray:
    return np.clip(np.floor((x + slack) / width), -(2**31) + 1, 2**31 - 1).astype("i8")


def _positions(prec: np.ndarray, m: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the peak, key) of all cells in which a partner of an evaluation peak may lie. prec is given for each peak."""
    width, i = 2.5 * tol, np.arange(len(m))
    out_i, out_k = [], []
    p0, p1 = _bins(prec, width, -tol - EPS), _bins(prec, width, tol + EPS)
    m0, m1 = _bins(m, width, -tol - EPS), _bins(m, width, tol + EPS)
    for pb, pu in ((p0, None), (p1, p1 > p0)):
        for mb, mu in ((m0, None), (m1, m1 > m0)):
            use = np.ones(len(m), bool) if pu is None else pu
            use = use if mu is None else use & mu
            out_i.append(i[use])
            out_k.append(_key(pb[use], mb[use]))
    return np.concatenate(out_i), np.concatenate(out_k)


def _batch(batch: pa.RecordBatch, mz: str, it: str, prec: str):
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    p = col(prec).to_numpy(zero_copy_only=False).astype("f8")
    return p, flat_peaks(col(mz), col(it))


def _signature(p: float, m: np.ndarray, a: np.ndarray) -> bytes:
    return hashlib.blake2b(np.float64(p).tobytes() + m.tobytes() + np.round(a, 9).tobytes(), digest_size=16).digest()


def _gather(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the peaks of ``rows``, row starts among them)."""
    size = (starts[1:] - starts[:-1])[rows]
    ends = np.cumsum(size)
    return np.arange(size.sum()) + np.repeat(starts[rows] - ends + size, size), np.concatenate([[0], ends])


def _rows(b: pa.RecordBatch, rows: np.ndarray, p: np.ndarray, m: np.ndarray, a: np.ndarray, starts: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """(id, prec, mz, it, cell) of some rows of a batch, which may repeat."""
    at, offsets = _gather(starts, rows)
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(x[at])) for x in (m, a)]
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(p[rows]), *lists, pa.array(cell)], ["id", "prec", "mz", "it", "cell"])


def _sketch(test: DataFrame, tol: float) -> tuple[np.ndarray, int]:
    """Which slots of a hashed set of bits hold an evaluation position, and the logarithm of their number.

    Its size is bounded by 2^25 bytes whatever the input; a fuller set only prunes less.
    """
    peaks = test.agg(F.sum(F.when(F.col("mz").isNotNull(), F.size("mz")).otherwise(0))).first()[0] or 0
    bits = log2_clamp(32.0 * peaks, 20, 28)

    def mark(batches):
        table = np.zeros(1 << (bits - 3), "u1")
        for b in batches:
            p, (row, m, _, _) = _batch(b, "mz", "it", "prec")
            ok = np.isfinite(p)[row]
            _, k = _positions(p[row][ok], m[ok], tol)
            slot = _slot(k, bits)
            np.bitwise_or.at(table, slot >> 3, (1 << (slot & 7)).astype("u1"))
        for i in range(0, len(table), _BLOCK):
            if (part := table[i : i + _BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["block", "cells"])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, "u1")
        for c in pdf.cells:
            total |= np.frombuffer(zlib.decompress(c), "u1")
        return pd.DataFrame({"block": [key[0]], "cells": [zlib.compress(total.tobytes(), 1)]})

    table = np.zeros(1 << (bits - 3), "u1")
    parts = test.select("prec", "mz", "it").mapInArrow(mark, "block int, cells binary").groupBy("block").applyInPandas(merge, "block int, cells binary")
    for r in parts.collect():  # at most 2^25 bytes
        table[r[0] * _BLOCK : (r[0] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(bytes(r[1])), "u1")
    return table, bits


def _choose(count: np.ndarray, a: np.ndarray, lost: float) -> tuple[np.ndarray, int] | None:
    """Which peaks a training string offers and how many must reappear; None if none of its partners can exist."""
    none = count == 0
    budget = lost - a[none].sum()
    if budget < 0:
        return None
    some = np.flatnonzero(~none)
    some = some[np.lexsort((-a[some], count[some]))]
    if not len(some):
        return None
    e = a[some]
    total = np.cumsum(e)
    for need in range(NEED, 0, -1):
        if need == 1:
            rest = total
        elif need == 2:
            rest = total - np.maximum.accumulate(e)
        else:
            first = np.maximum.accumulate(e)
            second = np.zeros(len(e))
            x = y = 0.0
            for i, v in enumerate(e.tolist()):
                x, y = (v, x) if v > x else (x, max(y, v))
                second[i] = y
            rest = total - first - second
        enough = np.flatnonzero(rest > budget)
        if len(enough):
            return some[: enough[0] + 1], need
    return None


def _numpy(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False)


class _Strings:
    """Peak lists with their precursors and cells; equal ones of a cell stand once, with the places of all copies."""

    def __init__(self, prec: np.ndarray, cell: np.ndarray, mz: pa.Array, it: pa.Array):
        m, a = _numpy(mz.flatten()), _numpy(it.flatten())
        starts = np.concatenate([[0], np.cumsum(_numpy(mz.value_lengths()))]).astype("i8")
        first: dict[tuple[int, bytes], int] = {}
        self.copies: list[list[int]] = []
        for r, (c, p) in enumerate(zip(cell.tolist(), prec.tolist())):
            s = slice(starts[r], starts[r + 1])
            at = first.setdefault((c, _signature(p, m[s], a[s])), len(first))
            if at == len(self.copies):
                self.copies.append([])
            self.copies[at].append(r)
        one = np.array([c[0] for c in self.copies], "i8")
        at, self.starts = _gather(starts, one)
        self.p, self.cell = prec[one], cell[one]
        self.peaks = Peaks(len(one), np.repeat(np.arange(len(one)), np.diff(self.starts)), m[at], a[at])


def _copies(left: list[list[int]], right: list[list[int]], r: np.ndarray, t: np.ndarray, most: int = 1 << 18):
    """Arrays (place of a copy of r, place of a copy of t, pair), of about ``most`` rows."""
    out, n = [], 0
    for k, (i, j) in enumerate(zip(r.tolist(), t.tolist())):
        x, y = left[i], right[j]
        step = max(1, most // len(y))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            out.append((np.repeat(part, len(y)), np.tile(y, len(part)), np.full(len(part) * len(y), k)))
            n += len(out[-1][2])
            if n >= most:
                yield tuple(map(np.concatenate, zip(*out)))
                out, n = [], 0
    if out:
        yield tuple(map(np.concatenate, zip(*out)))


class _Segments:
    """The segments of a task's evaluation strings by their cells."""

    def __init__(self, strings: _Strings, tol: float):
        self.strings, self.tol, width = strings, tol, 2.5 * tol
        x = strings.peaks
        low, high = _bins(x.mz, width, -tol - EPS), _bins(x.mz, width, tol + EPS)
        two = np.flatnonzero(high > low)
        at = np.concatenate([np.arange(len(low)), two])
        key = _key(strings.cell[x.row[at]], np.concatenate([low, high[two]]))
        order = np.argsort(key, kind="stable")
        self.keys, self.at = key[order], at[order]

    def pairs(self, train: _Strings, lost: float):
        """Arrays (training string, evaluation string) of those that share as many segments as they must."""
        x, y = train.peaks, self.strings.peaks
        key = _key(train.cell[x.row], _bins(x.mz, 2.5 * self.tol))
        lo = np.searchsorted(self.keys, key, "left")
        count = np.searchsorted(self.keys, key, "right") - lo
        dead = np.bincount(x.row, np.where(count == 0, x.w, 0.0), minlength=x.n) > lost
        picks, need = [], np.zeros(x.n, "i8")
        for r in np.flatnonzero(~dead):
            s = slice(train.starts[r], train.starts[r + 1])
            if (chosen := _choose(count[s], x.w[s], lost)) is not None:
                picks.append(train.starts[r] + np.sort(chosen[0]))
                need[r] = chosen[1]
        if not picks:
            return
        work, begin = 0, 0
        for i, pick in enumerate(picks):
            work += int(count[pick].sum())
            if work < SHARED and i + 1 < len(picks):
                continue
            e = np.concatenate(picks[begin : i + 1])
            work, begin = 0, i + 1
            c = count[e]
            peak = np.repeat(e, c)
            other = self.at[np.arange(c.sum()) + np.repeat(lo[e] - np.cumsum(c) + c, c)]
            ok = (np.abs(train.p[x.row[peak]] - self.strings.p[y.row[other]]) <= self.tol + EPS) & (np.abs(x.mz[peak] - y.mz[other]) <= self.tol + EPS)
            peak, other = peak[ok], other[ok]
            # a segment that two peaks of the other string fit counts once
            code = np.unique(y.row[other] * len(x.mz) + peak)
            t, r = code // len(x.mz), x.row[code % len(x.mz)]
            pair, hits = np.unique(r * y.n + t, return_counts=True)
            r, t = pair // y.n, pair % y.n
            enough = hits >= need[r]
            yield r[enough], t[enough]

    def matches(self, train: _Strings, lost: float, threshold: float):
        """Arrays (training string, evaluation string, overlap) of those that overlap enough."""
        x, y = train.peaks, self.strings.peaks
        for rs, ts in self.pairs(train, lost):
            ends = np.concatenate([[0], np.cumsum(np.diff(train.starts)[rs] + np.diff(self.strings.starts)[ts])])
            s = 0
            while s < len(rs):
                e = max(s + 1, int(np.searchsorted(ends, ends[s] + PEAKS, "right")) - 1)
                r, t, s = rs[s:e], ts[s:e], e
                a, b = x.take(r), y.take(t)
                i, j = near(a, b, self.tol + 2 * EPS)
                # the sum over all pairs of peaks is no less than that over any that are one to one
                most = np.bincount(a.row[i], np.sqrt(a.w[i] * b.w[j]), minlength=len(r))
                left = np.flatnonzero(most >= threshold - 2 * EPS)
                u, v = a.starts(), b.starts()
                score = np.array([overlap(a.mz[u[k] : u[k + 1]], a.w[u[k] : u[k + 1]], b.mz[v[k] : v[k + 1]], b.w[v[k] : v[k + 1]], self.tol) for k in left], "f8")
                ok = score >= threshold - EPS
                yield r[left[ok]], t[left[ok]], score[ok]


def matches(train: DataFrame, test: DataFrame, train_id: str = "rid", test_id: str = "spectrum_id", tol: float = TOLERANCE, threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """(train id, test id, overlap) of all pairs whose precursors differ by at most ``tol`` and that overlap enough.

    Both tables have precursor_mz, ms2_mzs and ms2_normalized_intensities. Null, NaN and infinite precursors and spectra
    without a sound peak match nothing; unsorted lists and other scales make no difference; equal spectra of a batch are
    compared once and every copy comes out. Empty tables give an empty result.

    A training string goes to the task of its cell of the precursor, an evaluation string to those in which partners may lie.
    Cells with more than ``rows`` training strings are dealt over several tasks, each with the cell's evaluation strings.
    """
    spark = train.sparkSession
    cols = lambda df, i: df.select(F.col(i).alias("id"), F.col("precursor_mz").cast("double").alias("prec"), F.col("ms2_mzs").cast("array<double>").alias("mz"), F.col("ms2_normalized_intensities").cast("array<double>").alias("it")).where("prec is not null and not isnan(prec) and size(mz) > 0")
    test, train = cols(test, test_id), cols(train, train_id)
    t_type, r_type = dict(test.dtypes)["id"], dict(train.dtypes)["id"]
    lost, width = 1 - threshold**2 + EPS, 2.5 * tol
    table, bits = _sketch(test, tol)
    shared = spark.sparkContext.broadcast(table)
    del table

    def evaluated(batches):
        for b in batches:
            p, (_, m, a, starts) = _batch(b, "mz", "it", "prec")
            keep = np.flatnonzero((np.diff(starts) > 0) & np.isfinite(p))
            low, high = _bins(p[keep], width, -tol - EPS), _bins(p[keep], width, tol + EPS)
            two = np.flatnonzero(high > low)
            yield _rows(b, np.concatenate([keep, keep[two]]), p, m, a, starts, np.concatenate([low, high[two]]))

    def alive(batches):
        table = shared.value
        for b in batches:
            p, (row, m, a, starts) = _batch(b, "mz", "it", "prec")
            sound = np.isfinite(p)
            cell = _bins(np.where(sound, p, 0.0), width)
            slot = _slot(_key(cell[row], _bins(m, width)), bits)
            none = (table[slot >> 3] >> (slot & 7).astype("u1")) & 1 == 0
            dead = np.bincount(row, np.where(none, a, 0.0), minlength=len(p)) > lost
            keep = np.flatnonzero(~dead & sound & (np.diff(starts) > 0))
            yield _rows(b, keep, p, m, a, starts, cell[keep])

    def meet(batches):
        mine, segments = [], None
        col = lambda b, c: b.column(b.schema.get_field_index(c))
        strings = lambda b: _Strings(_numpy(col(b, "prec")), _numpy(col(b, "cell")), col(b, "mz"), col(b, "it"))
        for b in batches:  # evaluation strings come first
            asked = _numpy(col(b, "asked"))
            if asked.any():
                mine.append(b.filter(pa.array(asked)))
                b = b.filter(pa.array(~asked))
            if not mine or not b.num_rows:
                continue
            if segments is None:
                whole = pa.Table.from_batches(mine).combine_chunks().to_batches()[0]
                segments, names = _Segments(strings(whole), tol), col(whole, "test")
            some = strings(b)
            for r, t, score in segments.matches(some, lost, threshold):
                for x, y, k in _copies(some.copies, segments.strings.copies, r, t):
                    yield pa.RecordBatch.from_arrays([col(b, "train").take(pa.array(x)), names.take(pa.array(y)), pa.array(score[k])], [train_id, test_id, "overlap"])

    schema = "prec double, mz array<double>, it array<double>, cell bigint"
    cell = F.greatest(F.least(F.floor(F.col("prec") / F.lit(width)), F.lit(2**31 - 1)), F.lit(-(2**31) + 1))
    crowded = F.broadcast(train.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > rows).select("cell", F.ceil(F.col("n") / rows).cast("int").alias("tasks")))
    dealt = lambda df: df.join(crowded, "cell", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    left = dealt(train.mapInArrow(alive, f"id {r_type}, {schema}")).select(F.lit(False).alias("asked"), F.col("id").alias("train"), F.lit(None).cast(t_type).alias("test"), "prec", "mz", "it", "cell", F.pmod(F.xxhash64("id", "it"), F.col("tasks")).cast("int").alias("task"))
    right = dealt(test.mapInArrow(evaluated, f"id {t_type}, {schema}")).select(F.lit(True).alias("asked"), F.lit(None).cast(r_type).alias("train"), F.col("id").alias("test"), "prec", "mz", "it", "cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    # the tasks of a cell are no more than partitions and lie next to each other, so no two of them share one
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-2 * train.count() // rows))
    place = F.pmod(F.pmod(F.xxhash64("cell"), F.lit(parts)) + F.col("task"), F.lit(parts)).cast("int")
    found = cut(right.union(left).repartitionById(parts, place).sortWithinPartitions(F.desc("asked")).mapInArrow(meet, f"{train_id} {r_type}, {test_id} {t_type}, overlap double"), "matches")
    shared.destroy()
    return found


def overlap_report(pairs: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(qset, ingest_lib, n_pairs, n_train, n_test): overlaps per evaluation split and source; the source without blanks and in lower case."""
    from peakloom.llm.capping import contributor

    rows = pairs.join(train.select("rid", contributor("ingest_lib").alias("ingest_lib")), "rid").join(test.select("spectrum_id", "qset"), "spectrum_id")
    return rows.groupBy("qset", "ingest_lib").agg(F.count("*").alias("n_pairs"), F.count_distinct("rid").alias("n_train"), F.count_distinct("spectrum_id").alias("n_test"))
