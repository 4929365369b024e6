"""A stated set of queries against all rows: bounded blocks of queries are broadcast, and all rows are compared where they are read.

Nothing of the rows is shuffled but the k best of each query and task. A key with any share of the rows makes no task larger,
as rows stay in the partitions they are read in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import similarity as S
from peakloom.functions.peaks import flat_peaks
from peakloom.session import cut

#: Queries that are compared at once, sums that are held at once, and pairs of peak lists that are scored at once.
ASKED, SUMS, PAIRS = 8_192, 2_000_000, 8_192


def best_rows(query: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -sims, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def in_blocks(queries: DataFrame, by: str | None, each: int, run: Callable[[pa.Table], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The union of ``run`` over blocks of about ``each`` queries: ranges of ``by`` where it is given, cut by a hash of the id.

    Each block is collected (a bounded number of queries), worked on and written, and what was sent for it removed, before the
    next. A value of ``by`` that many
    queries share makes several blocks.
    """
    def pieces(part: Column, n: int) -> list[Column]:
        m = max(1, -(-n // each))
        return [part & (F.pmod(F.xxhash64("id"), F.lit(m)) == i) if m > 1 else part for i in range(m)]

    n = queries.count()
    blocks = max(1, -(-n // each))
    if by is None or blocks == 1:
        parts = pieces(F.lit(True), n)
    else:
        edges = sorted(set(queries.select(F.percentile_approx(by, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0]))
        ends = [None, *edges, None]
        ranges = [(F.lit(True) if lo is None else F.col(by) > lo) & (F.lit(True) if hi is None else F.col(by) <= hi) for lo, hi in zip(ends, ends[1:])]
        sizes = queries.agg(*[F.count_if(r).alias(f"n{i}") for i, r in enumerate(ranges)]).first()
        parts = [x for r, m in zip(ranges, sizes) for x in pieces(r, m)]
    found = None
    for part in parts:
        block = queries.where(part).toArrow().combine_chunks().sort_by("id")
        if len(block) or found is None:
            part, sent = run(block)
            done = cut(part, "block")
            sent.destroy()
            found = done if found is None else found.unionByName(done)
    return found


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows (query, ..., other, sim) of each query with their rank; ties go to the smaller id."""
    best = Window.partitionBy(*by).orderBy(F.col("sim").desc(), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _codes(values: pa.Array, known: pd.Index) -> np.ndarray:
    """Numbers of values among the known ones, nulls alike; -1 for others."""
    return known.get_indexer(pd.Index(values.to_pandas().astype(object).where(lambda x: x.notna(), None)))


def cell_sums(block: pa.Table, k: int, zeros: bool = False, group: bool = False, apart: bool = False, digits: int | None = None, itself: bool = False):
    """A function of Arrow batches (id, cells, weights, ...) that finds the k rows with the largest sum of products to each query of ``block``.

    ``group`` and ``apart`` say that there are such columns: rows of another group, and rows with the same value of ``apart``,
    don't count (nulls being alike). ``zeros`` keeps rows that share no cell with the query.
    """
    c, w = block.column("cells").combine_chunks(), block.column("weights").combine_chunks()
    cell = c.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    who = np.repeat(np.arange(len(c)), c.value_lengths().to_numpy(zero_copy_only=False))[order]
    cells, begin = np.unique(cell[order], return_index=True)
    begin, weight = np.append(begin, len(cell)), w.flatten().to_numpy()[order].astype("f8")
    asked = block.column("id").to_numpy()
    sides = {}
    for name, there in (("grp", group), ("apart", apart)):
        if there:
            values = block.column(name).combine_chunks()
            known = pd.Index(pd.unique(values.to_pandas().astype(object).where(lambda x: x.notna(), None)))
            sides[name] = known, _codes(values, known)
    shared = (asked, cells, begin, who, weight, sides)

    def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        asked, cells, begin, who, weight, sides = shared.value if hasattr(shared, "value") else shared
        n, kth = len(asked), np.full(len(asked), -1.0)
        best = np.zeros(0, "i8"), np.zeros(0, asked.dtype), np.zeros(0)
        for b in batches:
            if not len(cells):
                continue
            ids = b.column(0).to_numpy()
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            row, cell, w = np.repeat(np.arange(len(ids)), size), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype("f8")
            side = {name: _codes(b.column(b.schema.get_field_index(name)), known) for name, (known, _) in sides.items()}
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            same = cells[at] == cell
            row, at, w = row[same], at[same], w[same]
            many = begin[at + 1] - begin[at]
            starts = np.searchsorted(row, np.arange(len(ids) + 1))
            work = np.concatenate([[0], np.cumsum(many)])[starts] + np.arange(len(ids) + 1) * n
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(work, work[lo] + 2 * SUMS, "right")) - 1)
                e = slice(starts[lo], starts[hi])
                c = many[e]
                # the places of all queries with a peak in the cell of an entry
                spot = np.arange(c.sum()) + np.repeat(begin[at[e]] - np.cumsum(c) + c, c)
                sims = np.bincount(np.repeat((row[e] - lo) * n, c) + who[spot], np.repeat(w[e], c) * weight[spot], minlength=(hi - lo) * n).reshape(-1, n)
                hit = (sims >= kth - 1e-9) & (sims > 0)
                if zeros:  # of those that share no cell with a query only the smallest ids count
                    few = np.argsort(ids[lo:hi], kind="stable")[: k + 1]
                    hit[few] |= sims[few] >= kth
                if not itself:
                    hit &= ids[lo:hi, None] != asked
                if group:
                    hit &= side["grp"][lo:hi, None] == sides["grp"][1]
                if apart:
                    hit &= side["apart"][lo:hi, None] != sides["apart"][1]
                r, q = np.nonzero(hit)
                found = sims[r, q] if digits is None else np.round(sims[r, q], digits)
                best = tuple(np.concatenate(x) for x in zip(best, (q, ids[lo:hi][r], np.minimum(found, 1.0))))
                top = best_rows(*best, k)
                best = tuple(x[top] for x in best)
                full = np.flatnonzero(np.bincount(best[0], minlength=n) >= k)
                kth[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(asked[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "other", "sim"])

    return run, shared


def nearest_by_cells(rows: DataFrame, queries: DataFrame, k: int, zeros: bool = False, digits: int | None = None, itself: bool = False, each: int = ASKED) -> DataFrame:
    """(query, other, sim, rank): for each query the k rows with the largest sum of products of weights in common cells; exact.

    Both sides have (id, cells array<bigint>, weights array<float or double>) and, where both have it, ``grp`` (rows of another
    group don't count) and ``apart`` (rows with the same value don't count), nulls being alike. A row is its own neighbour only if ``itself`` is set.
    Ties go to the smaller id. Sums are rounded to ``digits`` where given. Rows without a cell are nobody's neighbours.
    """
    kind = dict(rows.dtypes)["id"]
    has = set(rows.columns) & set(queries.columns)
    context = rows.sparkSession.sparkContext

    def one(block: pa.Table) -> tuple[DataFrame, Broadcast]:
        run, shared = cell_sums(block, k, zeros, "grp" in has, "apart" in has, digits, itself)
        sent = context.broadcast(shared)
        part = rows.select("id", "cells", "weights", *sorted(has & {"grp", "apart"})).mapInArrow(lambda b: run(b, sent), f"query {kind}, other {kind}, sim double")
        return ranked(part, ["query"], k), sent

    return in_blocks(queries, None, each, one)


def peak_cells(rows: DataFrame, ident: str, mz: str, it: str, prec: str, width: float, top: int, loss_from: float = 0.5, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, cells, weights, ...): square roots of the ``top`` strongest peaks summed in cells, fragments' (>= 0) and neutral losses' (< 0), length one.

    In Arrow batches where rows are read. Rows without a sound peak don't come out; a null or NaN precursor has no losses.
    """

    def run(batches):
        for b in batches:
            row, m, a, _ = flat_peaks(b.column(1), b.column(2), shares=False)
            p = b.column(3).to_numpy(zero_copy_only=False).astype("f8")
            ok = m > 0
            row, m, a = row[ok], m[ok], a[ok]
            order = np.lexsort((m, -a, row))
            order = order[np.arange(len(order)) - np.searchsorted(row, row) < top]
            row, m, v = row[order], m[order], np.sqrt(a[order])
            loss = p[row] - m
            lost = loss > loss_from
            r = np.concatenate([row, row[lost]])
            cell = np.concatenate([np.floor(m / width), -1 - np.floor(loss[lost] / width)]).astype("i8")
            w = np.concatenate([v, v[lost]])
            order = np.lexsort((cell, r))
            r, cell, w = r[order], cell[order], w[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (cell[1:] != cell[:-1])][: len(r)])
            r, cell, w = r[first], cell[first], np.add.reduceat(w, first) if len(first) else w
            w = w / np.sqrt(np.bincount(r, w * w, minlength=b.num_rows))[r]
            size = np.bincount(r, minlength=b.num_rows)
            keep = pa.array(size > 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size[size > 0])]).astype("i4"))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.ListArray.from_arrays(offsets, pa.array(cell)), pa.ListArray.from_arrays(offsets, pa.array(w)), *[b.column(4 + i).filter(keep) for i in range(len(more))]], ["id", "cells", "weights", *more])

    cols = rows.select(F.col(ident).alias("id"), F.col(mz).cast("array<double>").alias("mz"), F.col(it).cast("array<double>").alias("it"), F.col(prec).cast("double").alias("prec"), *more)
    kinds = dict(cols.dtypes)
    return cols.where("id is not null and size(mz) > 0").mapInArrow(run, f"id {kinds['id']}, cells array<bigint>, weights array<double>" + "".join(f", {c} {kinds[c]}" for c in more))


def clean_lists(rows: DataFrame, ident: str, mz: str, it: str, prec: str, more: tuple[str, ...] = (), sound: bool = True) -> DataFrame:
    """(id, prec, mz, it, ...): cleaned peak lists, of rows with a sound precursor only or of all rows that have peaks."""

    def run(batches):
        for b in batches:
            row, m, a, _ = flat_peaks(b.column(2), b.column(3), shares=False)
            p = S.clean(S.Peaks(b.num_rows, row, m, a), b.column(1).to_numpy(zero_copy_only=False).astype("f8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), p.lists(p.mz), p.lists(p.w), *[b.column(4 + i) for i in range(len(more))]], ["id", "prec", "mz", "it", *more])

    cols = _lists_of(rows, ident, mz, it, prec, more, sound)
    return cols.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in cols.dtypes)).where(F.size("mz") > 0)


def _lists_of(rows: DataFrame, ident: str, mz: str, it: str, prec: str, more: tuple[str, ...], sound: bool = True) -> DataFrame:
    cols = rows.select(F.col(ident).alias("id"), F.col(prec).cast("double").alias("prec"), F.col(mz).cast("array<double>").alias("mz"), F.col(it).cast("array<double>").alias("it"), *more)
    cols = cols.where(F.col("id").isNotNull() & (F.size("mz") > 0))
    return cols.where((F.col("prec") > 0) & (F.col("prec") < float("inf"))) if sound else cols


def _weighed(kind: str, p: S.Peaks) -> S.Peaks:
    return S.entropy_weights(p) if kind in ("entropy", "shifted") else p


def _places(p: S.Peaks, prec: np.ndarray, da: float, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(peak, key) of the cells of all peaks' m/z and neutral losses; with ``both`` of all cells within ``da``."""
    width, slack = 2.5 * da, (da + 1e-6) * both
    n, at, keys = np.arange(len(p.mz)), [], []
    for side, x in enumerate((p.mz, prec[p.row] - p.mz)):
        lo, hi = np.floor((x - slack) / width).astype("i8"), np.floor((x + slack) / width).astype("i8")
        more = np.flatnonzero(hi > lo)
        at += [n, more]
        keys += [2 * lo + side, 2 * hi[more] + side]
    return np.concatenate(at), np.concatenate(keys)


class Bounds:
    """Upper bounds of the shifted similarity of queries with rows.

    A pair of peaks with shares a and b adds at most sqrt(a * b), and two peaks that meet, directly or moved, have their m/z or
    their neutral losses within ``da``. So the sum of sqrt(a * b) over common cells is no less than the similarity.
    """

    def __init__(self, queries: S.Peaks, prec: np.ndarray, da: float):
        at, keys = _places(queries, prec, da, True)
        order = np.argsort(keys, kind="stable")
        self.n, self.da, self.keys = queries.n, da, keys[order]
        self.who, self.w = queries.row[at[order]], np.sqrt(queries.w[at[order]])

    def of(self, rows: S.Peaks, prec: np.ndarray) -> np.ndarray:
        """One number for each row and query."""
        at, keys = _places(rows, prec, self.da, False)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        c = hi - lo
        spot = np.arange(c.sum()) + np.repeat(lo - np.cumsum(c) + c, c)
        return np.bincount(np.repeat(rows.row[at] * self.n, c) + self.who[spot], np.repeat(np.sqrt(rows.w[at]), c) * self.w[spot], minlength=rows.n * self.n)


def best_by_peaks(rows: DataFrame, asked: Column, kind: str, k: int, reach: float, at: float = 0.0, da: float = 0.02, ident: str = "rid", mz: str = "ms2_mzs", it: str = "ms2_normalized_intensities", prec: str = "precursor_mz", group: str = "adduct", each: int = ASKED) -> DataFrame:
    """(query, other, sim, rank): for each row for which ``asked`` holds, the k rows most similar by their cleaned peaks.

    Compared are the rows of the same ``group`` whose precursor is within ``reach`` of the query's less ``at``. ``kind`` is entropy, cosine, shifted or modified. Blocks of queries are ranges of the precursor, so the filter
    of a block reaches the scan; rows are cleaned only if they meet a query. Ties go to the smaller id.
    """
    if kind not in S.KINDS:
        raise ValueError(kind)
    kind_of = dict(rows.dtypes)[ident]
    sound = rows.where(F.col(group).isNotNull())
    queries = cut(clean_lists(sound.where(asked), ident, mz, it, prec, (group,)), "asked")
    context = rows.sparkSession.sparkContext

    def one(block: pa.Table) -> tuple[DataFrame, Broadcast]:
        ids, p = block.column("id").to_numpy(), block.column("prec").to_numpy()
        names = pd.Index(pd.unique(block.column(group).to_pandas()), dtype=object)
        codes = names.get_indexer(block.column(group).to_pandas())
        lists = S.Peaks.of_lists(block.column("mz").combine_chunks(), block.column("it").combine_chunks()) if len(block) else S.Peaks(0, np.zeros(0, "i8"), np.zeros(0), np.zeros(0))
        wide = 4 * (float(p.max(initial=1.0)) + abs(at) + reach)
        order = np.argsort(codes * wide + p - at, kind="stable")
        sent = context.broadcast((ids[order], p[order], codes[order], names, _weighed(kind, lists.take(order)), wide))

        def run(batches):
            ids, p, codes, names, lists, wide = sent.value
            axis = codes * wide + p - at
            best, kth = (np.zeros(0, "i8"), np.zeros(0, ids.dtype), np.zeros(0)), np.full(len(ids), -1.0)
            bounds = Bounds(lists, p, da) if kind == "shifted" and len(ids) else None

            def add(query, other, sims):
                nonlocal best
                good = sims >= kth[query]
                best = tuple(np.concatenate(v) for v in zip(best, (query[good], other[good], sims[good])))
                top = best_rows(*best, k)
                best = tuple(v[top] for v in best)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) >= k)
                kth[full] = best[2][np.searchsorted(best[0], full, "right") - 1]

            for b in batches:
                own, x = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                g = names.get_indexer(b.column(4).to_pandas())
                lo, hi = np.searchsorted(axis, g * wide + x - reach - 1e-6), np.searchsorted(axis, g * wide + x + reach + 1e-6)
                many = np.where((g >= 0) & (x < wide / 2), np.maximum(hi - lo, 0), 0)
                r = np.repeat(np.arange(len(own)), many)
                q = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
                ok = (codes[q] == g[r]) & (np.abs(p[q] - at - x[r]) <= reach) & (ids[q] != own[r])
                r, q = r[ok], q[ok]
                if not len(r):
                    continue
                need, r = np.unique(r, return_inverse=True)
                part = b.take(pa.array(need))
                row, m, a, _ = flat_peaks(part.column(2), part.column(3), shares=False)
                mine = _weighed(kind, S.clean(S.Peaks(len(need), row, m, a), x[need]))
                some = np.bincount(mine.row, minlength=len(need)) > 0
                ok = some[r]
                r, q = r[ok], q[ok]
                each = len(need) if bounds is None else max(1, SUMS // len(ids))
                for first in range(0, len(need), each):
                    pairs = slice(*np.searchsorted(r, [first, first + each]))
                    rr, qq = r[pairs], q[pairs]
                    most = np.full(len(rr), np.inf)
                    if bounds is not None:
                        some = np.arange(first, min(first + each, len(need)))
                        most = bounds.of(mine.take(some), x[need][some])[(rr - first) * len(ids) + qq]
                        none = np.flatnonzero((most == 0) & (kth[qq] <= 0))
                        add(qq[none], own[need][rr[none]], np.zeros(len(none)))
                        order = np.argsort(-most, kind="stable")
                        order = order[most[order] > 0]
                        rr, qq, most = rr[order], qq[order], most[order]
                    done = 0
                    while done < len(rr):
                        # the likeliest first; what can't be among the best isn't compared
                        part = np.arange(done, min(done + PAIRS, len(rr)))
                        done += PAIRS
                        part = part[most[part] >= kth[qq[part]] - 1e-6]
                        a, o = qq[part], rr[part]
                        if len(part):
                            add(a, own[need][o], np.round(S.score(kind, lists.take(a), mine.take(o), p[a], x[need][o], da), 6))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "other", "sim"])

        span = (float(p.min()) - at - reach, float(p.max()) - at + reach) if len(p) else (0.0, -1.0)
        near = _lists_of(sound.where(F.col(prec).between(*span)), ident, mz, it, prec, (group,))
        part = near.mapInArrow(run, f"query {kind_of}, other {kind_of}, sim double")
        return ranked(part, ["query"], k), sent

    return in_blocks(queries, "prec", each, one)
