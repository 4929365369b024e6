"""A robust-pruned directed graph over the vectors of one shard, and beam search in it.

All loops run over whole batches of points: a step of the search takes, for every query of the batch, its best nodes that
haven't been expanded yet and merges those nodes' neighbours into its beam.
"""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, RELAX, BATCH, ENTRIES, PASSES = 24, 48, 1.2, 512, 16, 2
#: Nodes that a query expands in a step.
EXPAND = 4
#: Numbers in the table of the nodes that a batch of queries has named; large graphs are searched in smaller batches.
NAMED = 1 << 25


def batch_of(n: int) -> int:
    """Queries that are searched at once in a graph of ``n`` nodes."""
    return max(32, min(BATCH, NAMED // max(1, n)))


_EVERY_OTHER, _LANES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def ones(words: np.ndarray) -> np.ndarray:
    """Bits that are set in each row of 64-bit words (the last axis)."""
    c = np.bitwise_count(words)
    if c.shape[-1] % 8 or not c.flags.c_contiguous or c.shape[-1] > 512:
        return c.sum(-1, dtype="i4")
    # eight counts at once, as four sums of two that add up without a carry
    v = c.view("<u8")
    v = ((v & _EVERY_OTHER) + ((v >> np.uint64(8)) & _EVERY_OTHER)).sum(-1) if v.shape[-1] > 2 else _two(v)
    return ((v * _LANES) >> np.uint64(48)).astype("i4")


def _two(v: np.ndarray) -> np.ndarray:
    pairs = (v & _EVERY_OTHER) + ((v >> np.uint64(8)) & _EVERY_OTHER)
    return pairs[..., 0] + pairs[..., -1] if v.shape[-1] == 2 else pairs[..., 0]


class Bits:
    """Packed fingerprints; similarity is the number of common bits divided by the number of bits in either."""

    def __init__(self, packed: np.ndarray):
        self.x = np.ascontiguousarray(packed).view("<u8")
        self.n = np.bitwise_count(self.x).sum(1).astype("i4")

    def __len__(self):
        return len(self.x)

    def sim(self, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each query (rows of q) to its own row of ids."""
        both = ones(q[:, None, :] & self.x[ids])
        return both / np.maximum(1, qn[:, None] + self.n[ids] - both).astype("f4")

    def one(self, q: np.ndarray, qn: np.ndarray, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of query ``row`` to vector ``ids``, element by element."""
        both = ones(q[row] & self.x[ids])
        return both / np.maximum(1, qn[row] + self.n[ids] - both).astype("f4")

    def take(self, i):
        return self.x[i], self.n[i]

    def sketch(self, tables: int, seed: int) -> np.ndarray:
        """A key for each table and vector; similar vectors often share it (two minimum hashes of the bits that are set)."""
        width = self.x.shape[1] * 64
        rng = np.random.default_rng(seed)
        ranks = [[rng.permutation(width).astype("i4") for _ in range(2)] for _ in range(tables)]
        out = np.zeros((tables, len(self.x)), "i8")
        for lo in range(0, len(self.x), 16_384):
            part = slice(lo, lo + 16_384)
            row, bit = np.nonzero(np.unpackbits(self.x[part].view("u1"), axis=1))
            starts = np.minimum(np.searchsorted(row, np.arange(len(self.x[part]))), max(0, len(row) - 1))
            if len(row):
                for t, pair in enumerate(ranks):
                    for rank in pair:
                        out[t, part] = out[t, part] * width + np.minimum.reduceat(rank[bit], starts)
        return out


class Dense:
    """Vectors of length one; similarity is the cosine."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, "f4")
        self.x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        self.n = np.zeros(len(x), "i4")

    def __len__(self):
        return len(self.x)

    def sim(self, q, qn, ids):
        return np.einsum("qd,qkd->qk", q, self.x[ids])

    def one(self, q, qn, row, ids):
        return np.einsum("kd,kd->k", q[row], self.x[ids])

    def take(self, i):
        return self.x[i], self.n[i]

    def sketch(self, tables: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((self.x.shape[1], tables * 12)).astype("f4")
        sign = (self.x @ planes > 0).reshape(len(self.x), tables, 12)
        return (sign * (1 << np.arange(12))).sum(2).T.astype("i8")


class Graph:
    """Neighbours of each vector; built by inserting batches, each searched for in the graph so far."""

    def __init__(self, space, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 5, passes: int = PASSES):
        self.space, self.degree, self.beam, self.relax = space, degree, beam, relax
        n = len(space)
        # a node may hold half as many links again until it is pruned
        self.links = np.full((n, degree + degree // 2), -1, "i4")
        self.sketches = space.sketch(ENTRIES // 2, seed)
        self.orders = [np.argsort(k, kind="stable") for k in self.sketches]
        self.sorted = [k[o] for k, o in zip(self.sketches, self.orders)]
        self.alive = np.zeros(n, bool)
        rng = np.random.default_rng(seed)
        order, at, size, most = rng.permutation(n), 0, 32, batch_of(n)
        self.start = order[:4].astype("i4")
        while at < n:
            batch = order[at : at + size]
            self._insert(batch)
            at += len(batch)
            size = min(most, size * 2)
        for _ in range(passes - 1):  # again, now that all are there
            for lo in range(0, n, most):
                self._insert(order[lo : lo + most])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("sketches",)}

    def _entries(self, keys: np.ndarray) -> np.ndarray:
        """Where searches begin: nodes next to the query in each table's order, and a few fixed ones."""
        out = [np.repeat(self.start[None, :], keys.shape[1], 0)]
        for t in range(len(self.orders)):
            pos = np.searchsorted(self.sorted[t], keys[t])
            for step in (0, 1):
                out.append(self.orders[t][np.clip(pos + step, 0, len(self.alive) - 1)][:, None])
        return np.concatenate(out, 1).astype("i4")

    def search(self, q, qn, keys, own: np.ndarray | None = None, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first; -1 where it isn't full. own: the query's node, left out.

        In a step each query expands its EXPAND best nodes that are still to be expanded. Each node is compared once with a query;
        those that are no better than the worst of a full beam end there. Queries without a node to expand drop out.
        """
        width, n = beam or self.beam, len(self.alive)
        ids = np.full((len(q), width), -1, "i4")
        sims = np.full((len(q), width), -2.0, "f4")
        done = np.ones((len(q), width), bool)
        # when a node was last named, by which only one of equal ones goes on; 0 is never
        named, tick = np.zeros(len(q) * n, "i4"), 1
        if own is not None:
            named[np.arange(len(q)) * n + own] = tick
            tick += 1
        live = np.arange(len(q))
        first = self._entries(keys)
        if own is not None and self.alive[own].all():
            first = np.concatenate([first, np.where(self.links[own] >= 0, self.links[own], first[:, :1])], 1)
        new = first
        while len(live):
            at = (live[:, None] * n + new).ravel()
            fresh = np.flatnonzero((new.ravel() >= 0) & self.alive[new.ravel()])
            fresh = fresh[named[at[fresh]] == 0]
            mark = np.arange(tick, tick + len(fresh), dtype="i4")
            named[at[fresh]] = mark
            fresh = fresh[named[at[fresh]] == mark]
            tick += len(mark)
            place, node = fresh // new.shape[1], new.ravel()[fresh]
            row = live[place]
            s = self.space.one(q, qn, row, node)
            better = s > sims[row, -1]
            row, node, s = row[better], node[better], s[better]
            if len(row):
                some, start, count = np.unique(row, return_index=True, return_counts=True)
                many = int(count.max())
                slot = np.repeat(np.arange(len(some)), count), np.arange(len(row)) - np.repeat(start, count)
                more_i, more_s = np.full((len(some), many), -1, "i4"), np.full((len(some), many), -2.0, "f4")
                more_i[slot], more_s[slot] = node, s
                all_i, all_s = np.concatenate([ids[some], more_i], 1), np.concatenate([sims[some], more_s], 1)
                all_d = np.concatenate([done[some], more_i < 0], 1)
                top = np.argsort(-all_s, 1, kind="stable")[:, :width]
                ids[some], sims[some], done[some] = (np.take_along_axis(x, top, 1) for x in (all_i, all_s, all_d))
            closed = done[live]
            live = live[~closed.all(1)]
            nearest = np.argsort(done[live], 1, kind="stable")[:, :EXPAND]
            go = ~done[live[:, None], nearest]
            done[live[:, None], nearest] = True
            new = np.where(go[:, :, None], self.links[ids[live[:, None], nearest]], -1).reshape(len(live), -1 if len(live) else 0)
        return ids, sims

    def _prune(self, p: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The diverse neighbours of each point: the nearest candidate stays, and those much nearer to it than to the point go."""
        order = np.argsort(-sims, 1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        left = cand >= 0
        out = np.full((len(p), self.links.shape[1]), -1, "i4")
        for k in range(self.degree):
            some = np.flatnonzero(left.any(1))
            if not len(some):
                break
            pick = left[some].argmax(1)
            c = cand[some, pick]
            out[some, k] = c
            left[some, pick] = False
            # only those that are still left are compared with the one that stays
            row, col = np.nonzero(left[some])
            x, n = self.space.take(c)
            between = self.space.one(x, n, row, cand[some[row], col])
            gone = self.relax * (1 - between) <= 1 - sims[some[row], col]
            left[some[row[gone]], col[gone]] = False
        return out

    def _insert(self, batch: np.ndarray) -> None:
        q, qn = self.space.take(batch)
        ids, sims = self.search(q, qn, self.sketches[:, batch], own=batch)
        old = self.links[batch]
        known = (old[:, :, None] == ids[:, None, :]).any(2) | (old < 0)
        cand = np.concatenate([ids, np.where(known, -1, old)], 1)
        more = np.where(known, -2.0, self.space.sim(q, qn, np.where(known, 0, old)))
        links = self._prune(batch, cand, np.concatenate([sims, more], 1))
        self.links[batch] = links
        self.alive[batch] = True
        # each neighbour gets a link back; those whose room for links is full are pruned again
        src, dst = np.repeat(batch, links.shape[1]), links.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        back = (self.links[src] == dst[:, None]).any(1) & ~(self.links[dst] == src[:, None]).any(1)
        src, dst = src[back], dst[back]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        who, begin, count = np.unique(dst, return_index=True, return_counts=True)
        size = (self.links[who] >= 0).sum(1)
        fits = size + count <= self.links.shape[1]
        one = np.repeat(fits, count)
        self.links[dst[one], (np.repeat(size - begin, count) + np.arange(len(dst)))[one]] = src[one]
        # all links count; nodes with many of them have a table of their own, so that they don't widen that of the rest
        for some in (~fits & (count <= 2 * self.degree), ~fits & (count > 2 * self.degree)):
            for lo in range(0, int(some.sum()), BATCH):
                w, b, c = who[some][lo : lo + BATCH], begin[some][lo : lo + BATCH], count[some][lo : lo + BATCH]
                at = np.minimum(b[:, None] + np.arange(int(c.max())), len(src) - 1)
                cand = np.concatenate([self.links[w], np.where(np.arange(at.shape[1]) < c[:, None], src[at], -1)], 1).astype("i4")
                x, n = self.space.take(w)
                self.links[w] = self._prune(w, cand, np.where(cand < 0, -2.0, self.space.sim(x, n, np.where(cand < 0, 0, cand))))
