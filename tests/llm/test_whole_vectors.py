"""Nearest vectors against brute force over what the tables hold."""

import numpy as np

from peakloom.llm import neighbours as N
from peakloom.session import table
from test_vectors import exact, family, frame


def peaks(mzs, intensities):
    """Cells of a peak list and their weights, without hashing."""
    v = {}
    for m, a in zip(mzs or [], intensities or []):
        if m is not None and a is not None and np.isfinite(m) and np.isfinite(a) and a > 0:
            x = m / 0.05 - 0.5
            c = int(np.floor(x))
            for cell, w in ((c, c + 1 - x), (c + 1, x - c)):
                v[cell] = v.get(cell, 0.0) + a**0.5 * w
    size = sum(w * w for w in v.values()) ** 0.5
    return {c: w / size for c, w in v.items()} if size else {}


def test_spectra_equal_brute_force(spark, data, monkeypatch):
    s = table(spark, "/root/testdata/sf0.01", "train_spectra")
    whole = {r.rid: peaks(r.ms2_mzs, r.ms2_normalized_intensities) for r in s.select("rid", "ms2_mzs", "ms2_normalized_intensities").collect() if len(r.ms2_mzs or []) == len(r.ms2_normalized_intensities or [])}
    whole = {i: v for i, v in whole.items() if v}
    cells = {c: k for k, c in enumerate(sorted({c for v in whole.values() for c in v}))}
    ids = np.array(sorted(whole))
    x = np.zeros((len(ids), len(cells)))
    for k, i in enumerate(ids):
        for c, w in whole[i].items():
            x[k, cells[c]] = w
    asked = np.flatnonzero(ids % 100 == 0)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    at, place = {r: k for k, r in enumerate(ids[asked])}, {r: k for k, r in enumerate(ids)}
    for block in (8192, 4):
        monkeypatch.setattr(N, "ASKED", block, raising=False)
        rows = sorted((r.rid, r["rank"], r.other, r.sim) for r in N.similar_spectra(s).collect())
        assert [(r[0], r[1]) for r in rows] == [(i, k) for i in ids[asked] for k in range(1, 6)]
        for rid, rank, other, sim in rows:
            assert abs(sims[at[rid], place[other]] - sim) < 1e-5
            assert abs(-np.sort(-sims[at[rid]])[rank - 1] - sim) < 1e-5


def test_queries_search_all_shards_at_every_size(spark):
    df = frame(spark, list(enumerate(family(np.random.default_rng(5), 2500))))
    classes = N.classes_of(N.usable(df).select("sid", "fp"), "sid", "fp", 6)
    # more than twenty shards
    found = N.class_neighbours(classes, "bits", 5, shard=100).collect()
    pairs = {(min(r.rep, r.other), max(r.rep, r.other)) for r in found}
    want = exact([(r.rep, bytes(r.vec)) for r in classes.collect()])
    assert len(pairs & want) / len(want) > 0.99
