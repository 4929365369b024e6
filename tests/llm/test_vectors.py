"""Nearest vectors."""

import numpy as np
import pytest

from peakloom.llm import neighbours as N
from peakloom.llm.graph import Bits, Dense, Graph
from peakloom.session import table


def exact(rows, k=5):
    """The k most similar others of each row, ties to the smaller id."""
    rows = sorted((i, fp) for i, fp in rows if i is not None and fp is not None and len(fp) == 128 and any(fp))
    ids = np.array([i for i, _ in rows])
    b = np.unpackbits(np.frombuffer(b"".join(fp for _, fp in rows), "u1").reshape(-1, 128), axis=1).astype("f8")
    both = b @ b.T
    n = b.sum(1)
    s = both / (n[:, None] + n[None] - both)
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in top[i] if s[i, j] >= 0}


def family(rng, n, spread=6):
    out = []
    while len(out) < n:
        core = rng.random(1024) < 0.06
        for _ in range(int(rng.integers(1, 12))):
            x = core.copy()
            x[rng.integers(0, 1024, spread)] ^= True
            out.append(np.packbits(x).tobytes())
    return out[:n]


SCHEMA = "sid bigint, fp binary, id bigint, vec string, n int, rep int, first string"


def frame(spark, rows):
    return spark.createDataFrame([(i, fp, 1, "v", 2, 3, "f") for i, fp in rows], SCHEMA)


def test_pairs_of_odd_rows(spark):
    fps = family(np.random.default_rng(0), 150)
    rows = list(enumerate(fps)) + [(1000 + i, fps[0]) for i in range(40)] + [(2000, None), (2001, b""), (2002, bytes(128)), (2003, fps[1][:64]), (2004, b"\x80" + bytes(127)), (2005, b"\xff" * 128), (None, fps[2])]
    got = {(r.sid_a, r.sid_b) for r in N.similar_structures(frame(spark, [(i, bytes(f) if f is not None else None) for i, f in rows])).collect()}
    want = exact(rows)
    assert len(got & want) / len(want) > 0.98 and len(got & want) / len(got) > 0.98
    # the copies come out by id, whatever the search finds
    assert all((a, b) in got for a, b in [(0, 1000), (1000, 1001), (1003, 1039)])
    assert N.similar_structures(frame(spark, [])).count() == 0
    assert N.similar_structures(frame(spark, rows[:1])).count() == 0
    assert [tuple(r) for r in N.similar_structures(frame(spark, rows[:2])).collect()] == [(0, 1)]


def test_recall_on_the_tables(spark, data):
    structs = table(spark, "/root/testdata/sf0.1", "train_structs")
    got = {(r.sid_a, r.sid_b) for r in N.similar_structures(structs).collect()}
    want = exact([(r.sid, bytes(r.fp) if r.fp is not None else None) for r in structs.select("sid", "fp").collect()])
    assert len(got & want) / len(want) > 0.95


def test_routing_to_many_small_shards(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(family(rng, 3000)))
    # a tenth of all rows are variants of one structure, more than a shard holds
    core = np.unpackbits(np.frombuffer(rows[0][1], "u1"))
    for i in range(300):
        x = core.copy()
        x[rng.integers(0, 1024, 3)] ^= 1
        rows.append((5000 + i, np.packbits(x).tobytes()))
    df = frame(spark, rows)
    classes = N.classes_of(N.usable(df).select("sid", "fp"), "sid", "fp", 6)
    got = {}
    for r in N.class_neighbours(classes, "bits", 5, shard=200, probes=4).collect():
        got.setdefault(r.rep, set()).add(r.other)
    all_reps = [(r.rep, bytes(r.vec)) for r in classes.collect()]
    want = exact(all_reps)
    pairs = {(min(a, b), max(a, b)) for a, bs in got.items() for b in bs}
    assert len(got) == len(all_reps) and {len(v) for v in got.values()} == {5}
    assert len(pairs & want) / len(want) > 0.9


@pytest.mark.parametrize("kind", ["bits", "dense"])
def test_graph_recall(kind):
    rng = np.random.default_rng(2)
    if kind == "bits":
        x = np.unique(np.frombuffer(b"".join(family(rng, 3000)), "u1").reshape(-1, 128), axis=0)
        space, b = Bits(x), np.unpackbits(x, axis=1).astype("f4")
        both, n = b @ b.T, b.sum(1)
        sims = both / (n[:, None] + n[None] - both)
    else:
        centres = rng.standard_normal((60, 32))
        x = (centres[rng.integers(0, 60, 3000)] + 0.4 * rng.standard_normal((3000, 32))).astype("f4")
        space = Dense(x)
        sims = space.x @ space.x.T
    np.fill_diagonal(sims, -2)
    g = Graph(space, degree=20, beam=40, passes=1)
    rows = np.arange(0, len(space), 7)
    q, qn = space.take(rows)
    _, found = g.search(q, qn, g.sketches[:, rows], own=rows, beam=64)
    kth = -np.sort(-sims[rows], axis=1)[:, 4]
    assert ((found[:, :5] >= kth[:, None] - 1e-5).sum(1) / 5).mean() > 0.9
    assert (g.links != np.arange(len(space))[:, None]).all()


def test_spectra(spark, data):
    s = table(spark, "/root/testdata/sf0.01", "train_spectra")
    rows = N.similar_spectra(s).collect()
    vec = sorted((r[0], bytes(r[1])) for r in N.spectrum_vectors(s).collect())
    ids = np.array([v[0] for v in vec])
    x = np.frombuffer(b"".join(v[1] for v in vec), "<f4").reshape(len(vec), -1)
    asked = np.flatnonzero(ids % 100 == 0)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    kth = -np.sort(-sims, axis=1)[:, 4]
    by = {}
    for r in rows:
        by.setdefault(r.rid, []).append(r.sim)
    assert {len(v) for v in by.values()} == {5} and set(by) == set(ids[asked])
    assert np.mean([sum(v >= kth[i] - 1e-4 for v in by[ids[a]]) / 5 for i, a in enumerate(asked)]) > 0.9
    assert N.similar_spectra(s.limit(0)).count() == 0


def test_a_million_vectors_make_few_shards(spark):
    # a query searches all shards, so its work grows with their number
    classes = spark.createDataFrame([(i, bytes([i]) * 128) for i in range(1, 30)], "rep bigint, vec binary")
    shards, dealt, asked = N._routes(classes, classes, "bits", 1_000_000, N.SHARD, None)
    assert N.beam_of(48, 8_000) == N.beam_of(48, 32_768) == 48 and N.beam_of(48, 71_342) == 80
    assert shards <= 8 and dealt.count() == 29 and asked.count() == 29 * shards


def test_large_graphs_are_searched_in_small_batches():
    from peakloom.llm import graph

    assert [graph.batch_of(n) for n in (0, 1, 30_000, 65_536)] == [512] * 4
    assert all(graph.batch_of(n) * n <= graph.NAMED for n in (100_000, N.SHARD, 1_000_000))
    x = np.random.default_rng(3).integers(0, 256, (16_400, 128)).astype("u1")
    whole = graph.Bits(x).sketch(2, 5)
    assert (whole[:, 16_380:] == graph.Bits(x[16_380:]).sketch(2, 5)).all()
