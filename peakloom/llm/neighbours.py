"""The most similar vectors of every vector, by robust-pruned directed graphs over shards of all vectors."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.peaks import flat_peaks
from peakloom.llm.graph import ENTRIES, Bits, Dense, Graph, batch_of, ones
from peakloom.operators.blocks import nearest_by_cells
from peakloom.operators.skew import hot_keys, salted_join
from peakloom.session import cut

K = 5
FP_BYTES = 128
#: Distinct vectors of a shard, and those up to which its searches keep the beam of SPACES; in larger shards the beam grows so that recall doesn't fall. Small inputs are cut into up to FEW shards of at least a few thousand for the sake of parallel work.
SHARD, PLAIN, FEW, SMALL = 131_072, 32_768, 6, 8_192
#: Where a query isn't to search all shards: pivots are the first rows of a hash order, PIVOTS a shard, MOST_PIVOTS at most; a row is indexed with its COPIES nearest ones.
PIVOTS, MOST_PIVOTS, COPIES = 8, 4_096, 2
#: Queries of one search task: at least the first number, at most the second; in between, as few as make TASKS tasks.
QUERIES, MOST_QUERIES, TASKS = 16_384, 262_144, 64
SEED = 5


def _bits(blobs) -> Bits:
    return Bits(np.frombuffer(b"".join(blobs), "u1").reshape(len(blobs), -1))


def _dense(blobs) -> Dense:
    return Dense(np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), -1))


#: How each kind of vector is read, how its graphs are built, and the beam of its searches.
SPACES = {"bits": (_bits, {"degree": 20}, 48), "dense": (_dense, {"degree": 16, "beam": 24, "passes": 1}, 320)}


def _exact(space, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if isinstance(space, Bits):
        both = ones(q[:, None, :] & space.x[ids])
        return both / np.maximum(1, qn[:, None] + space.n[ids] - both).astype("f8")
    return space.sim(q, qn, ids).astype("f8")


def beam_of(beam: int, n: int) -> int:
    """The beam of searches in a shard of ``n`` vectors."""
    return max(beam, int(beam * (n / PLAIN) ** (2 / 3)))


def classes_of(rows: DataFrame, ident: str, vector: str, keep: int) -> DataFrame:
    """(vec, rep, n, first): each distinct vector, its smallest id, its number of rows and its ``keep`` smallest ids."""
    base = rows.select(F.col(ident).alias("id"), F.col(vector).alias("vec")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int"))
    local = base.withColumn("r", F.row_number().over(Window.partitionBy("vec", "part").orderBy("id"))).withColumn("c", F.count("*").over(Window.partitionBy("vec", "part"))).where(F.col("r") <= keep)
    whole = Window.partitionBy("vec")
    few = local.withColumn("n", F.sum(F.when(F.col("r") == 1, F.col("c")).otherwise(0)).over(whole)).withColumn("s", F.row_number().over(whole.orderBy("id"))).where(F.col("s") <= keep)
    return few.groupBy("vec").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.array_sort(F.collect_list("id")).alias("first"))


def _top_pivots(space: str, pivots: list[bytes], most: int):
    """A function that adds to (rep, vec) the numbers of the ``most`` nearest pivots."""
    make = SPACES[space][0]

    def run(batches):
        fixed = make(pivots)
        for pdf in batches:
            rows = make(pdf.vec.tolist())
            near = []
            for lo in range(0, len(rows), 256):
                x, n = rows.take(np.arange(lo, min(lo + 256, len(rows))))
                if isinstance(rows, Bits):
                    both = np.stack([np.bitwise_count(x & p).sum(1, dtype="i4") for p in fixed.x], 1)
                    s = both / np.maximum(1, n[:, None] + fixed.n[None] - both)
                else:
                    s = x @ fixed.x.T
                near.append(np.argsort(-s, 1, kind="stable")[:, :most])
            yield pdf.assign(pivots=list(np.concatenate(near).astype("i4")) if near else [])

    return run


def _routes(classes: DataFrame, asked: DataFrame, space: str, n: int, shard: int, probes: int | None) -> tuple[int, DataFrame, DataFrame]:
    """(shards, index rows, queries), both as (rep, vec, s).

    Without ``probes`` rows are dealt by a hash and every query goes to all shards, however many. With fewer probes than
    shards, rows go to the shards of their nearest pivots, queries to the shards of theirs. A pivot with more than a shard of rows has several shards, dealt by a hash, and all of
    them are searched; so equal or similar rows in any number don't overfill one.
    """
    shards = max(1, -(-n // shard), min(FEW, -(-n // SMALL)))
    if probes is None or shards <= probes:
        dealt = classes.select("rep", "vec", F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("s"))
        return shards, dealt, asked.select("rep", "vec", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    kind = dict(classes.dtypes)["rep"]
    pivots = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(min(MOST_PIVOTS, PIVOTS * shards)).select("vec").collect()]
    routed = lambda df: df.select("rep", "vec").mapInPandas(_top_pivots(space, pivots, 2 * probes), f"rep {kind}, vec binary, pivots array<int>")
    own = cut(routed(classes), "routed")
    indexed = own.select("rep", "vec", F.explode(F.slice("pivots", 1, COPIES)).alias("pivot"))
    # one row a pivot
    sizes = {r[0]: r[1] for r in indexed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    places: list[list[int]] = [[] for _ in pivots]
    room: list[int] = []
    for p in sorted(sizes, key=lambda p: (-sizes[p], p)):
        if sizes[p] >= shard // 2:
            for _ in range(-(-sizes[p] // shard)):
                places[p].append(len(room))
                room.append(shard)
            continue
        fit = next((i for i, used in enumerate(room) if used + sizes[p] <= shard), None)
        if fit is None:
            fit = len(room)
            room.append(0)
        room[fit] += sizes[p]
        places[p].append(fit)
    table = F.array(*[F.array(*[F.lit(x) for x in ps]) if ps else F.array().cast("array<int>") for ps in places])
    at = F.element_at(table, F.col("pivot") + 1)
    dealt = indexed.select("rep", "vec", F.element_at(at, (F.pmod(F.xxhash64("rep"), F.size(at)) + 1).cast("int")).alias("s")).distinct()
    asked = own if asked is classes else routed(asked)
    spots = F.slice(F.array_distinct(F.flatten(F.transform("pivots", lambda p: F.element_at(table, p + 1)))), 1, 2 * probes)
    first = F.flatten(F.transform(F.slice("pivots", 1, COPIES), lambda p: F.element_at(table, p + 1)))
    # all shards of the nearest pivots, then further ones up to the number of probes
    goal = F.array_distinct(F.concat(first, F.slice(spots, 1, probes)))
    return len(room), dealt, asked.select("rep", "vec", F.explode(goal).alias("s"))


def class_neighbours(classes: DataFrame, space: str, k: int, queries: DataFrame | None = None, shard: int = SHARD, probes: int | None = None) -> DataFrame:
    """(rep, other, sim): for each class (or each of ``queries``, which has rep and vec) its k most similar other classes.

    Each shard builds its graph once and keeps it as one row of a table; each block of queries searches in the shards it is
    sent to, one task for each: all shards, unless ``probes`` limits them at some loss of recall. Ties go to the smaller id.
    """
    make, settings, beam = SPACES[space]
    n = classes.count()
    kind = dict(classes.dtypes)["rep"]
    asked = classes if queries is None else queries
    count = n if queries is None else asked.count()
    shards, dealt, asked = _routes(classes, asked, space, n, shard, probes)

    def build(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            pdf = pd.concat(parts).sort_values("rep")
            graph = Graph(make(pdf.vec.tolist()), **settings)
            yield pd.DataFrame({"s": [pdf.s.iloc[0]], "graph": [zlib.compress(pickle.dumps((pdf.rep.to_numpy(), graph), 5), 1)]})

    # each shard is a partition of its own
    graphs = cut(dealt.select("rep", "vec", F.col("s").cast("int").alias("s")).repartitionById(shards, F.col("s").cast("int")).mapInPandas(build, "s int, graph binary"), "graphs")
    # one task for each shard and block of queries
    each = count * min(1.0, (probes or shards) / shards)
    blocks = max(1, -(-int(each) // MOST_QUERIES), min(-(-int(each) // QUERIES), -(-TASKS // shards)))
    asked = asked.select("rep", "vec", (F.col("s") * blocks + F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks))).cast("int").alias("task"), F.lit(None).cast("binary").alias("graph"))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.lit(0).cast(kind).alias("rep"), F.lit(None).cast("binary").alias("vec"), (F.col("s") * blocks + F.col("block")).cast("int").alias("task"), "graph")

    def search(batches):
        graph, queries = None, []
        for pdf in batches:
            own = pdf.graph.notna()
            if own.any():
                reps, graph = pickle.loads(zlib.decompress(pdf.graph[own].iloc[0]))
            queries.append(pdf.loc[~own, ["rep", "vec"]])
        if graph is None or not sum(map(len, queries)):
            return
        q = pd.concat(queries)
        asked, mine = make(q.vec.tolist()), q.rep.to_numpy().astype(reps.dtype)
        keys = asked.sketch(ENTRIES // 2, SEED)
        each, width = batch_of(len(reps)), beam_of(beam, len(reps))
        for lo in range(0, len(mine), each):
            rows = np.arange(lo, min(lo + each, len(mine)))
            x, xn = asked.take(rows)
            ids, _ = graph.search(x, xn, keys[:, rows], beam=width)
            sims = _exact(graph.space, x, xn, np.maximum(ids, 0))
            other = reps[np.maximum(ids, 0)]
            bad = (ids < 0) | (other == mine[rows][:, None])
            order = np.lexsort((other, np.where(bad, 9.0, -sims)), axis=1)[:, :k]
            other, sims, bad = (np.take_along_axis(v, order, 1) for v in (other, sims, bad))
            who = np.repeat(mine[rows], order.shape[1])[~bad.ravel()]
            yield pd.DataFrame({"rep": who, "other": other.ravel()[~bad.ravel()], "sim": sims.ravel()[~bad.ravel()]})

    found = graphs.unionByName(asked).repartitionById(shards * blocks, F.col("task")).mapInPandas(search, f"rep {kind}, other {kind}, sim double")
    # a row that is in two shards can be found twice
    best = Window.partitionBy("rep").orderBy(F.col("sim").desc(), "other")
    return found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, ident: str, vector: str, space: str = "bits", k: int = K, asked: Column | None = None) -> DataFrame:
    """(id, other, sim, rank): the k most similar other rows of every row, or of the rows for which ``asked`` holds.

    Rows with a null id or vector are left out. Equal vectors are searched once: a class of copies answers with its smallest
    ids, so however many copies there are, a row gets k others. Ties go to the smaller id. Every row is in the index; the
    search is approximate, and its recall is measured in the tests.
    """
    rows = rows.where(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    classes = cut(classes_of(rows, ident, vector, k + 1), "classes")
    wanted = rows if asked is None else rows.where(asked)
    queries = None if asked is None else classes.join(wanted.select(F.col(vector).alias("vec")).distinct(), "vec", "left_semi")
    near = class_neighbours(classes, space, k, queries)
    # the k best ids of other classes, the same for all rows of a class
    members = near.join(classes.select(F.col("rep").alias("other"), F.slice("first", 1, k).alias("ids")), "other").select("rep", F.explode(F.col("ids")).alias("o"), "sim")
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("sim").desc(), "o"))).where(F.col("r") <= k)
    others = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("o").alias("o")))).alias("others"))
    answers = cut(classes.join(others, "rep", "left").select("vec", "n", "first", F.coalesce("others", F.array().cast(dict(others.dtypes)["others"])).alias("others")), "answers")
    whole = salted_join(wanted.select(F.col(ident).alias("id"), F.col(vector).alias("vec")), answers.drop("n"), "vec", hot_keys(answers, "vec"), "id", "inner")
    own = F.transform(F.array_remove(F.col("first"), F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("o")))
    best = F.slice(F.concat(own, F.col("others")), 1, k)
    return whole.select("id", F.posexplode(best).alias("pos", "b")).select("id", F.col("b.o").alias("other"), (-F.col("b.d")).alias("sim"), (F.col("pos") + 1).alias("rank"))


def usable(structs: DataFrame) -> DataFrame:
    """Structures whose fingerprint has 128 bytes and any bit set."""
    return structs.where((F.length("fp") == FP_BYTES) & (F.hex("fp").rlike("[1-9A-F]")))


def similar_structures(structs: DataFrame, k: int = K) -> DataFrame:
    """(sid_a, sid_b): pairs of which at least one is among the k most similar others of the other."""
    found = nearest(usable(structs).select("sid", "fp"), "sid", "fp", "bits", k)
    return found.select(F.least("id", "other").alias("sid_a"), F.greatest("id", "other").alias("sid_b")).distinct()


#: The width of a spectrum's m/z cells, and the queries that are compared at once.
CELL, ASKED = 0.05, 8_192


def spectrum_cells(spectra: DataFrame, ident: str = "rid") -> DataFrame:
    """(id, cells, weights): square roots of intensities in m/z cells, each peak shared between two cells, with length one."""

    def run(batches):
        for b in batches:
            row, m, a, _ = flat_peaks(b.column(1), b.column(2))
            low = np.floor(m / CELL - 0.5)
            part = m / CELL - 0.5 - low
            rows, cells = np.concatenate([row, row]), np.concatenate([low, low + 1]).astype("i8")
            w = np.concatenate([np.sqrt(a) * (1 - part), np.sqrt(a) * part])
            order = np.lexsort((cells, rows))
            rows, cells, w = rows[order], cells[order], w[order]
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (cells[1:] != cells[:-1])][: len(rows)])
            rows, cells, w = rows[first], cells[first], np.add.reduceat(w, first) if len(first) else w
            w = w / np.sqrt(np.bincount(rows, w * w, minlength=b.num_rows))[rows]
            n = np.bincount(rows, minlength=b.num_rows)
            keep = n > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(n[keep])]).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(offsets, pa.array(cells)), pa.ListArray.from_arrays(offsets, pa.array(w.astype("f4")))], ["id", "cells", "weights"]
            )

    rows = spectra.select(F.col(ident).alias("id"), F.col("ms2_mzs").cast("array<double>"), F.col("ms2_normalized_intensities").cast("array<double>"))
    return rows.where("id is not null and size(ms2_mzs) > 0").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, cells array<bigint>, weights array<float>")


def spectrum_vectors(spectra: DataFrame, ident: str = "rid") -> DataFrame:
    """(id, vec): the same as numbers for all cells that occur, for comparisons on small tables."""
    found = spectrum_cells(spectra, ident)
    # one row a cell
    known = np.array(sorted(r[0] for r in found.select(F.explode("cells")).distinct().collect()), "i8")

    def run(batches):
        for b in batches:
            v = np.zeros((b.num_rows, len(known)), "<f4")
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            v[row, np.searchsorted(known, b.column(1).flatten().to_numpy())] = b.column(2).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "vec"])

    return found.mapInArrow(run, f"id {dict(found.dtypes)['id']}, vec binary")


def similar_spectra(spectra: DataFrame, k: int = K) -> DataFrame:
    """(rid, other, sim, rank): for every spectrum whose rid is divisible by 100, the k most similar of all spectra.

    Exact: blocks of ASKED queries, by cell, meet all spectra where these are read. Ties go to the smaller id. A spectrum's
    similarity with ids that share no cell is 0; such ids come last.
    """
    every = spectrum_cells(spectra)
    queries = cut(spectrum_cells(spectra.where("rid % 100 = 0")), "asked")
    return nearest_by_cells(every, queries, k, zeros=True, each=ASKED).select(F.col("query").alias("rid"), "other", "sim", "rank")
