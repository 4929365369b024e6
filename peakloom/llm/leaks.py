"""Evaluation passages that stand, wholly or partly, in a corpus.

Texts become lists of word hashes. All 5-grams of the passages are seeds, in a table. Hashed maps of bounded size tell where
a text holds enough 3-grams and seeds of passages for a leak; seeds from there are joined with the table, and each pair of a
text and a passage that share enough of them is aligned.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.peaks import log2_clamp
from peakloom.llm.text import words
from peakloom.operators.skew import hot_keys, salted_join
from peakloom.session import cut

#: A leak has at least LEAST words of the passage, of which at most one in PER is edited.
LEAST, PER = 16, 8
#: Words of a seed. Two edits leave fourteen of sixteen words in three runs, so one run has five words; longer leaks have longer runs.
#: A leak at the limit may hold one seed only, so seeds that are frequent in the corpus can't be left out.
SEED = 5
#: A map of n-grams has 2^15 to 2^28 bits (32 MB at most), 32 for each n-gram until then; a fuller one only lets more texts pass.
LEAST_BITS, MOST_BITS, BITS_EACH = 15, 28, 32
#: A leak of 2 * LEAST words or more has a half that is one too, so there is one of fewer. With e edits its L - e words that are
#: there stand in e + 1 runs within L + e words of the text, so SPAN words of the text hold at least MANY 3-grams and SEEDS seeds
#: of the passage: L - 3e - 2 and L - 5e - 4, which is least for sixteen words and two edits.
SPAN, SHORT, MANY, SEEDS = 34, 3, 8, 2
#: Parts into which the passages that share a seed with one text are cut before they are gathered.
PARTS = 16
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def word_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all lists on end, where each list begins and the last ends)."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = "\0".join(w for x in lists for w in x)
    if not starts[-1]:
        return np.zeros(0, "i8"), starts
    codes = np.frombuffer((flat + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    ends = np.flatnonzero(codes == 0)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(codes)) - np.repeat(begin, ends - begin + 1)
    powers = np.cumprod(np.full(int(place.max()) + 1, _PRIME))
    h = np.add.reduceat(codes * powers[place], begin) + (ends - begin).astype("u8")
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))).view("i8"), starts


def grams(h: np.ndarray, n: int = SEED) -> np.ndarray:
    """Hashes of the n consecutive words from each place on."""
    out = np.zeros(max(0, len(h) - n + 1), "u8")
    for k in range(n if len(out) else 0):
        out = (out ^ h.view("u8")[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return out.view("i8")


def _reach(p: list[int], d: list[int], i: int, j: int, step: int, most: int) -> list[int]:
    """For 0 to ``most`` edits, how many words of ``p`` from ``i`` on (step 1 or -1) can be aligned with those of ``d`` from ``j`` on.

    On each diagonal the furthest reach is kept, as equal words are always worth taking; the last word must be one that is there.
    """
    n, m = (len(p) - i, len(d) - j) if step > 0 else (i + 1, j + 1)
    best, out = -1, []
    front: dict[int, int] = {}
    for edits in range(most + 1):
        new: dict[int, int] = {}
        for k in range(-edits, edits + 1) if edits else (0,):
            # words of p used so far on diagonal k = used(d) - used(p)
            x = 0 if not edits else max(front.get(k, -2) + 1, front.get(k + 1, -2) + 1, front.get(k - 1, -2))
            if x < 0 or x > n or x + k < 0 or x + k > m:
                continue
            y = x
            while y < n and y + k < m and p[i + step * y] == d[j + step * (y + k)]:
                y += 1
            new[k] = y
            if y > x and y > best:
                best = y
        front = new
        out.append(max(best, 0))
    return out


def aligned(p: list[int], d: list[int], i: int, j: int, least: int = LEAST, per: int = PER) -> int:
    """Length of a stretch of ``p`` around the equal words p[i] and d[j] that ``d`` holds with few enough edits, or 0.

    Local (Smith-Waterman) alignment with a budget of edits in place of scores, as the definition counts edits: a changed,
    dropped or added word is an edit, and a stretch begins and ends with words that are there.
    """
    most = 2
    while True:
        right, left = _reach(p, d, i, j, 1, most), _reach(p, d, i - 1, j - 1, -1, most) if i and j else [0] * (most + 1)
        for edits in range(most + 1):
            size = max(right[e] + left[edits - e] for e in range(edits + 1))
            if size >= max(least, per * edits):
                return size
        # further edits can only help where the stretch found so far isn't yet hopeless
        if most >= len(p) // per or right[-1] + left[-1] < least // 2:
            return 0
        most = min(len(p) // per, most * 2)


@lru_cache(maxsize=4096)
def _seeds_of(run: bytes) -> tuple[list[int], frozenset, np.ndarray, list[list[int]]]:
    """A passage's words, their set, its seeds in order, and where each of them stands."""
    h = np.frombuffer(run, "i8")
    where: dict[int, list[int]] = {}
    for at, g in enumerate(grams(h).tolist()):
        where.setdefault(g, []).append(at)
    return h.tolist(), frozenset(h.tolist()), np.array(sorted(where), "i8"), [where[g] for g in sorted(where)]


class Text:
    """A text of a corpus that shares seeds with passages."""

    def __init__(self, h: np.ndarray):
        self.words, g = h.tolist(), grams(h)
        self.order = np.argsort(g, kind="stable")
        self.grams = g[self.order]

    def leaked(self, run: bytes) -> int:
        """Words of a stretch of the passage ``run`` that the text holds, at least LEAST with few enough edits, or 0."""
        p, have, seeds, where = _seeds_of(run)
        d = self.words
        lo, hi = np.searchsorted(self.grams, seeds, "left"), np.searchsorted(self.grams, seeds, "right")
        hits = sorted((int(pos), k) for k in np.flatnonzero(hi > lo).tolist() for pos in self.order[lo[k] : hi[k]])
        done: set = set()
        for pos, k in hits:
            for start in where[k]:
                # back to the beginning of this run of equal words, so that each run is tried once
                i, j = start, pos
                while i and j and p[i - 1] == d[j - 1]:
                    i, j = i - 1, j - 1
                if (i, j) in done:
                    continue
                done.add((i, j))
                first = max(0, j - LEAST)
                if sum(map(have.__contains__, d[first : j + 2 * LEAST])) < LEAST - LEAST // PER:
                    continue
                if size := aligned(p, d, i, j):
                    return size
        return 0


def passage_runs(items: DataFrame) -> DataFrame:
    """(item_id, run, words): the stretches of each item between sentences that another item has too.

    Which sentences occur in more than one item is counted over all items, by their hash. Null ids and passages are left out,
    equal rows count once.
    """
    kind = dict(items.dtypes)["item_id"]

    def sentences(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows, places, lists = [], [], []
            for r, t in enumerate(texts):
                for place, s in enumerate(_SENTENCE.split(t)):
                    if ws := words(s):
                        rows.append(r)
                        places.append(place)
                        lists.append(ws)
            h, starts = word_hashes(lists)
            sig = [h[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), b.column(2).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(sig, pa.binary())], ["item_id", "text", "place", "sentence"]
            )

    def runs(batches):
        for b in batches:
            rows, flat = [], []
            for r, ss in enumerate(b.column(1).to_pylist()):
                run = b""
                for s in [*ss, {"shared": True, "sentence": b""}]:
                    if not s["shared"]:
                        run += s["sentence"]
                    elif run:
                        if len(run) >= 8 * LEAST:
                            rows.append(r)
                            flat.append(run)
                        run = b""
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(flat, pa.binary())], ["item_id", "words"])

    known = items.select("item_id", "passage").where("item_id is not null and passage is not null").distinct()
    cutted = cut(known.select("item_id", "passage", F.xxhash64("passage").alias("text")).mapInArrow(sentences, f"item_id {kind}, text bigint, place int, sentence binary"), "sentences")
    shared = cutted.groupBy("sentence").agg(F.count_distinct("item_id").alias("n")).where("n > 1").select("sentence", F.lit(True).alias("shared"))
    marked = cutted.join(shared, "sentence", "left").select("item_id", "text", F.struct("place", F.coalesce("shared", F.lit(False)).alias("shared"), "sentence").alias("s"))
    # the sentences of one passage
    whole = marked.groupBy("item_id", "text").agg(F.array_sort(F.collect_list("s")).alias("s")).select("item_id", "s")
    found = whole.mapInArrow(runs, f"item_id {kind}, words binary").distinct()
    return cut(found.withColumn("run", F.xxhash64("item_id", "words")), "runs")


def _map(rows: DataFrame) -> tuple[np.ndarray, np.int64]:
    """One bit for each slot of the hashed n-grams, and the mask that makes a slot of a hash."""
    bits = log2_clamp(float(BITS_EACH * max(1, rows.count())), LEAST_BITS, MOST_BITS)
    slot = F.col("gram").bitwiseAND((1 << bits) - 1)
    parts = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    out = np.zeros(1 << bits, bool)
    for bucket, part in parts.toLocalIterator():  # at most 2^13 parts of 4 kB
        lo = (bucket - 1) << 15
        out[lo : lo + (1 << 15)] = np.unpackbits(np.frombuffer(bytes(part), "u1"), bitorder="little").astype(bool)
    return np.packbits(out), np.int64((1 << bits) - 1)


def _known(table: tuple[np.ndarray, np.int64], g: np.ndarray) -> np.ndarray:
    slot = g & table[1]
    return (table[0][slot >> 3] >> (7 - (slot & 7)).astype("u1") & 1).astype(bool)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold at least sixteen consecutive words of a passage, at most one in eight edited.

    Documents are normalised once, in one pass; texts without a seed end there. Equal texts are compared once and every copy
    comes out. n_words is the longest stretch that was found first, of the item's runs. Null and empty texts and passages give
    nothing; repeated documents come out once for each row; without items or documents the result is empty.
    """
    kind, item_kind = dict(documents.dtypes)[doc_id], dict(items.dtypes)["item_id"]
    runs = passage_runs(items)

    def grams_of(n: int):
        def run(batches):
            for b in batches:
                lists = [np.unique(grams(np.frombuffer(w, "i8"), n)) for w in b.column(1).to_pylist()]
                size = [len(x) for x in lists]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.concatenate(lists) if lists else np.zeros(0, "i8"))], ["run", "gram"])

        return cut(runs.select("run", "words").mapInArrow(run, "run bigint, gram bigint"), "grams")

    seeds = grams_of(SEED)
    shared = documents.sparkSession.sparkContext.broadcast((_map(seeds), _map(grams_of(SHORT))))

    def probe(batches):
        long, short = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                h, starts = word_hashes([words(t) for t in part.column(1).to_pylist()])
                # places from which on SPAN words hold enough 3-grams, then all places within such a stretch
                few = np.concatenate([[0], np.cumsum(_known(short, grams(h, SHORT)))])
                n = np.arange(len(h) + 1)
                full = few[np.minimum(n + SPAN, len(few) - 1)] - few[np.minimum(n, len(few) - 1)] >= MANY
                within = np.cumsum(np.bincount(n[full], minlength=len(h) + 1) - np.bincount(np.minimum(n[full] + SPAN, len(h)), minlength=len(h) + 1)) > 0
                g = grams(h)
                at = np.flatnonzero(within[: len(g)])
                hit = at[_known(long, g[at])]
                row = np.searchsorted(starts, hit, "right") - 1
                inside = hit + SEED <= starts[row + 1]  # not across two texts
                hit, row = hit[inside], row[inside]
                keep, first = np.unique(row, return_index=True)
                found = [np.unique(g[hit[x:y]], return_counts=True) for x, y in zip(first, np.append(first[1:], len(row)))]
                keep, found = zip(*[(r, f) for r, f in zip(keep, found) if f[1].sum() >= SEEDS]) if len(keep) and any(f[1].sum() >= SEEDS for f in found) else ((), ())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype("i4"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found]) if found else np.zeros(0, "i8"))) for k in (0, 1)]
                text = [h[starts[r] : starts[r + 1]].tobytes() for r in keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(text, pa.binary()), *lists], [doc_id, "words", "grams", "counts"])

    rows = documents.select(F.col(doc_id), F.col("text")).where("text is not null")
    passed = rows.mapInArrow(probe, f"{doc_id} {kind}, words binary, grams array<bigint>, counts array<bigint>")
    held = cut(passed.withColumn("sig", F.md5("words")), "texts")
    texts = held.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("words", "grams", "counts")])
    wanted = texts.select("sig", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("sig", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))
    hot = hot_keys(wanted.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    pairs = salted_join(wanted, seeds, "gram", hot, "sig", "inner").groupBy("sig", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEDS).select("sig", "run")
    # a text meets the passages that share a seed with it in PARTS parts
    near = pairs.join(runs.select("run", "item_id", "words"), "run").groupBy("sig", F.pmod("run", F.lit(PARTS)).alias("part")).agg(F.collect_list("item_id").alias("items"), F.collect_list("words").alias("runs"))

    def align(batches):
        for b in batches:
            sigs, at, ids, size = [], [], [], []
            offsets = b.column(2).offsets.to_numpy()
            for r, (text, ps) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist())):
                whole = Text(np.frombuffer(text, "i8"))
                for k, p in enumerate(ps):
                    if n := whole.leaked(p):
                        sigs.append(r)
                        at.append(offsets[r] - offsets[0] + k)
                        size.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(sigs, pa.int64())), b.column(2).flatten().take(pa.array(at, pa.int64())), pa.array(size, pa.int32())], ["sig", "item_id", "n_words"])

    # few rows of much work: as many tasks as there are places for
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = near.join(texts.select("sig", "words"), "sig").select("sig", "words", "items", "runs").repartition(tasks).mapInArrow(align, f"sig string, item_id {item_kind}, n_words int")
    once = found.groupBy("sig", "item_id").agg(F.max("n_words").alias("n_words"))
    return held.select(doc_id, "sig").join(once, "sig").select(doc_id, "item_id", "n_words")
