"""Splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.keys import record_key, structure_key
from peakloom.operators.skew import bucketed_prefix, hot_keys, salted_join
from peakloom.session import cut, few, release

#: Splits at most; more are an error.
MOST_SPLITS = 10_000
#: Bits of the subset-sum sets that are kept at once (128 MB).
ROOM = 1 << 30


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label): connected components of the undirected edges (u, v), labelled by their smallest node.

    Parallel hooking and shortcutting over a parent table: in each round every tree hooks onto the smallest grandparent that
    an edge shows it, and every node shortcuts to its grandparent; the rounds grow as the logarithm of the longest path.
    Edges with a null end and loops are ignored; nodes are those of the other edges.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    step = cut(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")), "parent")
    for _ in range(max_rounds):
        parent = step.select("node", "parent")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        seen = parent.join(up, "parent")  # node, parent, grand
        here, there = seen.select(F.col("node").alias("u"), F.col("parent").alias("pu")), seen.select(F.col("node").alias("v"), F.col("grand").alias("gv"))
        offers = e.join(here, "u").join(there, "v").select(F.explode(F.array(F.struct(F.col("pu").alias("node"), F.col("gv").alias("to")), F.struct(F.col("u").alias("node"), F.col("gv").alias("to")))).alias("o")).select("o.node", "o.to")
        offers = offers.union(seen.select("node", "grand"))
        new = offers.groupBy("node").agg(F.min("to").alias("to"))
        last, step = step, cut(parent.join(new, "node").select("node", F.least("parent", "to").alias("parent"), (F.col("to") < F.col("parent")).alias("moved")), "parent")
        release(last)  # the new round stands
        if step.where("moved").isEmpty():
            release(e)
            return step.select("node", F.col("parent").alias("label"))
    raise RuntimeError("components did not settle")


def group_keys(structs: DataFrame) -> DataFrame:
    """(key, group_key) of the structures that lead to another one or are led to.

    A structure with a null key or its own stands for itself. The group key is the end of the chain; where the chain runs in
    a circle, it is the circle's smallest key. Of repeated structures that lead to different ones, the smallest lead counts.
    """
    leads = structs.select(structure_key("inchikey14").alias("u"), structure_key("key").alias("v")).where("u is not null and v is not null and u <> v").groupBy("u").agg(F.min("v").alias("v"))
    leads = cut(leads, "leads")
    comp = components(leads)
    ends = comp.join(leads.select(F.col("u").alias("node")), "node", "left_anti").groupBy("label").agg(F.min("node").alias("end"))
    return comp.join(ends, "label", "left").select(F.col("node").alias("key"), F.coalesce("end", "label").alias("group_key"))


def keyed_records(records: DataFrame, structs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records as (rid, inchikey14, key, group_key), and (group_key, n)."""
    rows = records.select("rid", "inchikey14", record_key().alias("key"))
    counts = cut(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")), "counts")
    links = group_keys(structs)
    named = cut(counts.join(links, "key", "left").select("key", F.coalesce("group_key", "key").alias("group_key"), "n"), "named")
    out = salted_join(rows, named.select("key", "group_key"), "key", hot_keys(counts, "key"), "rid", "left")
    return out, named.groupBy("group_key").agg(F.sum("n").alias("n"))


def moved_records(records: DataFrame, structs: DataFrame) -> DataFrame:
    """(rid, group_key) of the records whose stored inchikey14 isn't exactly the group key."""
    out, _ = keyed_records(records, structs)
    return out.where("group_key is not null and (inchikey14 is null or inchikey14 <> group_key)").select("rid", "group_key")


def closest_subset(sizes: dict[int, int], goal: int, room: int = ROOM) -> dict[int, int]:
    """How many groups of each size to take so that their total is as near to ``goal`` as any choice can be.

    ``sizes`` has the multiplicity of each size. Bit t of a set says that total t can be reached; each size adds 1, 2, 4, ...
    of its groups at a time, by a shift and an or. Of two equally near totals the smaller is taken. On the way back the sets are
    needed once more: one in about the root of their number is kept, and the sets between two of those are made again. Where
    that would be more than ``room`` bits, fewer are kept and more made again, with the same result.
    """
    goal = max(0, int(goal))
    limit = 2 * goal + 1  # beyond twice the goal, taking nothing is nearer
    mask = (1 << (limit + 1)) - 1
    items = []
    for size in sorted(sizes, reverse=True):
        left, step = min(sizes[size], limit // size if size else 0), 1
        while left > 0:
            take = min(step, left)
            items.append((size, take))
            left, step = left - take, step * 2
    add = lambda bits, item: (bits | (bits << (item[0] * item[1]))) & mask
    most = max(2, min(math.isqrt(len(items)) + 1, room // (2 * (limit + 1))))
    out: dict[int, int] = {}

    def back(lo: int, hi: int, reach: int, total: int | None) -> int:
        """The total before item ``lo``; None stands for the best total that all items reach."""
        if hi - lo == 1 and total is not None:
            if not reach >> total & 1:
                size, take = items[lo]
                total -= size * take
                out[size] = out.get(size, 0) + take
            return total
        every, kept = max(1, -(-(hi - lo) // most)), []
        for i in range(lo, hi if total is None else hi - 1):
            if (i - lo) % every == 0:
                kept.append(reach)
            reach = add(reach, items[i])
        if total is None:
            total = _nearest(reach, goal)
        elif (hi - 1 - lo) % every == 0:
            kept.append(reach)
        for block in reversed(range(len(kept))):
            total = back(lo + block * every, min(hi, lo + (block + 1) * every), kept.pop(), total)
        return total

    back(0, len(items), 1, None)
    return out


def _nearest(reach: int, goal: int) -> int:
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    up = goal + 1 + ((above & -above).bit_length() - 1) if above else None
    return below if up is None or goal - below <= up - goal else up


def split_quotas(histogram: dict[int, int], targets: list[tuple[str, float]], room: int = ROOM) -> dict[int, list[tuple[str, int]]]:
    """For each size, how many of its groups go to each split.

    The smallest targets choose first; the split with the largest target gets the rest. With any number of rows no other
    choice of a split, from the groups that are left to it, is nearer to its share.
    """
    total = sum(s * n for s, n in histogram.items())
    shares = sum(max(0.0, w or 0.0) for _, w in targets) or 1.0
    ordered = sorted(targets, key=lambda t: (max(0.0, t[1] or 0.0), t[0]))
    left = dict(histogram)
    out: dict[int, list[tuple[str, int]]] = {s: [] for s in histogram}
    for name, weight in ordered[:-1]:
        want = total * max(0.0, weight or 0.0) / shares
        for s, k in closest_subset({s: n for s, n in left.items() if n}, round(want), room).items():
            out[s].append((name, k))
            left[s] -= k
    for s, n in left.items():
        if n:
            out[s].append((ordered[-1][0], n))
    return out


def assign_splits(records: DataFrame, structs: DataFrame, targets: DataFrame) -> DataFrame:
    """(rid, group_key, split_name): all records of a molecule in one split, the shares as near to the targets as groups allow.

    A record without a key is a group of its own. Which groups of a size go where is decided by a hash of their name, so the
    result doesn't depend on partitions. Without any split the result is empty; without records too.
    """
    spark = records.sparkSession
    goals = [(r[0], r[1]) for r in few(targets.select("split_name", "target_share").where("split_name is not null"), MOST_SPLITS, "splits")]
    out, sizes = keyed_records(records, structs)
    out = cut(out.select("rid", "group_key"), "records")
    loose = out.where("group_key is null").select(F.concat(F.lit("\x1f"), F.col("rid").cast("string")).alias("g"), F.lit(1).cast("bigint").alias("n"))
    groups = cut(sizes.select(F.col("group_key").alias("g"), "n").union(loose.groupBy("g").agg(F.sum("n").alias("n"))), "groups")
    # one row a size: at most the square root of twice the records
    histogram = {r[0]: r[1] for r in groups.groupBy("n").agg(F.count("*").alias("c")).collect()}
    quotas = split_quotas(histogram, goals) if goals else {}
    bounds = [(size, name, start, start + k) for size, parts in quotas.items() for (name, k), start in zip(parts, [sum(x for _, x in parts[:i]) for i in range(len(parts))])]
    limits = F.broadcast(spark.createDataFrame(bounds, "n bigint, split_name string, lo bigint, hi bigint"))
    ranked = bucketed_prefix(groups, ["n"], ["g"], F.lit(1), "rank")
    placed = cut(ranked.join(limits, "n").where("rank >= lo and rank < hi").select("g", "split_name", "n"), "placed")
    keyed = out.where("group_key is not null")
    whole = salted_join(keyed, placed.select(F.col("g").alias("group_key"), "split_name"), "group_key", hot_keys(placed.select(F.col("g").alias("group_key"), "n"), "group_key"), "rid", "inner")
    alone = out.where("group_key is null").withColumn("g", F.concat(F.lit("\x1f"), F.col("rid").cast("string"))).join(placed.select("g", "split_name"), "g").select("rid", "group_key", "split_name")
    return whole.select("rid", "group_key", "split_name").union(alone)
