"""Formulas, adducts, masses, and molecular graphs from structure text."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masses of the most common isotopes (fixed values).
MASS = {
    "H": 1.00782503223, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Na": 22.989769282, "Si": 27.97692653465,
    "P": 30.97376199842, "S": 31.9720711744, "Cl": 34.968852682, "K": 38.9637064864, "Se": 79.9165218, "Br": 78.9183376, "I": 126.9044719,
}
ELECTRON = 0.000548579909
#: Usual valences, lowest first (fixed values).
VALENCE = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,), "Se": (2, 4, 6), "Si": (4,)}


def formula_mass(c: str) -> Column:
    """Mass of a formula such as C10H12N2O, as an expression; null where it holds anything but known elements and counts."""
    f = F.regexp_replace(F.col(c), r"[+-]", "")
    table = F.create_map(*[x for e, m in MASS.items() for x in (F.lit(e), F.lit(m))])
    elements = F.regexp_extract_all(f, F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(1))
    counts = F.regexp_extract_all(f, F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(2))
    pairs = F.arrays_zip(elements.alias("e"), counts.alias("n"))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.try_element_at(table, p["e"]) * F.when(p["n"] == "", F.lit(1)).otherwise(p["n"].cast("int")))
    return F.when(f.rlike(r"^(?:[A-Z][a-z]?\d*)+$"), total)


def element_count(c: str, element: str) -> Column:
    """How many atoms of one element a formula has."""
    n = F.regexp_extract_all(F.col(c), F.lit(rf"{element}(?![a-z])(\d*)"), F.lit(1))
    return F.aggregate(n, F.lit(0), lambda a, x: a + F.when(x == "", F.lit(1)).otherwise(x.cast("int")))


def parse_formula(text: str) -> dict[str, int] | None:
    if not text or not re.fullmatch(r"(?:[A-Z][a-z]?\d*)+", text):
        return None
    out: dict[str, int] = {}
    for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", text):
        if e not in MASS:
            return None
        out[e] = out.get(e, 0) + int(n or 1)
    return out


class Adduct(NamedTuple):
    """m/z * charge = molecules * M + added, in the mode of ``polarity``."""

    molecules: int
    charge: int
    added: float
    polarity: int


def parse_adduct(text: str | None) -> Adduct | None:
    """Reads a name by its grammar: ``[`` number? ``M`` (sign number? (symbol number?)+)* ``]`` number? sign. None for other text.

    Anions named by structure, as HCOO, need no table: the masses of their atoms are added up one by one.
    """
    bare = (text or "").strip()
    tokens = re.findall(r"\d+|[A-Z][a-z]?|.", bare)[::-1]

    def take(fits: Callable[[str], bool], default=None):
        return tokens.pop() if tokens and fits(tokens[-1]) else default

    number = lambda: int(take(str.isdecimal, 1))
    sign = lambda: {"+": 1, "-": -1}.get(take(lambda x: x in "+-"))
    if not take("[".__eq__):
        return None
    molecules = number()
    if not take("M".__eq__):
        return None
    added = 0.0
    while way := sign():
        times, group = number(), 0.0
        if not tokens or tokens[-1] not in MASS:
            return None
        while atom := take(MASS.__contains__):
            group += MASS[atom] * number()
        added += way * times * group
    closed, charge, polarity = take("]".__eq__), number(), sign()
    if not closed or not polarity or tokens:
        return None
    return Adduct(molecules, charge, added - polarity * charge * ELECTRON, polarity)


def adduct_table(df: DataFrame, c: str = "adduct") -> DataFrame:
    """(adduct, n, z, delta, polarity) of the different adducts of a column, nulls where they can't be read."""

    def run(batches):
        for pdf in batches:
            rows = [(a, *(parse_adduct(a) or (None,) * 4)) for a in pdf[c]]
            yield pd.DataFrame(rows, columns=["adduct", "n", "z", "delta", "polarity"]).astype({"n": "Int32", "z": "Int32", "delta": "Float64", "polarity": "Int32"})

    return df.select(c).where(F.col(c).isNotNull()).distinct().mapInPandas(run, "adduct string, n int, z int, delta double, polarity int")


def neutral_mass(df: DataFrame, mz: str = "precursor_mz", adduct: str = "adduct") -> DataFrame:
    """``df`` with ``neutral_mass`` = (m/z * z - delta) / n; null for unknown adducts and missing m/z."""
    a = adduct_table(df, adduct).withColumnRenamed("adduct", adduct)
    return df.join(a, adduct, "left").withColumn("neutral_mass", F.when(~F.isnan(mz), (F.col(mz) * F.col("z") - F.col("delta")) / F.col("n"))).drop("n", "z", "delta", "polarity")


# ---- graphs
_ATOM = re.compile(r"\[(?:\d*)([A-Za-z][a-z]?)(@*)(H\d*)?([+-]\d*|\++|-+)?(?::\d+)?\]|Cl|Br|[BCNOPSFI]|[bcnops]")


def parse_smiles(text: str | None) -> tuple[list[str], list[int], list[tuple[int, int, int]]] | None:
    """(elements, hydrogens, bonds as (i, j, order)) of a structure text; None if it can't be read.

    Aromatic bonds have order 1 and take one valence more on each ring atom. Stereo marks are skipped.
    """
    if not text:
        return None
    elements: list[str] = []
    fixed: list[int | None] = []
    aromatic: list[bool] = []
    charge: list[int] = []
    bonds: list[tuple[int, int, int]] = []
    stack: list[int] = []
    rings: dict[str, tuple[int, int]] = {}
    last, order, i = -1, 0, 0
    while i < len(text):
        ch = text[i]
        if ch == "(":
            stack.append(last)
        elif ch == ")":
            if not stack:
                return None
            last = stack.pop()
        elif ch in "-=#:/\\":
            order = {"=": 2, "#": 3}.get(ch, 1)
        elif ch == ".":
            last, order = -1, 0
        elif ch.isdigit() or ch == "%":
            name = text[i + 1 : i + 3] if ch == "%" else ch
            i += 2 if ch == "%" else 0
            if name in rings:
                j, o = rings.pop(name)
                bonds.append((j, last, max(order, o, 1)))
            else:
                rings[name] = (last, order)
            order = 0
        else:
            m = _ATOM.match(text, i)
            if not m:
                return None
            symbol = m.group(1) or m.group(0)
            elements.append(symbol[0].upper() + symbol[1:])
            aromatic.append(symbol[0].islower())
            bracket = m.group(0)[0] == "["
            h = m.group(3)
            fixed.append((int(h[1:] or 1) if h else 0) if bracket else None)
            sign = m.group(4) or ""
            charge.append((1 if "+" in sign else -1) * (int(sign[1:]) if sign[1:].isdigit() else len(sign)) if sign else 0)
            if elements[-1] not in MASS:
                return None
            if last >= 0:
                bonds.append((last, len(elements) - 1, max(order, 1)))
            last, order = len(elements) - 1, 0
            i += len(m.group(0)) - 1
        i += 1
    if stack or rings or not elements:
        return None
    used = [0] * len(elements)
    for a, b, o in bonds:
        used[a] += o
        used[b] += o
    hydrogens = []
    for k, e in enumerate(elements):
        if fixed[k] is not None:
            hydrogens.append(fixed[k])
        else:
            need = used[k] + (1 if aromatic[k] else 0)
            room = next((v for v in VALENCE.get(e, (0,)) if v >= need), need)
            hydrogens.append(max(0, room - need))
    return elements, hydrogens, bonds


def graph_mass(g) -> float:
    elements, hydrogens, _ = g
    return sum(MASS[e] for e in elements) + MASS["H"] * sum(hydrogens)


def fragment_masses(weights: list[float], bonds: list[tuple[int, int, int]], cuts: int = 2) -> np.ndarray:
    """Masses of the connected parts after cutting one or two bonds, rounded to 0.001, each once, in order.

    On a spanning tree each bond has the set of rings (other bonds) that pass it: one cut makes parts at a bond without
    rings, two cuts at two such bonds or at two with the same rings. Masses are sums and differences of branches.
    """
    if cuts not in (1, 2):
        raise ValueError("one or two cuts")
    n, ends = len(weights), [(a, b) for a, b, _ in bonds]
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(ends):
        around[a].append((b, k))
        around[b].append((a, k))
    up, root, order, tree = [-1] * n, [-1] * n, [], set()
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        order.append(start)
        at = len(order) - 1
        while at < len(order):
            v = order[at]
            for x, k in around[v]:
                if root[x] < 0:
                    root[x], up[x] = start, v
                    order.append(x)
                    tree.add(k)
            at += 1
    branch, size, rings = list(weights), [1] * n, [0] * n
    closing = [k for k in range(len(ends)) if k not in tree]
    for bit, k in enumerate(closing):
        for x in ends[k]:
            rings[x] ^= 1 << bit
    for v in reversed(order):
        if up[v] >= 0:
            branch[up[v]] += branch[v]
            size[up[v]] += size[v]
            rings[up[v]] ^= rings[v]
    # branches as ranges of a preorder
    first, free = [0] * n, [0] * n
    for v in order:
        if up[v] >= 0:
            first[v] = free[up[v]]
            free[up[v]] += size[v]
        free[v] = first[v] + 1
    groups: dict[tuple[int, int], list[int]] = {}
    for v in order:
        if up[v] >= 0:
            groups.setdefault((root[v], rings[v]), []).append(v)
    out = [np.array([sum(weights)])]
    roots = [v for v in order if up[v] < 0]
    if len(roots) > 1:
        # a separate part stays whole when the cut is elsewhere or only opens a ring
        inside = {r: 0 for r in roots}
        for a, _ in ends:
            inside[root[a]] += 1
        ringed = {root[ends[k][0]] for k in closing}
        out.append(np.array([branch[r] for r in roots if len(ends) > inside[r] or r in ringed]))
    for (r, ring), vs in groups.items():
        whole, b = branch[r], np.array([branch[v] for v in vs])
        if not ring or cuts == 2 and ring.bit_count() == 1:
            out += [b, whole - b]
        if cuts == 2 and len(vs) > 1:
            f, z = np.array([first[v] for v in vs]), np.array([size[v] for v in vs])
            i, j = np.triu_indices(len(vs), 1)
            i, j = np.where(z[i] >= z[j], i, j), np.where(z[i] >= z[j], j, i)
            within = (f[j] >= f[i]) & (f[j] < f[i] + z[i])
            between = np.where(within, b[i] - b[j], whole - b[i] - b[j])
            out += [between, whole - between] if ring else [between]
    return np.unique(np.round(np.concatenate(out), 3))


#: What may carry a fragment's charge besides a proton where the adduct names it, by polarity: text of the name, formula (fixed values).
CARRIERS = {1: {"Na": "Na", "K": "K", "NH4": "NH4"}, -1: {"Cl": "Cl", "CH2O2": "CHO2", "HCOO": "CHO2"}}


def charge_carriers(adduct: str | None) -> list[float]:
    """What a neutral fragment's mass gains as an ion, for each carrier that an adduct allows; the proton comes first."""
    name = adduct or ""
    read = parse_adduct(name)
    way = read.polarity if read else -1 if name.endswith("-") else 1
    formulas = {f: parse_formula(f) for text, f in CARRIERS[way].items() if text in name}
    return [way * (MASS["H"] - ELECTRON), *[sum(MASS[e] * k for e, k in f.items()) - way * ELECTRON for f in formulas.values()]]


def explained(masses: np.ndarray, mz: np.ndarray, ion: float, shifts: int = 1, da: float = 0.01, ppm: float = 0.0) -> np.ndarray:
    """Which peaks are some fragment mass + ion offset + s hydrogens, s from -shifts to shifts, within tolerance."""
    ok = np.zeros(len(mz), bool)
    if not len(masses):
        return ok
    tol = np.maximum(da, mz * ppm * 1e-6)
    for s in range(-shifts, shifts + 1):
        x = mz - ion - s * MASS["H"]
        at = np.clip(np.searchsorted(masses, x), 1, max(1, len(masses) - 1)) if len(masses) > 1 else np.zeros(len(mz), int)
        near = np.minimum(np.abs(masses[at] - x), np.abs(masses[np.maximum(at - 1, 0)] - x))
        ok |= near <= tol
    return ok


def subformulas(formula: dict[str, int], mass: float, tol: float, most: int = 2_000_000) -> list[dict[str, int]]:
    """Sub-formulas whose mass is within ``tol`` of ``mass``, with no more hydrogens than valences allow."""
    heavy = [e for e in formula if e != "H"]
    size = 1
    for e in heavy:
        size *= formula[e] + 1
    if size > most:
        raise ValueError("too many sub-formulas")
    out: list[dict[str, int]] = []

    def walk(k: int, rest: float, at: dict[str, int]):
        if k == len(heavy):
            h = round(rest / MASS["H"])
            room = 2 * at.get("C", 0) + at.get("N", 0) + 3
            if 0 <= h <= min(formula.get("H", 0), room) and abs(rest - h * MASS["H"]) <= tol:
                out.append({**{e: n for e, n in at.items() if n}, **({"H": h} if h else {})})
            return
        e = heavy[k]
        for n in range(formula[e] + 1):
            if n * MASS[e] > rest + tol:
                break
            walk(k + 1, rest - n * MASS[e], {**at, e: n})

    walk(0, mass, {})
    return out


def subformula_search(formula: dict[str, int], block: int = 2_000_000):
    """A function of masses and a tolerance: which of them some sub-formula has, as ``subformulas`` has it, but the empty one.

    Masses of carbon, nitrogen and hydrogen are sorted, those of the rest are taken off each mass. Formulas of any size are
    tested in blocks; one that fits in a block is enumerated once.
    """
    c, n, h = (formula.get(e, 0) for e in "CNH")
    rest = [e for e in formula if e not in ("C", "N", "H")]
    shape = [formula[e] + 1 for e in rest]
    total, step = math.prod(shape), max(1, block // (h + 1))

    def cores():
        for lo in range(0, (c + 1) * (n + 1), step):
            k = np.arange(lo, min(lo + step, (c + 1) * (n + 1)))[:, None]
            i, j, x = k // (n + 1), k % (n + 1), np.arange(h + 1)
            yield np.sort((i * MASS["C"] + j * MASS["N"] + x * MASS["H"])[x <= 2 * i + j + 3])

    def others(most):
        for lo in range(0, total, most):
            k, m = np.arange(lo, min(lo + most, total)), 0.0
            for e, size in zip(rest, shape):
                m, k = m + k % size * MASS[e], k // size
            yield m + np.zeros(len(k))

    small = (c + 1) * (n + 1) <= step and total <= block // 100
    kept = ([*cores()], [*others(block)]) if small else None

    def run(masses: np.ndarray, tol: float) -> np.ndarray:
        ok = np.zeros(len(masses), bool)
        for core in kept[0] if kept else cores():
            for other in kept[1] if kept else others(max(1, block // max(1, len(masses)))):
                low = masses[:, None] - other - tol
                at = np.searchsorted(core, low)
                ok |= ((at < len(core)) & (core[np.minimum(at, len(core) - 1)] <= low + 2 * tol)).any(1)
        return ok & (masses > tol)

    return run


def degree_signature(g) -> list[str]:
    """Elements with their degree, sorted: the same for all ways of drawing double bonds."""
    elements, _, bonds = g
    deg = [0] * len(elements)
    for a, b, _ in bonds:
        deg[a] += 1
        deg[b] += 1
    return sorted(f"{e}{d}" for e, d in zip(elements, deg))


# ---- identity of graphs
def _around(n: int, bonds: list[tuple[int, int, int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, _ in bonds:
        out[a].append(b)
        out[b].append(a)
    return out


def _reached(around: list[list[int]], start: int, without: tuple[int, int]) -> dict[int, int]:
    """Bonds from ``start`` to every atom that can be reached, one bond being gone."""
    far, queue = {start: 0}, [start]
    for v in queue:
        for x in around[v]:
            if x not in far and {v, x} != set(without):
                far[x] = far[v] + 1
                queue.append(x)
    return far


def smallest_rings(n: int, bonds: list[tuple[int, int, int]]) -> tuple[list[int], list[bool]]:
    """(size of the smallest ring of each atom, 0 for none; whether each bond lies in a ring)."""
    around, size, ringed = _around(n, bonds), [0] * n, []
    for a, b, _ in bonds:
        far = _reached(around, a, (a, b)).get(b)
        ringed.append(far is not None)
        for x in (a, b) if far is not None else ():
            size[x] = min(size[x] or far + 1, far + 1)
    return size, ringed


def graph_key(elements: list[str], hydrogens: list[int], bonds: list[tuple[int, int, int]], rings: list[int], mark: int = -1) -> str:
    """Fourteen letters: the same for all ways of writing a graph, of numbering its atoms and of drawing its double bonds.

    Atoms are ranked by element, hydrogens, neighbours and smallest ring, then again and again by the ranks around them, until
    no more can be told apart; the key is a hash of all atoms with their neighbours' ranks. ``mark`` is an atom that differs
    from all others, as the one where a fragment was cut off.
    """
    around = _around(len(elements), bonds)
    kinds = [(e, h, len(around[k]), rings[k], k == mark) for k, (e, h) in enumerate(zip(elements, hydrogens))]

    def ranks(values: list) -> list[int]:
        place = {v: i for i, v in enumerate(sorted(set(values)))}
        return [place[v] for v in values]

    rank = ranks(kinds)
    while True:
        new = ranks([(r, tuple(sorted(rank[x] for x in around[k]))) for k, r in enumerate(rank)])
        if max(new) == max(rank):
            break
        rank = new
    text = repr(sorted((kinds[k], rank[k], sorted(rank[x] for x in around[k])) for k in range(len(elements))))
    number = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=16).digest())
    out = ""
    for _ in range(14):
        number, letter = divmod(number, 26)
        out += chr(65 + letter)
    return out


def part_of(g, atoms: list[int]) -> tuple[list[str], list[int], list[tuple[int, int, int]]]:
    """The atoms of a graph, numbered anew, and the bonds between them."""
    place = {x: i for i, x in enumerate(atoms)}
    return [g[0][x] for x in atoms], [g[1][x] for x in atoms], [(place[a], place[b], o) for a, b, o in g[2] if a in place and b in place]


def structure_keys(g) -> tuple[str, str, int]:
    """(key of the whole, key of the largest part, number of parts); of parts of the same number of heavy atoms the heavier, then the smaller key."""
    around, parts, seen = _around(len(g[0]), g[2]), [], set()
    for k in range(len(g[0])):
        if k not in seen:
            parts.append(sorted(_reached(around, k, (-1, -1))))
            seen.update(parts[-1])
    keyed = []
    for atoms in parts:
        p = part_of(g, atoms)
        keyed.append((-sum(e != "H" for e in p[0]), -round(graph_mass(p), 4), graph_key(*p, smallest_rings(len(p[0]), p[2])[0])))
    whole = keyed[0][2] if len(keyed) == 1 else hashlib.blake2b(" ".join(sorted(k for _, _, k in keyed)).encode(), digest_size=8).hexdigest()[:14].translate(str.maketrans("0123456789abcdef", "ABCDEFGHIJKLMNOP"))
    return whole, min(keyed)[2], len(parts)


def single_cuts(g, most: int = 13) -> list[tuple[str, str, str, float]]:
    """(constant, variable, environment, mass of the variable part) of each cut of one single bond outside rings.

    The variable part has at most ``most`` heavy atoms and no more than the constant one; both are keys with the cut atom marked.
    The environment is the constant part's atom at the cut, with its number of neighbours.
    """
    n = len(g[0])
    around = _around(n, g[2])
    rings, ringed = smallest_rings(n, g[2])
    out = []
    for (a, b, order), ring in zip(g[2], ringed):
        if ring or order != 1:
            continue
        side = set(_reached(around, a, (a, b)))
        whole = set(_reached(around, a, (-1, -1)))
        for var, at, keep in ((side, a, b), (whole - side, b, a)):
            rest = whole - var
            heavy = [sum(g[0][x] != "H" for x in part) for part in (var, rest)]
            if not 0 < heavy[0] <= min(most, heavy[1]):
                continue
            keys = []
            for part, mark in ((rest, keep), (var, at)):
                atoms = sorted(part)
                keys.append(graph_key(*part_of(g, atoms), [rings[x] for x in atoms], atoms.index(mark)))
            mass = sum(MASS[g[0][x]] + MASS["H"] * g[1][x] for x in var)
            out.append((*keys, f"{g[0][keep]}{len(around[keep])}", mass))
    return out


def cut_table(df: DataFrame, ident: str, smiles: str, most: int = 13) -> DataFrame:
    """(id, const, var, env, mass): the single cuts of each structure text that can be read, each once."""

    def run(batches):
        for pdf in batches:
            rows = [(i, *c) for i, s in zip(pdf["id"], pdf["smiles"]) if (g := parse_smiles(s)) for c in sorted({(x[0], x[1], x[2], round(x[3], 5)) for x in single_cuts(g, most)})]
            yield pd.DataFrame(rows, columns=["id", "const", "var", "env", "mass"])

    rows = df.select(F.col(ident).alias("id"), F.col(smiles).alias("smiles")).where("id is not null and smiles is not null")
    # milliseconds a row: as many tasks as there are places for, however few files there are
    spark = df.sparkSession
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, const string, var string, env string, mass double")


def key_table(df: DataFrame, ident: str, smiles: str) -> DataFrame:
    """(id, key, parent, parts) of each structure text; nulls where it can't be read."""

    def run(batches):
        for pdf in batches:
            rows = [(i, *(structure_keys(g) if (g := parse_smiles(s)) else (None, None, None))) for i, s in zip(pdf["id"], pdf["smiles"])]
            yield pd.DataFrame(rows, columns=["id", "key", "parent", "parts"]).astype({"parts": "Int32"})

    rows = df.select(F.col(ident).alias("id"), F.col(smiles).alias("smiles")).where("id is not null")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, key string, parent string, parts int")


def structure_facts(df: DataFrame, ident: str, smiles: str) -> DataFrame:
    """(id, n_heavy, graph_mass, n_fragments, signature) of each structure text; nulls where it can't be read."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, s in zip(pdf["id"], pdf["smiles"]):
                g = parse_smiles(s)
                if g is None:
                    rows.append((i, None, None, None, None))
                    continue
                w = [MASS[e] + h * MASS["H"] for e, h in zip(g[0], g[1])]
                rows.append((i, len(g[0]), round(graph_mass(g), 6), len(fragment_masses(w, g[2])), degree_signature(g)))
            yield pd.DataFrame(rows, columns=["id", "n_heavy", "graph_mass", "n_fragments", "signature"]).astype({"n_heavy": "Int32", "graph_mass": "Float64", "n_fragments": "Int32"})

    rows = df.select(F.col(ident).alias("id"), F.col(smiles).alias("smiles"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, n_heavy int, graph_mass double, n_fragments int, signature array<string>")
