"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.keys import SPACE
from peakloom.operators.skew import bucketed_prefix
from peakloom.session import cut, few

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind split a text (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Expected copies are whole numbers of this fraction, so that running sums are exact.
UNIT = 1 << 30
#: Target sources at most; more are an error.
MOST_TARGETS = 100_000
_ENCODERS: dict = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_count(c: str, path: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of a whole text; null has none."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(path, pattern)
        return pd.Series([len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in texts], dtype="int64")

    return count(F.col(c))


def source_name(c: str) -> Column:
    """A source however it is spelled: lower case, single underscores, no blanks around."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(c), rf"^{SPACE}|{SPACE}$", "")), r"[\s\x{A0}_-]+", "_")


def allocate(weights: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens of each source: its share of the budget, at most its cap; what capped sources can't fill goes to the others by weight."""
    out, open_ = dict.fromkeys(weights, 0.0), {s for s in weights if weights[s] > 0 and caps[s] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if out[s] + left * weights[s] / total >= caps[s]}
        if not full:
            for s in open_:
                out[s] += left * weights[s] / total
            break
        for s in full:
            left -= caps[s] - out[s]
            out[s] = caps[s]
        # the others start over from what is left for them together
        open_ -= full
        left = budget - sum(out[s] for s in out if s not in open_)
        for s in open_:
            out[s] = 0.0
    return out


def _offset(seed: int, source: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}/{source}".encode(), digest_size=8).digest()) % UNIT


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, n_tokens, copies), and the shares reached.

    ``budget`` is the mix's size in tokens, by default that of all documents of the target sources. Each source gets its
    weight's share of it, at most max_repeats times its own tokens; the rest is shared out among the others. All documents of
    a source have the same expected number of copies. In the order of a hash these are summed up, one random offset of the
    source is added, and a document is used once for each whole number that its stretch of the sum crosses; so none is used
    more often than max_repeats. Documents without tokens, of no source or of a source without target aren't used. Null,
    NaN and negative weights count as 0, null max_repeats as 1; of repeated targets the first in order counts.
    """
    docs = cut(documents.select(F.col("doc_id"), source_name("source").alias("source"), token_count("text", tokenizer, pattern).alias("n_tokens")), "tokens")
    wanted: dict[str, tuple[float, int]] = {}
    for r in sorted(few(targets.select(source_name("source").alias("s"), "target_weight", "max_repeats").where("s is not null"), MOST_TARGETS, "target sources"), key=lambda r: (r[0], -(r[1] or 0))):
        w = r[1] if r[1] is not None and r[1] == r[1] and r[1] > 0 else 0.0
        wanted.setdefault(r[0], (float(w), max(0, 1 if r[2] is None else r[2])))
    spark = documents.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    # one row for each target
    sizes = {r[0]: r[1] for r in docs.join(names, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens")).collect()}
    size = {s: float(sizes.get(s) or 0) for s in wanted}
    total = sum(w for w, _ in wanted.values()) or 1.0
    goal = float(sum(size.values()) if budget is None else budget)
    tokens = allocate({s: w for s, (w, _) in wanted.items()}, {s: m * size[s] for s, (_, m) in wanted.items()}, goal)
    plan = [(s, w, w / total, m, int(size[s]), int(min(m * UNIT, round(tokens[s] / size[s] * UNIT))) if size[s] else 0, _offset(seed, s)) for s, (w, m) in wanted.items()]
    plan = spark.createDataFrame(plan, "source string, target_weight double, target_share double, max_repeats int, source_tokens bigint, step bigint, offset bigint")
    used = docs.where("n_tokens > 0").join(F.broadcast(plan.select("source", "step", "offset")), "source")
    summed = bucketed_prefix(used, ["source"], ["doc_id"], F.col("step"), "before", seed=str(seed))
    start = F.col("before") + F.col("offset")
    drawn = summed.withColumn("copies", (F.shiftright(start + F.col("step"), 30) - F.shiftright(start, 30)).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row for each target
    shares = plan.join(got, "source", "left").select(
        "source", "target_weight", "target_share", "max_repeats", "source_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
    )
    return drawn, shares
