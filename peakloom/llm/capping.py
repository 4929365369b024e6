"""A limited number of records per contributor, the best by score; kept and dropped records both come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.keys import SPACE, record_key
from peakloom.operators.skew import tree_heaps
from peakloom.session import cut

CAP = 5


def contributor(c: str) -> Column:
    """A source name without surrounding blanks and in lower case."""
    return F.lower(F.regexp_replace(F.col(c), rf"^{SPACE}|{SPACE}$", ""))


def sound_score(c: str) -> Column:
    """The score, or null where it is null, NaN or outside 0 to 1."""
    s = F.col(c)
    return F.when(~F.isnan(s) & s.between(0.0, 1.0), s)


def best_of(records: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The records that have a lib, a key and a rid, as (rid, lib, group_key, score), and (rid, lib, group_key) of the best ``cap`` of each lib and key.

    The best are found from (score, rid) pairs alone: heaps bounded at ``cap`` are kept by each map task and merged in a tree.
    """
    rows = records.select(F.col("rid"), contributor("ingest_lib").alias("lib"), record_key().alias("group_key"), sound_score("quality_score").alias("score")).where("rid is not null and lib is not null and group_key is not null")
    order = F.struct(F.col("score").isNull().alias("last"), (-F.col("score")).alias("worse"), F.col("rid").alias("rid"))
    return rows, tree_heaps(rows, ["lib", "group_key"], order, cap).select("value.rid", "lib", "group_key")


def cap_records(records: DataFrame, cap: int = CAP) -> DataFrame:
    """(rid, lib, group_key, score, kept): each record of train_spectra that has a rid, a lib and a key.

    Best first: sound scores from high to low, then the rest alike, then the smaller rid. Records without a rid, key or lib
    stay out. Columns beside the needed ones don't matter. A rid that stands several times in a group takes several places of
    the cap, and all its rows there are kept if one is.
    """
    rows, best = best_of(records, cap)
    on = ["rid", "lib", "group_key"]
    kept = cut(best.distinct(), "kept")
    return rows.join(kept, on, "left_semi").withColumn("kept", F.lit(True)).union(rows.join(kept, on, "left_anti").withColumn("kept", F.lit(False)))


def dropped(records: DataFrame, cap: int = CAP) -> DataFrame:
    """(rid) of the records beyond the cap."""
    rows, best = best_of(records, cap)
    return rows.join(best, ["rid", "lib", "group_key"], "left_anti").select("rid")
