"""Relational pieces of grid processing: point lookups, upserts, exact comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_point(surface: DataFrame, ground: DataFrame, level: DataFrame, evidence: DataFrame, row: int, col: int) -> DataFrame:
    """A pixel's value with its height above ground, confidence level and that level's
    measured error. The filter on (row, col) reaches the scans; nothing comes back for a
    pixel outside the image."""
    at = (F.col("row") == row) & (F.col("col") == col)
    one = surface.filter(at).select("row", "col", F.col("v").alias("value"))
    one = one.join(ground.filter(at), ["row", "col"], "left").join(level.filter(at), ["row", "col"], "left")
    return one.withColumn("height", F.col("value") - F.col("ground")).join(F.broadcast(evidence), "level", "left").select("row", "col", "value", "height", "level", "rmse")


def identical(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: cells, cells that differ or stand on one side alone, and whether none do."""
    names = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*names).alias("_a"))
    y = b.select(*keys, F.struct(*names).alias("_b"))
    both = x.join(y, keys, "full_outer")
    bad = F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.agg(F.count("*").alias("cells"), bad.alias("different"), (bad == 0).alias("identical"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without new's keys, then new: the last write of a key wins."""
    return old.join(new, key, "left_anti").unionByName(new)


def evenly_spaced(df: DataFrame, by: str, order: str, per_group: int) -> DataFrame:
    """per_group evenly spaced rows of each group, first and last included: positions
    i * (n - 1) / max(per_group - 1, 1), halves to the even one, each once."""
    w = Window.partitionBy(by)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    k = F.least(F.lit(per_group).cast("long"), F.col("_n"))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1))).cast("long"))
    return ranked.filter(F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def greedy_top(df: DataFrame, k: int, score: str, overlaps) -> DataFrame:
    """The k best rows that don't overlap a better one taken before; overlaps(a, b) tells
    of two rows' columns (prefixes a_ and b_) whether they do. k small rounds of top-1."""
    out, left = None, df
    for _ in range(k):
        best = left.orderBy(F.desc(score), *[c for c in df.columns if c != score]).limit(1)
        out = best if out is None else out.union(best)
        b = best.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))
        a = left.select(*(F.col(c).alias(f"a_{c}") for c in df.columns))
        left = a.join(F.broadcast(b), overlaps(), "left_anti").select(*(F.col(f"a_{c}").alias(c) for c in df.columns))
    return out


def hashed_sample(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """At most k rows, those of smallest hash (MD5 of the keys and the seed, joined by
    colons): the same rows wherever it runs. Of a much larger table only rows whose hash
    is small enough for about k of them are put in order."""
    mixed = F.md5(F.concat_ws(":", *keys, F.lit(seed)))
    n = df.count()
    if n > 2 * k:
        bound = f"{min(16**8 - 1, int(16**8 * (k + 6 * k**0.5) / n) + 1):08x}"
        some = df.filter(mixed < bound)
        df = some if some.count() >= k else df
    return df.orderBy(mixed, *keys).limit(k)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before its time, by key. One sort
    of both sides together; no pair of rows is ever formed."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*(F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", True).over(w)).filter("_side = 1").drop("_v", "_side")


def histogram_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0, the upper edge in the last bin; null outside."""
    b = F.floor((v - low) / ((high - low) / bins))
    return F.when((v >= low) & (v <= high), F.least(b, F.lit(bins - 1)))
