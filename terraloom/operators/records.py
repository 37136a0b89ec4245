"""Operators over the tables around a raster: requests and their cache keys, datasets,
evaluation sets, masks as pixel sets, jobs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ requests and datasets
def request_key(*numbers: Column, digits: int = 6, length: int = 16) -> Column:
    """A short key of a request's numbers: equal after rounding, equal key."""
    text = F.format_string(",".join([f"%.{digits}f"] * len(numbers)), *numbers)
    return F.substring(F.sha1(text), 1, length)


def content_hash(content: Column) -> Column:
    """Lowercase hex SHA-256 of a text or binary column; null stays null."""
    return F.sha2(content, 256)


def tile_name(url: Column) -> tuple[Column, Column]:
    """(stem, tile) of a path: what stands before its last separator, and its last part."""
    return F.regexp_replace(url, "[_/][^_/]*$", ""), F.regexp_extract(url, "([^/]*)$", 1)


def corner_crops(df: DataFrame, size: int, crop: int) -> DataFrame:
    """Each row four times, with k, c0, r0: the crops in the corners of its square image."""
    if not 0 < crop <= size:
        raise ValueError(f"a crop of {crop} pixels does not fit into {size}")
    k, last = F.col("k"), size - crop
    x = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return x.withColumn("c0", F.when(k % 2 == 0, 0).otherwise(last)).withColumn("r0", F.when(k < 2, 0).otherwise(last))


def parsed(df: DataFrame, text: str, schema: str, into: str = "config") -> DataFrame:
    """df with a JSON column read by a schema; text that is no JSON object gives null."""
    return df.withColumn(into, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def wavy(spark: SparkSession, height: int, width: int) -> DataFrame:
    """A synthetic surface (row, col, v): a smooth wave for tests without any file."""
    at = spark.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    return at.withColumn("v", F.sin(F.col("row") / 9) + F.cos(F.col("col") / 7))


# ------------------------------------------------------------------ joins of an evaluation
def evaluation_set(estimates: DataFrame, truth: DataFrame, left: str, right: str, held: Column) -> DataFrame:
    """Estimates with their truth, and `held`: whether a truth row was kept out of the fit."""
    return estimates.join(truth.withColumn("held", held), F.col(left) == F.col(right))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row, `shared`: rows of a whose keys b has too. Fit and held-out sets share none."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("shared"))


def refuse_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Refuse sets that share keys."""
    if n := shared_keys(a, b, keys).first()["shared"]:
        raise ValueError(f"{n} rows are in both sets")


def lookup(df: DataFrame, by: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A row per `by` with a column per name: the sums of its values."""
    return df.groupBy(by).pivot(name, names).agg(F.sum(value))


def with_evidence(df: DataFrame, evidence: DataFrame, level: str) -> DataFrame:
    """df with the measured error of each row's level; null where none was measured."""
    return df.join(evidence, level, "left")


def incomplete(wanted: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys of `wanted` that are missing from at least one of the parts."""
    have = reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), parts, wanted.select(key))
    return wanted.select(key).join(have, key, "left_anti")


def optional_layer(grid: DataFrame, layer: DataFrame | None, name: str, kind: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """grid with a layer's value (keys, v) as `name`, and a note. Without the layer, or
    where it has no pixel, the value is null and the note says so."""
    missing = F.lit(f"no {name}")
    if layer is None:
        return grid.withColumn(name, F.lit(None).cast(kind)).withColumn("note", missing)
    found = grid.join(layer.select(*keys, F.col("v").cast(kind).alias(name)), list(keys), "left")
    return found.withColumn("note", F.when(F.col(name).isNull(), missing))


def factor_grid(*factors: DataFrame) -> DataFrame:
    """Every combination of some short lists of factors."""
    return reduce(DataFrame.crossJoin, (f.distinct() for f in factors))


def with_results(factors: DataFrame, results: DataFrame, keys: list[str], measured: str) -> DataFrame:
    """All combinations with their results; those without one are kept, not evaluated."""
    return factors.join(results, keys, "left").withColumn("evaluated", F.col(measured).isNotNull())


# ------------------------------------------------------------------ buildings and datasets
def centroid_fit(footprints: DataFrame, height: int, width: int) -> DataFrame:
    """(id, fit) of buildings by the checkerboard block that their centroid falls into."""
    c = footprints.groupBy("id").agg(F.avg("row").cast("long").alias("r"), F.avg("col").cast("long").alias("c"))
    block = F.floor(F.col("r") / height) + F.floor(F.col("c") / width)
    return c.select("id", (F.pmod(block, F.lit(2)) == 0).alias("fit"))


def majority(footprints: DataFrame, grid: DataFrame, condition: Column, into: str) -> DataFrame:
    """(id, into): whether a condition holds on more than half of a building's pixels."""
    share = F.avg(condition.cast("int"))
    return footprints.join(grid, ["row", "col"]).groupBy("id").agg((share > 0.5).alias(into))


def ratio_fit(df: DataFrame, by: str, estimate: str, truth: str, least: int = 5) -> DataFrame:
    """(by, k, iqr): median and interquartile range of truth / estimate, of groups with
    `least` rows or more."""
    x = F.col(truth) / F.col(estimate)
    spread = F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    return df.groupBy(by).agg(F.median(x).alias("k"), spread.alias("iqr"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")


def audit(df: DataFrame, label: str, v: str) -> DataFrame:
    """Per label: n, its share of all rows, 5 % quantile, median, 95 % quantile, and the
    share of negative values."""
    q = lambda p: F.percentile(v, F.lit(p))
    found = df.groupBy(label).agg(
        F.count("*").alias("n"),
        q(0.05).alias("p5"),
        F.median(v).alias("med"),
        q(0.95).alias("p95"),
        F.avg((F.col(v) < 0).cast("int")).alias("negative"),
    )
    every = found.agg(F.sum("n").alias("_all"))
    return found.crossJoin(every).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def correlation_summary(sites: DataFrame, by: str, r: str, error: str, n: str, least: int) -> DataFrame:
    """Per group of sites: median correlation, how many are negative, and the median error
    of sites with more than `least` rows."""
    big = F.when(F.col(n) > least, F.col(error))
    return sites.groupBy(by).agg(F.median(r).alias("median_r"), F.count_if(F.col(r) < 0).alias("negative"), F.median(big).alias("median_error"))


def scale_shift_invariant_loss(df: DataFrame, by: str, pred: str, truth: str, least: int = 16, floor: float = 1e-6) -> DataFrame:
    """(by, loss): mean absolute difference of prediction and truth after each is shifted
    by its lower median and scaled by its mean absolute deviation, per image (a `by`) of
    `least` valid pixels or more."""
    ok = df.select(by, F.col(pred).alias("x"), F.col(truth).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    middle = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    centre = ok.groupBy(by).agg(middle("x").alias("mx"), middle("y").alias("my"), F.count("*").alias("n")).filter(F.col("n") >= least)
    off = ok.join(centre, by).select(by, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    width = lambda c: F.greatest(F.avg(F.abs(c)), F.lit(floor))
    scale = off.groupBy(by).agg(width("x").alias("sx"), width("y").alias("sy"))
    gap = F.abs(F.col("x") / F.col("sx") - F.col("y") / F.col("sy"))
    return off.join(scale, by).groupBy(by).agg(F.avg(gap).alias("loss"))


def compare_variants(df: DataFrame, truth: str, variants: list[str], hybrid: str = "hybrid") -> DataFrame:
    """(variant, n, total, rmse_all, rmse_common) of some prediction columns and of the
    hybrid that takes the first one with a value; rmse_common is over the rows on which
    all variants have one."""
    common = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in variants))
    pair = lambda name, x: F.struct(F.lit(name).alias("variant"), x.alias("x"))
    listed = F.array(*(pair(v, F.col(v)) for v in variants), pair(hybrid, F.coalesce(*variants)))
    long = df.select(F.col(truth).alias("t"), common.alias("common"), F.explode(listed).alias("p")).select("t", "common", "p.*")
    square = (F.col("x") - F.col("t")) ** 2
    return long.groupBy("variant").agg(
        F.count("x").alias("n"),
        F.count("*").alias("total"),
        F.sqrt(F.avg(square)).alias("rmse_all"),
        F.sqrt(F.avg(F.when(F.col("common"), square))).alias("rmse_common"),
    )


# ------------------------------------------------------------------ jobs and reports
def latency(df: DataFrame, by: str, v: str) -> DataFrame:
    """Mean, standard deviation, least and median time per group."""
    return df.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lowest"), F.median(v).alias("med"))


def queue_counters(df: DataFrame, by: str, status: str, names: dict[str, str]) -> DataFrame:
    """Per group, how many jobs have each status (column name -> status)."""
    return df.groupBy(by).agg(*(F.count_if(F.col(status) == s).alias(n) for n, s in names.items()))


def first_status(conditions: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first status whose condition holds."""
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(conditions), F.lit(otherwise))


def issues(conditions: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """(issues, ready): the texts of all conditions that hold, and whether none does."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in conditions)))
    return F.array_join(found, "; "), F.size(found) == 0


def newest_first(df: DataFrame, at: str, key: str, k: int) -> DataFrame:
    """The k newest rows; of equally old ones those of least key."""
    return df.orderBy(F.desc(at), key).limit(k)


def ranked_layers(df: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Rows of the listed stages with their place in the list, in that order, then by key."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(by)).cast("int") - 1
    return df.withColumn("r", rank).filter("r >= 0").orderBy("r", key)


def best_by(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    """Each group's row of least score (and key): (by, best, score)."""
    return df.groupBy(by).agg(F.min_by(key, F.struct(score, key)).alias("best"), F.min(score).alias(score))


def running_minimum(df: DataFrame, by: str, order: list[str], v: str, into: str = "best") -> DataFrame:
    """df with the least value so far of each group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.min(v).over(w))


# ------------------------------------------------------------------ pixel sets
def union_of(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Pixels set in either mask, once."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def common_to(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Pixels set in both masks, once."""
    return a.select(*keys).intersect(b.select(*keys))


def without(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Pixels set in a and not in b, once."""
    return a.select(*keys).subtract(b.select(*keys))


def in_order_once(df: DataFrame, by: str, item: str, order: str) -> DataFrame:
    """(by, items): each group's distinct items by their first place, as an array."""
    first = df.groupBy(by, item).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", item)))
    return first.groupBy(by).agg(F.transform(listed, lambda x: x[item]).alias("items"))
