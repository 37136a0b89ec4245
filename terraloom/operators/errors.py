"""Error metrics of a prediction against a reference. Nodata is NULL: it is left out of
every statistic and counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terraloom.operators import graph

#: Scale that makes a median absolute deviation a standard deviation under normality.
MAD_SCALE = 1.4826


def quantile(c: Column, q: float, exact: bool = True) -> Column:
    """Linear-interpolated quantile. exact=False takes Spark's bounded-size sketch, which
    is what to use where a group holds more values than an executor's memory."""
    return F.percentile(c, F.lit(q)) if exact else F.percentile_approx(c, F.lit(q), F.lit(10_000)).cast("double")


def null_safe_join(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a with b's columns, keys equal or both null; a cross join with one row without keys."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    renamed = b.select(*(F.col(k).alias(f"_{k}") for k in by), *(c for c in b.columns if c not in by))
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(renamed[f"_{k}"]) for k in by))
    return a.join(renamed, on, how).drop(*(f"_{k}" for k in by))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where a side is constant (never a division by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_metrics(df: DataFrame, pred: str, ref: str, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per group: n, excluded_nodata, bias, mae, rmse, median_error, nmad,
    p95_abs_error, le90, pearson_r, r2.

    r2 is that of pred as a predictor of ref (it can be negative), not a squared
    correlation. Statistics of groups without valid pairs are null; r and r2 also where
    a side is constant."""
    by = by or []
    both = F.col(pred).isNotNull() & F.col(ref).isNotNull()
    d = df.select(*by, F.when(both, F.col(pred)).alias("_p"), F.when(both, F.col(ref)).alias("_r")).withColumn("_d", F.col("_p") - F.col("_r"))
    n = F.count("_d")
    spread = F.var_pop("_r") * n
    first = d.groupBy(*by).agg(
        n.alias("n"),
        (F.count("*") - n).alias("excluded_nodata"),
        F.avg("_d").alias("bias"),
        F.avg(F.abs("_d")).alias("mae"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        quantile(F.col("_d"), 0.5, exact).alias("median_error"),
        quantile(F.abs("_d"), 0.95, exact).alias("p95_abs_error"),
        quantile(F.abs("_d"), 0.9, exact).alias("le90"),
        F.when(n > 1, correlation("_p", "_r")).alias("pearson_r"),
        F.when(n > 1, 1 - F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.when(spread > 0, spread))).alias("r2"),
    )
    second = null_safe_join(d, first.select(*by, "median_error"), by).groupBy(*by).agg((quantile(F.abs(F.col("_d") - F.col("median_error")), 0.5, exact) * MAD_SCALE).alias("nmad"))
    out = null_safe_join(first, second, by) if by else first.crossJoin(second)
    return out.select(*by, "n", "excluded_nodata", "bias", "mae", "rmse", "median_error", "nmad", "p95_abs_error", "le90", "pearson_r", "r2")


#: Distinct values that a quantile's bracket may hold when it comes to the driver.
BRACKET = 100_000


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Linear-interpolated quantiles (name -> column, share) over all rows, nulls left out.

    For tables of any size: a sketch brackets each quantile, rows beside the brackets are
    only counted, and brackets are narrowed until few distinct values are inside. The
    result doesn't depend on the sketch."""
    names = list(wanted)
    x = df.select(*(wanted[k][0].cast("double").alias(f"q{i}") for i, k in enumerate(names)))
    n = x.agg(*(F.count(c).alias(c) for c in x.columns)).first()
    left = {i for i in range(len(names)) if n[f"q{i}"]}
    out: dict[str, float | None] = dict.fromkeys(names)
    inside = {i: F.col(f"q{i}").isNotNull() for i in left}
    below = dict.fromkeys(left, 0)
    held, margin = {i: n[f"q{i}"] for i in left}, dict.fromkeys(left, 1e-3)
    while left:
        # places of the two order statistics within what is inside now
        rank = {i: wanted[names[i]][1] * (n[f"q{i}"] - 1) for i in left}
        share = {i: [max(0.0, (int(rank[i]) - below[i]) / held[i] - margin[i]), min(1.0, (int(rank[i]) + 1 - below[i]) / held[i] + margin[i])] for i in left}
        got = x.agg(*(F.percentile_approx(F.when(inside[i], F.col(f"q{i}")), F.array(*map(F.lit, share[i])), F.lit(10_000)).alias(f"b{i}") for i in left)).first()
        for i in left:
            c, (low, high) = F.col(f"q{i}"), got[f"b{i}"]
            inside[i] = inside[i] & c.between(low, high)
        tests = [F.count_if(F.col(f"q{i}") < got[f"b{i}"][0]).alias(f"l{i}") for i in left] + [F.count_if(inside[i]).alias(f"c{i}") for i in left] + [F.approx_count_distinct(F.when(inside[i], F.col(f"q{i}"))).alias(f"d{i}") for i in left]
        counts = x.agg(*tests).first()
        for i in sorted(left):
            lower, many = counts[f"l{i}"], counts[f"c{i}"]
            if lower > int(rank[i]) or lower + many <= min(int(rank[i]) + 1, n[f"q{i}"] - 1):
                # beside the bracket: the whole again, with a wider one
                inside[i], below[i], held[i], margin[i] = F.col(f"q{i}").isNotNull(), 0, n[f"q{i}"], 4 * margin[i]
                continue
            below[i], held[i] = lower, many
            if counts[f"d{i}"] <= BRACKET:
                values = sorted(tuple(r) for r in x.filter(inside[i]).groupBy(f"q{i}").count().collect())
                at, ends = lower, []
                for v, k in values:
                    at += k
                    ends.append((at, v))
                pick = lambda r: next(v for e, v in ends if r < e)  # noqa: B023, E731
                a, b = pick(int(rank[i])), pick(min(int(rank[i]) + 1, n[f"q{i}"] - 1))
                out[names[i]] = a + (rank[i] - int(rank[i])) * (b - a)
                left.discard(i)
    return out


def scene_metrics(df: DataFrame, pred: str, ref: str) -> dict[str, float | None]:
    """error_metrics() of a whole table as one report, with exact quantiles in bounded
    memory however many pixels there are."""
    both = F.col(pred).isNotNull() & F.col(ref).isNotNull()
    d = df.select(F.when(both, F.col(pred)).alias("p"), F.when(both, F.col(ref)).alias("r")).withColumn("d", F.col("p") - F.col("r"))
    n, square = F.count("d"), F.sum(F.col("d") * F.col("d"))
    spread = F.var_pop("r") * n
    out = d.agg(
        n.alias("n"),
        (F.count("*") - n).alias("excluded_nodata"),
        F.avg("d").alias("bias"),
        F.avg(F.abs("d")).alias("mae"),
        F.sqrt(square / F.when(n > 0, n)).alias("rmse"),
        F.when(n > 1, correlation("p", "r")).alias("pearson_r"),
        F.when(n > 1, 1 - F.try_divide(square, F.when(spread > 0, spread))).alias("r2"),
    ).first().asDict()
    out |= exact_quantiles(d, {"median_error": (F.col("d"), 0.5), "p95_abs_error": (F.abs("d"), 0.95), "le90": (F.abs("d"), 0.9)})
    middle = out["median_error"]
    off = None if middle is None else exact_quantiles(d, {"m": (F.abs(F.col("d") - middle), 0.5)})["m"]
    return out | {"nmad": None if off is None else off * MAD_SCALE}


#: Groups of as many values go without a sketch.
SMALL_GROUP = 10_000


def group_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Linear-interpolated quantiles (name -> column, share) per group, nulls left out: by
    and a column a name, null where a group has no value.

    exact_quantiles() by group, for groups that are few and larger than memory: a sketch
    brackets each quantile, rows below are counted, and only distinct values inside are put
    in order. The result doesn't depend on the sketch. A row a group comes to the driver."""
    names = list(wanted)
    every = range(len(names))
    x = df.select(*by, *(wanted[k][0].cast("double").alias(f"_q{i}") for i, k in enumerate(names)))
    keys, margin = [x.schema[k] for k in by], 1e-3
    while True:
        ends = [F.array(*(F.lit(min(1.0, max(0.0, wanted[k][1] + m))) for m in (-margin, margin))) for k in names]
        got = x.groupBy(*by).agg(*(F.count(f"_q{i}").alias(f"_n{i}") for i in every), *(F.percentile_approx(f"_q{i}", ends[i], F.lit(10_000)).alias(f"_b{i}") for i in every))
        # small groups, and all where no bracket is narrower, are taken whole
        bounded = lambda i: F.when((F.col(f"_n{i}") > SMALL_GROUP) & F.lit(margin < 1), F.col(f"_b{i}"))  # noqa: B023, E731
        got = got.select(*by, *(F.col(f"_n{i}") for i in every), *(bounded(i).alias(f"_b{i}") for i in every))
        groups = x.sparkSession.createDataFrame(got.collect(), got.schema)
        y = null_safe_join(x, F.broadcast(groups), by)
        under = {i: F.col(f"_q{i}") < F.col(f"_b{i}")[0] for i in every}
        inside = {i: F.col(f"_b{i}").isNull() | F.col(f"_q{i}").between(F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]) for i in every}
        below = y.groupBy(*by).agg(*(F.count_if(under[i]).alias(f"_l{i}") for i in every))
        held = F.array_compact(F.array(*(F.when(inside[i] & F.col(f"_q{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"_q{i}").alias("q"))) for i in every)))
        values = y.select(*by, F.explode(held).alias("_x")).groupBy(*by, F.col("_x.i").alias("_i"), F.col("_x.q").alias("_q")).agg(F.count("*").alias("_k"))
        upto = F.sum("_k").over(Window.partitionBy(*by, "_i").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0))
        facts = null_safe_join(groups.select(*by, *(f"_n{i}" for i in every)), below, by)
        ranked = null_safe_join(values.withColumn("_upto", upto), F.broadcast(facts), by)
        picked = []
        for i, k in enumerate(names):
            mine, rank = F.col("_i") == i, F.lit(float(wanted[k][1])) * (F.col(f"_n{i}") - 1)
            last = F.col(f"_l{i}") + F.col("_upto")
            for name, place in (("low", F.floor(rank)), ("high", F.least(F.floor(rank) + 1, F.col(f"_n{i}") - 1))):
                picked.append(F.min(F.when(mine & (last > place) & (F.col(f"_l{i}") <= F.floor(rank)), F.col("_q"))).alias(f"_{name}{i}"))
        picked = ranked.groupBy(*by).agg(*picked)
        rows = null_safe_join(groups, picked, by, "left").collect() if by else groups.crossJoin(picked).collect()
        if all(r[f"_n{i}"] == 0 or (r[f"_low{i}"] is not None and r[f"_high{i}"] is not None) for r in rows for i in every):
            break
        if margin >= 1:
            raise RuntimeError("quantiles of whole groups were not found")
        margin *= 10

    def between(r, i):
        if not r[f"_n{i}"]:
            return None
        a, b, rank = r[f"_low{i}"], r[f"_high{i}"], wanted[names[i]][1] * (r[f"_n{i}"] - 1)
        return a if a == b else a + (rank - int(rank)) * (b - a)

    schema = StructType([*keys, *(StructField(k, DoubleType()) for k in names)])
    return x.sparkSession.createDataFrame([(*(r[k] for k in by), *(between(r, i) for i in every)) for r in rows], schema)


def group_metrics(df: DataFrame, pred: str, ref: str, by: list[str]) -> DataFrame:
    """error_metrics() of few large groups, with exact quantiles in bounded memory. Pairs
    are written to the shared folder once and read in several passes."""
    both = F.col(pred).isNotNull() & F.col(ref).isNotNull()
    d = graph.cut(df.select(*by, F.when(both, F.col(pred)).alias("_p"), F.when(both, F.col(ref)).alias("_r"))).withColumn("_d", F.col("_p") - F.col("_r"))
    n, square = F.count("_d"), F.sum(F.col("_d") * F.col("_d"))
    spread = F.var_pop("_r") * n
    first = d.groupBy(*by).agg(
        n.alias("n"),
        (F.count("*") - n).alias("excluded_nodata"),
        F.avg("_d").alias("bias"),
        F.avg(F.abs("_d")).alias("mae"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        F.when(n > 1, correlation("_p", "_r")).alias("pearson_r"),
        F.when(n > 1, 1 - F.try_divide(square, F.when(spread > 0, spread))).alias("r2"),
    )
    q = group_quantiles(d, by, {"median_error": (F.col("_d"), 0.5), "p95_abs_error": (F.abs("_d"), 0.95), "le90": (F.abs("_d"), 0.9)})
    off = null_safe_join(d, F.broadcast(q.select(*by, "median_error")), by)
    spreads = group_quantiles(off, by, {"nmad": (F.abs(F.col("_d") - F.col("median_error")), 0.5)})
    out = null_safe_join(null_safe_join(first, q, by), spreads.withColumn("nmad", F.col("nmad") * MAD_SCALE), by)
    return out.select(*by, "n", "excluded_nodata", "bias", "mae", "rmse", "median_error", "nmad", "p95_abs_error", "le90", "pearson_r", "r2")


def affine_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None, min_pixels: int = 2) -> DataFrame:
    """Least-squares y ~ a * x + b per group: a, b, fit_n; (1, 0) below min_pixels valid
    pairs or without variation in x."""
    by = by or []
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    v, w = F.when(both, F.col(x)), F.when(both, F.col(y))
    ok = (F.count(v) >= min_pixels) & (F.max(v) > F.min(v))
    return df.groupBy(*by).agg(F.when(ok, F.regr_slope(w, v)).otherwise(1.0).alias("a"), F.when(ok, F.regr_intercept(w, v)).otherwise(0.0).alias("b"), F.count(v).alias("fit_n"), F.coalesce(ok, F.lit(False)).alias("fitted"))


def affine_fitted_metrics(df: DataFrame, pred: str, ref: str, by: list[str] | None = None) -> DataFrame:
    """Metrics after ref ~ a * pred + b is fitted on the same pairs (optimistic by design);
    groups without two valid pairs or variation have fitted = false and unfitted scores
    left null."""
    by = by or []
    fit = affine_fit(df, pred, ref, by)
    joined = null_safe_join(df, fit, by).withColumn("_fit", F.when(F.col("fitted"), F.col("a") * F.col(pred) + F.col("b")))
    return null_safe_join(error_metrics(joined, "_fit", ref, by), fit.select(*by, F.col("a").alias("fit_a"), F.col("b").alias("fit_b"), "fitted"), by)


def stratified(df: DataFrame, pred: str, ref: str, label: str, names: DataFrame) -> DataFrame:
    """Metrics by label for the labels of `names` (label, name); labels that are not named
    are skipped, named ones without pixels are listed with n = 0."""
    found = error_metrics(df, pred, ref, [label])
    out = names.join(found, label, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("excluded_nodata", F.coalesce("excluded_nodata", F.lit(0).cast("long")))


def pooled(df: DataFrame, by: list[str], n: str = "n", rmse: str = "rmse", bias: str = "bias") -> DataFrame:
    """Site results pooled by pixel counts."""
    total = F.sum(n)
    return df.groupBy(*by).agg(total.alias("n"), F.sqrt(F.sum(F.col(n) * F.col(rmse) * F.col(rmse)) / total).alias("rmse"), (F.sum(F.col(n) * F.col(bias)) / total).alias("bias"))
