"""Robust calibration of a relative surface against a coarse elevation model, with
quality gates: methods M0 (elevation model alone), M1 (global affine), M2 (its residual)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators import errors, graph, terrain
from terraloom.operators.relational import hashed_sample


@dataclass(frozen=True)
class Gate:
    """Limits that a calibration must keep to be metric."""

    min_anchors: int = 100
    min_coverage: float = 0.8
    max_heldout_nmad: float = 15.0
    max_scale_rel_std: float = 0.5
    bootstrap: int = 30


#: Fixed values of the robust fits.
EPSILON, RIDGE = 1.35, 1e-4
MAX_FIT, RESAMPLE, MIN_FIT = 200_000, 5_000, 100


def anchor_masks(df: DataFrame, max_slope: float, edge: int) -> DataFrame:
    """df (row, col, dem, low, slope, water, fit) with `reason`: the first that excludes a
    pixel (nodata, water, steep, edge), else fit or held. Each pixel has one reason, so
    fit and held-out anchors can't overlap. edge = 0 excludes no border; an unknown slope
    is not steep."""
    x = terrain.with_size(df)
    border = (F.col("row") < edge) | (F.col("col") < edge) | (F.col("row") > F.col("_h") - 1 - edge) | (F.col("col") > F.col("_w") - 1 - edge)
    reason = (
        F.when(F.col("dem").isNull() | F.col("low").isNull(), "nodata")
        .when(F.coalesce(F.col("water"), F.lit(False)), "water")
        .when(F.coalesce(F.col("slope") > max_slope, F.lit(False)), "steep")
        .when(border if edge else F.lit(False), "edge")
        .when(F.col("fit"), "fit")
        .otherwise("held")
    )
    return x.withColumn("reason", reason).drop("_h", "_w")


def huber(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, scale) of y ~ a * x + b by Huber's regression with joint scale, along the last
    axis: rows of a matrix are samples that are fitted together. Weights and scale are
    renewed in turn until they settle."""
    x, y = np.atleast_2d(x), np.atleast_2d(y)
    n = x.shape[1]
    mu, sd = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
    if (sd == 0).any():
        raise ValueError("no variation in the relative signal on the anchors")
    z = (x - mu) / sd
    w, scale = np.ones_like(z), None
    slope, level = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    for _ in range(rounds):
        # weighted normal equations of a line, with a ridge on its slope
        sw, sz, szz = (v.sum(axis=1, keepdims=True) for v in (w, w * z, w * z * z))
        sy, szy = (w * y).sum(axis=1, keepdims=True), (w * z * y).sum(axis=1, keepdims=True)
        det = (szz + RIDGE) * sw - sz * sz
        before = slope, level
        slope, level = (szy * sw - sz * sy) / det, ((szz + RIDGE) * sy - sz * szy) / det
        r = np.abs(y - slope * z - level)
        if scale is None:
            scale = 1.4826 * np.median(r, axis=1, keepdims=True) + 1e-12
        for _ in range(50):
            out = r > EPSILON * scale
            left = n - EPSILON**2 * out.sum(axis=1, keepdims=True)
            inner = np.where(out, 0.0, r * r).sum(axis=1, keepdims=True)
            fresh = np.where(left > 0, np.sqrt(inner / np.where(left > 0, left, 1)), scale)
            done = np.abs(fresh - scale) <= 1e-10 * scale
            scale = np.where(done, scale, np.maximum(fresh, 1e-12))
            if done.all():
                break
        w = np.minimum(1, EPSILON * scale / np.maximum(r, 1e-12))
        moved = np.maximum(np.abs(slope - before[0]), np.abs(level - before[1]))
        if (moved < 1e-10 * np.maximum(1.0, np.maximum(np.abs(slope), np.abs(level)))).all():
            break
    a = slope / sd
    return a[:, 0], (level - a * mu)[:, 0], scale[:, 0]


def huber_fit(df: DataFrame, x: str, y: str) -> dict:
    """The same fit over all rows of a DataFrame, distributed (no sample, no collect)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ok = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    s = ok.agg(F.avg("_x").alias("mu"), F.stddev_pop("_x").alias("sd"), F.count("*").alias("n")).first()
    if s["n"] < MIN_FIT:
        raise ValueError(f"only {s['n']} anchor pixels; cannot fit")
    if not s["sd"]:
        raise ValueError("no variation in the relative signal on the anchors")
    std = VectorAssembler(inputCols=["_z"], outputCol="features").transform(ok.withColumn("_z", (F.col("_x") - s["mu"]) / s["sd"]))
    m = LinearRegression(loss="huber", epsilon=EPSILON, regParam=RIDGE / s["n"], standardization=False, labelCol="_y", maxIter=500, tol=1e-10).fit(std)
    a = float(m.coefficients[0]) / s["sd"]
    return {"a": a, "b": float(m.intercept) - a * s["mu"], "scale": float(m.scale), "n": s["n"]}


def _indexed(df: DataFrame, x: str, y: str, seed: int) -> DataFrame:
    """At most MAX_FIT hashed rows with an index: bounded, so one ordered frame is fine."""
    some = hashed_sample(df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"), MAX_FIT, seed, "x", "y")
    return some.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y")) - 1)


def ransac_fit(df: DataFrame, x: str, y: str, seed: int = 0, trials: int = 100) -> dict:
    """Least squares on the inliers of the best of `trials` lines through two hashed
    points; inliers lie within the median absolute deviation of y."""
    pts = graph.cut(_indexed(df, x, y, seed))
    n = pts.count()
    if n < 2:
        raise ValueError("two points at least are needed")
    med = pts.agg(F.median("y").alias("m")).first()["m"]
    mad = pts.agg(F.median(F.abs(F.col("y") - med)).alias("d")).first()["d"]
    rng = np.random.default_rng(seed)
    wanted = {(int(p), int(q)) for p, q in rng.integers(0, n, (trials, 2)) if p != q}
    at = {r["i"]: (r["x"], r["y"]) for r in pts.filter(F.col("i").isin(*{k for w in wanted for k in w})).collect()}
    lines = [((at[q][1] - at[p][1]) / (at[q][0] - at[p][0]), at[p]) for p, q in sorted(wanted) if at[p][0] != at[q][0]]
    if not lines:
        raise ValueError("no variation in the relative signal on the anchors")
    lines = [(a, y0 - a * x0) for a, (x0, y0) in lines]
    hits = pts.agg(*(F.count_if(F.abs(F.col("y") - a * F.col("x") - b) <= mad).alias(f"h{k}") for k, (a, b) in enumerate(lines))).first()
    a, b = lines[int(np.argmax(list(hits)))]
    inside = pts.filter(F.abs(F.col("y") - a * F.col("x") - b) <= mad)
    fit = errors.affine_fit(inside, "x", "y").first()
    return {"a": fit["a"], "b": fit["b"], "inlier_fraction": fit["fit_n"] / n}


def bootstrap_std(df: DataFrame, x: str, y: str, seed: int = 0, times: int = 30) -> dict:
    """Standard deviation of Huber slopes over resamples of at most RESAMPLE points with
    replacement, scaled to the whole sample's size. A resample is one bounded group."""
    pts = graph.cut(_indexed(df, x, y, seed))
    n = pts.count()
    m = min(n, RESAMPLE)
    draws = df.sparkSession.range(times * m).select(F.floor(F.col("id") / m).alias("k"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"))

    def fit(pdf):
        import pandas as pd

        return pd.DataFrame({"a": huber(pdf["x"].to_numpy(), pdf["y"].to_numpy())[0]})

    slopes = draws.join(pts, "i").groupBy("k").applyInPandas(fit, "a double")
    return {"a_std": slopes.agg(F.stddev_pop("a").alias("s")).first()["s"] * (m / n) ** 0.5, "m": m, "n": n}


def gate_reasons(coverage: Column, a: Column, nmad: Column, gate: Gate, a_std: Column | None = None) -> Column:
    """Array of the reasons that refuse a metric product; empty if it passes. A held-out
    spread that is null or not a number fails."""
    tests = [
        F.when(F.coalesce(coverage, F.lit(0.0)) < gate.min_coverage, F.lit("elevation model covers too little of the image")),
        F.when(a <= 0, F.lit("fitted scale is not positive")),
    ]
    if a_std is None:
        tests.append(F.when(~F.coalesce((nmad <= gate.max_heldout_nmad) & ~F.isnan(nmad), F.lit(False)), F.lit("held-out residual is too large")))
    else:
        tests.append(F.when((a > 0) & (a_std / F.when(a > 0, a) > gate.max_scale_rel_std), F.lit("scale is unstable")))
    return F.array_compact(F.array(*tests))


def sigma_affine(nmad: Column, a_std: Column, r: Column, mean: Column) -> Column:
    """Uncertainty of a global affine product: the held-out spread, and the scale's own
    times the distance from the mean signal."""
    return F.sqrt(nmad**2 + (a_std * F.abs(r - mean)) ** 2)


def sigma_residual(dem_error: Column, a_std: Column, high: Column) -> Column:
    """Uncertainty of a residual product: the elevation model's error, and the scale's
    spread times the detail that is added."""
    return F.sqrt(dem_error**2 + (a_std * F.abs(high)) ** 2)


def calibrate(df: DataFrame, method: str, gate: Gate | None = None, max_slope: float = 10.0, edge: int = 0, lowpass_px: int = 5, seed: int = 0) -> tuple[DataFrame, dict]:
    """Metric surface and report of a method over df (row, col, r, dem, slope, water, fit,
    dem_error, cell).

    Returns (row, col, z, sigma, low_confidence); z and sigma are null throughout where
    the gate refuses. Sums, fits and gates are reports of a row each; pixels stay in
    Spark."""
    gate = gate or Gate()
    x = graph.cut(df if "low" in df.columns else terrain.lowpass(df, lowpass_px, "r", "low"))
    low_conf = F.col("dem").isNull() | F.coalesce(F.col("water"), F.lit(False))
    coverage = x.agg(F.avg(F.col("dem").isNotNull().cast("double")).alias("c")).first()["c"]
    report: dict = {"method": method, "coverage": coverage}
    one = df.sparkSession.range(1)
    fails = [] if (coverage or 0.0) >= gate.min_coverage else ["elevation model covers too little of the image"]
    z, sigma = F.col("dem"), F.col("dem_error")
    if method != "M0":
        marked = anchor_masks(x, max_slope, edge)
        fit_px = marked.filter("reason = 'fit'")
        counts = {r["reason"]: r["count"] for r in marked.groupBy("reason").count().collect()}
        report["anchors"] = counts
        if counts.get("fit", 0) < max(gate.min_anchors, MIN_FIT):
            fails.append(f"only {counts.get('fit', 0)} fit anchors")
        else:
            # at most MAX_FIT anchors come to the driver; all held-out ones are scored in Spark
            some = hashed_sample(fit_px.select("row", "col", "low", "dem"), MAX_FIT, seed, "row", "col").toPandas()
            px, py = some["low"].to_numpy(float), some["dem"].to_numpy(float)
            if px.std() == 0:
                report |= {"reasons": ["no variation in the relative signal on the anchors"], "metric": False}
                return x.select("row", "col", F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("sigma"), low_conf.alias("low_confidence")), report
            f = dict(zip(("a", "b", "scale"), (float(v[0]) for v in huber(px, py)), strict=True))
            m, rng = min(len(px), RESAMPLE), np.random.default_rng(seed)
            draws = [i for i in (rng.integers(0, len(px), m) for _ in range(gate.bootstrap)) if px[i].std() > 0]
            slopes = huber(px[np.stack(draws)], py[np.stack(draws)])[0] if draws else [np.nan]
            spread = float(np.std(slopes)) * (m / len(px)) ** 0.5
            held = marked.filter("reason = 'held'").withColumn("_p", f["a"] * F.col("low") + f["b"])
            stats = errors.scene_metrics(held, "_p", "dem")
            report |= {"a": f["a"], "b": f["b"], "a_std": spread, "heldout": stats}
            is_m1 = method == "M1"
            found = one.select(gate_reasons(F.lit(coverage), F.lit(f["a"]), F.lit(stats["nmad"]).cast("double"), gate, None if is_m1 else F.lit(spread)).alias("why")).first()["why"]
            fails = list(found)
            if is_m1:
                mean = x.agg(F.avg("r").alias("m")).first()["m"]
                z = f["a"] * F.col("r") + f["b"]
                sigma = sigma_affine(F.lit(stats["nmad"] or 0.0), F.lit(spread), F.col("r"), F.lit(mean))
            else:
                if method == "M2_cell":
                    x = terrain.cell_mean(x, "r", "cell", "_mean").withColumn("_high", F.col("r") - F.col("_mean"))
                else:
                    x = x.withColumn("_high", F.col("r") - F.col("low"))
                z = F.col("dem") + f["a"] * F.col("_high")
                sigma = sigma_residual(F.col("dem_error"), F.lit(spread), F.col("_high"))
    report["reasons"], report["metric"] = fails, not fails
    none = F.lit(None).cast("double")
    out = x.select("row", "col", (none if fails else z).alias("z"), (none if fails else F.when(~low_conf, sigma)).alias("sigma"), low_conf.alias("low_confidence"))
    return out, report


METHODS: dict[str, Callable] = {m: (lambda df, m=m, **k: calibrate(df, m, **k)) for m in ("M0", "M1", "M2_cell", "M2_smooth")}
