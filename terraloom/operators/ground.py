"""Ground under a surface, heights above it, shadows and heights from shadows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators import graph, regrid, terrain


def _plane_residual(row: np.ndarray, col: np.ndarray, z: np.ndarray, percentile: float) -> float:
    """Height at the origin of a plane through the lower half of some points (fitted three
    times, each time to what lies below the median), plus a low percentile of what is off it."""
    a = np.c_[row, col, np.ones(len(z))]
    keep = np.ones(len(z), bool)
    for _ in range(3):
        coef = np.linalg.lstsq(a[keep], z[keep], rcond=None)[0]
        off = z - a @ coef
        keep = off <= np.median(off[keep])
        if keep.sum() < 10:
            break
    return float(coef[2] + np.percentile(off, percentile))


def lattice_ground(df: DataFrame, win: int, percentile: float = 10.0, max_roughness: float = 0.5, rough_px: int = 3, least: int = 20) -> DataFrame:
    """(row, col, i, j, fraction, ground) on a lattice of overlapping windows: a plane is
    fitted to smooth pixels and refitted on its lower half, then the low percentile of
    the residuals is added at the window's centre; null with fewer than `least` smooth
    pixels.

    Pixels are packed once into blocks between lattice lines, whose arrays then go to the
    four windows that meet there: a window is one bounded group (win + 1 squared pixels)."""
    x = terrain.with_size(terrain.roughness(df, rough_px))
    step, half = max(4, win // 2), win // 2
    cand = F.col("v").isNotNull() & (F.col("roughness") <= max_roughness)
    if "water" in df.columns:
        cand &= ~F.coalesce("water", F.lit(False))

    def blocks(axis: Column) -> Column:
        """A block, and for a pixel on a lattice line the block before it too."""
        k = F.floor(axis / step)
        return F.when((axis % step == 0) & (k > 0), F.array(k, k - 1)).otherwise(F.array(k))

    size = x.agg(F.first("_h"), F.first("_w")).first()
    points = [0 if n is None else (int(n) - 1) // step for n in size]
    dealt = x.select("row", "col", "v", cand.alias("ok")).withColumn("bi", F.explode(blocks(F.col("row")))).withColumn("bj", F.explode(blocks(F.col("col"))))

    def pack(t: pa.Table) -> pa.Table:
        arrays = {
            "rows": t["row"].to_numpy().astype(np.int32),
            "cols": t["col"].to_numpy().astype(np.int32),
            "zs": np.array(t["v"].to_numpy(), np.float64),
            "oks": t["ok"].to_numpy().astype(np.bool_),
        }
        return pa.table({"bi": t["bi"][:1], "bj": t["bj"][:1], **{k: pa.array([a.tobytes()], pa.binary()) for k, a in arrays.items()}})

    packed = dealt.groupBy("bi", "bj").applyInArrow(pack, "bi long, bj long, rows binary, cols binary, zs binary, oks binary")
    ends = lambda b, last: F.filter(F.array(F.col(b), F.col(b) + 1), lambda p: p <= last)
    windows = packed.withColumn("i", F.explode(ends("bi", points[0]))).withColumn("j", F.explode(ends("bj", points[1])))

    def fit(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        parts = []
        for bi, bj, *raw in zip(*(t[c].to_pylist() for c in ("bi", "bj", "rows", "cols", "zs", "oks")), strict=True):
            row, col, z, ok = (np.frombuffer(b, d) for b, d in zip(raw, (np.int32, np.int32, np.float64, np.bool_), strict=True))
            row, col = row - i * step, col - j * step
            # a line that two blocks hold counts in the later one
            inside = (np.abs(row) <= half) & (np.abs(col) <= half) & ((row >= 0) == (bi == i)) & ((col >= 0) == (bj == j))
            parts.append((row[inside], col[inside], z[inside], ok[inside]))
        row, col, z, ok = (np.concatenate(p) for p in zip(*parts, strict=True))
        ground = _plane_residual(row[ok], col[ok], z[ok], percentile) if ok.sum() >= least else None
        fraction = float(ok.mean()) if len(ok) else None
        return pa.table({"i": pa.array([i], pa.int64()), "j": pa.array([j], pa.int64()), "fraction": pa.array([fraction], pa.float64()), "ground": pa.array([ground], pa.float64())})

    found = windows.groupBy("i", "j").applyInArrow(fit, "i long, j long, fraction double, ground double")
    return found.select((F.col("i") * step).alias("row"), (F.col("j") * step).alias("col"), "i", "j", "fraction", "ground")


def fill_nearest(lattice: DataFrame) -> DataFrame:
    """lattice with empty points filled from the nearest full one (city-block distance,
    first in row order of equals); without a full one they stay empty.

    Points look for full ones in cells around them, whose side doubles until all have
    found one: joins are on equal cells, and what is found goes into no later round."""
    found = lattice.filter("ground IS NOT NULL").select(F.col("i").alias("fi"), F.col("j").alias("fj"), F.col("ground").alias("g"))
    size = lattice.agg(F.max("i") - F.min("i") + 1, F.max("j") - F.min("j") + 1, F.count("ground")).first()
    left = lattice.filter("ground IS NULL").select("i", "j")
    near = F.sequence(F.lit(-1), F.lit(1))
    done, reach = [], 1
    while size[2]:
        cell = lambda a, b, r=reach: [F.floor(F.col(a) / r).alias("a"), F.floor(F.col(b) / r).alias("b")]
        around = left.select("i", "j", *cell("i", "j")).withColumn("x", F.explode(near)).withColumn("y", F.explode(near))
        around = around.select("i", "j", (F.col("a") + F.col("x")).alias("a"), (F.col("b") + F.col("y")).alias("b"))
        d = F.abs(F.col("i") - F.col("fi")) + F.abs(F.col("j") - F.col("fj"))
        pairs = around.join(found.select("fi", "fj", "g", *cell("fi", "fj")), ["a", "b"]).filter(d <= reach)
        hit = graph.cut(pairs.groupBy("i", "j").agg(F.min_by("g", F.struct(d, "fi", "fj")).alias("g")))
        done.append(hit)
        left = graph.cut(left.join(hit, ["i", "j"], "left_anti"))
        if reach >= size[0] + size[1] or left.isEmpty():
            break
        reach *= 2
    if not done:
        return lattice
    every = reduce(DataFrame.union, done)
    return lattice.join(every, ["i", "j"], "left").withColumn("ground", F.coalesce("ground", "g")).drop("g")


def estimate_ground(df: DataFrame, win: int, min_fraction: float = 0.05, **options) -> DataFrame:
    """(row, col, v, ground, ndsm, low_confidence): the lattice's ground interpolated at
    true places, never above the surface; height above it, never below zero."""
    raw = graph.cut(lattice_ground(df, win, **options))
    filled = fill_nearest(raw)
    n = raw.agg(F.max("i") + 1, F.max("j") + 1).first()
    step = max(4, win // 2)
    lat = filled.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("ground").alias("v"))
    if min(n) > 1:
        x = regrid.bilinear(df.select("row", "col", "v"), lat, F.col("row") / step, F.col("col") / step, ["row", "col"], "v", "ground", True, (n[0], n[1]))
    else:
        x = df.select("row", "col", "v").crossJoin(F.broadcast(lat.agg(F.min_by("v", F.struct("row", "col")).alias("ground"))))
    low = raw.select(F.col("i").alias("row"), F.col("j").alias("col"), (F.col("fraction") < min_fraction).alias("v"))
    size = terrain.with_size(x)
    x = regrid.nearest(size, low, F.floor(F.col("row") * n[0] / F.col("_h")), F.floor(F.col("col") * n[1] / F.col("_w")), "v", "low")
    g = F.when(F.col("v").isNotNull(), F.least("ground", "v"))
    return x.select("row", "col", "v", g.alias("ground"), F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - g, F.lit(0.0))).alias("ndsm"), (F.coalesce("low", F.lit(True)) | F.col("v").isNull()).alias("low_confidence"))


def otsu(histogram: DataFrame, classes: int = 3) -> DataFrame:
    """(t1[, t2]): thresholds of an 8-bit histogram (bin, n) with the largest variance
    between 2 or 3 classes, the first of equals. 256 bins meet 256 bins at most."""
    h = histogram.sparkSession.range(256).select(F.col("id").alias("bin")).join(histogram, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("all"))
    w = Window.partitionBy("all").orderBy("bin")
    total = Window.partitionBy("all")
    p = F.col("n") / F.sum("n").over(total)
    c = h.select("bin", "all", p.alias("p")).select("bin", F.sum("p").over(w).alias("c"), F.sum(F.col("p") * F.col("bin")).over(w).alias("s"), F.sum(F.col("p") * F.col("bin")).over(total).alias("m"))
    part = lambda weight, moment: F.when(weight > 1e-15, moment * moment / F.when(weight > 1e-15, weight)).otherwise(0.0)
    a = c.select((F.col("bin") + 1).alias("t1"), F.col("c").alias("c1"), F.col("s").alias("s1"), "m").filter("t1 BETWEEN 1 AND 253" if classes == 3 else "t1 BETWEEN 1 AND 255")
    if classes == 2:
        v = part(F.col("c1"), F.col("s1")) + part(1 - F.col("c1"), F.col("m") - F.col("s1"))
        return a.agg(F.min_by("t1", F.struct(-F.round(v, 9), "t1")).alias("t1"))
    b = c.select((F.col("bin") + 1).alias("t2"), F.col("c").alias("c2"), F.col("s").alias("s2")).filter("t2 <= 255")
    v = part(F.col("c1"), F.col("s1")) + part(F.col("c2") - F.col("c1"), F.col("s2") - F.col("s1")) + part(1 - F.col("c2"), F.col("m") - F.col("s2"))
    best = a.join(F.broadcast(b), F.col("t1") < F.col("t2")).agg(F.min_by(F.struct("t1", "t2"), F.struct(-F.round(v, 9), "t1", "t2")).alias("t"))
    return best.select("t.t1", "t.t2")


def area_filter(mask: DataFrame, width: int, least: int) -> DataFrame:
    """Set pixels of components of at least `least` pixels."""
    labels = graph.pixel_components(mask, width)
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("area")).filter(F.col("area") >= least), "label").select("row", "col", "label", "area")


def shadow_mask(image: DataFrame, width: int, least: int = 6, max_green: float = 0.05) -> DataFrame:
    """(row, col) of shadow candidates: darkest of three luminance classes without
    vegetation, opened by 2 x 2, small components dropped. image: row, col, r, g, b."""
    from terraloom.functions.scalars import excess_green, luminance

    x = image.withColumn("lum", luminance(F.col("r"), F.col("g"), F.col("b")))
    t = otsu(x.groupBy(F.col("lum").cast("long").alias("bin")).agg(F.count("*").alias("n"))).select("t1")
    dark = (F.col("lum") < F.col("t1")) & (excess_green(F.col("r"), F.col("g"), F.col("b")) < max_green)
    m = terrain.binary_opening(x.crossJoin(F.broadcast(t)).select("row", "col", dark.alias("mask"))).filter("mask")
    return area_filter(m, width, least).select("row", "col")


def shadow_azimuth(shadow: DataFrame, footprints: DataFrame, height: int, width: int, gsd: float, low: float = 1.5, high: float = 6.0) -> DataFrame:
    """(direction, score) by whole degrees, best first in `score`: share of shadow in
    footprints moved along each direction, outside any footprint. Distinct pixel shifts
    are few; counts are made once for each and joined to the directions."""
    turns = []
    for d in range(360):
        a = np.radians(d)
        for dist in np.linspace(low, high, 4):
            turns.append((d, round(-np.cos(a) * dist / gsd), round(np.sin(a) * dist / gsd)))
    turn = shadow.sparkSession.createDataFrame(turns, "direction int, dr long, dc long")
    shifts = F.broadcast(turn.select("dr", "dc").distinct())
    moved = footprints.select("row", "col").crossJoin(shifts).select("dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    moved = moved.filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < height) & (F.col("col") < width))
    free = moved.join(footprints.select("row", "col"), ["row", "col"], "left_anti").join(shadow.select("row", "col", F.lit(1).alias("hit")), ["row", "col"], "left")
    counts = free.groupBy("dr", "dc").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return turn.join(counts, ["dr", "dc"], "left").groupBy("direction").agg((F.coalesce(F.sum("k"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("score"))


def best_direction(scores: DataFrame) -> DataFrame:
    """(direction, sun_azimuth, best, middle): the first direction of the highest score."""
    top = scores.agg(F.max_by("direction", F.struct("score", -F.col("direction"))).alias("direction"), F.max("score").alias("best"), F.median("score").alias("middle"))
    return top.select("direction", F.pmod(F.col("direction") + 180, F.lit(360)).alias("sun_azimuth"), "best", "middle")


def shadow_heights(shadow: DataFrame, footprints: DataFrame, height: int, width: int, gsd: float, azimuth: float, elevation: float, max_len: float = 80.0, min_rays: int = 5) -> DataFrame:
    """(id, height, rays, in_shadow, truncated): rays from each footprint's edge pixels on
    the shadow side, a row a step; a ray's run is its last shadow step before the first
    that stops it (light, another building, the image's edge). Height comes from the
    upper quartile of the runs; null with fewer than min_rays."""
    a = np.radians((azimuth + 180) % 360)
    dr, dc = float(-np.cos(a)), float(np.sin(a))
    fp = footprints.select("row", "col", "id")
    ring = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    r, c = F.col("row") + F.col("k.i"), F.col("col") + F.col("k.j")
    inside = fp.withColumn("k", F.explode(ring)).select("id", F.col("row").alias("r0"), F.col("col").alias("c0"), r.alias("row"), c.alias("col")).filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < height) & (F.col("col") < width))
    edge = inside.join(fp, ["id", "row", "col"], "left_anti").select("id", "r0", "c0").distinct()
    clip = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(x))).cast("long")
    ahead = edge.select("id", "r0", "c0", clip(F.col("r0") + 1.5 * dr, height).alias("row"), clip(F.col("c0") + 1.5 * dc, width).alias("col"))
    rays = ahead.join(fp, ["id", "row", "col"], "left_anti").select("id", "r0", "c0")
    steps = rays.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(int(max_len / gsd)))))
    steps = steps.select("id", "r0", "c0", "s", F.rint(F.col("r0") + dr * F.col("s")).cast("long").alias("row"), F.rint(F.col("c0") + dc * F.col("s")).cast("long").alias("col"))
    seen = steps.join(fp.select("row", "col", F.col("id").alias("other")), ["row", "col"], "left").join(shadow.select("row", "col", F.lit(True).alias("dark")), ["row", "col"], "left")
    off = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= height) | (F.col("col") >= width)
    own = F.coalesce(F.col("other") == F.col("id"), F.lit(False))
    kind = F.when(off, 3).when(own, 0).when(F.col("other").isNotNull(), 2).when(F.col("dark").isNull(), 1).otherwise(4)
    k = seen.select("id", "r0", "c0", "s", kind.alias("kind"))
    per = k.groupBy("id", "r0", "c0").agg(F.min(F.when(F.col("kind").isin(1, 2, 3), F.struct("s", "kind"))).alias("stop"), F.array_sort(F.collect_list(F.when(F.col("kind") == 4, F.col("s")))).alias("dark"))
    run = F.coalesce(F.array_max(F.filter("dark", lambda s: F.col("stop").isNull() | (s < F.col("stop.s")))), F.lit(0))
    per = per.select("id", run.alias("n"), F.col("stop.kind").alias("why"))
    cut = F.when((F.col("why") == 3) | ((F.col("why") == 2) & (F.col("n") > 0)), 1).otherwise(0)
    out = per.groupBy("id").agg(F.count("*").alias("rays"), F.count_if(F.col("n") > 0).alias("in_shadow"), F.sum(cut).alias("cut"), F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.75)).alias("q"))
    tall = F.when(F.col("in_shadow") >= min_rays, F.col("q") * gsd * float(np.tan(np.radians(elevation))))
    return out.select("id", tall.alias("height"), "rays", "in_shadow", ((F.col("in_shadow") >= min_rays) & (F.col("cut") > 0.3 * F.col("in_shadow"))).alias("truncated"))
