"""Neighbourhood operators of a dense raster (row, col, v), as window frames.

Every two-dimensional window is two one-dimensional ones, along columns and then along
rows; frames are by distance, so gaps don't shift them. `scene` names a column that
tells rasters apart, or is None for a single one: its rows and columns then are the
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _keys(scene: str | None) -> list[str]:
    return [scene] if scene else []


def with_size(df: DataFrame, scene: str | None = None) -> DataFrame:
    """df with _h and _w, the raster's numbers of rows and columns (one row a scene is
    joined)."""
    size = df.groupBy(*_keys(scene)).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    return df.join(size, scene) if scene else df.crossJoin(F.broadcast(size))


def line(axis: str, half: int | tuple[int, int], scene: str | None = None) -> WindowSpec:
    """Frame along an axis: `half` pixels to both sides, or (first, last) offsets."""
    other = "col" if axis == "row" else "row"
    a, b = half if isinstance(half, tuple) else (-half, half)
    return Window.partitionBy(*_keys(scene), other).orderBy(axis).rangeBetween(a, b)


def mirrored(df: DataFrame, axis: str, half: int, repeat_edge: bool) -> DataFrame:
    """df (with sizes) and its border mirrored outward along an axis; repeat_edge tells
    whether the edge pixel itself is repeated. Only border pixels are repeated, in place:
    the input is read once."""
    n, k, e = F.col("_h" if axis == "row" else "_w"), F.col(axis), 0 if repeat_edge else 1
    low = F.when((k >= e) & (k < half + e), e - 1 - k)
    high = F.when((k <= n - 1 - e) & (k > n - 1 - e - half), 2 * n - 1 - e - k)
    return df.withColumn(axis, F.explode(F.array_compact(F.array(k, low, high))))


def box_sums(df: DataFrame, size: int, sums: dict[str, Column], repeat_edge: bool = True, scene: str | None = None, running: bool = False) -> DataFrame:
    """df with sums over size x size pixels (size odd), borders mirrored.

    running: as differences of running sums, so that the cost of a pixel doesn't grow with
    the window; their rounding is that of the sum over a whole line. Otherwise each window
    is summed up by itself, for sums that are going to be subtracted from each other."""
    half = size // 2
    x = with_size(df, scene).withColumns(sums)
    for axis in ("row", "col"):
        n = F.col("_h" if axis == "row" else "_w")
        first = Window.unboundedPreceding
        upto, before, around = (line(axis, f, scene) for f in ((first, half), (first, -half - 1), half))
        total = lambda c: F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0)) if running else F.sum(c).over(around)  # noqa: B023, E731
        x = mirrored(x, axis, half, repeat_edge).withColumns({c: total(c) for c in sums}).filter((F.col(axis) >= 0) & (F.col(axis) < n))
    return x.drop("_h", "_w")


def lowpass(df: DataFrame, size: int, v: str = "v", into: str = "low", scene: str | None = None) -> DataFrame:
    """Nodata-aware box mean (size made odd); null where half the window or more is nodata."""
    k = max(1, int(size)) | 1
    out = box_sums(df, k, {"_s": F.coalesce(F.col(v), F.lit(0.0)), "_c": F.col(v).isNotNull().cast("long")}, True, scene, running=True)
    return out.withColumn(into, F.when(F.col("_c") > 0.5 * k * k, F.col("_s") / F.col("_c"))).drop("_s", "_c")


def roughness(df: DataFrame, size: int, scene: str | None = None) -> DataFrame:
    """Standard deviation in a size x size window (odd, 3 at least); nodata counts as the
    raster's mean, and the border is mirrored without its edge."""
    k = max(3, int(size) | 1)
    mean = df.groupBy(*_keys(scene)).agg(F.avg("v").alias("_mean"))
    x = df.join(mean, scene) if scene else df.crossJoin(F.broadcast(mean))
    z = F.coalesce("v", "_mean")
    out = box_sums(x, k, {"_s": z, "_q": z * z}, False, scene)
    m = F.col("_s") / (k * k)
    return out.withColumn("roughness", F.sqrt(F.greatest(F.col("_q") / (k * k) - m * m, F.lit(0.0)))).drop("_s", "_q", "_mean")


def gradient(df: DataFrame, res: tuple[float, float], scene: str | None = None) -> DataFrame:
    """df with gx, gy: central differences, one-sided at the border; nodata spreads."""
    x = df
    for axis, step, name in (("col", res[0], "gx"), ("row", res[1], "gy")):
        other = "col" if axis == "row" else "row"
        w = Window.partitionBy(*_keys(scene), other).orderBy(axis)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        # the border is where no pixel is, not where one is nodata: no size is needed
        first, last = F.lag(F.lit(True)).over(w).isNull(), F.lead(F.lit(True)).over(w).isNull()
        x = x.withColumn(name, F.when(first, (after - F.col("v")) / step).when(last, (F.col("v") - before) / step).otherwise((after - before) / (2 * step)))
    return x


def slope(df: DataFrame, res: tuple[float, float], scene: str | None = None) -> DataFrame:
    """df with gx, gy and slope in degrees."""
    return gradient(df, res, scene).withColumn("slope", F.degrees(F.atan(F.hypot("gx", "gy"))))


def hillshade(df: DataFrame, res: tuple[float, float], azimuth: float = 315.0, elevation: float = 45.0, scene: str | None = None) -> DataFrame:
    """df with shade in [0, 1] of a light at azimuth and elevation; nodata stays."""
    x = gradient(df, res, scene)
    tilt, aspect = F.atan(F.hypot("gx", "gy")), F.atan2(-F.col("gx"), F.col("gy"))
    az, el = F.radians(F.lit(450.0 - azimuth)), F.radians(F.lit(elevation))
    lit = F.sin(el) * F.cos(tilt) + F.cos(el) * F.sin(tilt) * F.cos(az - aspect)
    return x.withColumn("shade", F.when(lit.isNotNull(), F.least(F.greatest(lit, F.lit(0.0)), F.lit(1.0))))


def rank_filter(df: DataFrame, frame: int | tuple[int, int], highest: bool, v: str = "v", scene: str | None = None) -> DataFrame:
    """Minimum (or maximum) over a rectangular window; pixels outside don't count."""
    f = F.max if highest else F.min
    x = df.withColumn(v, f(v).over(line("row", frame, scene)))
    return x.withColumn(v, f(v).over(line("col", frame, scene)))


def grey_opening(df: DataFrame, size: int, scene: str | None = None) -> DataFrame:
    """Ground by opening (minimum, then maximum) over size x size pixels, never above the
    surface; nodata counts as the highest value and stays nodata."""
    half = max(3, int(size) | 1) // 2
    top = df.groupBy(*_keys(scene)).agg(F.max("v").alias("_top"))
    x = df.join(top, scene) if scene else df.crossJoin(F.broadcast(top))
    x = x.withColumn("ground", F.coalesce("v", "_top"))
    x = rank_filter(rank_filter(x, half, False, "ground", scene), half, True, "ground", scene)
    return x.withColumn("ground", F.when(F.col("v").isNotNull(), F.least("ground", "v"))).drop("_top")


def binary_opening(df: DataFrame, mask: str = "mask", scene: str | None = None) -> DataFrame:
    """Opening of a boolean mask by 2 x 2 pixels, anchored at the lower right one."""
    x = df.withColumn(mask, F.col(mask).cast("int"))
    x = rank_filter(rank_filter(x, (-1, 0), False, mask, scene), (-1, 0), True, mask, scene)
    return x.withColumn(mask, F.col(mask) == 1)


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical kernel of the given radius: row by row, half the width is
    the circle's, rounded to even halves."""
    out = []
    for i in range(-radius, radius + 1):
        w = round((radius * radius - i * i) ** 0.5)
        out += [(i, j) for j in range(-w, w + 1)]
    return out


def morph(df: DataFrame, offsets: list[tuple[int, int]], erode: bool, mask: str = "mask", scene: str | None = None) -> DataFrame:
    """Erosion or dilation of a boolean mask by a kernel of offsets. Outside the image is
    set for erosion, not for dilation. Only the pixels that decide are exploded: set ones
    for dilation, unset ones for erosion."""
    keys = [*_keys(scene), "row", "col"]
    kernel = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in offsets))
    active = df.filter(~F.col(mask) if erode else F.col(mask)).withColumn("_k", F.explode(kernel))
    reached = active.select(*_keys(scene), (F.col("row") - F.col("_k.i")).alias("row"), (F.col("col") - F.col("_k.j")).alias("col")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return df.join(reached, keys, "left").withColumn(mask, ~hit if erode else hit).drop("_hit")


def cell_mean(df: DataFrame, v: str = "v", cell: str = "cell", into: str = "mean") -> DataFrame:
    """df with the mean of v over each cell; cells below 0 stand outside and get null."""
    inside = F.col(cell) >= 0
    means = df.filter(inside).groupBy(cell).agg(F.avg(v).alias(into))
    return df.join(means, cell, "left")


def block_mean(df: DataFrame, f: int, v: str = "v", scene: str | None = None) -> DataFrame:
    """Nodata-aware f x f block means; a ragged edge is cropped."""
    x = with_size(df, scene).filter((F.col("row") < F.floor(F.col("_h") / f) * f) & (F.col("col") < F.floor(F.col("_w") / f) * f))
    return x.groupBy(*_keys(scene), F.floor(F.col("row") / f).alias("row"), F.floor(F.col("col") / f).alias("col")).agg(F.avg(v).alias(v))


def area_average(df: DataFrame, ratio_row: float, ratio_col: float, v: str = "v") -> DataFrame:
    """Fine pixels averaged by overlap onto cells of ratio_row x ratio_col pixels: row,
    col, v (over valid pixels) and coverage (valid share of the cell)."""
    x = df
    for axis, ratio in (("row", ratio_row), ("col", ratio_col)):
        k = F.col(axis)
        span = F.sequence(F.floor(k / ratio).cast("long"), (F.ceil((k + 1) / ratio) - 1).cast("long"))
        x = x.withColumn(f"_{axis}", F.explode(span)).withColumn(f"_w{axis}", F.least(k + 1, (F.col(f"_{axis}") + 1) * ratio) - F.greatest(k, F.col(f"_{axis}") * ratio)).filter(F.col(f"_w{axis}") > 1e-12)
    w = F.col("_wrow") * F.col("_wcol")
    ok = F.when(F.col(v).isNotNull(), w)
    return x.groupBy(F.col("_row").alias("row"), F.col("_col").alias("col")).agg(F.try_divide(F.sum(w * F.col(v)), F.sum(ok)).alias(v), (F.coalesce(F.sum(ok), F.lit(0.0)) / (ratio_row * ratio_col)).alias("coverage"))


def mesh(df: DataFrame, sx: float, sy: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a dense raster: a vertex a pixel, two triangles for each quad
    without nodata. An all-nodata raster is refused when the vertices are read."""
    low = df.agg(F.min("v").alias("_low"))
    low = low.select(F.coalesce("_low", F.raise_error(F.lit("height grid is all nodata")).cast("double")).alias("_low"))
    x = with_size(df).crossJoin(F.broadcast(low))
    vid = F.col("row") * F.col("_w") + F.col("col")
    v = x.select(vid.alias("vid"), ((F.col("col") + 0.5) * sx).alias("x"), (-(F.col("row") + 0.5) * sy).alias("y"), F.coalesce(F.col("v") - F.col("_low"), F.lit(0.0)).alias("z"), ((F.col("col") + 0.5) / F.col("_w")).alias("u"), (1 - (F.col("row") + 0.5) / F.col("_h")).alias("t"))
    ok = F.col("v").isNotNull()
    right = Window.partitionBy("row").orderBy("col")
    down = Window.partitionBy("col").orderBy("row")
    two = x.withColumn("_two", ok & F.coalesce(F.lead(ok).over(right), F.lit(False))).withColumn("_quad", F.col("_two") & F.coalesce(F.lead("_two").over(down), F.lit(False)))
    a = vid
    quads = two.filter("_quad").select(F.explode(F.array(F.struct(a.alias("a"), (a + F.col("_w")).alias("b"), (a + 1).alias("c")), F.struct((a + 1).alias("a"), (a + F.col("_w")).alias("b"), (a + F.col("_w") + 1).alias("c")))).alias("f"))
    return v, quads.select("f.a", "f.b", "f.c")
