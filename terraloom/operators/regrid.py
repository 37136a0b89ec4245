"""Regridding joins, datum shifts, polygons and building heights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(fine: DataFrame, coarse: DataFrame, row: Column, col: Column, value: str = "v", into: str = "ref") -> DataFrame:
    """fine with the coarse cell that holds each pixel: (row, col) give the cell by
    arithmetic, so this is an equi-join; null outside."""
    c = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias(into))
    return fine.withColumn("_r", row.cast("long")).withColumn("_c", col.cast("long")).join(c, ["_r", "_c"], "left").drop("_r", "_c")


def bilinear(fine: DataFrame, coarse: DataFrame, row: Column, col: Column, keys: list[str], value: str = "v", into: str = "ref", extrapolate: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """fine with coarse interpolated at fractional (row, col), in units of coarse pixel
    centres; valid neighbours' weights are renormalised. The coarse grid is brought into
    brackets of four corners first, so each fine pixel meets one row in one join; keys
    name columns of fine that stay.

    extrapolate: brackets stay inside a lattice of `size` and weights may leave [0, 1]."""
    r0, c0 = F.floor(row), F.floor(col)
    if extrapolate:
        r0 = F.greatest(F.lit(0), F.least(r0, F.lit(size[0] - 2)))
        c0 = F.greatest(F.lit(0), F.least(c0, F.lit(size[1] - 2)))
    x = fine.withColumns({"_r0": r0.cast("long"), "_c0": c0.cast("long"), "_fr": row - r0, "_fc": col - c0})
    at = [(i, j) for i in (0, 1) for j in (0, 1)]
    places = F.array(*(F.struct((F.col("row") - i).cast("long").alias("r"), (F.col("col") - j).cast("long").alias("c"), F.lit(2 * i + j).alias("k")) for i, j in at))
    corners = coarse.filter(F.col(value).isNotNull()).select(F.explode(places).alias("p"), F.col(value).alias("_v"))
    brackets = corners.groupBy(F.col("p.r").alias("_r0"), F.col("p.c").alias("_c0")).agg(*(F.max(F.when(F.col("p.k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)))
    got = x.join(brackets, ["_r0", "_c0"], "left")
    weights = [(F.col("_fr") if i else 1 - F.col("_fr")) * (F.col("_fc") if j else 1 - F.col("_fc")) for i, j in at]
    total = sum((F.coalesce(w * F.col(f"_v{k}"), F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    known = sum((F.when(F.col(f"_v{k}").isNotNull(), w).otherwise(0.0) for k, w in enumerate(weights)), F.lit(0.0))
    return got.withColumn(into, F.try_divide(total, known)).drop("_r0", "_c0", "_fr", "_fc", "_v0", "_v1", "_v2", "_v3")


def on_grid(fine: DataFrame, transform: tuple, sources: list[tuple[DataFrame, tuple, Callable[[Column, Column], tuple[Column, Column]] | None]], into: str = "ref") -> DataFrame:
    """fine (row, col, more) with a mosaic of sources on its grid: at each pixel the first
    source with a value, interpolated between its own cells' centres; null where none has.

    A source is a grid (row, col, v), its transform and, where its coordinates are others
    than fine's, a function from fine's x and y to its own; resolutions may differ. A
    transform is (x step, left, y step, top). Every source costs one equality join."""
    sx, left, sy, top = transform
    out, found = fine, []
    for k, (grid, (cx, cleft, cy, ctop), place) in enumerate(sources):
        x, y = left + (F.col("col") + 0.5) * sx, top + (F.col("row") + 0.5) * sy
        x, y = place(x, y) if place else (x, y)
        out = bilinear(out, grid, (y - ctop) / cy - 0.5, (x - cleft) / cx - 0.5, fine.columns, "v", f"_m{k}")
        found.append(f"_m{k}")
    value = F.coalesce(*found) if found else F.lit(None).cast("double")
    return out.withColumn(into, value).drop(*found)


def cells_inside(cells: DataFrame, a: float, b: float, c: float, d: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Cells (row, col) whose four corners, at (a * col + b, c * row + d), lie in a box."""
    corners = F.array(*(F.struct((a * (F.col("col") + j) + b).alias("x"), (c * (F.col("row") + i) + d).alias("y")) for i in (0, 1) for j in (0, 1)))
    return cells.filter(F.forall(corners, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)))


def convert_datum(df: DataFrame, source: DataFrame, target: DataFrame, row: Column, col: Column, keys: list[str], h: str = "h") -> DataFrame:
    """Heights moved by the difference of two geoid grids, interpolated at (row, col). A
    finite height whose shift is unknown is refused, never passed through."""
    shift = source.join(target.select("row", "col", F.col("v").alias("_t")), ["row", "col"]).select("row", "col", (F.col("v") - F.col("_t")).alias("v"))
    out = bilinear(df, shift, row, col, keys, "v", "_shift")
    bad = F.col(h).isNotNull() & F.col("_shift").isNull()
    return out.withColumn(h, F.when(bad, F.raise_error(F.lit("no geoid grid covers a height")).cast("double")).otherwise(F.col(h) + F.col("_shift"))).drop("_shift")


def require_grids(wanted: DataFrame, present: DataFrame, key: str = "grid") -> DataFrame:
    """wanted, or an error that names a grid that is not there: a datum step without its
    grid would silently do nothing."""
    known = present.select(key).distinct().withColumn("_ok", F.lit(True))
    out = wanted.join(known, key, "left")
    return out.filter(F.when(F.col("_ok").isNull(), F.raise_error(F.concat(F.lit("missing geoid grid: "), F.col(key))).cast("boolean")).otherwise(True)).drop("_ok")


def ring_area(ring: Column) -> Column:
    """Area of a closed ring (array of x, y) by the shoelace formula."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)) / 2


def rasterize(polygons: DataFrame, min_area: float = 1e-6) -> DataFrame:
    """(row, col, id) of pixels whose centres lie in a polygon (id, ring of x, y in pixel
    units): a pixel row's crossings decide, later ids win. Work is a row a pixel row and
    edge, then a row a pixel; there is no join with the image."""
    big = polygons.filter(ring_area(F.col("ring")) >= min_area)
    n = F.size("ring")
    e = big.select("id", F.explode(F.zip_with(F.slice("ring", 1, n - 1), F.slice("ring", 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    lo, hi = F.least("e.p.y", "e.q.y"), F.greatest("e.p.y", "e.q.y")
    first, last = F.ceil(lo - 0.5).cast("long"), (F.ceil(hi - 0.5) - 1).cast("long")
    rows = e.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = F.col("row") + 0.5
    x = F.col("e.p.x") + (y - F.col("e.p.y")) * (F.col("e.q.x") - F.col("e.p.x")) / (F.col("e.q.y") - F.col("e.p.y"))
    spans = rows.groupBy("id", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    two = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.element_at("xs", 2 * k + 1).alias("a"), F.element_at("xs", 2 * k + 2).alias("b")))
    s = spans.filter(F.size("xs") >= 2).select("id", "row", F.explode(two).alias("s"))
    a, b = F.ceil(F.col("s.a") - 0.5).cast("long"), (F.ceil(F.col("s.b") - 0.5) - 1).cast("long")
    px = s.filter(a <= b).select("id", "row", F.explode(F.sequence(a, b)).alias("col"))
    return px.groupBy("row", "col").agg(F.max("id").alias("id"))


def _eroded(surface: DataFrame, footprints: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """(id, row, col) of footprint pixels whose neighbours in the image, by a kernel of
    offsets, are all of the same building."""
    offsets = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in kernel))
    own, at = footprints.select("id", "row", "col"), F.col("k")
    back = own.withColumn("k", F.explode(offsets)).select("id", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") + at["i"]).alias("row"), (F.col("col") + at["j"]).alias("col"))
    foreign = back.join(surface.select("row", "col"), ["row", "col"]).join(own, ["id", "row", "col"], "left_anti")
    return own.join(foreign.select("id", F.col("r").alias("row"), F.col("c").alias("col")).distinct(), ["id", "row", "col"], "left_anti")


def heights_over_terrain(surface: DataFrame, terrain: DataFrame, footprints: DataFrame, kernel: list[tuple[int, int]], least: int = 5) -> DataFrame:
    """(id, height, roof_px, terrain_px): median surface of the eroded footprint minus median
    terrain under the whole of it, both over valid pixels; buildings with fewer than
    `least` of either are left out. surface and terrain: row, col, v."""
    middle = lambda px, raster, name: px.join(raster.filter("v IS NOT NULL").select("row", "col", "v"), ["row", "col"]).groupBy("id").agg(F.median("v").alias(name), F.count("*").alias(f"{name}_px"))
    both = middle(_eroded(surface, footprints, kernel), surface, "roof").join(middle(footprints.select("id", "row", "col"), terrain, "terrain"), "id")
    enough = (F.col("roof_px") >= least) & (F.col("terrain_px") >= least)
    return both.filter(enough).select("id", (F.col("roof") - F.col("terrain")).alias("height"), "roof_px", "terrain_px")


def building_heights(surface: DataFrame, footprints: DataFrame, roof: list[tuple[int, int]], ring: list[tuple[int, int]], least: int = 5) -> DataFrame:
    """(id, height, roof_px, ring_px): median of the eroded roof minus median of the ring
    around it outside any building; buildings with fewer pixels than `least` are left out.

    surface: row, col, v; footprints: row, col, id > 0. Offsets are exploded for footprint
    pixels only."""
    own = footprints.select("id", "row", "col")
    offsets = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ring))
    moved = own.withColumn("k", F.explode(offsets)).select("id", (F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col"))
    interior = _eroded(surface, footprints, roof)
    around = moved.distinct().join(own.select("row", "col"), ["row", "col"], "left_anti")
    v = surface.filter("v IS NOT NULL")
    top = interior.join(v, ["row", "col"]).groupBy("id").agg(F.median("v").alias("roof"), F.count("*").alias("roof_px"))
    low = around.join(v, ["row", "col"]).groupBy("id").agg(F.median("v").alias("ground"), F.count("*").alias("ring_px"))
    return top.join(low, "id").filter((F.col("roof_px") >= least) & (F.col("ring_px") >= least)).select("id", (F.col("roof") - F.col("ground")).alias("height"), "roof_px", "ring_px")
