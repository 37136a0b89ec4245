"""Joins and regridding, datums, polygons, buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import records as N
from terraloom.operators import regrid as J
from terraloom.operators import terrain as T
from terraloom.plans.base import G, Registry, S, extent, grid, pairs, q6, r6
from terraloom.sources import osm
from terraloom.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col

#: Coarse raster: 8 x 8 block means, without those of a slanted pattern.
K = G + """, k AS (SELECT CAST(floor("row" / 8.0) AS BIGINT) AS r, CAST(floor(col / 8.0) AS BIGINT) AS c, avg(v) AS m FROM g GROUP BY 1, 2 HAVING CAST(floor(min("row") / 8.0) + floor(min(col) / 8.0) AS BIGINT) % 5 <> 0)"""


def coarse(spark, sf_dir):
    b = grid(spark, sf_dir).groupBy(F.floor(C("row") / 8).alias("row"), F.floor(C("col") / 8).alias("col")).agg(F.avg("v").alias("v"))
    return b.filter((C("row") + C("col")) % 5 != 0)


@query("jn1_aligned_join", f'WITH {G} SELECT a."row" AS "row", a.col AS col, a.v - b.v * 0.5 AS d FROM g a JOIN g b USING ("row", col) WHERE a.label < 3'.replace('a."row" AS "row", a.col AS col', '"row", col'))
def jn1(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.filter("label < 3").join(g.select("row", "col", C("v").alias("w")), ["row", "col"]).select("row", "col", (C("v") - C("w") * 0.5).alias("d"))


@query("jn2_nearest_regrid", f'WITH {K} SELECT "row", col, {q6("m")} AS ref FROM g LEFT JOIN k ON r = CAST(floor("row" / 8.0) AS BIGINT) AND c = CAST(floor(col / 8.0) AS BIGINT)')
def jn2(spark, sf_dir):
    x = J.nearest(grid(spark, sf_dir), coarse(spark, sf_dir), F.floor(C("row") / 8), F.floor(C("col") / 8))
    return x.select("row", "col", r6("ref").alias("ref"))


_BI = f"""WITH {K}, p AS (SELECT "row", col, ("row" + 0.5e0) / 8 - 0.5e0 AS fr, (col + 0.5e0) / 8 - 0.5e0 AS fc FROM g),
q AS (SELECT "row", col, floor(fr) + i AS r, floor(fc) + j AS c, (CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END) * (CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END) AS w FROM p, range(2) a(i), range(2) b(j))
SELECT q."row" AS "row", q.col AS col, {q6('sum(w * m) / sum(w) FILTER (WHERE m IS NOT NULL)')} AS ref FROM q LEFT JOIN k USING (r, c) GROUP BY 1, 2"""


@query("jn3_bilinear_regrid", _BI)
def jn3(spark, sf_dir):
    x = J.bilinear(grid(spark, sf_dir), coarse(spark, sf_dir), (C("row") + 0.5) / 8 - 0.5, (C("col") + 0.5) / 8 - 0.5, ["row", "col"])
    return x.select("row", "col", r6("ref").alias("ref"))


@query("ag35_compare_reference", f"""WITH b AS ({_BI}), {G}, d AS (SELECT v - ref AS e, ref FROM g JOIN b USING ("row", col)) SELECT count(e) AS n, {q6('sqrt(avg(e * e))', 4)} AS rmse, {q6('quantile_cont(abs(e), 0.98)', 4)} AS colour_limit, {q6('avg(CAST(ref IS NOT NULL AS INTEGER))')} AS coverage, 'MATCH' AS datum FROM d""")
def ag35(spark, sf_dir):
    from terraloom.functions.scalars import datum_check

    x = J.bilinear(grid(spark, sf_dir), coarse(spark, sf_dir), (C("row") + 0.5) / 8 - 0.5, (C("col") + 0.5) / 8 - 0.5, ["row", "col"])
    e = C("v") - C("ref")
    return x.agg(F.count(e).alias("n"), r6(F.sqrt(F.avg(e * e)), 4).alias("rmse"), r6(F.percentile(F.abs(e), F.lit(0.98)), 4).alias("colour_limit"), r6(F.avg(C("ref").isNotNull().cast("int"))).alias("coverage")).withColumn("datum", datum_check(F.lit("EGM2008"), F.lit("EGM2008 (converted)")))


def _interpolated(cells: str, size: int) -> str:
    """Text of the bilinear value at each pixel of cells (r, c, m) of size x size pixels."""
    weight = "(CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END) * (CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END)"
    return f"""SELECT "row", col, sum(w * m) / sum(w) FILTER (WHERE m IS NOT NULL) AS v FROM (SELECT "row", col, floor(fr) + i AS r, floor(fc) + j AS c, {weight} AS w
FROM (SELECT "row", col, ("row" + 0.5e0) / {size} - 0.5e0 AS fr, (col + 0.5e0) / {size} - 0.5e0 AS fc FROM g), range(2) a(i), range(2) b(j)) LEFT JOIN {cells} USING (r, c) GROUP BY 1, 2"""


@query("sc3_mosaic_on_grid", f"""WITH {G}, ka AS (SELECT CAST(floor("row" / 8.0) AS BIGINT) AS r, CAST(floor(col / 8.0) AS BIGINT) AS c, avg(v) AS m FROM g GROUP BY 1, 2 HAVING CAST(floor(min("row") / 8.0) AS BIGINT) % 6 < 3),
kb AS (SELECT CAST(floor("row" / 20.0) AS BIGINT) AS r, CAST(floor(col / 20.0) AS BIGINT) AS c, avg(v) AS m FROM g GROUP BY 1, 2), a AS ({_interpolated('ka', 8)}), b AS ({_interpolated('kb', 20)})
SELECT "row", col, {q6('coalesce(a.v, b.v)')} AS ref FROM a JOIN b USING ("row", col)""")
def mosaic(spark, sf_dir):
    """A fine source with bands missing over a coarse one that has its axes the other way
    round, on the raster's grid of 2 m pixels."""
    g = grid(spark, sf_dir)
    blocks = lambda n: g.groupBy(F.floor(C("row") / n).alias("row"), F.floor(C("col") / n).alias("col")).agg(F.avg("v").alias("v"))
    first = blocks(8).filter("row % 6 < 3")
    second = blocks(20).select(C("col").alias("row"), C("row").alias("col"), "v")
    turned = lambda x, y: (1000.0 - y, x)
    x = J.on_grid(g.select("row", "col"), (2.0, 500.0, -2.0, 1000.0), [(first, (16.0, 500.0, -16.0, 1000.0), None), (second, (40.0, 0.0, 40.0, 500.0), turned)])
    return x.select("row", "col", r6("ref").alias("ref"))


@query("rs1_bilinear_resize", f"""WITH {K}, p AS (SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, (y + 0.5e0) * 62 / 40 - 0.5e0 AS fr, (x + 0.5e0) * 8 / 20 - 0.5e0 AS fc FROM range(40) a(y), range(20) b(x)),
q AS (SELECT y, x, floor(fr) + i AS r, floor(fc) + j AS c, (CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END) * (CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END) AS w FROM p, range(2) a(i), range(2) b(j))
SELECT y AS "row", x AS col, {q6('sum(w * m) / sum(w) FILTER (WHERE m IS NOT NULL)')} AS v FROM q LEFT JOIN k USING (r, c) GROUP BY 1, 2""")
def rs1(spark, sf_dir):
    h, w = grid(spark, sf_dir).agg(F.max("row") + 1, F.max("col") + 1).first()
    t = spark.range(800).select(F.floor(C("id") / 20).alias("row"), (C("id") % 20).alias("col"))
    x = J.bilinear(t, coarse(spark, sf_dir), (C("row") + 0.5) * (h // 8) / 40 - 0.5, (C("col") + 0.5) * (w // 8) / 20 - 0.5, ["row", "col"], "v", "out")
    return x.select("row", "col", r6("out").alias("v"))


@query("rs2_lattice_interpolation", f"""WITH {G}, l AS (SELECT "row" // 10 AS r, col // 10 AS c, v AS m FROM g WHERE "row" % 10 = 0 AND col % 10 = 0), n AS (SELECT max(r) AS h, max(c) AS w FROM l),
p AS (SELECT "row", col, least("row" // 10, h - 1) AS r0, least(col // 10, w - 1) AS c0, "row" / 10.0 AS fr, col / 10.0 AS fc FROM g, n), q AS (SELECT "row", col, r0 + i AS r, c0 + j AS c, (CASE i WHEN 1 THEN fr - r0 ELSE 1 - fr + r0 END) * (CASE j WHEN 1 THEN fc - c0 ELSE 1 - fc + c0 END) AS w FROM p, range(2) a(i), range(2) b(j))
SELECT q."row" AS "row", q.col AS col, {q6('sum(w * m)', 5)} AS v FROM q JOIN l USING (r, c) GROUP BY 1, 2""")
def rs2(spark, sf_dir):
    g = grid(spark, sf_dir)
    lattice = g.filter("row % 10 = 0 AND col % 10 = 0").select(F.floor(C("row") / 10).alias("row"), F.floor(C("col") / 10).alias("col"), "v")
    n = lattice.agg(F.max("row") + 1, F.max("col") + 1).first()
    x = J.bilinear(g.select("row", "col"), lattice, C("row") / 10, C("col") / 10, ["row", "col"], "v", "out", True, (n[0], n[1]))
    return x.select("row", "col", r6("out", 5).alias("v"))


@query("rs3_nearest_mask", f'WITH {G}, m AS (SELECT "row" // 30 AS r, col // 30 AS c, avg(v) > 0 AS low FROM g GROUP BY 1, 2) SELECT "row", col, low FROM g JOIN m ON r = CAST(floor("row" / 30.0) AS BIGINT) AND c = CAST(floor(col / 30.0) AS BIGINT)')
def rs3(spark, sf_dir):
    g = grid(spark, sf_dir)
    m = g.groupBy(F.floor(C("row") / 30).alias("row"), F.floor(C("col") / 30).alias("col")).agg((F.avg("v") > 0).alias("v"))
    return J.nearest(g.select("row", "col"), m, F.floor(C("row") / 30), F.floor(C("col") / 30), "v", "low").select("row", "col", "low")


@query("jn5_cells_inside", f"WITH {K} SELECT r AS \"row\", c AS col FROM k WHERE c * 8.0 + 1 >= 5 AND (c + 1) * 8.0 + 1 <= 60 AND 500 - r * 8.0 <= 470 AND 500 - (r + 1) * 8.0 >= 33")
def jn5(spark, sf_dir):
    return J.cells_inside(coarse(spark, sf_dir).select("row", "col"), 8.0, 1.0, -8.0, 500.0, 5.0, 33.0, 60.0, 470.0)


XML = """<osm><bounds minlon="7" minlat="50" maxlon="8" maxlat="51"/><node id="101" lon="7.25" lat="50.5"/><node id="102" lon="7.75" lat="50.5"/><node id="103" lon="7.75" lat="50.75"/><node id="104" lon="7.5" lat="50.75"/><node id="105" lon="7.25" lat="50.625"/>
<way id="31"><nd ref="101"/><nd ref="102"/><nd ref="103"/><nd ref="104"/><nd ref="105"/><nd ref="101"/><tag k="building" v="barn"/><tag k="height" v="6.5"/></way>
<way id="32"><nd ref="102"/><nd ref="103"/><nd ref="105"/><tag k="building" v="shed"/></way><way id="33"><nd ref="101"/><nd ref="104"/><nd ref="777"/><nd ref="101"/><tag k="building" v="garage"/></way>
<way id="34"><nd ref="104"/><nd ref="105"/><tag k="waterway" v="ditch"/></way><relation id="41"><tag k="building" v="church"/></relation></osm>"""


def _xml(spark):
    return spark.createDataFrame([(XML,)], "xml string")


@query("sc12_osm_buildings", "SELECT CAST(31 AS BIGINT) AS id, 'barn' AS building, '6.5' AS height_tag, 6 AS points, 0.109375::DOUBLE AS area")
def sc12(spark, sf_dir):
    b, _ = osm.buildings(_xml(spark))
    ring = F.transform("coords", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return b.select("id", "building", "height_tag", F.size("coords").alias("points"), J.ring_area(ring).alias("area"))


@query("jn9_node_way_counts", "SELECT CAST(1 AS BIGINT) AS ways, CAST(2 AS BIGINT) AS skipped_open_or_incomplete, CAST(1 AS BIGINT) AS skipped_relations")
def jn9(spark, sf_dir):
    return osm.buildings(_xml(spark))[1]


@query("jn9_unknown_references", "SELECT CAST(33 AS BIGINT) AS id, '777' AS ref")
def jn9u(spark, sf_dir):
    w = osm.building_ways(_xml(spark)).select("id", F.explode("refs").alias("ref"))
    return w.join(osm.nodes(_xml(spark)), "ref", "left_anti").select("id", "ref")


@query("ag38_polygon_area", "SELECT c_custkey AS id, (c_custkey % 7 + 1) * (c_custkey % 5 + 2) / 2.0::DOUBLE AS area FROM customer WHERE (c_custkey % 7 + 1) * (c_custkey % 5 + 2) / 2.0 >= 4")
def ag38(spark, sf_dir):
    a, b = (C("c_custkey") % 7 + 1).cast("double"), (C("c_custkey") % 5 + 2).cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    t = table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), F.array(p(z, z), p(a, z), p(z, b), p(z, z)).alias("ring"))
    return t.select("id", J.ring_area(C("ring")).alias("area")).filter("area >= 4")


@query("po1_rasterize", """WITH t(id, x0, y0, a) AS (VALUES (1, 2.0e0, 3.0e0, 11.0e0), (2, 8.0e0, 6.0e0, 9.0e0), (3, 30.0e0, 1.0e0, 14.0e0)), p AS (SELECT id, y, x FROM t, range(40) b(y), range(60) c(x) WHERE x + 0.5 - x0 >= 0 AND y + 0.5 - y0 > 0 AND (x + 0.5 - x0) + (y + 0.5 - y0) < a)
SELECT CAST(y AS BIGINT) AS "row", CAST(x AS BIGINT) AS col, max(id) AS id FROM p GROUP BY 1, 2""")
def po1(spark, sf_dir):
    t = spark.createDataFrame([(1, 2.0, 3.0, 11.0), (2, 8.0, 6.0, 9.0), (3, 30.0, 1.0, 14.0)], "id int, x double, y double, a double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, a = C("x"), C("y"), C("a")
    return J.rasterize(t.select("id", F.array(p(x, y), p(x + a, y), p(x, y + a), p(x, y)).alias("ring")))


def lattice(spark, g, step=8):
    """Lattice points (row, col) every `step` pixels around all pixels of g."""
    h, w = (int(n) // step + 2 for n in g.agg(F.max("row"), F.max("col")).first())
    return spark.range(h * w).select(F.floor(C("id") / w).alias("row"), (C("id") % w).alias("col"))


@query("dt1_datum_conversion", f"""WITH {G}, s AS (SELECT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c, i * 0.5e0 + j * 0.25e0 - (i * 0.1e0 - j * 0.3e0) AS m FROM range(64) a(i), range(9) b(j)) SELECT "row", col, {q6('v + ("row" / 8.0) * 0.4 + (col / 8.0) * 0.55', 5)} AS h FROM g""")
def dt1(spark, sf_dir):
    lat = lattice(spark, grid(spark, sf_dir))
    a = lat.withColumn("v", C("row") * 0.5 + C("col") * 0.25)
    b = lat.withColumn("v", C("row") * 0.1 - C("col") * 0.3)
    x = J.convert_datum(grid(spark, sf_dir).select("row", "col", C("v").alias("h")), a, b, C("row") / 8, C("col") / 8, ["row", "col"])
    return x.select("row", "col", r6("h", 5).alias("h"))


@query("dt2_required_grids", "SELECT * FROM (VALUES ('egm08'), ('egm96')) AS x(grid)")
def dt2(spark, sf_dir):
    return J.require_grids(spark.createDataFrame([("egm08",), ("egm96",)], "grid string"), spark.createDataFrame([("egm96",), ("egm08",), ("navd",)], "grid string"))


@query("dt3_offset_lattice_error", f"""WITH {G}, f AS (SELECT "row", col, sin("row" / 40.0) + cos(col / 40.0) AS t FROM g), p AS (SELECT "row", col, t, least("row" // 16, h - 1) AS r0, least(col // 16, w - 1) AS c0 FROM f, (SELECT max("row") // 16 AS h, max(col) // 16 AS w FROM g)),
q AS (SELECT "row", col, t, (sin((r0 * 16) / 40.0) * (1 - "row" / 16.0 + r0) + sin((r0 + 1) * 16 / 40.0) * ("row" / 16.0 - r0)) + (cos(c0 * 16 / 40.0) * (1 - col / 16.0 + c0) + cos((c0 + 1) * 16 / 40.0) * (col / 16.0 - c0)) AS a FROM p) SELECT {q6('max(abs(a - t))', 5)} AS worst FROM q""")
def dt3(spark, sf_dir):
    f = grid(spark, sf_dir).select("row", "col", (F.sin(C("row") / 40) + F.cos(C("col") / 40)).alias("t"))
    h, w = extent(f)
    lattice = f.filter("row % 16 = 0 AND col % 16 = 0").select(F.floor(C("row") / 16).alias("row"), F.floor(C("col") / 16).alias("col"), C("t").alias("v"))
    x = J.bilinear(f, lattice, C("row") / 16, C("col") / 16, ["row", "col"], "v", "a", True, ((h - 1) // 16 + 1, (w - 1) // 16 + 1))
    return x.agg(r6(F.max(F.abs(C("a") - C("t"))), 5).alias("worst"))


def footprints(spark, sf_dir):
    g = grid(spark, sf_dir)
    inside = (C("row") % 25).between(5, 14) & (C("col") % 32).between(8, 20)
    return g.filter(inside).select("row", "col", (F.floor(C("row") / 25) * 2 + F.floor(C("col") / 32) + 1).alias("id"))


_FP = """fp AS (SELECT "row", col, "row" // 25 * 2 + col // 32 + 1 AS id FROM g WHERE "row" % 25 BETWEEN 5 AND 14 AND col % 32 BETWEEN 8 AND 20)"""
_OFF = lambda r: ", ".join(f"({i}, {j})" for i, j in T.ellipse(r))


@query("ag22_building_heights", f"""WITH {G}, {_FP}, k2(i, j) AS (VALUES {_OFF(2)}), k4(i, j) AS (VALUES {_OFF(4)}),
bad AS (SELECT DISTINCT a.id, a."row", a.col FROM fp a, k2 JOIN g ON g."row" = a."row" + i AND g.col = a.col + j LEFT JOIN fp b ON b."row" = g."row" AND b.col = g.col AND b.id = a.id WHERE b.id IS NULL),
roof AS (SELECT id, median(v) AS m, count(*) AS n FROM fp JOIN g USING ("row", col) ANTI JOIN bad USING (id, "row", col) GROUP BY id),
rg AS (SELECT DISTINCT a.id, a."row" + i AS "row", a.col + j AS col FROM fp a, k4), low AS (SELECT rg.id, median(v) AS m, count(*) AS n FROM rg JOIN g USING ("row", col) ANTI JOIN fp USING ("row", col) GROUP BY rg.id)
SELECT roof.id AS id, {q6('roof.m - low.m')} AS height, roof.n AS roof_px, low.n AS ring_px FROM roof JOIN low USING (id) WHERE roof.n >= 5 AND low.n >= 5""")
def ag22(spark, sf_dir):
    h = J.building_heights(grid(spark, sf_dir), footprints(spark, sf_dir), T.ellipse(2), T.ellipse(4))
    return h.select("id", r6("height").alias("height"), "roof_px", "ring_px")


_CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


@query("ag23_lidar_heights", f"""WITH {G}, {_FP}, k(i, j) AS (VALUES {", ".join(map(str, _CROSS))}), dt AS (SELECT "row", col, v * 0.25 - 1 AS t FROM g WHERE label <> 4),
bad AS (SELECT DISTINCT a.id, a."row", a.col FROM fp a, k JOIN g ON g."row" = a."row" + i AND g.col = a.col + j LEFT JOIN fp b ON b."row" = g."row" AND b.col = g.col AND b.id = a.id WHERE b.id IS NULL),
roof AS (SELECT id, median(v) AS m, count(*) AS n FROM fp JOIN g USING ("row", col) ANTI JOIN bad USING (id, "row", col) GROUP BY id), ter AS (SELECT id, median(t) AS m, count(*) AS n FROM fp JOIN dt USING ("row", col) GROUP BY id)
SELECT roof.id AS id, {q6('roof.m - ter.m')} AS height, roof.n AS roof_px, ter.n AS terrain_px FROM roof JOIN ter USING (id) WHERE roof.n >= 5 AND ter.n >= 5""")
def ag23(spark, sf_dir):
    """Heights over a terrain raster with nodata, as measured by laser."""
    g = grid(spark, sf_dir)
    terrain = g.filter("label <> 4").select("row", "col", (C("v") * 0.25 - 1).alias("v"))
    h = J.heights_over_terrain(g, terrain, footprints(spark, sf_dir), _CROSS)
    return h.select("id", r6("height").alias("height"), "roof_px", "terrain_px")


@query("ag25_centroid_blocks", f"WITH {G}, {_FP} SELECT id, (CAST(trunc(avg(\"row\")) AS BIGINT) // 50 + CAST(trunc(avg(col)) AS BIGINT) // 20) % 2 = 0 AS fit FROM fp GROUP BY id")
def ag25(spark, sf_dir):
    return N.centroid_fit(footprints(spark, sf_dir), 50, 20)


@query("ag26_majority_level", f"WITH {G}, {_FP} SELECT id, avg(CAST(v < 0 AS INTEGER)) > 0.5 AS low FROM fp JOIN g USING (\"row\", col) GROUP BY id")
def ag26(spark, sf_dir):
    return N.majority(footprints(spark, sf_dir), grid(spark, sf_dir), C("v") < 0, "low")


@query("ag27_ratio_calibration", f"WITH {S} SELECT p_brand, {q6('median(q / p)')} AS k, {q6('quantile_cont(q / p, 0.75) - quantile_cont(q / p, 0.25)')} AS iqr FROM s GROUP BY p_brand HAVING count(*) >= 5")
def ag27(spark, sf_dir):
    x = N.ratio_fit(pairs(spark, sf_dir), "p_brand", "p", "q")
    return x.select("p_brand", r6("k").alias("k"), r6("iqr").alias("iqr"))


@query("jn10_estimates_truth_held", "SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment = 'BUILDING' AS held FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def jn10(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    x = N.evaluation_set(o, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", C("c_mktsegment") == "BUILDING")
    return x.select("o_orderkey", "o_totalprice", "c_acctbal", "held")


@query("jn12_overlap_refusal", f'WITH {G} SELECT count(*) AS shared FROM (SELECT "row", col FROM g WHERE ("row" // 5 + col // 5) % 2 = 0) a SEMI JOIN (SELECT "row", col FROM g WHERE ("row" // 5 + col // 5) % 2 <> 0) b USING ("row", col)')
def jn12(spark, sf_dir):
    from terraloom.functions.scalars import checkerboard

    g = grid(spark, sf_dir)
    fit = checkerboard(C("row"), C("col"), 5)
    N.refuse_overlap(g.filter(fit), g.filter(~fit), ["row", "col"])
    return N.shared_keys(g.filter(fit), g.filter(~fit), ["row", "col"])


@query("jn13_new_neighbour_tiles", "WITH t AS (SELECT DISTINCT s_nationkey AS a, s_suppkey % 7 AS b FROM supplier), n AS (SELECT DISTINCT a + i AS a, b + j AS b FROM t, range(-1, 2) x(i), range(-1, 2) y(j)) SELECT a, b FROM n ANTI JOIN t USING (a, b)")
def jn13(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(C("s_nationkey").cast("long").alias("a"), (C("s_suppkey") % 7).alias("b")).distinct()
    step = F.sequence(F.lit(-1), F.lit(1))
    n = t.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).select((C("a") + C("i")).alias("a"), (C("b") + C("j")).alias("b")).distinct()
    return n.join(t, ["a", "b"], "left_anti")


@query("jn17_lookup", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def jn17(spark, sf_dir):
    p = N.lookup(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["O", "F"])
    return p.select("l_returnflag", C("O").alias("o"), C("F").alias("f"))


@query("jn18_evidence_lookup", "SELECT o_orderkey, x.error FROM orders LEFT JOIN (VALUES ('F', 4.7e0), ('O', 4.4e0)) AS x(level, error) ON o_orderstatus = level")
def jn18(spark, sf_dir):
    e = spark.createDataFrame([("F", 4.7), ("O", 4.4)], "o_orderstatus string, error double")
    return N.with_evidence(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), e, "o_orderstatus").select("o_orderkey", "error")


@query("jn19_incomplete_triples", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn19(spark, sf_dir):
    """Orders without a line, or without a returned one."""
    li = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return N.incomplete(table(spark, sf_dir, "orders"), [li, li.filter("l_returnflag = 'R'")], "o_orderkey")


@query("jn20_optional_layer", f"""WITH {G} SELECT "row", col, CASE WHEN label <> 2 THEN CAST(label * 10 AS INTEGER) END AS landcover, CASE WHEN label = 2 THEN 'no landcover' END AS note, CAST(NULL AS INTEGER) AS water, 'no water' AS water_note FROM g""")
def jn20(spark, sf_dir):
    """One layer that has pixels for most of the raster, and one that is not there."""
    g = grid(spark, sf_dir)
    layer = g.filter("label <> 2").select("row", "col", (C("label") * 10).alias("v"))
    x = N.optional_layer(g.select("row", "col"), layer, "landcover", "int").withColumnRenamed("note", "land_note")
    x = N.optional_layer(x, None, "water", "int")
    return x.select("row", "col", "landcover", C("land_note").alias("note"), "water", C("note").alias("water_note"))


_FACTORS = "r AS (SELECT DISTINCT l_returnflag AS f FROM lineitem), b AS (SELECT DISTINCT p_brand FROM part), m(method) AS (VALUES ('a'), ('b'))"


@query("jn21_factor_grid", f"WITH {_FACTORS} SELECT f, p_brand, method FROM r, b, m")
def jn21(spark, sf_dir):
    return _factors(spark, sf_dir)


def _factors(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("f"))
    brands = table(spark, sf_dir, "part").select("p_brand")
    return N.factor_grid(flags, brands, spark.createDataFrame([("a",), ("b",)], "method string"))


@query("jn22_not_evaluated_kept", f"WITH {_FACTORS}, {S}, s2 AS (SELECT l_returnflag AS f, p_brand, 'a' AS method, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 800) SELECT f, p_brand, method, n, n IS NOT NULL AS evaluated FROM r CROSS JOIN b CROSS JOIN m LEFT JOIN s2 USING (f, p_brand, method)")
def jn22(spark, sf_dir):
    res = pairs(spark, sf_dir).groupBy(C("l_returnflag").alias("f"), "p_brand").agg(F.count("*").alias("n")).filter("n > 800").withColumn("method", F.lit("a"))
    return N.with_results(_factors(spark, sf_dir), res, ["f", "p_brand", "method"], "n")


@query("baseline_as_of_join", "SELECT a.event_id, (SELECT arg_max(b.value, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts) AS last_purchase FROM events a WHERE a.event_type = 'click'")
def as_of(spark, sf_dir):
    from terraloom.operators.relational import as_of as join

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", C("value").alias("last_purchase"))
    return join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("baseline_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("baseline_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
