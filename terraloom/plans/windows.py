"""Block and cell aggregation, neighbourhood windows, morphology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraloom.operators import terrain as T
from terraloom.plans.base import G, Registry, grid, q6, r6
from terraloom.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col

#: The raster with holes: every eleventh pixel of a slanted pattern is nodata.
H = G + """, z AS (SELECT "row", col, CASE WHEN ("row" * 7 + col * 3) % 11 <> 0 THEN v END AS v, label FROM g), n AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM g)"""


def holes(spark, sf_dir):
    return grid(spark, sf_dir).withColumn("v", F.when((C("row") * 7 + C("col") * 3) % 11 != 0, C("v")))


def _around(k: int, edge: bool) -> str:
    """Every pixel with its mirrored k x k neighbours: columns r, c, x."""
    h = k // 2
    m = lambda i, n: f"CASE WHEN {i} < 0 THEN -{i} - {int(edge)} WHEN {i} >= {n} THEN 2 * {n} - {2 - int(edge)} - {i} ELSE {i} END"
    return f"""o AS (SELECT z."row" AS r, z.col AS c, {m('(z."row" + a.i)', 'n.h')} AS rr, {m('(z.col + b.j)', 'n.w')} AS cc FROM z, n, range(-{h}, {h + 1}) a(i), range(-{h}, {h + 1}) b(j)),
nb AS (SELECT o.r, o.c, z.v AS x FROM o JOIN z ON z."row" = o.rr AND z.col = o.cc)"""


@query("ag5_cell_mean", f"""WITH {H}, k AS (SELECT *, CASE WHEN label = 9 THEN -1 ELSE CAST(floor("row" / 8.0) * 8 + floor(col / 8.0) AS BIGINT) END AS cell FROM z), m AS (SELECT cell, avg(v) AS m FROM k WHERE cell >= 0 GROUP BY cell)
SELECT "row", col, {q6('m')} AS mean, {q6('v - m')} AS high FROM k LEFT JOIN m USING (cell)""")
def ag5(spark, sf_dir):
    cell = F.when(C("label") == 9, -1).otherwise(F.floor(C("row") / 8) * 8 + F.floor(C("col") / 8))
    x = T.cell_mean(holes(spark, sf_dir).withColumn("cell", cell.cast("long")))
    return x.select("row", "col", r6("mean").alias("mean"), r6(C("v") - C("mean")).alias("high"))


@query("ag6_block_mean", f'WITH {H} SELECT CAST(floor("row" / 7.0) AS BIGINT) AS "row", CAST(floor(col / 7.0) AS BIGINT) AS col, {q6("avg(v)")} AS v, CAST(round_even(avg(v) * 100, 0) AS BIGINT) AS whole FROM z, n WHERE "row" < floor(h / 7.0) * 7 AND col < floor(w / 7.0) * 7 GROUP BY 1, 2')
def ag6(spark, sf_dir):
    b = T.block_mean(holes(spark, sf_dir), 7)
    return b.select("row", "col", r6("v").alias("v"), F.rint(C("v") * 100).cast("long").alias("whole"))


@query("ag7_decimate", f'WITH {H}, f AS (SELECT CAST(ceil(greatest(h, w) / 100.0) AS BIGINT) AS f FROM n) SELECT CAST(floor("row" / f) AS BIGINT) AS "row", CAST(floor(col / f) AS BIGINT) AS col, {q6("avg(v)")} AS v FROM z, n, f WHERE "row" < floor(h / f) * f AND col < floor(w / f) * f GROUP BY 1, 2')
def ag7(spark, sf_dir):
    d = T.with_size(holes(spark, sf_dir)).withColumn("f", F.ceil(F.greatest("_h", "_w") / 100.0))
    inside = d.filter((C("row") < F.floor(C("_h") / C("f")) * C("f")) & (C("col") < F.floor(C("_w") / C("f")) * C("f")))
    return inside.groupBy(F.floor(C("row") / C("f")).alias("row"), F.floor(C("col") / C("f")).alias("col")).agg(r6(F.avg("v")).alias("v"))


@query("wn1_lowpass", f"WITH {H}, {_around(5, True)} SELECT r AS \"row\", c AS col, {q6('CASE WHEN count(x) > 12.5 THEN sum(x) / count(x) END')} AS low FROM nb GROUP BY r, c")
def wn1(spark, sf_dir):
    return T.lowpass(holes(spark, sf_dir), 4).select("row", "col", r6("low").alias("low"))


@query("wn2_highpass", f"WITH {H}, {_around(3, True)}, l AS (SELECT r, c, CASE WHEN count(x) > 4.5 THEN sum(x) / count(x) END AS low FROM nb GROUP BY r, c) SELECT \"row\", col, {q6('v - low')} AS high FROM z JOIN l ON r = \"row\" AND c = col")
def wn2(spark, sf_dir):
    return T.lowpass(holes(spark, sf_dir), 3).select("row", "col", r6(C("v") - C("low")).alias("high"))


_GRAD = """d AS (SELECT "row", col, v, CASE WHEN col = 0 THEN (lead(v) OVER c - v) / 0.5 WHEN col = w - 1 THEN (v - lag(v) OVER c) / 0.5 ELSE (lead(v) OVER c - lag(v) OVER c) / 1.0 END AS gx,
CASE WHEN "row" = 0 THEN (lead(v) OVER r - v) / 0.25 WHEN "row" = h - 1 THEN (v - lag(v) OVER r) / 0.25 ELSE (lead(v) OVER r - lag(v) OVER r) / 0.5 END AS gy FROM z, n WINDOW c AS (PARTITION BY "row" ORDER BY col), r AS (PARTITION BY col ORDER BY "row"))"""


@query("wn3_slope", f"WITH {H}, {_GRAD} SELECT \"row\", col, {q6('degrees(atan(sqrt(gx * gx + gy * gy)))')} AS slope FROM d")
def wn3(spark, sf_dir):
    return T.slope(holes(spark, sf_dir), (0.5, 0.25)).select("row", "col", r6("slope").alias("slope"))


@query("pf32_hillshade", f"WITH {H}, {_GRAD} SELECT \"row\", col, {q6('CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN least(greatest(sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-gx, gy)), 0), 1) END')} AS shade FROM d")
def pf32(spark, sf_dir):
    return T.hillshade(holes(spark, sf_dir), (0.5, 0.25)).select("row", "col", r6("shade").alias("shade"))


@query("wn4_roughness", f"WITH {G}, n AS (SELECT max(\"row\") + 1 AS h, max(col) + 1 AS w FROM g), z0 AS (SELECT \"row\", col, CASE WHEN (\"row\" * 7 + col * 3) % 11 <> 0 THEN v END AS v FROM g), z AS (SELECT \"row\", col, coalesce(v, (SELECT avg(v) FROM z0)) AS v FROM z0), {_around(3, False)} SELECT r AS \"row\", c AS col, {q6('sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0))', 5)} AS rough FROM nb GROUP BY r, c")
def wn4(spark, sf_dir):
    return T.roughness(holes(spark, sf_dir), 3).select("row", "col", r6("roughness", 5).alias("rough"))


@query("wn5_uniform_trim", f"WITH {G}, n AS (SELECT max(\"row\") + 1 AS h, max(col) + 1 AS w FROM g), z AS (SELECT * FROM g), {_around(7, True)} SELECT r AS \"row\", c AS col, {q6('avg(x)')} AS low FROM nb, n WHERE r >= 3 AND c >= 3 AND r < h - 3 AND c < w - 3 GROUP BY r, c")
def wn5(spark, sf_dir):
    x = T.with_size(T.lowpass(grid(spark, sf_dir), 7)).filter("row >= 3 AND col >= 3 AND row < _h - 3 AND col < _w - 3")
    return x.select("row", "col", r6("low").alias("low"))


@query("ag11_robust_spread", f"WITH {G}, m AS (SELECT label, median(v) AS m FROM g GROUP BY label) SELECT g.label, {q6('1.4826 * median(abs(v - m))')} AS spread FROM g JOIN m USING (label) GROUP BY g.label")
def ag11(spark, sf_dir):
    from terraloom.operators.errors import error_metrics

    return error_metrics(grid(spark, sf_dir).withColumn("zero", F.lit(0.0)), "v", "zero", ["label"]).select("label", r6("nmad").alias("spread"))


@query("wn7_step_profile", f"WITH {G} SELECT a.\"row\" AS \"row\", {q6('median(b.v - a2.v)')} AS step FROM g a JOIN g b ON b.\"row\" = a.\"row\" + 4 AND b.col = a.col JOIN g a2 ON a2.\"row\" = a.\"row\" - 4 AND a2.col = a.col GROUP BY 1")
def wn7(spark, sf_dir):
    from terraloom.operators.tiles import step_profile

    return step_profile(grid(spark, sf_dir), 4).select("row", r6("step").alias("step"))


@query("wn8_running_median", f"WITH {G}, a AS (SELECT \"row\", avg(v) AS v FROM g GROUP BY 1) SELECT x.\"row\" AS \"row\", {q6('median(y.v)')} AS med FROM a x JOIN a y ON y.\"row\" BETWEEN x.\"row\" - 15 AND x.\"row\" + 15 GROUP BY 1")
def wn8(spark, sf_dir):
    # a profile is one number a row: the whole series is a single ordered frame
    a = grid(spark, sf_dir).groupBy("row").agg(F.avg("v").alias("v")).withColumn("series", F.lit(0))
    w = Window.partitionBy("series").orderBy("row").rangeBetween(-15, 15)
    return a.select("row", r6(F.percentile("v", F.lit(0.5)).over(w)).alias("med"))


@query("wn10_histogram_prefix_sums", f"WITH {G}, b AS (SELECT CAST(floor((v + 1) * 100) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS total FROM b")
def wn10(spark, sf_dir):
    b = grid(spark, sf_dir).groupBy(F.floor((C("v") + 1) * 100).alias("bin")).agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return b.select("bin", "n", F.sum("n").over(Window.partitionBy("all").orderBy("bin")).alias("total"))


@query("mo1_erode_dilate_rect", f"WITH {G}, z AS (SELECT \"row\", col, CAST(v > -0.1 AS INTEGER) AS m FROM g) SELECT a.\"row\" AS \"row\", a.col AS col, min(b.m) = 1 AS eroded, max(b.m) = 1 AS dilated FROM z a JOIN z b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2")
def mo1(spark, sf_dir):
    z = grid(spark, sf_dir).select("row", "col", (C("v") > -0.1).cast("int").alias("m"))
    lo, hi = T.rank_filter(z, 1, False, "m"), T.rank_filter(z, 1, True, "m")
    return lo.join(hi.withColumnRenamed("m", "k"), ["row", "col"]).select("row", "col", (C("m") == 1).alias("eroded"), (C("k") == 1).alias("dilated"))


_E2 = ", ".join(f"({i}, {j})" for i, j in T.ellipse(2))


@query("mo1_erode_dilate_ellipse", f"WITH {G}, z AS (SELECT \"row\", col, CAST(v > -0.1 AS INTEGER) AS m FROM g), k(i, j) AS (VALUES {_E2}) SELECT a.\"row\" AS \"row\", a.col AS col, min(b.m) = 1 AS eroded, max(b.m) = 1 AS dilated FROM z a, k JOIN z b ON b.\"row\" = a.\"row\" + i AND b.col = a.col + j GROUP BY 1, 2")
def mo1e(spark, sf_dir):
    z = grid(spark, sf_dir).select("row", "col", (C("v") > -0.1).alias("mask"))
    lo, hi = T.morph(z, T.ellipse(2), True), T.morph(z, T.ellipse(2), False)
    return lo.withColumnRenamed("mask", "eroded").join(hi.withColumnRenamed("mask", "dilated"), ["row", "col"])


@query("mo2_grey_opening", f"WITH {H}, f AS (SELECT \"row\", col, coalesce(v, (SELECT max(v) FROM z)) AS x, v FROM z), e AS (SELECT a.\"row\" AS r, a.col AS c, min(b.x) AS x FROM f a JOIN f b ON b.\"row\" BETWEEN a.\"row\" - 2 AND a.\"row\" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2), o AS (SELECT a.r, a.c, max(b.x) AS x FROM e a JOIN e b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2) SELECT r AS \"row\", c AS col, {q6('CASE WHEN v IS NOT NULL THEN least(o.x, v) END')} AS ground FROM o JOIN f ON f.\"row\" = r AND f.col = c")
def mo2(spark, sf_dir):
    return T.grey_opening(holes(spark, sf_dir), 5).select("row", "col", r6("ground").alias("ground"))


@query("mo3_binary_opening", f"WITH {G}, z AS (SELECT \"row\", col, CAST(v > -0.05 AS INTEGER) AS m FROM g), e AS (SELECT a.\"row\" AS r, a.col AS c, min(b.m) AS m FROM z a JOIN z b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" AND b.col BETWEEN a.col - 1 AND a.col GROUP BY 1, 2) SELECT a.r AS \"row\", a.c AS col, max(b.m) = 1 AS mask FROM e a JOIN e b ON b.r BETWEEN a.r - 1 AND a.r AND b.c BETWEEN a.c - 1 AND a.c GROUP BY 1, 2")
def mo3(spark, sf_dir):
    return T.binary_opening(grid(spark, sf_dir).select("row", "col", (C("v") > -0.05).alias("mask")))


@query("tk7_top_values", f"WITH {G}, b AS (SELECT label, round(v, 2) + 0.0 AS x, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, x) AS k FROM b) SELECT label, x, n, k FROM r WHERE k <= 3")
def tk7(spark, sf_dir):
    b = grid(spark, sf_dir).groupBy("label", (F.round("v", 2) + F.lit(0.0)).alias("x")).agg(F.count("*").alias("n"))
    return b.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "x")).cast("long")).filter("k <= 3")


@query("jn4_area_average_rs4", f"WITH {H}, o AS (SELECT z.*, CAST(i AS BIGINT) AS ir, CAST(j AS BIGINT) AS jc, least(\"row\" + 1, (i + 1) * 3.5) - greatest(\"row\", i * 3.5) AS wr, least(col + 1, (j + 1) * 2.5) - greatest(col, j * 2.5) AS wc FROM z, range(0, 1000) a(i), range(0, 40) b(j) WHERE i * 3.5 < \"row\" + 1 AND (i + 1) * 3.5 > \"row\" AND j * 2.5 < col + 1 AND (j + 1) * 2.5 > col) SELECT ir AS \"row\", jc AS col, {q6('sum(wr * wc * v) / sum(wr * wc) FILTER (WHERE v IS NOT NULL)')} AS v, {q6('coalesce(sum(wr * wc) FILTER (WHERE v IS NOT NULL), 0) / 8.75')} AS coverage FROM o GROUP BY 1, 2")
def jn4(spark, sf_dir):
    return T.area_average(holes(spark, sf_dir), 3.5, 2.5).select("row", "col", r6("v").alias("v"), r6("coverage").alias("coverage"))


@query("rs5_mask_average", f'WITH {G} SELECT CAST(floor("row" / 5.0) AS BIGINT) AS "row", CAST(floor(col / 5.0) AS BIGINT) AS col, avg(CAST(v > 0 AS INTEGER)) > 0.5 AS low FROM g GROUP BY 1, 2')
def rs5(spark, sf_dir):
    return grid(spark, sf_dir).groupBy(F.floor(C("row") / 5).alias("row"), F.floor(C("col") / 5).alias("col")).agg((F.avg((C("v") > 0).cast("int")) > 0.5).alias("low"))


@query("me1_mesh_vertices", f"WITH {H} SELECT \"row\" * w + col AS vid, {q6('(col + 0.5) * 2.0')} AS x, {q6('-(\"row\" + 0.5) * 3.0')} AS y, {q6('coalesce(v - (SELECT min(v) FROM z), 0)')} AS z, {q6('(col + 0.5) / w')} AS u, {q6('1 - (\"row\" + 0.5) / h')} AS t FROM z, n")
def me1v(spark, sf_dir):
    v, _ = T.mesh(holes(spark, sf_dir), 2.0, 3.0)
    return v.select("vid", *(r6(c).alias(c) for c in ("x", "y", "z", "u", "t")))


@query("me1_mesh_faces", f"WITH {H}, q AS (SELECT a.\"row\" * w + a.col AS i, w FROM z a, n JOIN z b ON b.\"row\" = a.\"row\" AND b.col = a.col + 1 JOIN z c ON c.\"row\" = a.\"row\" + 1 AND c.col = a.col JOIN z d ON d.\"row\" = a.\"row\" + 1 AND d.col = a.col + 1 WHERE a.v + b.v + c.v + d.v IS NOT NULL) SELECT i AS a, i + w AS b, i + 1 AS c FROM q UNION ALL SELECT i + 1, i + w, i + w + 1 FROM q")
def me1f(spark, sf_dir):
    return T.mesh(holes(spark, sf_dir), 2.0, 3.0)[1]


@query("ag42_class_balance", f"WITH {G} SELECT label, count(*) AS n, {q6('count(*) / (SELECT count(*) FROM g)')} AS share FROM g GROUP BY label")
def ag42(spark, sf_dir):
    c = grid(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return c.select("label", "n", r6(C("n") / F.sum("n").over(Window.partitionBy("all"))).alias("share"))
