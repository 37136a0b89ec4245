"""Ground, heights above it, shadows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import graph, terrain
from terraloom.operators import ground as D
from terraloom.plans.base import G, Registry, Z, extent, grid, q6, r6
from terraloom.plans.joins import footprints
from terraloom.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col


@query("wn6_lattice_ground")
def wn6(spark, sf_dir):
    x = D.lattice_ground(grid(spark, sf_dir), 40, max_roughness=0.15)
    return x.select("i", "j", r6("fraction").alias("fraction"), r6("ground").alias("ground"))


@query("pf37_ground_and_ndsm")
def pf37(spark, sf_dir):
    x = D.estimate_ground(grid(spark, sf_dir), 40, max_roughness=0.15)
    return x.select("row", "col", r6("ground").alias("ground"), r6("ndsm").alias("ndsm"), "low_confidence")


@query("jn16_fill_nearest", f"""WITH {G}, l AS (SELECT "row" // 20 AS i, col // 16 AS j, CASE WHEN label < 4 THEN v END AS ground FROM g WHERE "row" % 20 = 0 AND col % 16 = 0),
f AS (SELECT e.i, e.j, arg_min(o.ground, (abs(e.i - o.i) + abs(e.j - o.j), o.i, o.j)) AS x FROM l e, l o WHERE e.ground IS NULL AND o.ground IS NOT NULL GROUP BY 1, 2) SELECT l.i, l.j, coalesce(l.ground, x) AS ground FROM l LEFT JOIN f USING (i, j)""")
def jn16(spark, sf_dir):
    l = grid(spark, sf_dir).filter("row % 20 = 0 AND col % 16 = 0").select(F.floor(C("row") / 20).alias("i"), F.floor(C("col") / 16).alias("j"), F.when(C("label") < 4, C("v")).alias("ground"))
    return D.fill_nearest(l).select("i", "j", "ground")


_H = f"{G}, h AS (SELECT CAST(floor((v + 0.5) * 250) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.i AS bin, sum(coalesce(n, 0) / (SELECT sum(n) FROM h)) OVER (ORDER BY x.i) AS c, sum(coalesce(n, 0) * x.i / (SELECT sum(n) FROM h)) OVER (ORDER BY x.i) AS s FROM range(256) x(i) LEFT JOIN h ON h.bin = x.i), m AS (SELECT max(s) AS m FROM c)"
_PART = "CASE WHEN {0} > 1e-15 THEN ({1}) * ({1}) / ({0}) ELSE 0 END"


def _histogram(spark, sf_dir):
    return grid(spark, sf_dir).groupBy(F.floor((C("v") + 0.5) * 250).alias("bin")).agg(F.count("*").alias("n"))


@query("ag17_otsu_three_classes", f"WITH {_H} SELECT a.bin + 1 AS t1, b.bin + 1 AS t2 FROM c a, c b, m WHERE a.bin < b.bin AND a.bin + 1 <= 253 AND b.bin + 1 <= 255 ORDER BY round({_PART.format('a.c', 'a.s')} + {_PART.format('(b.c - a.c)', 'b.s - a.s')} + {_PART.format('(1 - b.c)', 'm - b.s')}, 9) DESC, 1, 2 LIMIT 1")
def ag17(spark, sf_dir):
    return D.otsu(_histogram(spark, sf_dir))


@query("ag18_otsu_two_classes", f"WITH {_H} SELECT bin + 1 AS t1 FROM c, m WHERE bin + 1 <= 255 ORDER BY round({_PART.format('c', 's')} + {_PART.format('(1 - c)', 'm - s')}, 9) DESC, 1 LIMIT 1")
def ag18(spark, sf_dir):
    return D.otsu(_histogram(spark, sf_dir), 2)


def _components(mask: str, width: str = "w") -> str:
    """Common table expressions `l` (id, label): 8-connected components of a table with r, c."""
    return f"""p AS (SELECT r, c, r * {width} + c AS id FROM {mask}, z), e AS (SELECT a.id AS a, b.id AS b FROM p a, range(-1, 2) i(i), range(-1, 2) j(j), p b WHERE b.r = a.r + i AND b.c = a.c + j AND a.id <> b.id),
l(id, label) USING KEY (id) AS (SELECT id, id FROM p UNION (SELECT e.a, min(v.label) FROM l v JOIN e ON e.b = v.id JOIN recurring.l u ON u.id = e.a WHERE v.label < u.label GROUP BY e.a))"""


_BRIGHT = f"""{G}, {Z}, m AS (SELECT "row" AS r, col AS c FROM g WHERE v > 0.16), {_components('m')}"""


@query("st3_components", f'WITH RECURSIVE {_BRIGHT} SELECT r AS "row", c AS col, label FROM l JOIN p USING (id)')
def st3(spark, sf_dir):
    g = grid(spark, sf_dir)
    return graph.pixel_components(g.filter("v > 0.16"), extent(g)[1])


@query("ag19_area_filter", f"WITH RECURSIVE {_BRIGHT} SELECT label, count(*) AS area FROM l GROUP BY label HAVING count(*) >= 6")
def ag19(spark, sf_dir):
    g = grid(spark, sf_dir)
    return D.area_filter(g.filter("v > 0.16"), extent(g)[1], 6).select("label", "area").distinct()


def _image(spark, sf_dir):
    level = F.floor((C("v") + 0.5) * 250).cast("int")
    return grid(spark, sf_dir).select("row", "col", level.alias("r"), level.alias("g"), level.alias("b"))


#: A grey image has no vegetation; its luminance is its level, up to rounding down.
_LUM = "CAST(floor(0.299e0 * floor((v + 0.5) * 250) + 0.587e0 * floor((v + 0.5) * 250) + 0.114e0 * floor((v + 0.5) * 250)) AS BIGINT)"


@query("sh1_shadow_mask", f"""WITH RECURSIVE {G}, {Z}, y AS (SELECT "row" AS r, col AS c, {_LUM} AS lum FROM g), hh AS (SELECT lum AS bin, count(*) AS n FROM y GROUP BY 1), cc AS (SELECT x.i AS bin, sum(coalesce(n, 0) / (SELECT sum(n) FROM hh)) OVER (ORDER BY x.i) AS c, sum(coalesce(n, 0) * x.i / (SELECT sum(n) FROM hh)) OVER (ORDER BY x.i) AS s FROM range(256) x(i) LEFT JOIN hh ON hh.bin = x.i), mm AS (SELECT max(s) AS m FROM cc),
th AS (SELECT a.bin + 1 AS t1 FROM cc a, cc b, mm WHERE a.bin < b.bin AND a.bin + 1 <= 253 AND b.bin + 1 <= 255 ORDER BY round({_PART.format('a.c', 'a.s')} + {_PART.format('(b.c - a.c)', 'b.s - a.s')} + {_PART.format('(1 - b.c)', 'm - b.s')}, 9) DESC, a.bin, b.bin LIMIT 1),
dark AS (SELECT r, c FROM y, th WHERE lum < t1), eroded AS (SELECT x.r AS r, x.c AS c FROM y x WHERE NOT EXISTS (SELECT 1 FROM range(-1, 1) i(i), range(-1, 1) j(j), y o LEFT JOIN dark d ON d.r = o.r AND d.c = o.c WHERE o.r = x.r + i AND o.c = x.c + j AND d.r IS NULL)),
m AS (SELECT DISTINCT y.r AS r, y.c AS c FROM eroded q, range(0, 2) i(i), range(0, 2) j(j), y WHERE y.r = q.r + i AND y.c = q.c + j), {_components('m')}
SELECT r AS "row", c AS col FROM l JOIN p USING (id) WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 6)""")
def sh1(spark, sf_dir):
    image = _image(spark, sf_dir)
    return D.shadow_mask(image, extent(image)[1])


def _shadow(spark, sf_dir):
    """Shadows and footprints of buildings of equal height, and the raster's size."""
    fp = footprints(spark, sf_dir)
    moved = fp.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).select((C("row") - C("k")).alias("row"), (C("col") - C("k")).alias("col")).distinct()
    return moved.filter("row >= 0 AND col >= 0").join(fp, ["row", "col"], "left_anti"), fp, *extent(grid(spark, sf_dir))


_CAST = f"""{G}, {Z}, fp AS (SELECT "row" AS r, col AS c, "row" // 25 * 2 + col // 32 + 1 AS id FROM g WHERE "row" % 25 BETWEEN 5 AND 14 AND col % 32 BETWEEN 8 AND 20), s AS (SELECT DISTINCT fp.r - k AS r, fp.c - k AS c FROM fp, range(1, 7) x(k)), sh AS (SELECT r, c FROM s ANTI JOIN fp USING (r, c) WHERE r >= 0 AND c >= 0)"""
_SCORES = f"""{_CAST}, t AS (SELECT d, CAST(round_even(-cos(radians(d)) * (1.5 + 1.5 * q), 0) AS BIGINT) AS dr, CAST(round_even(sin(radians(d)) * (1.5 + 1.5 * q), 0) AS BIGINT) AS dc FROM range(360) a(d), range(4) b(q)), o AS (SELECT DISTINCT dr, dc FROM t),
f AS (SELECT dr, dc, fp.r + dr AS r, fp.c + dc AS c FROM o, fp, z WHERE fp.r + dr BETWEEN 0 AND h - 1 AND fp.c + dc BETWEEN 0 AND w - 1), n AS (SELECT dr, dc, count(*) AS n, count(sh.r) AS k FROM (SELECT * FROM f ANTI JOIN fp USING (r, c)) f LEFT JOIN sh ON sh.r = f.r AND sh.c = f.c GROUP BY 1, 2),
x AS (SELECT CAST(d AS INTEGER) AS direction, coalesce(sum(k), 0) / greatest(coalesce(sum(n), 0), 1) AS score FROM t LEFT JOIN n USING (dr, dc) GROUP BY 1)"""


@query("sh2_shadow_azimuth_tk2", f"WITH {_SCORES}, b AS (SELECT arg_max(direction, (score, -direction)) AS direction, max(score) AS best, median(score) AS middle FROM x) SELECT direction, CAST((direction + 180) % 360 AS INTEGER) AS sun_azimuth, {q6('best')} AS best, {q6('middle')} AS middle FROM b")
def sh2(spark, sf_dir):
    return D.best_direction(D.shadow_azimuth(*_shadow(spark, sf_dir), 1.0)).select("direction", "sun_azimuth", r6("best").alias("best"), r6("middle").alias("middle"))


@query("jn14_shifted_footprints", f"WITH {_SCORES} SELECT direction, {q6('score')} AS score FROM x")
def jn14(spark, sf_dir):
    return D.shadow_azimuth(*_shadow(spark, sf_dir), 1.0).select("direction", r6("score").alias("score"))


#: Rays of 20 steps of (cos 45, -sin 45) from the footprints' edge pixels on the shadow side.
_STEP = "0.70710678118654752"


@query("sh3_shadow_heights_jn15", f"""WITH {_CAST}, edge AS (SELECT DISTINCT a.id, a.r, a.c FROM fp a, range(-1, 2) i(i), range(-1, 2) j(j), z WHERE a.r + i BETWEEN 0 AND h - 1 AND a.c + j BETWEEN 0 AND w - 1 AND NOT EXISTS (SELECT 1 FROM fp b WHERE b.r = a.r + i AND b.c = a.c + j AND b.id = a.id)),
ray AS (SELECT e.id, e.r, e.c FROM edge e, z WHERE NOT EXISTS (SELECT 1 FROM fp b WHERE b.id = e.id AND b.r = greatest(0, least(h - 1, CAST(round_even(e.r - 1.5 * {_STEP}, 0) AS BIGINT))) AND b.c = greatest(0, least(w - 1, CAST(round_even(e.c - 1.5 * {_STEP}, 0) AS BIGINT))))),
st AS (SELECT id, r, c, s, CAST(round_even(r - {_STEP} * s, 0) AS BIGINT) AS y, CAST(round_even(c - {_STEP} * s, 0) AS BIGINT) AS x FROM ray, range(1, 21) k(s)),
kd AS (SELECT st.*, CASE WHEN y < 0 OR x < 0 OR y >= h OR x >= w THEN 3 WHEN b.id = st.id THEN 0 WHEN b.id IS NOT NULL THEN 2 WHEN sh.r IS NULL THEN 1 ELSE 4 END AS kind FROM st CROSS JOIN z LEFT JOIN fp b ON b.r = y AND b.c = x LEFT JOIN sh ON sh.r = y AND sh.c = x),
stop AS (SELECT id, r, c, min(s) FILTER (WHERE kind IN (1, 2, 3)) AS halt, arg_min(kind, s) FILTER (WHERE kind IN (1, 2, 3)) AS why FROM kd GROUP BY 1, 2, 3),
run AS (SELECT stop.id AS id, any_value(why) AS why, coalesce(max(s) FILTER (WHERE kind = 4 AND (halt IS NULL OR s < halt)), 0) AS n FROM stop JOIN kd ON kd.id = stop.id AND kd.r = stop.r AND kd.c = stop.c GROUP BY stop.id, stop.r, stop.c),
a AS (SELECT id, count(*) AS rays, CAST(count_if(n > 0) AS BIGINT) AS in_shadow, count_if(why = 3 OR (why = 2 AND n > 0)) AS cut, quantile_cont(n, 0.75) FILTER (WHERE n > 0) AS q FROM run GROUP BY id)
SELECT id, {q6('CASE WHEN in_shadow >= 5 THEN q * 1.0 END')} AS height, rays, in_shadow, in_shadow >= 5 AND cut > 0.3 * in_shadow AS truncated FROM a""")
def sh3(spark, sf_dir):
    h = D.shadow_heights(*_shadow(spark, sf_dir), 1.0, 135.0, 45.0, 20.0)
    return h.select("id", r6("height").alias("height"), "rays", "in_shadow", "truncated")


#: Windows of 40 x 32 pixels every 20 x 16, as many as begin inside and reach no further.
_WINDOWS = f"""{G}, {Z}, w AS (SELECT a.i AS wi, b.j AS wj, avg((v - 0.05 * label) * (v - 0.05 * label)) AS m FROM g, z, LATERAL (SELECT unnest(range(greatest(0, "row" // 20 - 1), least("row" // 20, h // 20 - 2) + 1)) AS i) a, LATERAL (SELECT unnest(range(greatest(0, col // 16 - 1), least(col // 16, z.w // 16 - 2) + 1)) AS j) b GROUP BY 1, 2 HAVING count(*) > 640)"""


@query("ag40_worst_windows", f"WITH {_WINDOWS} SELECT wi, wj, {q6('sqrt(m)')} AS rmse FROM w")
def ag40(spark, sf_dir):
    return _windows(spark, sf_dir).select("wi", "wj", r6("rmse").alias("rmse"))


def _windows(spark, sf_dir):
    g = grid(spark, sf_dir)
    h, w = extent(g)
    near = lambda k, step, n: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(k / step) - 1), F.least(F.lit(n // step - 2).cast("long"), F.floor(k / step).cast("long")))
    inside = lambda k, step, n: F.floor(k / step) - 1 <= n // step - 2
    g = g.filter(inside(C("row"), 20, h) & inside(C("col"), 16, w)).withColumn("wi", F.explode(near(C("row"), 20, h))).withColumn("wj", F.explode(near(C("col"), 16, w)))
    e = C("v") - 0.05 * C("label")
    return g.groupBy("wi", "wj").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n")).filter("n > 640").select("wi", "wj", "rmse")


@query("tk1_worst_two_windows", f"""WITH {_WINDOWS}, x AS (SELECT wi, wj, round(sqrt(m), 6) AS m FROM w),
a AS (SELECT * FROM x ORDER BY m DESC, wi, wj LIMIT 1), b AS (SELECT x.* FROM x, a WHERE NOT (abs(x.wi - a.wi) < 2 AND abs(x.wj - a.wj) < 2) ORDER BY x.m DESC, x.wi, x.wj LIMIT 1) SELECT wi, wj, m + 0.0 AS rmse FROM a UNION ALL SELECT wi, wj, m + 0.0 FROM b""")
def tk1(spark, sf_dir):
    from terraloom.operators.relational import greedy_top

    w = _windows(spark, sf_dir).select("wi", "wj", F.round("rmse", 6).alias("rmse"))
    return greedy_top(w, 2, "rmse", lambda: (F.abs(C("a_wi") - C("b_wi")) < 2) & (F.abs(C("a_wj") - C("b_wj")) < 2))
