"""Calibration, gates and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import calibration as K
from terraloom.operators import errors as E
from terraloom.operators import terrain as T
from terraloom.operators import tiles as L
from terraloom.plans.base import G, Registry, S, Z, extent, grid, pairs, q6, r6

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col


@query("ag10_affine_fit", f"WITH {S} SELECT p_brand, {q6('CASE WHEN count(p) >= 64 AND max(p) > min(p) THEN regr_slope(q, p) ELSE 1 END', 8)} AS a, {q6('CASE WHEN count(p) >= 64 AND max(p) > min(p) THEN regr_intercept(q, p) ELSE 0 END', 4)} AS b FROM s GROUP BY p_brand")
def ag10(spark, sf_dir):
    return E.affine_fit(pairs(spark, sf_dir), "p", "q", ["p_brand"], 64).select("p_brand", r6("a", 8).alias("a"), r6("b", 4).alias("b"))


def world(spark, sf_dir):
    """Raster with a coarse elevation model: dem = 4 r + 2 with a few gross errors."""
    g = grid(spark, sf_dir)
    bad = (31 * C("row") + 17 * C("col") + C("row") * C("col")) % 20 == 0
    return g.select("row", "col", C("v").alias("r"), (4 * C("v") + 2 + F.when(bad, 80.0).otherwise(0.0)).alias("dem"), F.lit(0.0).alias("slope"), (C("label") == 9).alias("water"), (F.pmod(F.floor(C("row") / 25) + F.floor(C("col") / 8), F.lit(2)) == 0).alias("fit"), F.lit(0.5).alias("dem_error"), (F.floor(C("row") / 8) * 8 + F.floor(C("col") / 8)).alias("cell"), C("v").alias("low"))


@query("ag12_huber_fit")
def ag12(spark, sf_dir):
    f = K.huber_fit(world(spark, sf_dir), "low", "dem")
    return spark.createDataFrame([(round(f["a"], 3), round(f["b"], 3), f["n"])], "a double, b double, n long")


#: Without the gross errors, which are no inliers, all pixels are on one line.
@query("ag13_ransac_fit", f'WITH {G} SELECT 4.0e0 AS a, 2.0e0 AS b, {q6("""avg(CAST((31 * "row" + 17 * col + "row" * col) % 20 <> 0 AS INTEGER))""", 3)} AS inlier_fraction FROM g')
def ag13(spark, sf_dir):
    f = K.ransac_fit(world(spark, sf_dir), "low", "dem")
    return spark.createDataFrame([(f["a"], f["b"], f["inlier_fraction"])], "a double, b double, inlier_fraction double").select(*(r6(c, 3).alias(c) for c in ("a", "b", "inlier_fraction")))


@query("ag14_bootstrap")
def ag14(spark, sf_dir):
    f = K.bootstrap_std(world(spark, sf_dir), "low", "dem", times=10)
    return spark.createDataFrame([(f["a_std"], f["m"], f["n"])], "a_std double, m long, n long")


def _method(name):
    def run(spark, sf_dir):
        out, report = K.METHODS[name](world(spark, sf_dir), gate=K.Gate(bootstrap=5))
        return out.agg(F.count("z").alias("n"), r6(F.avg("z"), 3).alias("mean_z"), r6(F.avg("sigma"), 3).alias("mean_sigma"), F.count_if("low_confidence").alias("low")).withColumn("metric", F.lit(report["metric"]))

    return run


query("pf21_method_m0", f"""WITH {G}, w AS (SELECT label = 9 AS water FROM g) SELECT count(*) AS n, CAST(count_if(water) AS BIGINT) AS low, true AS metric, 0.5::DOUBLE AS mean_sigma FROM w""")(lambda spark, sf_dir: _method("M0")(spark, sf_dir).select("n", "low", "metric", "mean_sigma"))
@query("ud4_method_registry", f"WITH {G} SELECT method, count(*) AS n, {q6('avg(4 * v + 2 + CASE WHEN (31 * \"row\" + 17 * col + \"row\" * col) % 20 = 0 THEN 80 ELSE 0 END)', 3)} AS mean FROM g, (VALUES ('M0'), ('own')) AS m(method) GROUP BY method")
def ud4(spark, sf_dir):
    """A registered method and one of one's own, through the same interface."""
    methods = {"M0": K.METHODS["M0"], "own": lambda df, **_: (df.select("row", "col", C("dem").alias("z")), {"metric": True})}
    made = [f(world(spark, sf_dir), gate=K.Gate(bootstrap=5))[0].agg(F.count("z").alias("n"), r6(F.avg("z"), 3).alias("mean")).select(F.lit(m).alias("method"), "n", "mean") for m, f in methods.items()]
    return made[0].union(made[1])


query("pf35_method_m1")(_method("M1"))
query("pf34_method_m2_cell")(_method("M2_cell"))
query("pf34_method_m2_smooth")(_method("M2_smooth"))


@query("pf33_uncertainty", f'WITH {G}, m AS (SELECT avg(v) AS m FROM g) SELECT "row", col, {q6("sqrt(0.3 * 0.3 + pow(0.1 * abs(v - m), 2))")} AS m1, {q6("CASE WHEN label <> 9 THEN sqrt(0.25 + pow(0.1 * abs(v), 2)) END")} AS m2 FROM g, m')
def pf33(spark, sf_dir):
    g = grid(spark, sf_dir)
    m = g.agg(F.avg("v").alias("m"))
    return g.crossJoin(F.broadcast(m)).select("row", "col", r6(K.sigma_affine(F.lit(0.3), F.lit(0.1), C("v"), C("m"))).alias("m1"), r6(F.when(C("label") != 9, K.sigma_residual(F.lit(0.5), F.lit(0.1), C("v")))).alias("m2"))


@query("pf36_quality_gate", f"""WITH {S}, f AS (SELECT p_brand, regr_slope(q, p) AS a, avg(CAST(q > 1000 AS INTEGER)) AS cov, sqrt(avg((p - q) * (p - q))) AS nm FROM s GROUP BY p_brand)
SELECT p_brand, concat_ws('; ', CASE WHEN cov < 0.8 THEN 'elevation model covers too little of the image' END, CASE WHEN a <= 0 THEN 'fitted scale is not positive' END, CASE WHEN NOT nm <= 15 THEN 'held-out residual is too large' END) AS reasons, cov >= 0.8 AND a > 0 AND nm <= 15 AS metric FROM f""")
def pf36(spark, sf_dir):
    f = pairs(spark, sf_dir).groupBy("p_brand").agg(F.regr_slope("q", "p").alias("a"), F.avg((C("q") > 1000).cast("int")).alias("cov"), F.sqrt(F.avg((C("p") - C("q")) ** 2)).alias("nm"))
    why = K.gate_reasons(C("cov"), C("a"), C("nm"), K.Gate())
    return f.withColumn("why", why).select("p_brand", F.array_join("why", "; ").alias("reasons"), (F.size("why") == 0).alias("metric"))


TILE, OVERLAP = 200, 50
#: First rows of the tiles that cover the raster, which is one tile wide, and their heights.
TILES = f"""{Z}, t AS (SELECT row_number() OVER (ORDER BY r) - 1 AS i, CAST(r AS BIGINT) AS r, least({TILE}, h) AS th, w AS tw FROM (SELECT DISTINCT unnest(list_concat(range(0, h - {TILE}, {TILE - OVERLAP}), [greatest(0, h - {TILE})])) AS r, h, w FROM z))"""


def plan(spark, sf_dir):
    g = grid(spark, sf_dir)
    h, w = extent(g)
    return g, h, w, L.plan(spark, h, w, TILE, OVERLAP)


@query("tl1_tile_plan", f"WITH {TILES} SELECT CAST(i AS INTEGER) AS tile_id, r AS row0, CAST(0 AS BIGINT) AS col0, th AS h, tw AS w FROM t")
def tl1(spark, sf_dir):
    return plan(spark, sf_dir)[3]


@query("tl5_tile_edges", f"WITH {TILES} SELECT DISTINCT e AS edge FROM (SELECT r AS e FROM t UNION ALL SELECT r + th FROM t), z WHERE e > 0 AND e < h")
def tl5(spark, sf_dir):
    return spark.createDataFrame([(e,) for e in L.edges(extent(grid(spark, sf_dir))[0], TILE, OVERLAP)], "edge long")


@query("tl2_tile_transform", f"WITH {TILES} SELECT CAST(i AS INTEGER) AS tile_id, 214400.0e0 AS c, round(3358000.0e0 - 0.6 * r, 6) AS f FROM t")
def tl2(spark, sf_dir):
    return plan(spark, sf_dir)[3].select("tile_id", (214400.0 + 0.6 * C("col0")).alias("c"), F.round(3358000.0 - 0.6 * C("row0"), 6).alias("f"))


@query("jn6_tile_overlaps", "WITH t AS (SELECT CAST(i AS INTEGER) AS i, 90 * (i // 2) AS r, 40 * (i % 2) AS c FROM range(4) x(i)) SELECT a.i AS i, b.i AS j, greatest(a.r, b.r) AS r0, least(a.r + 100, b.r + 100) AS r1, greatest(a.c, b.c) AS c0, least(a.c + 50, b.c + 50) AS c1 FROM t a JOIN t b ON a.i < b.i WHERE least(a.r + 100, b.r + 100) > greatest(a.r, b.r) AND least(a.c + 50, b.c + 50) > greatest(a.c, b.c)")
def jn6(spark, sf_dir):
    t = spark.range(4).select(C("id").cast("int").alias("tile_id"), (90 * F.floor(C("id") / 2)).alias("row0"), (40 * (C("id") % 2)).alias("col0"), F.lit(100).cast("long").alias("h"), F.lit(50).cast("long").alias("w"))
    return L.overlaps(t)


@query("jn7_pixels_in_tiles", f'WITH {G}, {TILES} SELECT "row", col, r AS row0 FROM g JOIN t ON "row" >= r AND "row" < r + th')
def jn7(spark, sf_dir):
    g, h, w, _ = plan(spark, sf_dir)
    return L.deal(g, h, w, TILE, OVERLAP).select("row", "col", "row0")


def _w(i: str, n: str) -> str:
    return f"CASE WHEN least({i}, {n} - 1 - {i}) < least({OVERLAP}, {n} // 2) THEN 0.5 - 0.5 * cos(pi() * (least({i}, {n} - 1 - {i}) + 1) / (least({OVERLAP}, {n} // 2) + 1)) ELSE 1 END"


_DEALT = f"""{G}, {TILES}, d AS (SELECT "row", col, r AS row0, v * (1 + r / 300.0) AS p, least({_w('("row" - r)', 'th')}, {_w('col', 'tw')}) AS w FROM g JOIN t ON "row" >= r AND "row" < r + th)"""


def _dealt(spark, sf_dir):
    g, h, w, _ = plan(spark, sf_dir)
    return L.deal(g, h, w, TILE, OVERLAP).withColumn("p", C("v") * (1 + C("row0") / 300))


@query("wn9_blend_weights", f'WITH {_DEALT} SELECT "row", col, row0, {q6("w")} AS w FROM d')
def wn9(spark, sf_dir):
    return _dealt(spark, sf_dir).select("row", "col", "row0", r6(L.blend_weight(OVERLAP)).alias("w"))


@query("ag9_blend_mosaic", f'WITH {_DEALT} SELECT "row", col, {q6("sum(w * p) / sum(w)")} AS v FROM d GROUP BY "row", col')
def ag9(spark, sf_dir):
    return L.blend(_dealt(spark, sf_dir), OVERLAP).select("row", "col", r6("v").alias("v"))


@query("jn8_overlap_strips", f'WITH {_DEALT} SELECT a.row0 AS i, b.row0 AS j, count(*) AS n, {q6("avg(b.p - a.p)")} AS gap FROM d a JOIN d b ON a."row" = b."row" AND a.col = b.col AND a.row0 < b.row0 GROUP BY 1, 2')
def jn8(spark, sf_dir):
    d = _dealt(spark, sf_dir)
    a, b = d.select("row", "col", C("row0").alias("i"), C("p").alias("pi")), d.select("row", "col", C("row0").alias("j"), C("p").alias("pj"))
    return a.join(b, ["row", "col"]).filter("i < j").groupBy("i", "j").agg(F.count("*").alias("n"), r6(F.avg(C("pj") - C("pi"))).alias("gap"))


def _tiles(spark, sf_dir):
    g, h, w, p = plan(spark, sf_dir)
    return p, L.deal(g, h, w, TILE, OVERLAP).join(p.select("tile_id", "row0", "col0"), ["row0", "col0"])


@query("ud3_tiled_prediction", f'WITH {G}, {TILES} SELECT CAST(i AS INTEGER) AS tile_id, count(*) AS n, {q6("sum(2 * v)")} AS total FROM g JOIN t ON "row" >= r AND "row" < r + th GROUP BY 1')
def ud3(spark, sf_dir):
    _, d = _tiles(spark, sf_dir)
    return L.predict(d.select("tile_id", "row", "col", "v"), lambda x: 2 * x[..., 0], ["v"]).groupBy("tile_id").agg(F.count("*").alias("n"), r6(F.sum("p")).alias("total"))


def _distorted(spark, sf_dir):
    p, d = _tiles(spark, sf_dir)
    t = C("tile_id")
    return p, d.select("tile_id", "row", "col", ((1 + 0.3 * t) * C("v") + 0.5 * t).alias("p"))


@query("tl3_sequential_alignment", f'WITH {G} SELECT "row", col, {q6("v", 4)} AS v FROM g')
def tl3(spark, sf_dir):
    p, d = _distorted(spark, sf_dir)
    m, _ = L.align_sequential(d, [r.asDict() for r in p.orderBy("tile_id").collect()], OVERLAP)
    return m.select("row", "col", r6("v", 4).alias("v"))


#: The distortions are known, so the alignment that undoes them is too.
@query("tl4_joint_alignment", f"WITH {TILES} SELECT CAST(i AS INTEGER) AS tile_id, {q6('1 / (1 + 0.3 * i)', 4)} AS a, {q6('-0.5 * i / (1 + 0.3 * i)', 4)} AS b FROM t")
def tl4(spark, sf_dir):
    p, d = _distorted(spark, sf_dir)
    h, w = extent(grid(spark, sf_dir))
    fits = L.align_joint(d, p, h, w, plane=False, hp_px=7, min_strip_px=20, step=2)
    return spark.createDataFrame([(f["tile_id"], f["a"], f["b"]) for f in fits], "tile_id int, a double, b double").select("tile_id", r6("a", 4).alias("a"), r6("b", 4).alias("b"))


@query("ag33_seam_statistics", f"""WITH {G}, {TILES}, p AS (SELECT a."row" AS r, median(b.v - c.v) AS s FROM g a JOIN g b ON b."row" = a."row" + 4 AND b.col = a.col JOIN g c ON c."row" = a."row" - 4 AND c.col = a.col GROUP BY 1),
e AS (SELECT DISTINCT e AS edge FROM (SELECT r AS e FROM t UNION ALL SELECT r + th FROM t), z WHERE e > 0 AND e < h),
k AS (SELECT quantile_cont(abs(s), 0.95) AS control FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE abs(r - edge) <= 10)) SELECT edge, {q6('max(abs(s))')} AS peak, {q6('any_value(control)')} AS control_p95, {q6('max(abs(s)) / any_value(control)')} AS ratio FROM p JOIN e ON abs(r - edge) <= 6, k GROUP BY edge""")
def ag33(spark, sf_dir):
    g = grid(spark, sf_dir)
    s = L.seam_stats(L.step_profile(g, 4), L.edges(extent(g)[0], TILE, OVERLAP), 4, 6)
    return s.select("edge", r6("peak").alias("peak"), r6("control_p95").alias("control_p95"), r6("ratio").alias("ratio"))
