"""Error metrics: plain, stratified, pooled, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import errors as E
from terraloom.operators import records as N
from terraloom.plans.base import G, P, Registry, S, Z, grid, pairs, points, q6, r6  # noqa: F401
from terraloom.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STATS = ("bias", "mae", "rmse", "median_error", "nmad", "p95_abs_error", "le90", "pearson_r", "r2")


def shown(df, *keys):
    """Keys, counts and rounded statistics of a metrics frame."""
    return df.select(*keys, "n", "excluded_nodata", *(r6(c).alias(c) for c in _STATS))


def metrics_sql(ctes: str, source: str, pred: str, ref: str, by: str = "") -> str:
    """DuckDB text of error metrics; by: a grouping column, or none."""
    k, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"ON d.{by} IS NOT DISTINCT FROM a.{by}" if by else "ON true"
    kd = f"d.{by}, " if by else ""
    gd = f"GROUP BY d.{by}" if by else ""
    join = f"ON a.{by} IS NOT DISTINCT FROM b.{by}" if by else "ON true"
    ka = f"a.{by}, " if by else ""
    cols = ", ".join(f"{q6('a.' + c if c != 'nmad' else 'b.nmad')} AS {c}" for c in _STATS)
    return f"""WITH {ctes}, d AS (SELECT {k}CASE WHEN {ref} IS NOT NULL THEN {pred} END AS p, CASE WHEN {pred} IS NOT NULL THEN {ref} END AS r FROM {source}),
a AS (SELECT {k}count(p) AS n, count(*) - count(p) AS excluded_nodata, avg(p - r) AS bias, avg(abs(p - r)) AS mae, sqrt(avg((p - r) * (p - r))) AS rmse,
 quantile_cont(p - r, 0.5) AS median_error, quantile_cont(abs(p - r), 0.95) AS p95_abs_error, quantile_cont(abs(p - r), 0.9) AS le90,
 CASE WHEN count(p) > 1 AND stddev_pop(p) > 0 AND stddev_pop(r) > 0 THEN covar_pop(p, r) / (stddev_pop(p) * stddev_pop(r)) END AS pearson_r,
 CASE WHEN count(p) > 1 AND var_pop(r) > 0 THEN 1 - sum((p - r) * (p - r)) / (var_pop(r) * count(r)) END AS r2 FROM d {g}),
b AS (SELECT {kd}{E.MAD_SCALE} * quantile_cont(abs(d.p - d.r - a.median_error), 0.5) AS nmad FROM d JOIN a {on} {gd})
SELECT {ka}a.n, a.excluded_nodata, {cols} FROM a JOIN b {join}"""


def cell_pairs(spark, sf_dir):
    """The raster against its 8 x 8 cell means; every 17th cell is nodata."""
    g = grid(spark, sf_dir).withColumn("cell", F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8))
    means = g.groupBy("cell").agg(F.avg("v").alias("ref"))
    return g.join(means, "cell").withColumn("ref", F.when(F.col("cell") % 17 != 0, F.col("ref")))


CELLS = G + """, cm AS (SELECT *, CAST(floor("row" / 8.0) * 8 + floor(col / 8.0) AS BIGINT) AS cell FROM g),
ca AS (SELECT cell, avg(v) AS ref FROM cm GROUP BY cell),
cp AS (SELECT cm."row" AS "row", cm.col AS col, cm.v AS v, cm.label AS label, cm.cell AS cell, CASE WHEN cm.cell % 17 <> 0 THEN ca.ref END AS ref FROM cm JOIN ca ON cm.cell = ca.cell)"""


@query("ag1_error_metrics", metrics_sql(CELLS, "cp", "v", "ref"))
def ag1(spark, sf_dir):
    return shown(E.error_metrics(cell_pairs(spark, sf_dir), "v", "ref"))


@query("ag3_stratified_metrics", metrics_sql(CELLS, "cp", "v", "ref", "label"))
def ag3(spark, sf_dir):
    d = cell_pairs(spark, sf_dir)
    names = d.select("label").distinct()
    return shown(E.stratified(d, "v", "ref", "label", names), "label")


@query("ag3_empty_strata", """SELECT * FROM (WITH m AS (""" + metrics_sql(CELLS, "cp", "v", "ref", "label") + """) SELECT x.label, x.name, coalesce(n, 0) AS n, rmse FROM (VALUES (0, 'zero'), (3, 'three'), (77, 'none')) AS x(label, name) LEFT JOIN m ON m.label = x.label)""")
def ag3_empty(spark, sf_dir):
    names = spark.createDataFrame([(0, "zero"), (3, "three"), (77, "none")], "label int, name string")
    return E.stratified(cell_pairs(spark, sf_dir), "v", "ref", "label", F.broadcast(names)).select("label", "name", "n", r6("rmse").alias("rmse"))


@query("ag39_price_agreement", metrics_sql(S, "s", "p", "q", "l_returnflag"))
def ag39(spark, sf_dir):
    return shown(E.group_metrics(pairs(spark, sf_dir), "p", "q", ["l_returnflag"]), "l_returnflag")


_FIT = f"""WITH {S}, f AS (SELECT l_returnflag AS k, regr_slope(q, p) AS a, regr_intercept(q, p) AS b FROM s GROUP BY 1),
d AS (SELECT k, a, b, a * p + b - q AS e FROM s JOIN f ON k = l_returnflag)
SELECT k AS l_returnflag, count(*) AS n, {q6('avg(e)')} AS bias, {q6('sqrt(avg(e * e))', 4)} AS rmse, {q6('any_value(a)', 8)} AS fit_a, {q6('any_value(b)', 4)} AS fit_b FROM d GROUP BY k"""


@query("ag2_affine_fitted", _FIT)
def ag2(spark, sf_dir):
    m = E.affine_fitted_metrics(pairs(spark, sf_dir), "p", "q", ["l_returnflag"])
    return m.select("l_returnflag", "n", r6("bias").alias("bias"), r6("rmse", 4).alias("rmse"), r6("fit_a", 8).alias("fit_a"), r6("fit_b", 4).alias("fit_b"))


@query("ag4_overlapping_strata", f"""WITH {S} SELECT l_returnflag, p_brand, count(*) AS n, {q6('avg(p - q)', 4)} AS bias, {q6('sqrt(avg((p - q) * (p - q)))', 4)} AS rmse
FROM s GROUP BY GROUPING SETS ((l_returnflag), (p_brand), ())""")
def ag4(spark, sf_dir):
    d = F.col("p") - F.col("q")
    return pairs(spark, sf_dir).groupingSets([["l_returnflag"], ["p_brand"], []], "l_returnflag", "p_brand").agg(F.count("*").alias("n"), r6(F.avg(d), 4).alias("bias"), r6(F.sqrt(F.avg(d * d)), 4).alias("rmse"))


@query("ag8_residual_stats", f"""WITH {CELLS}, d AS (SELECT label, v - ref AS e FROM cp WHERE v - ref IS NOT NULL), m AS (SELECT label, median(e) AS m FROM d GROUP BY label)
SELECT d.label, count(*) AS n, {q6('avg(e)')} AS bias, {q6('sqrt(avg(e * e))')} AS rmse, {q6('1.4826 * median(abs(e - m))')} AS nmad, {q6('quantile_cont(abs(e), 0.9)')} AS le90 FROM d JOIN m USING (label) GROUP BY d.label""")
def ag8(spark, sf_dir):
    return shown(E.error_metrics(cell_pairs(spark, sf_dir), "v", "ref", ["label"]), "label").select("label", "n", "bias", "rmse", "nmad", "le90")


_SITES = f"""{S}, site AS (SELECT p_brand, l_returnflag, count(*) AS n, avg(p - q) AS bias, sqrt(avg((p - q) * (p - q))) AS rmse FROM s GROUP BY ALL)"""


def _sites(spark, sf_dir):
    return E.error_metrics(pairs(spark, sf_dir), "p", "q", ["p_brand", "l_returnflag"])


@query("ag15_pooled_rmse", f"WITH {_SITES} SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, {q6('sqrt(sum(n * rmse * rmse) / sum(n))', 4)} AS rmse, {q6('sum(n * bias) / sum(n)', 4)} AS bias FROM site GROUP BY l_returnflag")
def ag15(spark, sf_dir):
    return E.pooled(_sites(spark, sf_dir), ["l_returnflag"]).select("l_returnflag", "n", r6("rmse", 4).alias("rmse"), r6("bias", 4).alias("bias"))


@query("ag16_relative_change", f"""WITH {_SITES}, b AS (SELECT p_brand, rmse AS base FROM site WHERE l_returnflag = 'N') SELECT site.p_brand, l_returnflag, {q6('100 * (rmse - base) / base', 4)} AS change_pct FROM site JOIN b USING (p_brand) WHERE l_returnflag <> 'N'""")
def ag16(spark, sf_dir):
    site = _sites(spark, sf_dir).select("p_brand", "l_returnflag", "rmse")
    wide = site.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.first("rmse"))
    long = wide.selectExpr("p_brand", "N", "stack(2, 'A', A, 'R', R) AS (l_returnflag, rmse)").filter("rmse IS NOT NULL AND N IS NOT NULL")
    return long.select("p_brand", "l_returnflag", r6(100 * (F.col("rmse") - F.col("N")) / F.col("N"), 4).alias("change_pct"))


@query("ag20_array_agreement", f"WITH {CELLS} SELECT {q6('sqrt(sum((v - ref) * (v - ref))) / sqrt(sum(ref * ref))')} AS rel_l2, {q6('max(abs(v - ref))')} AS max_abs, {q6('corr(v, ref)')} AS pearson FROM cp WHERE ref IS NOT NULL")
def ag20(spark, sf_dir):
    d = cell_pairs(spark, sf_dir).filter("ref IS NOT NULL")
    e = F.col("v") - F.col("ref")
    return d.agg(r6(F.try_divide(F.sqrt(F.sum(e * e)), F.sqrt(F.sum(F.col("ref") * F.col("ref"))))).alias("rel_l2"), r6(F.max(F.abs(e))).alias("max_abs"), r6(E.correlation("v", "ref")).alias("pearson"))


@query("ag21_sigma_coverage", f"WITH {CELLS}, d AS (SELECT abs(v - ref) AS e, 0.05 + abs(ref) AS s, label FROM cp WHERE ref IS NOT NULL) SELECT label, {q6('avg(CAST(e <= s AS INTEGER))')} AS within_1, {q6('avg(CAST(e <= 2 * s AS INTEGER))')} AS within_2, {q6('median(s)')} AS median_sigma FROM d GROUP BY label")
def ag21(spark, sf_dir):
    d = cell_pairs(spark, sf_dir).filter("ref IS NOT NULL").select("label", F.abs(F.col("v") - F.col("ref")).alias("e"), (0.05 + F.abs("ref")).alias("s"))
    return d.groupBy("label").agg(r6(F.avg((F.col("e") <= F.col("s")).cast("int"))).alias("within_1"), r6(F.avg((F.col("e") <= 2 * F.col("s")).cast("int"))).alias("within_2"), r6(F.median("s")).alias("median_sigma"))


@query("ag24_height_bins", f"""WITH {S}, b AS (SELECT CASE WHEN q < 1200 THEN '<1200' WHEN q < 1600 THEN '1200-1600' ELSE '>=1600' END AS bin, p - q AS d FROM s)
SELECT bin, count(*) AS n, {q6('avg(d)', 4)} AS bias, {q6('sqrt(avg(d * d))', 4)} AS rmse FROM b GROUP BY bin HAVING count(*) >= 3""")
def ag24(spark, sf_dir):
    b = pairs(spark, sf_dir).withColumn("bin", F.when(F.col("q") < 1200, "<1200").when(F.col("q") < 1600, "1200-1600").otherwise(">=1600"))
    return E.error_metrics(b, "p", "q", ["bin"]).filter("n >= 3").select("bin", "n", r6("bias", 4).alias("bias"), r6("rmse", 4).alias("rmse"))


@query("ag34_raster_summary", f"WITH {CELLS} SELECT label, {q6('avg(CAST(ref IS NULL AS INTEGER))')} AS nan_fraction, {q6('min(ref)')} AS lowest, {q6('max(ref)')} AS highest, {q6('1 - avg(CAST(ref IS NULL AS INTEGER))')} AS coverage FROM cp GROUP BY label")
def ag34(spark, sf_dir):
    hole = F.avg(F.col("ref").isNull().cast("int"))
    return cell_pairs(spark, sf_dir).groupBy("label").agg(r6(hole).alias("nan_fraction"), r6(F.min("ref")).alias("lowest"), r6(F.max("ref")).alias("highest"), r6(1 - hole).alias("coverage"))


_SLOPE = """sg AS (SELECT "row", col, v, ref, CASE WHEN col = 0 THEN (lead(ref) OVER c - ref) / 0.05e0 WHEN col = w - 1 THEN (ref - lag(ref) OVER c) / 0.05e0 ELSE (lead(ref) OVER c - lag(ref) OVER c) / 0.1e0 END AS gx,
CASE WHEN "row" = 0 THEN (lead(ref) OVER r - ref) / 0.05e0 WHEN "row" = h - 1 THEN (ref - lag(ref) OVER r) / 0.05e0 ELSE (lead(ref) OVER r - lag(ref) OVER r) / 0.1e0 END AS gy FROM cp, z WINDOW c AS (PARTITION BY "row" ORDER BY col), r AS (PARTITION BY col ORDER BY "row")),
sd AS (SELECT v, ref, degrees(atan(sqrt(gx * gx + gy * gy))) AS s FROM sg), sc AS (SELECT v, ref, CASE WHEN s IS NULL THEN -1 WHEN s < 5 THEN 0 WHEN s < 15 THEN 1 ELSE 2 END AS slope_class FROM sd)"""


@query("ag36_evaluate_by_slope", f"SELECT x.slope_class, x.name, coalesce(n, 0) AS n, coalesce(excluded_nodata, 0) AS excluded_nodata, {', '.join(_STATS)} FROM (VALUES (0, 'flat'), (1, 'moderate'), (2, 'steep')) AS x(slope_class, name) LEFT JOIN ({metrics_sql(f'{CELLS}, {Z}, {_SLOPE}', 'sc', 'v', 'ref', 'slope_class')}) m ON m.slope_class = x.slope_class")
def ag36(spark, sf_dir):
    from terraloom.operators import terrain

    d = cell_pairs(spark, sf_dir)
    slope = terrain.slope(d.select("row", "col", F.col("ref").alias("v")), res=(0.05, 0.05), scene=None)
    cls = F.when(F.col("slope").isNull(), -1).when(F.col("slope") < 5, 0).when(F.col("slope") < 15, 1).otherwise(2)
    joined = d.join(slope.select("row", "col", cls.alias("slope_class")), ["row", "col"])
    names = spark.createDataFrame([(0, "flat"), (1, "moderate"), (2, "steep")], "slope_class int, name string")
    return shown(E.stratified(joined, "v", "ref", "slope_class", F.broadcast(names)), "slope_class", "name")


@query("pf46_slim", f"WITH {_SITES} SELECT p_brand, l_returnflag, round(rmse, 3) AS rmse, round(sqrt(greatest(rmse * rmse - bias * bias, 0)), 3) AS std_error FROM site")
def pf46(spark, sf_dir):
    m = _sites(spark, sf_dir)
    return m.select("p_brand", "l_returnflag", F.round("rmse", 3).alias("rmse"), F.round(F.sqrt(F.greatest(F.col("rmse") ** 2 - F.col("bias") ** 2, F.lit(0.0))), 3).alias("std_error"))


@query("ag43_variant_comparison", f"""WITH {CELLS}, t AS (SELECT "row", col, v, CASE WHEN (col % 5) <> 0 THEN ref END AS a, CASE WHEN ("row" % 7) <> 0 THEN ref * 0.9 END AS b FROM cp),
u AS (SELECT "row", col, v, 'a' AS variant, a AS x, a IS NOT NULL AND b IS NOT NULL AS common FROM t UNION ALL SELECT "row", col, v, 'b', b, a IS NOT NULL AND b IS NOT NULL FROM t UNION ALL SELECT "row", col, v, 'hybrid', coalesce(a, b), a IS NOT NULL AND b IS NOT NULL FROM t)
SELECT variant, count(x) AS n, count(*) AS total, {q6('sqrt(avg((x - v) * (x - v)))')} AS rmse_all, {q6('sqrt(avg((x - v) * (x - v)) FILTER (WHERE common))')} AS rmse_common FROM u GROUP BY variant""")
def ag43(spark, sf_dir):
    t = cell_pairs(spark, sf_dir).select("v", F.when(F.col("col") % 5 != 0, F.col("ref")).alias("a"), F.when(F.col("row") % 7 != 0, F.col("ref") * 0.9).alias("b"))
    x = N.compare_variants(t, "v", ["a", "b"])
    return x.select("variant", "n", "total", r6("rmse_all").alias("rmse_all"), r6("rmse_common").alias("rmse_common"))


@query("jn11_common_subset", f"""WITH {S}, b AS (SELECT p_brand FROM s GROUP BY p_brand HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM s)) SELECT p_brand, count(*) AS n FROM s WHERE p_brand IN (SELECT p_brand FROM b) GROUP BY p_brand""")
def jn11(spark, sf_dir):
    s = pairs(spark, sf_dir)
    every = s.agg(F.count_distinct("l_returnflag").alias("k"))
    full = s.groupBy("p_brand").agg(F.count_distinct("l_returnflag").alias("m")).crossJoin(F.broadcast(every)).filter("m = k").select("p_brand")
    return s.join(full, "p_brand", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))
