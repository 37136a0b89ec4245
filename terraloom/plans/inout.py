"""Sources, sinks, reports, audits, ordering and set operations."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from terraloom.operators import errors as E
from terraloom.operators import graph
from terraloom.operators import records as N
from terraloom.operators import relational as R
from terraloom.operators import terrain as T
from terraloom.plans.base import G, P, Registry, S, grid, pairs, points, q6, r6
from terraloom.plans.calibration import TILES, plan
from terraloom.plans.windows import H, holes
from terraloom.sources import catalog as K
from terraloom.sources import raster, sinks
from terraloom.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col


def _files(spark):
    y, x = np.mgrid[0:20, 0:30]
    a = ((3 * y + 5 * x) % 256).astype(np.uint8)
    hgt = (y[:, :20] * 10 - x[:, :20]).astype(">i2")
    hgt[0, 0] = -32768
    rows = [("a.png", raster.write_png(a)), ("b.ppm", b"P6\n30 20\n255\n" + np.repeat(a[..., None], 3, axis=2).tobytes()), ("N30E078.hgt", hgt.tobytes())]
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")


@query("sc1_raster_scan", """WITH p AS (SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM range(20) a(y), range(30) b(x))
SELECT 'a.png' AS path, 0 AS band, y AS "row", x AS col, CAST((3 * y + 5 * x) % 256 AS DOUBLE) AS v FROM p UNION ALL SELECT 'b.ppm', CAST(k AS INTEGER), y, x, (3 * y + 5 * x) % 256 FROM p, range(3) c(k)
UNION ALL SELECT 'N30E078.hgt', 0, y, x, CASE WHEN y + x > 0 THEN y * 10 - x END FROM p WHERE x < 20""")
def sc1(spark, sf_dir):
    return raster.long_grid(raster.tiles(_files(spark), 16)).select("path", "band", C("row").cast("long").alias("row"), C("col").cast("long").alias("col"), "v")


@query("sc1_raster_metadata", "SELECT * FROM (VALUES ('a.png', 30, 20, 1, 'uint8', false), ('b.ppm', 30, 20, 3, 'uint8', false), ('N30E078.hgt', 20, 20, 1, 'int16', true)) AS x(path, width, height, count, dtype, georeferenced)")
def sc1m(spark, sf_dir):
    return raster.metadata(_files(spark)).select("path", "width", "height", "count", "dtype", C("georef_issue").isNull().alias("georeferenced"))


@query("sc2_nodata_to_null", "SELECT l_orderkey, count(CASE WHEN l_quantity <> 10 THEN l_quantity END) AS valid, count(*) AS n FROM lineitem GROUP BY 1")
def sc2(spark, sf_dir):
    x = raster.mask_nodata(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", 10.0)
    return x.groupBy("l_orderkey").agg(F.count("l_quantity").alias("valid"), F.count("*").alias("n"))


@query("sc3_dem_window", f'WITH {G} SELECT "row", col, v FROM g WHERE "row" >= 98 AND "row" < 212 AND col >= 8 AND col < 42')
def sc3(spark, sf_dir):
    return raster.window(grid(spark, sf_dir), 98, 212, 8, 42).select("row", "col", "v")


@query("sc3_missing_tiles", f"WITH {P}, w AS (SELECT DISTINCT CAST(floor(lon / 10) AS BIGINT) AS tile FROM pts), h AS (SELECT DISTINCT CAST(floor(lon / 10) AS BIGINT) AS tile FROM pts WHERE lat > 70) SELECT w.tile, h.tile IS NULL AS missing FROM w LEFT JOIN h USING (tile)")
def sc3m(spark, sf_dir):
    t = F.floor(C("lon") / 10).alias("tile")
    p = points(spark, sf_dir)
    return K.wanted_and_missing(p.select(t).distinct(), p.filter("lat > 70").select(t))


@query("sc4_sc9_source_catalog", "SELECT * FROM (VALUES ('copernicus_glo30', 'EGM2008'), ('tilezen_skadi', 'EGM96'), ('nasadem', 'EGM96'), ('usgs_3dep_dsm', 'NAVD88')) AS x(source, vertical_datum)")
def sc4(spark, sf_dir):
    return K.sources(spark).filter("kind = 'surface'").select("source", "vertical_datum")


@query("sc8_one_survey", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def sc8(spark, sf_dir):
    return K.one_survey(table(spark, sf_dir, "orders").withColumn("survey", C("o_orderpriority")), "1-URGENT").select("o_orderkey", "o_totalprice")


@query("sc9_landcover_classes", "SELECT * FROM (VALUES (10, 'tree cover'), (20, 'shrubland'), (30, 'grassland'), (40, 'cropland'), (50, 'built-up'), (60, 'bare / sparse vegetation'), (70, 'snow and ice'), (80, 'permanent water'), (90, 'herbaceous wetland'), (95, 'mangroves'), (100, 'moss and lichen')) AS x(code, name)")
def sc9(spark, sf_dir):
    return K.landcover_classes(spark)


@query("sc11_newest_item_tk4", "SELECT o_custkey, max(o_orderdate) AS newest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def sc11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return K.newest(o, "at", "o_custkey").select("o_custkey", C("o_orderdate").alias("newest"), "o_orderkey")


@query("sc13_request_keys", f"WITH {P} SELECT id, substr(sha1(printf('%.6f,%.6f', lon, lat)), 1, 16) AS key, sha256(printf('%.6f', lon)) AS content FROM pts")
def sc13(spark, sf_dir):
    key, content = N.request_key(C("lon"), C("lat")), N.content_hash(F.format_string("%.6f", "lon"))
    return points(spark, sf_dir).select("id", key.alias("key"), content.alias("content"))


@query("sc15_evenly_spaced_subset", """WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, s_suppkey FROM r WHERE i IN (SELECT CAST(round_even(k * (n - 1) / greatest(least(3, n) - 1, 1), 0) AS BIGINT) FROM range(3) x(k) WHERE k < n)""")
def sc15(spark, sf_dir):
    return R.evenly_spaced(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 3)


@query("sc16_tile_ids", r"SELECT page_id, regexp_replace(url, '[_/][^_/]*$', '') AS stem, regexp_extract(url, '([^/]*)$', 1) AS tile FROM pages")
def sc16(spark, sf_dir):
    stem, tile = N.tile_name(C("url"))
    return table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), tile.alias("tile"))


@query("sc17_corner_crops", "SELECT s_suppkey, CAST(k AS INTEGER) AS k, CASE WHEN k % 2 = 0 THEN 0 ELSE 1024 - 518 END AS c0, CASE WHEN k < 2 THEN 0 ELSE 1024 - 518 END AS r0 FROM supplier, range(4) x(k)")
def sc17(spark, sf_dir):
    return N.corner_crops(table(spark, sf_dir, "supplier").select("s_suppkey"), 1024, 518)


@query("sc18_json_configs", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc18(spark, sf_dir):
    return N.parsed(table(spark, sf_dir, "events"), "props", "k long").select("event_id", C("config.k").alias("k"))


@query("sc19_synthetic_raster", "SELECT y AS \"row\", x AS col, round(sin(y / 9.0) + cos(x / 7.0), 6) + 0.0 AS v FROM range(40) a(y), range(50) b(x)")
def sc19(spark, sf_dir):
    return N.wavy(spark, 40, 50).select("row", "col", r6("v").alias("v"))


@query("sc20_cached_requests", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS hit, sha256(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN printf('content of %.6f', CAST(c_custkey AS DOUBLE)) END) AS sha256 FROM customer")
def sc20(spark, sf_dir):
    """Customers with a finished order have been asked for before; a second store of the
    same keys adds nothing."""
    from terraloom.operators import graph
    from terraloom.sources.cache import RequestCache

    ask = lambda c: N.request_key(c.cast("double"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(C("o_custkey").cast("double").alias("k"))
    fetched = done.select(ask(C("k")).alias("key"), F.format_string("content of %.6f", "k").alias("content"))
    cache = RequestCache(spark, f"{graph.shared_folder(spark).rstrip('/')}/cache-{uuid.uuid4().hex}")
    cache.store(fetched)
    cache.store(fetched)
    wanted = table(spark, sf_dir, "customer").select("c_custkey", ask(C("c_custkey")).alias("key"))
    hits, misses = cache.split(wanted)
    found = hits.join(cache.index(), "key").select("c_custkey", F.lit(True).alias("hit"), "sha256")
    return found.union(misses.select("c_custkey", F.lit(False), F.lit(None).cast("string")))


@query("sk2_export_summary", f"WITH {H} SELECT {q6('min(v)')} AS min, {q6('max(v)')} AS max, {q6('avg(v)')} AS mean, count(*) - count(v) AS nan_count FROM z")
def sk2(spark, sf_dir):
    s = sinks.summary(holes(spark, sf_dir))
    return s.select(r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"), "nan_count")


@query("sk3_json_reports", "SELECT '{\"l_returnflag\":\"' || l_returnflag || '\",\"n\":' || count(*) || ',\"units\":\"metres\"}' AS value FROM lineitem GROUP BY l_returnflag")
def sk3(spark, sf_dir):
    return sinks.report(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), {"units": "metres"})


@query("sk5_preview_levels", f"WITH {H}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM z) SELECT \"row\", col, {q6('CASE WHEN v IS NOT NULL THEN greatest(0, least(1, (v - a) / (b - a))) END')} AS level FROM z, q")
def sk5(spark, sf_dir):
    return sinks.preview(holes(spark, sf_dir)).select("row", "col", r6("level").alias("level"))


@query("sk6_mask_preview", f'WITH {G} SELECT CAST(floor("row" / 4.0) AS BIGINT) AS "row", CAST(floor(col / 4.0) AS BIGINT) AS col, avg(CAST(v > 0 AS INTEGER)) > 0.5 AS on_ FROM g, (SELECT max("row") + 1 AS h FROM g) WHERE "row" < floor(h / 4.0) * 4 GROUP BY 1, 2')
def sk6(spark, sf_dir):
    m = T.block_mean(grid(spark, sf_dir).withColumn("v", (C("v") > 0).cast("double")), 4)
    return m.select("row", "col", (C("v") > 0.5).alias("on_"))


@query("sk9_fit_plot_histogram", f"WITH {S}, d AS (SELECT p - q AS e FROM s), m AS (SELECT quantile_cont(abs(e), 0.99) AS m FROM d) SELECT CAST(least(floor((e + m) / (2 * m / 60)), 59) AS BIGINT) AS bin, count(*) AS n FROM d, m WHERE abs(e) <= m GROUP BY 1")
def sk9(spark, sf_dir):
    # the quantile takes several passes: the pairs are joined once
    d = graph.cut(pairs(spark, sf_dir).select((C("p") - C("q")).alias("e")))
    m = F.lit(E.exact_quantiles(d, {"m": (F.abs("e"), 0.99)})["m"]).cast("double")
    return d.select(R.histogram_bin(C("e"), -m, m, 60).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


@query("sk11_layer_upsert_so5", "SELECT s_suppkey AS id, s_name AS title, 2 AS version FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier WHERE s_suppkey % 3 <> 0")
def sk11(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("title"), F.lit(1).alias("version"))
    return R.upsert(s, s.filter("id % 3 = 0").withColumn("version", F.lit(2)), "id")


@query("sk13_markdown_rows", "SELECT '| ' || l_returnflag || ' | ' || count(*) || ' | ' || printf('%.2f', avg(l_quantity)) || ' |' AS line FROM lineitem GROUP BY l_returnflag")
def sk13(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return sinks.markdown(a, ["l_returnflag", "n", "q"])


@query("pf11_radiometry", "WITH s AS (SELECT max(l_partkey) AS top FROM lineitem), b AS (SELECT pow(2, greatest(8, ceil(log2(top + 1)))) - 1 AS f FROM s) SELECT l_partkey, any_value(CAST(least(255, greatest(0, round_even(l_partkey * 255.0e0 / f, 0))) AS INTEGER)) AS byte FROM lineitem, b GROUP BY 1")
def pf11(spark, sf_dir):
    x = sinks.radiometry(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", "bit_depth")
    return x.distinct()


@query("pf12_stretch", "WITH q AS (SELECT quantile_cont(l_partkey, 0.005) AS a, quantile_cont(l_partkey, 0.995) AS b FROM lineitem) SELECT l_partkey, any_value(CAST(round_even(greatest(0, least(255, (l_partkey - a) / (b - a) * 255)), 0) AS INTEGER)) AS byte FROM lineitem, q GROUP BY 1")
def pf12(spark, sf_dir):
    return sinks.radiometry(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", "stretch").distinct()


@query("ag28_dataset_audit", f"WITH {G} SELECT label, count(*) AS n, {q6('count(*) / (SELECT count(*) FROM g)')} AS share, {q6('quantile_cont(v, 0.05)')} AS p5, {q6('median(v)')} AS med, {q6('quantile_cont(v, 0.95)')} AS p95, {q6('avg(CAST(v < 0 AS INTEGER))')} AS negative FROM g GROUP BY label")
def ag28(spark, sf_dir):
    a = N.audit(grid(spark, sf_dir), "label", "v")
    return a.select("label", "n", *(r6(c).alias(c) for c in ("share", "p5", "med", "p95", "negative")))


@query("ag29_summary_medians", f"WITH {S}, t AS (SELECT p_brand, l_returnflag, corr(p, q) AS r, median(p - q) AS m, count(*) AS n FROM s GROUP BY 1, 2) SELECT l_returnflag, {q6('median(r)')} AS median_r, CAST(count_if(r < 0) AS BIGINT) AS negative, {q6('median(m) FILTER (WHERE n > 500)', 4)} AS median_error FROM t GROUP BY 1")
def ag29(spark, sf_dir):
    t = pairs(spark, sf_dir).groupBy("p_brand", "l_returnflag").agg(E.correlation("p", "q").alias("r"), F.median(C("p") - C("q")).alias("m"), F.count("*").alias("n"))
    x = N.correlation_summary(t, "l_returnflag", "r", "m", "n", 500)
    return x.select("l_returnflag", r6("median_r").alias("median_r"), "negative", r6("median_error", 4).alias("median_error"))


@query("ag30_scale_shift_invariant_loss", f"""WITH {G}, m AS (SELECT label, quantile_disc(v, 0.5) AS t, quantile_disc(v * v, 0.5) AS u FROM g GROUP BY label), s AS (SELECT g.label AS label, greatest(avg(abs(v - t)), 1e-6) AS a, greatest(avg(abs(v * v - u)), 1e-6) AS b FROM g JOIN m USING (label) GROUP BY 1)
SELECT label, {q6('avg(abs((v - t) / a - (v * v - u) / b))')} AS loss FROM g JOIN m USING (label) JOIN s USING (label) GROUP BY label""")
def ag30(spark, sf_dir):
    g = grid(spark, sf_dir).select("label", "v", (C("v") * C("v")).alias("square"))
    return N.scale_shift_invariant_loss(g, "label", "v", "square").select("label", r6("loss").alias("loss"))


@query("ag31_validation_medians", f"""WITH {S}, f AS (SELECT p_brand, l_returnflag, regr_slope(q, p) AS a, regr_intercept(q, p) AS b, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 100), e AS (SELECT s.p_brand AS p_brand, s.l_returnflag AS k, sqrt(avg((a * p + b - q) * (a * p + b - q))) AS rmse FROM s JOIN f ON s.p_brand = f.p_brand AND s.l_returnflag = f.l_returnflag GROUP BY 1, 2)
SELECT k AS l_returnflag, {q6('median(rmse)', 4)} AS rmse FROM e GROUP BY 1""")
def ag31(spark, sf_dir):
    m = E.affine_fitted_metrics(pairs(spark, sf_dir), "p", "q", ["p_brand", "l_returnflag"]).filter("n >= 100")
    return m.groupBy("l_returnflag").agg(r6(F.median("rmse"), 4).alias("rmse"))


@query("ag32_latency_stats", f"SELECT event_type, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std, {q6('min(value)')} AS lowest, {q6('median(value)')} AS med FROM events GROUP BY 1")
def ag32(spark, sf_dir):
    x = N.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return x.select("event_type", *(r6(c).alias(c) for c in ("mean", "std", "lowest", "med")))


@query("ag41_content_hashes", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def ag41(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.content_hash(C("html")).alias("sha256"))


@query("ag44_queue_counters_ag45_statuses", "SELECT o_orderpriority, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS queued, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS running, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS done FROM orders GROUP BY 1")
def ag44(spark, sf_dir):
    return N.queue_counters(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", {"queued": "O", "running": "P", "done": "F"})


@query("ag46_environment_report", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size < 8 THEN 'little memory' END, CASE WHEN p_retailprice < 1000 THEN 'old driver' END) AS issues, p_size >= 8 AND p_retailprice >= 1000 AS ready FROM part")
def ag46(spark, sf_dir):
    found, ready = N.issues([(C("p_size") < 8, "little memory"), (C("p_retailprice") < 1000, "old driver")])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("issues"), ready.alias("ready"))


@query("tk5_done_jobs_newest_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def tk5(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return N.newest_first(done, "o_orderdate", "o_orderkey", 50)


@query("tk6_layers_by_stage", "SELECT o_orderkey, r FROM orders JOIN (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) AS x(p, r) ON o_orderpriority = p")
def tk6(spark, sf_dir):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return N.ranked_layers(table(spark, sf_dir, "orders"), "o_orderpriority", order, "o_orderkey").select("o_orderkey", "r")


@query("tk8_best_checkpoint", "SELECT user_id, arg_min(event_id, (value, event_id)) AS best, min(value) AS value FROM events GROUP BY 1")
def tk8(spark, sf_dir):
    return N.best_by(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("tk8_running_minimum", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events")
def tk8r(spark, sf_dir):
    return N.running_minimum(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "best")


@query("tk9_hashed_sample", f"WITH {G} SELECT \"row\", col, v FROM g ORDER BY md5(concat_ws(':', \"row\", col, 7)), \"row\", col LIMIT 5000")
def tk9(spark, sf_dir):
    return R.hashed_sample(grid(spark, sf_dir).select("row", "col", "v"), 5000, 7, "row", "col")


@query("so1_mosaic_first_wins", f'WITH {G} SELECT "row", col, CASE WHEN label < 5 THEN v ELSE v * 2 END AS v FROM g')
def so1(spark, sf_dir):
    g = grid(spark, sf_dir)
    return K.first_wins(g.filter("label < 5"), g.withColumn("v", C("v") * 2))


@query("so2_mask_union", f'WITH {G} SELECT "row", col FROM g WHERE v > 0.2 OR label = 3')
def so2(spark, sf_dir):
    g = grid(spark, sf_dir)
    return N.union_of(g.filter("v > 0.2"), g.filter("label = 3"))


@query("so3_mask_intersection", f'WITH {G} SELECT "row", col FROM g WHERE v > 0.1 AND label = 3')
def so3(spark, sf_dir):
    g = grid(spark, sf_dir)
    return N.common_to(g.filter("v > 0.1"), g.filter("label = 3"))


@query("so4_mask_difference", f'WITH {G} SELECT "row", col FROM g WHERE v > 0.1 AND label <> 3')
def so4(spark, sf_dir):
    g = grid(spark, sf_dir)
    return N.without(g.filter("v > 0.1"), g.filter("label = 3"))


@query("so6_ordered_dedup", "WITH o AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM o GROUP BY 1")
def so6(spark, sf_dir):
    x = N.in_order_once(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    return x.select("user_id", F.array_join("items", ",").alias("types"))


@query("so7_id_intersection", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def so7(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return N.common_to(table(spark, sf_dir, "documents"), good, ("doc_id",))


@query("sk1_guarded_surface_kinds", "SELECT * FROM (VALUES ('relative', 'none', false), ('relative', 'metres', true), ('absolute', 'metres', false), ('absolute', 'feet', true)) AS x(kind, units, refused)")
def sk1(spark, sf_dir):
    rows = []
    for kind, units in (("relative", "none"), ("relative", "metres"), ("absolute", "metres"), ("absolute", "feet")):
        try:
            sinks.check_surface(kind, units, "EPSG:32644", "EGM2008")
            rows.append((kind, units, False))
        except ValueError:
            rows.append((kind, units, True))
    return spark.createDataFrame(rows, "kind string, units string, refused boolean")


@query("sk4_confidence_bands", f'WITH {G}, b AS (SELECT "row", col, label, CASE WHEN abs(v) < 0.02 THEN 1 ELSE 0 END | CASE WHEN label = 2 THEN 4 ELSE 0 END AS bits FROM g) SELECT "row", col, CASE WHEN bits > 0 THEN 1 ELSE 2 END AS band1, bits AS band2 FROM b')
def sk4(spark, sf_dir):
    from terraloom.functions import scalars as X

    b = grid(spark, sf_dir).withColumn("bits", X.confidence_reasons(F.abs("v"), F.abs("v") < 0.02, water=C("label") == 2))
    return b.select("row", "col", X.confidence_level(C("v"), C("bits")).alias("band1"), C("bits").alias("band2"))


@query("sk7_slope_levels", f"""WITH {G}, n AS (SELECT "row", col, v, lag(v) OVER c AS west, lead(v) OVER c AS east, lag(v) OVER r AS north, lead(v) OVER r AS south FROM g WINDOW c AS (PARTITION BY "row" ORDER BY col), r AS (PARTITION BY col ORDER BY "row")),
d AS (SELECT "row", col, (coalesce(east, v) - coalesce(west, v)) / CASE WHEN east IS NULL OR west IS NULL THEN 0.1e0 ELSE 0.2e0 END AS gx, (coalesce(south, v) - coalesce(north, v)) / CASE WHEN south IS NULL OR north IS NULL THEN 0.1e0 ELSE 0.2e0 END AS gy FROM n)
SELECT "row", col, {q6('greatest(0, least(1, degrees(atan(sqrt(gx * gx + gy * gy))) / 60))')} AS level FROM d""")
def sk7(spark, sf_dir):
    x = T.slope(grid(spark, sf_dir).select("row", "col", "v"), (0.1, 0.1))
    return x.select("row", "col", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("slope") / 60))).alias("level"))


@query("sk8_tile_overlay", f"WITH {TILES} SELECT CAST(i AS INTEGER) AS tile_id, r / 2.0e0 AS top, 0.0e0 AS left_, th / 2.0e0 AS height, tw / 2.0e0 AS width FROM t")
def sk8(spark, sf_dir):
    return plan(spark, sf_dir)[3].select("tile_id", (C("row0") / 2).alias("top"), (C("col0") / 2).alias("left_"), (C("h") / 2).alias("height"), (C("w") / 2).alias("width"))


@query("sk10_binary_mesh", f"WITH {G} SELECT CAST(1 AS BIGINT) AS files, count(*) AS vertices, CAST((max(\"row\") * max(col)) * 2 AS BIGINT) AS faces FROM g")
def sk10(spark, sf_dir):
    v, f = T.mesh(grid(spark, sf_dir).select("row", "col", "v"), 1.0, 1.0)
    path = f"{graph.shared_folder(spark).rstrip('/')}/terraloom-{uuid.uuid4().hex}.glb"
    n, m = sinks.write_glb(path, v, f)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    file = fs.open(at)
    try:
        head = bytes(file.readNBytes(12))
    finally:
        file.close()
    whole = head[:4] == b"glTF" and int.from_bytes(head[8:], "little") == fs.getFileStatus(at).getLen()
    fs.delete(at, False)
    return spark.createDataFrame([(int(whole), n, m)], "files long, vertices long, faces long")


_SHIFTED = 'v + 0.4 - 0.001 * "row"'


@query("sk15_surface_to_egm2008_dt4", f'WITH {G} SELECT "row", col, {q6(_SHIFTED, 5)} AS h FROM g')
def sk15(spark, sf_dir):
    from terraloom.operators import regrid as J
    from terraloom.plans import joins

    lattice = joins.lattice(spark, grid(spark, sf_dir))
    a, b = lattice.withColumn("v", F.lit(0.4)), lattice.withColumn("v", 0.008 * C("row"))
    x = J.convert_datum(grid(spark, sf_dir).select("row", "col", C("v").alias("h")), a, b, C("row") / 8, C("col") / 8, ["row", "col"])
    return x.select("row", "col", r6("h", 5).alias("h"))


def _crops(spark):
    rows = [(i, 6, 8, bytearray(((np.arange(6 * 8 * 3) * (i + 1)) % 256).astype(np.uint8).tobytes())) for i in range(5)]
    return spark.createDataFrame(rows, "tile_id long, h int, w int, rgb binary")


@query("ud1_predictor_interface_ud2_registry", "SELECT i AS tile_id, CAST(sum(3 * k * (i + 1) % 256) AS DOUBLE) AS total, count(*) AS n FROM range(5) a(i), range(48) b(k) GROUP BY 1")
def ud1(spark, sf_dir):
    from terraloom.functions.predictors import predict

    p = predict(_crops(spark), "red")
    return p.select("tile_id", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("data").cast("long").alias("n"))


@query("pf48_predictor_contract", "SELECT i AS tile_id, true AS shape_ok FROM range(5) a(i)")
def pf48(spark, sf_dir):
    from terraloom.functions.predictors import predict

    return predict(_crops(spark), "half").select("tile_id", (F.size("data") == C("h") * C("w")).alias("shape_ok"))


@query("ag45_benchmark_matrix", "SELECT p_brand, CASE WHEN p_size > 45 THEN 'OOM' WHEN p_retailprice < 950 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n FROM part GROUP BY 1, 2")
def ag45(spark, sf_dir):
    status = N.first_status([(C("p_size") > 45, "OOM"), (C("p_retailprice") < 950, "ERROR")], "OK")
    return table(spark, sf_dir, "part").groupBy("p_brand", status.alias("status")).agg(F.count("*").alias("n"))


@query("sk12_job_log_append", "SELECT event_id, event_type FROM events")
def sk12(spark, sf_dir):
    from terraloom.operators import graph
    from terraloom.streaming import events as V

    path = f"{graph.shared_folder(spark).rstrip('/')}/log-{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 60)}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    V.append(e.filter("event_id % 2 = 0"), path)
    V.append(e.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string").json(path)
