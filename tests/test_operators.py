"""Known answers, invariants and refusals of the library's operators."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import scalars as X
from terraloom.operators import calibration, errors, graph, ground, regrid, relational, terrain, tiles
from terraloom.sources import catalog, osm, raster, sinks
from terraloom.streaming import events


def raster_df(spark, a):
    h, w = a.shape
    return spark.createDataFrame([(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)], "row long, col long, v double")


def array(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", F.col(v).cast("double").alias("x")).collect():
        out[r["row"], r["col"]] = np.nan if r["x"] is None else r["x"]
    return out


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (4.0, 6.0), (9.0, 8.0), (None, 1.0), (1.0, None)], "p double, r double")
    m = errors.error_metrics(df, "p", "r").first()
    d = np.array([1.0, 1.0, -2.0, 1.0])
    assert (m["n"], m["excluded_nodata"]) == (4, 2)
    assert m["bias"] == pytest.approx(d.mean()) and m["rmse"] == pytest.approx(np.sqrt((d**2).mean()))
    assert m["nmad"] == pytest.approx(1.4826 * np.median(abs(d - np.median(d)))) and m["le90"] == pytest.approx(np.percentile(abs(d), 90))
    assert m["pearson_r"] == pytest.approx(np.corrcoef([1, 3, 4, 9], [0, 2, 6, 8])[0, 1]) and m["r2"] == pytest.approx(1 - 7 / 40)


def test_metrics_of_constants_and_nothing(spark):
    flat = errors.error_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "p double, r double"), "p", "r").first()
    assert flat["pearson_r"] is None and flat["r2"] is None and flat["bias"] == -0.5
    none = errors.error_metrics(spark.createDataFrame([(None, 2.0)], "p double, r double"), "p", "r").first()
    assert none["n"] == 0 and none["rmse"] is None
    assert errors.affine_fit(spark.createDataFrame([(1.0, 2.0)], "p double, r double"), "p", "r").first()["fitted"] is False


def test_lowpass_is_nodata_aware_and_keeps_constants(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 24))
    a[rng.random(a.shape) < 0.3] = np.nan
    got = array(terrain.lowpass(raster_df(spark, a), 4), a.shape, "low")
    pad = np.pad(a, 2, mode="symmetric")
    for r in range(20):
        for c in range(24):
            w = pad[r : r + 5, c : c + 5]
            ok = np.isfinite(w)
            assert (np.isnan(got[r, c]) and ok.mean() <= 0.5) or got[r, c] == pytest.approx(w[ok].mean())
    assert np.allclose(array(terrain.lowpass(raster_df(spark, np.full((9, 9), 3.0)), 5), (9, 9), "low"), 3)


def test_gradient_slope_and_hillshade(spark):
    a = np.add.outer(2.0 * np.arange(12), 3.0 * np.arange(15)) + np.random.default_rng(1).normal(size=(12, 15))
    gy, gx = np.gradient(a, 0.5, 2.0)
    s = terrain.slope(raster_df(spark, a), (2.0, 0.5))
    assert np.allclose(array(s, a.shape, "slope"), np.degrees(np.arctan(np.hypot(gx, gy))))
    flat = array(terrain.hillshade(raster_df(spark, np.zeros((5, 5))), (1.0, 1.0)), (5, 5), "shade")
    assert np.allclose(flat, np.sin(np.radians(45)))


def test_morphology(spark):
    a = np.zeros((9, 9))
    a[2:7, 2:7] = 1
    df = raster_df(spark, a).withColumn("mask", F.col("v") == 1)
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert array(terrain.morph(df, square, True), a.shape, "mask").sum() == 9
    assert array(terrain.morph(df, square, False), a.shape, "mask").sum() == 49
    assert array(terrain.binary_opening(df), a.shape, "mask").sum() == 25
    tower = np.zeros((30, 30))
    tower[10:14, 10:14] = 20
    assert np.allclose(array(terrain.grey_opening(raster_df(spark, tower), 7), (30, 30), "ground"), 0)


def test_area_average_conserves_and_blocks_match(spark):
    a = np.arange(48.0).reshape(6, 8)
    got = terrain.area_average(raster_df(spark, a), 1.5, 2.0)
    assert got.agg(F.sum(F.col("v") * F.col("coverage") * 3.0)).first()[0] == pytest.approx(a.sum())
    b = array(terrain.block_mean(raster_df(spark, a), 4), (1, 2))
    assert np.allclose(b, a[:4].reshape(1, 4, 2, 4).mean(axis=(1, 3)))


def test_bilinear_reproduces_a_plane(spark):
    coarse = raster_df(spark, np.add.outer(10.0 * np.arange(6), 3.0 * np.arange(7)))
    fine = spark.createDataFrame([(r, c) for r in range(20) for c in range(24)], "row long, col long")
    x = regrid.bilinear(fine, coarse, F.col("row") / 4, F.col("col") / 4, ["row", "col"])
    assert x.filter(F.abs(F.col("ref") - (2.5 * F.col("row") + 0.75 * F.col("col"))) > 1e-9).count() == 0
    out = regrid.bilinear(fine, coarse, F.col("row") / 2, F.col("col") / 2, ["row", "col"], extrapolate=True, size=(6, 7))
    assert out.filter(F.abs(F.col("ref") - (5 * F.col("row") + 1.5 * F.col("col"))) > 1e-9).count() == 0


def test_datum_refusals(spark):
    one = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, h double")
    grid = spark.createDataFrame([(5, 5, 1.0)], "row long, col long, v double")
    with pytest.raises(Exception, match="no geoid grid"):
        regrid.convert_datum(one, grid, grid, F.col("row"), F.col("col"), ["row", "col"]).collect()
    with pytest.raises(Exception, match="missing geoid grid"):
        regrid.require_grids(spark.createDataFrame([("a",)], "grid string"), spark.createDataFrame([("b",)], "grid string")).collect()
    with pytest.raises(Exception, match="unknown vertical datum"):
        spark.range(1).select(X.require_datum(F.lit("mean sea level"))).collect()


def test_building_heights_recover_boxes(spark):
    a = np.add.outer(0.01 * np.arange(60), np.zeros(60))
    ids = []
    for k, (r, c, h) in enumerate([(10, 10, 12.0), (10, 35, 20.0), (35, 20, 6.0)], 1):
        a[r : r + 14, c : c + 14] += h
        ids += [(k, i, j) for i in range(r, r + 14) for j in range(c, c + 14)]
    got = regrid.building_heights(raster_df(spark, a), spark.createDataFrame(ids, "id int, row long, col long"), terrain.ellipse(2), terrain.ellipse(4))
    assert {r["id"]: round(r["height"], 1) for r in got.collect()} == {1: 12.0, 2: 20.0, 3: 6.0}


def test_polygons(spark):
    ring = [(1.0, 1.0), (9.0, 1.0), (9.0, 5.0), (5.0, 5.0), (5.0, 9.0), (1.0, 9.0), (1.0, 1.0)]
    p = spark.createDataFrame([(1, ring), (2, [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)])], "id int, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in p.select(regrid.ring_area(F.col("ring"))).collect()] == [48.0, 4.0]
    px = regrid.rasterize(p).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in px} == {1: 44, 2: 4}


def test_huber_resists_outliers_and_ransac_agrees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    y = 4 * x + 100 + 0.5 * rng.normal(size=3000) + 80 * (rng.random(3000) < 0.05)
    a, b, _ = calibration.huber(x, y)
    assert abs(a - 4) < 0.05 and abs(b - 100) < 0.5
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "x double, y double")
    f = calibration.huber_fit(df, "x", "y")
    assert abs(f["a"] - a) < 1e-2 and abs(f["b"] - b) < 1e-2
    r = calibration.ransac_fit(df, "x", "y")
    assert abs(r["a"] - 4) < 0.3 and r["inlier_fraction"] > 0.5
    assert 0 < calibration.bootstrap_std(df, "x", "y", times=8)["a_std"] < 0.2
    with pytest.raises(ValueError, match="cannot fit"):
        calibration.huber_fit(df.limit(50), "x", "y")


def test_gate_reasons(spark):
    g = calibration.Gate()
    why = lambda *a: spark.range(1).select(calibration.gate_reasons(*a).alias("w")).first()["w"]
    lit = lambda v: F.lit(v).cast("double")
    assert why(lit(1.0), lit(2.0), lit(1.0), g) == []
    assert len(why(lit(0.5), lit(-1.0), lit(99.0), g)) == 3 and len(why(lit(1.0), lit(1.0), lit(float("nan")), g)) == 1
    assert len(why(lit(1.0), lit(1.0), lit(None), g, lit(0.9))) == 1


def test_sequential_and_joint_alignment_undo_tile_errors(spark):
    spark.sparkContext.setCheckpointDir("/tmp/terraloom-test-checkpoints")
    y, x = np.mgrid[0:60, 0:90]
    z = np.sin(y / 7.0) + np.cos(x / 5.0) + 0.3 * np.sin(x * y / 50.0)
    plan = tiles.plan(spark, 60, 90, 50, 20)
    rows = plan.orderBy("tile_id").collect()
    assert [(r["row0"], r["col0"]) for r in rows] == [(0, 0), (0, 30), (0, 40), (10, 0), (10, 30), (10, 40)]
    rng = np.random.default_rng(1)
    params = [(1.0, 0.0)] + [(float(rng.uniform(0.5, 2)), float(rng.uniform(-3, 3))) for _ in rows[1:]]
    data = [(r["tile_id"], i, j, params[k][0] * float(z[i, j]) + params[k][1]) for k, r in enumerate(rows) for i in range(r["row0"], r["row0"] + r["h"]) for j in range(r["col0"], r["col0"] + r["w"])]
    preds = spark.createDataFrame(data, "tile_id int, row long, col long, p double").cache()
    m, _ = tiles.align_sequential(preds, [r.asDict() for r in rows], 20)
    assert np.abs(array(m, z.shape) - z).max() < 1e-6
    fits = tiles.align_joint(preds, plan, 60, 90, plane=False, hp_px=5, min_strip_px=10, step=2)
    for f, (a, b) in zip(fits, params, strict=True):
        assert f["a"] == pytest.approx(1 / a, rel=0.05) and f["b"] == pytest.approx(-b / a, abs=0.3)
    with pytest.raises(ValueError):
        tiles.starts(10, 5, 5)


def test_sequential_alignment_of_noisy_tiles(spark, monkeypatch):
    """Against a plain loop over tiles, where up to four tiles share a pixel; with nodata."""
    spark.sparkContext.setCheckpointDir("/tmp/terraloom-test-checkpoints")
    rows = [r.asDict() for r in tiles.plan(spark, 60, 90, 40, 16).orderBy("tile_id").collect()]
    rng = np.random.default_rng(8)
    z = rng.normal(size=(60, 90))
    ps = {r["tile_id"]: rng.uniform(0.5, 2) * z[r["row0"] : r["row0"] + 40, r["col0"] : r["col0"] + 40] + rng.normal(size=(40, 40)) + 50 for r in rows}
    for p in ps.values():
        p[rng.uniform(size=p.shape) < 0.05] = np.nan
    at = np.arange(40)
    d = np.minimum(at, 39 - at)
    ramp = np.where(d < 16, 0.5 - 0.5 * np.cos(np.pi * (d + 1) / 17), 1.0)
    top, weight, want = np.zeros((60, 90)), np.zeros((60, 90)), []
    for r in rows:
        part, p = np.s_[r["row0"] : r["row0"] + 40, r["col0"] : r["col0"] + 40], ps[r["tile_id"]]
        both = (weight[part] > 0) & ~np.isnan(p)
        a, b = np.polyfit(p[both], (top[part] / np.where(weight[part] > 0, weight[part], 1))[both], 1) if both.sum() >= 64 else (1.0, 0.0)
        w = np.where(np.isnan(p), 0.0, np.minimum.outer(ramp, ramp))
        top[part] += w * np.nan_to_num(a * p + b)
        weight[part] += w
        want.append((a, b, int(both.sum())))
    data = [(t, r["row0"] + i, r["col0"] + j, None if np.isnan(p[i, j]) else float(p[i, j])) for r in rows for t, p in [(r["tile_id"], ps[r["tile_id"]])] for i in range(40) for j in range(40)]
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: cuts.append(1) or f(df))
    m, fits = tiles.align_sequential(spark.createDataFrame(data, "tile_id int, row long, col long, p double"), rows, 16)
    # tables between steps don't grow in number with the tiles
    assert len(cuts) == 1
    for f, (a, b, n) in zip(fits, want, strict=True):
        assert f["overlap_px"] == n and f["a"] == pytest.approx(a, rel=1e-9) and f["b"] == pytest.approx(b, rel=1e-9, abs=1e-9)
    with np.errstate(invalid="ignore"):
        assert np.allclose(array(m, z.shape), top / np.where(weight > 0, weight, np.nan), equal_nan=True)


def test_blending_copies_a_consistent_image(spark):
    z = np.random.default_rng(2).normal(size=(30, 40))
    d = tiles.deal(raster_df(spark, z), 30, 40, 16, 6)
    assert d.select(F.min(tiles.blend_weight(6))).first()[0] > 0
    assert np.allclose(array(tiles.blend(d, 6, "v"), z.shape), z)
    with pytest.raises(Exception, match="the model returned"):
        tiles.predict(d.withColumn("tile_id", F.lit(1)).filter("row0 = 0 AND col0 = 0"), lambda a: a[..., 0][:-1], ["v"]).collect()


def test_ground_under_boxes_on_a_slope(spark):
    z = np.add.outer(0.02 * np.arange(80), 0.01 * np.arange(80)) + 100
    true = z.copy()
    for r, c in ((15, 15), (45, 50)):
        z[r : r + 12, c : c + 12] += 10
    g = ground.estimate_ground(raster_df(spark, z), 40)
    assert np.abs(array(g, z.shape, "ground") - true).max() < 0.5
    nd = array(g, z.shape, "ndsm")
    assert nd.min() >= 0 and np.median(nd[17:25, 17:25]) == pytest.approx(10, abs=0.5)


def test_components_touch_at_corners(spark):
    a = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 0]])
    px = [(r, c) for r in range(4) for c in range(4) if a[r, c]]
    got = {(r["row"], r["col"]): r["label"] for r in graph.pixel_components(spark.createDataFrame(px, "row long, col long"), 4).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (0, 3): 3, (2, 3): 11, (3, 2): 11, (3, 0): 12}


def test_shadow_of_a_box(spark):
    fp = [(r, c, 1) for r in range(60, 90) for c in range(60, 90)]
    dark = {(r - k, c - k) for r, c, _ in fp for k in range(1, 29)} - {(r, c) for r, c, _ in fp}
    f = spark.createDataFrame(fp, "row long, col long, id int")
    s = spark.createDataFrame(sorted(dark), "row long, col long")
    best = ground.best_direction(ground.shadow_azimuth(s, f, 150, 150, 0.5)).first()
    assert abs(best["direction"] - 315) <= 12 and best["best"] > 0.9
    h = ground.shadow_heights(s, f, 150, 150, 0.5, 135.0, 45.0).first()
    assert h["height"] == pytest.approx(28 * 2**0.5 * 0.5, rel=0.1) and not h["truncated"]


def test_sun_at_solstice_and_equinox(spark):
    t = [dt.datetime(2024, 6, 20, 12, tzinfo=dt.UTC), dt.datetime(2024, 3, 20, 12, tzinfo=dt.UTC)]
    df = spark.createDataFrame([(0.0, 51.5, x.timestamp()) for x in t], "lon double, lat double, t double")
    el, az = X.solar_position(F.col("lon"), F.col("lat"), F.col("t"))
    a, b = df.select(el.alias("e"), az.alias("a")).collect()
    assert a["e"] == pytest.approx(90 - 51.5 + 23.44, abs=0.1) and b["e"] == pytest.approx(90 - 51.5, abs=0.3) and abs(a["a"] - 180) < 3


def test_utm_of_a_known_place(spark):
    lon, lat = F.lit(78.0), F.lit(30.0)
    x, y = X.to_utm(lon, lat, F.lit(44))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(210590.35, abs=0.1) and r["y"] == pytest.approx(3322575.90, abs=0.1)


def test_osm_refuses_entities(spark):
    bad = spark.createDataFrame([('<!DOCTYPE a [<!ENTITY b "c">]><osm><node id="1" lon="1" lat="1"/></osm>',)], "xml string")
    with pytest.raises(Exception, match="refused"):
        osm.nodes(bad).collect()


# ------------------------------------------------------------------ files
def tiff(a, compress, tiled):
    """A little-endian single-band float TIFF with a georeference."""
    h, w = a.shape
    blocks = [a[y : y + 16, x : x + 16] for y in range(0, h, 16) for x in range(0, w, 16)] if tiled else [a[y : y + 7] for y in range(0, h, 7)]
    if tiled:
        blocks = [np.pad(b, ((0, 16 - b.shape[0]), (0, 16 - b.shape[1]))) for b in blocks]
    data = [zlib.compress(b.tobytes()) if compress else b.tobytes() for b in blocks]
    at, offsets = 8, []
    for d in data:
        offsets.append(at)
        at += len(d)
    extra, entries = b"", []

    def add(tag, kind, values, code):
        nonlocal extra
        raw = values.encode() + b"\0" if kind == 2 else struct.pack("<" + code * len(values), *values)
        n = len(raw) if kind == 2 else len(values)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, n, at + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)

    add(256, 3, [w], "H"), add(257, 3, [h], "H"), add(258, 3, [32], "H"), add(259, 3, [8 if compress else 1], "H"), add(277, 3, [1], "H")
    if tiled:
        add(322, 3, [16], "H"), add(323, 3, [16], "H"), add(324, 4, offsets, "I"), add(325, 4, [len(d) for d in data], "I")
    else:
        add(273, 4, offsets, "I"), add(278, 3, [7], "H"), add(279, 4, [len(d) for d in data], "I")
    add(339, 3, [3], "H"), add(33550, 12, [2.0, 2.0, 0.0], "d"), add(33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0], "d"), add(34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32644], "H"), add(42113, 2, "-9999", "")
    ifd = at + len(extra)
    return struct.pack("<2sHI", b"II", 42, ifd) + b"".join(data) + extra + struct.pack("<H", len(entries)) + b"".join(sorted(entries)) + struct.pack("<I", 0)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff(spark, compress, tiled):
    a = np.random.default_rng(3).normal(size=(20, 33)).astype("<f4")
    a[3, 4] = -9999
    files = spark.createDataFrame([("x.tif", bytearray(tiff(a, compress, tiled)))], "path string, content binary")
    m = raster.metadata(files).first()
    assert (m["crs"], m["transform"], m["nodata"], m["georef_issue"]) == ("EPSG:32644", [2.0, 0.0, 500.0, 0.0, -2.0, 900.0], -9999.0, None)
    got = array(raster.long_grid(raster.tiles(files, 8)), a.shape)
    assert np.isnan(got[3, 4]) and np.allclose(np.where(np.isnan(got), -9999, got), a)


def test_binary_source_and_unknown_formats(spark, tmp_path):
    a = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(raster.write_png(a))
    got = raster.long_grid(raster.tiles(raster.read(spark, f"file://{tmp_path}")))
    assert got.count() == 60 and got.filter("band = 2 AND row = 1 AND col = 1 AND v = 20").count() == 1
    with pytest.raises(ValueError):
        raster.decode("x.jp2", b"\0" * 20)


def test_guarded_writer(spark, tmp_path):
    df = raster_df(spark, np.array([[1.0, np.nan], [3.0, 5.0]]))
    with pytest.raises(ValueError):
        sinks.write_surface(df, str(tmp_path / "a"), "relative", "metres")
    with pytest.raises(ValueError):
        sinks.write_surface(df, str(tmp_path / "a"), "absolute", "metres", "EPSG:32644", None)
    sinks.write_surface(df, f"file://{tmp_path}/b", "absolute", "metres", "EPSG:32644", "EGM2008", {"source": "test"})
    side = spark.read.json(f"file://{tmp_path}/b/sidecar").first()
    assert (side["min"], side["max"], side["nan_count"], side["vertical_datum"]) == (1.0, 5.0, 1, "EGM2008")
    assert spark.read.parquet(f"file://{tmp_path}/b/grid").count() == 4


def test_glb_and_mesh(spark):
    v, f = terrain.mesh(raster_df(spark, np.array([[0.0, 1.0, 2.0], [1.0, 2.0, 3.0], [np.nan, 1.0, 1.0]])), 1.0, 1.0)
    vs = np.array([[r["x"], r["y"], r["z"]] for r in v.orderBy("vid").collect()])
    fs = np.array([[r["a"], r["b"], r["c"]] for r in f.collect()])
    assert vs.shape == (9, 3) and fs.shape == (6, 3)
    b = sinks.glb(vs, fs)
    assert b[:4] == b"glTF" and struct.unpack("<I", b[8:12])[0] == len(b)
    with pytest.raises(Exception, match="all nodata"):
        terrain.mesh(raster_df(spark, np.full((2, 2), np.nan)), 1.0, 1.0)[0].collect()


def test_mesh_is_written_in_pieces(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir("/tmp/terraloom-test-checkpoints")
    a = np.random.default_rng(6).normal(size=(30, 20))
    a[4, 5] = np.nan
    v, f = terrain.mesh(raster_df(spark, a), 1.5, 2.0)
    vs = np.array([[r["x"], r["y"], r["z"]] for r in v.orderBy("vid").collect()])
    fs = sorted((r["a"], r["b"], r["c"]) for r in f.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    # the driver holds pieces, never the mesh
    monkeypatch.setattr(type(v), "toPandas", None)
    try:
        assert sinks.write_glb(f"file://{tmp_path}/m.glb", v, f) == (600, len(fs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, want = (tmp_path / "m.glb").read_bytes(), sinks.glb(vs, np.array(fs))
    body = len(want) - 12 * len(fs)
    assert got[:body] == want[:body] and len(got) == len(want)
    assert sorted(map(tuple, np.frombuffer(got[body:], "<u4").reshape(-1, 3).tolist())) == fs


def test_radiometry(spark):
    df = spark.range(256).select((F.col("id") * 8).cast("int").alias("v"))
    x = sinks.radiometry(df, "v", "bit_depth", nbits=11).collect()
    assert all(abs(r["byte"] - r["v"] / 8 * 255 / 255.875) < 1 for r in x)
    dark = sinks.radiometry(spark.range(100).select(F.col("id").cast("int").alias("v")), "v", "auto", nbits=16)
    assert dark.agg(F.max("byte")).first()[0] == 255


def test_upsert_and_sampling(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, t string")
    assert {tuple(r) for r in relational.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    ids = spark.range(1000)
    assert relational.hashed_sample(ids, 50, 1, "id").collect() == relational.hashed_sample(ids.repartition(7), 50, 1, "id").collect()
    assert catalog.sources(spark).count() == len(catalog.SOURCES)


def test_streams_close_windows_and_keep_state(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("j", i, base + dt.timedelta(minutes=10 * i), "done" if i == 20 else "running", "s", 1.0, 1.0) for i in range(21)]
    log = f"file://{tmp_path}/log"
    events.append(spark.createDataFrame(rows[:15], events.EVENT), log)
    s = events.stream(spark, log)
    out = events.drain(events.windowed(s, "time", "job", "1 hour", late="10 minutes"), "w1", f"file://{tmp_path}/c1")
    assert sorted(r["n"] for r in out.collect()) == [6, 6]
    live = lambda: events.live_status(events.stream(spark, log).select("job", F.col("type").alias("status"), "seq"))
    sink, memory = f"file://{tmp_path}/sink", f"file://{tmp_path}/c2"
    events.run_batches(live(), sink, memory)
    events.append(spark.createDataFrame(rows[15:], events.EVENT), log)
    events.run_batches(live(), sink, memory)
    seen = spark.read.json(sink).orderBy("seq").collect()
    assert [(r["status"], r["seq"]) for r in seen] == [("running", 14), ("done", 20)]
