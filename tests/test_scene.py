"""The composed pipeline, the request cache, records, files and alignment of many tiles."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom import scene
from terraloom.functions.predictors import Predictor
from terraloom.operators import calibration, errors, ground, records, terrain, tiles
from terraloom.sources import raster, sinks
from terraloom.sources.cache import RequestCache

SIDE = 128


def city(spark):
    """Smooth ground with blocks of 12 m; the image shows the height, the model the ground."""
    p = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).alias("row"), (F.col("id") % SIDE).alias("col"))
    block = F.when((F.col("row") % 40 < 12) & (F.col("col") % 40 < 12), 12.0).otherwise(0.0)
    height = 30 * F.sin(F.col("row") / 60) + 20 * F.cos(F.col("col") / 60)
    g = p.withColumn("level", F.rint(2 * (height + block) + 100).cast("int")).withColumn("dem", height + 5.0)
    return g.select("row", "col", *(F.col("level").alias(b) for b in "rgb")), g.select("row", "col", "dem", (F.col("row") < 3).alias("water"), F.lit(0.5).alias("dem_error"))


OPTIONS = scene.Options(tile=80, overlap=20, lowpass=45.0, block=20.0, ground_window=24.0, max_slope=60.0, mesh_side=32, gate=calibration.Gate(bootstrap=5))


def test_scene_from_image_to_mesh(spark, tmp_path):
    image, dem = city(spark)
    events, steps = [], []
    s = scene.Scene(image, (1.0, 1.0), "EPSG:32644", dem)
    layers, report = scene.build(s, Predictor("red", lambda c: c[..., 0] * 0.5), OPTIONS, events.append, lambda *a: steps.append(a))
    assert [e["type"] for e in events] == ["start", "done"] * len(scene.STAGES) and steps[-1] == ("Mesh", 1.0)
    assert report["product"]["kind"] == "absolute" and report["facts"]["calibration"]["metric"]
    assert report["facts"]["calibration"]["a"] == pytest.approx(1.0, abs=0.1)
    got = layers["surface"].join(dem, ["row", "col"]).join(image, ["row", "col"])
    off = got.select((F.col("v") - ((F.col("r") - 100) / 2 + 5)).alias("d")).agg(F.avg(F.abs("d"))).first()[0]
    assert off < 1.5
    tall = layers["heights"].filter("row % 40 BETWEEN 3 AND 8 AND col % 40 BETWEEN 3 AND 8").agg(F.median("v")).first()[0]
    assert 7 < tall < 13
    assert layers["uncertainty"].filter("row < 3 AND v IS NOT NULL").count() == 0
    assert report["facts"]["mesh"]["vertices"] == 32 * 32 and report["facts"]["tiling"]["tiles"] == 4
    scene.write(layers, report, f"file://{tmp_path}/out", "EPSG:32644")
    assert spark.read.parquet(f"file://{tmp_path}/out/surface/grid").count() == SIDE * SIDE


def test_scene_without_a_place_stays_relative(spark):
    image, dem = city(spark)
    events = []
    layers, report = scene.build(scene.Scene(image, issue="rotated grid"), Predictor("red", lambda c: c[..., 0]), OPTIONS, events.append)
    skipped = {e["stage"]: e["reason"] for e in events if e["type"] == "skipped"}
    assert set(skipped) == {"elevation", "calibration", "uncertainty", "heights", "slope"} and "rotated grid" in skipped["elevation"]
    assert report["product"] == {"kind": "relative", "units": "none", "reasons": ["rotated grid"]}
    assert layers["surface"].count() == SIDE * SIDE and report["facts"]["prediction"]["align"] == "joint"
    # a gate that refuses leaves a relative product too
    strict = scene.Options(**{**OPTIONS.__dict__, "gate": calibration.Gate(min_coverage=1.1)})
    _, refused = scene.build(scene.Scene(image, (1.0, 1.0), "EPSG:32644", dem), Predictor("red", lambda c: c[..., 0]), strict)
    assert refused["product"]["kind"] == "relative" and refused["product"]["reasons"]
    with pytest.raises(Exception, match="model returned|shape"):
        scene.build(scene.Scene(image), Predictor("bad", lambda c: c[..., 0][:0]), OPTIONS, events.append)
    assert events[-1]["type"] == "failed"


def test_request_cache(spark, tmp_path):
    cache = RequestCache(spark, f"file://{tmp_path}/cache")
    key = records.request_key(F.col("x"), F.col("y")).alias("key")
    asked = spark.createDataFrame([(1.0, 2.0, "a"), (1.00000001, 2.0, "b"), (3.0, 4.0, "c"), (None, 4.0, "d")], "x double, y double, text string").select(F.when(F.col("x").isNotNull(), key).alias("key"), "text")
    hits, misses = cache.split(asked)
    assert (hits.count(), misses.count()) == (0, 4)
    cache.store(asked.filter("text <> 'c'"), content="text")
    cache.store(asked, content="text")
    assert cache.index().count() == 2 and cache.index().select("key").distinct().count() == 2
    hits, misses = cache.split(asked)
    assert sorted(r["text"] for r in hits.collect()) == ["a", "b", "c"] and misses.count() == 1
    assert sorted(bytes(r["content"]).decode() for r in cache.read(hits.filter("text = 'c'")).collect()) == ["c"]
    assert cache.damaged().count() == 0
    spark.createDataFrame([("k", bytearray(b"x"), "0" * 64)], "key string, content binary, sha256 string").write.mode("append").parquet(cache.path)
    assert [r["key"] for r in cache.damaged().collect()] == ["k"]


def test_records(spark):
    g = spark.createDataFrame([(r, c, float(r * c)) for r in range(4) for c in range(4)], "row long, col long, v double")
    layer = g.filter("row < 2").select("row", "col", F.lit(7).alias("v"))
    x = records.optional_layer(g.select("row", "col"), layer, "landcover", "int")
    assert x.filter("landcover = 7 AND note IS NULL").count() == 8 and x.filter("landcover IS NULL AND note = 'no landcover'").count() == 8
    assert records.optional_layer(g, None, "water", "int").filter("water IS NULL").count() == 16
    with pytest.raises(ValueError, match="4 rows"):
        records.refuse_overlap(g, g.filter("row = 0"), ["row", "col"])
    records.refuse_overlap(g.filter("row = 1"), g.filter("row = 0"), ["row", "col"])
    with pytest.raises(ValueError, match="fit"):
        records.corner_crops(g, 10, 11)
    same = spark.createDataFrame([(1, float(v), 3.0 * v + 2) for v in range(20)], "image int, p double, t double")
    assert records.scale_shift_invariant_loss(same, "image", "p", "t").first()["loss"] == pytest.approx(0)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r["id"] for r in records.incomplete(ids, [ids.filter("id < 3"), ids.filter("id > 1")], "id").orderBy("id").collect()] == [1, 3]
    done = records.parsed(spark.createDataFrame([('{"k": 3}',), ("no json",), (None,)], "props string"), "props", "k long")
    assert [r["config"]["k"] if r["config"] else None for r in done.collect()] == [3, None, None]


def test_exact_quantiles_of_any_table(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=5001), rng.integers(0, 3, 4000).astype(float), np.array([1.0]), np.full(50, 2.5), rng.normal(size=2)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for bracket in (100_000, 40):
            monkeypatch.setattr(errors, "BRACKET", bracket)
            got = errors.exact_quantiles(df, {f"{q}": (F.col("v"), q) for q in (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)})
            for q, v in got.items():
                assert v == pytest.approx(np.quantile(values, float(q)), abs=1e-12), (len(values), q)
    none = errors.exact_quantiles(spark.createDataFrame([(None,)], "v double"), {"m": (F.col("v"), 0.5)})
    assert none == {"m": None}
    d = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(500, 2))] + [(None, 1.0)], "p double, r double")
    one, two = errors.scene_metrics(d, "p", "r"), errors.error_metrics(d, "p", "r").first().asDict()
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in two)


def test_group_metrics_in_bounded_memory(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(g, float(a), float(b)) for g, n in (("a", 6000), ("b", 41), (None, 300), ("one", 1)) for a, b in rng.normal(size=(n, 2))]
    data += [("ties", float(k % 3), 0.0) for k in range(600)] + [("none", None, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(data, "g string, p double, r double").repartition(3)
    want = {r["g"]: r.asDict() for r in errors.error_metrics(df, "p", "r", ["g"]).collect()}
    # no state that grows with a group
    monkeypatch.setattr(F, "percentile", None)
    monkeypatch.setattr(errors, "SMALL_GROUP", 1000)
    got = {r["g"]: r.asDict() for r in errors.group_metrics(df, "p", "r", ["g"]).collect()}
    assert got.keys() == want.keys()
    for g, m in want.items():
        assert got[g] == {k: v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-12) for k, v in m.items()}, g


def test_lowpass_far_from_zero_and_over_gaps(spark):
    a = 1e4 + np.random.default_rng(5).normal(size=(40, 70))
    df = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(40) for c in range(70)], "row long, col long, v double")
    got = {(r["row"], r["col"]): r["low"] for r in terrain.lowpass(df, 31).collect()}
    pad = np.pad(a, 15, mode="symmetric")
    assert max(abs(got[r, c] - pad[r : r + 31, c : c + 31].mean()) for r in range(40) for c in range(70)) < 1e-8


def test_many_tiles_settle_together():
    """A grid of 400 tiles with planes of their own: what undoes them is found without any
    matrix of all unknowns."""
    rng = np.random.default_rng(6)
    n = 20
    true = rng.normal(size=(n * n, 3))
    true[0] = 0
    links = []
    for i in range(n * n):
        for j in ([i + 1] if (i + 1) % n else []) + ([i + n] if i + n < n * n else []):
            basis = np.c_[np.ones(30), rng.uniform(0, 1, (30, 2))]
            gap = basis @ (true[i] - true[j])
            links.append((i, j, basis.T @ basis / 30, basis.T @ gap / 30))
    assert np.abs(tiles.settle(links, n * n) - true).max() < 1e-6
    assert tiles.settle([], 3).shape == (3, 1)
    alone = tiles.settle([(0, 1, np.eye(1), np.array([2.0]))], 3)
    assert alone[:, 0] == pytest.approx([0, -2, 0])


def test_fill_nearest_takes_the_first_of_equally_near(spark):
    rng = np.random.default_rng(7)
    for share in (0.02, 0.5):
        a = np.where(rng.random((17, 23)) < share, rng.normal(size=(17, 23)), np.nan)
        rows = [(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(17) for j in range(23)]
        full = [(i, j, v) for i, j, v in rows if v is not None]
        got = {(r["i"], r["j"]): r["ground"] for r in ground.fill_nearest(spark.createDataFrame(rows, "i long, j long, ground double")).collect()}
        for i, j, v in rows:
            assert got[i, j] == (v if v is not None else min(full, key=lambda f: (abs(f[0] - i) + abs(f[1] - j), f[0], f[1]))[2])
    nothing = spark.createDataFrame([(0, 0, None), (0, 1, None)], "i long, j long, ground double")
    assert {r["ground"] for r in ground.fill_nearest(nothing).collect()} == {None}


# ------------------------------------------------------------------ files
def lzw(data):
    """TIFF's LZW, by the book."""
    out, held, bits = bytearray(), 0, 0
    table, width, code = {bytes([k]): k for k in range(256)}, 9, 258

    def put(c):
        nonlocal held, bits
        bits, held = bits << width | c, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], code = code, code + 1
        if code == (1 << width) - 1 + 1 and width < 12:
            width += 1
        if code == 4094:
            put(256)
            table, width, code = {bytes([k]): k for k in range(256)}, 9, 258
        word = data[k : k + 1]
    put(table[word])
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("packed, predictor", [(5, 1), (5, 2), (8, 3), (32773, 1), (1, 3)])
def test_packed_tiffs(packed, predictor, big):
    rng = np.random.default_rng(8)
    a = (rng.normal(size=(37, 50)).astype("<f4") if predictor != 2 else (np.cumsum(rng.integers(0, 9, (37, 50)), axis=1) * 40).astype("<u2"))
    raw = a.tobytes()
    if predictor == 2:
        raw = np.diff(a, axis=1, prepend=np.zeros((37, 1), "<u2")).astype("<u2").tobytes()
    elif predictor == 3:
        planes = a.astype(">f4").view(np.uint8).reshape(37, 50, 4).transpose(0, 2, 1).reshape(37, -1)
        raw = np.diff(planes, axis=1, prepend=np.zeros((37, 1), np.uint8)).astype(np.uint8).tobytes()
    body = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[packed](raw)
    tags = [(256, 50), (257, 37), (258, a.dtype.itemsize * 8), (259, packed), (273, 16), (277, 1), (278, 37), (279, len(body)), (317, predictor), (339, 3 if a.dtype.kind == "f" else 1)]
    at = 16 + len(body)
    if big:
        head, end = b"II" + struct.pack("<HHHQ", 43, 8, 0, at), struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 4, 1, v) for t, v in tags) + b"\0" * 8
    else:
        head, end = (b"II" + struct.pack("<HI", 42, at)).ljust(16, b"\0"), struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 4
    got, meta = raster.read_tiff(head + body + end)
    assert got.dtype.itemsize == a.dtype.itemsize and (got[0].astype(float) == a.astype(float)).all()
    assert meta["georef_issue"] == "no transform"


def test_written_tiff_tiles_are_read_again(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(150, 90)).astype(np.float32)
    a[5, 7] = np.nan
    back, meta = raster.read_tiff(raster.write_tiff(a, [2.0, 0.0, 500.0, 0.0, -2.0, 900.0], 32644))
    assert meta["crs"] == "EPSG:32644" and meta["transform"] == [2.0, 0.0, 500.0, 0.0, -2.0, 900.0]
    assert np.array_equal(np.where(back[0] == meta["nodata"], np.nan, back[0]), a, equal_nan=True)
    grid = spark.createDataFrame([(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(150) for c in range(90)], "row long, col long, v double")
    files = raster.tile_files(grid, 64, "dsm", [2.0, 0.0, 500.0, 0.0, -2.0, 900.0], 32644)
    assert files.count() == 6
    for r in files.collect():
        i, j = (int(x) for x in r["path"].removesuffix(".tif").split("_")[1:])
        part, m = raster.read_tiff(bytes(r["content"]))
        assert m["transform"][2::3] == [500.0 + 128 * j, 900.0 - 128 * i]
        want = a[64 * i : 64 * i + 64, 64 * j : 64 * j + 64]
        assert np.array_equal(np.where(part[0] == m["nodata"], np.nan, part[0]), want, equal_nan=True)


def test_colour_ramps(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "level double")
    got = [tuple(r) for r in sinks.coloured(df, "grey").select("r", "g", "b", "a").collect()]
    assert got == [(0, 0, 0, 255), (128, 128, 128, 255), (255, 255, 255, 255), (0, 0, 0, 0)]
    top = sinks.coloured(df, "difference").select("r", "g", "b").collect()
    assert tuple(top[0]) == (0x2B, 0x4C, 0x9B) and tuple(top[1]) == (0xF2, 0xF2, 0xF2) and tuple(top[2]) == (0xB3, 0x26, 0x2E)
