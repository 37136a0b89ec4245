"""Guarded writers: grids with a sidecar, previews, meshes, reports."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators import graph


def summary(df: DataFrame, v: str = "v") -> DataFrame:
    """(min, max, mean, nan_count) of finite values, one row."""
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count_if(F.col(v).isNull()).alias("nan_count"))


def check_surface(kind: str, units: str, crs: str | None, datum: str | None) -> None:
    """Refuse a relative surface in metres, and a metric one without CRS and datum."""
    if kind not in ("relative", "absolute"):
        raise ValueError("kind must be relative or absolute")
    if kind == "relative" and units == "metres":
        raise ValueError("a relative surface is not in metres")
    if kind == "absolute" and not (crs and datum and units == "metres"):
        raise ValueError("a metric surface needs metres, a coordinate system and a vertical datum")


def write_surface(df: DataFrame, path: str, kind: str, units: str, crs: str | None = None, datum: str | None = None, tags: dict | None = None) -> None:
    """The grid as Parquet by rows of tiles, with a one-row JSON sidecar that describes it."""
    check_surface(kind, units, crs, datum)
    df.write.partitionBy(*(["scene"] if "scene" in df.columns else [])).parquet(f"{path}/grid")
    facts = {"kind": kind, "units": units, "crs": crs, "vertical_datum": datum, **(tags or {})}
    report(summary(df), facts).coalesce(1).write.text(f"{path}/sidecar")


def report(df: DataFrame, facts: dict) -> DataFrame:
    """(value): each row of df with constant facts as a JSON line."""
    return df.withColumns({k: F.lit(v) for k, v in facts.items()}).select(F.to_json(F.struct("*")).alias("value"))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """v scaled to 0..255 between low and high, halves to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - low) / F.greatest(high - low, F.lit(1e-9)) * 255))).cast("int")


def radiometry(df: DataFrame, v: str, mode: str = "auto", nbits: int | None = None, floating: bool = False) -> DataFrame:
    """df with `byte`: 8 bits for a model. By bit depth (given, or from the maximum), or by
    a joint 0.5-99.5 percentile stretch where asked for, for floats, and in auto mode when
    the scaled image is very dark (p99 below 64). Nodata becomes 0."""
    s = df.agg(F.max(v).alias("_top"), F.percentile(v, F.lit(0.005)).alias("_low"), F.percentile(v, F.lit(0.995)).alias("_high"))
    bits = F.lit(nbits) if nbits else F.greatest(F.lit(8), F.ceil(F.log2(F.coalesce("_top", F.lit(255)) + 1)).cast("int"))
    x = df.crossJoin(F.broadcast(s.withColumn("_full", F.pow(F.lit(2.0), bits) - 1)))
    wide = stretch(F.col(v), F.col("_low"), F.col("_high"))
    deep = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.col(v) * 255.0 / F.col("_full")))).cast("int")
    if mode == "stretch" or floating:
        out = x.withColumn("byte", wide)
    else:
        out = x.withColumn("byte", deep)
        if mode == "auto":
            dark = out.agg(F.percentile("byte", F.lit(0.99)).alias("_p99"))
            out = out.crossJoin(F.broadcast(dark)).withColumn("byte", F.when(F.col("_p99") < 64, wide).otherwise(F.col("byte"))).drop("_p99")
    return out.withColumn("byte", F.coalesce("byte", F.lit(0))).drop("_top", "_low", "_high", "_full")


def preview(df: DataFrame, v: str = "v", low: float = 0.02, high: float = 0.98, symmetric: bool = False) -> DataFrame:
    """df with `level` in [0, 1] between two percentiles (or symmetric about 0), null for
    nodata: the numeric part of a coloured preview."""
    q = df.agg(F.percentile(v, F.lit(low)).alias("_a"), F.percentile(v, F.lit(high)).alias("_b"), F.percentile(F.abs(v), F.lit(high)).alias("_s"))
    x = df.crossJoin(F.broadcast(q))
    a, b = (-F.col("_s"), F.col("_s")) if symmetric else (F.col("_a"), F.col("_b"))
    return x.withColumn("level", F.when(F.col(v).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(v) - a, b - a))))).drop("_a", "_b", "_s")


#: Colour ramps by a few stops, dark to light; colours between them are mixed.
RAMPS = {
    "height": ("#0b3c49", "#3a7d44", "#c9d46c", "#b07d3c", "#f4efe6"),
    "difference": ("#2b4c9b", "#f2f2f2", "#b3262e"),
    "grey": ("#000000", "#ffffff"),
}


def coloured(df: DataFrame, ramp: str = "height", level: str = "level") -> DataFrame:
    """df with r, g, b and a (0 to 255) of a level in [0, 1]; a null level is transparent."""
    stops = [[int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in RAMPS[ramp]]
    at = F.col(level) * (len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    out = {}
    for k, name in enumerate("rgb"):
        band = F.array(*(F.lit(float(s[k])) for s in stops))
        a, b = F.get(band, low), F.get(band, low + 1)
        out[name] = F.coalesce(F.bround(a + (b - a) * (at - low)), F.lit(0.0)).cast("int")
    return df.withColumns(out | {"a": F.when(F.col(level).isNull(), 0).otherwise(255)})


def _glb_head(n: int, low: list[float], high: list[float], m: int) -> bytes:
    """What stands before the body in a binary glTF of n vertices and m triangles."""
    places, indices = 12 * n, 12 * m
    doc = {
        "asset": {"version": "2.0"},
        "buffers": [{"byteLength": places + indices}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": places, "target": 34962}, {"buffer": 0, "byteOffset": places, "byteLength": indices, "target": 34963}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": low, "max": high},
            {"bufferView": 1, "componentType": 5125, "count": 3 * m, "type": "SCALAR"},
        ],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "nodes": [{"mesh": 0}],
        "scenes": [{"nodes": [0]}],
        "scene": 0,
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    size = 28 + len(text) + places + indices
    if size > 0xFFFFFFFF:
        raise ValueError(f"a binary glTF holds 4 GB at most, this mesh takes {size} bytes")
    return b"".join([struct.pack("<4sII", b"glTF", 2, size), struct.pack("<I4s", len(text), b"JSON"), text, struct.pack("<I4s", places + indices, b"BIN\0")])


def glb(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary glTF of a mesh (float32 positions, uint32 triangles)."""
    v, f = np.ascontiguousarray(vertices, "<f4"), np.ascontiguousarray(faces, "<u4")
    return _glb_head(len(v), v.min(axis=0).tolist(), v.max(axis=0).tolist(), len(f)) + v.tobytes() + f.tobytes()


def _packed(df: DataFrame, kind: str) -> DataFrame:
    """(n, low, high, content): rows of three columns as bytes, a batch a piece, in order;
    `at`, where df has it, is the first row's."""
    columns = [c for c in df.columns if c != "at"]

    def run(batches):
        for x in batches:
            if len(x):
                a = np.ascontiguousarray(x[columns].to_numpy(), kind)
                yield pd.DataFrame({"at": [int(x["at"].iloc[0]) if "at" in x else 0], "n": [len(a)], "low": [a.min(axis=0).tolist()], "high": [a.max(axis=0).tolist()], "content": [a.tobytes()]})

    return graph.cut(df.mapInPandas(run, "at long, n long, low array<double>, high array<double>, content binary"))


def write_glb(path: str, vertices: DataFrame, faces: DataFrame) -> tuple[int, int]:
    """Write a mesh (vid, x, y, z) and (a, b, c) as one binary glTF through Hadoop's file
    system, so that path may be in any store; numbers of vertices and faces.

    Executors pack the bytes; the driver passes them on piece by piece and never holds
    the mesh. The file is that of glb()."""
    spark = vertices.sparkSession
    v = _packed(vertices.orderBy("vid").select(F.col("vid").alias("at"), "x", "y", "z"), "<f4")
    f = _packed(faces.select("a", "b", "c"), "<u4")
    ends = [g(F.col(c)[k]) for g, c in ((F.min, "low"), (F.max, "high")) for k in range(3)]
    n, *box = v.agg(F.sum("n"), *ends).first()
    m = f.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        raise ValueError("a mesh without vertices")
    head = _glb_head(n, box[:3], box[3:], m)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(head)
        for pieces in (v.orderBy("at"), f):
            for r in pieces.select("content").toLocalIterator():
                out.write(bytes(r["content"]))
    finally:
        out.close()
    return n, m


def markdown(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(line): rows as a Markdown table's lines, numbers with fixed digits."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_string(f"%.{digits}f", c) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("-"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("line"))
