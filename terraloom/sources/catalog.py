"""Elevation and land-cover sources as a small dimension, and tile selection by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import scalars

#: Key, kind, tile naming, vertical datum, units.
SOURCES = [
    ("copernicus_glo30", "surface", "copernicus", "EGM2008", "metres"),
    ("copernicus_wbm", "water", "copernicus", None, "class code"),
    ("copernicus_hem", "error", "copernicus", None, "metres"),
    ("tilezen_skadi", "surface", "skadi", "EGM96", "metres"),
    ("nasadem", "surface", "search", "EGM96", "metres"),
    ("usgs_3dep_dsm", "surface", "search", "NAVD88", "metres"),
    ("usgs_3dep_dtm", "terrain", "search", "NAVD88", "metres"),
    ("esa_worldcover", "landcover", "search", None, "class code"),
]
#: Land-cover classes.
LANDCOVER = {
    10: "tree cover",
    20: "shrubland",
    30: "grassland",
    40: "cropland",
    50: "built-up",
    60: "bare / sparse vegetation",
    70: "snow and ice",
    80: "permanent water",
    90: "herbaceous wetland",
    95: "mangroves",
    100: "moss and lichen",
}
#: Version of the land-cover map by year.
LANDCOVER_VERSIONS = {2020: "v100", 2021: "v200"}


def sources(spark: SparkSession) -> DataFrame:
    """The catalog: source, kind, naming, vertical_datum, units."""
    return spark.createDataFrame(SOURCES, "source string, kind string, naming string, vertical_datum string, units string")


def landcover_classes(spark: SparkSession) -> DataFrame:
    """(code, name) of the land-cover classes."""
    return spark.createDataFrame(list(LANDCOVER.items()), "code int, name string")


#: How a source's files are named: a function of the columns (lat, lon) of a degree tile's
#: south-west corner. Sources that are found by a search have none.
NAMING: dict[str, Callable[[Column, Column], Column]] = {
    "copernicus_glo30": lambda lat, lon: scalars.degree_tile_name(lat, lon),
    "copernicus_wbm": lambda lat, lon: _auxiliary(lat, lon, "WBM"),
    "copernicus_hem": lambda lat, lon: _auxiliary(lat, lon, "HEM"),
    "tilezen_skadi": lambda lat, lon: scalars.degree_tile_name(lat, lon, "skadi"),
}


def _auxiliary(lat: Column, lon: Column, layer: str) -> Column:
    """The file of a layer that lies beside an elevation tile, on the same grid."""
    tile = scalars.degree_tile_name(lat, lon)
    return F.concat(tile, F.lit("/AUXFILES/"), F.regexp_replace(tile, "_DEM$", f"_{layer}.tif"))


def tile_requests(areas: DataFrame, source: str, naming: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """areas (id, west, south, east, north) with the `tile` names of a source that cover
    each, a row a tile. naming: another function than the source's own."""
    name = naming or NAMING.get(source)
    if name is None:
        raise ValueError(f"files of {source!r} are found by a search, not by name")
    tiles = scalars.degree_tiles(*(F.col(c) for c in ("west", "south", "east", "north")))
    return areas.withColumn("_t", F.explode(tiles)).withColumn("tile", name(F.col("_t.lat"), F.col("_t.lon"))).drop("_t")


def wanted_and_missing(wanted: DataFrame, present: DataFrame, key: str = "tile") -> DataFrame:
    """wanted with `missing`: tiles that are not there are recorded, not fatal."""
    return wanted.join(present.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left").withColumn("missing", F.col("_ok").isNull()).drop("_ok")


def one_survey(items: DataFrame, survey: str) -> DataFrame:
    """Items of one survey alone, chosen before any union: surveys never mix."""
    return items.filter(F.col("survey") == survey)


def newest(items: DataFrame, at: str, *keys: str) -> DataFrame:
    """The newest item of each key, in one pass."""
    return items.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in items.columns if c not in keys)), at).alias("_x")).select(*keys, "_x.*")


def first_wins(*layers: DataFrame) -> DataFrame:
    """Mosaic (row, col, v) of layers: at each pixel the first layer with a value."""
    out = None
    for i, x in enumerate(layers):
        y = x.select("row", "col", "v", F.lit(i).alias("_i"))
        out = y if out is None else out.unionByName(y)
    return out.filter("v IS NOT NULL").groupBy("row", "col").agg(F.min_by("v", "_i").alias("v"))
