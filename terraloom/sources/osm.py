"""Building footprints from OpenStreetMap XML, by XPath."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def refuse_entities(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df, or an error for a document that declares entities or a document type."""
    bad = F.col(xml).rlike("<!(DOCTYPE|ENTITY)")
    return df.filter(F.when(bad, F.raise_error(F.lit("XML with a document type is refused")).cast("boolean")).otherwise(True))


def nodes(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(ref, lon, lat) of all nodes."""
    tags = refuse_entities(df, xml).select(F.explode(F.regexp_extract_all(xml, F.lit(r"<node\b[^>]*>"), F.lit(0))).alias("t"))
    get = lambda n: F.regexp_extract("t", rf'\s{n}="([^"]*)"', 1)
    return tags.select(get("id").alias("ref"), get("lon").cast("double").alias("lon"), get("lat").cast("double").alias("lat"))


def building_ways(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(id, refs, building, height_tag, levels_tag) of ways tagged as buildings."""
    ways = refuse_entities(df, xml).select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<way\b.*?</way>"), F.lit(0))).alias("w"))
    tag = lambda k: F.nullif(F.xpath_string("w", F.lit(f"/way/tag[@k='{k}']/@v")), F.lit(""))
    return ways.select(F.xpath_long("w", F.lit("number(/way/@id)")).alias("id"), F.xpath("w", F.lit("/way/nd/@ref")).alias("refs"), tag("building").alias("building"), tag("height").alias("height_tag"), tag("building:levels").alias("levels_tag")).filter("building IS NOT NULL")


def buildings(df: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(buildings with their rings, counts): a ring is closed, has four references at
    least, and all its nodes are known; other ways are counted as skipped."""
    ways, known = building_ways(df, xml), nodes(df, xml)
    each = ways.select("id", "building", "height_tag", "levels_tag", "refs", F.posexplode("refs").alias("at", "ref"))
    found = each.join(known, "ref", "left").groupBy("id", "building", "height_tag", "levels_tag", "refs").agg(F.array_sort(F.collect_list(F.when(F.col("lon").isNotNull(), F.struct("at", "lon", "lat")))).alias("ring"))
    closed = (F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)) & (F.size("ring") == F.size("refs"))
    relations = F.size(F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<relation\b.*?</relation>"), F.lit(0)), lambda r: F.contains(r, F.lit('k="building"'))))
    counts = found.agg(F.count_if(closed).alias("ways"), F.count_if(~closed).alias("skipped_open_or_incomplete")).crossJoin(df.agg(F.coalesce(F.sum(relations), F.lit(0)).alias("skipped_relations")))
    return found.filter(closed).select("id", "building", "height_tag", "levels_tag", F.transform("ring", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords")), counts
