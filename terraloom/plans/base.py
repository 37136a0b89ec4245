"""Registration of queries with their SQL twins, and the stand-in tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.session import table


class Registry:
    """Named queries of a module, each with the DuckDB text of the same result."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def q6(x: str, digits: int = 6) -> str:
    """The same in DuckDB."""
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a raster: row, col, v, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("col", "v")).select("row", F.col("col").cast("long"), F.col("v").cast("double"), "label")


#: The same raster as a common table expression `g`.
G = """g AS (SELECT vec_id AS "row", CAST(unnest(range(len(embedding))) AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"""


def extent(g: DataFrame) -> tuple[int, int]:
    """Numbers of rows and columns of a raster."""
    return tuple(int(n) for n in g.agg(F.max("row") + 1, F.max("col") + 1).first())


#: The raster's numbers of rows and columns as a common table expression `z`.
Z = """z AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS h, CAST(max(len(embedding)) AS BIGINT) AS w FROM embeddings)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price against list price of each order line: p, q, and two strata."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("p_retailprice").alias("q"), "l_returnflag", "p_brand")


#: The same pairs as a common table expression `s`.
S = """s AS (SELECT l_extendedprice / l_quantity AS p, p_retailprice AS q, l_returnflag, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as places on the globe: id, lon, lat."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 37, F.lit(360)) - 180 + 0.25).cast("double").alias("lon"), (F.pmod(F.col("c_custkey") * 53, F.lit(160)) - 80 + 0.375).cast("double").alias("lat"))


P = """pts AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 360 - 180 + 0.25 AS DOUBLE) AS lon, CAST((c_custkey * 53) % 160 - 80 + 0.375 AS DOUBLE) AS lat FROM customer)"""
