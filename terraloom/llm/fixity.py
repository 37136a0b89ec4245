"""Merkle fixity audit of WARC files.

Each file's records are leaves (SHA-256 of the record's bytes). Leaves meet in ordered
offset ranges of LEAF bytes, ranges in ranges FAN times as wide, up to one root a file.
Two replicas are compared root by root, and only the parts of trees whose hashes differ
are descended, level by level, to the records that are corrupt, missing or extra. All of
it is DataFrame functions; a node's children are at most FAN ranges, or the records that
start in LEAF bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LEAF, FAN = 1 << 16, 16
#: Levels above the leaf ranges; the top one spans LEAF * FAN^TOP bytes (1 TiB).
TOP = 6
#: Pages a WARC file holds, by page id.
PAGES_PER_FILE = 256
#: The query audits a replica in which a byte is overwritten in records of ids that leave
#: 5 by _HIT, and records of ids that leave 3 by _LOST are missing.
_HIT, _LOST = 11, 101

#: The record format's lines.
_HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC response record (string; its bytes are UTF-8)."""
    body = F.coalesce(html, F.lit(""))
    a, b = _HEAD.split("{id}")
    b, c = b.split("{url}")
    c, d = c.split("{size}")
    return F.concat(F.lit(a), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(b), F.coalesce(url, F.lit("")), F.lit(c), F.octet_length(body).cast("string"), F.lit(d), body, F.lit("\r\n\r\n"))


def layout(rows: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """rows (page_id: long, length, hash, more) with file and offset: records laid end to
    end in WARC files, in the order of id.

    A file takes one record each of per_file successive ids. Further records of an id,
    copies, and records without an id go to files of their own, per_file copies each, so
    no file grows with a hot id. An empty table gives none."""
    names = rows.columns
    counted = written(rows.groupBy(*names).agg(F.count("*").alias("_n")))
    first = written(counted.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.min("hash").alias("_first")))
    each = counted.join(first, "page_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    usual = (F.col("hash") == F.col("_first")) & (F.col("_copy") == 0)
    own = F.concat(F.lit("x"), F.xxhash64(*names).cast("string"), F.lit("-"), F.floor(F.col("_copy") / per_file).cast("string"))
    file = F.when(usual, F.concat(F.lit("p"), F.floor(F.col("page_id") / per_file).cast("string"))).otherwise(own)
    w = Window.partitionBy("file").orderBy("page_id", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("file", file).select("file", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), *names)


def warc_leaves(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_file: int = PAGES_PER_FILE) -> DataFrame:
    """(file, offset, page_id, length, hash, damaged, lost) of pages as WARC records.

    Records are hashed where they are read; only hashes and lengths are shuffled. damaged
    is the hash of the record with a byte overwritten where the id leaves 5 by _HIT, lost
    tells whether it leaves 3 by _LOST: a replica of known damage. A null url or page
    counts as empty; records without an id are never damaged. Repeated rows are records
    each, very long pages one; other columns are not read. An empty table gives none."""
    k = pages[key].cast("long")
    r = record(k, pages[url], pages[html])
    rows = pages.select(k.alias("page_id"), r.alias("r"))
    bad = F.concat(F.expr("substring(r, 1, 20)"), F.lit("?"), F.expr("substring(r, 22)"))
    return layout(
        rows.select(
            "page_id",
            F.octet_length("r").cast("long").alias("length"),
            F.sha2("r", 256).alias("hash"),
            F.sha2(F.when(F.pmod("page_id", F.lit(_HIT)) == 5, bad).otherwise(F.col("r")), 256).alias("damaged"),
            F.coalesce(F.pmod("page_id", F.lit(_LOST)) == 3, F.lit(False)).alias("lost"),
        ),
        per_file,
    )


def _node(level: int) -> Column:
    return F.floor(F.col("offset") / (LEAF * FAN**level)).cast("long")


def tree(leaf: DataFrame) -> DataFrame:
    """(file, level, node, hash, bytes, records) of all inner nodes; level TOP is the root.

    A node's hash is taken over its children's places, lengths and hashes in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "hash")))
    text = F.concat_ws("|", F.transform(parts, lambda x: F.concat_ws(":", x["offset"], x["length"], x["hash"])))
    levels = [leaf.groupBy("file", _node(0).alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("length").alias("bytes"), F.count("*").alias("records"))]
    for _ in range(TOP):
        below = levels[-1]
        parts = F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), F.col("bytes").alias("size"), F.col("hash").alias("sha"))))
        text = F.concat_ws("|", F.transform(parts, lambda x: F.concat_ws(":", x["at"], x["size"], x["sha"])))
        levels.append(written(below.groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))))
    out = levels[0].withColumn("level", F.lit(0))
    for i, x in enumerate(levels[1:], 1):
        out = out.union(x.withColumn("level", F.lit(i)))
    return out.select("file", "level", "node", "hash", "bytes", "records")


def _different(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys at which two sides' hashes differ or one side has none."""
    x, y = a.select(*on, F.col("hash").alias("ha")), b.select(*on, F.col("hash").alias("hb"))
    return x.join(y, on, "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where replica b differs from replica a, both as leaves (file, offset, length, hash).

    One row per differing record: file, offset, lengths and hashes on either side (null
    where it has no record there), status: corrupt, missing (only in a) or extra (only in
    b). Roots are compared first; below, only nodes under a differing parent are joined.
    A file on one side alone differs from its root down. Null files or offsets form no
    tree and are left out; the same record twice at an offset counts as two children.
    Empty replicas differ in nothing."""
    a, b = (x.filter("file IS NOT NULL AND offset IS NOT NULL") for x in (a, b))
    a, b = written(a), written(b)
    ta, tb = written(tree(a)), written(tree(b))
    bad = _different(ta.filter(F.col("level") == TOP), tb.filter(F.col("level") == TOP), ["file", "node"]).select("file", F.col("node").alias("parent"))
    for level in range(TOP - 1, -1, -1):
        bad = written(bad)
        under = [t.filter(F.col("level") == level).withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(bad, ["file", "parent"], "left_semi") for t in (ta, tb)]
        bad = _different(*under, ["file", "node"]).select("file", F.col("node").alias("parent"))
    bad = written(bad)
    # repeated records of an offset are told apart by their number
    number = F.row_number().over(Window.partitionBy("file", "offset").orderBy("length", "hash"))
    sides = [x.withColumn("parent", _node(0)).join(bad, ["file", "parent"], "left_semi").withColumn("copy", number) for x in (a, b)]
    x = sides[0].select("file", "offset", "copy", F.col("length").alias("length_a"), F.col("hash").alias("hash_a"))
    y = sides[1].select("file", "offset", "copy", F.col("length").alias("length_b"), F.col("hash").alias("hash_b"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return x.join(y, ["file", "offset", "copy"], "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "offset", "length_a", "length_b", "hash_a", "hash_b", status.alias("status"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages as WARC files against a damaged replica: each record that
    differs, with its page."""
    placed = written(warc_leaves(table(spark, sf_dir, "pages")))
    replica = placed.filter("NOT lost").select("file", "offset", "length", F.col("damaged").alias("hash"))
    found = audit(placed.select("file", "offset", "length", "hash"), replica)
    return found.join(placed.select("file", "offset", "page_id"), ["file", "offset"]).select("file", "offset", "page_id", "length_a", "length_b", "hash_a", "hash_b", "status")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, 'p' || CAST(CAST(floor(page_id / {PAGES_PER_FILE}.0) AS BIGINT) AS VARCHAR) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
o AS (
  SELECT *, strlen(r) AS n, CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM p)
SELECT file, begins AS "offset", page_id, CAST(n AS BIGINT) AS length_a,
  CASE WHEN page_id % {_LOST} = 3 THEN NULL ELSE CAST(n AS BIGINT) END AS length_b,
  sha256(r) AS hash_a,
  CASE WHEN page_id % {_LOST} = 3 THEN NULL ELSE sha256(substr(r, 1, 20) || '?' || substr(r, 22)) END AS hash_b,
  CASE WHEN page_id % {_LOST} = 3 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % {_LOST} = 3 OR page_id % {_HIT} = 5
"""
