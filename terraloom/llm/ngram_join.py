"""Jaccard self-join on word n-gram sets by prefix filters under several token orders.

Two sets that are similar enough must share a token among the first few of each, under
any one global order of the tokens. The join uses this four times:

1. By hash value, with a longer prefix of which a share must be common: a document with
   too few tokens that anybody else has there is out. Only prefixes are shuffled. A token
   that several documents of a task have is sent once, so a passage that is in every
   document costs a row a task.
2. The documents left are read again. Under two orders that put rare tokens first (by
   document frequency, and by its magnitude and a hash), the prefixes of both must meet.
3. Documents that share a prefix token are grouped around the most typical of them. A
   member that is similar to it is settled; the others are compared with the group in
   blocks of BLOCK rows, where candidates must pass both orders and the size bound before
   their intersections are counted.

Copies of a set are one throughout; every link between different sets is either found or
joins two that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, rows_of, small_batches, table, written

#: Rows on either side of a block comparison, on average.
BLOCK = 64
#: Prefix tokens that a task looks through at once.
CHUNK = 4_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _A
    return (h ^ (h >> _S)) * _B


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's words (ASCII case
    ignored); of fewer words, one for the whole sequence; of none, none."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out ^ h[i : len(h) - size + 1 + i])
    return np.unique(out)


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class Bound:
    """The threshold num / den, and what follows from it for a set of n tokens."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: int) -> int:
        """Tokens it must share with any similar set."""
        return -(-self.num * n // self.den)

    def more(self, n: int) -> int:
        """Common tokens asked for in the longer prefix: grows with n."""
        return max(1, (self.den - self.num) * n // self.den)

    def prefix(self, n: int) -> int:
        """Length of the longer prefix."""
        return min(n, n - self.overlap(n) + self.more(n))


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(df[key].cast("long").alias("_id"), df[text].alias("_text"))
    return rows.select("_id", "_text", *row_names(F.col("_id"), F.col("_text")))


def row_names(key: Column, text: Column) -> list[Column]:
    """_key and _hash, which name a row by its id (its text, without one) and its text."""
    return [F.coalesce(key.cast("long"), F.xxhash64(text)).alias("_key"), F.xxhash64(text).alias("_hash")]


def _signatures(docs: DataFrame, words: int, bound: Bound) -> DataFrame:
    """(_id, _key, _hash, n, fp, prefix) of each row: the size and hash of its set, and its longer
    prefix by hash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                sets = [shingles(t, words) for t in texts]
                prefix = _lists([s[: bound.prefix(len(s))] for s in sets])
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), b.column("_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), prefix], ["_id", "_key", "_hash", "n", "fp", "prefix"])

    return docs.select("_id", "_key", "_hash", "_text").mapInArrow(run, "_id long, _key long, _hash long, n long, fp long, prefix array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of token arrays."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64, copy=False).view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The token arrays of a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _prefix_rows(signed: DataFrame) -> DataFrame:
    """(token, fp, credit): for a token that one set of the task has in its prefix, that
    set; for one that several have, a row without fp; for each set, under a key of its
    own, the tokens of the latter sort as credit."""

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        fps = np.fromiter(held, np.int64, len(held))
        sizes = np.fromiter(map(len, held.values()), np.int64, len(held))
        tokens, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(fps)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        credit = np.bincount(owner[many[group]], minlength=len(fps))
        lone = ~many[group]
        once = first & ~lone
        a, m, d = int(lone.sum()), int(once.sum()), len(fps)
        keys = np.concatenate([tokens[lone], tokens[once], _mix(fps.view(np.uint64))]).view(np.int64)
        kind = np.repeat([0, 1, 2], [a, m, d])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                pa.array(np.concatenate([fps[owner[lone]], np.zeros(m, np.int64), fps]), mask=kind == 1),
                pa.array(np.concatenate([np.zeros(a + m, np.int64), credit]), mask=kind != 2),
            ],
            ["token", "fp", "credit"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            for fp, prefix in zip(b.column("fp").to_pylist(), _arrays(b.column("prefix")), strict=True):
                if len(prefix) and fp not in held:
                    held[fp] = prefix.copy()
                    size += len(prefix)
                    if size >= CHUNK:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return signed.select("fp", "prefix").mapInArrow(run, "token long, fp long, credit long")


def _alive(signed: DataFrame, classes: DataFrame, bound: Bound) -> DataFrame:
    """Classes (fp, _key, n) that share enough of their longer prefix with other sets."""
    w = Window.partitionBy("token")
    rows = _prefix_rows(signed).select(
        "fp",
        "credit",
        ((F.min("fp").over(w) != F.max("fp").over(w)) | (F.count("*").over(w) > F.count("fp").over(w))).alias("shared"),
    )
    sums = rows.filter("fp IS NOT NULL AND (shared OR credit IS NOT NULL)").groupBy("fp").agg(F.sum(F.coalesce("credit", F.lit(1))).alias("common"), F.count("credit").alias("copies"))
    smallest = F.expr(f"({bound.num} * n + {bound.den - 1}) div {bound.den}")  # tokens of the smallest similar set
    least = F.greatest(F.lit(1), F.floor(smallest * (bound.den - bound.num) / bound.den))
    return classes.join(written(sums), "fp").filter(F.col("common") >= least * F.col("copies")).select("fp", "_key", "n")


def _sets(docs: DataFrame, alive: DataFrame, words: int) -> DataFrame:
    """(fp, n, tokens) of the classes in `alive`, from one of their texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                sets = [shingles(t, words) for t in texts]
                ok = [len(s) > 0 and fingerprint(s) == fp for s, fp in zip(sets, b.column("fp").to_pylist(), strict=True)]
                kept = [s for s, x in zip(sets, ok, strict=True) if x]
                yield pa.RecordBatch.from_arrays([b.column("fp").filter(pa.array(ok)), pa.array([len(s) for s in kept], pa.int64()), _lists(kept)], ["fp", "n", "tokens"])

    texts = docs.select("_key", "_text").join(alive.select("_key", "fp").hint("shuffle_hash"), "_key")
    return texts.select("fp", "_key", "_text").mapInArrow(run, "fp long, n long, tokens array<long>").dropDuplicates(["fp"])


def _prefixes(sets: DataFrame, bound: Bound) -> DataFrame:
    """(fp, token, in_a, in_b, typical): prefix tokens under two rare-first orders, of the
    sets whose tokens that nobody else has don't fill the prefix already."""
    tokens = sets.select("fp", "n", F.explode("tokens").alias("token"))
    counts = written(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = tokens.join(counts, "token")
    whole = Window.partitionBy("fp")
    by_a = whole.orderBy("df", "token")
    by_b = whole.orderBy(F.floor(F.log2("df")), F.xxhash64("token"), "token")
    overlap = F.expr(f"({bound.num} * n + {bound.den - 1}) div {bound.den}")
    left = (F.col("n") - overlap + 1) - (F.col("n") - F.count("*").over(whole))
    ranked = shared.select("fp", "token", left.alias("left"), F.avg("df").over(whole).alias("typical"), F.row_number().over(by_a).alias("a"), F.row_number().over(by_b).alias("b"))
    return ranked.select("fp", "token", (F.col("a") <= F.col("left")).alias("in_a"), (F.col("b") <= F.col("left")).alias("in_b"), "typical").filter("in_a OR in_b")


def _shares(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    ax, ay = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(ax, ay)
    if not len(both):
        return out

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat
        return row[hit], at[hit]

    (rx, cx), (ry, cy) = places(xs, ax), places(ys, ay)
    for low in range(0, len(both), 4096):
        m = min(4096, len(both) - low)
        dx, dy = np.zeros((len(xs), m), np.float32), np.zeros((len(ys), m), np.float32)
        in_x, in_y = (cx >= low) & (cx < low + m), (cy >= low) & (cy < low + m)
        dx[rx[in_x], cx[in_x] - low] = 1
        dy[ry[in_y], cy[in_y] - low] = 1
        out += dx @ dy.T
    return out


def block_links(fx: np.ndarray, xs: list, ax: list, bx: list, fy: np.ndarray, ys: list, ay: list, by: list, bound: Bound, settled: bool) -> list[tuple[int, int]]:
    """Links between two blocks (tokens, and prefixes under two orders). settled: the
    second block is one component, so one link of each row to it is enough. Otherwise
    links that close a cycle are left out."""
    nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
    ok = (_shares(ax, ay) > 0) & (_shares(bx, by) > 0)
    ok &= (bound.den * ny[None, :] >= bound.num * nx[:, None]) & (bound.den * nx[:, None] >= bound.num * ny[None, :])
    ok &= fx[:, None] != fy[None, :]
    rows, columns = np.nonzero(ok.any(axis=1))[0], np.nonzero(ok.any(axis=0))[0]
    if not len(rows):
        return []
    common = _shares([xs[i] for i in rows], [ys[j] for j in columns]).astype(np.int64)
    linked = ok[np.ix_(rows, columns)] & (bound.den * common >= bound.num * (nx[rows][:, None] + ny[columns][None, :] - common))
    if settled:
        return [(int(fx[rows[i]]), int(fy[columns[np.argmax(linked[i])]])) for i in np.nonzero(linked.any(axis=1))[0]]
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = parent[p]
            a = p
        return a

    out = []
    for i, j in np.argwhere(linked):
        a, b = root(int(fx[rows[i]])), root(int(fy[columns[j]]))
        if a != b:
            parent[a] = b
            out.append((int(fx[rows[i]]), int(fy[columns[j]])))
    return out


def _links(sets: DataFrame, bound: Bound) -> DataFrame:
    """Links (a, b) between different sets: enough of them to connect all that similar
    sets connect."""
    prefixes = written(_prefixes(sets, bound))
    lists = prefixes.filter("in_a").groupBy("token").agg(F.count("*").alias("m"), F.max_by("fp", F.struct("typical", "fp")).alias("leader")).filter("m > 1").select("token", "leader")
    members = written(prefixes.filter("in_a").select("fp", "token").join(written(lists), "token").select("fp", "leader").distinct())
    arrays = prefixes.groupBy("fp").agg(F.collect_list(F.when(F.col("in_a"), F.col("token"))).alias("pa"), F.collect_list(F.when(F.col("in_b"), F.col("token"))).alias("pb"))
    full = written(sets.join(arrays, "fp"))
    lead = full.select(F.col("fp").alias("leader"), F.col("tokens").alias("other"))
    pairs = members.join(full, "fp").join(lead, "leader")
    common = F.size(F.array_intersect("tokens", "other"))
    settled = bound.den * common >= bound.num * (F.col("n") + F.size("other") - common)
    judged = written(pairs.select("leader", "fp", "n", "tokens", "pa", "pb", settled.alias("settled")))
    direct = judged.filter("settled AND fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    sizes = judged.groupBy("leader").agg(F.count_if(~F.col("settled")).alias("open"), F.count_if("settled").alias("done")).filter("open > 0 AND open + done > 2")
    todo = judged.join(written(sizes), "leader").filter("NOT settled OR fp <> leader")
    u, c = F.ceil(F.col("open") / BLOCK), F.ceil(F.col("done") / BLOCK)
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.when(F.col("settled"), c).otherwise(u)).cast("int")
    rows = todo.select("leader", "fp", "settled", "tokens", "pa", "pb", u.cast("int").alias("u"), c.cast("int").alias("c"), block.alias("block"))
    up = F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda j: F.struct(F.lit(False).alias("with"), F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    over = F.when(F.col("c") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("c"), F.lit(1)) - 1), lambda j: F.struct(F.lit(True).alias("with"), F.col("block").alias("i"), j.alias("j")))).otherwise(F.expr("array()").cast("array<struct<with:boolean,i:int,j:int>>"))
    under = F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda i: F.struct(F.lit(True).alias("with"), i.alias("i"), F.col("block").alias("j")))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("settled"), under).otherwise(F.concat(up, over)))).select("leader", "at.with", "at.i", "at.j", "block", "settled", "fp", "tokens", "pa", "pb")

    def compare(t: pa.Table) -> pa.Table:
        with_settled, i = t["with"][0].as_py(), t["i"][0].as_py()
        fp = t["fp"].to_numpy()
        tokens, a, b = ([np.asarray(x.values, np.int64) for x in t[name]] for name in ("tokens", "pa", "pb"))
        settled, block = np.array(t["settled"].to_pylist()), t["block"].to_numpy()
        x = np.nonzero(~settled & (block == i))[0]
        y = np.nonzero(settled)[0] if with_settled else np.nonzero(block == t["j"][0].as_py())[0]
        pick = lambda s, k: [s[q] for q in k]
        found = block_links(fp[x], pick(tokens, x), pick(a, x), pick(b, x), fp[y], pick(tokens, y), pick(a, y), pick(b, y), bound, with_settled) if len(x) and len(y) else []
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    return direct.union(dealt.groupBy("leader", "with", "i", "j").applyInArrow(compare, "a long, b long"))


def _grouped(df: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(_id, _key, _hash, n, root, least) of each row: root names its component, least is
    the smallest id in it."""
    small_batches(df.sparkSession)
    bound = Bound(num, den)
    docs = _source(df, key, text)
    signed = written(_signatures(docs, words, bound))
    classes = written(signed.filter("n > 0").groupBy("fp").agg(F.min("_id").alias("least"), F.min("_key").alias("_key"), F.max("n").alias("n")))
    sets = written(_sets(docs, written(_alive(signed, classes, bound)), words))
    found = written(components(written(_links(sets, bound))))
    named = classes.select("fp", "least").join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    reached = written(found.join(classes.select(F.col("fp").alias("node"), "least"), "node").groupBy(F.col("component").alias("root")).agg(F.min("least").alias("reached")))
    final = written(named.join(reached, "root", "left").select("fp", "root", F.coalesce("reached", "least").alias("least")))
    return signed.select("_id", "_key", "_hash", "n", "fp").join(final, "fp", "left").select("_id", "_key", "_hash", "n", "root", "least")


def jaccard_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) of each row: rows whose n-gram sets have a Jaccard
    similarity of num / den or more are linked; component_id is the smallest key in reach.

    A null or empty text, or one of white space, has no n-grams and is linked with
    nothing: its component is its own key. Rows with a null key link like others but
    don't name a component; one of nulls alone has none. Repeated rows are members of one
    component. Other columns are not returned. An empty table gives none."""
    rows = _grouped(df, key, text, words, num, den)
    return rows.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(_key, _hash, copies, stays) of each different row with words, as row_names() names
    it: how often it is there, and whether it is the one row of its component that stays:
    that of smallest id, of rows with one id that of smallest hash; rows without an id
    stay only where the component has none with one. An empty table gives none."""
    rows = _grouped(df, key, text, words, num, den).filter("n > 0")
    once = written(rows.groupBy("_key", "_hash", "_id", "root").agg(F.count("*").alias("copies")))
    rank = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "_key")
    first = once.groupBy("root").agg(F.min(rank).alias("first"))
    mine = once.join(first, "root")
    return mine.select("_key", "_hash", "copies", ((F.col("_key") == F.col("first._key")) & (F.col("_hash") == F.col("first._hash"))).alias("stays"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same groups by comparing all pairs that share a shingle.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT t.doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM t JOIN r ON r.a = t.doc_id GROUP BY t.doc_id
"""
