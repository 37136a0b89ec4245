"""Embedding near-duplicates from a neighbour graph refined by NN-descent.

1. Copies of a vector become one node with a weight.
2. Several hyperplane codes order the nodes; neighbours in an order start the graph.
3. Rounds of neighbours-of-neighbours: each node's neighbours (either direction, LIST at
   most of each) are compared with each other, and better ones enter the lists.
4. All pairs that pass the threshold when they are compared join nodes into regions,
   whether or not a list keeps them.
5. A list may be saturated (all its neighbours pass). Members of a region need no list of
   each other, as the region is compared in full at the end; so in the next attempt, with
   new starting orders, every node has a further list of LIST neighbours outside its region,
   and so on until an attempt joins no regions and an audit misses nothing.
6. A region's members are compared in blocks of about BLOCK rows that lie together: two
   blocks meet once, and only if their centres and radii leave room for a link. Links are
   counted, not listed. Small regions share a block.
7. The audit compares nodes with all others until it has met AUDIT true links or asked
   ASKED nodes. It measures and calls for further attempts; its links are no part of the
   result. If the last attempt still misses links, all nodes are compared as one region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, table, written

LIST = 12
TABLES, NEXT = 8, 3
#: Rounds of an attempt at most, and attempts before all nodes are compared in blocks.
ROUNDS, ATTEMPTS = 4, 24
BLOCK = 1024
#: Bits of the hyperplane code by which a large region's rows are dealt to blocks.
CODE = 20
EDGE = "node long, nbr long, cos double, inside boolean"
#: True links that the audit finds by brute force, from nodes in order of hash; also the
#: nodes of its first pass. Passes double up to PASS nodes, ASKED at most in all.
AUDIT, RECALL = 512, 0.98
PASS, ASKED = 8192, 16_384


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """(id, vec): the vector's bytes, null for one that can't link; and their type."""
    single = df.schema[vector].dataType.elementType in (T.FloatType(), T.ShortType(), T.ByteType())
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("vec"):
                v = None if x.values is None or x.values.null_count or not len(x.values) else np.asarray(x.values).astype(kind)
                out.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    element = "float" if single else "double"
    return df.select(df[key].cast("long").alias("id"), df[vector].cast(f"array<{element}>").alias("vec")).mapInArrow(run, "id long, vec binary"), kind


def _start(nodes: DataFrame, kind: str, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """First edges (node, nbr, cos, inside), and a table they are read from: NEXT followers in each of TABLES orders, and
    the NEXT rows before the run of a row's region. An order sorts by length, hyperplane
    code and projection; it is dealt by range, so that a dense region is split over tasks
    like any other. `inside` tells an edge within a region (nodes has `region`)."""
    bits = max(1, int(np.ceil(np.log2(max(count, 2) / 16))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vectors = b.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                x = _unit([vectors[i] for i in at], kind)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((x.shape[1], TABLES, bits + 1))
                y = np.einsum("nd,dtb->ntb", x, planes[size])
                codes = ((y[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2)
                sub = b.take(pa.array(at))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(np.full(len(at), int(size))), pa.array(codes[:, t].astype(np.int64)), pa.array(y[:, t, bits]), sub.column("node"), sub.column("region"), sub.column("vec")], ["t", "size", "code", "place", "node", "region", "vec"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for b in batches:
            if not len(b):
                continue
            whole = pa.Table.from_batches([kept, b] if kept else [b]).combine_chunks()
            new = len(kept) if kept else 0
            n = len(whole)
            group = np.stack([whole[c].to_numpy() for c in ("t", "size", "code")], axis=1)
            node, region, vectors, sizes = whole["node"].to_numpy(), whole["region"].to_numpy(), whole["vec"].to_pylist(), whole["size"].to_numpy()
            fresh = (group[1:] != group[:-1]).any(axis=1) | (region[1:] != region[:-1])
            run = np.maximum.accumulate(np.concatenate([[0], np.where(fresh, np.arange(1, n), 0)]))
            out = []
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                x = _unit([vectors[i] for i in at], kind)
                # lengths sort within an order, so a length's rows of one order are contiguous
                first = np.searchsorted(at, run[at])
                for step in range(1, NEXT + 1):
                    for i in (np.arange(len(at)) - step, first - step):
                        j = np.nonzero(i >= 0)[0]
                        i = i[j]
                        ok = (group[at[i]] == group[at[j]]).all(axis=1) & (at[j] >= new) & (node[at[i]] != node[at[j]])
                        i, j = i[ok], j[ok]
                        out.append((node[at[i]], node[at[j]], (x[i] * x[j]).sum(axis=1), region[at[i]] == region[at[j]]))
            a, c, s, same = (np.concatenate(p) for p in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c])), pa.array(np.concatenate([c, a])), pa.array(np.concatenate([s, s])), pa.array(np.concatenate([same, same]))], ["node", "nbr", "cos", "inside"])
            # the next rows need the last ones, and those before the last run
            last = int(run[-1])
            kept = whole.take(pa.array(np.r_[max(0, last - NEXT) : last, max(last, n - NEXT) : n])).combine_chunks().to_batches()[0]

    rows = written(nodes.select("node", "region", "vec").mapInArrow(code, "t long, size long, code long, place double, node long, region long, vec binary"))
    order = ["t", "size", "code", "place", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(follow, EDGE), rows


def _best(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each node within its region and outside, each once."""
    w = Window.partitionBy("node", "inside").orderBy(F.desc("cos"), "nbr")
    return edges.groupBy("node", "nbr", "inside").agg(F.max("cos").alias("cos")).select("node", "nbr", "cos", "inside").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LIST).drop("r")


def _refine(graph: DataFrame, nodes: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """New edges among each node's neighbours, between regions, that beat the worst of
    either one's list; and, with a null cosine, pairs that join all of these neighbours
    whose cosines link them across regions, whether an edge beats a list or not. Also a
    table that they are read from."""
    back = Window.partitionBy("node", "inside").orderBy(F.desc("cos"), "nbr")
    reverse = graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "cos", "inside").withColumn("r", F.row_number().over(back)).filter(F.col("r") <= LIST).drop("r")
    around = graph.select("node", "nbr").union(reverse.select("node", "nbr")).distinct()
    floor = graph.filter("NOT inside").groupBy("node").agg(F.when(F.count("*") >= LIST, F.min("cos")).otherwise(-1.0).alias("floor"))
    known = written(nodes.select("node", "vec", "region").join(floor, "node", "left").select(F.col("node").alias("nbr"), "vec", "region", F.coalesce("floor", F.lit(-1.0)).alias("floor")))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            node, nbr, floor, region = (t[c].to_numpy() for c in ("node", "nbr", "floor", "region"))
            vectors = t["vec"].to_pylist()
            x = _unit(vectors, kind) if len({len(v) for v in vectors}) == 1 else None
            cut = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1, [len(node)]])
            a, b, s = [], [], []
            joined: list[tuple[np.ndarray, np.ndarray]] = []
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                # neighbours are of one length, whatever other nodes' are
                u = x[low:high] if x is not None else _unit(vectors[low:high], kind)
                c = u @ u.T
                apart = region[low:high, None] != region[None, low:high]
                better = np.triu(apart & ((c > floor[low:high, None]) | (c > floor[None, low:high])), 1)
                i, j = np.nonzero(better)
                a.append(nbr[low + i])
                b.append(nbr[low + j])
                s.append(c[i, j])
                linked = apart & (c >= threshold)
                if linked.any():
                    label, before = np.arange(high - low), None
                    while before is None or (label != before).any():
                        before, label = label, np.minimum(label, np.where(linked, label[None, :], high - low).min(axis=1))
                    i = np.nonzero(label != np.arange(high - low))[0]
                    joined.append((nbr[low + i], nbr[low + label[i]]))
            a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            key, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_index=True)
            more = np.unique(np.concatenate([np.stack(p, axis=1) for p in joined]), axis=0) if joined else np.empty((0, 2), np.int64)
            cos = pa.array(np.concatenate([s[first], np.zeros(len(more))]), mask=np.arange(len(key) + len(more)) >= len(key))
            key = np.concatenate([key, more])
            return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), cos, pa.array(np.zeros(len(key), bool))], ["node", "nbr", "cos", "inside"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            whole = pa.Table.from_batches(held).combine_chunks()
            node = whole["node"].to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last:
                yield pairs(whole.slice(0, last))
            held = whole.slice(last).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    lists = around.join(known, "nbr").select("node", "nbr", "vec", "floor", "region")
    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(local, EDGE), known


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("node", "nbr", "cos", "inside").union(edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "cos", "inside"))


def _labelled(graph: DataFrame, found: DataFrame) -> DataFrame:
    """The graph with `inside` by the components found."""
    mine, other = found.select("node", F.col("component").alias("mine")), found.select(F.col("node").alias("nbr"), F.col("component").alias("other"))
    return graph.drop("inside").join(mine, "node", "left").join(other, "nbr", "left").select("node", "nbr", "cos", F.coalesce(F.expr("mine = other"), F.lit(False)).alias("inside"))


def _state(graph: DataFrame, threshold: float) -> tuple:
    """What a round is expected to better: passing edges, and the mean cosine outside regions."""
    r = graph.agg(F.count(F.when(F.col("cos") >= threshold, 1)), F.round(F.avg(F.when(~F.col("inside"), F.col("cos"))), 2)).first()
    return tuple(r)


def _audit(nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """All true links (node, nbr, cos) of nodes in order of hash: of as many as have AUDIT
    links together, or of ASKED. A pass sends its nodes' vectors to every task."""
    order = nodes.select("node", "vec", F.xxhash64("node", F.lit(11)).alias("h"))
    out, total, size, last, left = None, 0, min(AUDIT, ASKED), None, ASKED
    while True:
        rest = order if last is None else order.filter((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("node") > last[1])))
        asked = rest.orderBy("h", "node").limit(size).collect()
        if out is None or asked:
            links = written(_links(nodes, asked, kind, threshold))
            out = links if out is None else out.union(links)
            total += links.count()
        left -= len(asked)
        if len(asked) < size or total >= AUDIT or not left:
            return out
        last, size = (asked[-1]["h"], asked[-1]["node"]), min(2 * size, PASS, left)


def _links(nodes: DataFrame, asked: list, kind: str, threshold: float) -> DataFrame:
    """All true links (node, nbr, cos) of the asked nodes."""
    names, vectors = np.array([r["node"] for r in asked], np.int64), [bytes(r["vec"]) for r in asked]
    step = max(1, 4_000_000 // max(1, len(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for v in vectors}:
            theirs = [i for i, v in enumerate(vectors) if len(v) == size]
            units[size] = names[theirs], _unit([vectors[i] for i in theirs], kind)
        for b in (part for whole in batches for part in (whole.slice(i, step) for i in range(0, len(whole), step))):
            node, vec = b.column("node").to_numpy(), b.column("vec").to_pylist()
            for size in {len(v) for v in vec} & set(units):
                mine = [i for i, v in enumerate(vec) if len(v) == size]
                c = units[size][1] @ _unit([vec[i] for i in mine], kind).T
                i, j = np.nonzero(c >= threshold)
                a, o, s = units[size][0][i], node[mine][j], c[i, j]
                ok = a != o
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(o[ok]), pa.array(s[ok])], ["node", "nbr", "cos"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, nbr long, cos double")


def _blocks(nodes: DataFrame, found: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(component, node, vec, copies, block) of the nodes in regions, and the pairs of
    blocks (i, j) that may hold links, each once.

    Regions of up to BLOCK / 2 rows share blocks, by a hash. A larger one is dealt by its
    rows' hyperplane codes, so that a block's rows lie together; a code that still has too
    many rows is salted. No region is ever in one task."""
    spark = nodes.sparkSession

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vectors, out = b.column("vec").to_pylist(), np.zeros(len(b), np.int64)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                x = _unit([vectors[i] for i in at], kind)
                if size not in planes:
                    planes[size] = np.random.default_rng([99, int(size)]).standard_normal((x.shape[1], CODE))
                # lengths never link, so they begin the code
                out[at] = (int(size) << CODE) + ((x @ planes[size] > 0) << np.arange(CODE)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "code"])

    sizes = written(found.groupBy("component").agg(F.count("*").alias("n")))
    shared = max(1, -(-(sizes.filter(F.col("n") <= BLOCK // 2).agg(F.sum("n")).first()[0] or 0) // BLOCK))
    rows = found.join(sizes, "component").join(nodes, "node").select("component", "n", "node", "vec", "copies")
    small = rows.filter(F.col("n") <= BLOCK // 2).select("component", "node", "vec", "copies", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(shared))).alias("block"))
    large = rows.filter(F.col("n") > BLOCK // 2).mapInArrow(code, "component long, n long, node long, vec binary, copies long, code long")
    bits = F.least(F.lit(CODE), F.ceil(F.log2(F.col("n") / BLOCK)).cast("int") + 2)
    large = written(large.withColumn("cell", F.shiftright("code", CODE) * (1 << CODE) + F.pmod("code", F.pow(F.lit(2.0), bits).cast("long"))).drop("code"))
    cells = written(large.groupBy("component", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("salts")))
    salted = large.join(cells, ["component", "cell"]).withColumn("block", F.concat_ws("-", "component", "cell", F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts"))))
    placed = written(small.union(salted.select("component", "node", "vec", "copies", "block")))

    def summary(t: pa.Table) -> pa.Table:
        x = _unit(t["vec"].to_pylist(), kind)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        return pa.table({"component": t["component"][:1], "block": t["block"][:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    balls = written(placed.filter(~F.startswith("block", F.lit("s"))).select("component", "block", "vec").groupBy("block").applyInArrow(summary, "component long, block string, centre array<double>, radius double"))
    a = balls.select("component", F.col("block").alias("i"), F.col("centre").alias("ci"), F.col("radius").alias("ri"))
    b = balls.select("component", F.col("block").alias("j"), F.col("centre").alias("cj"), F.col("radius").alias("rj"))
    apart = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return placed, a.join(b, "component").filter((F.col("i") <= F.col("j")) & (F.size("ci") == F.size("cj"))).select("i", "j", (apart - F.col("ri") - F.col("rj")).alias("gap"))


def _regions(nodes: DataFrame, found: DataFrame, kind: str, threshold: float, joins: bool = False) -> DataFrame:
    """(node, links) of the nodes in regions: their links inside, by weight. With `joins`,
    (node, links, other): also rows without links that connect all that links connect."""
    placed, near = _blocks(nodes, found, kind)
    # the distance of two unit vectors whose cosine is the threshold, and some for rounding
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    own = placed.select("block").distinct().select(F.col("block").alias("i"), F.col("block").alias("j"))
    pairs = written(own.union(near.filter((F.col("i") < F.col("j")) & (F.col("gap") <= reach)).select("i", "j")))
    first = placed.join(pairs.withColumnRenamed("i", "block"), "block").select(F.col("block").alias("i"), "j", F.lit(True).alias("asks"), "component", "node", "vec", "copies")
    second = placed.join(pairs.filter("i < j").withColumnRenamed("j", "block"), "block").select("i", F.col("block").alias("j"), F.lit(False).alias("asks"), "component", "node", "vec", "copies")

    def count(t: pa.Table) -> pa.Table:
        vectors, asks = t["vec"].to_pylist(), np.array(t["asks"].to_pylist())
        node, copies, component = (t[c].to_numpy() for c in ("node", "copies", "component"))
        sizes = np.array([len(v) for v in vectors])
        out = [np.empty((3, 0), np.int64)]
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            x = _unit([vectors[i] for i in at], kind)
            mine, theirs = np.nonzero(asks[at])[0], np.nonzero(~asks[at])[0]
            one = not len(theirs) and t["i"][0].as_py() == t["j"][0].as_py()
            theirs = mine if one else theirs
            q, o = at[mine], at[theirs]
            linked = (x[mine] @ x[theirs].T >= threshold) & (node[q][:, None] != node[o][None, :]) & (component[q][:, None] == component[o][None, :])
            out.append(np.stack([node[q], linked @ copies[o], np.full(len(q), -1)]))
            if not one:
                out.append(np.stack([node[o], linked.T @ copies[q], np.full(len(o), -1)]))
            if joins:
                out.append(_spanning(linked, node[q], node[o]))
        a, n, b = np.concatenate(out, axis=1)
        counts = b == -1
        return pa.table({"node": pa.array(a), "links": pa.array(n, mask=~counts), "other": pa.array(b, mask=counts)})

    both = first.union(second).groupBy("i", "j").applyInArrow(count, "node long, links long, other long")
    counts = both.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    if joins:
        both = written(both)
        return both.filter("other IS NOT NULL").select("node", F.lit(None).cast("long").alias("links"), "other").union(both.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links")).select("node", "links", F.lit(None).cast("long")))
    return counts


def _spanning(linked: np.ndarray, q: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Columns (node, 0, other) that connect what a block of links connects: each row and
    column to the least one it reaches; labels spread and jump until they settle."""
    n, names = len(q), np.concatenate([q, o])
    label = np.arange(len(names))
    while True:
        before = label.copy()
        label[:n] = np.minimum(label[:n], np.where(linked, label[None, n:], len(names)).min(axis=1, initial=len(names)))
        label[n:] = np.minimum(label[n:], np.where(linked, label[:n, None], len(names)).min(axis=0, initial=len(names)))
        label = label[label]
        if (label == before).all():
            break
    moved = np.nonzero(label != np.arange(len(names)))[0]
    return np.stack([names[moved], np.zeros(len(moved), np.int64), names[label[moved]]])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept, audit_recall) of each row.

    Two vectors of equal length link when their cosine in double precision is threshold
    or more. A vector that is null, empty, zero, or has null or non-finite components
    links with nothing. Repeated rows are linked copies of one vector; rows with a null key
    count as links but name no component, and are not kept. audit_recall is the share of
    the audited nodes' true links whose ends the graph has brought into one region, in which
    all links are counted; 1 where they have none. Other
    columns are not returned. An empty table gives none."""
    spark = df.sparkSession
    rows, kind = _vectors(df, key, vector)
    rows = written(rows)
    nodes = written(rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).select("vec", "least", "copies", F.coalesce("least", F.xxhash64("vec")).alias("node")))
    count = nodes.count()
    graph = written(spark.createDataFrame([], EDGE))
    found = written(spark.createDataFrame([], "node long, component long"))
    truth, recall = _audit(nodes, kind, threshold), 1.0
    total = truth.count()
    caught = lambda found: truth.join(found, "node").join(found.select(F.col("node").alias("nbr"), F.col("component").alias("other")), "nbr").filter("component = other").count()
    for attempt in range(ATTEMPTS if count > 1 else 0):
        placed = written(nodes.select("node", "vec").join(found, "node", "left").select("node", "vec", F.coalesce("component", "node").alias("region")))
        begun, source = _start(placed, kind, count, attempt)
        first = written(begun)
        joins = first.filter(f"cos >= {threshold!r} AND NOT inside").select("node", "nbr")
        done, graph = [placed, source, first, graph], written(_best(_labelled(graph, found).union(first)))
        state = _state(graph, threshold)
        for _ in range(ROUNDS):
            made, source = _refine(graph, placed, kind, threshold)
            new = written(made)
            joins = joins.union(new.filter("cos IS NULL").select("node", "nbr"))
            done += [source, new, graph]
            graph = written(_best(graph.union(_both(new.filter("cos IS NOT NULL")))))
            before, state = state, _state(graph, threshold)
            if state == before:
                break
        joins = written(joins.distinct())
        quiet = joins.isEmpty()
        if not quiet:
            found = written(components(found.union(joins).toDF("a", "b")))
        discard(*done)
        recall = caught(found) / total if total else 1.0
        if quiet and recall == 1.0:
            break
    plain = nodes.select("node", "vec", "copies")
    if recall < RECALL:
        everything = written(_regions(plain, nodes.select("node", F.lit(0).cast("long").alias("component")), kind, threshold, joins=True))
        found = written(components(everything.filter("other IS NOT NULL").select("node", "other").toDF("a", "b")))
        counts = everything.filter("links IS NOT NULL").select("node", "links")
        recall = caught(found) / total
    else:
        counts = _regions(plain, found, kind, threshold)
    regions = written(found.join(counts, "node"))
    least = written(regions.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("reached")))
    links = regions.join(least, "component").select("node", "links", "reached")
    final = written(nodes.join(links, "node", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component_id")))
    out = rows.join(final, "vec", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.when(F.col("vec").isNull(), F.col("id"))).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings at a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same links by comparing all pairs; the audit is expected to miss none.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT vec_id, count(b) AS n FROM v LEFT JOIN p ON a = vec_id GROUP BY vec_id),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, n AS n_links, c AS component_id, vec_id = c AS kept, 1.0::DOUBLE AS audit_recall FROM n JOIN c ON a = vec_id
"""
