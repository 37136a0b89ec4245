"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents (SAMPLE rows) and
flattened into node arrays; scoring walks all documents of a batch down all trees at
once. Features in MONOTONE can only move the score in one direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, small_batches, table, utf8

#: Labelled documents that the classifier is fitted on at most: those of smallest hash.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents whose probability of being good is lower are rejected.
THRESHOLD = 0.3

_SPACE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_digits", "n_upper", "n_ends", "longest")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "end_share", "log_longest")
#: Feature -> sign of its effect on the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size == n:
        return 0
    if size < 1 << 20:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        key = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """COUNTS and MORE of a whole text (UTF-8 bytes; None as empty)."""
    b = text or b""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    distinct = len(set(words))
    digits = len(b) - len(b.translate(None, b"0123456789"))
    upper = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ends = sum(map(b.count, (b".", b"!", b"?")))
    return (
        len(words),
        len(b.translate(None, _SPACE + _INNER)),
        len(b) - len(b.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        distinct,
        digits,
        upper,
        ends,
        max(map(len, words), default=0),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from rows of COUNTS and MORE."""
    words, chars, symbols, dup, repeat, lines, distinct, digits, upper, ends, longest = counts.astype(np.float64).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(words), chars / w, symbols / c, dup / np.maximum(lines, 1), repeat / w, distinct / w, digits / c, upper / c, ends / w, np.log1p(longest)], axis=1)


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat node arrays. A leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features; all trees advance one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss with histogram splits.

    signs: for each feature the direction (-1, 0, 1) in which it may move the score; a
    split against it is not taken, and the middle of two children's values bounds all
    values below them. Ties go to the first feature and the lowest threshold."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(good / (1 - good)))
    raw = np.full(n, bias)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        work = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while work:
            k, rows, level, low, high = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + ridge), low, high))
            nodes[k] = [0, 0.0, k, k, rate * value]
            best = (1e-6, None)
            for j in range(width) if level < depth and len(rows) >= 2 * least else ():
                if not len(edges[j]):
                    continue
                b, size = binned[rows, j], len(edges[j]) + 1
                gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                wl = np.clip(-gl / (hl + ridge), low, high)
                wr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = lambda w, gg, hh: -(2 * gg * w + (hh + ridge) * w * w)
                won = gain(wl, gl, hl) + gain(wr, gs - gl, hs - hl) - gain(value, gs, hs)
                won[(nl < least) | (len(rows) - nl < least) | (signs[j] * (wr - wl) < 0)] = -np.inf
                i = int(np.argmax(won))
                if won[i] > best[0]:
                    best = (won[i], (j, i, float(wl[i]), float(wr[i])))
            if best[1]:
                j, i, wl, wr = best[1]
                a, c = len(nodes), len(nodes) + 1
                nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, c, c, 0.0]]
                nodes[k] = [j, float(edges[j][i]), a, c, 0.0]
                goes = binned[rows, j] <= i
                mid = (wl + wr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[j])]
                work += [(a, rows[goes], level + 1, *bounds[0]), (c, rows[~goes], level + 1, *bounds[1])]
            else:
                raw[rows] += rate * value
    f, t, left, right, v = zip(*nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), np.array(roots), depth, bias)


_COUNT_TYPES = [(n, pa.int64()) for n in COUNTS + MORE]


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, COUNTS and MORE of each row's whole text, row by row (null text: no words)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                found = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(_COUNT_TYPES))
                yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array(c) for c in found.T)], [key, *COUNTS, *MORE])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in COUNTS + MORE)])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on at most `sample` labelled documents, or None without both classes.

    Of repeated labels of a document the lowest counts; null ids and labels are left out.
    The sampled ids (at most `sample` longs) are broadcast; at most one row of statistics
    for each comes back."""
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = document_statistics(texts.select("doc_id", "text"))
    one = found.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *MORE)).alias("s")).join(F.broadcast(some), "doc_id")
    rows = one.orderBy("doc_id").select("quality", "s.*").toPandas().to_numpy()
    if not len(rows) or len(set(rows[:, 0] > 0)) < 2:
        return None
    return fit(features(rows[:, 1:]), (rows[:, 0] > 0).astype(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def rate(documents: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Key, COUNTS, base_failed, quality_score and kept of each row's whole text.

    kept is false where the base rules fail, else whether the trees give at least
    `threshold` (all, without trees). A null or empty text has no words and so fails the
    base. Repeated rows are rated each; other columns are not returned. An empty table
    gives none. One narrow stage; the trees are a few thousand numbers."""
    small_batches(documents.sparkSession)
    names = [key, *COUNTS, "base_failed", "quality_score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                found = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(_COUNT_TYPES))
                score = trees.score(features(found)) if trees and len(found) else np.ones(len(found))
                failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEATED * found[:, 0])
                columns = [pa.array(found[:, i]) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([b.column("_key"), *columns, pa.array(failed), pa.array(np.round(score, 6)), pa.array(~failed & (score >= threshold))], names)

    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return documents.select(documents[key].alias("_key"), documents[text].alias("_text")).mapInArrow(run, schema)


def keep(documents: DataFrame, trees: Trees | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that rate() would keep, with all their columns, whatever
    their names. Each row goes by its own text, so no join is needed."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(t) for t in utf8(b.column(at))], np.int64).reshape(-1, len(_COUNT_TYPES))
            score = trees.score(features(found)) if trees and len(found) else np.ones(len(found))
            failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEATED * found[:, 0])
            yield b.filter(pa.array(~failed & (score >= threshold)))

    return documents.mapInArrow(run, documents.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, train(docs, table(spark, sf_dir, "labels")))
