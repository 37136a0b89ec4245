"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts every word from SIDE words on either side of it: their embeddings,
gated by position, are summed and pass a tanh; a softmax over classes of words and one over
the members of the word's class give its probability, normalised exactly over the whole
vocabulary. A document's score is the sum of the log-probabilities of its words.

The vocabulary is every word that occurs MIN_COUNT times or more in all documents, so it
grows with them. All other words are one more class, in which a word is spelled by byte
pairs, counted over all such words: the probabilities of all possible words add up to 1.

Training: documents are dealt by hash to shards of about SHARD words, whatever the input's
partitions are. From shared first weights a pass over each shard is made in numpy, in order
of hash; what it changes is averaged over shards, each row of weights by how often it was
used, in a distributed aggregation.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, small_batches, table, written

#: Least count of a word of the vocabulary; MAX_WORDS bounds the memory of a worker (beyond
#: it the least frequent are spelled like all others).
MIN_COUNT, MAX_WORDS = 400, 1 << 18
#: Embeddings of words outside the vocabulary, by hash, as neighbours only.
TAILS = 64
SIDE, WIDTH = 2, 8
#: Classes by the square root of the vocabulary.
CLASSES = 0.6
SHARD, BATCH, RATE = 1 << 19, 1 << 14, 0.4
#: Words of a class softmax that are worked on at once.
PART = 2048
#: What is added to each count of byte pairs.
ADDED = 0.1
#: Distinct words that a task counts before it passes its counts on.
DISTINCT = 400_000
#: Rows of weights that travel together, and groups in which tasks' sums are added first.
BLOCK, GROUPS = 4096, 16

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and non-ASCII characters."""
    return (text or b"").translate(_WORD_BYTES).split()


class Spelling:
    """Log-probabilities of words by byte pairs (256 stands for a word's begin and end),
    given that the word is not in the vocabulary."""

    def __init__(self, pairs: np.ndarray, vocabulary: list[bytes]):
        counts = pairs.reshape(257, 257) + ADDED
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        known = np.exp(self._plain(vocabulary)).sum() if vocabulary else 0.0
        self.rest = float(np.log(max(1e-9, 1.0 - known - np.exp(self.log[256, 256]))))

    def _plain(self, found: list[bytes]) -> np.ndarray:
        a, b, owner = pairs_of(found)
        return np.bincount(owner, self.log[a, b], len(found))

    def of(self, found: list[bytes]) -> np.ndarray:
        """Log-probability of each word."""
        return self._plain(found) - self.rest


def pairs_of(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second byte of all pairs of some words, ends included, and their words."""
    n = np.array([len(w) for w in found], np.int64)
    flat = np.full(int(n.sum()) + len(n) + 1, 256, np.int64)
    at = np.arange(int(n.sum())) + np.repeat(np.arange(1, len(n) + 1), n)
    flat[at] = np.frombuffer(b"".join(found), np.uint8)
    return flat[:-1], flat[1:], np.repeat(np.arange(len(n)), n + 1)


class Codes(dict):
    """Word -> number: vocabulary words by rank, then others as they come; `bucket` and
    `cost` tell the hash class and the log-probability of those."""

    def __init__(self, vocabulary: list[bytes], spelling: Spelling):
        super().__init__({w: i for i, w in enumerate(vocabulary)})
        self.vocabulary, self.spelling = vocabulary, spelling
        self.fresh: list[bytes] = []
        self.bucket, self.cost = np.empty(0, np.int64), np.empty(0)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.vocabulary) + len(self.bucket) + len(self.fresh)
        self.fresh.append(word)
        return i

    def ids(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and what the spelling of those outside the vocabulary costs."""
        size = len(self.vocabulary)
        if len(self.bucket) > 2 * DISTINCT:
            self.clear()
            self.update({w: i for i, w in enumerate(self.vocabulary)})
            self.bucket, self.cost = np.empty(0, np.int64), np.empty(0)
        code = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.fresh:
            self.bucket = np.concatenate([self.bucket, [zlib.crc32(w) % TAILS for w in self.fresh]])
            self.cost = np.concatenate([self.cost, self.spelling.of(self.fresh)])
            self.fresh = []
        tail = np.nonzero(code >= size)[0]
        cost = np.zeros(len(code))
        cost[tail] = self.cost[code[tail] - size]
        code[tail] = size + self.bucket[code[tail] - size]
        return code, cost


class Network:
    """The window network over a vocabulary of given counts, most frequent first, and
    `tail` words outside it. Classes are runs of ranks of about equal sums of square roots
    of counts, so frequent words have classes to themselves."""

    def __init__(self, counts: np.ndarray, tail: float, seed: int = 0):
        counts = np.asarray(counts, np.float64)
        self.size = v = len(counts)
        root = np.sqrt(counts)
        wanted = max(1, round(CLASSES * v**0.5))
        dealt = np.floor((np.cumsum(root) - root) / max(root.sum(), 1e-9) * wanted).astype(np.int64)
        self.class_of = np.append(np.unique(dealt, return_inverse=True)[1], np.full(TAILS, -1)) if v else np.full(TAILS, -1)
        self.classes = int(self.class_of.max(initial=-1)) + 1
        self.class_of[v:] = self.classes
        self.low = np.searchsorted(self.class_of[:v], np.arange(self.classes + 1))
        mass = np.append(np.add.reduceat(counts, self.low[:-1]) if v else [], tail) + 1.0
        rng = np.random.default_rng(seed)
        normal = lambda mean, sd, *shape: rng.normal(mean, sd, shape).astype(np.float32)
        self.parts = {
            "embedding": normal(0, 0.3, v + TAILS + 1, WIDTH),
            "member": np.hstack([normal(0, 0.1, v, WIDTH), np.log((counts + 1.0) / mass[self.class_of[:v]])[:, None].astype(np.float32)]),
            "head": np.hstack([normal(0, 0.1, len(mass), WIDTH), np.log(mass / mass.sum())[:, None].astype(np.float32)]),
            "gate": np.vstack([normal(1, 0.3, 2 * SIDE, WIDTH), np.zeros((1, WIDTH), np.float32)]),
        }

    def copy(self) -> Network:
        """A network with weights of its own."""
        out = object.__new__(Network)
        out.__dict__ = self.__dict__ | {"parts": {k: x.copy() for k, x in self.parts.items()}}
        return out

    def _hidden(self, around: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        gate = self.parts["gate"]
        near = [self.parts["embedding"].take(a, axis=0) for a in around]
        h = gate[-1] + near[0] * gate[0]
        for k in range(1, 2 * SIDE):
            h += near[k] * gate[k]
        return np.tanh(h, out=h), near

    @staticmethod
    def _exponentials(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities of rows of h (with a column of ones) under weights w
        (a row an output, its bias last), and their sums."""
        z = h @ w.T
        with np.errstate(over="ignore"):
            p = np.exp(z)
            total = p.sum(axis=1)
        if not (np.isfinite(total).all() and total.min(initial=1.0) > 0):
            p = np.exp(z - z.max(axis=1, keepdims=True))
            total = p.sum(axis=1)
        return p, total

    def _sorted(self, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by word, hence by class; the words so; and where each class ends."""
        order = _order(center)
        words = center[order]
        return order, words, np.searchsorted(words, self.low)

    def log_probabilities(self, center: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log-probability of each center word given its neighbours (2 * SIDE rows); of a
        word outside the vocabulary, that it is one."""
        head, member = self.parts["head"], self.parts["member"]
        out = np.empty(len(center))
        for low in range(0, len(center), 2 * BATCH):
            c = center[low : low + 2 * BATCH]
            order, words, ends = self._sorted(c)
            h = _with_ones(self._hidden(around[:, low : low + 2 * BATCH])[0])[order]
            cls, lp = self.class_of[words], np.empty(len(c))
            for i in range(0, len(c), PART):
                p, total = self._exponentials(h[i : i + PART], head)
                lp[i : i + PART] = np.log(np.maximum(p[np.arange(len(p)), cls[i : i + PART]], 1e-30) / total)
            for k in range(self.classes):
                a, b = ends[k], ends[k + 1]
                if b > a and self.low[k + 1] - self.low[k] > 1:
                    p, total = self._exponentials(h[a:b], member[self.low[k] : self.low[k + 1]])
                    lp[a:b] += np.log(np.maximum(p[np.arange(b - a), words[a:b] - self.low[k]], 1e-30) / total)
            out[low + order] = lp
        return out

    def gradients(self, center: np.ndarray, around: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean negative log-probability by part, and the rows of
        embeddings that theirs belong to. Words are gone through sorted, so that a class
        is a slice; what a softmax pushes away is summed by matrix products, what it pulls
        to the words that are there by runs of equal ones."""
        n = len(center)
        head, member, gate = (self.parts[k] for k in ("head", "member", "gate"))
        order, words, ends = self._sorted(center)
        around = around[:, order]
        h, near = self._hidden(around)
        h1 = _with_ones(h)
        cls, scale = self.class_of[words], np.float32(1 / n)
        gh, ghead, gmember = np.empty((n, WIDTH + 1), np.float32), np.zeros_like(head), np.zeros_like(member)
        for i in range(0, n, PART):
            hi = h1[i : i + PART]
            p, total = self._exponentials(hi, head)
            weight = (scale / total)[:, None]
            gh[i : i + PART] = (p @ head) * weight
            ghead += p.T @ (hi * weight)
        for k in range(self.classes):
            a, b, u, v = ends[k], ends[k + 1], self.low[k], self.low[k + 1]
            if b > a and v - u > 1:
                p, total = self._exponentials(h1[a:b], member[u:v])
                weight = (scale / total)[:, None]
                gh[a:b] += (p @ member[u:v]) * weight
                gmember[u:v] = p.T @ (h1[a:b] * weight)
        inside = ends[-1]
        for of, g, last in ((cls, ghead, n), (words[:inside], gmember, inside)):
            if last:
                first = _runs(of[:last])
                g[of[first]] -= scale * np.add.reduceat(h1[:last], first, axis=0)
        alone = np.diff(self.low) == 1
        gmember[self.low[:-1][alone]] = 0
        gh -= scale * head[cls]
        several = np.append(~alone, False)[cls[:inside]]
        gh[:inside][several] -= scale * member[words[:inside][several]]
        g = gh[:, :WIDTH] * (1 - h * h)
        ids, grads = around.ravel(), np.concatenate([g * gate[k] for k in range(2 * SIDE)])
        by_id = _order(ids)
        ids = ids[by_id]
        first = _runs(ids)
        ggate = np.stack([*((g * x).sum(axis=0) for x in near), g.sum(axis=0)])
        return {"head": ghead, "member": gmember, "gate": ggate, "embedding": np.add.reduceat(grads[by_id], first, axis=0)}, ids[first]

    def step(self, center: np.ndarray, around: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One batch of Adagrad."""
        gradients, rows = self.gradients(center, around)
        for name, g in gradients.items():
            part, square = self.parts[name], squares[name]
            at = rows if name == "embedding" else None
            total = g * g
            total += square if at is None else square[at]
            if at is None:
                square[:] = total
            else:
                square[at] = total
            np.sqrt(total, out=total)
            g /= total
            g *= RATE
            if at is None:
                part -= g
            else:
                part[at] -= g

    def squares(self) -> dict[str, np.ndarray]:
        """Fresh sums of squared gradients."""
        return {k: np.full(x.shape, 1e-6, np.float32) for k, x in self.parts.items()}

    def used(self, center: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """How often each row of weights is used by some words and their neighbours."""
        by_class = np.bincount(self.class_of[center], minlength=self.classes + 1)
        every = lambda k: np.full(len(self.parts[k]), len(center))
        return {"embedding": np.bincount(around.ravel(), minlength=len(self.parts["embedding"])), "member": by_class[self.class_of[: self.size]], "head": every("head"), "gate": every("gate")}


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), WIDTH + 1), np.float32)
    out[:, :WIDTH] = h
    return out


def _order(x: np.ndarray) -> np.ndarray:
    """Places of values below 2^31 in order, equal ones as they stand: value and place are
    sorted as one number."""
    return np.sort((x << 32) | np.arange(len(x))) & 0xFFFFFFFF


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1])


def windows(ids: np.ndarray, counts: np.ndarray, pad: int) -> np.ndarray:
    """The 2 * SIDE neighbours of each word of documents of given lengths."""
    at = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    flat = np.full(len(ids) + SIDE * (len(counts) + 1), pad, np.int64)
    flat[at] = ids
    return np.stack([flat[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks count first what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for _, texts in rows_of(batches, "_text", "_text"):
            for t in texts:
                found.update(words(t))
                if len(found) > DISTINCT:
                    yield out(found)
                    found = Counter()
        if found:
            yield out(found)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(tail: DataFrame) -> np.ndarray:
    """Counts of byte pairs in words (word, n): at most 257 squared sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257 * 257, np.int64)
        for b in batches:
            a, c, owner = pairs_of(b.column("word").to_pylist())
            np.add.at(total, a * 257 + c, b.column("n").to_numpy()[owner])
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    out = np.zeros(257 * 257, np.int64)
    for r in tail.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[list[bytes], np.ndarray, Spelling, int]:
    """Words of the vocabulary (most frequent first) and their counts, the spelling of all
    others, and the number of those, over all documents (_text)."""
    counts = written(count_words(docs))
    often = counts.filter(F.col("n") >= min_count)
    if often.count() > MAX_WORDS:
        often = often.orderBy(F.desc("n"), "word").limit(MAX_WORDS)
    top = sorted(((r["n"], bytes(r["word"])) for r in often.collect()), key=lambda x: (-x[0], x[1]))
    last = (top[-1] if len(top) == MAX_WORDS else (min_count, b"")) if top else (min_count, b"")
    out = (F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > F.lit(bytearray(last[1])))) if len(top) == MAX_WORDS else F.col("n") < min_count
    tail = counts.filter(out)
    known = [w for _, w in top]
    rest = tail.agg(F.sum("n").alias("n")).first()["n"] or 0
    return known, np.array([n for n, _ in top], np.int64), Spelling(count_pairs(tail), known), int(rest)


def encode(df: DataFrame, key: str, text: str, known: list[bytes], spelling: Spelling) -> DataFrame:
    """(_key, _hash, ids, spelled) of each row: its words' ids, and the log-probability of
    the spellings of those outside the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(known, spelling)
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                found = list(map(words, texts))
                n = np.array([len(x) for x in found], np.int64)
                ids, cost = codes.ids([w for x in found for w in x])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                spelled = np.bincount(np.repeat(np.arange(len(n)), n), cost, len(n)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_hash"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(spelled)], ["_key", "_hash", "ids", "spelled"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *T._parse_datatype_string("_hash long, ids array<int>, spelled double").fields])
    return df.select(df[key].alias("_key"), df[text].alias("_text"), F.xxhash64(df[key], df[text]).alias("_hash")).mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list column, and their numbers by row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), np.diff(offsets)


def train(encoded: DataFrame, net: Network, total: int, rounds: int = 1) -> Network:
    """The network after `rounds` passes over all of `encoded`, averaged over its shards."""
    shards = max(1, -(-total // SHARD))
    sums = "part string, block int, salt int, rows binary, changes binary, weights binary"
    width = {k: x.shape[1] for k, x in net.parts.items()}
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start: Network = net) -> Iterator[pa.RecordBatch]:
            changes = {k: np.zeros(x.shape) for k, x in start.parts.items()}
            weights = {k: np.zeros(len(x)) for k, x in start.parts.items()}
            now, own, squares, use, held, size, salt = None, start, {}, {}, [], 0, 0

            def learn() -> None:
                """Steps over the words held, in an order that depends on the shard alone."""
                center, around = np.concatenate([c for c, _ in held]), np.concatenate([a for _, a in held], axis=1)
                mixed = np.random.default_rng([now, len(center)]).permutation(len(center))
                center, around = center[mixed], around[:, mixed]
                for i in range(0, len(center), BATCH):
                    own.step(center[i : i + BATCH], around[:, i : i + BATCH], squares)
                for k, n in own.used(center, around).items():
                    use[k] = use[k] + n

            def close() -> None:
                for k, n in use.items():
                    changes[k] += n[:, None] * (own.parts[k].astype(np.float64) - start.parts[k])
                    weights[k] += n

            for b in batches:
                shard = b.column("shard").to_numpy()
                for s in np.unique(shard):
                    if s != now:
                        if held:
                            learn()
                        if now is not None:
                            close()
                        now, own, squares, held, size = int(s), start.copy(), start.squares(), [], 0
                        use, salt = dict.fromkeys(start.parts, 0), now
                    first, last = np.searchsorted(shard, [s, s + 1])
                    ids, counts = _flat(b.column("ids").slice(first, last - first))
                    around = windows(ids, counts, len(start.parts["embedding"]) - 1)
                    # a shard that holds very many equal rows is gone through in pieces
                    while len(ids):
                        n = min(len(ids), 4 * SHARD - size)
                        held.append((ids[:n], around[:, :n]))
                        ids, around, size = ids[n:], around[:, n:], size + n
                        if size == 4 * SHARD:
                            learn()
                            held, size = [], 0
            if now is None:
                return
            if held:
                learn()
            close()
            for k, w in weights.items():
                for i in range(0, len(w), BLOCK):
                    rows = np.nonzero(w[i : i + BLOCK])[0] + i
                    if len(rows):
                        data = (rows.astype(np.int32), changes[k][rows].astype(np.float32), w[rows])
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i // BLOCK], pa.int32()), pa.array([salt % GROUPS], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["part", "block", "salt", "rows", "changes", "weights"])

        def add(t: pa.Table) -> pa.Table:
            k, i = t["part"][0].as_py(), t["block"][0].as_py()
            total, weight = np.zeros((BLOCK, width[k])), np.zeros(BLOCK)
            for r, c, w in zip(*(t[x].to_pylist() for x in ("rows", "changes", "weights")), strict=True):
                rows = np.frombuffer(r, np.int32) - i * BLOCK
                total[rows] += np.frombuffer(c, np.float32).reshape(len(rows), -1)
                weight[rows] += np.frombuffer(w)
            rows = np.nonzero(weight)[0]
            data = ((rows + i * BLOCK).astype(np.int32), total[rows].astype(np.float32), weight[rows])
            return pa.table({"part": [k], "block": pa.array([i], pa.int32()), "salt": pa.array([0], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("rows", "changes", "weights"), data, strict=True)}})

        dealt = encoded.filter(F.size("ids") > 0).select(F.pmod("_hash", F.lit(shards)).alias("shard"), "_hash", "ids")
        made = dealt.repartition("shard").sortWithinPartitions("shard", "_hash", "ids").select("shard", "ids").mapInArrow(run, sums)
        made = made.groupBy("part", "block", "salt").applyInArrow(add, sums).groupBy("part", "block").applyInArrow(add, sums)
        after = net.copy()
        for r in made.collect():
            rows, x = np.frombuffer(r["rows"], np.int32), after.parts[r["part"]]
            x[rows] += (np.frombuffer(r["changes"], np.float32).reshape(len(rows), -1) / np.frombuffer(r["weights"])[:, None]).astype(np.float32)
        net = after
    return net


def score(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 1, min_count: int = MIN_COUNT) -> DataFrame:
    """(key, n_tokens, log_likelihood, mean_log_likelihood, n_spelled) of each row, by a
    network trained on all rows; n_spelled counts words outside the vocabulary.

    A null or empty text, or one without words, has no tokens: a sum of 0 and a null mean.
    Null keys and repeated rows are trained on and scored each; other columns are not
    returned. An empty table gives none. Shards, their order and their batches follow from
    the rows alone; sums over shards are added in any order, which may change the last
    digits of a weight."""
    small_batches(df.sparkSession)
    known, counts, spelling, rest = vocabulary(df.select(df[text].alias("_text")), min_count)
    encoded = written(encode(df, key, text, known, spelling))
    net = train(encoded, Network(counts, rest), int(counts.sum()) + rest, rounds)
    pad = len(net.parts["embedding"]) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = _flat(b.column("ids"))
            owner = np.repeat(np.arange(len(n)), n)
            sums = np.bincount(owner, net.log_probabilities(ids, windows(ids, n, pad)), len(n)) + b.column("spelled").to_numpy()
            spelled = np.bincount(owner, ids >= net.size, len(n)).astype(np.int64)
            mean = pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(n.astype(np.int64)), pa.array(np.round(sums, 4)), mean, pa.array(spelled)], [key, "n_tokens", "log_likelihood", "mean_log_likelihood", "n_spelled"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string("n_tokens long, log_likelihood double, mean_log_likelihood double, n_spelled long").fields])
    return encoded.select("_key", "ids", "spelled").mapInArrow(run, schema)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every whole text of documents under a network trained on all."""
    return score(table(spark, sf_dir, "documents"))
