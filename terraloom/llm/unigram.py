"""SentencePiece-style encoding: Viterbi over a double-array trie of scored pieces.

The pieces are a public model's; their log scores are estimated on the corpus itself, as
that model's are merge ranks: the parts of all documents are counted, and the best paths of
the distinct parts, at first the shortest ones, are counted anew in each of ROUNDS rounds.

White space becomes a marker, texts get one marker in front, and the best-scoring sequence
of pieces is found by dynamic programming. A character that no piece covers is spelled in
byte pieces. As no piece holds a marker behind another character, texts fall apart before
markers; the distinct parts of a batch are encoded together, as rows of arrays.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, written

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far an uncovered character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Times that scores are estimated, and what is added to each count.
ROUNDS, ADDED = 2, 0.5
#: Parts of up to SHORT bytes are encoded together, ROWS at a time; longer ones one by one.
SHORT, ROWS = 64, 16_384
#: Distinct parts that a task counts before it passes its counts on, and bytes of parts
#: that are counted at once.
DISTINCT, DISTINCT_BYTES = 400_000, 1 << 24
#: Bytes of rows that are worked on together.
GATHER = 1 << 23

_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Stands between parts while a batch is split; texts that hold it are split one by one.
_CUT = "\x01"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and raw value."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        wire = tag & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id from a model file."""
    with open(path, "rb") as f:
        model = f.read()
    out = []
    for number, value in _fields(model):
        if number == 1:
            x = dict(_fields(value))
            out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
    return out


class DoubleArray:
    """A double-array trie over bytes: from state s, byte c leads to base[s] + c + 1 if
    check there names s; value is the id that ends in a state, or -1."""

    def __init__(self, words: dict[bytes, int]):
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        children: dict[bytes, set[int]] = {}
        for w in words:
            for i in range(len(w)):
                children.setdefault(w[:i], set()).add(w[i])
        free, low, queue = 258, 258, [(b"", 0)]
        for prefix, state in queue:
            if (v := words.get(prefix)) is not None and prefix:
                value[state] = v
            codes = sorted(children.get(prefix, ()))
            if not codes:
                continue
            while check[free] >= 0:
                free += 1
            # several children need a gap that fits; where gaps got rare, the search moves on
            begin = at = (free if len(codes) == 1 else max(low, free)) - codes[0] - 1
            while True:
                if at + 300 > size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if all(check[at + c + 1] < 0 for c in codes):
                    break
                at += 1
            if len(codes) > 1 and at - begin > 32:
                low = at
            base[state] = at
            for c in codes:
                check[at + c + 1] = state
                queue.append((prefix + bytes([c]), at + c + 1))
            if free + 300 > size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                size *= 2
        end = max(i for i, c in enumerate(check) if c >= 0) + 258
        self.base, self.check, self.value = base[:end], check[:end], value[:end]

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, id) of every word that begins at start, shortest first."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(start, len(text)):
            after = base[state] + text[i] + 1
            if check[after] != state or not after:
                return
            state = after
            if value[state] >= 0:
                yield i + 1, value[state]


class Unigram:
    """Encoder and decoder of a set of pieces under given log scores by id (None: every
    normal piece scores -1, so that the shortest path is best)."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: np.ndarray | None = None):
        self.kinds = np.array([k for _, _, k in pieces])
        self.normal = self.kinds == NORMAL
        self.trie = _trie(tuple((p, k) for p, _, k in pieces))
        self.scores = np.where(self.normal, -1.0, 0.0) if scores is None else np.array(scores, np.float64)
        best, worst = (self.scores[self.normal].max(), self.scores[self.normal].min()) if self.normal.any() else (0.0, 0.0)
        for i in np.nonzero(self.kinds == USER)[0]:
            self.scores[i] = len(pieces[i][0]) * best - 0.1
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.bytes_of = {i: v for v, i in self.byte_ids.items()}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.texts = [bytes([self.bytes_of[i]]) if k == BYTE else (p.replace(MARK, " ") if k in (NORMAL, USER, UNUSED) else "" if k != UNKNOWN else " ⁇ ").encode() for i, (p, _, k) in enumerate(pieces)]
        self.spelled = np.array([self.byte_ids.get(x, self.unknown) for x in range(256)])
        self.arrays = tuple(np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))

    def one(self, b: bytes) -> tuple[list[int], float, int]:
        """Ids, score and number of byte pieces of one part's best path; of equal ones the
        piece that begins first (the longest) wins."""
        n = len(b)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        i = 0
        while i < n:
            first = b[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            single = False
            for j, v in self.trie.prefixes(b, i):
                s = best[i] + float(self.scores[v])
                if s > best[j]:
                    best[j], came[j] = s, (i, v)
                single |= j == i + width
            if not single and (s := best[i] + self.unknown_score) > best[i + width]:
                best[i + width], came[i + width] = s, (i, -1)
            i += width
        out: list[int] = []
        fallback, at = 0, n
        while at:
            start, v = came[at]
            if v >= 0:
                out.append(v)
            elif len(self.byte_ids) == 256:
                out.extend(self.byte_ids[x] for x in reversed(b[start:at]))
                fallback += at - start
            else:
                out.append(self.unknown)
            at = start
        return out[::-1], float(best[n]), fallback

    def _together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What one() gives for each of some short parts: all ids, ids by part, scores, byte
        pieces. Positions are gone through in order, each for all parts at once."""
        base, check, value = self.arrays
        n, sizes = len(parts), np.array([len(p) for p in parts])
        most = int(sizes.max(initial=0))
        text = np.zeros((n, most + 4), np.uint8)
        text[np.arange(most + 4) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        width = 1 + (text >= 0xC0).astype(np.int8) + (text >= 0xE0) + (text >= 0xF0)
        best = np.full((n, most + 4), -np.inf)
        best[:, 0] = 0.0
        start, piece = np.zeros((n, most + 4), np.int32), np.zeros((n, most + 4), np.int32)

        def offer(rows: np.ndarray, i: int, j: np.ndarray | int, s: np.ndarray, v: np.ndarray | int) -> None:
            better = s > best[rows, j]
            pick = lambda x: x[better] if isinstance(x, np.ndarray) else x
            at = (rows[better], pick(j))
            best[at], start[at], piece[at] = s[better], i, pick(v)

        for i in range(most):
            begun = np.nonzero((sizes > i) & ((text[:, i] & 0xC0) != 0x80))[0]
            single = np.zeros(n, bool)
            rows, state, j = begun, np.zeros(len(begun), np.int32), i
            while len(rows):
                after = base[state] + text[rows, j] + 1
                ok = (check[after] == state) & (sizes[rows] > j) & (after > 0)
                rows, state, j = rows[ok], after[ok], j + 1
                v = value[state]
                hit = v >= 0
                found, v = rows[hit], v[hit]
                offer(found, i, j, best[found, i] + self.scores[v], v)
                single[found[width[found, i] == j - i]] = True
            left = begun[~single[begun]]
            offer(left, i, i + width[left, i], best[left, i] + self.unknown_score, -1)
        rows, at = np.arange(n), sizes.copy()
        steps = []
        while True:
            on = at[rows] > 0
            rows = rows[on]
            if not len(rows):
                break
            end = at[rows]
            at[rows] = start[rows, end]
            steps.append((rows, at[rows], end, piece[rows, end]))
        if not steps:
            return np.empty(0, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        row, begin, end, v = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((begin, row))
        row, begin, end, v = row[order], begin[order], end[order], v[order]
        spell = (v < 0) & (len(self.byte_ids) == 256)
        many = np.where(spell, end - begin, 1)
        of = np.repeat(np.arange(len(v)), many)
        within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        ids = np.where(v[of] >= 0, v[of], np.where(spell[of], self.spelled[text[row[of], np.minimum(begin[of] + within, most)]], self.unknown))
        return ids, np.bincount(row, many, n).astype(np.int64), best[np.arange(n), sizes], np.bincount(row, spell * many, n).astype(np.int64)

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some parts in their order; numbers of ids, scores and byte pieces."""
        sizes = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], SHORT, "right"))
        found = [self._together([parts[k] for k in order[i : min(i + ROWS, short)]]) for i in range(0, short, ROWS)]
        for k in order[short:]:
            ids, score, fallback = self.one(parts[k])
            found.append((np.array(ids, np.int64), np.array([len(ids)]), np.array([score]), np.array([fallback])))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        ids, count, score, fallback = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(order, kind="stable")
        begin = np.cumsum(count) - count
        return ids[_spread(begin[back], count[back])], count[back], score[back], fallback[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some texts (a string array without nulls) in order; numbers of ids,
        scores and byte pieces by text."""
        parts, number = split(texts)
        coded = parts.dictionary_encode()
        ids, count, score, fallback = self.segment(coded.dictionary.cast(pa.binary()).to_pylist())
        which = coded.indices.to_numpy()
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(number)), number)
        total = lambda x: np.bincount(owner, x[which], len(number))
        return ids[_spread(begin[which], count[which])], total(count).astype(np.int64), total(score).astype(np.float64), total(fallback).astype(np.int64)

    def join(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The bytes of each run of ids, markers as spaces, the front one included."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(self.texts, pa.binary()).take(pa.array(ids))), b"")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces join to characters (bad ones become U+FFFD),
        markers to spaces; the marker in front goes. Ids that name no piece become U+FFFD,
        nulls nothing."""
        bad = "\ufffd".encode()
        text = b"".join(self.texts[i] if 0 <= i < len(self.texts) else bad for i in ids if i is not None).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... (count of them) of each run, one after another."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of some texts (no nulls), marked, in order, and their number by text."""
    odd = np.nonzero(pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False))[0]
    marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", MARK), "")
    lists = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}]){MARK}", rf"\1{_CUT}{MARK}"), _CUT)
    parts, number = lists.flatten(), lists.value_lengths().to_numpy().copy()
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if len(odd) or empty.any():
        listed = lists.to_pylist()
        for i in odd:
            listed[i] = _PART.findall(marked[i].as_py())
        for i in np.nonzero(empty)[0]:
            listed[i] = []
        parts = pa.array([p for x in listed for p in x], pa.string())
        number = np.array([len(x) for x in listed], np.int64)
    return parts, number


@cache
def _trie(pieces: tuple[tuple[str, int], ...]) -> DoubleArray:
    return DoubleArray({p.encode(): i for i, (p, k) in enumerate(pieces) if k in (NORMAL, USER)})


@cache
def _pieces(path: str) -> list[tuple[str, float, int]]:
    return read_pieces(path)


def model(path: str, scores: np.ndarray | None = None) -> Unigram:
    """The encoder of a model file's pieces under scores; the trie is built once a worker."""
    return Unigram(_pieces(path), scores)


def _path(path: str) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("_text").cast(pa.string()), "")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to GATHER bytes or somewhat more: more of their parts are equal."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """(part, n) over all texts; tasks count first what they read."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(new: list[pa.Array]) -> pa.Table:
            """Counts of some parts, and of the counts held before."""
            found = pc.value_counts(pa.chunked_array(new))
            fresh = pa.table({"part": found.field("values"), "n": found.field("counts")})
            whole = fresh if held is None else pa.concat_tables([held, fresh])
            return whole.group_by("part").aggregate([("n", "sum")]).rename_columns(["part", "n"]).select(["part", "n"])

        held: pa.Table | None = None
        new: list[pa.Array] = []
        size = 0
        for b in batches:
            new.append(split(_texts(b))[0])
            size += new[-1].nbytes
            if size > DISTINCT_BYTES:
                held, new, size = add(new), [], 0
                if len(held) > DISTINCT or held.nbytes > 2 * DISTINCT_BYTES:
                    yield from held.to_batches()
                    held = None
        if new:
            held = add(new)
        if held is not None:
            yield from held.to_batches()

    return df.select(df[text].alias("_text")).mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def count_pieces(parts: DataFrame, path: str, scores: np.ndarray | None) -> np.ndarray:
    """How often each piece is in the best paths of counted parts; a row a piece comes to
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model(path, scores)
        total = np.zeros(len(encoder.scores), np.int64)
        for b in _gathered(batches):
            ids, count, _, _ = encoder.segment(b.column("part").cast(pa.binary()).to_pylist())
            total += np.bincount(ids, np.repeat(b.column("n").to_numpy(), count), len(total)).astype(np.int64)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    out = np.zeros(len(_pieces(path)), np.int64)
    for r in parts.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def estimate(df: DataFrame, text: str = "text", path: str = "", rounds: int = ROUNDS) -> np.ndarray:
    """Log scores by id of the normal pieces of a model file, from all texts of df: the
    smoothed shares of their counts in the best paths. They don't depend on how df is dealt
    out. Null and empty texts add nothing; without any text all scores are equal."""
    path = _path(path)
    parts = written(count_parts(df, text), compression="zstd")
    normal = np.array([k == NORMAL for _, _, k in _pieces(path)])
    scores = None
    for _ in range(rounds):
        n = np.where(normal, count_pieces(parts, path, scores), 0)
        scores = np.where(normal, np.log((n + ADDED) / (n.sum() + ADDED * normal.sum())), 0.0)
    return scores


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "", scores: np.ndarray | None = None) -> DataFrame:
    """(key, ids: array<int>, score) of each row's whole text, under scores (estimated on df
    if not given). Null and empty texts have no ids and score 0; repeated rows are encoded
    each; other columns are not returned. An empty table gives none."""
    small_batches(df.sparkSession)
    path = _path(path)
    scores = estimate(df, text, path) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model(path, scores)
        for b in _gathered(batches):
            ids, count, score, _ = encoder.encode(_texts(b))
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(score)], [key, "ids", "score"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = "") -> DataFrame:
    """(key, text) of each row's ids; a null array gives an empty text, an id that names no
    piece U+FFFD, a null id nothing. Repeated rows are decoded each; an empty table gives
    none."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(path).decode
        for b in batches:
            texts = [decode(x or []) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(texts, pa.string())], [key, "text"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(df[key].alias("_key"), df[ids].alias("_ids")).mapInArrow(run, schema)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "", scores: np.ndarray | None = None) -> DataFrame:
    """(key, n_pieces, n_byte_pieces, score, ids_crc32, round_trip) of each row, under scores
    (estimated on df if not given).

    ids_crc32 is taken over the ids as little-endian unsigned 32-bit numbers; round_trip
    tells whether decoding gives the text back (not where it holds the marker itself). A
    null text counts as empty. Repeated rows are encoded each; other columns are not
    returned. An empty table gives none."""
    small_batches(df.sparkSession)
    path = _path(path)
    scores = estimate(df, text, path) if scores is None else scores
    names = ["n_pieces", "n_byte_pieces", "score", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model(path, scores)
        for b in _gathered(batches):
            texts = _texts(b)
            ids, count, score, fallback = encoder.encode(texts)
            flat, ends = ids.astype("<u4"), np.cumsum(count)
            crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, count, strict=True)]
            front = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
            same = pc.equal(encoder.join(ids, count), front.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(count), pa.array(fallback), pa.array(np.round(score, 6)), pa.array(crc, pa.int64()), same], [key, *names])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string("n_pieces long, n_byte_pieces long, score double, ids_crc32 long, round_trip boolean").fields])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in pieces and back, under scores from all of them."""
    return digest(table(spark, sf_dir, "documents"))
