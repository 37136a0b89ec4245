"""Sum-of-squares packing of token sequences into windows.

Each task packs what it reads: there is no shuffle, and a hot source only fills more
windows of the same tasks. A document's whole windows are cut off first; its rest goes
online to the fill level that keeps the sum of squared counts of partly filled windows
smallest. A level array holds the counts. A rest may also be cut to fill an open window,
at a price of CUT in that sum: so no level ever holds more than about CUT / 2 windows, and
a task's open windows are bounded by the array alone, whatever the sizes are. At the end of
a task the array is run down: the fullest window is filled from the emptiest, until one is
left, which is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import rows_of, small_batches, table

WINDOW = 1024
#: What a cut costs, in squared counts.
CUT = 32
#: Runs of white space of this length are left to the tokenizers file.
LONG_SPACE = 10_000
END_ID = 0
#: Windows of a task have ids from partition * 2^STRIDE on.
STRIDE = 36


class LevelArray:
    """Counts of open windows by fill level, and the choice of a level for a size."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The level (0: a new window) that minimises the sum of squares after adding
        size there; the fullest of equals. Level h's count drops by one, that of h + size
        grows by one unless the window is then full. At a level where size doesn't fit, it
        is cut: the window is full, what remains opens another, and the sum is CUT dearer."""
        n, w = self.counts, self.window
        grown = 2 * n + 1
        grown[w] = 0
        cost = np.full(w, np.iinfo(np.int64).max)
        at = np.nonzero(n[1:w])[0] + 1
        after = at + size
        cost[at] = 1 - 2 * n[at] + np.where(after <= w, grown[np.minimum(after, w)], grown[np.maximum(after - w, 0)] + CUT)
        cost[0] = grown[size]
        return w - 1 - int(np.argmin(cost[::-1]))

    def take(self, level: int) -> int | None:
        """An open window of a level, removed from it; None for a new one."""
        if not level:
            return None
        self.counts[level] -= 1
        return self.open[level].pop()

    def put(self, window: int, level: int) -> None:
        """A window at its new level; full ones are not kept."""
        if level < self.window:
            self.counts[level] += 1
            self.open[level].append(window)


class Packer:
    """Packs one stream of (key, ids) and yields pieces
    (key, start, length, crc, doc_tokens, window, offset)."""

    def __init__(self, first: int, window: int = WINDOW):
        self.next, self.window = first, window
        self.levels = LevelArray(window)
        self.held: dict[int, list[tuple]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _piece(key, start: int, ids: np.ndarray, total: int, window: int, offset: int) -> tuple:
        return key, start, len(ids), zlib.crc32(ids.tobytes()), total, window, offset

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces that are final once this document (little-endian uint32 ids) is placed."""
        w, total = self.window, len(ids)
        whole = total - total % w
        for at in range(0, whole, w):
            yield self._piece(key, at, ids[at : at + w], total, self._new(), 0)
        if size := total - whole:
            level = self.levels.choose(size)
            window = self.levels.take(level)
            if window is None:
                window = self._new()
            piece = (key, whole, ids[whole:].copy(), total)
            if level + size <= w:
                yield from self._place(window, level, piece)
            else:
                head, rest = self._cut(piece, w - level)
                yield from self._place(window, level, head)
                yield from self._place(self._new(), 0, rest)

    @staticmethod
    def _cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
        key, start, ids, total = piece
        return (key, start, ids[:length], total), (key, start + length, ids[length:], total)

    def _place(self, window: int, level: int, piece: tuple) -> Iterator[tuple]:
        """Put a piece into a window taken at a level; the window's pieces if it is full."""
        self.held.setdefault(window, []).append(piece)
        level += len(piece[2])
        self.levels.put(window, level)
        if level == self.window:
            yield from self._close(window)

    def _close(self, window: int) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in self.held.pop(window):
            yield self._piece(key, start, ids, total, window, offset)
            offset += len(ids)

    def finish(self) -> Iterator[tuple]:
        """The pieces of all windows still open: the fullest is filled by pieces of the
        emptiest, the last piece cut where need be, until one window is left."""
        levels = self.levels
        while True:
            some = np.nonzero(levels.counts)[0]
            if not len(some) or (len(some) == 1 and levels.counts[some[0]] == 1):
                break
            low, high = int(some[0]), int(some[-1])
            full, poor = levels.take(high), levels.take(low)
            while high < self.window and low:
                piece = self.held[poor].pop()
                room = self.window - high
                if len(piece[2]) > room:
                    piece, rest = self._cut(piece, room)
                    self.held[poor].append(rest)
                self.held[full].append(piece)
                high, low = high + len(piece[2]), low - len(piece[2])
            if high < self.window:
                levels.put(full, high)
            else:
                yield from self._close(full)
            if low:
                levels.put(poor, low)
            else:
                del self.held[poor]
        for window in list(self.held):
            yield from self._powers(self.held.pop(window))

    def _powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The last window's pieces in windows of falling powers of two."""
        left = sum(len(p[2]) for p in pieces)
        window, room, at = 0, 0, 0
        while pieces:
            if not room:
                window, room, at = self._new(), 1 << (left.bit_length() - 1), 0
            piece = pieces.pop(0)
            if len(piece[2]) > room:
                piece, rest = self._cut(piece, room)
                pieces.insert(0, rest)
            yield self._piece(*piece, window, at)
            n = len(piece[2])
            at, room, left = at + n, room - n, left - n


@cache
def _encoders(path: str, ranks: str):
    """Two encoders of one vocabulary: the tokenizers file decides, the rank file's is
    faster and gives the same ids wherever no special token's string is in the text and no
    run of white space is so long that its pattern's backtracking runs out of stack."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(ranks, "rb") as f:
        merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return slow, fast, special


_LONG = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")


def encode(text: str, path: str, ranks: str) -> np.ndarray:
    """Ids of a text as the tokenizers file at `path` gives them, little-endian uint32."""
    slow, fast, special = _encoders(path, ranks)
    if any(s in text for s in special) or (len(text) >= LONG_SPACE and _LONG.search(text)):
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return fast.encode_to_numpy(text).astype("<u4", copy=False)


_NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str = "", ranks: str = "") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its token ids and END_ID; each id lies in exactly one piece. A null
    or empty text is END_ID alone. Null keys and repeated rows are packed like others,
    row by row; other columns are not returned. An empty table gives no rows. Very long
    texts are encoded whole, those with very long runs of white space too. A task's memory
    holds one Arrow batch and the open windows that the level array bounds. Window ids depend on how the input is split, pieces' content doesn't
    depend on anything else; a task run again gives the same rows."""
    import public_tokenizers

    small_batches(df.sparkSession)
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), *(T.StructField(n, T.LongType()) for n in _NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << STRIDE, window)
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, *_NAMES])

        for b in batches:
            kind = b.schema.field("_key").type
            rows: list[tuple] = []
            for keys, texts in rows_of([b], "_key", "_text"):
                for k, t in zip(keys, texts, strict=True):
                    ids = np.append(encode((t or b"").decode(), tokenizer, ranks), np.array([END_ID], "<u4"))
                    rows.extend(packer.add(k, ids))
            if rows:
                yield out(rows)
        if rows := list(packer.finish()):
            yield out(rows)

    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens, by sum-of-squares placement."""
    return pack(table(spark, sf_dir, "documents"))
