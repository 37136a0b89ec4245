"""Token counts kept up to date under edits.

A document keeps a segment tree over its pre-tokens: a leaf stands for about LEAF of them,
and heap arrays hold the sums of characters, tokens and pre-tokens below each node. plant()
makes the trees, a table with a row a document; apply_edits() takes that table, finds the
leaves that an edit touches by the character sums, splits and encodes only them (with the
characters of context that a split looks ahead), and returns the table with its sums
updated, ready for the next edits. Text outside those leaves is never encoded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, small_batches, table, written

LEAF = 64
#: Characters that the split of a pre-token may look past its end.
LOOK = 2
#: Counts of pre-tokens that a task remembers, each of at most SHORT characters.
REMEMBERED, SHORT = 1_000_000, 64
SUMS = ("chars", "tokens", "pieces")


class TokenTree:
    """Sums over one document's pre-tokens; leaves are texts that begin and end at a
    pre-token's boundary, empty ones where an edit left fewer."""

    def __init__(self, leaves: list[str], sums: dict[str, list[int]], split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.leaves, self.split, self.count = leaves, split, count
        self.chars, self.tokens, self.pieces = (sums[s] for s in SUMS)
        self.size = len(self.chars) // 2
        self.reencoded = 0

    @classmethod
    def plant(cls, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]) -> TokenTree:
        """The tree of a text, all of which is split and counted."""
        found = split(text)
        parts = [found[i : i + LEAF] for i in range(0, len(found), LEAF)] or [[]]
        tree = cls([], {s: [0, 0] for s in SUMS}, split, count)
        tree._build(["".join(p) for p in parts], [sum(map(count, p)) for p in parts], [len(p) for p in parts])
        return tree

    @classmethod
    def load(cls, text: str, sums: dict[str, list[int]], split: Callable[[str], list[str]], count: Callable[[str], int]) -> TokenTree:
        """The tree of stored sums: the text is cut at the leaves' ends, nothing is encoded."""
        leaves, at = [], 0
        for n in sums["chars"][len(sums["chars"]) // 2 :]:
            leaves.append(text[at : at + n])
            at += n
        return cls(leaves, sums, split, count)

    def _build(self, leaves: list[str], tokens: list[int], pieces: list[int]) -> None:
        self.size = 1 << (len(leaves) - 1).bit_length()
        empty = self.size - len(leaves)
        self.leaves = leaves + [""] * empty
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        self.tokens = [0] * self.size + tokens + [0] * empty
        self.pieces = [0] * self.size + pieces + [0] * empty
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        for s in (self.chars, self.tokens, self.pieces):
            s[i] = s[2 * i] + s[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_pieces(self) -> int:
        return self.pieces[1]

    def text(self) -> str:
        """The document as it is now."""
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the first character of that leaf."""
        node, left = 1, at
        while node < self.size:
            node *= 2
            if left >= self.chars[node]:
                left -= self.chars[node]
                node += 1
        return node - self.size, at - left

    def edit(self, start: int, delete: int, insert: str) -> int:
        """Replace `delete` characters from `start` on by `insert` (both clamped to the
        text); the number of tokens then."""
        start = min(max(start, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - start)
        stop, shift = start + delete, len(insert) - delete
        first, begin = self._leaf(max(0, start - LOOK)) if self.n_chars else (0, 0)
        leaf, at, more = first, begin, 1
        old: list[str] = []
        bounds: dict[int, int] = {}
        while True:
            # leaves up to the edit's end, and `more` after it
            while leaf < self.size and (at < stop or more > 0):
                more -= at >= stop and bool(self.leaves[leaf])
                old.append(self.leaves[leaf])
                at += len(self.leaves[leaf])
                leaf += 1
                if at >= stop:
                    bounds[at] = leaf
            whole = "".join(old)
            region = whole[: start - begin] + insert + whole[stop - begin :]
            ahead, k = "", leaf
            while len(ahead) < LOOK and k < self.size:
                ahead += self.leaves[k][:LOOK]
                k += 1
            fresh, place, end = [], begin, self.size if leaf == self.size and not region else None
            for piece in self.split(region + ahead):
                place += len(piece)
                if place > begin + len(region):
                    break
                fresh.append(piece)
                if place - shift in bounds:
                    end = bounds[place - shift]
                    break
            if end is not None:
                break
            more = 2 * (leaf - first)
        self._replace(first, end, fresh)
        self.reencoded += len(fresh)
        return self.n_tokens

    def _replace(self, first: int, end: int, fresh: list[str]) -> None:
        """Put fresh pre-tokens in the place of the leaves first to end - 1."""
        room = max(1, end - first)
        per = max(LEAF, -(-len(fresh) // room))
        grows = per > 2 * LEAF
        per = LEAF if grows else per
        parts = [fresh[i : i + per] for i in range(0, len(fresh), per)]
        parts += [[]] * (room - len(parts))
        leaves = ["".join(p) for p in parts]
        tokens, pieces = [sum(map(self.count, p)) for p in parts], [len(p) for p in parts]
        if grows:
            put = lambda old, new: old[:first] + new + old[first + room :]
            self._build(put(self.leaves, leaves), put(self.tokens[self.size :], tokens), put(self.pieces[self.size :], pieces))
            return
        for i, (a, t, p) in enumerate(zip(leaves, tokens, pieces, strict=True), first):
            self.leaves[i] = a
            self.chars[self.size + i], self.tokens[self.size + i], self.pieces[self.size + i] = len(a), t, p
        low, high = (self.size + first) // 2, (self.size + first + room - 1) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


class _Counts(dict):
    """Pre-token -> number of tokens; long ones are counted each time."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@cache
def tokenizer(path: str) -> tuple[Callable[[str], list[str]], Callable[[str], int], Callable[[str], list[int]]]:
    """Split, count and whole encoding of a byte-level vocabulary's rank file. A pre-token
    is encoded without another split, so runs of white space may have any length."""
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    found = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = found._encode_single_piece
    split = regex.compile(public_tokenizers.PATTERN).findall
    return split, _Counts(single).__getitem__, lambda text: [i for p in split(text) for i in single(p)]


def _path(path: str) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


_EDITS = "array<struct<start:long,delete:long,insert:string>>"
_STATE = [T.StructField("text", T.StringType()), *(T.StructField(s, T.ArrayType(T.IntegerType())) for s in SUMS)]
_TYPES = {"text": pa.string(), **{s: pa.list_(pa.int32()) for s in SUMS}}
_COUNTS = ("n_tokens_before", "n_tokens_after", "n_pretokens", "n_reencoded", "n_chars_after")


def plant(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "") -> DataFrame:
    """The trees of a table: (key, text, chars, tokens, pieces) of each row, the last three
    heap arrays of sums with the whole document's at 1 and the leaves in the upper half.

    A null text counts as empty. Null keys and repeated rows have a tree each; other columns
    are not returned. An empty table gives none. One narrow stage."""
    small_batches(df.sparkSession)
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count, _ = tokenizer(path)
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                trees = [TokenTree.plant((t or b"").decode(), split, count) for t in texts]
                sums = [pa.array([getattr(t, s) for t in trees], _TYPES[s]) for s in SUMS]
                yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([t.text() for t in trees], pa.string()), *sums], [key, "text", *SUMS])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *_STATE])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, key: str = "doc_id", edits: str = "edits", path: str = "") -> DataFrame:
    """The trees after edits, in plant()'s columns, and n_tokens_before, n_tokens_after,
    n_pretokens, n_reencoded (pre-tokens that were split and counted anew), n_chars_after.

    trees: plant()'s columns, or this function's own, and `edits`: an array of (start,
    delete, insert), applied in order, each in code points of the text as the one before
    left it. Places beyond the text are clamped, null numbers count as 0, a null insert as
    empty, null edits and a null array as none: such a row is returned as it is. Repeated
    rows are edited each; other columns are not returned. An empty table gives none."""
    small_batches(trees.sparkSession)
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count, _ = tokenizer(path)
        for b in batches:
            texts, changes = b.column("text").to_pylist(), b.column("_edits").to_pylist()
            todo = [i for i, c in enumerate(changes) if c and any(e is not None for e in c)]
            sums = {s: b.column(s).to_pylist() for s in SUMS}
            before = [t[1] for t in sums["tokens"]]
            again = [0] * len(texts)
            for i in todo:
                tree = TokenTree.load(texts[i], {s: sums[s][i] for s in SUMS}, split, count)
                for e in changes[i]:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                texts[i], again[i] = tree.text(), tree.reencoded
                for s in SUMS:
                    sums[s][i] = getattr(tree, s)
            counts = (before, *([x[1] for x in sums[s]] for s in ("tokens", "pieces")), again, [x[1] for x in sums["chars"]])
            state = [pa.array(texts, pa.string()), *(pa.array(sums[s], _TYPES[s]) for s in SUMS)]
            yield pa.RecordBatch.from_arrays([b.column("_key"), *state, *(pa.array(c, pa.int64()) for c in counts)], [key, *_TYPES, *_COUNTS])

    schema = T.StructType([T.StructField(key, trees.schema[key].dataType), *_STATE, *(T.StructField(n, T.LongType()) for n in _COUNTS)])
    return trees.select(trees[key].alias("_key"), "text", *SUMS, trees[edits].cast(_EDITS).alias("_edits")).mapInArrow(run, schema)


#: Texts that the query's edits insert; a document's hash chooses.
INSERTS = ("", " amended", "\n\nSee also: notes.", "'s", " 2,048", "  \t", "été 中文")


def sample_edits(key: Column, n: Column) -> Column:
    """Four edits of a document, by its key and number of characters: one in front, two at
    hashed places, one at the end."""
    words = F.array(*map(F.lit, INSERTS))

    def one(start: Column, salt: int) -> Column:
        pick = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(INSERTS))).cast("int")
        return F.struct(start.alias("start"), F.pmod(F.xxhash64(key, F.lit(salt + 1)), F.lit(24)).alias("delete"), F.element_at(words, pick + 1).alias("insert"))

    hashed = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), n + 1)
    return F.array(one(F.lit(0).cast("long"), 10), one(hashed(20), 30), one(hashed(40), 50), one(n, 60)).cast(_EDITS)


def op4_token_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents before and after four edits of its
    stored tree."""
    trees = written(plant(table(spark, sf_dir, "documents")), compression="zstd")
    edits = sample_edits(F.col("doc_id"), F.element_at("chars", 2).cast("long"))
    return apply_edits(trees.withColumn("edits", edits)).select("doc_id", *_COUNTS)
