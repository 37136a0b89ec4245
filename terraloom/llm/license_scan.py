"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; expressions behind
a tag go through a shunting-yard parser and are evaluated against a set of licences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import rows_of, small_batches, table

#: Phrases of the base and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases that only the method's own labels use.
MORE_PHRASES = {
    "bsd license": "bsd",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Longest first: prefix of an identifier -> label.
FAMILIES = {
    "agpl": "agpl",
    "apache": "apache",
    "bsd": "bsd",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
    "cc0": "cc0",
    "epl": "epl",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "mit": "mit",
    "mpl": "mpl",
}
PERMISSIVE = frozenset({"mit", "apache", "bsd", "cc-by", "cc0"})
#: Share of doubt that each kind of evidence leaves.
DOUBT = {"tag": 0.1, "base": 0.4, "more": 0.5}

#: Bytes to words: ASCII letters (lower-cased), ASCII digits and all of non-ASCII stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: What follows a tag: a colon, and the expression up to the line's or the comment's end.
_EXPRESSION = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(?:(?:\*/|-->|[\"'])[^\r\n]*)?(?:[\r\n]|\Z)")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order (shunting-yard); None if malformed: other
    characters, two licences or two operators in a row, open parentheses.

    WITH binds closest, then AND, then OR; operators are left-associative and read in
    any case."""
    out: list[str] = []
    stack: list[str] = []
    operand_next, depth, at, end = True, 0, 0, len(text.rstrip(" \t"))
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        token = m[1] or m[2]
        op = token.upper()
        if op in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                return None
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or depth:
        return None
    return out + stack[::-1]


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or itself in lower case."""
    low = identifier.lower()
    return next((label for start, label in sorted(FAMILIES.items(), key=lambda x: -len(x[0])) if low == start or low.startswith((start + "-", start + "+"))), low.rstrip("+."))


def evaluate(postfix: list[str], allowed: Callable[[str], bool]) -> bool:
    """Whether a parsed expression can be met with allowed licences: OR needs one side,
    AND both, WITH the licence on its left."""
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append({"OR": left or right, "AND": left and right, "WITH": left}[token])
        else:
            stack.append(allowed(family(token)))
    return stack.pop()


def operands(postfix: list[str]) -> list[str]:
    """The licences an expression names, without exceptions (the right side of WITH)."""
    stack: list[list[str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "WITH" else left + right)
        else:
            stack.append([token])
    return stack.pop()


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds = {TAG: ("tag", "")} | {p: ("more", x) for p, x in MORE_PHRASES.items()} | {p: ("base", x) for p, x in BASE_PHRASES.items()}
    for phrase, (kind, label) in kinds.items():
        found.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan(text: bytes | None, allowed: frozenset = PERMISSIVE) -> dict:
    """What a text (UTF-8 bytes; None as empty) says of licences, by places in words."""
    text = text or b""
    spaced = text.translate(_WORD_BYTES)
    words = spaced.split()
    plain = f" {b' '.join(words).decode()} "
    base, labels, kinds, tags = [], set(), set(), []
    before, counted = 0, 0
    for end, (kind, label, size) in _automaton().iter(plain):
        # matches come by their ends, so one count of spaces runs along with them
        before, counted = before + plain.count(" ", counted, end), end
        if kind == "tag":
            tags.append(before - 1)
            continue
        kinds.add(kind)
        labels.add(label)
        if kind == "base":
            base.append((before - size, label))
    permitted = None
    expressions, malformed = [], 0
    if tags:
        # an expression ends where the next tag begins, so a line is read once
        first, last = {t - TAG.count(" ") for t in tags}, set(tags)
        at = [m.span() for i, m in enumerate(_WORD.finditer(spaced)) if i in first or i in last]
        stops = [a for a, _ in at[2::2]] + [len(text)]
        for m in filter(None, map(_EXPRESSION.match, repeat(text), (e for _, e in at[1::2]), stops)):
            postfix = parse_expression(m[1].decode())
            if postfix is None:
                malformed += 1
                permitted = False
                continue
            kinds.add("tag")
            expressions.append(" ".join(postfix))
            labels.update(family(x) for x in operands(postfix))
            permitted = permitted is not False and evaluate(postfix, allowed.__contains__)
    doubt = 1.0
    for kind in kinds:
        doubt *= DOUBT[kind]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((s for s, _ in base), default=None),
        "last_word": max((s for s, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted(labels)),
        "score": round(1.0 - doubt, 6) if kinds else 0.0,
        "expressions": "; ".join(expressions),
        "n_malformed": malformed,
        "permitted": permitted,
    }


_FIELDS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "expressions": pa.string(),
    "n_malformed": pa.int64(),
    "permitted": pa.bool_(),
}
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, n_malformed long, permitted boolean"


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", allowed: Iterable[str] = PERMISSIVE) -> DataFrame:
    """One row per row of df: its key and what scan() finds in its whole text.

    `labels` holds base labels and the method's own; `permitted` tells whether every
    tagged expression can be met with `allowed` (null without one); malformed expressions
    (n_malformed) name no licence and permit nothing. A tag is its three words, however they
    are joined, with a colon behind. A null text counts as empty: no words, no labels, score 0. A null key
    stays null. Repeated rows give repeated rows; other columns are not returned, so
    their names can't clash. An empty table gives none. One narrow stage, no shuffle."""
    small_batches(df.sparkSession)
    allowed = frozenset(allowed)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in rows_of([b], "_key", "_text"):
                found = [scan(t, allowed) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array([x[f] for x in found], t) for f, t in _FIELDS.items())], [key, *_FIELDS])

    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(_DDL).fields])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence evidence in every whole text of documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
