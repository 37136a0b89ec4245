"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Built from DataFrame functions alone: the regular expressions run in the JVM, and no
row leaves it. The patterns are the plain ones with possessive quantifiers and look-around,
which keep the same matches but need no deep recursion and no second scan of a run. Places
are running sums over blocks of matches, and context is looked up in pieces of the text, so
a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LOCAL = "A-Za-z0-9._%+-"

PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
}
#: Characters of an IBAN by country (the registry's).
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _country(n: int) -> str:
    tail = rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{LENGTHS[n].replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{tail}"


#: An IBAN of its country's length. The pattern above, for any code, may take letters of the next word.
COUNTRIES = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(map(_country, LENGTHS))})(?![A-Za-z0-9])"
#: A text without this can't hold the kind; a cheap test before the pattern runs.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Words that raise a span's score when they stand within CONTEXT characters of it.
WORDS = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|mastercard|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: What a confirmed span scores by itself; context adds RAISE.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
RAISE, CONTEXT = 0.2, 48
BASE = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Span:
    """A found span: kind, start and end in code points (end exclusive), score."""

    kind: str
    start: int
    end: int
    score: float


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True where a string of digits passes Luhn's test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(v: Column) -> Column:
    """True where an IBAN leaves 1 when its rearranged digits are divided by 97."""
    plain = F.regexp_replace(v, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.length(plain).between(15, 34) & (F.aggregate(number, F.lit(0), lambda a, x: (F.when(x < 10, a * 10).otherwise(a * 100) + x) % 97) == 1)


def _confirmed(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(v)).between(13, 19) & _luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return _mod97(v) if kind == "iban" else F.lit(True)


_SPANS = "array<struct<start:int,end:int,value:string>>"
_FOUND = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Characters of the pieces in which context is looked up.
PIECE = 256


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _blocks(a: Column, f: Callable[[Column], Column]) -> Column:
    """f of the array a cut into about as many blocks as each has elements."""

    def cut(a: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / n).cast("int"), F.lit(0))), lambda i: F.slice(a, i * n + 1, n))

    return _let(_let(a, cut), f)


def _pushed(a: Column, x: Column) -> Column:
    return F.concat(a["out"], F.array(x))


def _places(steps: Column) -> Column:
    """Spans of steps (gap, value): a step's place is the sum of what comes before it,
    within its block and over the blocks before."""
    wide = lambda x: x["gap"] + F.length(x["value"])

    def one(a: Column, x: Column) -> Column:
        begin, end = a["at"] + x["gap"], a["at"] + wide(x)
        return F.struct(end.alias("at"), _pushed(a, F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def all_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + wide(x)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, none, lambda a, n: F.struct((a["at"] + n).alias("at"), _pushed(a, a["at"]).alias("out")), lambda a: a["out"])
        inside = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), one, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, inside))

    return _blocks(steps, all_blocks)


def _matches(t: Column, pattern: str, kind: str) -> Column:
    """All confirmed matches of a pattern with their places: what lies between matches
    and the matches themselves add up to the places."""
    between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    steps = F.filter(F.zip_with(between, found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())
    return F.filter(_places(steps), lambda s: _confirmed(kind, s["value"]))


def _pieces(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _look(pieces: Column, at: Column, n: Column | int) -> Column:
    """n characters (PIECE at most) of the text from a place on."""
    k = F.floor(at / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(two, at - k * PIECE + 1, F.lit(n) if isinstance(n, int) else n)


def _overlaps(s: Column, exact: Column) -> Column:
    """Whether a span meets one of `exact` (sorted, apart from each other): only the last
    that begins before its end can, which is found by halving."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(exact) + 1)).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = F.get(exact, middle)["start"] < s["end"]
        go = a["low"] < a["high"]
        return F.struct(F.when(go & before, middle + 1).otherwise(a["low"]).alias("low"), F.when(go & ~before, middle).otherwise(a["high"]).alias("high"))

    begun = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(exact).alias("high")), halve, lambda a: a["low"])
    return F.coalesce(F.get(exact, begun - 1)["end"] > s["start"], F.lit(False))


def _ibans(t: Column) -> Column:
    """IBANs of their country's length, then others; no letter or digit touches one."""

    def both(exact: Column) -> Column:
        other = F.filter(_matches(t, PATTERNS["iban"], "iban"), lambda s: ~_overlaps(s, exact))
        return F.array_sort(F.concat(exact, other))

    def alone(found: Column) -> Column:
        beside = lambda p, s: F.concat_ws(" ", F.when(s["start"] > 0, _look(p, s["start"] - 1, 1)), _look(p, s["end"], 1))
        return F.when(F.size(found) > 0, _let(_pieces(t), lambda p: F.filter(found, lambda s: ~beside(p, s).rlike("[A-Za-z0-9]")))).otherwise(found)

    return _let(_let(_matches(t, COUNTRIES, "iban"), both), alone)


def _spans(t: Column, kind: str) -> Column:
    """All spans of a kind, by start."""
    kept = _ibans(t) if kind == "iban" else _matches(t, PATTERNS[kind], kind)
    hint = F.contains(t, F.lit(HINTS[kind])) if kind in HINTS else t.rlike("[0-9]" if kind == "card" else "[0-9]{2}")
    return F.when(hint, kept).otherwise(F.array().cast(_SPANS))


def _scored(t: Column, kind: str) -> Column:
    """Spans of a kind with their scores; context words near a span raise it."""

    def score(p: Column, s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.concat_ws(" ", _look(p, first, s["start"] - first), _look(p, s["end"], CONTEXT)))
        return F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?<![a-z])(?:{WORDS[kind]})(?![a-z])"), RAISE).otherwise(0.0)

    def listed(spans: Column) -> Column:
        full = _let(_pieces(t), lambda p: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score(p, s), 2).alias("score"))))
        return F.when(F.size(spans) > 0, full).otherwise(F.array().cast(_FOUND))

    return _let(_spans(t, kind), listed)


def detect(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """df with a column `into`: array of (kind, start, end, score), by kind in the
    order of PATTERNS, then by start.

    A null or empty text gives an empty array. Texts are searched whole. Repeated rows
    are each searched. Extra columns pass through; a column already named `into` is
    replaced. An empty table gives an empty table. One narrow stage, no shuffle."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumn(into, F.concat(*(_scored(t, k) for k in PATTERNS)))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with every span of `text` replaced by its kind in angle brackets.

    Overlapping spans are covered by the first's mark; a null text stays null."""
    t = F.col(f"`{text}`")
    ordered = F.array_sort(F.transform(F.col(f"`{spans}`"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def block(b: Column, last: Column, following: Column) -> Column:
        """The text from the end of what the spans before cover to a block's own such end,
        with its marks; the last block goes on to the end of the text."""
        end = F.greatest(last, F.array_max(F.transform(b, lambda s: s["end"])))
        own = F.substring(t, last + 1, F.coalesce(F.when(following, end - last), F.length(t)))

        def step(whole: Column) -> Callable[[Column, Column], Column]:
            def one(a: Column, s: Column) -> Column:
                mark = F.when(s["start"] >= a["at"], F.concat(F.substring(whole, a["at"] - last + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), _pushed(a, mark).alias("out"))

            return one

        start = F.struct(last.alias("at"), F.array().cast("array<string>").alias("out"))
        closed = lambda whole: lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, a["at"] - last + 1, F.length(whole)))
        return _let(own, lambda whole: F.aggregate(b, start, step(whole), closed(whole)))

    def whole(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        lasts = F.aggregate(ends, none, lambda a, e: F.struct(F.greatest(a["at"], e).alias("at"), _pushed(a, a["at"]).alias("out")), lambda a: a["out"])
        return _let(lasts, lambda lasts: F.array_join(F.transform(blocks, lambda b, i: block(b, F.get(lasts, i), i < F.size(blocks) - 1)), ""))

    return df.withColumn(text, F.when(F.size(F.col(f"`{spans}`")) > 0, _blocks(ordered, whole)).otherwise(t))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of documents, as counts and digests."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(_count(k) for k in PATTERNS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


#: The plain patterns, which the possessive ones above equal.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": PATTERNS["phone"],
    "iban": PATTERNS["iban"],
}


def _found_sql(kind: str, order: int) -> str:
    near = f"lower(concat_ws(' ', substr(t, greatest(a - {CONTEXT}, 0) + 1, a - greatest(a - {CONTEXT}, 0)), substr(t, e + 1, {CONTEXT})))"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = "list_sum(list_transform(range(1, length(n) + 1), lambda j: CASE WHEN j % 2 = 0 THEN 2 * CAST(substr(n, length(n) - j + 1, 1) AS INTEGER) // 10 + 2 * CAST(substr(n, length(n) - j + 1, 1) AS INTEGER) % 10 ELSE CAST(substr(n, length(n) - j + 1, 1) AS INTEGER) END)) % 10 = 0"
    plain = "replace(x, ' ', '')"
    number = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    test = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(x, '.'), lambda p: regexp_matches(p, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')))",
        "card": f"length(n) BETWEEN 13 AND 19 AND {luhn}",
        "phone": "length(n) BETWEEN 9 AND 15",
        "iban": f"length({plain}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {number}), lambda r, y: CASE WHEN y < 10 THEN (r * 10 + y) % 97 ELSE (r * 100 + y) % 97 END) = 1 AND NOT regexp_matches(substr(t, a, CASE WHEN a > 0 THEN 1 ELSE 0 END) || ' ' || substr(t, e + 1, 1), '[A-Za-z0-9]')",
    }[kind]
    lengths = "coalesce(list_sum(list_transform({0}, lambda p: length(p))), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, a, e, round({SCORES[kind]} + CASE WHEN regexp_matches({near}, '(^|[^a-z])({WORDS[kind]})($|[^a-z])') THEN {RAISE} ELSE 0 END, 2) AS score FROM
 (SELECT *, CAST(a + length(x) AS BIGINT) AS e, {digits} AS n FROM (SELECT doc_id, t, v[i] AS x, CAST({lengths.format('g[1:i]')} + {lengths.format('v[1:i - 1]')} AS BIGINT) AS a
  FROM (SELECT doc_id, t, g, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, t, string_split_regex(t, '{_PLAIN[kind]}') AS g, regexp_extract_all(t, '{_PLAIN[kind]}') AS v FROM d)))) WHERE {test}"""


_LIST = "coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY o, a){0}, '')"

ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found_sql(k, i) for i, k in enumerate(PATTERNS))})
SELECT d.doc_id AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in PATTERNS)}, sha256({_LIST.format(" FILTER (WHERE kind <> 'iban')")}) AS base_sha256, {_LIST.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans, CAST(coalesce(max(score), 0) AS DOUBLE) AS top_score
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
