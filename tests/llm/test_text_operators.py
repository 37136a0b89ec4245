"""Operators that look at one text at a time, against plain Python."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import fixity, license_scan, lm_score, packing, pii, quality, token_edit, unigram

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words int, pii string, labels string"
ODD = [None, "", " \t\n", "x", "word " * 30_000, "é中😀 mit license\n" * 3, "same\nsame\n\nsame", "a b c a b c"]


def frame(spark, texts, start=0):
    """Documents with clashing extra columns and nulls in them."""
    return spark.createDataFrame([(i + start, t, None, "kept?", None) for i, t in enumerate(texts)], DOCS)


def rows(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def seconds(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


# ------------------------------------------------------------------ personal data
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [
    "mail a@b.cc+x@d.ee and a@b, a@b., é@x.yy me@x-1.y.zz.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111 5--4111111111111111",
    "call +1 (269) 555-3296 4524132264652876 +12 +1+2 345 678 901",
    "IBAN DE89 3704 0044 0532 0130 00 bank, GB82WEST12345698765432, DE00 3704 0044 0532 0130 00",
    "😀 é a@b.c 1.1.1.1",
    "1 " * 9_000,
    "9" * 20_000,
    "a." * 9_000 + "@b.c",
    "a@b" + ".c" * 9_000,
]


def test_pii_matches_plain_patterns(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab1234567890@.+- ()é,") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts = ODD + PII + noise
    got = rows(pii.detect(frame(spark, texts)).selectExpr("doc_id", "pii"))
    for i, t in enumerate(texts):
        found = [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i][0]["pii"] if s["kind"] in pii.BASE]
        assert found == base_spans(t), t


def test_pii_iban_context_and_redaction(spark):
    df = pii.redact(pii.detect(frame(spark, PII[4:6] + [None, "card 4111111111111111", "4111111111111111"])))
    got = rows(df)
    ibans = [(s["start"], s["end"]) for s in got[0][0]["pii"] if s["kind"] == "iban"]
    assert [PII[4][a:b] for a, b in ibans] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert got[1][0]["text"] == "😀 é <EMAIL> <IP>" and got[2][0]["text"] is None
    assert got[3][0]["pii"][0]["score"] > got[4][0]["pii"][0]["score"]
    assert "<IBAN>" in got[0][0]["text"] and "DE89" not in got[0][0]["text"]


def test_pii_ibans_before_words_and_spaced_cards(spark):
    texts = ["pay ES91 2100 0418 4502 0005 1332 Please", "ES9121000418450200051332 BANK", "AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00 Bank", "BE68 5390 0754 7034 12 times", "CZ65 0800 0000 1920 0014 5399 A", "xES9121000418450200051332", "ES9121000418450200051333 BANK"]
    want = [["ES91 2100 0418 4502 0005 1332"], ["ES9121000418450200051332"], ["AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"], ["BE68 5390 0754 7034"], ["CZ65 0800 0000 1920 0014 5399"], [], []]
    got = rows(pii.detect(frame(spark, [*texts, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"])))
    assert [[t[s["start"] : s["end"]] for s in g[0]["pii"] if s["kind"] == "iban"] for t, g in zip(texts, (got[i] for i in range(len(texts))), strict=True)] == want
    assert [s["kind"] for s in got[len(texts)][0]["pii"]] == ["card"]


def test_pii_many_spans(spark):
    rng = random.Random(13)
    ibans = ["ES91 2100 0418 4502 0005 1332", "DE89370400440532013000", "XX00 1234 5678 9012", "GB82WEST12345698765432"]
    bits = ["a@b.cc", "1.2.3.4", "+1 269 555 3296", "4111 1111 1111 1111", *ibans, "é", "😀 x", "word " * 60, " mail ", " "]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", ", ", ""]) for _ in range(n)) for n in (1, 2, 3, 17, 90, 400, 1200)]
    df = pii.detect(frame(spark, texts)).cache()
    found, masked = rows(df), rows(pii.redact(df))
    for i, t in enumerate(texts):
        spans = found[i][0]["pii"]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in pii.BASE] == base_spans(t)
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
            near = f"{t[max(0, s['start'] - 48) : s['start']]} {t[s['end'] : s['end'] + 48]}".lower()
            raised = re.search(rf"(?<![a-z])(?:{pii.WORDS[s['kind']]})(?![a-z])", near) is not None
            assert abs(s["score"] - pii.SCORES[s["kind"]] - 0.2 * raised) < 1e-9
            out.append(t[at : s["start"]] + f"<{s['kind'].upper()}>" if s["start"] >= at else "")
            at = max(at, s["end"])
        assert masked[i][0]["text"] == "".join(out) + t[at:]
    assert sum(s["kind"] == "iban" for g in found.values() for s in g[0]["pii"]) > 200


def test_pii_cost_follows_the_number_of_spans(spark):
    def run(n):
        df = frame(spark, ["a@b.cc 1.2.3.4 DE89370400440532013000 " * n])
        return seconds(lambda: pii.redact(pii.detect(df)).selectExpr("sum(length(text))").collect())

    run(10)
    short, long = (min(run(n) for _ in range(2)) for n in (2_000, 8_000))
    assert long < 8 * short + 1


def test_pii_sql_twin_on_odd_texts(spark, tmp_path):
    import duckdb

    rng = random.Random(12)
    noise = ["".join(rng.choice("ab1234567890@.+- ()é,DE") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    ibans = ["xDE89370400440532013000", "DE89370400440532013000", "éDE89 3704 0044 0532 0130 00.", "DE89370400440532013000x", "iban: GB82 WEST 1234 5698 7654 32"]
    frame(spark, ODD + PII + ibans + noise).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = pii.op10_pii(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in c.sql(pii.ORACLE_SQL).fetchall()}
    names = [x[0] for x in c.sql(pii.ORACLE_SQL).description]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()} == want
    assert sum(r[names.index("n_iban")] for r in want.values()) == 5


def test_pii_query_digest(spark):
    for r in pii.op10_pii(spark, SF).limit(100).collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("iban")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


# ------------------------------------------------------------------ quality
def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_quality_base_statistics(spark):
    texts = ODD + ["a b c d a b c", "x y z # * <b>", "l1\nl1 \nl1\n\n\n", "p q p q p q p q"]
    got = rows(quality.rate(frame(spark, texts), None))
    for i, t in enumerate(texts):
        r = got[i][0]
        want = brute_counts(t)
        assert [r[c] for c in quality.COUNTS] == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_quality_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] + 0.1 * rng.normal(size=3000) > 0.3)).astype(float)
    trees = quality.fit(x[:2000], y[:2000], np.array([-1, 0, -1]))
    held = trees.score(x[2000:])
    assert ((held > 0.5) == (y[2000:] > 0.5)).mean() > 0.93
    line = np.tile([[0.3, 0.6, 0.5]], (200, 1))
    line[:, 0] = np.linspace(0, 1, 200)
    assert (np.diff(trees.score(line)) <= 1e-12).all()
    # flat arrays score like a walk of each tree
    for r in x[:20]:
        total = trees.bias
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if r[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        assert abs(trees.score(r[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_query_and_empty_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = spark.createDataFrame([(1, None, "x"), (None, 1, "y"), (2, 1, "z")], "doc_id long, quality int, text string")
    assert quality.train(docs, none) is None
    assert quality.train(docs.limit(0), none) is None
    got = quality.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert got.filter("(quality = 1) <> kept").count() <= 0.05 * got.count()


# ------------------------------------------------------------------ licences
def brute_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_licence_places(spark):
    texts = ODD + ["MIT License, mit-license mit license\nApache License", "the GNU General Public License and cc by cc by-nc", "submit license summit licenses", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"]
    got = rows(license_scan.scan_licenses(frame(spark, texts)))
    for i, t in enumerate(texts):
        n, places = brute_places(t)
        r = got[i][0]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[len(texts) - 1][0]["labels"] == "apache,gpl,mit" and got[len(texts) - 1][0]["permitted"] is False


@pytest.mark.parametrize(
    "text, postfix, permitted",
    [
        ("MIT", ["MIT"], True),
        ("MIT OR GPL-3.0", ["MIT", "GPL-3.0", "OR"], True),
        ("MIT AND GPL-3.0", ["MIT", "GPL-3.0", "AND"], False),
        ("MIT or GPL-3.0 and BSD-3-Clause", ["MIT", "GPL-3.0", "BSD-3-Clause", "AND", "OR"], True),
        ("(MIT OR GPL-3.0) AND GPL-2.0", ["MIT", "GPL-3.0", "OR", "GPL-2.0", "AND"], False),
        ("Apache-2.0 WITH LLVM-exception", ["Apache-2.0", "LLVM-exception", "WITH"], True),
        ("MIT OR", None, None),
        ("(MIT", None, None),
        ("MIT)", None, None),
        ("", None, None),
        ("MIT/GPL-3.0-only", None, None),
        ("MIT GPL-3.0", None, None),
        ("MIT (GPL-3.0)", None, None),
        ("MIT AND OR BSD", None, None),
    ],
)
def test_licence_expressions(text, postfix, permitted):
    assert license_scan.parse_expression(text) == postfix
    if postfix:
        assert license_scan.evaluate(postfix, license_scan.PERMISSIVE.__contains__) is permitted


def brute_value(text, allowed):
    """An expression's value by recursive descent: another way than the shunting-yard."""
    tokens = re.findall(r"[()]|[^\s()]+", text)

    def level(k):
        if k == 3:
            t = tokens.pop(0)
            if t == "(":
                v = level(0)
                assert tokens.pop(0) == ")"
                return v
            return license_scan.family(t) in allowed
        v = level(k + 1)
        while tokens and tokens[0].upper() == ("OR", "AND", "WITH")[k]:
            tokens.pop(0)
            w = level(k + 1)
            v = (v or w, v and w, v)[k]
        return v

    v = level(0)
    assert not tokens
    return v


def test_licence_values_against_recursive_descent():
    rng = random.Random(20)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["MIT", "GPL-3.0-only", "BSD-3-Clause", "Apache-2.0", "LGPL-2.1+"])
        a, op, b = make(depth - 1), rng.choice(["AND", "OR", "or", "With"]), make(depth - 1)
        return f"({a} {op} {b})" if rng.random() < 0.5 else f"{a} {op} {b}"

    for _ in range(500):
        e = make(4)
        assert license_scan.evaluate(license_scan.parse_expression(e), license_scan.PERMISSIVE.__contains__) is brute_value(e, license_scan.PERMISSIVE)


def test_licence_tags_come_from_the_automaton(spark):
    texts = [
        "SPDX License Identifier: MIT", "spdx-license-identifier : Apache-2.0 */ int x;", "// SPDX-License-Identifier: MIT/GPL-3.0-only", "é <!-- SPDX-License-Identifier: MIT -->",
        "the spdx license identifier is a tag", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only\r\nmit license", "spdx license identifierx: MIT", "SPDX-License-Identifier:",
    ]
    got = rows(license_scan.scan_licenses(frame(spark, [*texts, texts[0], None, ""])))
    view = [(g["labels"], g["expressions"], g["n_malformed"], g["permitted"], g["score"]) for g in (got[i][0] for i in range(11))]
    nothing = ("", "", 0, None, 0.0)
    assert view == [
        ("mit", "MIT", 0, True, 0.9), ("apache", "Apache-2.0", 0, True, 0.9), ("", "", 1, False, 0.0), ("mit", "MIT", 0, True, 0.9),
        nothing, ("gpl,mit", "MIT; GPL-2.0-only", 0, False, 0.96), nothing, ("", "", 1, False, 0.0), ("mit", "MIT", 0, True, 0.9), nothing, nothing,
    ]


def test_licence_scan_is_linear():
    for end in (b"\n", b" "):
        text = b"mit license gnu general public license spdx-license-identifier: MIT" + end
        short, long = (min(seconds(lambda n=n: license_scan.scan(text * n)) for _ in range(2)) for n in (4_000, 16_000))
        assert long < 8 * short + 0.2
        assert license_scan.scan(text * 16_000)["n_base"] == 32_000


# ------------------------------------------------------------------ packing
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_covers_every_token_once(spark):
    rng = random.Random(3)
    texts = ODD + ["<|endoftext|> tail", "a" * 5_000] + [" ".join(rng.choice("the of and token é 中").join("ab") for _ in range(rng.randrange(0, 900))) for _ in range(150)]
    texts += texts[10:14]
    df = frame(spark, texts).repartition(3)
    got = packing.pack(df).toPandas()
    tok = tokenizer()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for k, part in got.groupby("doc_id"):
        part = part.sort_values("start")
        assert (part["start"].to_numpy() == np.concatenate([[0], np.cumsum(part["length"])[:-1]])).all()
        assert part["length"].sum() == len(ids[k]) and (part["doc_tokens"] == len(ids[k])).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][r.start : r.start + r.length], "<u4").tobytes())
    assert set(got["doc_id"]) == set(ids)
    padding = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s["length"].sum())
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all() and total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding == 0


def test_packing_chooses_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = 12
        levels = packing.LevelArray(w)
        levels.counts[1:w] = rng.integers(0, 4 if rng.random() < 0.5 else 40, w - 1)
        size = int(rng.integers(1, w))
        cost = {}
        for h in range(w):
            if h and not levels.counts[h]:
                continue
            c = levels.counts.copy()
            c[h] -= h > 0
            if h + size < w:
                c[h + size] += 1
            elif h + size > w:
                c[h + size - w] += 1
            cost[h] = int((c[1:w] ** 2).sum()) + packing.CUT * (h + size > w)
        assert cost[levels.choose(size)] == min(cost.values())


@pytest.mark.parametrize("sizes", ["any", "same", "over half"])
def test_packing_keeps_every_id_and_bounds_open_windows(sizes):
    p = packing.Packer(0, window=64)
    rng = np.random.default_rng(2)
    n = {"any": lambda: rng.integers(1, 200), "same": lambda: 38, "over half": lambda: rng.integers(33, 64)}[sizes]
    docs = [rng.integers(0, 99, n()).astype("<u4") for _ in range(3000)]
    out, most = [], 0
    for i, d in enumerate(docs):
        out += list(p.add(i, d))
        most = max(most, int(p.levels.counts.max()))
        assert len(p.held) == p.levels.counts.sum()
    assert most <= packing.CUT / 2 + 2
    before = len(out)
    out += list(p.finish())
    assert before > 0.8 * len(out)
    for i, d in enumerate(docs):
        mine = sorted(x[1:4] for x in out if x[0] == i)
        assert [x[0] for x in mine] == list(np.cumsum([0, *(x[1] for x in mine)])[:-1]) and sum(x[1] for x in mine) == len(d)
        assert all(zlib.crc32(d[s : s + k].tobytes()) == c for s, k, c in mine)
    fill = {}
    for x in sorted(out, key=lambda x: (x[5], x[6])):
        assert x[6] == fill.get(x[5], 0)
        fill[x[5]] = x[6] + x[2]
    partial = [v for v in fill.values() if v < 64]
    assert all(v & (v - 1) == 0 for v in partial) and len(partial) <= 6


LONG_SPACE = [" " * 1_000_000 + "x", "\n" * 1_000_000, " \n\t" * 400_000 + "x y", ("a" + " " * 9_999) * 40, "b" + " " * 10_000 + "c\u00a0" + "\u3000" * 20_000]


def test_encoding_of_very_long_white_space():
    import public_tokenizers

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    for t in LONG_SPACE:
        assert packing.encode(t, path, ranks).tolist() == tokenizer().encode(t, add_special_tokens=False).ids


def test_fast_and_plain_tokenizer_agree_on_characters():
    import public_tokenizers

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    tok = tokenizer()
    points = [c for c in range(0x20, 0x3400) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F600))
    texts = ["a" + chr(c) + "b 1" + chr(c) + chr(c) + " x" for c in points]
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    bad = [c for c, t, w in zip(points, texts, want, strict=True) if packing.encode(t, path, ranks).tolist() != w]
    assert not bad, [hex(c) for c in bad[:20]]


# ------------------------------------------------------------------ token counts under edits
def changed(text, edits):
    for s, d, x in edits or []:
        s = min(s, len(text))
        text = text[:s] + (x or "") + text[s + d :]
    return text


@pytest.mark.parametrize("leaf", [2, 64])
def test_token_trees_follow_any_edits(monkeypatch, leaf):
    import public_tokenizers

    monkeypatch.setattr(token_edit, "LEAF", leaf)
    split, count, encode = token_edit.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(leaf)
    for _ in range(400):
        text = "".join(rng.choice(" ab\n\té中😀.the's12") for _ in range(rng.randrange(0, 300)))
        tree = token_edit.TokenTree.plant(text, split, count)
        for _ in range(8):
            e = (rng.randrange(0, 320), rng.choice([0, 1, 5, 40, 400]), rng.choice([*token_edit.INSERTS, " " * 30, "x y " * 60]))
            text = changed(text, [e])
            tree.edit(*e)
            assert tree.text() == text and tree.n_chars == len(text)
            assert (tree.n_tokens, tree.n_pieces) == (len(encode(text)), len(split(text)))
            sums = {s: getattr(tree, s) for s in token_edit.SUMS}
            assert all(x[i] == x[2 * i] + x[2 * i + 1] for x in sums.values() for i in range(1, tree.size))
            tree = token_edit.TokenTree.load(text, sums, split, count)


def test_token_edit_against_encoding_anew(spark):
    import public_tokenizers

    _, _, encode = token_edit.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    texts = ODD + LONG_SPACE + ["".join(rng.choice(" ab\n\té中😀.the's12") for _ in range(rng.randrange(0, 400))) for _ in range(80)]
    ids = [None if i == 9 else 8 if i == 10 else i for i in range(len(texts))]  # a null key and a used one
    plan = lambda: [[(rng.randrange(0, 420), rng.randrange(0, 30), rng.choice([*token_edit.INSERTS, None])) for _ in range(5)] for _ in texts]
    first, second = plan(), plan()
    first[1] = second[4] = None
    schema = "doc_id long, text string, chars string, i int"
    state = token_edit.plant(spark.createDataFrame([(k, t, "clash", i) for i, (k, t) in enumerate(zip(ids, texts, strict=True))], schema), key="i")
    # the table of trees takes one batch of edits after another
    for edits in (first, second):
        todo = spark.createDataFrame(list(enumerate(edits)), "i int, edits array<struct<start:long,delete:long,insert:string>>")
        state = token_edit.apply_edits(state.join(todo, "i"), key="i").cache()
        got = rows(state, "i")
        for i, (t, e) in enumerate(zip(texts, edits, strict=True)):
            now = changed(t or "", e)
            assert got[i][0]["text"] == now and got[i][0]["n_chars_after"] == len(now)
            assert got[i][0]["n_tokens_before"] == len(encode(t or "")) and got[i][0]["n_tokens_after"] == len(encode(now))
            assert e or got[i][0]["n_reencoded"] == 0
            texts[i] = now
        # edits of a long text touch few of its pre-tokens
        assert got[4][0]["n_reencoded"] < 1500 < got[4][0]["n_pretokens"]
    again = token_edit.apply_edits(token_edit.plant(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")).selectExpr("*", "array(named_struct('start', 0, 'delete', null, 'insert', 'x '), null) AS edits"))
    assert [r["n_tokens_after"] for r in again.collect()] == [3, 3, 3]
    made = rows(token_edit.op4_token_edit(spark, SF))
    assert len(made) == 200 and all(r[0]["n_reencoded"] > 0 for r in made.values())


def test_an_edit_of_a_text_of_twice_the_length_encodes_no_more():
    import public_tokenizers

    split, count, _ = token_edit.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    trees = [token_edit.TokenTree.plant("some words " * n, split, count) for n in (50_000, 100_000)]
    for t in trees:
        for at in range(0, 400_000, 40_000):
            t.edit(at, 3, " new")
    assert trees[0].reencoded == trees[1].reencoded < 10 * 4 * token_edit.LEAF


# ------------------------------------------------------------------ unigram pieces
def brute_path(pieces, scores, byte_ids, unknown, b):
    """Best score, ids and ids of one part, from a plain dictionary of pieces."""
    best = [(0.0, ())] + [None] * len(b)
    for i in range(len(b)):
        if best[i] is None:
            continue
        found = [j for j in range(i + 1, len(b) + 1) if b[i:j] in pieces]
        width = len(b[i : i + 4].decode(errors="ignore")[:1].encode())
        options = [(j, scores[pieces[b[i:j]]], (pieces[b[i:j]],)) for j in found]
        if i + width not in found:
            options.append((i + width, unknown, tuple(byte_ids[x] for x in b[i : i + width])))
        for j, s, ids in options:
            if best[j] is None or best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, best[i][1] + ids)
    return best[-1]


def brute_parts(text):
    return re.findall(f"{unigram.MARK}*[^{unigram.MARK}]+|{unigram.MARK}+", unigram.MARK + text.replace(" ", unigram.MARK)) if text else []


UNIGRAM = [None, "", " ", "the cat sat", "  two  spaces ", "cats and\ttabs\n\nthe end", "é中😀▁x ▁", "one\x01two three", "zqx" * 40, "the the the information"]


def test_unigram_scores_and_paths_against_brute_force(spark):
    import sentencepiece

    path = unigram._path("")
    listed = unigram.read_pieces(path)
    pieces = {p.encode(): i for i, (p, _, k) in enumerate(listed) if k == unigram.NORMAL}
    byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(listed) if k == unigram.BYTE}
    rng = random.Random(6)
    texts = UNIGRAM + ["".join(rng.choice(" ab\n\té中😀▁.the'") for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    df = frame(spark, [*texts, texts[3]])
    counted = {}
    for t in [*texts, texts[3]]:
        for p in brute_parts(t or ""):
            counted[p] = counted.get(p, 0) + 1
    assert {r["part"]: r["n"] for r in unigram.count_parts(df.repartition(3)).collect()} == counted
    scores = dict.fromkeys(pieces.values(), -1.0)
    for _ in range(unigram.ROUNDS):
        seen = dict.fromkeys(pieces.values(), 0)
        unknown = min(scores.values()) - unigram.UNKNOWN_PENALTY
        for p, n in counted.items():
            for i in brute_path(pieces, scores, byte_ids, unknown, p.encode())[1]:
                if i in seen:
                    seen[i] += n
        total = sum(seen.values()) + unigram.ADDED * len(seen)
        scores = {i: float(np.log((n + unigram.ADDED) / total)) for i, n in seen.items()}
    got = unigram.estimate(df)
    assert max(abs(got[i] - s) for i, s in scores.items()) < 1e-9
    assert (got == unigram.estimate(df.repartition(7))).all()

    unknown = min(scores.values()) - unigram.UNKNOWN_PENALTY
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = rows(unigram.encode_texts(df))
    short = unigram.model(path, got)
    for i, t in enumerate(texts):
        want = [brute_path(pieces, scores, byte_ids, unknown, p.encode()) for p in brute_parts(t or "")]
        ids = enc[i][0]["ids"]
        assert abs(enc[i][0]["score"] - sum(s for s, _ in want)) < 1e-6 * max(1, abs(enc[i][0]["score"]))
        assert ids == [x for _, y in want for x in y] and short.decode(ids) == sp.decode(ids)
        assert ids == [x for p in brute_parts(t or "") for x in short.one(p.encode())[0]]
    back = rows(unigram.decode_ids(unigram.encode_texts(df)))
    assert [back[i][0]["text"] for i in range(len(UNIGRAM)) if unigram.MARK not in (UNIGRAM[i] or "")] == [t or "" for t in UNIGRAM if unigram.MARK not in (t or "")]


def test_unigram_odd_rows(spark):
    d = rows(unigram.digest(frame(spark, [*ODD, ODD[5]])))
    assert d[0][0]["n_pieces"] == 0 and d[5][0]["n_byte_pieces"] > 0 and all(d[i][0]["round_trip"] for i in range(len(ODD)))
    assert {k: v for k, v in d[5][0].items() if k != "doc_id"} == {k: v for k, v in d[len(ODD)][0].items() if k != "doc_id"}
    odd = spark.createDataFrame([(1, [-5, 40_000, None], "x"), (1, [-5, 40_000, None], "x"), (None, None, "y")], "doc_id long, ids array<int>, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in unigram.decode_ids(odd).collect()), key=str) == [(1, "\ufffd\ufffd"), (1, "\ufffd\ufffd"), (None, "")]
    assert unigram.decode_ids(odd.limit(0)).count() == 0 and unigram.encode_texts(odd.limit(0)).count() == 0
    assert len(set(unigram.estimate(frame(spark, [None, ""]))[300:])) == 1


def test_unigram_takes_fewer_bits_than_the_first_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, once = unigram.estimate(docs), unigram.estimate(docs, rounds=1)
    total = lambda s: unigram.encode_texts(docs, scores=s).selectExpr("sum(score)").first()[0]
    assert total(whole) >= total(once)


def test_double_array_finds_all_prefixes():
    rng = random.Random(7)
    words = {"".join(rng.choice("abcé中") for _ in range(rng.randrange(1, 6))).encode() for _ in range(300)}
    ids = {w: i for i, w in enumerate(sorted(words))}
    trie = unigram.DoubleArray(ids)
    for _ in range(300):
        t = "".join(rng.choice("abcé中z") for _ in range(8)).encode()
        assert list(trie.prefixes(t, 0)) == [(j, ids[t[:j]]) for j in range(1, len(t) + 1) if t[:j] in ids]


# ------------------------------------------------------------------ language model
def lm_text(rng, n):
    out = []
    for _ in range(n):
        a = rng.randrange(20)
        out += [f"w{a}", f"w{20 + a}", f"w{a}"]  # the middle word follows from either side
    return " ".join(out)


def test_lm_learns_both_sides(spark):
    rng = random.Random(8)
    train = [lm_text(rng, 120) for _ in range(120)]
    shuffled = " ".join(rng.sample(train[0].split(), len(train[0].split())))
    got = rows(lm_score.score(frame(spark, [*train, shuffled, *ODD, train[0]]), min_count=30))
    assert got[0][0]["mean_log_likelihood"] > got[120][0]["mean_log_likelihood"] + 0.5
    assert got[121][0]["log_likelihood"] == 0 and got[121][0]["mean_log_likelihood"] is None and got[125][0]["n_tokens"] == 30_000
    assert got[0][0]["log_likelihood"] == got[129][0]["log_likelihood"]  # a repeated row


@pytest.mark.parametrize("v", [0, 1, 60])
def test_lm_network_against_plain_sums(v):
    """Probabilities add up to 1 over the vocabulary and the rest, and are those of a plain
    walk through classes and members."""
    import math

    rng = np.random.default_rng(v)
    net = lm_score.Network(np.sort(rng.integers(1, 1000, v))[::-1], 50.0, seed=3)
    pad = len(net.parts["embedding"]) - 1
    around = rng.integers(0, pad + 1, (4, 5))
    for i in range(5):
        column = np.repeat(around[:, i : i + 1], v + 1, axis=1)
        lp = net.log_probabilities(np.arange(v + 1), column)  # v stands for any other word
        assert abs(np.exp(lp).sum() - 1) < 1e-4
        e, g = net.parts["embedding"], net.parts["gate"]
        h = [math.tanh(float(g[-1][d]) + sum(float(g[k][d]) * float(e[around[k, i]][d]) for k in range(4))) for d in range(lm_score.WIDTH)]
        dot = lambda w, b: sum(x * float(y) for x, y in zip(h, w, strict=True)) + float(b)
        head = [math.exp(dot(net.parts["head"][c, :-1], net.parts["head"][c, -1])) for c in range(net.classes + 1)]
        for w in range(v + 1):
            c = net.class_of[w]
            p = head[c] / sum(head)
            if w < v:
                members = [u for u in range(v) if net.class_of[u] == c]
                z = {u: math.exp(dot(net.parts["member"][u, :-1], net.parts["member"][u, -1])) for u in members}
                p *= z[w] / sum(z.values())
            assert abs(lp[w] - math.log(p)) < 1e-4


def test_lm_document_sums_against_brute_force(spark, monkeypatch):
    """A document's sum, word by word, from the weights that the query trains."""
    rng = random.Random(18)
    texts = [lm_text(rng, 40) + " " + " ".join(rng.choice(["rare", "odd", "zzz", "é中"]) + str(rng.randrange(9)) for _ in range(5)) for _ in range(30)] + ODD
    kept = {}
    train, vocabulary = lm_score.train, lm_score.vocabulary
    monkeypatch.setattr(lm_score, "train", lambda *a: kept.setdefault("net", train(*a)))
    monkeypatch.setattr(lm_score, "vocabulary", lambda *a: kept.setdefault("words", vocabulary(*a)))
    got = rows(lm_score.score(frame(spark, texts), min_count=25))
    net, (known, counts, spelling, rest) = kept["net"], kept["words"]
    every = [[x.encode() for x in re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())] for t in texts]
    flat = [w for x in every for w in x]
    assert {w: flat.count(w) for w in set(flat) if flat.count(w) >= 25} == dict(zip(known, counts.tolist(), strict=True))
    tail = [w for w in flat if w not in known]
    assert rest == len(tail)
    pairs = np.full((257, 257), lm_score.ADDED)
    for w in tail:
        for a, b in zip([256, *w], [*w, 256], strict=True):
            pairs[a, b] += 1
    p = pairs / pairs.sum(axis=1, keepdims=True)
    spell = lambda w: float(np.prod([p[a, b] for a, b in zip([256, *w], [*w, 256], strict=True)]))
    left = 1 - p[256, 256] - sum(map(spell, known))
    pad = len(net.parts["embedding"]) - 1
    number = lambda w: known.index(w) if w in known else len(known) + zlib.crc32(w) % lm_score.TAILS
    for i, x in enumerate(every):
        ids = [pad, pad, *map(number, x), pad, pad]
        total = 0.0
        for k, w in enumerate(x[:200], 2):
            around = np.array([[ids[k + d]] for d in (-2, -1, 1, 2)])
            total += float(net.log_probabilities(np.array([ids[k]]), around)[0]) + (0 if w in known else np.log(spell(w) / left))
        assert got[i][0]["n_tokens"] == len(x) and got[i][0]["n_spelled"] == sum(w not in known for w in x)
        if len(x) <= 200:
            assert abs(got[i][0]["log_likelihood"] - total) < 1e-2


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 1 << 14)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (rows(lm_score.score(docs.repartition(n), min_count=10)) for n in (1, 13))
    assert len(one) == 200
    pairs = [(one[k][0]["mean_log_likelihood"], many[k][0]["mean_log_likelihood"]) for k in one if one[k][0]["n_tokens"]]
    assert max(abs(a - b) for a, b in pairs) < 1e-4


def test_lm_step_descends_the_loss():
    """Each step's change is along the numeric gradient of the loss."""
    rng = np.random.default_rng(9)
    net = lm_score.Network(np.sort(rng.integers(5, 90, 40))[::-1], 10.0)
    center, around = rng.integers(0, 45, 60), rng.integers(0, 105, (4, 60))
    loss = lambda n: -n.log_probabilities(center, around).mean()
    after = net.copy()
    after.step(center, around, {k: np.full(x.shape, 1e8, np.float32) for k, x in net.parts.items()})  # plain small steps
    for k, x in net.parts.items():
        g = (x.astype(float) - after.parts[k]) * 1e4 / lm_score.RATE
        for _ in range(6):
            moved, at = net.copy(), tuple(rng.integers(0, n) for n in x.shape)
            moved.parts[k][at] += 1e-2
            up = loss(moved)
            moved.parts[k][at] -= 2e-2
            assert abs((up - loss(moved)) / 2e-2 - g[at]) < 0.03 * abs(g[at]) + 0.03, (k, at)


# ------------------------------------------------------------------ fixity
def test_fixity_locates_every_damage(spark):
    import duckdb

    rng = random.Random(10)
    pages = [(i, f"u{i}", "x" * rng.randrange(0, 9000)) for i in range(700)] + [(5, "u5", "other"), (5, "u5", "other"), (None, None, None), (None, "u", "é"), (6, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a = fixity.warc_leaves(df, per_file=64).select("file", "offset", "length", "hash").cache()
    assert a.count() == len(pages) and a.select("file", "offset").distinct().count() == len(pages)
    assert fixity.audit(a, a).count() == 0
    rows_a = a.collect()
    hit = {(r["file"], r["offset"]) for r in rng.sample(rows_a, 9)}
    lost = {(r["file"], r["offset"]) for r in rng.sample(rows_a, 4)} - hit
    b = [(r["file"], r["offset"], r["length"], "bad" if (r["file"], r["offset"]) in hit else r["hash"]) for r in rows_a if (r["file"], r["offset"]) not in lost]
    b += [("p0", 10**9, 5, "new"), ("only-b", 0, 5, "new")]
    got = fixity.audit(a, spark.createDataFrame(b, "file string, offset long, length long, hash string")).collect()
    by = {s: {(r["file"], r["offset"]) for r in got if r["status"] == s} for s in ("corrupt", "missing", "extra")}
    assert by == {"corrupt": hit, "missing": lost, "extra": {("p0", 10**9), ("only-b", 0)}}
    empty = a.limit(0)
    assert fixity.audit(empty, empty).count() == 0 and fixity.audit(a, empty).count() == len(pages)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = {(r[0], r[1], r[-1]) for r in c.sql(fixity.ORACLE_SQL).fetchall()}
    assert {(r["file"], r["offset"], r["status"]) for r in fixity.op3_warc_fixity(spark, SF).collect()} == want


def test_fixity_of_odd_tables(spark, tmp_path):
    pages = [(1, "u", "x", "clash", 5, "h"), (1, "u", "x", "clash", 5, "h"), (16, "u", "y" * 2_000_000, None, None, None), (None, None, None, None, None, None)]
    schema = "page_id long, url string, html string, file string, offset int, hash string"
    df = spark.createDataFrame(pages, schema)
    a = fixity.warc_leaves(df)
    assert a.count() == 4 and a.select("file", "offset").distinct().count() == 4 and a.agg(F.max("length")).first()[0] > 2_000_000
    df.coalesce(1).write.parquet(f"{tmp_path}/odd/pages.parquet")
    got = fixity.op3_warc_fixity(spark, f"{tmp_path}/odd").collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(16, "corrupt")]
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert fixity.op3_warc_fixity(spark, f"{tmp_path}/none").count() == 0 and fixity.warc_leaves(df.limit(0)).count() == 0


# ------------------------------------------------------------------ empty tables
def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    for made in (pii.detect(none), quality.rate(none, None), license_scan.scan_licenses(none), packing.pack(none), token_edit.plant(none), token_edit.apply_edits(token_edit.plant(none).selectExpr('*', 'NULL AS edits')), unigram.digest(none), lm_score.score(none)):
        assert made.count() == 0
