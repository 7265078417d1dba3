"""Secret scans, phrase collocations and vector codes, against plain Python versions."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import compare
import helpers
import numpy as np
import pytest

from citetide.llm import codes, collocations, secrets
from citetide.llm.sql import STATEMENTS

KEYWORD = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
PATTERNS = {
    "assign": rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            size, least = (len(m[2]), 12) if kind == "assign" else (len(m[0]), 18 if kind == "access" else 16)
            if size >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def secret_texts():
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    noise = ["token", "Secret", "api_key", "apikey", "PASSWORD", "=", ":", " ", " ", '"', "'", "AKIA", "\n", "é", "ſecret", "toKen", "𝄞"]
    texts = [None, "", "token=", "token = 'abcdefghijk'", "token = 'abcdefghijkl'", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop"]
    texts += ["password: token: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "AKIAAKIAAKIAAKIA", "AKIA" + "B" * 14, "a" * 15, "a" * 16, "x" + "0f" * 40]
    for _ in range(200):
        parts = [rng.choice([rng.choice(noise), "".join(rng.choices("0123456789abcdef", k=rng.randint(1, 30))),
                             "".join(rng.choices(letters, k=rng.randint(1, 24)))]) for _ in range(rng.randint(1, 40))]
        texts.append("".join(parts))
    return texts + [texts[20]] * 3 + [helpers.prose(3, 20_000) + " passwd=" + "Zz0" * 9]


def test_secret_patterns(spark):
    texts = secret_texts()
    found = secrets.report(helpers.documents(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = plain_spans(texts[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == expected
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in expected) for k in PATTERNS]
    assert secrets.report(helpers.documents(spark, texts).limit(0)).count() == 0


def test_novel_strings_in_sensitive_contexts(spark):
    rng = random.Random(9)
    names = ["client", "session", "request", "header", "config", "provider", "account", "identity", "default", "settings"]

    def key(n):
        return "".join(rng.choices(string.ascii_letters, k=n - 2)) + "7Q"

    def line():
        return f"the {rng.choice(names)} of {rng.choice(names)} sends a bearer header for {rng.choice(names)}_{rng.choice(names)} to config"

    keys = [key(n) for n in (20, 32, 40) * 5]
    told = [f"{line()} with the credential {k} and {line()}" for k in keys]
    plain = [f"{line()} auth {'_'.join(rng.choices(names, k=3))}_v2 and {line()}" for _ in range(40)]  # built from identifiers
    away = [f"{helpers.prose(i, 30)} {key(32)} {helpers.prose(i + 1, 30)}" for i in range(5)]  # no sensitive word
    texts = told + plain + away + [told[0]] * 20 + [f"auth {keys[1]} {keys[1]} {line()}", "auth " + "0" * 200 + "x"]
    found = {r.doc_id: r for r in secrets.find_secrets(helpers.documents(spark, texts)).collect()}

    def novel(i):
        return [s.value for s in found[i].secrets if s.kind == "novel"]

    assert all(novel(i) == [k] for i, k in enumerate(keys))
    first = len(told)
    assert not any(novel(i) for i in range(first, first + len(plain) + len(away)))
    copies = first + len(plain) + len(away)
    assert all(novel(i) == [keys[0]] for i in range(copies, copies + 20))
    assert novel(copies + 20) == [keys[1]] * 2 and not novel(copies + 21)


def test_a_key_does_not_become_an_identifier(spark):
    """Identifiers come from distinct contexts and not from candidates; copies of a text count once."""
    texts = ["credential Xqabcd2Lp9Rt4Zc8Vb1Nm and servicename ."] * 50 + ["an auth servicename x", "an auth servicename y", "a auth Xqabcd2Lp9Rt4Zc8Vb1Nm"]
    assert secrets.identifiers(helpers.documents(spark, texts)) == ["auth", "servicename"]


def plain_collocations(rows, least=30, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i : i + size])
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    cover = Counter()
    for (lang, w), a in counts.items():
        if len(w) > 2 and a >= least:
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    cover[lang, w[i : i + size]] = max(cover[lang, w[i : i + size]], a)
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least and 100 * cover[lang, w] < 80 * a:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(
        (lang, i + 1, w.decode(), -a, l, r, totals[lang], -score)
        for lang, held in out.items()
        for i, (score, a, w, l, r) in enumerate(sorted(held)[:top])
    )


def phrase_rows(spark):
    rng = random.Random(6)
    words = ["The", "of", "und", "é", "𝄞x", "a-b", "x" * 50, "ﬀ", "Zu", "zu"]
    rows = [("en", " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(60)]
    rows += [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice([*words, " ", " ", "\t", ". ", "\n", ",", "\x0b", " ", "\xa0"]) for _ in range(150))) for _ in range(120)]
    rows += [("fr", "one two three four five. " * 40), ("fr", None), ("en", ""), (None, "!?"), ("en", "solo " * 3000)] + [("fr", "alpha beta gamma\tdelta")] * 35
    frame = spark.createDataFrame([(i, l, t, "x", 0) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n long")
    return rows, frame.repartition(4)


@pytest.mark.parametrize("least, entries, burst", [(30, 600_000, 4096), (30, 40, 2), (3, 25, 1)])
def test_collocations(spark, monkeypatch, least, entries, burst):
    """Also with tries that burst and spill all the time."""
    rows, frame = phrase_rows(spark)
    whole = collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, n: whole(docs, n, entries=entries, burst=burst))
    found = collocations.report(frame, least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least)


def test_collocations_keep_the_first(spark):
    rows, frame = phrase_rows(spark)
    assert sorted(map(tuple, collocations.report(frame, 5, 7).collect())) == plain_collocations(rows, 5, 7)
    assert collocations.report(frame.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 62
    rows = [("en", "a b", big, 2), ("en", "a", big, 1), ("en", "b", big + 3, 1), ("en", "c", big, 1), ("en", "a c", 7, 2)]
    found = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, n long, words int")).collect()}
    assert found["a b"].score == 2_000_000 * big // (2 * big + 3) and found["a c"].score == 0


def test_tries_split_and_spill():
    trie, held = collocations.HatTrie(3, burst=3), Counter()
    rng = np.random.default_rng(2)
    for _ in range(30):
        rows = rng.integers(0, 5, (40, 4)).astype(np.int64)
        columns, counts = collocations.distinct(list(rows.T))
        held.update({tuple(k): n for k, n in zip(np.stack(columns, 1).tolist(), counts.tolist())})
        b = collocations.ID_BITS
        trie.add(columns[0], columns[1] << 2 * b | columns[2] << b | columns[3], counts)
    assert trie.size == len(held) and any(isinstance(n, collocations.Inner) for n in trie.root.values())
    out = Counter()
    for keep in (trie.size // 2, 0):
        for first, r, n in zip(*(x.tolist() for x in trie.spill(keep))):
            out[first, r >> 2 * b, r >> b & (1 << b) - 1, r & (1 << b) - 1] += n
        assert trie.size <= keep
    assert out == held


def plain_codes(rows, rounds=6):
    kept = [(v, label, [math.floor(4096 * x) for x in e]) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][2]) // 8
    parts = [[tuple(e[p * width : (p + 1) * width]) for p in range(8)] for _, _, e in kept]
    books = [[parts[i][p] for i in range(min(16, len(kept)))] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            best = [near(row[p], books[p])[1] for row in parts]
            for e in set(best):
                mine = [row[p] for row, b in zip(parts, best) if b == e]
                books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    found = [[near(row[p], books[p]) for p in range(8)] for row in parts]
    errors = [min(codes.LONGEST, sum(d for d, _ in f)) for f in found]
    labels = Counter()
    for (_, label, _), e in zip(kept, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((v or -1, "".join(f"{i:02x}" for _, i in f), e, min(codes.LONGEST, labels[label]), digest) for (v, label, _), f, e in zip(kept, found, errors))


def code_rows(scale, count=60):
    rng = np.random.default_rng(8)
    rows = [(5 * i % 301, (rng.normal(size=24) * scale).tolist(), [None, 0, 1, 2][i % 4]) for i in range(count)]
    rows += [(400 + i, rows[3][1], 1) for i in range(30)]  # copies and ties
    bad = [None, [None] * 24, [float("nan")] * 24, [1.0] * 23 + [float("inf")], [1.0] * 23 + [None]]
    return rows + [(1000 + i, e, 0) for i, e in enumerate(bad)] + [(None, rows[5][1], None)]


@pytest.mark.parametrize("scale, count", [(0.1, 60), (1e6, 60), (1e4, 60), (0.1, 5)])
def test_vector_codes(spark, scale, count):
    """Also with distances beyond what a limb, and beyond what a long can take."""
    rows = code_rows(scale, count)
    rows = rows if count > 5 else rows[:5]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    found = codes.report(frame).collect()
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == plain_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0] * 9, "a"), (2, [], "a"), (3, [3.0e38] * 9, None), (3, [3.0e38] * 9, None), (4, [1.0], "")]
    found = codes.report(spark.createDataFrame(rows, schema)).orderBy("vec_id", "code").collect()
    assert [r.error for r in found] == [0] * 5 and [r.label_error for r in found] == [0] * 5


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(1)
    left, right = rng.integers(-(1 << 27), 1 << 27, (50, 8)), rng.integers(-(1 << 27), 1 << 27, (9, 8))
    left[0], right[0] = -(1 << 27), (1 << 27) - 1
    whole = (left.astype(object) @ right.astype(object).T).astype(np.int64)
    for bits in (1, 5, 12, None):
        assert (codes.exact_products(left, right, bits) == whole).all()
    assert 2 ** (2 * codes.limb_bits(8)) * 8 < 2**53


def test_codes_decode_to_entries(spark):
    rows, width = codes.quantised(spark.createDataFrame(code_rows(0.1), "vec_id long, embedding array<double>, label int"))
    books = codes.train(rows, width)
    for r in codes.decode(codes.encode(rows, books, width), books, 24).collect():
        assert r.vector == [x / 4096 for p in range(8) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)].tolist()]


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, name):
    from citetide.llm.queries import REGISTRY

    oracle = compare.connect("/root/testdata/sf0.001")
    found = REGISTRY[name](spark, "/root/testdata/sf0.001")
    assert compare.spark_types(found) == compare.duckdb_types(oracle, STATEMENTS[name])
    assert compare.spark_rows(found) == compare.duckdb_rows(oracle, STATEMENTS[name])


def test_different_rows_and_spilled_subtrees():
    """Packed and wide rows are told apart alike; what is spilled and what stays add up, as arrays."""
    rng = np.random.default_rng(3)
    for size, most in ((2, 9), (3, 7), (4, 1 << 20)):
        columns = [rng.integers(0, most, 3000) for _ in range(size)]
        expected, counts = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        found, n = collocations.distinct(columns)
        assert (np.stack(found, 1) == expected).all() and (n == counts).all()
        trie, rest = collocations.HatTrie(size - 1, 20), np.zeros(len(n), np.int64)
        for c in found[1:]:
            rest = rest << collocations.ID_BITS | c
        trie.add(found[0], rest, n)
        trie.add(found[0], rest, n)
        parts = [trie.spill(len(n) // 2), trie.spill(0)]
        assert len(parts[0][0]) >= len(n) // 2 and trie.size == 0
        rows = sorted(row for part in parts for row in zip(*(x.tolist() for x in part)))
        assert rows == sorted(zip(found[0].tolist(), rest.tolist(), (2 * n).tolist()))
