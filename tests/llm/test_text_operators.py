"""Decontamination, near-dups, suffix-array dedup, templates and pieces against brute force."""

import collections
import hashlib
import random
import tracemalloc

import helpers
import numpy as np
import pytest

from citetide.llm import decontaminate, near_dups, pieces, suffixes, templates
from citetide.llm.textblocks import SpanHasher


# ---- decontamination


def brute_decontamination(docs, items):
    patterns = collections.defaultdict(set)
    for item, text in items:
        if item is None or text is None:
            continue
        w = helpers.words(text)
        for i in range(max(len(w) - 12, 1 if w else 0)):
            patterns[tuple(w[i : i + 13])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = helpers.words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if names := patterns.get(tuple(w[i : i + n])):
                    found |= names
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 2000])
def test_decontamination(spark, part_bytes):
    items = [(i, helpers.prose(i, 30)) for i in range(20)] + [(50, "ab"), (51, "x y z"), (52, "Été, ÉTÉ 12"), (53, ""), (54, None), (55, "!!")]
    items += [(None, "lost item"), (3, helpers.prose(3, 30)), (56, helpers.prose(3, 16))]
    texts = [helpers.prose(100 + i, 60) for i in range(12)]
    texts[1] += " " + helpers.prose(1, 30).upper()
    texts[2] = helpers.prose(2, 30)[5:120].replace(" ", ", ")
    texts[3] = "q " * 500 + helpers.prose(3, 30)
    texts += [None, "", "ab", "ab ab AB-ab", "x y", "x\ny z", "été 12 Été été 12", helpers.prose(7, 40) + helpers.prose(8, 40), texts[1]]
    docs = list(enumerate(texts)) + [(1, texts[1]), (None, "ab")]
    frame = helpers.documents(spark, [t for _, t in docs], [i for i, _ in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(frame, bench, part_bytes)
    names = found.columns[-5:]
    got = [
        (r["doc_id"], r[names[0]], r[names[1]], len(r[names[3]]), hashlib.sha256(",".join(sorted(r[names[3]])).encode()).hexdigest(), r[names[4]])
        for r in found.collect()
    ]
    assert sorted(got, key=repr) == brute_decontamination(docs, items)
    kept = decontaminate.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not r[-1] for r in brute_decontamination(docs, items))


def test_candidates_are_compared_in_bounded_numbers(monkeypatch):
    # a hundred patterns begin alike and so share a bucket, and the text holds nothing but this beginning and one of them
    begin, size = b" the same old beginning of a question", 4000
    found = [begin + b" %03d " % i for i in range(100)]
    hasher = SpanHasher()
    text = np.frombuffer((begin + b" ") * size + found[7], np.uint8)
    padded = np.concatenate([text, np.zeros(decontaminate.BLOCK + 1, np.uint8)])
    group = decontaminate.Group([begin + b" "] + found, np.arange(101), hasher)
    hasher.load(text)
    at, which = group.search(padded, len(text), hasher)
    begins = [i * (len(begin) + 1) for i in range(size)] + [len(text) - len(found[7])]
    want = sorted([(x, 0) for x in begins] + [(begins[-1], 8)])
    assert sorted(zip(at.tolist(), which.tolist())) == want
    monkeypatch.setattr(decontaminate, "PAIRS", 1 << 10)
    tracemalloc.start()
    again = group.search(padded, len(text), hasher)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(*(x.tolist() for x in again))) == want
    # all pairs at once take more than 400,000 numbers for each of several arrays
    assert peak < 3 << 20


def test_decontamination_of_empty_tables(spark):
    frame, none = helpers.documents(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame, none).first()["contaminated"] is False
    assert decontaminate.report(frame.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ---- near-duplicates


def probability_jaccard(x, y):
    """Of two counters: the sum over common elements of their share under the larger of both weights."""
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def brute_classes(docs, similarity=0.8, alike=probability_jaccard):
    bags = [
        (d, t, collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))))
        for d, t in docs
        for w in [helpers.words(t)]
    ]
    parent = list(range(len(bags)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, x) in enumerate(bags):
        for j in range(i):
            _, b, y = bags[j]
            if a is not None and b is not None and (a == b or (x.keys() & y.keys() and alike(x, y) >= similarity - 1e-9)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = collections.defaultdict(list)
    for i, (d, _, _) in enumerate(bags):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, min(least[root(i)], default=None)) for i, (d, _, _) in enumerate(bags)), key=repr)


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def near_texts():
    base, other = helpers.prose(1, 150), helpers.prose(2, 90)
    texts = [helpers.prose(50 + i, 80) for i in range(30)]
    texts += [base, base, base.upper()] + [edited(base, i, i % 8) for i in range(40)]
    texts += [other] + [edited(other, i, 1 + i % 3) for i in range(10)]
    texts += [None, None, "", "", "!!", "one two", "One, two", "three", " ".join(["same line here again now"] * 200)]
    return texts


def test_near_duplicates(spark):
    docs = [(7 * i % 101, t) for i, t in enumerate(near_texts())] + [(None, near_texts()[30]), (None, "alone and lonely")]
    frame = helpers.documents(spark, [t for _, t in docs], [i for i, _ in docs])
    found = near_dups.report(frame).collect()
    assert sorted([(r.doc_id, r.class_id) for r in found], key=repr) == brute_classes(docs)
    kept = near_dups.keep_one(frame)
    assert kept.columns == frame.columns
    expected = {c for d, c in brute_classes(docs)} - {None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(expected)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["alone and lonely"]


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SIDE", 2)
    docs = list(enumerate(near_texts()))
    found = near_dups.report(helpers.documents(spark, [t for _, t in docs])).collect()
    assert sorted([(r.doc_id, r.class_id) for r in found], key=repr) == brute_classes(docs)


def test_repeated_shingles_weigh_by_their_number(spark):
    line, base = helpers.prose(3, 9), helpers.prose(4, 100)
    # one set of shingles, other counts; and other sets with the weight on what they share
    texts = [" ".join([base] + [line] * 2), " ".join([base] + [line] * 40), " ".join([line] * 90 + [helpers.prose(5, 30)])]
    texts += [" ".join([line] * 90 + [helpers.prose(6, 30)]), " ".join([base] + [line] * 41), " ".join([base] + [line] * 2 + ["end"])]
    docs = [(f"d{i}", t) for i, t in enumerate(texts)]
    expected = brute_classes(docs)
    assert expected != brute_classes(docs, alike=lambda x, y: len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
    frame = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    assert sorted((r.doc_id, r.class_id) for r in near_dups.report(frame).collect()) == expected


def test_recall_at_the_limit():
    """Pairs of sets of similarity 0.8 share a band."""
    rng = np.random.default_rng(8)
    pairs = 2000
    grams = rng.integers(1, 1 << 62, (pairs, 90)).astype(np.uint64)
    both = np.concatenate([grams[:, :81], grams[:, 9:]]).ravel()  # 72 of 90: exactly 0.8
    held = near_dups.sketch(both, np.repeat(np.arange(2 * pairs), 81), np.ones(len(both)), 2 * pairs)
    bands = (held[:pairs] == held[pairs:]).reshape(pairs, near_dups.BANDS, near_dups.ROWS).all(axis=2)
    assert bands.any(axis=1).mean() > 0.999


def test_near_duplicates_of_empty_table(spark):
    assert near_dups.report(helpers.documents(spark, ["a"]).limit(0)).count() == 0


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 30, 12)).astype(np.uint64) for _ in range(2))
        wa, wb = rng.integers(1, 5, len(a)).astype(np.uint32), rng.integers(1, 5, len(b)).astype(np.uint32)
        x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
        plain = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert near_dups.similarity(a, wa, b, wb) == pytest.approx(plain)
        assert near_dups.similarity(a, None, b, None) == pytest.approx(len(x.keys() & y.keys()) / len(x.keys() | y.keys()))


def test_sketch_estimates_probability_jaccard():
    a, b = np.arange(1, 301, dtype=np.uint64), np.arange(61, 361, dtype=np.uint64)
    for wa, wb in ((np.ones(300), np.ones(300)), (np.arange(1, 301) % 4 + 1.0, np.arange(61, 361) % 4 + 1.0)):
        held = near_dups.sketch(np.concatenate([a, b]), np.repeat([0, 1], 300), np.concatenate([wa, wb]), 2, 4096)
        true = near_dups.similarity(a, wa, b, wb)
        assert abs((held[0] == held[1]).mean() - true) < 0.04


# ---- suffix arrays


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 60, 300):
        for k in (2, 3, 20):
            text = np.append(rng.integers(1, k, n), 0).astype(np.int16)
            assert suffixes.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def brute_removed(docs, length):
    counts = collections.Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"length": 40, "gram": 8}, {"length": 40, "gram": 8, "group": 1}, {"length": 40, "gram": 8, "shard": 1}, {}])
def test_repeats(spark, sizes):
    passage, rng = helpers.prose(9, 100), random.Random(4)
    texts = [helpers.prose(i, 60) for i in range(10)]
    texts += [helpers.prose(20 + i, 10) + passage[rng.randint(0, 30) : 500 + i] + helpers.prose(40 + i, 10) for i in range(12)]
    texts += [passage, passage, passage * 3, "é" * 500, "ab" * 300, "", None, "short", "\x00" * 450, helpers.prose(60, 3000) + passage]
    docs = list(enumerate(texts)) + [(0, texts[0]), (None, passage)]
    found = suffixes.report(helpers.documents(spark, [t for _, t in docs], [i for i, _ in docs]), **sizes).collect()
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=repr)
    assert got == brute_removed(docs, sizes.get("length", 400))


@pytest.mark.parametrize("length, gram", [(400, 32), (40, 8), (12, 8), (9, 8), (8, 8)])
def test_every_window_holds_a_context(length, gram):
    for place in range(length - gram + 1):
        assert any(before <= place and gram + behind <= length - place for before, behind in suffixes.contexts(length, gram))


def test_segments_meet_by_one_context(spark):
    contexts = [f"context{j}" for j in range(suffixes.CONTEXTS)]
    none = [None] * suffixes.CONTEXTS
    rows = [
        (1, 1, 0, 7, None, *[10, 11, 12, 13], *none[4:]),
        (1, 2, 0, 7, None, *[20, 11, 22, 23], *none[4:]),  # as the first in one context
        (1, 3, 0, 7, None, *[11, 30, 32, 33], *none[4:]),  # the same number, of another context
        (2, 4, 0, 7, None, *[10, 11, 12, 13], *none[4:]),  # another anchor
        (3, 5, 0, None, 8, *none[:4], *[1, 2, 3, None]),
        (3, 6, 0, None, 8, *none[:4], *[4, 5, 6, None]),
        (3, 7, 0, None, None, *none),
    ]
    schema = "anchor long, s1 long, s2 long, behind int, before int, " + ", ".join(f"{c} int" for c in contexts)
    assert sorted(r.s1 for r in suffixes._meeting(spark.createDataFrame(rows, schema)).collect()) == [1, 2]


def test_kept_bytes(spark):
    frame = helpers.documents(spark, ["x" * 30 + "abcdefgh" * 6, "y" * 5 + "abcdefgh" * 6, None, ""])
    kept = {r.doc_id: r.kept for r in suffixes.remove_repeats(frame, length=40, gram=8).collect()}
    assert kept == {0: b"x" * 30, 1: b"y" * 5, 2: None, 3: b""}
    assert suffixes.report(frame.limit(0)).count() == 0


# ---- templates


def brute_templates(texts, min_docs, long=40):
    def masked(line):
        return [templates.WILD if any(c in "0123456789" for c in t) else t for t in line.split(" ")]

    def leaf(line):
        return line.count(" "), tuple(masked(line)[: templates.LEADING])

    lines = {(t, x) for t in set(texts) - {None} for x in t.split("\n") if x.strip(" ")}
    reached = collections.Counter(leaf_ for leaf_ in {(leaf(x), t) for t, x in lines} for leaf_ in [leaf_[0]])
    lines = {(t, x) for t, x in lines if reached[leaf(x)] >= min_docs}
    tokens = collections.Counter((leaf(x), i, m) for _, x in lines for i, m in enumerate(masked(x)))
    kinds = {}
    for _, x in lines:
        fields = [m if tokens[leaf(x), i, m] >= min_docs and m != templates.WILD else templates.WILD for i, m in enumerate(masked(x))]
        if 2 * sum(f != templates.WILD for f in fields) >= len(fields):
            kinds[x] = (leaf(x), tuple(fields))
    support = collections.Counter(k for k, _ in {(kinds[x], t) for t, x in lines if x in kinds})
    homes = collections.defaultdict(set)
    for t, x in {(t, x) for t in set(texts) - {None} for x in t.split("\n") if x.strip(" ")}:
        homes[x].add(t)

    def goes(t, x):
        if x in kinds and support[kinds[x]] >= min_docs or len(homes[x]) >= min_docs:
            return True
        return len(x) >= long and len(homes[x]) > 1 and t != min(homes[x], key=lambda h: hashlib.md5(h.encode()).hexdigest()[:15])

    out = []
    for t in texts:
        old = [] if t is None else t.split("\n")
        kept = [x for x in old if not goes(t, x)]
        out.append((None if t is None else "\n".join(kept), len(old), len(old) - len(kept)))
    return sorted(out, key=repr)


def test_templates(spark):
    texts = []
    for i in range(12):
        lines = [helpers.prose(100 + i, 12), f"Copyright {2000 + i} by the makers of {helpers.prose(i, 1)}", "", "  "]
        lines += [f"user u{i} logged in from 10.0.0.{i}"] * (i % 3) + [f"{i} {i}"] + ["the end of all"] * (i < 4)
        texts.append("\n".join(lines))
    texts += [texts[0], texts[0], None, "", "\n", "copied line here\nbody one"] + ["copied line here\nbody one"] * 9
    for min_docs in (5, 2):
        frame = helpers.documents(spark, texts)
        found = templates.drop_templates(frame, min_docs)
        got = sorted([(r.text, r.n_lines, r.n_dropped) for r in found.collect()], key=repr)
        assert got == brute_templates(texts, min_docs)
    clash = frame.withColumn("N_LINES", frame.doc_id).withColumn("text_key", frame.doc_id)
    assert {"N_LINES", "_n_lines", "text_key"} <= set(templates.drop_templates(clash, 5).columns)
    assert templates.drop_templates(frame.limit(0)).count() == 0


def test_lines_recur_with_production_values(spark):
    passage, digits, footer, short = helpers.prose(7, 80), "+1 555 0100 2019-01-01 12:00 ok", "著作権2024", "three short words"
    texts = [f"{helpers.prose(i, 30)}\n{passage}" for i in range(9)]
    texts += [f"{helpers.prose(100 + i, 30)}\n{digits}\n{footer}" for i in range(60)]
    texts += [f"{helpers.prose(200 + i, 30)}\n{short}" for i in range(9)] + [texts[0]] * 3
    found = [r.text.split("\n") for r in templates.drop_templates(helpers.documents(spark, texts)).collect()]
    # a long line stays in one text and its copies
    keeper = min(texts[:9], key=lambda t: hashlib.md5(t.encode()).hexdigest()[:15])
    assert sum(passage in x for x in found) == texts.count(keeper)
    assert not any(digits in x or footer in x for x in found)
    assert sum(short in x for x in found) == 9
    assert sorted(x[0] for x in found) == sorted(t.split("\n")[0] for t in texts)


def test_texts_are_split_twice_for_their_lines(spark):
    """Once for the marks of all lines and once for the candidates; nothing is left to split when the lines are read."""
    texts = [f"a line of its own, number {n}\nthe same long line that stands in each of the texts\nend" for n in range(30)]
    lost = templates.recurring_lines(helpers.documents(spark, texts))
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan
    # every line recurs: two as they are, one by its template
    assert lost.distinct().count() == 90


def test_tokens_with_a_digit_are_masked(spark):
    lines = ["a1b 22 c", "1 a", "abc def ghi", "x9 y z9", " 7 ", "a  b5  c", "\u00e97\tq r", "-3- no"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    found = [r[0] for r in rows.select(templates.F.regexp_replace("line", templates._VARIABLE, templates.WILD)).collect()]
    assert found == [" ".join(templates.WILD if any(c in "0123456789" for c in t) else t for t in x.split(" ")) for x in lines]


# ---- pieces


TEXTS = ["hello wörld  ▁x\n\n 世界😀 龘龘", None, "", " ", "   a  ", "a" * 2000, "\x00▁ é", helpers.prose(1, 3000), "tab\tand\r\nline"]


def test_pieces_are_lossless_and_reproducible(spark):
    frame = helpers.documents(spark, TEXTS)
    encoded = pieces.encode(frame, ["doc_id"], check=True)
    rows = {r.doc_id: r for r in pieces.decode(encoded).collect()}
    assert [rows[i].decoded for i in range(len(TEXTS))] == TEXTS
    assert all(r.lossless for r in rows.values())
    again = {r.doc_id: r.pieces for r in pieces.encode(helpers.documents(spark, TEXTS, partitions=1), ["doc_id"]).collect()}
    assert again == {i: r.pieces for i, r in rows.items()}
    other = {r.doc_id: r.pieces for r in pieces.encode(frame, ["doc_id"], seed=9).collect()}
    assert other[7] != rows[7].pieces
    assert pieces.encode_report(frame.limit(0)).count() == 0


def test_words_are_drawn_by_their_probability():
    import itertools

    with open(pieces.MODEL, "rb") as file:
        vocabulary = pieces.Vocabulary(file.read(), alpha=1.0)
    word = " theaa"
    names = {b.decode(): i for i, b in enumerate(vocabulary.bytes_of) if b and i > 258}
    weights = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in names for p in parts):
            ids = tuple(names[p] for p in parts)
            weights[ids] = np.exp(sum(vocabulary.log_of[i] for i in ids))
    total, n = sum(weights.values()), 40_000
    lattices = pieces.Lattices(vocabulary)
    lattices.add([word], [1])
    ids, counts = lattices.draw(np.zeros(n, np.int64), np.zeros(n, np.uint64), np.arange(n) * 7)
    ends = np.cumsum(counts)
    drawn = collections.Counter(tuple(ids[b - c : b].tolist()) for b, c in zip(ends, counts))
    assert set(drawn) <= set(weights)
    for ids, weight in weights.items():
        p = weight / total
        assert abs(drawn[ids] / n - p) < 5 * np.sqrt(p / n) + 1e-4


def test_hash_collisions_do_not_lose_text(spark, monkeypatch):
    with open(pieces.MODEL, "rb") as file:
        vocabulary = pieces.Vocabulary(file.read())
    data = np.frombuffer(b"one two three", np.uint8)
    hasher = SpanHasher()
    monkeypatch.setattr(hasher, "of", lambda starts, ends: np.zeros(len(starts), np.uint64))
    ids, counts = pieces.sample(pieces.Lattices(vocabulary), hasher, data, np.array([0, 13]), np.zeros(1, np.uint64), exact=True)
    assert bytes(vocabulary.decode(ids, counts)[0]) == b"one two three"
