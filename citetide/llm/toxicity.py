"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded texts.

Folding: letters that look like Latin ones, accented and full-width letters become plain small letters, digits the
letters they stand for (``@`` and ``$`` too, between letters), ``l`` becomes ``i`` (both are written as 1), and all
other ASCII signs and blanks become single blanks.

The lexicon is learnt from labelled documents. Its terms are whole words and word beginnings of 4 to 12 letters; the
weight of a term is the log odds of its occurring in toxic against other documents. Kept are terms of weight
``WEIGHT`` or more that so many toxic documents do not share by chance (a Chernoff bound of exp(-``EVIDENCE``)),
except those which a longer term explains or a shorter one covers.
Exception phrases are pairs of a term's word and its neighbour that occur in at least ``LEAST`` documents of which
most are not toxic; a match inside one does not count. The sum of the weights of a text's matches, for a hundred
words, gives the score through a logistic curve fitted on the same documents.

Copies and near copies would make the words of one text look like terms; so of documents with one label that share
any of ``LANES`` minima of hashed three-word shingles only the one with the smallest id is learnt from.

At most ``SAMPLE`` labelled documents are learnt from, the first by a hash of their id, and at most ``CANDIDATES``
terms are considered, the most frequent in toxic documents. Null and empty texts have no matches and get the score
of such texts. With labels of one kind only, all scores are 0 or 1 accordingly, without any 0. Of several labels for
a document the toxic one holds. Repeated rows are treated alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

from .languages import held_out
from .near_dups import shingles
from .textblocks import U64, SpanHasher, blocks, mix

SAMPLE, CANDIDATES, LEAST, WEIGHT, EVIDENCE = 20_000, 50_000, 5, 2.5, 15.0
THRESHOLD = 0.7
SHORT, LONG, LANES = 4, 12, 6

# Letters of other scripts that look like the Latin letter before them, and what digits stand for.
LOOKALIKES = {
    "a": "аαɑ", "b": "ьвβ", "c": "сϲ", "d": "ԁ", "e": "еεє", "g": "ɡ", "h": "һн", "i": "іιɩ", "j": "ј", "k": "кκ",
    "m": "м", "n": "пη", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ",
    "y": "уγ", "z": "ᴢ",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
_SIGNS = re.compile(r"(?<=[a-z])[@$](?=[a-z])")


def folding() -> dict[int, str | int]:
    """Translation table of :func:`fold`, from the lists above and the decompositions of Latin letters."""
    table: dict[int, str | int] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D7D0)):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= base <= "z":
            table[code] = base
    for plain, others in LOOKALIKES.items():
        for other in others:
            table[ord(other)] = plain
            table[ord(other.upper())] = plain
    for code in range(65, 91):
        table[code] = chr(code + 32)
    for digit, plain in DIGITS.items():
        table[ord(digit)] = table[0xFF10 + int(digit)] = plain
    for code in range(128):
        if not chr(code).isalnum() and chr(code) not in "@$":
            table[code] = " "
    for code, plain in list(table.items()):
        if plain == "l":
            table[code] = "i"
    table[ord("l")] = "i"
    return table


def fold(text: str | None, table: dict) -> list[str]:
    """The folded words of a text."""
    plain = (text or "").translate(table)
    if "@" in plain or "$" in plain:
        plain = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", plain).replace("@", " ").replace("$", " ")
    return plain.split()


def terms_of(words: list[str]) -> set[str]:
    """Whole words (with a blank behind) and beginnings."""
    found = set()
    for word in set(words):
        if len(word) <= 40:
            found.add(word + " ")
        found.update(word[:n] for n in range(SHORT, min(len(word), LONG) + 1))
    return found


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHasher()
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            grams, rows, _ = shingles(data, offsets, hasher, 3)
            some, first = np.unique(rows, return_index=True)
            lanes = np.zeros((LANES, part.num_rows), np.int64)
            for i in range(LANES if len(some) else 0):
                lanes[i, some] = np.minimum.reduceat(mix(grams + U64(i + 1)), first).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), *(pa.array(x) for x in lanes)], ["doc_id", "label", *(f"l{i}" for i in range(LANES))]
            )


def without_copies(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of one document of each group of near copies."""
    names = [f"l{i}" for i in range(LANES)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    left = rows.mapInArrow(_lanes, f"doc_id {kind}, label int, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        left = left.groupBy("label", name).agg(F.min(F.struct("doc_id", *(n for n in names if n != name))).alias("r")).select("label", name, "r.*")
    return rows.join(left.select("doc_id"), "doc_id", "left_semi")


def _term_counts(only: frozenset | None):
    """Documents that have each term, by label; from toxic documents only if ``only`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = folding(), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                if only is None and not label:
                    continue
                found = terms_of(fold(text, table))
                counts[label].update(found if only is None else found & only)
        names = sorted(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts)], ["term", "clean", "toxic"]
            )

    return run


class Lexicon:
    """Terms with weights, and exception phrases (folded words)."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.weights, self.exceptions = weights, set(exceptions)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(" " + term, (len(term) + 1, weight, term))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        if len(machine):
            machine.make_automaton()
        return machine

    @staticmethod
    def matches(machine, words: list[str]) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and term of the matches outside exceptions."""
        if not len(machine) or not words:
            return []
        text = f" {' '.join(words)} "
        found, excused = [], []
        for end, (size, weight, term) in machine.iter(text):
            if weight is None:
                excused.append((end + 1 - size, end + 1))
            else:
                found.append((end + 1 - size, end + 1, weight, term))
        if excused:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in excused)]
        return found


def select(counts: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """The lexicon from (term, clean documents, toxic documents)."""
    toxic = {t: x for t, _, x in counts}
    weight = {
        t: float(np.log((x + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))) for t, c, x in counts if x >= LEAST
    }
    base = n_toxic / (n_toxic + n_clean)
    evidence = {t: x * np.log(x / (x + c) / base) + (c * np.log(c / (x + c) / (1 - base)) if c else 0.0) for t, c, x in counts if x}
    weight = {t: w for t, w in weight.items() if w >= WEIGHT and evidence[t] >= EVIDENCE}
    # the longest of terms found in the same documents
    explained = set()
    for term in weight:
        for n in range(SHORT, len(term)):
            if term[:n] in weight and toxic[term] >= 0.9 * toxic[term[:n]] and weight[term] >= weight[term[:n]] - 0.2:
                explained.add(term[:n])
    weight = {t: w for t, w in weight.items() if t not in explained}
    covered = {t for t, w in weight.items() if any(weight.get(t[:n], -9.0) >= w - 0.5 for n in range(SHORT, len(t)))}
    return {t: w for t, w in weight.items() if t not in covered}


def _phrase_counts(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, machine, counts = folding(), lexicon.automaton(), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = fold(text, table)
                found = lexicon.matches(machine, words)
                if not found:
                    continue
                begins = {m[0] for m in found}
                at, phrases = 0, set()
                for i, word in enumerate(words):
                    if at in begins:
                        if i:
                            phrases.add(f"{words[i - 1]} {word}")
                        if i + 1 < len(words):
                            phrases.add(f"{word} {words[i + 1]}")
                    at += len(word) + 1
                counts[label].update(phrases)
        names = sorted(counts[0])  # only phrases of clean documents can be exceptions
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], ["phrase", "clean", "toxic"]
        )

    return run


def _amounts(lexicon: Lexicon, curve: tuple[float, float] | None, threshold: float):
    """Matched weight for a hundred words; or the score and prediction if ``curve`` is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, machine = folding(), lexicon.automaton()
        for batch in batches:
            amounts = []
            for text in batch.column("text"):
                words = fold(text.as_py(), table)
                total = sum(m[2] for m in lexicon.matches(machine, words))
                amounts.append(np.log1p(100 * total / max(len(words), 1)))
            amounts = np.array(amounts, float)
            if curve is None:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(amounts)], ["label", "amount"])
            else:
                score = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * amounts, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return run


def fit_curve(amounts: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature with a small ridge, by Newton steps; both labels count the same."""
    x = np.stack([np.ones(len(amounts)), amounts], axis=1)
    y = labels.astype(float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, ridge = np.zeros(2), 1e-3 * len(y) * np.eye(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, tuple[float, float]]:
    """Lexicon and curve, from the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pin(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"))
    rows = pin(without_copies(rows))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon({}), (30.0 if n_toxic else -30.0, 0.0)
    schema = "term string, clean long, toxic long"
    first = rows.where("label = 1").mapInArrow(_term_counts(None), schema).groupBy("term").agg(F.sum("toxic").alias("n"))
    names = first.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "term").limit(CANDIDATES).select("term").collect()
    only = frozenset(r.term for r in names)
    counts = rows.mapInArrow(_term_counts(only), schema).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = Lexicon(select([tuple(r) for r in counts.collect()], n_clean, n_toxic))
    phrases = rows.mapInArrow(_phrase_counts(lexicon), "phrase string, clean long, toxic long").groupBy("phrase").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    excused = phrases.where(f"clean + toxic >= {LEAST} and clean > toxic").orderBy(F.desc("clean"), "phrase").limit(CANDIDATES)
    lexicon.exceptions = {r.phrase for r in excused.collect()}
    table = rows.mapInArrow(_amounts(lexicon, None, 0), "label int, amount double").toPandas()
    return lexicon, fit_curve(table.amount.to_numpy(), table.label.to_numpy())


def score(documents: DataFrame, lexicon: Lexicon, curve: tuple[float, float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_amounts(lexicon, curve, threshold), f"doc_id {kind}, score double, predicted int")


def report(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    found = score(documents, *fit(documents, labels, sample))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
