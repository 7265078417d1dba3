"""Secrets in texts: fixed patterns, and dictionary-primed zstandard novelty of strings in sensitive contexts.

Patterns (leftmost, not overlapping within a kind; a span is the whole match; positions count code points):

* ``assign``: a sensitive name, ``:`` or ``=``, and a value of at least 12 characters,
* ``access``: an access key id of at least 18 characters,
* ``hex``: at least 16 small hexadecimal digits.

Novelty: a candidate is a run of ``LEAST`` or more key characters that holds a letter and a digit, begins within
``REACH`` characters after a sensitive word and overlaps no pattern's span. It is compressed together with the text
around it, by a compressor whose dictionary holds the commonest identifiers of all sensitive contexts of the corpus;
what the candidate adds to the compressed size of its surroundings alone is its novelty. Words, paths, names built
from identifiers and repeated placeholders add little; random strings add nearly their information content. A
candidate that adds ``BITS`` or more bits per character is reported as ``novel``.

The dictionary is counted over all documents: distinct contexts are reduced to identifiers and counts on Spark, so
copies of a document count once, and only the ``DICTIONARY_ROWS`` commonest come to the driver. Strings that could be
candidates, whole or cut off, give no identifiers, so no key can make itself common. Null and empty texts hold no secrets; repeated documents are treated
alike; a long text is searched whole; other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import with_fields

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A run that is too short fails as a whole, so the least length can stand in these two patterns.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: Words of which a text must hold one, in small letters, before the two costlier patterns are tried.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE_HINTS = (*ASSIGN_HINTS, "pwd", "key", "credential", "auth", "bearer", "signature", "session")
SENSITIVE = re.compile(
    r"password|passwd|pwd|secret|token|(?:api|access|private|account|encryption|signing)[ _-]?key|credential|auth|bearer|signature|session",
    re.IGNORECASE | re.ASCII,
)
FIRST = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]")
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Runs at the ends of a context, which may be cut off.
ENDS = re.compile(r"^[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]+$")
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")

#: Shortest candidate; how far behind a sensitive word it may begin; characters of context before and behind.
LEAST, REACH, BEFORE, BEHIND = 16, 64, 160, 80
#: Bits per character that a candidate must add: as many as a random character of base64 holds.
BITS = 6.0
#: Identifiers fetched for the dictionary, and bytes of it that are used.
DICTIONARY_ROWS, DICTIONARY_BYTES, LEVEL = 8192, 32 << 10, 12

SECRETS = "array<struct<kind:string,start:bigint,end:bigint,value:string,bits:double>>"


def base_spans(text: str, small: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the patterns' matches, by start and then kind; ``small`` is the text in small letters."""
    found = []
    if any(hint in small for hint in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, small: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Spans of the strings whose novelty is to be measured, in order."""
    if not any(hint in small for hint in SENSITIVE_HINTS):
        return
    done, at = 0, 0
    for word in SENSITIVE.finditer(text):
        for first in FIRST.finditer(text, max(done, word.end()), word.end() + REACH + 1):
            if first.start() < done:
                continue
            begin, done = RUN.match(text, first.start()).span()
            while at < len(taken) and taken[at][1] <= begin:
                at += 1
            # spans of different kinds may overlap, so a few more than the next one are looked at
            overlaps = any(a < done and b > begin for a, b, _ in taken[max(0, at - len(KINDS)) : at + len(KINDS)])
            value = text[begin:done]
            if len(value) >= LEAST and not overlaps and LETTER.search(value) and DIGIT.search(value):
                yield begin, done


class Novelty:
    """Bits per character that a string adds to its compressed surroundings."""

    def __init__(self, identifiers: list[str]):
        """``identifiers``: commonest first. A dictionary's end is its cheapest place, so they are turned round."""
        raw = " ".join(reversed(identifiers)).encode()[-DICTIONARY_BYTES:]
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        if len(raw) >= 8:
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            options["dict_data"] = held
        self.compress = zstandard.ZstdCompressor(**options).compress

    def bits(self, before: str, value: str, behind: str) -> float:
        """A second copy of the value beside it must not hide it."""
        before, behind = before.replace(value, ""), behind.replace(value, "")
        alone = len(self.compress((before + behind).encode()))
        whole = len(self.compress((before + value + behind).encode()))
        return 8.0 * max(0, whole - alone) / len(value)


def find_in(text: str, novelty: Novelty) -> list[dict]:
    """All secrets of a text, by start and then kind."""
    small = text.lower()
    found = [(*span, None) for span in base_spans(text, small)]
    for begin, end in candidates(text, small, [x[:3] for x in found]):
        bits = novelty.bits(text[max(0, begin - BEFORE) : begin], text[begin:end], text[end : end + BEHIND])
        if bits >= BITS:
            found.append((begin, end, "novel", bits))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [{"kind": kind, "start": a, "end": b, "value": text[a:b], "bits": bits} for a, b, kind, bits in found]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of every sensitive word."""
    for batch in batches:
        held = []
        for cell in batch.column("text"):
            text = cell.as_py() or ""
            small = text.lower()
            if any(hint in small for hint in SENSITIVE_HINTS):
                for word in SENSITIVE.finditer(text):
                    held.append(ENDS.sub("", text[max(0, word.start() - BEHIND) : word.end() + REACH]))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["context"])
                        held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["context"])


def identifiers(documents: DataFrame) -> list[str]:
    """The commonest identifiers in the distinct sensitive contexts of all documents, commonest first."""
    contexts = documents.select("text").mapInArrow(_contexts, "context string").distinct()
    plain = F.regexp_replace("context", f"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}", " ")
    words = contexts.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[A-Za-z_]{4,40}"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY_ROWS).collect()]


def find_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``secrets`` of every document: kind, start, end, value and, of ``novel`` ones, bits per character."""
    known = identifiers(documents)
    rows = documents.select("doc_id", "text")
    schema = with_fields(rows.select("doc_id"), f"`secrets` {SECRETS}")
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("bits", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            found = [find_in(cell.as_py() or "", novelty) for cell in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "secrets"])

    return rows.mapInArrow(run, schema)


def _joined(kinds: Column) -> Column:
    """``kind:start:end`` of each secret, with commas between."""
    return F.array_join(F.transform(kinds, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the patterns' spans, and all spans."""
    found = F.col("secrets")
    base = F.filter(found, lambda s: s["kind"] != "novel")
    kinds = F.transform(found, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    rows = find_secrets(documents)
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(found).alias("spans"))
