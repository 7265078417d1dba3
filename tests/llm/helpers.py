"""Small tables and plain-Python versions shared by the tests of the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, node string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, ids=None, partitions=3):
    """Texts as documents, with columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)
