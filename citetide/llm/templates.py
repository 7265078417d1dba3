"""Line dedup by a tree of log templates, in DataFrame expressions only.

A line falls into a leaf of a tree of fixed depth: by its number of blanks (the token count), then by its first
``LEADING`` tokens. Tokens that hold a digit are variable from the start. In a leaf that at least ``min_docs``
different texts reach, a token is a fixed field of its position if lines of ``min_docs`` (text, line) pairs have
it there, and a variable field otherwise. The template of a line is its tokens with ``<*>`` for variable fields.
A template recurs if at least half of its fields are fixed words and lines of at least ``min_docs`` different
texts have it. Lines of recurring templates are dropped from every document.

A line whose every field repeats as it is needs no generalising, digits or not: one that stands in ``min_docs``
different texts recurs by itself and is dropped from all. One of ``LONG`` or more characters recurs from two texts on;
as two texts may be versions of one another, it stays in the text with the smallest key and is dropped from the others
(from all, if it or its template stands in ``min_docs``). Only shorter lines in fewer texts stay everywhere.

Copies of a whole text count once, so that copying does not make a text's own lines templates. Blank lines are
never dropped. A null text stays null, an empty one empty; a text whose every line is dropped becomes empty.
Repeated rows are treated alike. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.session import pin, unpin

from .rows import fresh

#: Documents from which on a short line or a template recurs, and leading tokens that lead to a leaf.
MIN_DOCS, LEADING = 10, 3
#: Characters from which on a line recurs in two documents.
LONG = 40
WILD = "<*>"
#: A token with a digit, looked for at the beginning of a token only and without going back.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def lines_of(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def key_of(text: str) -> Column:
    """60 bits of the text's MD5 as a long. Texts with equal keys would only share which recurring lines they lose."""
    return F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long")


def leaf_of(line: str) -> Column:
    """The leaf as a string: token count and masked leading tokens."""
    blanks = F.length(line) - F.length(F.replace(F.col(line), F.lit(" "), F.lit("")))
    leading = F.regexp_replace(F.substring_index(F.col(line), " ", LEADING), _VARIABLE, WILD)
    return F.concat_ws(" ", blanks.cast("string"), leading)


def marks_of(lines: DataFrame, long: int = LONG) -> DataFrame:
    """``text_key``, ``leaf`` and, of long lines, two hashes ``line_key`` and ``other_key``; ``lines`` has ``text_key``,
    ``line`` and ``leaf``."""
    of_long = {name: F.when(F.length("line") >= long, key) for name, key in (("line_key", F.xxhash64("line")), ("other_key", F.xxhash64(F.lit(1), "line")))}
    return lines.select("text_key", "leaf", *(key.alias(name) for name, key in of_long.items()))


def repeated_lines(marks: DataFrame) -> DataFrame:
    """``text_key`` and ``line_key`` of long lines that also stand in a text with a smaller key."""
    keys = marks.where("line_key is not null").drop("leaf")
    # the smallest and largest key tell a line of one text from a line of several, without a list of its texts
    seen = keys.groupBy("line_key", "other_key").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last"))
    several = pin(seen.where("first < last").select("line_key", "other_key", "first"))
    return keys.join(several, ["line_key", "other_key"]).where("text_key > first").select("text_key", "line_key")


def recurring_lines(documents: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG) -> DataFrame:
    """``text_key`` and ``line_key``: the lines that each text loses."""
    texts = documents.select(key_of("text").alias("text_key"), F.explode(lines_of("text")).alias("line")).where("trim(line) != ''")
    lines = texts.withColumn("leaf", F.xxhash64(leaf_of("line")))
    # the texts are split for the marks and for the candidates only; the marks go before the candidates are written
    marks = pin(marks_of(lines, long))
    repeated = pin(repeated_lines(marks))
    reached = marks.groupBy("leaf", "text_key").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = pin(reached.where(F.col("n") >= min_docs).select("leaf"))
    unpin(marks)
    candidates = pin(lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "line", "text_key").agg(F.lit(1).alias("one")).drop("one"))
    distinct = pin(candidates.groupBy("leaf", "line").agg(F.count("*").alias("n")))
    fields = distinct.select(
        "leaf", "line", "n", F.posexplode(F.split(F.regexp_replace("line", _VARIABLE, WILD), " ")).alias("at", "token")
    )
    fixed = fields.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    fixed = fixed.where(F.col("token") != WILD).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    field = F.when(F.col("fixed"), F.col("token")).otherwise(WILD)
    templates = (
        fields.join(fixed, ["leaf", "at", "token"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", field.alias("field")))).alias("fields"),
            F.count("fixed").alias("n_fixed"),
        )
        .where(F.col("n_fixed") * 2 >= F.size("fields"))
        .select("leaf", "line", F.xxhash64("leaf", "fields.field").alias("template"))
    )
    templates = pin(templates)
    found = candidates.join(templates, ["leaf", "line"]).groupBy("template", "text_key").agg(F.lit(1).alias("one"))
    recurring = found.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    dropped = templates.join(recurring, "template", "left_semi").select("leaf", "line")
    alone = distinct.where(F.col("n") >= min_docs).select("leaf", "line")
    gone = candidates.join(dropped.unionByName(alone), ["leaf", "line"], "left_semi").select("text_key", F.xxhash64("line").alias("line_key"))
    return gone.unionByName(repeated)


def drop_templates(documents: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG) -> DataFrame:
    """The documents without the lines that recur, and columns ``n_lines`` and ``n_dropped`` (with
    underscores in front where ``documents`` has such columns)."""
    key, drop, old, kept, lines, dropped = (
        fresh(documents, name) for name in ("text_key", "drop", "old_lines", "kept_lines", "n_lines", "n_dropped")
    )
    gone = (
        recurring_lines(documents, min_docs, long)
        .groupBy(F.col("text_key").alias(key))
        .agg(F.collect_set("line_key").alias(drop))
    )
    joined = documents.withColumn(key, key_of("text")).join(gone, key, "left")
    split = joined.withColumn(old, lines_of("text")).withColumn(
        kept, F.when(F.col(drop).isNull(), F.col(old)).otherwise(F.filter(old, lambda x: ~F.array_contains(drop, F.xxhash64(x))))
    )
    others = [F.col(f"`{c}`") for c in documents.columns if c.lower() != "text"]
    n_lines = F.coalesce(F.size(old), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size(kept)).cast("long")
    return split.select(
        *others,
        F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n_lines.alias(lines),
        (n_lines - n_kept).alias(dropped),
    )
