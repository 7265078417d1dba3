"""Yearly citation counts kept up to date from batches of newly arrived dates.

A store folder holds, per batch, the latest year the batch gives each paper and the change it makes to the counts.
A paper counts in the latest year that any batch up to then names, so a batch that dates a paper later takes its
citations out of the old year and puts them into the new one. The counts are the sum of all changes.

A batch is written by replacing its own partition, and its change depends on the batches before it only. So running
a batch again, after a failure or by mistake, changes nothing, and the counts equal a count over all dates at once.
If the dates of an old batch are corrected, the batches after it must be run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citetide.operators.dedupe import one_year_per_pub
from citetide.plans.citations import GENE

DATES, CHANGES = "pmid bigint, year int, batch bigint", "tax_id int, gene_id bigint, year int, citations bigint, batch bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace(df: DataFrame, path: str, batch: int) -> None:
    """Write the batch's own partition; an empty batch empties it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def changed_years(dates: DataFrame, before: DataFrame) -> DataFrame:
    """``pmid, year, sign``: years that papers gain (1) and lose (-1) through ``dates``, given their years ``before``."""
    new = one_year_per_pub(dates.filter(F.col("pmid").isNotNull() & F.col("year").isNotNull()))
    old = before.groupBy("pmid").agg(F.max("year").alias("was"))
    moved = new.join(old, "pmid", "left").filter(F.col("was").isNull() | (F.col("year") > F.col("was")))
    steps = F.filter(
        F.array(F.struct(F.col("year"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("year"), F.lit(-1).alias("sign"))),
        lambda step: step["year"].isNotNull(),
    )
    return moved.select("pmid", F.inline(steps))


def add_batch(gene2pubmed: DataFrame, dates: DataFrame, store: str, batch: int) -> None:
    """Take the dates (``pmid``, ``year``) of batch number ``batch`` into the store.

    Only papers whose year changes meet the citations. The change is written first: a run that fails in between is
    repeated as a whole and finds the same earlier batches.
    """
    spark = dates.sparkSession
    before = _read(spark, f"{store}/dates", DATES).filter(F.col("batch") < batch)
    steps = changed_years(dates, before)
    rows = gene2pubmed.select(*GENE, "pmid").join(steps, "pmid")
    changes = rows.groupBy(*GENE, "year").agg(F.sum("sign").cast("bigint").alias("citations"))
    _replace(changes.filter("citations <> 0"), f"{store}/changes", batch)
    own = one_year_per_pub(dates.filter(F.col("pmid").isNotNull() & F.col("year").isNotNull()))
    _replace(own.select("pmid", F.col("year").cast("int").alias("year")), f"{store}/dates", batch)


def current_counts(spark: SparkSession, store: str) -> DataFrame:
    """``tax_id, gene_id, year, citations`` after all batches so far, as ``citations.citation_counts`` gives them."""
    changes = _read(spark, f"{store}/changes", CHANGES)
    return changes.groupBy(*GENE, "year").agg(F.sum("citations").alias("citations")).filter("citations <> 0")


def follow(gene2pubmed: DataFrame, dates: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Take every batch of a stream of dates into the store, then stop; the stream numbers the batches, so one that is
    delivered twice replaces itself."""

    def take(rows: DataFrame, number: int) -> None:
        add_batch(gene2pubmed, rows, store, number)

    writer = dates.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
