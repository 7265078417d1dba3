"""Daily id files arrive one by one; each is read once and appended to the date table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citetide.sources.dates import parse_dates


def stream_daily_dates(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``pmid, year, pub_date`` of all daily files, present and future."""
    lines = (
        spark.readStream.option("pathGlobFilter", "*.ssv")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
    )
    return parse_dates(lines)


def append_daily_dates(dates: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a parquet table partitioned by year, then stop.

    ``checkpoint`` remembers which files are done, so a rerun after a failure neither loses nor repeats
    a file.
    """
    return (
        dates.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .partitionBy("year")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
