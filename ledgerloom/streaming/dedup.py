"""Never process a message twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(
    stream: DataFrame,
    keys: list[str],
    event_time: str | None = None,
    within: str = "7 days",
    salts: int = 1,
) -> DataFrame:
    """Drop repeats of a key.

    With an event time, keys are forgotten once the watermark passes them and
    the state stays bounded. Without one every key is remembered.

    All rows of a key go to one task. If one key may be repeated very often, use
    several ``salts``: repeats are then dropped in that many tasks first, at the
    price of a second state entry per key.
    """
    def drop(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.dropDuplicates(columns) if event_time is None else df.dropDuplicatesWithinWatermark(columns)

    if event_time is not None:
        stream = stream.withWatermark(event_time, within)
    if salts > 1:
        salted = stream.withColumn("_salt", F.spark_partition_id() % salts)
        stream = drop(salted, [*keys, "_salt"]).drop("_salt")
    return drop(stream, keys)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain the stream into a folder and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
