"""Selecting messages and attachments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_any, ends_with_any
from ledgerloom.vocab import ATTACHMENT_SUFFIXES, NEWEST_PER_MAILBOX, RELEVANT_TERMS


LEDGER = "mailbox STRING, uid BIGINT"


def relevant(messages: DataFrame) -> DataFrame:
    """Messages whose body or subject mentions an invoice term."""
    def hit(c: str):
        return contains_any(F.lower(F.coalesce(c, F.lit(""))), RELEVANT_TERMS)

    return messages.where(hit("subject") | hit("body"))


def explode_attachments(messages: DataFrame) -> DataFrame:
    """One row per document or archive attachment; messages without any vanish."""
    kept = F.filter("attachments", lambda a: ends_with_any(a, ATTACHMENT_SUFFIXES))
    return messages.withColumn("attachment", F.explode(kept)).drop("attachments")


def newest_per_mailbox(messages: DataFrame, n: int = NEWEST_PER_MAILBOX) -> DataFrame:
    """The newest messages of each mailbox; a uid is unique within its mailbox.

    Only mailbox and uid are ranked, so no message body is sorted. Spark limits
    each mailbox to n rows per map task before the shuffle, so a mailbox with
    most of the messages does not end up whole in one task. The few keys left
    then select the messages.
    """
    rank = F.row_number().over(Window.partitionBy("mailbox").orderBy(F.col("uid").desc()))
    keys = messages.select("mailbox", "uid").withColumn("_rank", rank).where(F.col("_rank") <= n)
    return messages.join(keys.drop("_rank"), ["mailbox", "uid"], "left_semi")


def unprocessed(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages that are not in the ledger; it may hold repeats."""
    return messages.join(ledger.select("mailbox", "uid").distinct(), ["mailbox", "uid"], "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger (mailbox, uid) with all that was appended; empty before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def append_ledger(messages: DataFrame, path: str) -> None:
    """Add messages to the ledger. A run repeated after a failure may add them twice; readers take them once."""
    messages.select(F.col("mailbox").cast("string"), F.col("uid").cast("long")).write.mode("append").parquet(path)


def select_messages(messages: DataFrame, ledger: DataFrame, n: int = NEWEST_PER_MAILBOX) -> DataFrame:
    """The mail stage: newest first, then unseen, then relevant, then attachments."""
    return explode_attachments(relevant(unprocessed(newest_per_mailbox(messages, n), ledger)))
