"""File listings of an inbox folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import ends_with_any
from ledgerloom.vocab import ATTACHMENT_SUFFIXES


def inbox_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep documents and archives; the suffix test ignores case."""
    return files.where(ends_with_any(F.col(path_col), ATTACHMENT_SUFFIXES))


def stream_inbox(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """The inbox as a stream: each file once, by the state in the query's checkpoint.

    With ``archive`` (a folder outside the inbox) files are moved there after their batch
    is committed. The suffix test is part of the listing and ignores case.
    """
    suffixes = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in ATTACHMENT_SUFFIXES)
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    reader = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", f"*{{{suffixes}}}")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select("path", "length", "modificationTime")


def scan_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """List an inbox without reading file contents (the content column is pruned)."""
    files = spark.read.format("binaryFile").load(folder)
    return inbox_files(files.select("path", "length", "modificationTime"))
