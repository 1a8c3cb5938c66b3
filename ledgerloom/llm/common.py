"""Shared by the operators of this subpackage: sizes, identities and staged tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import work_dir

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: later jobs, and jobs repeated after an executor was lost,
    read the files instead of computing the rows again.
    """
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs without white space; null counts 0. Linear: each word becomes one mark, and marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]++", "x")
    return F.length(F.translate(marks, " \t\n\v\f\r", "")).cast("long")


def digest_number(*parts: Column, digits: int) -> Column:
    """A number of so many hexadecimal digits from the MD5 of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def keeps_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function of a table: columns that begin with an underscore pass it by, as its own names do so."""

    @functools.wraps(work)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        hidden = {c: f"own{i}{c}" for i, c in enumerate(df.columns) if c.startswith("_")}
        out = work(df.withColumnsRenamed(hidden), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in hidden.items()})

    return run
