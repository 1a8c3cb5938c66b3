"""Validation, outcomes and run summaries."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.vocab import REQUIRED_FIELDS


def missing_fields(fields: list[str] = REQUIRED_FIELDS) -> Column:
    """All required fields a record lacks, comma separated in field order."""
    names = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    return F.array_join(F.array_compact(names), ",")


def validate(records: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    return records.withColumn("missing", missing_fields(fields)).withColumn("valid", F.col("missing") == "")


def null_report(records: DataFrame) -> DataFrame:
    """Rows in total and nulls per column, in one pass: which rows cannot be trained on."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in records.columns]
    return records.agg(F.count("*").alias("total"), *nulls)


def with_outcome(records: DataFrame, succeeded: Column) -> DataFrame:
    """Mark each record as processed or error."""
    ok = F.coalesce(succeeded, F.lit(False))
    return records.withColumn("status", F.when(ok, "processed").otherwise("error"))


def write_by_outcome(records: DataFrame, path: str) -> None:
    """Processed and failed records go to separate folders."""
    records.write.mode("errorifexists").partitionBy("status").parquet(path)


def run_summary(records: DataFrame) -> DataFrame:
    """Documents per outcome."""
    return records.groupBy("status").agg(F.count("*").alias("documents"))


#: Counters of runs: the run's name, its batch (null for a batch job), rows by outcome and seconds.
METRICS = "run STRING, batch BIGINT, documents BIGINT, processed BIGINT, errors BIGINT, seconds DOUBLE"


def write_observed(records: DataFrame, path: str, run: str) -> DataFrame:
    """``write_by_outcome``, and the run's counters as a table of one row.

    The counts are taken while the rows are written; nothing is read again.
    """
    counted = Observation(run)
    failed = F.count_if(F.col("status") == "error")
    observed = records.observe(counted, F.count("*").alias("documents"), F.count_if(F.col("status") == "processed").alias("processed"), failed.alias("errors"))
    started = time.monotonic()
    write_by_outcome(observed, path)
    seconds = time.monotonic() - started
    n = counted.get
    row = (run, None, n["documents"], n["processed"], n["errors"], seconds)
    return records.sparkSession.createDataFrame([row], METRICS)


def stream_metrics(spark: SparkSession, query: StreamingQuery, run: str) -> DataFrame:
    """The counters of the latest micro-batches of a stream: the rows that came in, and seconds.

    A stream whose rows are observed under the name ``run`` (documents, processed, errors) gives its outcomes too.
    """
    rows = []
    for progress in query.recentProgress:
        p = json.loads(progress.json)
        seen = p.get("observedMetrics", {}).get(run, {})
        rows.append((run, p["batchId"], seen.get("documents", p["numInputRows"]), seen.get("processed"), seen.get("errors"), p["durationMs"]["triggerExecution"] / 1000))
    return spark.createDataFrame(rows, METRICS)
