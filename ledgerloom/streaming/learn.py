"""Learning that follows a stream of corrections.

Two ways: ``collect_corrections`` appends to a log that ``learn_from_log`` reads as a
whole. ``count_corrections`` keeps state instead: the value that counts for each
(invoice, field), and changes of the number of times a value is entered for a field. What is
learned is read from the counts, and the log never again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerloom.operators.corrections import upsert_corrections
from ledgerloom.operators.learning import learn, modal_values


def collect_corrections(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch, reduced to one row per invoice and field."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_corrections(batch).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def learn_from_log(spark: SparkSession, log: str, item_corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and terms from everything logged so far, latest correction per field."""
    corrections = upsert_corrections(spark.read.option("basePath", log).parquet(log).drop("batch"))
    return learn(corrections, item_corrections)


#: The correction that counts for an invoice and field; changes of the count of a value.
CURRENT = "invoice_id BIGINT, field STRING, id BIGINT, corrected_value STRING, corrected_at TIMESTAMP_NTZ, bucket INT"
DELTAS = "field STRING, corrected_value STRING, id BIGINT, n BIGINT"
#: Hash buckets of (invoice, field): a batch reads and writes those it has corrections of.
BUCKETS = 64


def _finished(spark: SparkSession, state: str) -> int:
    try:
        return spark.read.schema("batch BIGINT").parquet(f"{state}/done").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1


def _current(spark: SparkSession, state: str, before: int, buckets: list[int]) -> DataFrame:
    """The corrections that count after the batches before ``before``, in some buckets: of each bucket its newest file."""
    try:
        rows = spark.read.schema(f"{CURRENT}, batch BIGINT").parquet(f"{state}/current")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CURRENT)
    rows = rows.where((F.col("batch") < before) & F.col("bucket").isin(buckets))
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["bucket", "batch"], "left_semi").drop("batch")


def apply_corrections(batch: DataFrame, state: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Fold a batch of header corrections into the state; a batch that comes again replaces what it wrote."""
    spark = batch.sparkSession
    fresh = upsert_corrections(batch).select("invoice_id", "field", "id", "corrected_value", "corrected_at")
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("invoice_id", "field"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        old = _current(spark, state, batch_id, touched)
        both = old.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
        last = F.max_by(F.struct("id", "corrected_value", "corrected_at", "_side"), F.struct("corrected_at", "id"))
        was = F.max(F.when(F.col("_side") == 0, F.struct("id", "corrected_value")))
        merged = both.groupBy("bucket", "invoice_id", "field").agg(last.alias("_last"), was.alias("_was"))
        now = merged.select("invoice_id", "field", "_last.id", "_last.corrected_value", "_last.corrected_at", "bucket")
        now.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/current/batch={batch_id}")
        # What counts now comes, what counted before goes.
        changed = merged.where("_last._side = 1").select("field", F.inline(F.array_compact(F.array(
            F.struct(F.col("_last.corrected_value").alias("corrected_value"), F.col("_last.id").alias("id"), F.lit(1).cast("long").alias("n")),
            F.when(F.col("_was").isNotNull(), F.struct(F.col("_was.corrected_value"), F.col("_was.id"), F.lit(-1).cast("long").alias("n"))),
        ))))
        changed.write.mode("overwrite").parquet(f"{state}/deltas/batch={batch_id}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{state}/done/batch={batch_id}")
    finally:
        fresh.unpersist()


def count_corrections(stream: DataFrame, state: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the learning state up to date with a stream of header corrections."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: apply_corrections(batch, state, batch_id, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_values(spark: SparkSession, state: str) -> DataFrame:
    """How often each value counts for each field, and when it was first entered among those: field, corrected_value, times, first_id."""
    rows = spark.read.schema(f"{DELTAS}, batch BIGINT").parquet(f"{state}/deltas").where(F.col("batch") <= _finished(spark, state))
    # An entry that came and went leaves nothing.
    left = rows.groupBy("field", "corrected_value", "id").agg(F.sum("n").alias("n")).where("n <> 0")
    return left.groupBy("field", "corrected_value").agg(F.sum("n").alias("times"), F.min("id").alias("first_id"))


def learned_values(spark: SparkSession, state: str) -> DataFrame:
    """The most frequent value of each field, as ``learning.frequent_values`` gives it for the whole log."""
    return modal_values(counted_values(spark, state))
