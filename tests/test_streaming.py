import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.store import latest_per_key, upsert
from ledgerloom.session import work_dir, work_root
from ledgerloom.streaming import dedup, ingest

SCHEMA = "seq BIGINT, file_path STRING, total DOUBLE"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, src, base):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.append_log(stream, f"{base}/log", f"{base}/check", lambda b: b, F.col("total").isNotNull()).awaitTermination()
    return ingest.current(spark, f"{base}/log", "file_path", ["seq"])


def test_stream_equals_batch_and_restart_reads_only_new_files(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path)
    one = [(1, "a", 1.0), (2, "b", 2.0), (3, "b", None)]
    two = [(4, "a", 4.0), (5, "c", 5.0)]
    put(spark, src, "one", one)
    run(spark, src, base)
    put(spark, src, "two", two)
    got = run(spark, src, base)
    batch = latest_per_key(spark.createDataFrame([r for r in one + two if r[2]], SCHEMA), "file_path", ["seq"])
    assert sorted(map(tuple, got.select("seq", "file_path", "total").collect())) == sorted(map(tuple, batch.select("seq", "file_path", "total").collect()))
    assert [r.seq for r in ingest.failed(spark, f"{base}/log").collect()] == [3]
    assert spark.read.parquet(f"{base}/log").count() == 5
    snapshot = spark.createDataFrame([(1, "a", 0.0), (2, "z", 9.0)], "id BIGINT, file_path STRING, total DOUBLE")
    folded = ingest.fold_log(spark, snapshot, f"{base}/log", f"{base}/next")
    assert {(r.file_path, r.total) for r in folded.collect()} == {("a", 4.0), ("b", 2.0), ("c", 5.0), ("z", 9.0)}
    assert {r.id for r in folded.where("file_path IN ('a', 'z')").collect()} == {1, 2}


@pytest.mark.parametrize("salts", [1, 4])
def test_dedup_survives_restart(spark, tmp_path, salts):
    src, base = str(tmp_path / "src"), str(tmp_path)

    def drain():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(src).select("file_path", "seq")
        dedup.to_files(dedup.first_seen(stream, ["file_path", "seq"], salts=salts), f"{base}/out", f"{base}/check").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{base}/out").select("file_path", "seq").collect()))

    put(spark, src, "one", [(1, "a", 1.0)] * 50 + [(2, "a", 1.0)])
    assert drain() == [("a", 1), ("a", 2)]
    put(spark, src, "two", [(1, "a", 1.0), (3, "a", 1.0)])
    assert drain() == [("a", 1), ("a", 2), ("a", 3)]


def test_work_folder(spark):
    root = work_root(spark)
    assert work_dir(spark, "x").startswith(root) and work_dir(spark, "x") != work_dir(spark, "x")
