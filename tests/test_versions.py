"""The versioned store: partitions, unfinished versions, identities of items, folds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import corrections as corr, documents
from ledgerloom.sources import versions
from ledgerloom.sources.snapshots import empty
from ledgerloom.streaming import ingest

ITEM = "invoice_id BIGINT, seq BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE"
LOG = "id BIGINT, invoice_id BIGINT, kind STRING, original_item_id BIGINT, field STRING, original_value STRING, corrected_value STRING"


def batch(spark, rows):
    records = spark.createDataFrame(rows, "seq BIGINT, file_path STRING, invoice_number STRING, total_amount DOUBLE, raw_text STRING")
    items = records.select("file_path", "seq", F.lit(1).alias("line_no"), F.concat(F.lit("of "), "invoice_number").alias("description"),
                           F.lit(1.0).alias("quantity"), F.lit(2.0).alias("unit_price"), F.lit(2.0).alias("line_total"))
    return records, items


@pytest.fixture
def logs(spark):
    return spark.createDataFrame([], "id BIGINT, email STRING"), empty(spark, "field_corrections"), empty(spark, "item_corrections")


def invoices(spark, version):
    return {r.file_path: (r.id, r.invoice_number) for r in versions.read(spark, version, "invoices", documents.INVOICES).collect()}


def test_only_touched_partitions_are_read_and_written(spark, tmp_path, logs):
    store = str(tmp_path)
    first = documents.commit_batch(spark, store, *batch(spark, [(i, f"f/{i}", f"N{i}", 1.0, "t") for i in range(1, 41)]), *logs, parts=8)
    second = documents.commit_batch(spark, store, *batch(spark, [(1, "f/7", "M", 1.0, "u")]), *logs, parts=8)
    (part,) = [r.p for r in spark.createDataFrame([("f/7",)], "k STRING").select(versions.part_of(F.col("k"), 8).alias("p")).collect()]
    for name in ("invoices", "items", "texts"):
        folder = {v.number: {r.part: r.folder for r in v.rows if r.name == name and r.part >= 0} for v in (first, second)}
        assert {p for p in folder[1] if folder[1][p] != folder[2][p]} == {part}
    files = versions.read(spark, first, "invoices", documents.INVOICES, [part]).inputFiles()
    assert files and all(f"/part={part}/" in f for f in files)
    got = invoices(spark, second)
    assert got["f/7"] == (7, "M") and len(got) == 40
    texts = {r.file_path: r.raw_text for r in versions.read(spark, second, "texts", documents.TEXTS).collect()}
    assert texts["f/7"] == "u" and len(texts) == 40
    # a new document gets an id above all that were given, though its partition is all that was read
    third = documents.commit_batch(spark, store, *batch(spark, [(1, "new", "X", 1.0, "v")]), *logs, parts=8)
    assert invoices(spark, third)["new"] == (41, "X")
    ids = [r.id for r in versions.read(spark, third, "items", documents.ITEMS).collect()]
    assert len(ids) == len(set(ids)) == 41


def test_unfinished_versions_are_invisible(spark, tmp_path, logs):
    store = str(tmp_path)
    assert versions.latest(spark, store).number == 0
    one = documents.commit_batch(spark, store, *batch(spark, [(1, "a", "A", 1.0, "t")]), *logs)
    (tmp_path / "manifests" / "version=2" / "_temporary").mkdir(parents=True)
    assert versions.latest(spark, store) == one
    assert documents.commit_batch(spark, store, *batch(spark, []), *logs) == one
    two = documents.commit_batch(spark, store, *batch(spark, [(2, "b", "B", 1.0, "t")]), *logs)
    assert two.number == 2 and set(invoices(spark, two)) == {"a", "b"}


def test_folds_read_new_batches_only_and_replay(spark, tmp_path, logs):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    ingest.write_documents(*batch(spark, [(1, "a", "A", 1.0, "t"), (2, "b", "B", 1.0, "t")]), log, 0)
    ingest.write_documents(*batch(spark, [(1, "a", "A", 1.0, "t"), (2, "b", "B", 1.0, "t")]), log, 0)
    first = ingest.fold_documents(spark, log, store, *logs)
    assert first.mark == 0 and invoices(spark, first) == {"a": (1, "A"), "b": (2, "B")}
    assert ingest.fold_documents(spark, log, store, *logs) == first
    (item,) = versions.read(spark, first, "items", documents.ITEMS).where("invoice_id = 1").collect()
    at = dt.datetime(2025, 1, 1)
    header = spark.createDataFrame([(1, 1, "total_amount", "1.0", "7,5", at), (2, 2, "total_amount", "1.0", "9", at)], empty(spark, "field_corrections").schema)
    items = spark.createDataFrame([(1, 1, item.id, "update", "quantity", "1.0", "4", at)], empty(spark, "item_corrections").schema)
    ingest.write_documents(*batch(spark, [(3, "a", "A", 1.0, "t"), (4, "a", "A", 2.0, "t"), (5, "c", "C", 1.0, "t")]), log, 1)
    for name in ("headers", "items"):  # begun, not done
        spark.read.parquet(f"{log}/{name}/batch=1").write.parquet(f"{log}/{name}/batch=2")
    second = ingest.fold_documents(spark, log, store, logs[0], header, items)
    assert second.mark == 1
    totals = {r.file_path: r.total_amount for r in versions.read(spark, second, "invoices", documents.INVOICES).collect()}
    assert totals == {"a": 7.5, "b": 1.0, "c": 1.0}
    kept = {r.invoice_id: (r.id, r.quantity) for r in versions.read(spark, second, "items", documents.ITEMS).collect()}
    assert kept[1] == (item.id, 4.0) and len(kept) == 3


def test_identities(spark, monkeypatch):
    """Equal signatures match in order; corrected values are traced back; null parts are equal; runs do not matter."""
    monkeypatch.setattr(corr, "RUN", 3)
    old = [(10 + i, 1, "A", 1.0, 2.0, None) for i in range(8)] + [(30, 1, "B", 5.0, None, 9.0), (40, 2, "A", 1.0, 2.0, None)]
    stored = spark.createDataFrame(old, "id BIGINT, invoice_id BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE")
    log = spark.createDataFrame([
        (1, 1, "update", 30, "quantity", "3.0", "4"), (2, 1, "update", 30, "quantity", "4.0", "5"), (3, 1, "actualizar", 30, "line_total", None, "9"),
        (4, 1, "update", 10, "x", "{}", "{}"),
    ], LOG)
    assert [tuple(r)[1:] for r in corr.as_extracted(stored, log).where("id = 30").collect()] == [(1, "B", 3.0, None, None)]
    fresh = spark.createDataFrame([(1, s, " a ", 1.0, 2.0, 7.0) for s in range(1, 11)] + [(1, 11, "b", 3.0, None, None), (2, 1, "new", 1.0, 1.0, 1.0)], ITEM)
    got = {(r.invoice_id, r.seq): r.id for r in corr.match_identities(corr.as_extracted(stored, log), fresh).collect()}
    assert got == {**{(1, s): 9 + s for s in range(1, 9)}, (1, 9): None, (1, 10): None, (1, 11): 30, (2, 1): None}
    replayed = {(r.invoice_id, r.description): (r.id, r.quantity, r.line_total) for r in corr.replay_on_extracted(stored, fresh, log).collect()}
    assert replayed[(1, "b")] == (30, 5.0, 9.0) and replayed[(2, "new")] == (None, 1.0, 1.0)


def test_hot_group_is_numbered_in_runs(spark):
    rows = spark.range(200_000).selectExpr("id", "IF(id % 3 = 0, 'hot', string(id)) AS g")
    got = corr.numbered_within(rows, ["g"], "id").where("g = 'hot'").agg(F.count("*"), F.max("_nth"), F.count_distinct("_nth")).first()
    assert set(got) == {66_667}


def test_repeated_right_sides(spark):
    from ledgerloom.operators.combine import overlay_metadata
    from ledgerloom.operators.store import attach_user

    invoices_ = spark.createDataFrame([(1, "u@x")], "id BIGINT, customer_email STRING")
    users = spark.createDataFrame([(9, "u@x"), (7, "u@x")], "id BIGINT, email STRING")
    assert [r.user_id for r in attach_user(invoices_, users).collect()] == [7]
    meta = spark.createDataFrame([(1, "a", None), (1, "b", "s")], "id BIGINT, sender STRING, subject STRING")
    assert [tuple(r) for r in overlay_metadata(invoices_, meta, ["id"]).collect()] == [(1, "u@x", "b", "s")]


def test_first_items_meet_no_identities(spark):
    own = "id BIGINT, invoice_id BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE"
    none = spark.createDataFrame([], own)
    changed = spark.createDataFrame([(1, "a")], "invoice_id BIGINT, file_path STRING")
    rows = [("a", 1, "A", 1.0, 2.0, 2.0), ("a", 2, " a ", 1.0, 2.0, 7.0), ("a", None, "N", 1.0, 1.0, 1.0), ("a", 3, None, None, 3.0, 3.0), ("z", 1, "Z", 1.0, 1.0, 1.0)]
    records = spark.createDataFrame(rows, "file_path STRING, line_no INT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE")
    log = spark.createDataFrame([(1, 1, "add", None, None, None, '{"description":"E","quantity":1,"unit_price":1,"line_total":1}')], LOG)
    first = documents.replaced_items(none, changed, records, log, none_stored=True)
    matched = documents.replaced_items(none, changed, records, log)
    assert sorted(map(str, first.collect())) == sorted(map(str, matched.select(*first.columns).collect()))
    assert first.count() == 3 and "Window" not in first._jdf.queryExecution().optimizedPlan().toString()
