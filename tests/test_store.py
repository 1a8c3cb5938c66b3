import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import corrections as corr, learning, store
from ledgerloom.sources import files, json_files, snapshots


@pytest.fixture
def snapshot(spark):
    return spark.createDataFrame([(1, "f/a", "N1", 10.0), (2, "f/b", "N2", 20.0)], "id BIGINT, file_path STRING, invoice_number STRING, total_amount DOUBLE")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(1, "f/b", "old", 1.0), (2, "f/b", None, 21.0), (3, "f/c", "N3", 30.0)], "seq BIGINT, file_path STRING, invoice_number STRING, total_amount DOUBLE")


def test_upsert(snapshot, batch):
    rows = {r.file_path: (r.id, r.invoice_number, r.total_amount, r.action) for r in store.upsert(snapshot, batch).collect()}
    assert rows == {"f/a": (1, "N1", 10.0, "keep"), "f/b": (2, None, 21.0, "update"), "f/c": (5, "N3", 30.0, "insert")}


def test_upsert_twice_changes_nothing(snapshot, batch):
    first = store.upsert(snapshot, batch).drop("action")
    second = store.upsert(first.select(*snapshot.columns), batch).drop("action")
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, second.select(*first.columns).collect()), key=str)


def test_upsert_into_empty(spark, batch):
    empty = spark.createDataFrame([], "id BIGINT, file_path STRING, invoice_number STRING, total_amount DOUBLE")
    assert {r.id for r in store.upsert(empty, batch).collect()} == {2, 3}


def test_header_corrections(spark):
    invoices = spark.createDataFrame([(1, "N", 5.0, dt.date(2024, 1, 1)), (2, "M", 6.0, None)], "id BIGINT, invoice_number STRING, total_amount DOUBLE, due_date DATE")
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([
        (1, 1, "total_amount", "x", "1.234,50", t), (2, 1, "total_amount", "x", "bad", t - dt.timedelta(1)),
        (3, 1, "due_date", None, "31/12/2024, x", t), (4, 2, "invoice_number", None, "NEW", t), (5, 2, "unknown", None, "z", t),
    ], "id BIGINT, invoice_id BIGINT, field STRING, original_value STRING, corrected_value STRING, corrected_at TIMESTAMP_NTZ")
    rows = {r.id: tuple(r)[1:] for r in store.apply_header_corrections(invoices, log).collect()}
    assert rows == {1: ("N", 1234.5, dt.date(2024, 12, 31)), 2: ("NEW", 6.0, None)}
    kept = {(r.invoice_id, r.field): r.corrected_value for r in corr.upsert_corrections(log).collect()}
    assert kept[(1, "total_amount")] == "1.234,50" and len(kept) == 4


def test_items_of_a_hot_invoice(spark):
    invoices = spark.range(3).selectExpr("id", "id * 10 AS total")
    items = spark.range(1000).selectExpr("id", "IF(id < 999, 0L, 1L) AS invoice_id")
    rows = store.with_items(invoices, items).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in rows} == {0: 999, 1: 1, 2: 1}
    assert store.with_items(invoices, items).where("id = 2").first().item_id is None


def test_a_deletion_gives_a_task_few_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS_A_TASK", 500, raising=False)
    tables = {
        "invoices": spark.range(10_000),
        "invoice_items": spark.range(20_000).selectExpr("IF(id < 3, NULL, id % 10000) AS invoice_id", "id AS n"),
        "item_corrections": spark.range(9).selectExpr("IF(id < 5, 1, id) AS invoice_id"),
    }
    doomed = spark.range(10_000).where("id % 2 = 0").selectExpr("inline(array(struct(id AS invoice_id), struct(IF(id = 0, NULL, id) AS invoice_id)))")
    left = store.cascade_delete(tables, doomed)
    assert sorted(r.id for r in left["invoices"].collect()) == list(range(1, 10_000, 2))
    items = [(r.invoice_id, r.n) for r in left["invoice_items"].collect()]
    assert sorted(n for i, n in items if i is None) == [0, 1, 2]
    assert sorted(n for i, n in items if i is not None) == [n for n in range(3, 20_000) if n % 2]
    assert sorted(r.invoice_id for r in left["item_corrections"].collect()) == [1] * 5 + [5, 7]
    counted = left["invoice_items"].groupBy("invoice_id").count()
    tasks = counted.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("count").alias("n")).collect()
    assert len(tasks) >= 40 and max(r.n for r in tasks) < 500


def test_overlay_items(spark):
    def p(d, q, u, t=None):
        import json
        return json.dumps({"description": d, "quantity": q, "unit_price": u, "line_total": t})

    items = spark.createDataFrame(
        [(1, 1, "A", 1.0, 2.0, None), (1, 2, " a ", 1.0, 2.0, 7.0), (1, 3, "B", 1.0, 2.0, 3.0), (1, 4, "C", 1.0, 2.0, 3.0), (1, 5, "D", None, 2.0, 3.0)],
        "invoice_id INT, seq BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE",
    )
    log = spark.createDataFrame([
        (1, 1, "actualizar", 9, "x", p("B", 1, 2), p("B2", "1.000,5", 2)),
        (2, 1, "update", 9, "x", p("B", 1, 2), p("B3", 4, "2,5", 10)),
        (3, 1, "update", None, "x", p("C", 1, 2), p("never", 1, 1)),
        (4, 1, "eliminar", 9, None, p("c", 1.0, 2), None),
        (5, 1, "update", 9, "x", p("C", 1, 2), p("gone", 1, 1)),
        (6, 1, "añadir", None, None, None, p("A", 1, 2, 99)),
        (7, 1, "add_item", None, None, None, p("E", 1, 1, 1)),
        (8, 1, "add", None, None, None, p("e", 1, 1, 2)),
        (9, 1, "add", None, None, None, "{broken"),
        (10, 1, "delete", None, None, "{broken", None),
    ], "id BIGINT, invoice_id INT, kind STRING, original_item_id INT, field STRING, original_value STRING, corrected_value STRING")
    rows = {tuple(r)[1:] for r in corr.overlay_items(items, log).collect()}
    assert rows == {(" a ", 1.0, 2.0, 7.0), ("B3", 4.0, 2.5, 10.0), ("D", None, 2.0, 3.0), ("E", 1.0, 1.0, 1.0)}


def test_store_batch(spark):
    from ledgerloom.operators.documents import store_batch

    invoices = spark.createDataFrame([(1, "f/a", "A", "u@x", None, 5.0), (2, "f/b", "B", "u@x", 1, 6.0)], "id BIGINT, file_path STRING, invoice_number STRING, customer_email STRING, user_id BIGINT, total_amount DOUBLE")
    items = spark.createDataFrame([(1, "old", 1.0, 1.0, 1.0), (2, "kept", 1.0, 1.0, 1.0)], "invoice_id BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE")
    records = spark.createDataFrame([(1, "f/a", "A2", "u@x", 7.0), (2, "f/n", "N", "w@x", 8.0)], "seq BIGINT, file_path STRING, invoice_number STRING, customer_email STRING, total_amount DOUBLE")
    fresh = spark.createDataFrame([("f/a", 1, "new", 1.0, 2.0, 2.0), ("f/a", 2, "wrong", 1.0, 2.0, 2.0), ("f/n", 1, "n", 1.0, 1.0, 1.0)], "file_path STRING, line_no INT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE")
    users = spark.createDataFrame([(9, "u@x")], "id BIGINT, email STRING")
    log = spark.createDataFrame([(1, 1, "invoice_number", "A", "FIXED", dt.datetime(2024, 1, 1))], "id BIGINT, invoice_id BIGINT, field STRING, original_value STRING, corrected_value STRING, corrected_at TIMESTAMP_NTZ")
    item_log = spark.createDataFrame([(1, 1, "delete", 5, None, '{"description":"wrong","quantity":1,"unit_price":2}', None)], "id BIGINT, invoice_id BIGINT, kind STRING, original_item_id BIGINT, field STRING, original_value STRING, corrected_value STRING")
    new, new_items = store_batch(invoices, items, records, fresh, users, log, item_log)
    rows = {r.file_path: (r.id, r.invoice_number, r.user_id, r.total_amount) for r in new.collect()}
    assert rows == {"f/a": (1, "FIXED", 9, 7.0), "f/b": (2, "B", 1, 6.0), "f/n": (4, "N", None, 8.0)}
    assert {(r.invoice_id, r.description) for r in new_items.collect()} == {(1, "new"), (2, "kept"), (4, "n")}


def test_audits(spark):
    items = spark.createDataFrame([(1, 7, "A", 23.0, None, 1.0)], "id BIGINT, invoice_id BIGINT, description STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE")
    changes = spark.createDataFrame([(1, 1, "quantity", "23,00"), (2, 1, "unit_price", "5"), (3, 1, "description", "A"), (4, 9, "quantity", "1")], "id BIGINT, item_id BIGINT, field STRING, corrected_value STRING")
    assert [(r.field, r.original_value, r.corrected_value) for r in corr.change_audit(items, changes).collect()] == [("unit_price", None, "5")]
    assert corr.update_items(items, changes).first().unit_price == 5.0
    left, audit = corr.delete_items(items, spark.createDataFrame([(1,), (1,)], "item_id BIGINT"))
    assert left.count() == 0 and audit.count() == 1
    assert '"unit_price":null' in audit.first().original_value


def test_learning(spark, tmp_path):
    rows = [(i, "invoice_number", "F.1" if i % 2 else "G") for i in range(14)] + [(20 + i, "supplier_name", "Acme Ltda") for i in range(6)]
    rows += [(40 + i, "currency", "USD") for i in range(9)] + [(60 + i, "customer_name", "Pocos") for i in range(5)]
    log = spark.createDataFrame(rows, "id BIGINT, field STRING, corrected_value STRING")
    items = spark.createDataFrame([(1, "description", '{"description": "Yeso"}'), (2, "description", "{mal}"), (3, "quantity", "9"), (4, "description", "Acme Ltda")], "id BIGINT, field STRING, corrected_value STRING")
    patterns, terms = learning.learn(log, items)
    assert learning.patterns_as_dict(patterns) == {"invoice_number": "(?iu)(\\QG\\E)"}  # tie: first entered
    ordered = [r.term for r in terms.orderBy("source_rank", "first_id").collect()]
    assert ordered == ["Acme Ltda", "Yeso", "{mal}"]
    path = str(tmp_path / "learned")
    json_files.write_json(json_files.learned_records(patterns, terms), path)
    again = json_files.explode_learned(json_files.read_learned(spark, path), [])
    assert {(r.kind, r.value) for r in again.collect()} == {("regex", "(?iu)(\\QG\\E)"), ("term", "Acme Ltda"), ("term", "Yeso"), ("term", "{mal}")}


def test_learned_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "regex_patterns": {"invoice_number": "x"},\n "nlp_terms": ["TORNILLO NUEVE MM", "CINTA AZUL"]\n}')
    (tmp_path / "b.json").write_text("{ not json")
    rows = json_files.explode_learned(json_files.read_learned(spark, str(tmp_path), whole_file=True), []).collect()
    assert sorted((r.kind, r.value) for r in rows) == [("regex", "x"), ("term", "CINTA AZUL"), ("term", "TORNILLO NUEVE MM")]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "users")
    assert snapshots.read_or_empty(spark, path, "users").count() == 0
    snapshots.write_snapshot(spark.createDataFrame([(1, "a@b")], snapshots.SCHEMAS["users"]), path)
    assert snapshots.read_or_empty(spark, path, "users").first().email == "a@b"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshots.write_snapshot(snapshots.empty(spark, "users"), path)
    assert snapshots.conform(spark.range(1), "invoices").first().currency == "COP"


def test_inbox(spark, tmp_path):
    for name in ("a.pdf", "B.ZIP", "c.txt", "pdf"):
        (tmp_path / name).write_text("x")
    df = files.scan_inbox(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in df.collect()} == {"a.pdf", "B.ZIP"}


def test_patches_of_one_correction(spark):
    log = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id BIGINT, corrected_value STRING, corrected_at INT")
    patches = spark.createDataFrame([(1, "late", 9), (1, "early", 5), (1, "late", 9)], "id BIGINT, corrected_value STRING, patched_at INT")
    got = corr.patch_log(log, log.where("false"), patches, log.where("false").select("id"))
    assert sorted(map(tuple, got.select("id", "corrected_value", "corrected_at").collect())) == [(1, "late", 9), (2, "b", 1)]
