import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import combine, messages, quality


def outputs(spark, records):
    rows = [(d, e, f, v) for (d, e), fields in records.items() for f, v in fields.items()]
    return spark.createDataFrame(rows, "doc INT, extractor STRING, field STRING, value STRING")


def test_priority_and_types(spark):
    df = outputs(spark, {
        (7, "nlp"): {"invoice_number": "N-4", "customer_name": "Sur y Cia", "total_amount": "8"},
        (7, "regex"): {"invoice_number": "R-4", "total_amount": "2.750,5"},
        (7, "ocr"): {"invoice_number": "O-4", "supplier_name": "Viento", "issue_date": "04/11/2030"},
        (8, "ocr"): {"supplier_name": "Directo"},
        (9, "ocr"): {"total_amount": "doce", "issue_date": "ayer"},
    })
    rows = {r.doc: r for r in combine.combine_fields(df, ["doc"]).collect()}
    assert (rows[7].invoice_number, rows[7].total_amount, rows[7].issue_date) == ("R-4", 2750.5, dt.date(2030, 11, 4))
    assert (rows[7].supplier_name, rows[7].customer_name) == ("Viento", "Sur y Cia")
    assert (rows[8].invoice_number, rows[8].supplier_name) == (None, "Directo")
    assert (rows[9].total_amount, rows[9].issue_date) == (None, None)


def test_wide_records_as_outputs(spark):
    regex = spark.createDataFrame([(1, "R", None), (2, None, None)], "doc INT, invoice_number STRING, total_amount DOUBLE")
    nlp = spark.createDataFrame([(1, 5.0), (2, None)], "doc INT, total_amount DOUBLE")
    long = combine.as_outputs(regex, ["doc"], "regex").unionByName(combine.as_outputs(nlp, ["doc"], "nlp"))
    rows = combine.combine_fields(long, ["doc"]).collect()
    assert [(r.doc, r.invoice_number, r.total_amount) for r in rows] == [(1, "R", 5.0)]


def test_source_precedence(spark):
    def inv(n, total):
        return f"<Invoice><cbc:ID>{n}</cbc:ID>" + (f"<cac:LegalMonetaryTotal><cbc:PayableAmount>{total}</cbc:PayableAmount></cac:LegalMonetaryTotal>" if total else "") + "</Invoice>"

    df = spark.createDataFrame([
        ("a", 1, "pdf", "%PDF"), ("a", 2, "xml", inv("no total", None)), ("a", 3, "xml", inv("F3", 5)), ("a", 4, "xml", inv("F4", 6)),
        ("b", 2, "pdf", "%PDF"), ("b", 1, "xml", "<Other/>"), ("b", 3, "pdf", "%PDF"), ("c", 1, "xml", "broken <"), ("c", 2, "txt", "x"),
    ], "archive STRING, member_no INT, kind STRING, payload STRING")
    rows = {r.archive: (r.kind, r.member_no, r.header and r.header.invoice_number) for r in combine.choose_source(df, ["archive"]).collect()}
    assert rows == {"a": ("xml", 3, "F3"), "b": ("pdf", 2, None)}


def test_dedup_of_a_hot_group(spark):
    items = spark.range(20000).selectExpr(
        "1 AS doc", "'x' AS description", "cast(null AS double) AS quantity", "1.0D AS unit_price",
        "CASE WHEN id IN (70, 90) THEN cast(id AS double) END AS line_total", "id AS seq",
    )
    rows = combine.dedup_items(items, ["doc"], ["seq"]).collect()
    assert [(r.line_total, r.seq) for r in rows] == [(70.0, 70)]


def test_merge_text(spark):
    df = spark.createDataFrame([("abc", "b"), ("abc", "x"), (None, "x"), ("abc", None), (None, None), ("abc", "")], "a STRING, b STRING")
    got = [r[0] for r in df.select(combine.merge_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["abc", "abc\nx", "\nx", "abc", "", "abc"]


def test_mail_stage_limits_before_filtering(spark):
    df = spark.createDataFrame(
        [("m", 1, "factura", "", ["a.PDF"]), ("m", 2, "hola", "", ["a.pdf"]), ("m", 3, "Invoice 3", None, ["x.png", "y.zip"]), ("n", 1, None, "CxC", [])],
        "mailbox STRING, uid INT, subject STRING, body STRING, attachments ARRAY<STRING>",
    )
    ledger = spark.createDataFrame([("m", 9)], "mailbox STRING, uid INT")
    rows = messages.select_messages(df, ledger, n=2).collect()
    assert [(r.mailbox, r.uid, r.attachment) for r in rows] == [("m", 3, "y.zip")]


def test_ledger(spark, tmp_path):
    df = spark.createDataFrame([("m", 1), ("m", 2)], "mailbox STRING, uid INT")
    path = str(tmp_path / "ledger")
    assert messages.unprocessed(df, messages.read_ledger(spark, path)).count() == 2
    for _ in range(2):
        messages.append_ledger(df.where("uid = 1"), path)
    assert [r.uid for r in messages.unprocessed(df, messages.read_ledger(spark, path)).collect()] == [2]


def test_outcomes(spark, tmp_path):
    df = quality.with_outcome(spark.range(10), F.when(F.col("id") < 3, True))
    path = str(tmp_path / "out")
    quality.write_by_outcome(df, path)
    assert spark.read.parquet(f"{path}/status=error").count() == 7
    assert {r.status: r.documents for r in quality.run_summary(df).collect()} == {"processed": 3, "error": 7}
