"""Plans keep the shape they were designed for."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.functions import amounts
from ledgerloom.operators import documents, features, header, messages, terms
from ledgerloom.operators.header import extract_header
from ledgerloom.operators.lines import extract_lines
from ledgerloom.plans import QUERIES
from ledgerloom.sources import ubl


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_text_extraction_does_not_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (extract_header(docs), extract_lines(docs, ["doc_id"])):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(extract_lines(docs, ["doc_id"]))


def test_newest_per_mailbox_is_limited_before_the_shuffle(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet").selectExpr("role AS mailbox", "conv_id * 100 + turn AS uid", "text AS body")
    text = plan(messages.newest_per_mailbox(df))
    assert text.count("WindowGroupLimit") >= 2


def test_xml_is_parsed_twice_at_most(spark, small):
    text = plan(QUERIES["source_precedence"](spark, small))
    project = [line for line in text.split("\n") if "from_xml" in line]
    assert 0 < sum(line.count("from_xml") for line in project) <= 4
    assert "Filter" not in text.split("SortAggregate")[-1].split("\n")[0]


@pytest.mark.parametrize("name", ["item_overlay", "item_dedup", "combine_fields", "correction_upsert"])
def test_one_shuffle_by_key(spark, small, name):
    text = plan(QUERIES[name](spark, small)).split("\n\n\n")[0]
    assert text.count("Aggregate (") == 2  # partial and final
    assert "Join" not in text


def test_tables_are_laid_out_once(spark, small):
    """The layout of a table is aggregated from numbers by hash and joined; the rows follow in the same partitioning."""
    text = plan(QUERIES["table_items"](spark, small)).split("\n\n\n")[0]
    assert text.count("HashAggregate (") == 2 and text.count("Join") == 1


@pytest.mark.parametrize("small_dictionary", [True, False])
def test_texts_are_not_broadcast_to_find_terms(spark, monkeypatch, small_dictionary):
    monkeypatch.setattr(terms, "SMALL", 2_000_000 if small_dictionary else -1)
    docs = spark.range(4).selectExpr("id", "concat('uno dos tres ', id % 2, ' uno') AS text")
    listed = spark.createDataFrame([("uno dos tres",), ("tres 1",), ("uno",), ("uno",), ("falta",)], "term STRING")
    hits = terms.match_terms(docs, ["id"], listed)
    text = plan(hits).split("\n\n\n")[0]
    assert "BuildLeft" not in text and "LeftSemi BuildRight" not in text
    assert text.count("BroadcastHashJoin") == (2 if small_dictionary else 0)
    found = [(i, "uno dos tres", 1, 3) for i in range(4)] + [(i, "tres 1", 3, 2) for i in (1, 3)]
    found += [(i, "uno", p, 1) for i in range(4) for p in (1, 5)]
    assert sorted(map(tuple, hits.collect())) == sorted(found)


def test_no_cross_join_anywhere(spark, small):
    skip = {
        "stream_upsert", "stream_dedup", "stream_dedup_watermark", "stream_learn", "stream_learn_incremental", "stream_ingest_fold",
        "run_metrics", "snapshot_commit", "document_pipeline", "ml_train_predict", "predict_fill", "classify_docs",
    }
    for name, query in QUERIES.items():
        if name not in skip:
            text = plan(query(spark, small))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_words_are_counted_where_their_document_is(spark):
    docs = spark.createDataFrame([(1, "uno dos uno"), (1, "dos tres"), (None, "uno"), (2, None)], "id INT, text STRING")
    counted = features.term_counts(docs, "id")
    assert plan(counted).split("\n\n\n")[0].count("Exchange (") == 1
    assert sorted(map(str, counted.collect())) == sorted(
        f"Row(id={i}, token='{t}', tf={n})" for i, t, n in [(1, "uno", 2), (1, "dos", 2), (1, "tres", 1), (None, "uno", 1)]
    )


def test_usual_amounts_meet_no_pattern(spark):
    shapes = {
        "12": 12.0, "1.5": 1.5, "1.": 1.0, ".5": 0.5, ",5": 0.5, "1,5": 1.5, "1.234,5": 1234.5, "1,234.5": 1234.5, "1.234.567,8": 1234567.8,
        "1,234,567.8": 1234567.8, ".": None, "": None, "1.234.567": 1234567.0, "1.234.56": 1234.56, "$ 7": 7.0, "nan": None, "1e5": None, "1,2,3": None,
    }
    rows = spark.createDataFrame(list(shapes.items()), "v STRING, expected DOUBLE").select("expected", amounts.amount_auto(F.col("v")).alias("found"))
    wrong = rows.where(~F.col("expected").eqNullSafe(F.col("found"))).collect()
    assert not wrong
    text = plan(rows)
    assert text.index("WHEN translate(v") < text.index("regexp_replace")


def test_a_table_of_few_files_is_dealt_to_all_cores(spark):
    setting, cores = spark.conf.get(session.SPREAD), spark.sparkContext.defaultParallelism
    spark.conf.unset(session.SPREAD)
    try:
        few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 2 * cores)
        assert session.spread(few).rdd.getNumPartitions() == 4 * cores
        assert session.spread(many).rdd.getNumPartitions() == 2 * cores
    finally:
        spark.conf.set(session.SPREAD, setting)


def test_usual_xml_meets_no_pattern(spark):
    line = "<Invoice xmlns='u'><x>{0}</x><cac:InvoiceLine><cbc:ID u='1'>7{1}</cbc:ID></cac:InvoiceLine></Invoice>"
    texts = [line.format("", ""), line.format("\x01", ""), line.format("", "\x01"), line.format("", "a￾b"), line.format("", "￿"), "no", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k INT, xml STRING")
    lines = ubl.parse_lines(docs, ["k"])
    assert sorted((r.k, r.line_no, r.line_id) for r in lines.collect()) == [(0, 1, "7"), (1, 1, "7"), (2, 1, "7"), (3, 1, "7a b"), (4, 1, "7")]
    assert ubl.parse_headers(docs, ["k"]).count() == len(texts)
    text = plan(lines)
    assert text.count("from_xml(") - text.count("regexp_replace(xml") == 1


XML = (
    "<Invoice xmlns='u'><cbc:ID>F{0}</cbc:ID>{1}<cac:LegalMonetaryTotal><cbc:PayableAmount>9</cbc:PayableAmount></cac:LegalMonetaryTotal>"
    "<cac:InvoiceLine><cac:Item><cbc:Description>Uno</cbc:Description></cac:Item><cac:Price><cbc:PriceAmount>5</cbc:PriceAmount></cac:Price>{2}</cac:InvoiceLine></Invoice>"
)


def test_xml_of_a_batch_is_parsed_once_for_fields_and_lines(spark):
    wrapped = "<A><cac:Attachment><cac:ExternalReference><cbc:Description><![CDATA[{0}]]></cbc:Description></cac:ExternalReference></cac:Attachment></A>"
    broken = ["<cac:T>ax", "c<cbc:ID>9", "</x>", "<cac:InvoiceLine>t</cac:InvoiceLine>", "\x01", "&#1;", "\ufffe"]
    xml = [XML.format(0, "", ""), wrapped.format(XML.format(1, "", ""))]
    xml += [XML.format(i, *parts) for i, b in enumerate(broken, len(xml)) for parts in ((b, ""), ("", b))] + [XML.format(0, "", "")[:-20], "", None]
    members = spark.createDataFrame([(i, 1, "xml", x) for i, x in enumerate(xml)] + [(99, 1, "pdf", "Factura 7")], "k INT, member_no INT, kind STRING, payload STRING")
    headers, items = documents.read_documents(members, "k")
    assert "from_xml(" not in plan(items) and "from_xml(" not in plan(headers)
    # as each part is read by a parse of its own
    content = members.where("kind = 'xml'").select("k", ubl.invoice_content(F.col("payload")).alias("xml"))
    accepted = ubl.parse_headers(content, ["k"]).where("invoice_number IS NOT NULL AND total_amount IS NOT NULL")
    told = [c for c in accepted.columns if c != "k"]
    lines = ubl.parse_lines(content, ["k"]).join(accepted, "k", "left_semi").select(*items.columns)
    assert sorted(map(str, headers.where("kind = 'xml'").select("k", *told).collect())) == sorted(map(str, accepted.select("k", *told).collect()))
    assert sorted(map(str, items.collect())) == sorted(map(str, lines.collect()))
    assert {0, 1, 10, 11, 14, 15} <= {r.k for r in items.collect()}


def test_patterns_run_only_where_a_label_occurs(spark):
    texts = [
        "FACTURA No. A-1\nFecha 2024-05-01", "Nº 7 IMPUE\u017fTO: 5 VENC\u0130MIENTO 1/2/2024", "emp\u0131re total 9 \u212aELV\u0130N", "raz\u00f3nSocial: Acme Ltda",
        "TOTAL\ta\npagar $ 3", "RAZÓN  SOCIAL Casa Norte, CLIENTE: uno dos tres cuatro", "nit del adquiriente 900.123.456-1", "MÉTODO DE PAGO efectivo", "uuid " + "a" * 36, "nada", "", None,
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING")
    base = header.base_patterns()
    fields = [f for f in base if f not in ("currency", "cufe")]
    always = [F.nullif(F.btrim(F.regexp_extract("text", base[f], 1), F.lit(" \t\r\n")), F.lit("")).alias(f) for f in fields]
    found = header.extract_header(docs).selectExpr("text", *[f"CAST({f} AS STRING) IS NOT NULL AS {f}" for f in fields])
    expected = docs.select("text", *always).selectExpr("text", *[f"{f} IS NOT NULL AS {f}" for f in fields])
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert any(r.tax_amount and r.due_date for r in found.collect())
    text = plan(header.extract_header(docs))
    # once, behind a test for a word of its labels
    assert text.count("forma\\s*de\\s*pago") == 1 and "WHEN (Contains(_folded" in text


def test_messages_are_not_read_for_items(spark):
    members = spark.createDataFrame([(1, 1, "pdf", "Factura A1\nTotal 9"), (2, 1, "pdf", "nada")], "k INT, member_no INT, kind STRING, payload STRING")
    mail = spark.createDataFrame([(1, "f/b", "x@casa-azul.com", "s"), (1, "f/a", None, "900;EMPRESA AZUL;A;2"), (2, "f/c", None, None)], "k INT, file_path STRING, email_sender STRING, email_subject STRING")
    records, items = documents.read_batch(members, "k", messages=mail)
    assert plan(records).count("partial_max(email_sender") == 1
    (r,) = records.collect()
    assert (r.k, r.file_path, r.email_sender, r.email_subject, r.supplier_name, r.invoice_number) == (1, "f/b", "x@casa-azul.com", "s", "Casa Azul", "A1")
    assert "email_s" not in plan(items)
