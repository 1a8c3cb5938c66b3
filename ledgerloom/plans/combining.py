"""Queries that select, combine, check and route."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import combine, hints, messages as msg, quality, store
from ledgerloom.operators.documents import staged
from ledgerloom.operators.header import extract_header
from ledgerloom.operators.learning import merge_patterns
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registry import query
from ledgerloom.plans.scalars import day
from ledgerloom.session import spread, work_dir
from ledgerloom.sources import json_files, snapshots
from ledgerloom.sources.catalog import table
from ledgerloom.sources.files import inbox_files


@query("""
SELECT page_id, url || '.ZIP' AS path FROM pages WHERE url LIKE '%#top'
UNION ALL SELECT page_id, url || '.pdf' FROM pages WHERE url NOT LIKE '%#top' AND url LIKE 'https://%'""")
def inbox_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "pages").selectExpr("page_id", """CASE WHEN url LIKE '%#top' THEN concat(url, '.ZIP')
        WHEN url LIKE 'https://%' THEN concat(url, '.pdf') ELSE concat(url, '.pdf.txt') END AS path""")
    return inbox_files(files)


@query("""
SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'ana@example.com' END AS customer_email FROM pages""")
def filename_email(spark: SparkSession, folder: str) -> DataFrame:
    name = F.expr("""CASE WHEN url LIKE 'https://m.%' THEN concat(page_id, '_x_ana@example.com_f.pdf')
        WHEN url LIKE 'https://%' THEN concat(page_id, '_x_ana@example.com') ELSE concat('a_b_c_', page_id, '.pdf') END""")
    return table(spark, folder, "pages").select("page_id", hints.customer_email_from_filename(name).alias("customer_email"))


@query(f"SELECT mailbox, uid, subject FROM ({fx.MESSAGES_SQL}) WHERE turn < 3")
def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return msg.relevant(fx.messages(spark, folder)).select("mailbox", "uid", "subject")


@query("""
SELECT o_orderkey, o_orderkey || '.pdf' AS attachment FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'anexo ' || o_orderkey || '.ZIP' FROM orders WHERE o_orderstatus = 'F'""")
def attachment_explode(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "orders").selectExpr("o_orderkey", """CASE o_orderstatus
        WHEN 'F' THEN array(concat(o_orderkey, '.pdf'), 'firma.png', concat('anexo ', o_orderkey, '.ZIP'))
        WHEN 'O' THEN array('logo.gif', concat(o_orderkey, '.pdf')) ELSE array('pdf', 'a.pdf.exe') END AS attachments""")
    return msg.explode_attachments(messages)


@query(f"""
SELECT mailbox, uid, subject FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS rn FROM ({fx.MESSAGES_SQL})) WHERE rn <= 50""")
def newest_per_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    return msg.newest_per_mailbox(fx.messages(spark, folder)).select("mailbox", "uid", "subject")


@query(f"SELECT mailbox, uid, turn FROM ({fx.MESSAGES_SQL}) WHERE subject NOT LIKE 'Factura%'")
def unprocessed_messages(spark: SparkSession, folder: str) -> DataFrame:
    messages = fx.messages(spark, folder)
    ledger = messages.where("subject LIKE 'Factura%'").select("mailbox", "uid")
    return msg.unprocessed(messages, ledger.unionByName(ledger)).select("mailbox", "uid", "turn")


@query(f"""
SELECT mailbox, uid, CAST(uid AS VARCHAR) || '.pdf' AS attachment FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS rn FROM ({fx.MESSAGES_SQL}))
WHERE rn <= 50 AND turn IN (1, 2)""")
def mail_stage(spark: SparkSession, folder: str) -> DataFrame:
    messages = fx.messages(spark, folder).withColumn("attachments", F.expr("array(concat(uid, '.pdf'), 'firma.png')"))
    ledger = messages.where("turn = 0")
    return msg.select_messages(messages, ledger).select("mailbox", "uid", "attachment")


_COMBINE_OUTPUTS = [
    ("pdf_direct", "invoice_number", "concat('D-', o_orderkey)"),
    ("regex", "invoice_number", "CASE WHEN o_orderstatus = 'F' THEN concat('R-', o_orderkey) END"),
    ("nlp", "invoice_number", "CASE WHEN o_orderstatus = 'O' OR o_orderpriority < '3' THEN concat('N-', o_orderkey) END"),
    ("ocr", "invoice_number", "CASE WHEN o_orderpriority < '5' THEN concat('O-', o_orderkey) END"),
    ("regex", "total_amount", "CASE WHEN o_orderstatus <> 'P' THEN format_number(o_totalprice, 2) END"),
    ("nlp", "total_amount", "CASE WHEN o_orderpriority < '3' THEN 'no es monto' ELSE '12,5' END"),
    ("ocr", "issue_date", fx.DATE_TEXT),
    ("nlp", "issue_date", "CASE o_orderstatus WHEN 'F' THEN '15-02-2023' WHEN 'O' THEN 'invalid-date' END"),
    ("nlp", "supplier_name", "concat('Nlp ', o_custkey)"),
    ("ocr", "supplier_name", "'Ocr'"),
]


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'R-' || o_orderkey WHEN o_orderstatus = 'O' OR o_orderpriority < '3' THEN 'N-' || o_orderkey
    WHEN o_orderpriority < '5' THEN 'O-' || o_orderkey END AS invoice_number,
  CASE o_orderstatus WHEN 'F' THEN '2023-02-15' WHEN 'O' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issue_date,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice WHEN o_orderpriority < '3' THEN NULL ELSE 12.5 END AS total_amount,
  'Nlp ' || o_custkey AS supplier_name
FROM orders""")
def combine_fields(spark: SparkSession, folder: str) -> DataFrame:
    entries = [f"named_struct('extractor', '{e}', 'field', '{f}', 'value', {v})" for e, f, v in _COMBINE_OUTPUTS]
    outputs = table(spark, folder, "orders").selectExpr("o_orderkey", f"inline(array({', '.join(entries)}))")
    fields = ["invoice_number", "issue_date", "total_amount", "supplier_name"]
    out = combine.combine_fields(outputs, ["o_orderkey"], fields)
    return out.withColumn("issue_date", day("issue_date"))


@query("""
WITH m AS (
  SELECT l_orderkey AS archive, (CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 64 + CAST(l_quantity AS INT) AS member_no,
    CASE WHEN l_returnflag = 'R' THEN 'pdf' ELSE 'xml' END AS kind, l_linestatus, l_partkey, l_extendedprice FROM lineitem),
r AS (
  SELECT *, row_number() OVER (PARTITION BY archive ORDER BY kind DESC, member_no) AS rn FROM m
  WHERE kind = 'pdf' OR l_linestatus = 'F')
SELECT archive, kind, member_no, CASE WHEN kind = 'xml' THEN 'FV-' || l_partkey END AS invoice_number,
  CASE WHEN kind = 'xml' THEN l_extendedprice END AS total_amount
FROM r WHERE rn = 1""")
def source_precedence(spark: SparkSession, folder: str) -> DataFrame:
    total = "concat('<cac:LegalMonetaryTotal><cbc:PayableAmount>', cast(l_extendedprice AS decimal(18,2)), '</cbc:PayableAmount></cac:LegalMonetaryTotal>')"
    invoice = "concat('<Invoice xmlns:cbc=\"b\" xmlns:cac=\"a\"><cbc:ID>FV-', l_partkey, '</cbc:ID>', {0}, '</Invoice>')"
    payload = f"""CASE WHEN l_returnflag = 'R' THEN '%PDF-1.4'
        WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN {fx.wrap_xml(invoice.format(total))}
        WHEN l_returnflag = 'A' THEN {fx.wrap_xml(invoice.format("''"))}
        WHEN l_linestatus = 'F' THEN {invoice.format(total)}
        ELSE concat('<Note xmlns:cbc="b" xmlns:cac="a"><cbc:ID>1</cbc:ID>', {total}, '</Note>') END"""
    members = spread(table(spark, folder, "lineitem")).selectExpr(
        "l_orderkey AS archive",
        "(cast(l_linenumber AS bigint) * 100000000 + l_partkey) * 64 + cast(l_quantity AS int) AS member_no",
        "CASE WHEN l_returnflag = 'R' THEN 'pdf' ELSE 'xml' END AS kind", f"{payload} AS payload",
    )
    chosen = combine.choose_source(members, ["archive"])
    return chosen.select("archive", "kind", "member_no", "header.invoice_number", "header.total_amount")


@query("""
WITH g AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS line_total,
  (l_partkey * 1000003 + l_suppkey) * 64 + CAST(l_discount * 100 AS INT) AS seq FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line_total IS NULL, seq, line_total) AS rn FROM g)
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS description, line_total, seq FROM r WHERE rn = 1""")
def item_dedup(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "cast(l_linenumber AS string) AS description", "cast(null AS double) AS quantity", "1.0D AS unit_price",
        "CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS line_total",
        "(l_partkey * 1000003 + l_suppkey) * 64 + cast(round(l_discount * 100) AS int) AS seq",
    )
    return combine.dedup_items(items, ["l_orderkey"], ["seq"]).drop("quantity", "unit_price")


@query("""
WITH u AS (
  SELECT 0 AS extractor_no, l_orderkey, l_linenumber, NULL::DOUBLE AS line_total FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 1, l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT 2, l_orderkey, l_linenumber, l_discount FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line_total IS NULL, extractor_no, line_total) AS rn FROM u)
SELECT l_orderkey, 'L' || l_linenumber AS description, extractor_no, line_total FROM r WHERE rn = 1""")
def extractor_union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    def extractor(keep: str, total: str) -> DataFrame:
        return table(spark, folder, "lineitem").where(keep).selectExpr(
            "l_orderkey", "concat('L', l_linenumber) AS description", "1.0D AS quantity", "2.0D AS unit_price",
            f"{total} AS line_total",
        )

    runs = [extractor("l_returnflag = 'A'", "cast(null AS double)"), extractor("l_returnflag = 'N'", "l_tax"),
            extractor("true", "l_discount")]
    return combine.union_dedup(runs, ["l_orderkey"], []).drop("quantity", "unit_price")


@query("""
SELECT l_orderkey, 'tabla' AS origin, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, 'texto', l_partkey, l_quantity FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R' AND t.l_orderkey = l.l_orderkey)""")
def items_fallback(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    tables = items.where("l_returnflag = 'R'").withColumn("origin", F.lit("tabla"))
    texts = items.withColumn("origin", F.lit("texto"))
    return combine.items_or_fallback(tables, texts, ["l_orderkey"]).drop("l_returnflag")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN NULL ELSE text END AS direct,
  CASE lang WHEN 'en' THEN text WHEN 'es' THEN source || text WHEN 'fr' THEN NULL ELSE upper(source) END AS ocr FROM documents)
SELECT doc_id, md5(CASE WHEN ocr IS NOT NULL AND NOT contains(coalesce(direct, ''), ocr)
  THEN coalesce(direct, '') || chr(10) || ocr ELSE coalesce(direct, '') END) AS merged FROM d""")
def text_merge(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "CASE WHEN source = 'src1' THEN NULL ELSE text END AS direct",
        "CASE lang WHEN 'en' THEN text WHEN 'es' THEN concat(source, text) WHEN 'fr' THEN NULL ELSE upper(source) END AS ocr",
    )
    return docs.select("doc_id", F.md5(combine.merge_text(F.col("direct"), F.col("ocr"))).alias("merged"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'meta@example.com' ELSE 'c' || o_custkey || '@example.com' END AS customer_email,
  CASE WHEN o_orderstatus = 'P' THEN 'entrada/' || o_orderkey ELSE 'zip/' || o_orderkey END AS file_path,
  CASE WHEN o_orderstatus = 'F' THEN 'Factura' END AS email_subject, o_totalprice AS total_amount
FROM orders""")
def metadata_overlay(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    extracted = orders.selectExpr(
        "o_orderkey", "concat('c', o_custkey, '@example.com') AS customer_email", "o_totalprice AS total_amount",
        "coalesce(CASE WHEN o_orderstatus <> 'P' THEN concat('zip/', o_orderkey) END, concat('entrada/', o_orderkey)) AS file_path",
    )
    metadata = orders.where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'meta@example.com' END AS customer_email",
        "CASE WHEN o_orderstatus = 'F' THEN 'Factura' END AS email_subject",
    )
    return combine.overlay_metadata(extracted, metadata, ["o_orderkey"])


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority >= '3')""")
def drop_empty(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS invoice_number",
        "CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS total_amount",
        "CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS supplier_name",
    )
    return combine.drop_empty(records, ["invoice_number", "total_amount", "supplier_name"]).select("o_orderkey")


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'invoice_number' END, CASE WHEN o_orderpriority < '2' THEN 'date' END,
    CASE WHEN o_totalprice < 100000 THEN 'total_amount' END, CASE WHEN o_orderstatus = 'F' THEN 'items' END) AS missing,
  NOT (o_orderstatus = 'P' OR o_orderpriority < '2' OR o_totalprice < 100000 OR o_orderstatus = 'F') AS valid
FROM orders""")
def validate_required(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS invoice_number",
        "CASE WHEN o_orderpriority >= '2' THEN o_orderdate END AS date",
        "CASE WHEN o_totalprice >= 100000 THEN o_totalprice END AS total_amount",
        "CASE WHEN o_orderstatus <> 'F' THEN array(1) END AS items",
    )
    return quality.validate(records).select("o_orderkey", "missing", "valid")


_EMAIL_SQL = r"nullif(regexp_extract(text, '([\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+)', 1), '')"


@query(f"""
SELECT doc_id, {_EMAIL_SQL} AS email, CASE WHEN {_EMAIL_SQL} IS NULL THEN 'error' ELSE 'processed' END AS status FROM documents""")
def outcome_route(spark: SparkSession, folder: str) -> DataFrame:
    docs = extract_header(spread(table(spark, folder, "documents"))).select("doc_id", "email")
    return quality.with_outcome(docs, F.col("email").isNotNull())


@query(f"""
SELECT CASE WHEN {_EMAIL_SQL} IS NULL THEN 'error' ELSE 'processed' END AS status, count(*) AS documents FROM documents GROUP BY 1""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.run_summary(outcome_route(spark, folder))


@query("""
SELECT o_orderkey AS invoice_number, o_totalprice AS total_amount, CASE WHEN o_orderstatus = 'F' THEN 'COP' END AS currency,
  CASE WHEN o_orderpriority > '2' THEN o_orderpriority END AS supplier_name, 'f/' || o_orderkey AS file_path FROM orders""")
def canonicalise(spark: SparkSession, folder: str) -> DataFrame:
    produced = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS numero_factura", "o_totalprice AS monto_total", "CASE WHEN o_orderstatus = 'F' THEN 'COP' ELSE '' END AS moneda",
        "CASE WHEN o_orderpriority > '2' THEN o_orderpriority ELSE 'No encontrado' END AS nombre_proveedor",
        "concat('f/', o_orderkey) AS file_path",
    )
    return store.canonicalise(produced)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS value FROM orders""")
def sentinel_null(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerloom.functions.text import sentinel_to_null

    raw = F.expr("CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'No encontrado' ELSE '' END")
    return table(spark, folder, "orders").select("o_orderkey", sentinel_to_null(raw).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS description, l_tax AS quantity, l_extendedprice AS unit_price,
  NULL::DOUBLE AS line_total FROM lineitem""")
def item_names(spark: SparkSession, folder: str) -> DataFrame:
    produced = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'A' THEN cast(l_partkey AS string) END AS description",
        "cast(l_partkey AS string) AS descripcion", "l_tax AS quantity", "9.0D AS cantidad", "l_extendedprice AS precio_unitario",
    )
    return store.canonical_items(produced).withColumn("line_total", F.col("line_total").cast("double"))


@query("""
SELECT p_partkey, 'regex' AS kind, p_type AS name, p_name AS value FROM part WHERE p_brand <> 'Brand#1'
UNION ALL SELECT p_partkey, 'term', NULL, p_name FROM part WHERE p_brand <> 'Brand#1'
UNION ALL SELECT p_partkey, 'term', NULL, p_brand FROM part WHERE p_brand <> 'Brand#1'""")
def patterns_load(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "part").selectExpr("p_partkey", """CASE WHEN p_brand = 'Brand#1' THEN '{"regex_patterns": {'
        ELSE to_json(named_struct('regex_patterns', map(p_type, p_name), 'nlp_terms', array(p_name, p_brand), 'item_patterns',
          cast(map() AS map<string,string>))) END AS json""")
    learned = stored.select("p_partkey", json_files.parse_learned(F.col("json")).alias("j")).select("p_partkey", "j.*")
    return json_files.explode_learned(learned, ["p_partkey"])


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type, value FROM events""")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("record", F.from_json("props", "k BIGINT"))
    packed = events.select(F.to_json(F.struct("event_id", "record", "event_type", "value")).alias("json"))
    parsed = packed.select(
        F.from_json("json", "event_id BIGINT, record STRUCT<k: BIGINT>, event_type STRING, value DOUBLE").alias("r")
    )
    return parsed.select("r.event_id", "r.record.k", "r.event_type", "r.value")


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type, value FROM events""")
def json_file_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested records written as files of JSON lines and read again with a schema."""
    path = work_dir(spark, "records")
    record = F.from_json("props", "k BIGINT").alias("record")
    json_files.write_json(table(spark, folder, "events").select("event_id", record, "event_type", "value"), path)
    back = json_files.read_json(spark, path, "event_id BIGINT, record STRUCT<k: BIGINT>, event_type STRING, value DOUBLE")
    return back.select("event_id", "record.k", "event_type", "value")


@query("""
SELECT 'm' || o_custkey AS mailbox, o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS run, 1 AS entries FROM orders""")
def ledger_append(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs over a growing mailbox: each takes what the ledger on disk does not hold and appends it."""
    path = work_dir(spark, "ledger")
    sent = table(spark, folder, "orders").selectExpr("concat('m', o_custkey) AS mailbox", "o_orderkey AS uid", "o_orderstatus")
    runs = []
    for run, arrived in enumerate(["o_orderstatus = 'F'", "o_orderstatus IN ('F', 'O')", "true"], 1):
        fresh = msg.unprocessed(sent.where(arrived), msg.read_ledger(spark, path))
        # written before the ledger grows, which it is read from
        runs.append(staged(fresh.select("mailbox", "uid", F.lit(run).alias("run")), "run"))
        msg.append_ledger(runs[-1], path)
    entries = msg.read_ledger(spark, path).groupBy("mailbox", "uid").agg(F.count("*").cast("int").alias("entries"))
    return reduce(DataFrame.unionByName, runs).join(entries, ["mailbox", "uid"])


@query("""
SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS invoice_number, o_totalprice AS total_amount,
  CASE WHEN o_orderstatus = 'F' THEN 'USD' ELSE 'COP' END AS currency, 'f/' || o_orderkey AS file_path,
  NULL::VARCHAR AS customer_email FROM orders""")
def empty_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A newly created invoices table and the first rows stored in it."""
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey AS invoice_number", "o_totalprice AS total_amount",
        "CASE WHEN o_orderstatus = 'F' THEN 'USD' END AS currency", "concat('f/', o_orderkey) AS file_path",
    )
    stored = snapshots.empty(spark, "invoices").unionByName(snapshots.conform(rows, "invoices"))
    return stored.select("id", "invoice_number", "total_amount", "currency", "file_path", "customer_email")


@query("""
WITH b AS (SELECT p_name AS field, min('b' || p_brand) AS regex FROM part GROUP BY 1),
l AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS field, min('l' || p_type) AS regex FROM part GROUP BY 1)
SELECT coalesce(b.field, l.field) AS field, coalesce(l.regex, b.regex) AS regex,
  CASE WHEN l.regex IS NULL THEN 'base' ELSE 'learned' END AS origin
FROM b FULL JOIN l ON b.field = l.field""")
def pattern_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Base and learned patterns from all parts: some fields have both, some only one of them."""
    part = table(spark, folder, "part")
    base = part.groupBy(F.col("p_name").alias("field")).agg(F.expr("min(concat('b', p_brand)) AS regex"))
    field = F.expr("CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(p_name, ' ', p_type) END")
    learned = part.groupBy(field.alias("field")).agg(F.expr("min(concat('l', p_type)) AS regex"))
    return merge_patterns(base, learned)
