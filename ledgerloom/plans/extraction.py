"""Queries that turn texts, tables and XML into fields and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import documents, hints, terms
from ledgerloom.operators.header import extract_header
from ledgerloom.operators.lines import extract_lines
from ledgerloom.operators.pages import concat_pages
from ledgerloom.operators.tables import items_from_cells
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registry import query
from ledgerloom.plans.scalars import day
from ledgerloom.session import spread
from ledgerloom.sources import ubl
from ledgerloom.sources.catalog import table

_AMOUNTS = """
  SELECT *, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.84 AS DECIMAL(18,2)) AS DOUBLE) AS subtotal,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.84 AS DECIMAL(18,2)) AS DOUBLE) AS tax
  FROM orders"""


@query(f"""
WITH o AS ({_AMOUNTS}), d AS (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS k6 FROM o JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS doc_key, 'FV-' || o_orderkey AS invoice_number,
  strftime(o_orderdate, '%Y-%m-%d') AS issue_date,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date,
  subtotal AS subtotal_amount, tax AS tax_amount, o_totalprice AS total_amount,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'COP' WHEN '2' THEN 'EUR' WHEN '3' THEN 'EUR' WHEN '4' THEN 'MXN' ELSE 'COP' END AS currency,
  c_mktsegment || ' Comercial S.A.S.' AS supplier_name,
  '900' || k6 || left(o_orderpriority, 1) AS supplier_tax_id,
  replace(c_name, '#', ' ') AS customer_name,
  '800' || k6 || left(o_orderpriority, 1) AS customer_tax_id,
  CASE WHEN o_orderstatus <> 'P' THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS cufe,
  CASE o_orderstatus WHEN 'F' THEN 'Transferencia bancaria' WHEN 'O' THEN 'Efectivo' ELSE 'Tarjeta de crédito' END AS payment_method,
  'ventas' || o_custkey || '@example.com' AS email
FROM d""")
def header_extract(spark: SparkSession, folder: str) -> DataFrame:
    out = extract_header(fx.invoice_texts(spark, folder)).drop("text")
    return out.withColumns({"issue_date": day("issue_date"), "due_date": day("due_date")})


@query("""SELECT o_orderkey, 'muelle ' || o_custkey AS delivery_dock, 'FV' || o_orderkey AS invoice_number FROM orders""")
def custom_pattern(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "orders")).selectExpr(
        "o_orderkey", "concat('Texto. Ref: FV', o_orderkey, ' Factura 77. Entregar en <muelle ', o_custkey, '>') AS text"
    )
    out = extract_header(
        docs,
        learned={"invoice_number": r"(?iu)ref:\s*(\w+)"},
        custom={"delivery_dock": r"(?iu)entregar\s+en\s+<([^>]+)>"},
    )
    return out.select("o_orderkey", "delivery_dock", "invoice_number")


_ROUNDED = """CAST(CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS DOUBLE)"""


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS line_no, 'Parte ' || l_partkey || ' azul' AS description,
  l_quantity AS quantity, l_extendedprice AS unit_price, {_ROUNDED} AS line_total
FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 AS line_no, 'Entrega ' || l_suppkey || ' almacén' AS description,
  1.0::DOUBLE AS quantity, l_tax AS unit_price, l_tax AS line_total
FROM lineitem""")
def text_line_items(spark: SparkSession, folder: str) -> DataFrame:
    return extract_lines(fx.line_texts(spark, folder), fx.LINE_KEYS)


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    price = "cast(l_extendedprice AS decimal(18,2))"
    code = "concat('C', l_suppkey)"
    description = "concat(' Parte ', l_partkey, ' ')"
    quantity = "cast(cast(l_quantity AS int) AS string)"
    unit = (
        f"CASE l_returnflag WHEN 'R' THEN translate(format_number({price}, 2), ',.', '.,') "
        f"WHEN 'A' THEN concat('$', format_number({price}, 2)) ELSE cast({price} AS string) END"
    )
    total = f"CASE WHEN l_linestatus = 'F' THEN cast({fx._LINE_TOTAL} AS string) ELSE '' END"

    def row(*columns: tuple[str, str]) -> str:
        cells = [f"struct({i} AS col_no, '{h}' AS header, {v} AS value)" for i, (h, v) in enumerate(columns)]
        return f"array({', '.join(cells)})"

    layouts = {
        1: row(("Código", code), ("Descripción", description), ("Cantidad", quantity), ("Precio Unitario", unit), ("Total", total)),
        2: row(("Qty", quantity), (" DETALLE ", description), ("Vr.Unitario", unit), ("Importe", total)),
        3: row(("A", description), ("B", quantity), ("C", unit), ("D", total)),
        4: row(("X", description), ("Y", quantity), ("Z", unit)),
        5: row(("Descripción", description), ("Cantidad", quantity)),
        6: row(("Item", code), ("Descripcion", description), ("Cant.", quantity), ("P Unit", unit), ("Total", total)),
    }
    last = row(("0", description), ("1", quantity), ("2", unit), ("3", total))
    title = row(("0", "'Descripcion'"), ("1", "'9'"), ("2", "'9'"), ("3", "'9'"))
    blank = row(("0", "'Transporte'"), ("1", "''"), ("2", "'-'"), ("3", "cast(null AS string)"))
    whens = " ".join(f"WHEN {k} THEN array({v})" for k, v in layouts.items())
    rows = spread(table(spark, folder, "lineitem")).selectExpr(
        "l_orderkey", "l_linenumber AS table_no",
        "((l_partkey * 1000003 + l_suppkey) * 64 + cast(l_quantity AS int)) * 3 AS row_base",
        f"posexplode(CASE l_linenumber {whens} ELSE array({last}, {title}, {blank}) END) AS (kind, cells)",
    )
    return rows.selectExpr("l_orderkey", "table_no", "row_base + kind AS row_no", "inline(cells)")


@query(f"""
SELECT l_orderkey, l_linenumber AS table_no, 'Parte ' || l_partkey AS description, l_quantity AS quantity,
  l_extendedprice AS unit_price, {_ROUNDED} AS line_total
FROM lineitem WHERE l_linenumber <> 5""")
def table_items(spark: SparkSession, folder: str) -> DataFrame:
    return items_from_cells(_cells(spark, folder), ["l_orderkey"]).drop("row_no")


_UBL_SQL = f"""
WITH o AS ({_AMOUNTS})
SELECT o_orderkey AS doc_key, sha256(CAST(o_orderkey AS VARCHAR)) AS cufe, 'FV-' || o_orderkey AS invoice_number,
  strftime(o_orderdate, '%Y-%m-%d') AS issue_date, '08:' || strftime(o_orderdate, '%d') || ':00-05:00' AS issue_time,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date,
  'COP' AS currency, o_orderpriority AS supplier_name, '900' || o_custkey AS supplier_tax_id,
  'ventas@example.com' AS supplier_email, 'Cliente ' || o_custkey AS customer_name,
  '800' || o_custkey AS customer_tax_id, 'c' || o_custkey || '@example.com' AS customer_email,
  subtotal AS subtotal_amount, tax AS tax_amount, o_totalprice AS total_amount
FROM o"""


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({"issue_date": day("issue_date"), "due_date": day("due_date")})


@query(_UBL_SQL)
def ubl_header(spark: SparkSession, folder: str) -> DataFrame:
    return _dates_as_text(ubl.parse_headers(fx.invoice_documents(spark, folder), ["doc_key"]))


@query(_UBL_SQL)
def ubl_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    wrapped = fx.invoice_documents(spark, folder).selectExpr("doc_key", f"{fx.wrap_xml('xml')} AS wrapper")
    inner = wrapped.select("doc_key", ubl.unwrap(F.col("wrapper")).alias("xml"))
    return _dates_as_text(ubl.parse_headers(inner, ["doc_key"]))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS line_no, '1' AS line_id, 'Parte ' || l_partkey AS description,
  l_quantity AS quantity, l_extendedprice AS unit_price, {_ROUNDED} AS line_total
FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, '2', 'Impuesto ' || l_suppkey, 1.0::DOUBLE, l_tax, l_tax
FROM lineitem""")
def ubl_lines(spark: SparkSession, folder: str) -> DataFrame:
    return ubl.parse_lines(fx.line_documents(spark, folder), fx.LINE_KEYS)


@query("""
SELECT o_orderkey, o_orderstatus <> 'P' AS is_invoice FROM orders
UNION ALL
SELECT -1 - page_id, contains(html, '<Invoice') OR contains(html, '<FacturaElectronica') OR contains(html, '<DianExtensions>')
FROM pages""")
def xml_sniff(spark: SparkSession, folder: str) -> DataFrame:
    payload = """CASE o_orderstatus WHEN 'F' THEN '<?xml version="1.0"?><Invoice xmlns="a">'
        WHEN 'O' THEN concat('<a><DianExtensions>', o_orderkey) ELSE '<ApplicationResponse>' END"""
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", f"{payload} AS payload")
    pages = table(spark, folder, "pages").selectExpr("-1 - page_id AS o_orderkey", "html AS payload")
    return orders.unionByName(pages).select("o_orderkey", ubl.looks_like_invoice(F.col("payload")).alias("is_invoice"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey < 10 THEN 'Propio ' || s_nationkey WHEN s_nationkey < 5 THEN NULL
  ELSE 'Casa Del Norte ' || s_nationkey END AS supplier_name FROM supplier""")
def sender_supplier_hint(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_suppkey < 10 THEN concat('Propio ', s_nationkey) WHEN s_suppkey < 50 THEN '' END AS supplier_name",
        "CASE WHEN s_nationkey < 5 THEN 'x@ab.com' ELSE concat('ventas@casa-del_norte-', s_nationkey, '.com.co') END AS email_sender",
    )
    return hints.fill_supplier(records).select("s_suppkey", "supplier_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '900' || o_custkey || '1' END AS supplier_tax_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'Empresa ' || o_custkey END AS supplier_name,
  CASE WHEN o_orderstatus <> 'P' THEN 'FV' || o_orderkey || 'AB' END AS invoice_number FROM orders""")
def subject_hint(spark: SparkSession, folder: str) -> DataFrame:
    subject = F.expr("""CASE o_orderstatus
        WHEN 'F' THEN concat(' 900.', o_custkey, '-1 ; Empresa ', o_custkey, ' ;fv ', o_orderkey, '; ab')
        WHEN 'O' THEN concat('900', o_custkey, '1;Empresa ', o_custkey, ';FV;', o_orderkey, 'ab;01;resto')
        ELSE concat('Factura ', o_orderkey, ';dos;tres') END""")
    return table(spark, folder, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in hints.subject_parts(subject).items()]
    )


@query("""
WITH r AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS st, CASE WHEN o_orderpriority < '3' THEN '' ELSE 'Empresa ' || o_custkey END AS name,
    CASE WHEN o_orderpriority < '2' THEN NULL ELSE '900' || o_custkey || '1' END AS tax, 'FV' || o_orderkey AS number FROM orders),
h AS (
  SELECT o_orderkey, CASE WHEN name = '' THEN 'Casa Norte' ELSE name END AS name, tax, number,
    CASE st WHEN 'F' THEN 'EMPRESA ' || o_custkey WHEN 'O' THEN 'Otra Firma' END AS hname,
    CASE st WHEN 'F' THEN '900' || o_custkey || '1' WHEN 'O' THEN '777777777777' END AS htax,
    CASE WHEN st <> 'P' THEN 'FV' || o_orderkey || 'X' END AS hnumber FROM r)
SELECT o_orderkey,
  CASE WHEN hname IS NOT NULL AND 1 - levenshtein(lower(name), lower(hname)) / greatest(length(name), length(hname)) < 0.7 THEN hname ELSE name END AS supplier_name,
  CASE WHEN htax IS NOT NULL AND (tax IS NULL OR 1 - levenshtein(tax, htax) / greatest(length(tax), length(htax)) < 0.7) THEN htax ELSE tax END AS supplier_tax_id,
  CASE WHEN hnumber IS NOT NULL AND 1 - levenshtein(lower(number), lower(hnumber)) / greatest(length(number), length(hnumber)) < 0.7 THEN hnumber ELSE number END AS invoice_number
FROM h""")
def header_hints(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderpriority < '3' THEN '' ELSE concat('Empresa ', o_custkey) END AS supplier_name",
        "CASE WHEN o_orderpriority < '2' THEN NULL ELSE concat('900', o_custkey, '1') END AS supplier_tax_id",
        "concat('FV', o_orderkey) AS invoice_number", "'ventas@casa-norte.com' AS email_sender",
        "CASE o_orderstatus WHEN 'F' THEN concat('900.', o_custkey, '-1;EMPRESA ', o_custkey, ';FV ', o_orderkey, ';x') "
        "WHEN 'O' THEN concat('777777777777;Otra Firma;fv', o_orderkey, ';x') ELSE 'sin datos' END AS email_subject",
    )
    out = hints.apply_hints(records)
    return out.drop("email_sender", "email_subject")


_FUZZY = """CASE left(o_orderpriority, 1) WHEN '1' THEN upper({c}) WHEN '2' THEN {r}
    WHEN '3' THEN 'Otra empresa' WHEN '4' THEN '' ELSE {x} END"""


@query("""
WITH r AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE c_name END AS found,
    CASE left(o_orderpriority, 1) WHEN '1' THEN upper(c_name) WHEN '2' THEN replace(c_name, 'Customer', 'Kunde')
      WHEN '3' THEN 'Otra empresa' WHEN '4' THEN '' ELSE replace(c_name, '#0000', ' ') END AS hint
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, 1 - levenshtein(lower(found), lower(hint)) / greatest(length(found), length(hint), 1) AS sim FROM r)
SELECT o_orderkey, CASE WHEN hint <> '' AND (found = '' OR sim < 0.7) THEN hint ELSE nullif(found, '') END AS supplier_name
FROM s""")
def fuzzy_override(spark: SparkSession, folder: str) -> DataFrame:
    return hints.override_by_levenshtein(_found_and_hint(spark, folder), "found", "hint", "supplier_name").select(
        "o_orderkey", "supplier_name"
    )


def _found_and_hint(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = spread(table(spark, folder, "orders")), table(spark, folder, "customer")
    hint = _FUZZY.format(c="c_name", r="replace(c_name, 'Customer', 'Kunde')", x="replace(c_name, '#0000', ' ')")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN '' ELSE c_name END AS found", f"{hint} AS hint"
    )


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(rf"""
WITH b AS (SELECT {_TOKENS} AS tk FROM benchmark),
terms AS (SELECT DISTINCT unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS term FROM b),
d AS (SELECT doc_id, {_TOKENS} AS tk FROM documents),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(tk)), lambda i: {{'pos': i, 'gram': tk[i] || ' ' || tk[i + 1]}})) AS g FROM d)
SELECT doc_id, term, CAST(g.pos AS INTEGER) AS pos, 2 AS n_tokens FROM grams JOIN terms ON g.gram = term""")
def term_dictionary_match(spark: SparkSession, folder: str) -> DataFrame:
    words = terms.tokens(F.col("text"))
    pairs = table(spark, folder, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(
        F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
                             lambda a, b: F.concat_ws(" ", a, b))).alias("term")
    ).distinct()
    return terms.match_terms(spread(table(spark, folder, "documents")), ["doc_id"], pairs)


@query("""
SELECT o_orderkey, replace(o_orderpriority, '-', s) AS term, 2 AS pos, CASE WHEN o_orderpriority LIKE '4%' THEN 4 ELSE 3 END AS n_tokens
FROM orders, (VALUES ('-'), (' - '), ('- ')) AS v(s)""")
def term_dictionary_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary terms that differ in blanks only are all found."""
    orders = table(spark, folder, "orders")
    words = orders.select(F.explode(F.array(*[F.replace("o_orderpriority", F.lit("-"), F.lit(x)) for x in ("-", " - ", "- ")])).alias("term"))
    return terms.match_terms(spread(orders).selectExpr("o_orderkey", "concat('clase ', o_orderpriority, ' .') AS text"), ["o_orderkey"], words)


@query("""
SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE p_type || ' ' || p_brand END AS supplier_name,
  CASE WHEN p_size < 25 THEN p_type || ' ' || p_brand ELSE p_name END AS customer_name,
  CASE WHEN p_brand <> 'Brand#1' THEN '90000' || p_size || '7' END AS supplier_tax_id FROM part""")
def term_assign(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    first = "CASE WHEN p_size < 25 THEN p_name ELSE concat(p_type, ' ', p_brand) END"
    second = "CASE WHEN p_size < 25 THEN concat(p_type, ' ', p_brand) ELSE p_name END"
    docs = spread(part).selectExpr(
        "p_partkey",
        f"concat('Venta: ', {first}, ', ', {first}, ' por ', {second}, '. NIT ', "
        "CASE WHEN p_brand <> 'Brand#1' THEN concat('90000', p_size, '7') ELSE '12' END) AS text",
    )
    words = part.selectExpr("explode(array(p_name, concat(p_type, ' ', p_brand), concat('90000', p_size, '7'), '12')) AS term")
    hits = terms.match_terms(docs, ["p_partkey"], words.distinct())
    return terms.assign_terms(hits, ["p_partkey"])


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Uno ' || o_orderkey || ' Tres' END AS supplier_name,
  CASE o_orderstatus WHEN 'O' THEN 'Casa ' || o_custkey || ' Norte' END AS customer_name FROM orders""")
def keyword_proximity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "orders")).selectExpr("o_orderkey", """CASE o_orderstatus
        WHEN 'F' THEN concat('Datos del PROVEEDOR Uno ', o_orderkey, ' Tres Cuatro proveedor x y z w')
        WHEN 'O' THEN concat('subproveedor a b c d Cliente: Casa ', o_custkey, ' Norte fin')
        ELSE concat('Razón social Beta ', o_orderkey) END AS text""")
    return terms.names_near_keywords(docs).drop("text")


def _entities(spark: SparkSession, folder: str, labels: dict[str, str]) -> DataFrame:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return table(spark, folder, "events").selectExpr(
        "user_id", "event_id AS pos", f"CASE event_type {whens} ELSE 'MISC' END AS label",
        "CASE WHEN event_type <> 'purchase' THEN concat(event_type, ' ', get_json_object(props, '$.k')) "
        "WHEN cast(get_json_object(props, '$.k') AS int) < 50 THEN 'mucho dinero' "
        "ELSE concat('$', replace(cast(cast(value AS decimal(18,2)) AS string), '.', ','), ' COP') END AS text",
    )


_ENTITY_SQL = """
  SELECT user_id, event_id AS pos, event_type, CAST(props->>'$.k' AS INT) AS k, value,
    CASE WHEN event_type <> 'purchase' THEN event_type || ' ' || (props->>'$.k') END AS text FROM events"""


@query(f"""
WITH e AS ({_ENTITY_SQL})
SELECT user_id, arg_min(text, pos) FILTER (event_type = 'click') AS supplier_name,
  arg_min(text, pos) FILTER (event_type = 'view') AS issue_date,
  CAST(arg_min(CAST(value AS DECIMAL(18,2)), pos) FILTER (event_type = 'purchase' AND k >= 50) AS DOUBLE) AS total_amount
FROM e GROUP BY user_id""")
def first_entity(spark: SparkSession, folder: str) -> DataFrame:
    labels = {"click": "ORG", "view": "DATE", "purchase": "MONEY"}
    return terms.first_entities(_entities(spark, folder, labels), ["user_id"])


@query(f"""
WITH e AS ({_ENTITY_SQL})
SELECT user_id, arg_max(text, pos) FILTER (event_type = 'click') AS supplier_name,
  arg_max(text, pos) FILTER (event_type = 'view') AS customer_name,
  arg_max(text, pos) FILTER (event_type = 'signup') AS issue_date,
  arg_max(text, pos) FILTER (event_type = 'error') AS total_amount
FROM e GROUP BY user_id""")
def last_entity(spark: SparkSession, folder: str) -> DataFrame:
    labels = {"click": "SUPPLIER_NAME", "view": "CUSTOMER_NAME", "signup": "DATE", "error": "TOTAL_AMOUNT"}
    return terms.last_entities(_entities(spark, folder, labels), ["user_id"])


@query("""
SELECT o_orderkey AS doc_key, CASE o_orderstatus WHEN 'F' THEN 'xml' ELSE 'pdf' END AS kind, 'FV-' || o_orderkey AS invoice_number,
  o_totalprice AS total_amount, strftime(o_orderdate, '%Y-%m-%d') AS issue_date,
  'Parte ' || o_custkey || ' azul' AS description, 2.0::DOUBLE AS quantity, o_totalprice AS unit_price,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS line_total
FROM orders""")
def document_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Archives with an XML and a text member; only a third has a complete XML invoice."""
    headers, items = documents.read_documents(fx.archive_members(spark, folder), "doc_key")
    return headers.join(items, "doc_key").select(
        "doc_key", "kind", "invoice_number", "total_amount", day("issue_date").alias("issue_date"),
        "description", "quantity", "unit_price", "line_total",
    )


@query("""
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) AS pages FROM conversations GROUP BY conv_id""")
def page_concat(spark: SparkSession, folder: str) -> DataFrame:
    docs = concat_pages(table(spark, folder, "conversations"), ["conv_id"], "turn")
    return docs.select("conv_id", F.md5("text").alias("text_md5"), "pages")
