"""Documents, logs and messages derived from the input tables.

Everything is derived row by row, or by a join on a unique key; nothing is
collected per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import spread
from ledgerloom.sources.catalog import table
from ledgerloom.vocab import MONTHS_ES

_MONTHS = "array(" + ", ".join(f"'{m}'" for m in MONTHS_ES) + ")"
_AMOUNT_TEXT = """CASE o_orderstatus
    WHEN 'F' THEN translate(format_number({0}, 2), ',.', '.,')
    WHEN 'O' THEN format_number({0}, 2)
    ELSE cast({0} AS string) END"""
_MARK = """CASE left(o_orderpriority, 1) WHEN '1' THEN '$ ' WHEN '2' THEN '€ '
    WHEN '3' THEN 'EUR ' WHEN '4' THEN 'MXN ' ELSE 'COP ' END"""
DATE_TEXT = f"""CASE left(o_orderpriority, 1)
    WHEN '1' THEN date_format(o_orderdate, 'dd/MM/yyyy')
    WHEN '2' THEN date_format(o_orderdate, 'yyyy-MM-dd')
    WHEN '3' THEN concat(day(o_orderdate), ' de ', element_at({_MONTHS}, month(o_orderdate)), ' de ', year(o_orderdate))
    WHEN '4' THEN date_format(o_orderdate, 'dd-MM-yyyy')
    ELSE date_format(o_orderdate, 'd/M/yy') END"""


def orders_with_amounts(orders: DataFrame) -> DataFrame:
    total = F.col("o_totalprice").cast("decimal(18,2)")
    subtotal = (total * F.expr("0.84")).cast("decimal(18,2)")
    return orders.withColumns({"total": total, "subtotal": subtotal, "tax": total - subtotal})


def invoice_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One printed invoice header per order: doc_key, text."""
    orders = orders_with_amounts(spread(table(spark, folder, "orders")))
    customer = table(spark, folder, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])

    def amount(c: str) -> str:
        return _AMOUNT_TEXT.format(c)

    lines = [
        "'DOCUMENTO COMERCIAL'",
        "concat('Número de factura: FV-', o_orderkey)",
        f"concat(CASE o_orderstatus WHEN 'F' THEN 'Fecha de emisión: ' ELSE 'FECHA: ' END, {DATE_TEXT})",
        "CASE WHEN o_orderstatus <> 'P' THEN concat('Fecha de vencimiento: ', "
        "date_format(date_add(o_orderdate, 30), 'yyyy-MM-dd')) END",
        "concat('Proveedor: ', c_mktsegment, ' Comercial S.A.S.')",
        "concat('NIT: 900.', left(k6, 3), '.', right(k6, 3), '-', left(o_orderpriority, 1))",
        "concat('Cliente: ', replace(c_name, '#', ' '))",
        "concat('NIT cliente: 800', k6, '-', left(o_orderpriority, 1))",
        f"concat('Subtotal: ', {_MARK}, {amount('subtotal')})",
        f"concat('IVA: ', {_MARK}, {amount('tax')})",
        f"concat('TOTAL A PAGAR: ', {_MARK}, {amount('total')})",
        "concat('Forma de pago: ', CASE o_orderstatus WHEN 'F' THEN 'Transferencia bancaria' "
        "WHEN 'O' THEN 'Efectivo' ELSE 'Tarjeta de crédito' END)",
        "CASE o_orderstatus WHEN 'F' THEN concat('CUFE: ', sha2(cast(o_orderkey AS string), 256)) "
        "WHEN 'O' THEN concat('https://www.dian.gov.co/validador/documento?cufe=', "
        "sha2(cast(o_orderkey AS string), 256)) END",
        "concat('Contacto ventas', o_custkey, '@example.com')",
    ]
    return joined.withColumn("k6", F.expr("lpad(cast(o_custkey AS string), 6, '0')")).selectExpr(
        "o_orderkey AS doc_key", f"concat_ws('\n', {', '.join(lines)}) AS text"
    )


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_TOTAL = "cast(cast(l_quantity AS decimal(18,2)) * cast(l_extendedprice AS decimal(18,2)) AS decimal(18,2))"


def line_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One printed item section per lineitem row."""
    lineitem = spread(table(spark, folder, "lineitem"))
    price = "cast(l_extendedprice AS decimal(18,2))"
    lines = [
        "'Pedido de cliente'",
        "concat('  Descripción Cantidad Valor Unitario Total ', l_linenumber, '  ')",
        f"concat('Parte ', l_partkey, ' azul ', cast(l_quantity AS int), ' ', CASE l_returnflag "
        f"WHEN 'R' THEN translate(format_number({price}, 2), ',.', '.,') "
        f"WHEN 'A' THEN format_number({price}, 2) ELSE cast({price} AS string) END, "
        f"CASE WHEN l_linestatus = 'F' THEN concat(' $ ', format_number({_LINE_TOTAL}, 2)) ELSE '' END)",
        "''",
        "'nota sin cifras'",
        "concat('Entrega ', l_suppkey, ' almacén 1 ', cast(l_tax AS decimal(18,2)))",
        "concat('Total a pagar ', l_linenumber)",
        "'Parte fantasma 9 9 9'",
    ]
    return lineitem.selectExpr(*LINE_KEYS, f"concat_ws('\n', {', '.join(lines)}) AS text")


def _tag(name: str, value: str) -> str:
    return f"'<{name}>', {value}, '</{name}>'"


def _party(role: str, name: str, tax_id: str, email: str) -> str:
    return (
        f"'<cac:{role}><cac:Party><cac:PartyTaxScheme>', {_tag('cbc:RegistrationName', name)}, "
        f"{_tag('cbc:CompanyID', tax_id)}, '</cac:PartyTaxScheme><cac:Contact>', "
        f"{_tag('cbc:ElectronicMail', email)}, '</cac:Contact></cac:Party></cac:{role}>'"
    )


_XML_HEAD = (
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?><Invoice "
    'xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" '
    'xmlns:cac="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2" '
    'xmlns:cbc="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2">\''
)


def invoice_xml(total: str = "total") -> str:
    """SQL expression for the UBL invoice of an order."""
    return "concat(" + ", ".join([
        _XML_HEAD,
        _tag("cbc:UUID", "sha2(cast(o_orderkey AS string), 256)"),
        _tag("cbc:ID", "concat('FV-', o_orderkey)"),
        _tag("cbc:IssueDate", "date_format(o_orderdate, 'yyyy-MM-dd')"),
        _tag("cbc:IssueTime", "concat('08:', lpad(cast(day(o_orderdate) AS string), 2, '0'), ':00-05:00')"),
        _tag("cbc:DocumentCurrencyCode", "'COP'"),
        _party("AccountingSupplierParty", "o_orderpriority", "concat('900', o_custkey)", "'ventas@example.com'"),
        _party("AccountingCustomerParty", "concat('Cliente ', o_custkey)", "concat('800', o_custkey)",
               "concat('c', o_custkey, '@example.com')"),
        "CASE WHEN o_orderstatus <> 'P' THEN concat('<cac:PaymentMeans>', "
        + _tag("cbc:PaymentDueDate", "date_format(date_add(o_orderdate, 30), 'yyyy-MM-dd')")
        + ", '</cac:PaymentMeans>') ELSE '' END",
        "'<cac:TaxTotal><cbc:TaxAmount currencyID=\"COP\">', tax, '</cbc:TaxAmount></cac:TaxTotal>'",
        "'<cac:LegalMonetaryTotal><cbc:LineExtensionAmount currencyID=\"COP\">', subtotal, "
        "'</cbc:LineExtensionAmount>'",
        f"CASE WHEN {total} IS NOT NULL THEN concat('<cbc:PayableAmount currencyID=\"COP\">', {total}, "
        "'</cbc:PayableAmount>') ELSE '' END",
        "'</cac:LegalMonetaryTotal></Invoice>'",
    ]) + ")"


#: SQL expression for one UBL line of a struct x of what, n and price.
XML_LINE = (
    "concat('<cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity>', x.n, '</cbc:InvoicedQuantity><cbc:LineExtensionAmount>', x.n * x.price,"
    " '</cbc:LineExtensionAmount><cac:Item><cbc:Description>', x.what, '</cbc:Description></cac:Item><cac:Price><cbc:PriceAmount>', x.price,"
    " '</cbc:PriceAmount></cac:Price></cac:InvoiceLine>')"
)


def invoice_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One UBL invoice per order: doc_key, xml."""
    orders = orders_with_amounts(spread(table(spark, folder, "orders")))
    return orders.selectExpr("o_orderkey AS doc_key", f"{invoice_xml()} AS xml")


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    return members_of(spread(table(spark, folder, "orders")))


def members_of(orders: DataFrame) -> DataFrame:
    """Two members per order: a text, and an XML that is complete for one status only."""
    text = f"""concat('Descripción Cantidad Valor Unitario 1\nParte ', o_custkey, ' azul 2 ', total, '\nSubtotal ', subtotal,
        '\nNúmero de factura: FV-', o_orderkey, '\nFecha: ', {DATE_TEXT}, '\nTOTAL A PAGAR: $ ', total)"""
    line = """'<cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity>2</cbc:InvoicedQuantity><cbc:LineExtensionAmount>', total * 2,
        '</cbc:LineExtensionAmount><cac:Item><cbc:Description>Parte ', o_custkey, ' azul</cbc:Description></cac:Item>',
        '<cac:Price><cbc:PriceAmount>', total, '</cbc:PriceAmount></cac:Price></cac:InvoiceLine></Invoice>'"""
    complete = f"concat(replace({invoice_xml()}, '</Invoice>', ''), {line})"
    partial = invoice_xml("cast(NULL AS string)")
    xml = f"CASE o_orderstatus WHEN 'F' THEN {wrap_xml(complete)} WHEN 'O' THEN {partial} ELSE '<ApplicationResponse/>' END"
    return orders_with_amounts(orders).selectExpr(
        "o_orderkey AS doc_key",
        f"inline(array(named_struct('member_no', 1, 'kind', 'pdf', 'payload', {text}), "
        f"named_struct('member_no', 2, 'kind', 'xml', 'payload', {xml})))",
    )


def wrap_xml(xml: str) -> str:
    """SQL expression for an attached-document wrapper around an invoice."""
    return (
        "concat('<AttachedDocument xmlns:cac=\"a\" xmlns:cbc=\"b\"><cbc:ID>wrapper</cbc:ID><cac:Attachment>"
        "<cac:ExternalReference><cbc:MimeCode>text/xml</cbc:MimeCode><cbc:Description><![CDATA[', "
        f"{xml}, ']]></cbc:Description></cac:ExternalReference></cac:Attachment></AttachedDocument>')"
    )


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One UBL invoice with two lines per lineitem row."""
    def line(no: int, description: str, quantity: str, price: str, total: str) -> str:
        return ", ".join([
            "'<cac:InvoiceLine>'", _tag("cbc:ID", f"'{no}'"),
            f"'<cbc:InvoicedQuantity unitCode=\"EA\">', {quantity}, '</cbc:InvoicedQuantity>'",
            f"'<cbc:LineExtensionAmount currencyID=\"COP\">', {total}, '</cbc:LineExtensionAmount>'",
            f"'<cac:Item>', {_tag('cbc:Description', description)}, '</cac:Item>'",
            f"'<cac:Price><cbc:PriceAmount>', {price}, '</cbc:PriceAmount></cac:Price></cac:InvoiceLine>'",
        ])

    xml = "concat(" + ", ".join([
        _XML_HEAD,
        line(1, "concat('Parte ', l_partkey)", "l_quantity", "cast(l_extendedprice AS decimal(18,2))", _LINE_TOTAL),
        line(2, "concat('Impuesto ', l_suppkey)", "1", "cast(l_tax AS decimal(18,2))", "cast(l_tax AS decimal(18,2))"),
        "'</Invoice>'",
    ]) + ")"
    return spread(table(spark, folder, "lineitem")).selectExpr(*LINE_KEYS, f"{xml} AS xml")


# --- logs --------------------------------------------------------------------

#: The header correction log: id, invoice_id, field, original_value, corrected_value, corrected_at.
HEADER_CORRECTIONS = [
    "event_id AS id",
    "user_id AS invoice_id",
    "CASE event_type WHEN 'click' THEN 'invoice_number' WHEN 'view' THEN 'supplier_name' "
    "WHEN 'purchase' THEN 'total_amount' WHEN 'signup' THEN 'issue_date' ELSE 'currency' END AS field",
    "event_type AS original_value",
    "CASE event_type WHEN 'click' THEN concat('INV-', get_json_object(props, '$.k')) "
    "WHEN 'view' THEN concat('Proveedor ', get_json_object(props, '$.k')) "
    "WHEN 'purchase' THEN replace(cast(cast(value AS decimal(18,2)) AS string), '.', ',') "
    "WHEN 'signup' THEN date_format(ts, 'dd/MM/yyyy') "
    "ELSE CASE WHEN value < 10 THEN 'USD' ELSE 'EUR' END END AS corrected_value",
    "ts AS corrected_at",
]

#: The same log for the checking SQL.
HEADER_CORRECTIONS_SQL = """
  SELECT event_id AS id, user_id AS invoice_id,
    CASE event_type WHEN 'click' THEN 'invoice_number' WHEN 'view' THEN 'supplier_name'
      WHEN 'purchase' THEN 'total_amount' WHEN 'signup' THEN 'issue_date' ELSE 'currency' END AS field,
    event_type AS original_value,
    CASE event_type WHEN 'click' THEN 'INV-' || (props->>'$.k')
      WHEN 'view' THEN 'Proveedor ' || (props->>'$.k')
      WHEN 'purchase' THEN replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
      WHEN 'signup' THEN strftime(ts, '%d/%m/%Y')
      ELSE CASE WHEN value < 10 THEN 'USD' ELSE 'EUR' END END AS corrected_value,
    ts AS corrected_at
  FROM events"""


def header_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*HEADER_CORRECTIONS)


#: The stored items: one per order, with a unique numeric id.
ITEMS = [
    "o_orderkey AS id", "o_custkey AS invoice_id", "o_orderpriority AS description",
    "CASE o_orderstatus WHEN 'F' THEN 1.0D WHEN 'O' THEN 2.0D ELSE 3.0D END AS quantity",
    "o_totalprice AS unit_price", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS line_total",
]
ITEMS_SQL = """
  SELECT o_orderkey AS id, o_custkey AS invoice_id, o_orderpriority AS description,
    CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END::DOUBLE AS quantity,
    o_totalprice AS unit_price, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS line_total
  FROM orders"""


def stored_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*ITEMS)


#: Requested item field changes: id, item_id, field, corrected_value.
ITEM_CHANGES = [
    "event_id AS id", "user_id AS item_id",
    "CASE event_type WHEN 'click' THEN 'description' WHEN 'view' THEN 'quantity' "
    "WHEN 'purchase' THEN 'unit_price' ELSE 'line_total' END AS field",
    "CASE event_type WHEN 'click' THEN concat('Producto ', get_json_object(props, '$.k')) "
    "WHEN 'view' THEN get_json_object(props, '$.k') "
    "ELSE replace(cast(cast(value AS decimal(18,2)) AS string), '.', ',') END AS corrected_value",
]
ITEM_CHANGES_SQL = """
  SELECT event_id AS id, user_id AS item_id,
    CASE event_type WHEN 'click' THEN 'description' WHEN 'view' THEN 'quantity'
      WHEN 'purchase' THEN 'unit_price' ELSE 'line_total' END AS field,
    CASE event_type WHEN 'click' THEN 'Producto ' || (props->>'$.k')
      WHEN 'view' THEN props->>'$.k'
      ELSE replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END AS corrected_value
  FROM events"""


def item_changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*ITEM_CHANGES)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages: few mailboxes, so each one is hot."""
    return table(spark, folder, "conversations").selectExpr(
        "concat(role, '@example.com') AS mailbox", "conv_id * 1000 + turn AS uid",
        "CASE turn WHEN 0 THEN concat('Factura ', conv_id) WHEN 1 THEN 'Orden de Compra' "
        "WHEN 2 THEN 'NOTA CRÉDITO' ELSE role END AS subject",
        "text AS body", "turn",
    )


MESSAGES_SQL = """
  SELECT role || '@example.com' AS mailbox, conv_id * 1000 + turn AS uid,
    CASE turn WHEN 0 THEN 'Factura ' || conv_id WHEN 1 THEN 'Orden de Compra'
      WHEN 2 THEN 'NOTA CRÉDITO' ELSE role END AS subject,
    text AS body, turn
  FROM conversations"""
