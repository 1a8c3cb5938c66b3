"""Word lists, lookup tables and formats the extraction rules rely on.

They are data, not logic: results depend on these exact values.
"""

# --- message relevance -------------------------------------------------------
RELEVANT_TERMS = [
    "factura", "invoice", "comprobante", "recibo", "cuenta", "estado de cuenta",
    "billing", "cxc", "facturación", "orden de compra", "remisión",
    "nota crédito", "nota débito",
]
ATTACHMENT_SUFFIXES = [".pdf", ".zip"]
NEWEST_PER_MAILBOX = 50

# --- header labels, in the order they are tried ------------------------------
# "[.]" marks an optional dot.
HEADER_LABELS = {
    "invoice_number": [
        "número de factura", "factura no.", "no[.]", "nº", "factura", "serie",
        "comprobante", "invoice no.", "invoice #", "bill no.",
    ],
    "issue_date": ["fecha de emisión", "fecha", "date", "fec."],
    "due_date": ["fecha de vencimiento", "vencimiento", "fecha límite"],
    "subtotal_amount": ["subtotal", "valor neto"],
    "tax_amount": ["iva", "impuesto", "impuestos", "tax"],
    "total_amount": ["total", "importe total", "valor total", "total a pagar"],
    "currency": [
        "total", "importe total", "valor total", "subtotal", "iva", "impuesto",
        "impuestos", "tax",
    ],
    "supplier_name": ["empresa", "nombre comercial", "razón social", "proveedor", "emisor"],
    "supplier_tax_id": [
        "nit", "n.i.t.", "nit del emisor", "cif", "nif", "rfc", "tax id", "vat id",
    ],
    "customer_name": [
        "adquirente", "nombre comercial cliente", "razón social cliente", "cliente", "receptor",
    ],
    "customer_tax_id": [
        "nit del adquiriente", "n.i.t. cliente", "nit cliente", "número documento cliente",
        "cif cliente", "nif cliente", "rfc cliente", "tax id cliente", "vat id cliente",
    ],
    "cufe": ["cufe", "codigo unico de factura electronica", "uuid", "guid"],
    "payment_method": ["forma de pago", "método de pago"],
}

HEADER_FIELDS = [
    "invoice_number", "issue_date", "due_date", "subtotal_amount", "tax_amount",
    "total_amount", "currency", "supplier_name", "supplier_tax_id", "customer_name",
    "customer_tax_id", "cufe", "payment_method", "email",
]

# --- money -------------------------------------------------------------------
CURRENCY_MARKS = ["€", "$", "EUR", "USD", "MXN", "COP"]
#: Marks allowed between the label and the tax or total amount.
TOTAL_MARKS = ["€", "$", "EUR", "MXN", "COP"]

# --- dates -------------------------------------------------------------------
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
    "septiembre", "octubre", "noviembre", "diciembre",
]
MONTHS_EN = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]

# --- line items in free text -------------------------------------------------
SECTION_START_WORDS = [
    "descripción", "cantidad", "valor unitario", "total", "item", "producto",
    "referencia", "detalle", "concept", "qty", "unit price", "line total", "amount",
    "unit", "valor", "preciounitario",
]
SECTION_END_WORDS = ["subtotal", "iva", "impuesto", "total", "total a pagar", "gran total"]

# --- line items in tables, synonyms in priority order ------------------------
TABLE_SYNONYMS = {
    "description": ["descripcion", "description", "detalle", "concepto", "item", "desc"],
    "quantity": ["cantidad", "qty", "quantity", "cant"],
    "unit_price": [
        "precio_unitario", "unitario", "precio_unit", "unit_price", "valor_unitario",
        "vrunitario", "p_unit",
    ],
    "line_total": ["total", "valor_total", "subtotal", "importe", "vr_total", "total_linea"],
}
TABLE_NOISE_WORDS = ["item", "ítem", "description", "descripcion", "concepto", "total"]

# --- names near keywords -----------------------------------------------------
SUPPLIER_KEYWORDS = ["proveedor", "razón social", "nombre del emisor", "company name", "sold by"]
CUSTOMER_KEYWORDS = [
    "cliente", "razón social cliente", "nombre del receptor", "billed to", "ship to",
]

# --- structured documents ----------------------------------------------------
INVOICE_XML_MARKERS = ["<Invoice", "<FacturaElectronica", "<DianExtensions>"]

# --- storage -----------------------------------------------------------------
MISSING_SENTINELS = ["No encontrado", ""]
REQUIRED_FIELDS = ["invoice_number", "date", "total_amount", "items"]
#: Producer field name -> canonical field name.
FIELD_NAMES = {
    "numero_factura": "invoice_number",
    "fecha_emision": "issue_date",
    "fecha_vencimiento": "due_date",
    "hora_emision": "issue_time",
    "monto_subtotal": "subtotal_amount",
    "monto_impuesto": "tax_amount",
    "monto_total": "total_amount",
    "moneda": "currency",
    "nombre_proveedor": "supplier_name",
    "nit_proveedor": "supplier_tax_id",
    "email_proveedor": "supplier_email",
    "nombre_cliente": "customer_name",
    "nit_cliente": "customer_tax_id",
    "cufe": "cufe",
    "metodo_pago": "payment_method",
    "raw_text": "raw_text",
    "file_path": "file_path",
    "asunto_correo": "email_subject",
    "remitente_correo": "email_sender",
    "correo_cliente": "customer_email",
}
#: Producer item field name -> canonical item field name.
ITEM_FIELD_NAMES = {
    "descripcion": "description",
    "cantidad": "quantity",
    "precio_unitario": "unit_price",
    "total_linea": "line_total",
}
#: Header fields a correction may change.
CORRECTABLE_FIELDS = [
    "invoice_number", "issue_date", "due_date", "subtotal_amount", "tax_amount",
    "total_amount", "currency", "supplier_name", "supplier_tax_id", "customer_name",
    "customer_tax_id", "cufe", "payment_method", "email_subject", "email_sender",
    "customer_email",
]
AMOUNT_FIELDS = ["subtotal_amount", "tax_amount", "total_amount"]
DATE_FIELDS = ["issue_date", "due_date"]
ITEM_NUMBER_FIELDS = ["quantity", "unit_price", "line_total"]
#: Spellings of the three item correction kinds.
CORRECTION_KINDS = {
    "update": ["update", "actualizar", "item_field_correction"],
    "add": ["add", "añadir", "add_item"],
    "delete": ["delete", "eliminar", "delete_item"],
}

# --- combining and learning --------------------------------------------------
EXTRACTOR_RANK = {"regex": 3, "nlp": 2, "ocr": 1, "pdf_direct": 0}
LEARN_THRESHOLD = 5
PATTERN_FIELDS = ["invoice_number"]
TERM_FIELDS = ["supplier_name", "customer_name", "supplier_tax_id", "customer_tax_id"]
SIMILARITY_THRESHOLD = 0.7

#: Fixed shape of a learned term that is a tax id.
TERM_TAX_ID = r"^\d{5,20}-?\d+$"
