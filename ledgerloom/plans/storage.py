"""Queries over the invoice store and its correction logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import corrections as corr, documents, store
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registry import query
from ledgerloom.plans.scalars import day
from ledgerloom.session import spread, work_dir
from ledgerloom.sources import versions
from ledgerloom.sources.catalog import table
from ledgerloom.sources.snapshots import empty

#: Re-ingested documents: few paths, so each one is hot.
INCOMING = [
    "event_id + 1 AS seq",
    "CASE WHEN event_type = 'error' THEN concat('n/', user_id, '-', get_json_object(props, '$.k')) "
    "ELSE concat('f/', user_id) END AS file_path",
    "concat(event_type, '-', get_json_object(props, '$.k')) AS invoice_number",
    "value AS total_amount",
    "CASE WHEN event_type <> 'view' THEN concat('S', user_id) END AS supplier_name",
]
INCOMING_SQL = """
  SELECT event_id + 1 AS seq, event_type,
    CASE WHEN event_type = 'error' THEN 'n/' || user_id || '-' || (props->>'$.k') ELSE 'f/' || user_id END AS file_path,
    event_type || '-' || (props->>'$.k') AS invoice_number, value AS total_amount,
    CASE WHEN event_type <> 'view' THEN 'S' || user_id END AS supplier_name
  FROM events"""


@query(f"""
WITH e AS (SELECT o_orderkey AS id, 'f/' || o_orderkey AS file_path, 'FV-' || o_orderkey AS invoice_number,
    o_totalprice AS total_amount, o_orderpriority AS supplier_name FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seq DESC) AS rn FROM ({INCOMING_SQL})) WHERE rn = 1)
SELECT coalesce(e.id, (SELECT max(id) FROM e) + n.seq) AS id, coalesce(e.file_path, n.file_path) AS file_path,
  CASE WHEN n.seq IS NULL THEN e.invoice_number ELSE n.invoice_number END AS invoice_number,
  CASE WHEN n.seq IS NULL THEN e.total_amount ELSE n.total_amount END AS total_amount,
  CASE WHEN n.seq IS NULL THEN e.supplier_name ELSE n.supplier_name END AS supplier_name,
  CASE WHEN n.seq IS NULL THEN 'keep' WHEN e.id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM e FULL JOIN n ON e.file_path = n.file_path""")
def invoice_upsert(spark: SparkSession, folder: str) -> DataFrame:
    existing = table(spark, folder, "orders").where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS id", "concat('f/', o_orderkey) AS file_path", "concat('FV-', o_orderkey) AS invoice_number",
        "o_totalprice AS total_amount", "o_orderpriority AS supplier_name",
    )
    return store.upsert(existing, table(spark, folder, "events").selectExpr(*INCOMING))


@query("""
SELECT o_orderkey, CASE WHEN c_nationkey < 20 THEN c_custkey ELSE -1 END AS user_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def user_attach(spark: SparkSession, folder: str) -> DataFrame:
    invoices = table(spark, folder, "orders").selectExpr("o_orderkey", "concat('c', o_custkey, '@example.com') AS customer_email")
    users = table(spark, folder, "customer").where("c_nationkey < 20").selectExpr(
        "c_custkey AS id", "concat('c', c_custkey, '@example.com') AS email"
    )
    return store.attach_user(invoices, users, default_user=-1).drop("customer_email")


@query(f"""
WITH c AS ({fx.HEADER_CORRECTIONS_SQL}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, field ORDER BY corrected_at DESC, id DESC) AS rn FROM c) WHERE rn = 1)
SELECT o_orderkey AS id, coalesce(n.corrected_value, 'FV-' || o_orderkey) AS invoice_number,
  strftime(coalesce(strptime(d.corrected_value, '%d/%m/%Y'), o_orderdate), '%Y-%m-%d') AS issue_date,
  coalesce(CAST(replace(t.corrected_value, ',', '.') AS DOUBLE), o_totalprice) AS total_amount,
  coalesce(m.corrected_value, 'COP') AS currency, coalesce(s.corrected_value, o_orderpriority) AS supplier_name
FROM orders
LEFT JOIN l n ON n.invoice_id = o_orderkey AND n.field = 'invoice_number'
LEFT JOIN l d ON d.invoice_id = o_orderkey AND d.field = 'issue_date'
LEFT JOIN l t ON t.invoice_id = o_orderkey AND t.field = 'total_amount'
LEFT JOIN l m ON m.invoice_id = o_orderkey AND m.field = 'currency'
LEFT JOIN l s ON s.invoice_id = o_orderkey AND s.field = 'supplier_name'""")
def header_overlay(spark: SparkSession, folder: str) -> DataFrame:
    invoices = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "concat('FV-', o_orderkey) AS invoice_number", "cast(o_orderdate AS date) AS issue_date",
        "o_totalprice AS total_amount", "'COP' AS currency", "o_orderpriority AS supplier_name",
    )
    out = store.apply_header_corrections(invoices, fx.header_corrections(spark, folder))
    return out.withColumn("issue_date", day("issue_date"))


_SEQ = "(l_partkey * 1000003 + l_suppkey) * 64 + cast(l_quantity AS int)"


@query(f"""
WITH i AS (SELECT *, {_SEQ} AS seq, l_returnflag || l_linestatus AS what FROM lineitem),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_tax ORDER BY seq DESC) AS rn FROM i) WHERE rn = 1),
d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_tax FROM i WHERE what = 'RF'),
u AS (SELECT l_orderkey, l_linenumber, l_tax, max(seq) AS useq, arg_max(l_extendedprice, seq) AS price FROM i WHERE what = 'AF' GROUP BY ALL),
live AS (SELECT b.* FROM b ANTI JOIN d USING (l_orderkey, l_linenumber, l_tax)),
a AS (SELECT l_orderkey, l_linenumber, l_tax, arg_min(l_extendedprice, seq) AS price FROM i WHERE what = 'NF' GROUP BY ALL),
x AS (SELECT l_orderkey, l_linenumber, l_tax, arg_min(l_extendedprice, seq) AS price FROM i WHERE what = 'NO' GROUP BY ALL)
SELECT live.l_orderkey AS invoice_id, CASE WHEN u.useq IS NULL THEN 'Parte ' ELSE 'Nueva ' END || live.l_linenumber AS description,
  CASE WHEN u.useq IS NULL THEN 1.0 ELSE 1234.5 END::DOUBLE AS quantity, live.l_tax AS unit_price,
  CASE WHEN u.useq IS NULL THEN live.l_extendedprice ELSE u.price END AS line_total
FROM live LEFT JOIN u USING (l_orderkey, l_linenumber, l_tax)
UNION ALL
SELECT l_orderkey, 'Parte ' || l_linenumber, 1.0, l_tax, price FROM a ANTI JOIN live USING (l_orderkey, l_linenumber, l_tax)
UNION ALL
SELECT l_orderkey, 'Extra ' || l_linenumber, 1.0, l_tax, price FROM x""")
def item_overlay(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = spread(table(spark, folder, "lineitem"))
    items = lineitem.selectExpr(
        "l_orderkey AS invoice_id", f"{_SEQ} AS seq", "concat('Parte ', l_linenumber) AS description",
        "1.0D AS quantity", "l_tax AS unit_price", "l_extendedprice AS line_total",
    )
    payload = "to_json(named_struct('description', concat('{0}', l_linenumber), 'quantity', {1}, 'unit_price', l_tax, 'line_total', l_extendedprice))"
    log = lineitem.withColumn("what", F.expr("concat(l_returnflag, l_linestatus)")).where("what <> 'RO'").selectExpr(
        "l_orderkey AS invoice_id", f"{_SEQ} AS id",
        "CASE WHEN what = 'RF' THEN 'eliminar' WHEN l_returnflag = 'A' THEN 'actualizar' ELSE 'añadir' END AS kind",
        "CASE WHEN what = 'AF' THEN l_partkey END AS original_item_id",
        "'description' AS field",
        f"CASE WHEN l_returnflag <> 'N' THEN {payload.format(' PARTE ', '1.0D')} END AS original_value",
        f"""CASE what WHEN 'AF' THEN {payload.format('Nueva ', "'1.234,5'")} WHEN 'AO' THEN {payload.format('Nunca ', '1.0D')}
            WHEN 'NF' THEN {payload.format('Parte ', '1.0D')} WHEN 'NO' THEN {payload.format('Extra ', '1.0D')} END AS corrected_value""",
    )
    return corr.overlay_items(items, log)


@query("""
SELECT o_orderkey AS id, o_totalprice AS total_amount, l_linenumber AS line_no, l_partkey AS part, l_quantity AS quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def invoice_with_items(spark: SparkSession, folder: str) -> DataFrame:
    invoices = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS total_amount")
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS invoice_id", "l_linenumber AS line_no", "l_partkey AS part", "l_quantity AS quantity"
    )
    return store.with_items(invoices, items)


@query("""
WITH live AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT 'invoices' AS source, o_orderkey AS invoice_id, 1 AS n FROM live
UNION ALL SELECT 'invoice_items', l_orderkey, count(*) FROM lineitem SEMI JOIN live ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT 'field_corrections', user_id, count(*) FROM events SEMI JOIN live ON user_id = o_orderkey WHERE event_type <> 'error' GROUP BY ALL
UNION ALL SELECT 'item_corrections', user_id, count(*) FROM events SEMI JOIN live ON user_id = o_orderkey WHERE event_type = 'error' GROUP BY ALL""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    orders, events = table(spark, folder, "orders"), table(spark, folder, "events")
    left = store.cascade_delete(
        {
            "invoices": orders.selectExpr("o_orderkey AS id"),
            "invoice_items": table(spark, folder, "lineitem").selectExpr("l_orderkey AS invoice_id"),
            "field_corrections": events.where("event_type <> 'error'").selectExpr("user_id AS invoice_id"),
            "item_corrections": events.where("event_type = 'error'").selectExpr("user_id AS invoice_id"),
        },
        orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey AS invoice_id"),
    )
    counts = [
        df.groupBy(F.col(df.columns[0]).alias("invoice_id")).agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query("""
SELECT l_orderkey AS invoice_id, 'Parte ' || l_partkey AS description, l_quantity AS quantity FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 'Nuevo', 1.0 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def items_replace(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS invoice_id", "concat('Parte ', l_partkey) AS description", "l_quantity AS quantity"
    )
    new = orders.where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS invoice_id", "'Nuevo' AS description", "1.0D AS quantity")
    return store.replace_items(items, orders.selectExpr("o_orderkey AS invoice_id"), new)


@query("""
SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS invoice_number, o_totalprice AS total_amount FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
WHERE invoice_number IN (SELECT user_id FROM events)""")
def invoice_lookup(spark: SparkSession, folder: str) -> DataFrame:
    invoices = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "o_custkey AS invoice_number", "o_totalprice AS total_amount")
    wanted = table(spark, folder, "events").selectExpr("user_id AS invoice_number")
    return store.lookup(invoices, wanted, "invoice_number")


@query("""
SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT user_id FROM events)""")
def invoice_children(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").selectExpr("l_orderkey AS invoice_id", "l_linenumber AS line_no", "l_partkey AS part")
    return store.children(items, table(spark, folder, "events").selectExpr("user_id AS invoice_id"))


@query(f"""
SELECT invoice_id, field, id, original_value, corrected_value, corrected_at FROM ({fx.HEADER_CORRECTIONS_SQL})
QUALIFY row_number() OVER (PARTITION BY invoice_id, field ORDER BY corrected_at DESC, id DESC) = 1""")
def correction_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return corr.upsert_corrections(fx.header_corrections(spark, folder))


@query(f"""
WITH i AS ({fx.ITEMS_SQL}), c AS ({fx.ITEM_CHANGES_SQL}),
l AS (SELECT item_id, arg_max(corrected_value, id) FILTER (field = 'description') AS d,
  arg_max(corrected_value, id) FILTER (field = 'quantity') AS q, arg_max(corrected_value, id) FILTER (field = 'unit_price') AS p,
  arg_max(corrected_value, id) FILTER (field = 'line_total') AS t FROM c GROUP BY item_id)
SELECT i.id, invoice_id, coalesce(d, description) AS description, coalesce(CAST(q AS DOUBLE), quantity) AS quantity,
  coalesce(CAST(replace(p, ',', '.') AS DOUBLE), unit_price) AS unit_price, coalesce(CAST(replace(t, ',', '.') AS DOUBLE), line_total) AS line_total
FROM i LEFT JOIN l ON i.id = l.item_id""")
def item_update(spark: SparkSession, folder: str) -> DataFrame:
    return corr.update_items(fx.stored_items(spark, folder), fx.item_changes(spark, folder))


@query(f"""
WITH i AS ({fx.ITEMS_SQL}), c AS ({fx.ITEM_CHANGES_SQL}),
l AS (SELECT item_id, arg_max(corrected_value, id) FILTER (field = 'description') AS d,
  arg_max(corrected_value, id) FILTER (field = 'quantity') AS q, arg_max(corrected_value, id) FILTER (field = 'unit_price') AS p,
  arg_max(corrected_value, id) FILTER (field = 'line_total') AS t FROM c GROUP BY item_id)
SELECT i.id, invoice_id, coalesce(d, description) AS description, coalesce(CAST(q AS DOUBLE), quantity) AS quantity,
  coalesce(CAST(replace(p, ',', '.') AS DOUBLE), unit_price) AS unit_price, coalesce(CAST(replace(t, ',', '.') AS DOUBLE), line_total) AS line_total
FROM i LEFT JOIN l ON i.id = l.item_id""")
def item_field_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Logged scalar changes of item fields, replayed by item id; payload rows are left to the overlay."""
    log = fx.item_changes(spark, folder).selectExpr(
        "id", "'item_field_correction' AS kind", "item_id AS original_item_id", "field", "corrected_value"
    )
    payloads = log.selectExpr("id + 1000000000 AS id", "kind", "original_item_id", "'description' AS field", "'{\"description\": \"x\"}' AS corrected_value")
    return corr.replay_item_fields(fx.stored_items(spark, folder), log.unionByName(payloads))


_REQUESTS = [
    "event_id + 1 AS request_id", "user_id AS invoice_id", "event_type AS description",
    "get_json_object(props, '$.k') AS quantity", "replace(cast(cast(value AS decimal(18,2)) AS string), '.', ',') AS unit_price",
    "CASE WHEN event_type = 'view' THEN '1.234,5' END AS line_total",
]
_ADDED_SQL = f"""
  SELECT (SELECT max(id) FROM ({fx.ITEMS_SQL})) + event_id + 1 AS id, user_id AS invoice_id, event_type AS description,
    CAST(props->>'$.k' AS DOUBLE) AS quantity, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS unit_price,
    CASE WHEN event_type = 'view' THEN 1234.5::DOUBLE END AS line_total FROM events"""


@query(f"SELECT * FROM ({fx.ITEMS_SQL}) UNION ALL SELECT * FROM ({_ADDED_SQL})")
def item_add(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "events").selectExpr(*_REQUESTS)
    return corr.add_items(fx.stored_items(spark, folder), requests)[0]


@query(f"""
SELECT invoice_id, id AS original_item_id, 'add' AS kind, CAST(to_json({{'description': description, 'quantity': quantity,
  'unit_price': unit_price, 'line_total': line_total}}) AS VARCHAR) AS corrected_value FROM ({_ADDED_SQL})""")
def item_add_audit(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "events").selectExpr(*_REQUESTS)
    return corr.add_items(fx.stored_items(spark, folder), requests)[1]


@query(f"""
WITH j AS (SELECT i.*, c.item_id, c.field, c.corrected_value FROM ({fx.ITEMS_SQL}) i JOIN ({fx.ITEM_CHANGES_SQL}) c ON i.id = c.item_id)
SELECT invoice_id, item_id, field, CASE field WHEN 'description' THEN description WHEN 'quantity' THEN CAST(quantity AS VARCHAR)
    WHEN 'unit_price' THEN CAST(unit_price AS VARCHAR) ELSE CAST(line_total AS VARCHAR) END AS original_value, corrected_value
FROM j
WHERE CASE field WHEN 'description' THEN description IS DISTINCT FROM corrected_value
  WHEN 'quantity' THEN quantity IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE)
  WHEN 'unit_price' THEN unit_price IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE)
  ELSE line_total IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE) END""")
def item_change_audit(spark: SparkSession, folder: str) -> DataFrame:
    return corr.change_audit(fx.stored_items(spark, folder), fx.item_changes(spark, folder))


@query(f"SELECT * FROM ({fx.ITEMS_SQL}) WHERE id NOT IN (SELECT user_id FROM events)")
def item_delete(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "events").selectExpr("user_id AS item_id")
    return corr.delete_items(fx.stored_items(spark, folder), doomed)[0]


@query(f"""
SELECT invoice_id, id AS original_item_id, 'delete' AS kind, CAST(to_json({{'id': id, 'invoice_id': invoice_id, 'description': description,
  'quantity': quantity, 'unit_price': unit_price, 'line_total': line_total}}) AS VARCHAR) AS original_value
FROM ({fx.ITEMS_SQL}) WHERE id IN (SELECT user_id FROM events)""")
def item_delete_audit(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "events").selectExpr("user_id AS item_id")
    return corr.delete_items(fx.stored_items(spark, folder), doomed)[1]


@query(f"""
SELECT invoice_id, item_id AS original_item_id, 'update' AS kind, field, original_value, corrected_value, TIMESTAMP '2025-01-01' AS corrected_at FROM (WITH j AS (SELECT i.*, c.item_id, c.field, c.corrected_value FROM ({fx.ITEMS_SQL}) i JOIN ({fx.ITEM_CHANGES_SQL}) c ON i.id = c.item_id)
SELECT invoice_id, item_id, field, CASE field WHEN 'description' THEN description WHEN 'quantity' THEN CAST(quantity AS VARCHAR)
    WHEN 'unit_price' THEN CAST(unit_price AS VARCHAR) ELSE CAST(line_total AS VARCHAR) END AS original_value, corrected_value
FROM j
WHERE CASE field WHEN 'description' THEN description IS DISTINCT FROM corrected_value
  WHEN 'quantity' THEN quantity IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE)
  WHEN 'unit_price' THEN unit_price IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE)
  ELSE line_total IS DISTINCT FROM CAST(replace(CASE WHEN field <> 'description' THEN corrected_value END, ',', '.') AS DOUBLE) END)
UNION ALL SELECT invoice_id, original_item_id, kind, NULL, NULL, corrected_value, TIMESTAMP '2025-01-01' FROM (SELECT invoice_id, id AS original_item_id, 'add' AS kind, CAST(to_json({{'description': description, 'quantity': quantity,
  'unit_price': unit_price, 'line_total': line_total}}) AS VARCHAR) AS corrected_value FROM ({_ADDED_SQL}))
UNION ALL SELECT invoice_id, original_item_id, kind, NULL, original_value, NULL, TIMESTAMP '2025-01-01' FROM (SELECT invoice_id, id AS original_item_id, 'delete' AS kind, CAST(to_json({{'id': id, 'invoice_id': invoice_id, 'description': description,
  'quantity': quantity, 'unit_price': unit_price, 'line_total': line_total}}) AS VARCHAR) AS original_value
FROM ({fx.ITEMS_SQL}) WHERE id IN (SELECT user_id FROM events))""")
def item_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows of updated, added and deleted items, as rows of the item log (without their ids)."""
    items, events = fx.stored_items(spark, folder), table(spark, folder, "events")
    rows = corr.log_rows(
        empty(spark, "item_corrections"), F.lit("2025-01-01").cast("timestamp_ntz"),
        corr.change_audit(items, fx.item_changes(spark, folder)),
        corr.add_items(items, events.selectExpr(*_REQUESTS))[1],
        corr.delete_items(items, events.selectExpr("user_id AS item_id"))[1],
    )
    return rows.drop("id")


@query(f"""
WITH c AS ({fx.HEADER_CORRECTIONS_SQL})
SELECT id, invoice_id, field, original_value, CASE WHEN o_orderstatus = 'F' THEN 'parche ' || o_custkey ELSE corrected_value END AS corrected_value,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE corrected_at END AS corrected_at
FROM c LEFT JOIN orders ON id = o_orderkey WHERE o_orderstatus IS NULL OR o_orderstatus <> 'P'""")
def correction_log_patch(spark: SparkSession, folder: str) -> DataFrame:
    log, orders = fx.header_corrections(spark, folder), table(spark, folder, "orders")
    patches = orders.where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey AS id", "concat('parche ', o_custkey) AS corrected_value", "o_orderdate AS patched_at"
    )
    removed = orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey AS id")
    return corr.patch_log(log.where("original_value <> 'error'"), log.where("original_value = 'error'"), patches, removed)


@query(f"""
WITH i AS ({fx.ITEMS_SQL}), c AS ({fx.ITEM_CHANGES_SQL}),
l AS (SELECT item_id, arg_max(corrected_value, id) FILTER (field = 'description') AS d,
  arg_max(corrected_value, id) FILTER (field = 'quantity') AS q, arg_max(corrected_value, id) FILTER (field = 'unit_price') AS p,
  arg_max(corrected_value, id) FILTER (field = 'line_total') AS t FROM c GROUP BY item_id)
SELECT i.id, invoice_id, coalesce(d, description) AS description, coalesce(CAST(q AS DOUBLE), quantity) AS quantity,
  coalesce(CAST(replace(p, ',', '.') AS DOUBLE), unit_price) AS unit_price, coalesce(CAST(replace(t, ',', '.') AS DOUBLE), line_total) AS line_total
FROM i LEFT JOIN l ON i.id = l.item_id""")
def item_identity_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected items are extracted again, without ids: they get their ids back, and with them all corrections."""
    extracted = fx.stored_items(spark, folder)
    changes = fx.item_changes(spark, folder)
    before = changes.join(extracted.withColumnRenamed("id", "item_id"), "item_id")
    original = F.expr("CASE field WHEN 'description' THEN description WHEN 'quantity' THEN string(quantity) "
                      "WHEN 'unit_price' THEN string(unit_price) ELSE string(line_total) END")
    log = before.select(
        "id", "invoice_id", F.lit("update").alias("kind"), F.col("item_id").alias("original_item_id"), "field",
        original.alias("original_value"), "corrected_value",
    )
    fresh = extracted.withColumnRenamed("id", "seq")
    return corr.replay_on_extracted(corr.update_items(extracted, changes), fresh, log)


#: A batch of documents with two items each.
_RECORD = ["concat('f/', o_orderkey) AS file_path", "o_orderkey AS seq", "concat('FV-', o_orderkey) AS invoice_number"]


def _record_items(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "concat('f/', o_orderkey) AS file_path",
        "inline(array(named_struct('line_no', 1, 'description', concat('Parte ', o_custkey), 'quantity', 2.0D, 'unit_price', o_totalprice, 'line_total', 2 * o_totalprice),"
        " named_struct('line_no', 2, 'description', 'Flete', 'quantity', 1.0D, 'unit_price', 10.0D, 'line_total', 10.0D)))",
    )


@query("""
SELECT 'f/' || o_orderkey AS file_path, 'FV-' || o_orderkey AS invoice_number, 'COP' AS currency,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS total_amount,
  CASE WHEN o_orderstatus = 'F' THEN 'segundo ' ELSE 'primero ' END || o_orderkey AS raw_text,
  2 AS n_items, 2 AS n_ids, CASE WHEN o_orderstatus = 'F' THEN 2 * (o_totalprice + 1) ELSE 2 * o_totalprice END + 10 AS items_total
FROM orders WHERE o_orderstatus <> 'P'""")
def snapshot_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches committed as versions, and a third that was written but not committed, which nobody sees."""
    base = work_dir(spark, "snapshot_commit")
    orders = spread(table(spark, folder, "orders"))
    none = spark.createDataFrame([], "id BIGINT, email STRING")
    logs = empty(spark, "field_corrections"), empty(spark, "item_corrections")

    def batch(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
        records = rows.selectExpr(*_RECORD, "o_totalprice AS total_amount", "'COP' AS currency", f"concat('{text} ', o_orderkey) AS raw_text")
        return records, _record_items(rows)

    documents.commit_batch(spark, base, *batch(orders.where("o_orderstatus <> 'P'"), "primero"), none, *logs)
    again = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    version = documents.commit_batch(spark, base, *batch(again, "segundo"), none, *logs)
    versions.write(orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey AS id", *_RECORD), base, "invoices", "file_path")
    now = versions.latest(spark, base)
    assert now == version
    invoices = versions.read(spark, now, "invoices", documents.INVOICES)
    items = versions.read(spark, now, "items", f"{documents.ITEMS}, file_path STRING").groupBy("file_path").agg(
        F.count("*").alias("n_items"), F.count_distinct("id").alias("n_ids"), F.sum("line_total").alias("items_total")
    )
    texts = versions.read(spark, now, "texts", documents.TEXTS)
    return invoices.select("file_path", "invoice_number", "currency", "total_amount").join(items, "file_path").join(texts, "file_path")


def _batch_of_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, cells and messages of documents of as many items as an order has lines.

    Orders of status F come as XML, those of O as text, those of P as text with a table
    that says more than the text; a document that says nothing comes for each customer.
    """
    orders = fx.orders_with_amounts(spread(table(spark, folder, "orders")))
    price = "cast(l_extendedprice AS decimal(18,2))"
    lines = spread(table(spark, folder, "lineitem")).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey * 1000003 + l_suppkey AS code", "concat('Parte ', l_partkey, ' de P', l_suppkey) AS what",
        "cast(l_quantity AS int) AS n", f"{price} AS price",
    )
    # Lines are shuffled as they are; only the text that the kind of document shows is made of them.
    texts = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("what", "n", "price")).alias("lines"))
    printed = "array_join(array_sort(transform(lines, x -> concat(x.what, ' ', x.n, ' ', x.price))), '\n')"
    xml_lines = f"array_join(transform(lines, x -> {fx.XML_LINE}), '')"
    head = f"concat('Número de factura: FV-', o_orderkey, '\nFecha: ', {fx.DATE_TEXT}, '\nTOTAL A PAGAR: $ ', total, '\n')"
    section = "'Descripción Cantidad Valor Unitario 1\n'"
    documents_ = orders.join(texts, orders["o_orderkey"] == texts["l_orderkey"], "left").selectExpr(
        "o_orderkey AS doc_key",
        f"""CASE o_orderstatus
          WHEN 'F' THEN named_struct('member_no', 1, 'kind', 'xml', 'payload', concat(replace({fx.invoice_xml()}, '</Invoice>', ''), coalesce({xml_lines}, ''), '</Invoice>'))
          WHEN 'O' THEN named_struct('member_no', 1, 'kind', 'pdf', 'payload', concat({section}, coalesce({printed}, ''), '\nSubtotal 1\n', {head}))
          ELSE named_struct('member_no', 1, 'kind', 'pdf', 'payload', concat({section}, IF(lines IS NULL, '', 'Fantasma 9 9'), '\nSubtotal 1\n', {head})) END AS m""",
    ).select("doc_key", "m.*")
    silent = table(spark, folder, "customer").selectExpr("-c_custkey - 1 AS doc_key", "1 AS member_no", "'pdf' AS kind", "'nada' AS payload")
    tabled = lines.join(orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    cells = tabled.selectExpr(
        "l_orderkey AS doc_key", "l_linenumber AS table_no", "(code * 64 + n) * 64 + cast(price % 64 AS int) AS row_no",
        "inline(array(named_struct('col_no', 0, 'header', 'Descripción', 'value', what), named_struct('col_no', 1, 'header', 'Cantidad', 'value', string(n)),"
        " named_struct('col_no', 2, 'header', 'Precio Unitario', 'value', string(price))))",
    )
    messages = orders.selectExpr(
        "o_orderkey AS doc_key", "concat('f/', o_orderkey) AS file_path", "'ventas@casa-norte.com' AS email_sender",
        "IF(o_custkey % 2 = 0, concat('900.', o_custkey, '-1;EMPRESA ', o_custkey, ';', 'FV-', ';', o_orderkey), 'sin datos') AS email_subject",
        "concat('c', o_custkey, '@example.com') AS customer_email",
    )
    return documents_.unionByName(silent), cells, messages


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, 'Parte ' || l_partkey || ' de P' || l_suppkey AS description, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS quantity,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS unit_price FROM lineitem)
SELECT 'f/' || o_orderkey AS file_path, o_orderkey AS id, 'FV-' || o_orderkey AS invoice_number, o_totalprice AS total_amount,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_custkey % 2 = 0 AND 1 - levenshtein('casa norte', 'empresa ' || o_custkey) / greatest(10, length('empresa ' || o_custkey)) < 0.7
    THEN 'EMPRESA ' || o_custkey ELSE 'Casa Norte' END AS supplier_name,
  CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS user_id, description, quantity, unit_price,
  CAST(CAST(quantity * CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS DOUBLE) AS line_total
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN i ON l_orderkey = o_orderkey""")
def document_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """From members, table cells and messages to the store: every invoice with every item."""
    members, cells, messages = _batch_of_documents(spark, folder)
    records, items = documents.read_batch(members, "doc_key", cells, messages)
    users = table(spark, folder, "customer").selectExpr("c_custkey AS id", "concat('c', c_custkey, '@example.com') AS email")
    base = work_dir(spark, "document_pipeline")
    paths = {name: f"{base}/{name}" for name in ("records", "items")}
    records.withColumn("seq", F.col("doc_key")).drop("kind").write.parquet(paths["records"])
    keys = spark.read.parquet(paths["records"]).select("doc_key", "file_path")
    items.join(keys, "doc_key").drop("doc_key").write.parquet(paths["items"])
    stored = {name: spark.read.parquet(path) for name, path in paths.items()}
    logs = empty(spark, "field_corrections"), empty(spark, "item_corrections")
    now = documents.commit_batch(spark, f"{base}/store", stored["records"], stored["items"], users, *logs)
    invoices = versions.read(spark, now, "invoices", documents.INVOICES).select("file_path", "id", "invoice_number", "total_amount", "supplier_name", "user_id")
    return store.with_items(invoices, versions.read(spark, now, "items", documents.ITEMS)).drop("item_id")
