"""Queries over the column functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, text
from ledgerloom.operators.header import extract_header
from ledgerloom.plans.fixtures import DATE_TEXT, LINE_KEYS, invoice_texts
from ledgerloom.plans.registry import query
from ledgerloom.session import spread
from ledgerloom.sources.catalog import table


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN floor(l_extendedprice) * 1000000 ELSE l_extendedprice END AS amount,
  CASE WHEN l_linenumber < 6 THEN l_extendedprice END AS entity_amount
FROM lineitem""")
def amount_normalise(spark: SparkSession, folder: str) -> DataFrame:
    shown = spread(table(spark, folder, "lineitem")).selectExpr(*LINE_KEYS, """CASE l_linenumber
        WHEN 1 THEN translate(format_number(l_extendedprice, 2), ',.', '.,')
        WHEN 2 THEN concat(' ', format_number(l_extendedprice, 2), '\t')
        WHEN 3 THEN cast(cast(l_extendedprice AS decimal(18,2)) AS string)
        WHEN 4 THEN replace(cast(cast(l_extendedprice AS decimal(18,2)) AS string), '.', ',')
        WHEN 5 THEN concat('$ ', translate(format_number(l_extendedprice, 2), ',.', '.,'))
        WHEN 6 THEN replace(format_number(floor(l_extendedprice) * 1000000, 0), ',', '.')
        ELSE 'sin valor' END AS shown""")
    return shown.select(
        *LINE_KEYS,
        amounts.amount_auto(F.col("shown")).alias("amount"),
        amounts.amount_entity(F.concat("shown", F.lit(" EUR"))).alias("entity_amount"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount FROM orders""")
def amount_es(spark: SparkSession, folder: str) -> DataFrame:
    typed = F.expr("""CASE o_orderstatus WHEN 'F' THEN translate(format_number(o_totalprice, 2), ',.', '.,')
        WHEN 'O' THEN replace(cast(cast(o_totalprice AS decimal(18,2)) AS string), '.', ',')
        ELSE concat(o_orderkey, ' pesos') END""")
    return table(spark, folder, "orders").select("o_orderkey", amounts.amount_es(typed).alias("amount"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_any,
  CASE WHEN o_orderpriority NOT LIKE '3%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_digits
FROM orders""")
def date_normalise(spark: SparkSession, folder: str) -> DataFrame:
    shown = spread(table(spark, folder, "orders")).selectExpr("o_orderkey", f"{DATE_TEXT} AS shown")
    return shown.select(
        "o_orderkey",
        day(dates.date_long(F.col("shown"))).alias("date_any"),
        day(dates.date_numeric(F.col("shown"))).alias("date_digits"),
    )


@query("""
SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN strftime(o_orderdate, '%Y-%m-%d') END
  AS stored FROM orders""")
def date_storage(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.expr("""CASE left(o_orderpriority, 1) WHEN '1' THEN date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN '2' THEN date_format(o_orderdate, 'dd/MM/yyyy')
        WHEN '3' THEN date_format(o_orderdate, 'dd/MM/yyyy, HH:mm')
        WHEN '4' THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'sin fecha' END""")
    return table(spark, folder, "orders").select("o_orderkey", day(dates.date_storage(shown)).alias("stored"))


@query("""SELECT c_custkey, '900' || c_custkey || c_nationkey AS tax_id FROM customer""")
def tax_id_normalise(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.concat(F.lit("900."), "c_custkey", F.lit(" - "), "c_nationkey")
    return table(spark, folder, "customer").select("c_custkey", text.tax_id(shown).alias("tax_id"))


@query("""
SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'COP' WHEN '2' THEN 'EUR' WHEN '3' THEN 'USD'
  WHEN '4' THEN 'MXN' ELSE 'CLP' END AS currency FROM orders""")
def currency_normalise(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.expr("""CASE left(o_orderpriority, 1) WHEN '1' THEN '$' WHEN '2' THEN '€' WHEN '3' THEN 'usd'
        WHEN '4' THEN 'Mxn' ELSE 'clp' END""")
    return table(spark, folder, "orders").select("o_orderkey", text.currency_code(shown).alias("currency"))


@query("""
SELECT o_orderkey AS doc_key, CASE WHEN o_orderstatus <> 'P' THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS cufe
FROM orders""")
def cufe_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract_header(invoice_texts(spark, folder)).select("doc_key", "cufe")


@query(r"""
SELECT doc_id,
  md5(regexp_replace(text, '[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]+', ' ', 'g')) AS cleaned,
  md5(regexp_replace(text, '[^\t\n\r\x20-\x7E\x{80}-\x{FF}]+', ' ', 'g')) AS cleaned_latin1
FROM documents""")
def xml_clean(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.md5(text.clean_xml(F.col("text"))).alias("cleaned"),
        F.md5(text.clean_xml_latin1(F.col("text"))).alias("cleaned_latin1"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linestatus = 'F' THEN l_extendedprice
    ELSE CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DOUBLE)
  END AS line_total
FROM lineitem""")
def derived_total(spark: SparkSession, folder: str) -> DataFrame:
    given = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))
    total = amounts.derived_total(F.col("l_quantity"), F.col("l_extendedprice"), given)
    return table(spark, folder, "lineitem").select(*LINE_KEYS, total.alias("line_total"))


@query("""SELECT o_orderkey, format('${:,.2f}', o_totalprice) AS shown FROM orders""")
def currency_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", amounts.format_currency(F.col("o_totalprice")).alias("shown")
    )


@query(r"""
SELECT page_id, regexp_replace(split_part(url, '/', -1), '^(\.*[^.].*)\.[^.]*$', '\1') AS stem FROM pages""")
def file_stem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.file_stem(F.col("url")).alias("stem"))


@query("""SELECT c_custkey, replace(c_name, '#', '_') || '_correo_example_com' AS mailbox FROM customer""")
def mailbox_key(spark: SparkSession, folder: str) -> DataFrame:
    address = F.concat("c_name", F.lit("@correo.example.com"))
    return table(spark, folder, "customer").select("c_custkey", text.mailbox_key(address).alias("mailbox"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS BIGINT) END AS k,
  CASE WHEN event_type <> 'error' THEN '{"k":' || (props->>'$.k') || '}' END AS encoded
FROM events""")
def json_payload(spark: SparkSession, folder: str) -> DataFrame:
    stored = F.when(F.col("event_type") == "error", F.lit("{k: ")).otherwise(F.col("props"))
    parsed = F.from_json(stored, "k BIGINT")
    return table(spark, folder, "events").select(
        "event_id", parsed["k"].alias("k"), F.when(parsed["k"].isNotNull(), F.to_json(parsed)).alias("encoded")
    )


@query(r"""
SELECT p_partkey, '(?iu)(\Q' || p_name || '\E)' AS regex, upper(p_name) AS found FROM part""")
def literal_pattern(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("regex", text.literal_pattern(F.col("p_name")))
    shown = F.expr("regexp_extract(concat('Ref. ', upper(p_name), ' fin'), regex, 1)")
    return part.select("p_partkey", "regex", shown.alias("found"))


@query("""
SELECT p_partkey, replace(lower(p_type), '.', '') || '_unitario_' || lower(p_name[1:3]) || 'aeiou' AS header FROM part""")
def header_normalise(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.concat(F.lit(" "), "p_type", F.lit(". Unitario "), F.upper(F.left("p_name", F.lit(3))), F.lit("áéíóÚ\t"))
    return table(spark, folder, "part").select("p_partkey", text.header_name(shown).alias("header"))
