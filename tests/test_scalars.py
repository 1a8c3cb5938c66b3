import datetime as dt

import pytest

from ledgerloom.functions import amounts, dates, text


@pytest.mark.parametrize("shown, value", [
    ("$870.25", 870.25), ("7.081,75", 7081.75), ("1,234.56", 1234.56), ("1.234.567", 1234567.0),
    ("1.234.567,8", 1234567.8), ("1.234.56", 1234.56), ("1." + "0" * 50 + ".000", 1e53), ("12,5", 12.5), ("1,234,567", None), ("EUR 7", 7.0),
    ("1.234", 1.234), ("doce", None), ("", None), (None, None), ("nan", None), ("12d", None), ("5.", 5.0),
    ("1,234.567.890", None), ("  € 3,10\t", 3.1),
])
def test_amount_auto(one, shown, value):
    assert one(shown, amounts.amount_auto) == value


@pytest.mark.parametrize("shown, value", [
    ("$150.75", 150.75), ("150,75 EUR", 150.75), ("1.234.567", None), ("COP 1.234,5", 1234.5), ("mucho", None),
])
def test_amount_entity(one, shown, value):
    assert one(shown, amounts.amount_entity) == value


@pytest.mark.parametrize("shown, value", [("1.234,50", 1234.5), ("1234.56", 123456.0), ("7", 7.0), ("x", None)])
def test_amount_es(one, shown, value):
    assert one(shown, amounts.amount_es) == value


@pytest.mark.parametrize("shown, value", [
    ("23/05/2025", dt.date(2025, 5, 23)), ("2024-01-15", dt.date(2024, 1, 15)), ("15-02-2023", dt.date(2023, 2, 15)),
    ("2024/3/9", dt.date(2024, 3, 9)), ("5 de enero de 2024", dt.date(2024, 1, 5)), ("5 MARZO 2024", dt.date(2024, 3, 5)),
    ("5 Sep 2024", dt.date(2024, 9, 5)), ("5 de Jan de 2024", dt.date(2024, 1, 5)), ("1/2/69", dt.date(1969, 2, 1)),
    ("1/2/68", dt.date(2068, 2, 1)), ("31/02/2024", None), ("invalid-date", None), ("5 de brumario de 2024", None),
    ("", None), (None, None), ("99/99/9999", None), ("5/3-2024", None),
])
def test_date_long(one, shown, value):
    assert one(shown, dates.date_long) == value


@pytest.mark.parametrize("shown, value", [
    ("2024-01-15", dt.date(2024, 1, 15)), ("15/01/2024", dt.date(2024, 1, 15)), ("15/1/2024, 10:30", dt.date(2024, 1, 15)),
    ("2024/01/15", None), ("mañana", None), ("2024-13-15", None),
])
def test_date_storage(one, shown, value):
    assert one(shown, dates.date_storage) == value


@pytest.mark.parametrize("path, stem", [
    ("/a/b/factura.v2.pdf", "factura.v2"), ("/a/.oculto", ".oculto"), ("x", "x"), ("/a.b/c", "c"), ("a..pdf", "a."),
])
def test_file_stem(one, path, stem):
    assert one(path, text.file_stem) == stem


def test_identifiers(one):
    assert one("900.123.456 - 7", text.tax_id) == "9001234567"
    assert one("a.b@c-d.com", text.mailbox_key) == "a_b_c_d_com"
    assert one(" Vr. Total ", text.header_name) == "vr_total"
    assert one("€ 5\u0000\u0001x", text.clean_xml) == "€ 5 x"
    assert one("€ 5\u0000x", text.clean_xml_latin1) == "  5 x"
    assert one("No encontrado", text.sentinel_to_null) is None
    assert [one(c, text.currency_code) for c in ("$", "€", "usd", "Mxn", "clp")] == ["COP", "EUR", "USD", "MXN", "CLP"]


def test_currency_format(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(amounts.format_currency(F.lit(1234.5))).first()[0] == "$1,234.50"


def test_literal_pattern_is_literal(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r"A.B\E(c)",), ("x+y",)], "v STRING")
    found = df.withColumn("p", text.literal_pattern(F.col("v"))).select(F.expr("regexp_extract(concat('>', lower(v), '<'), p, 1)"))
    assert {r[0] for r in found.collect()} == {r"a.b\e(c)", "x+y"}
