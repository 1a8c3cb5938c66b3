"""Amount columns: locale-aware parsing, derived totals and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip
from ledgerloom.vocab import CURRENCY_MARKS

_PLAIN_NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))$"
_DOTS_BEFORE_DECIMAL_COMMA = r"\.(?=.*,[^.]*$)"
_COMMAS_BEFORE_DECIMAL_DOT = r",(?=.*\.)"
# Of several dots all but the last; after such a one, also a last dot before three digits and more.
_DOTS_BUT_LAST = r"\.(?=.*\.)"
_LAST_DOT_GROUPS = r"^(.*,.*)\.([^.]{3,})$"


def marks_regex(marks: list[str]) -> str:
    return "|".join(m.replace("$", r"\$") for m in marks)


def _marks_of(c: Column) -> Column:
    """What is left of a text without its digits; far cheaper than a regular expression."""
    return F.translate(c, "0123456789", "")


def plain_double(c: Column) -> Column:
    """Double from a dot-decimal string, null for anything else (also for 'nan', '12d').

    Digits with at most one dot are cast at once; only other texts meet the pattern.
    """
    matched = F.regexp_extract(c, _PLAIN_NUMBER, 1)
    return F.when(_marks_of(c).isin("", "."), c).otherwise(matched).try_cast("double")


def _decimal_dot(v: Column) -> Column:
    """Drop grouping marks where both marks occur, then make a comma the decimal dot."""
    no_dots = F.regexp_replace(v, _DOTS_BEFORE_DECIMAL_COMMA, "")
    return F.translate(F.regexp_replace(no_dots, _COMMAS_BEFORE_DECIMAL_DOT, ""), ",", ".")


def _no_grouping_dots(v: Column) -> Column:
    """For text without commas, which here stand for the grouping dots."""
    marked = F.regexp_replace(v, _DOTS_BUT_LAST, ",")
    return F.translate(F.regexp_replace(marked, _LAST_DOT_GROUPS, "$1$2"), ",", "")


def amount_auto(c: Column) -> Column:
    """Amount whose decimal mark is read off the text.

    With both marks the later one is the decimal mark; a lone comma is decimal;
    of several dots the last is decimal only before at most two digits.

    Usual shapes are told by their marks alone: plain, a decimal comma after grouping
    dots, a decimal dot after grouping commas. The rest meets a short chain of
    replacements; every mention of the input is evaluated again where Spark merges
    projections and filters.
    """
    v = F.regexp_replace(strip(c), rf"^(?:{marks_regex(CURRENCY_MARKS)})\s*", "")
    other = plain_double(
        F.when(F.contains(v, F.lit(",")), _decimal_dot(v)).otherwise(_no_grouping_dots(v))
    )
    marks = _marks_of(c)
    return (
        F.when(marks.isin("", "."), c.try_cast("double"))
        .when(marks.isin(",", ".,", "..,", "...,"), F.translate(c, ",.", ".").try_cast("double"))
        .when(marks.isin(",.", ",,.", ",,,."), F.translate(c, ",", "").try_cast("double"))
        .otherwise(other)
    )


def amount_entity(c: Column) -> Column:
    """Amount in a recognised money entity: currency marks may stand anywhere."""
    return plain_double(_decimal_dot(strip(F.regexp_replace(c, marks_regex(CURRENCY_MARKS), ""))))


def amount_es(c: Column) -> Column:
    """Amount typed by a person in Spanish notation: dots group, the comma is decimal."""
    return plain_double(F.translate(strip(c), ",.", "."))


def derived_total(quantity: Column, unit_price: Column, line_total: Column) -> Column:
    """The given total, or quantity times price rounded half up to cents in decimal."""
    product = quantity.cast("decimal(18,6)") * unit_price.cast("decimal(18,6)")
    return F.coalesce(line_total, F.round(product, 2).cast("double"))


def format_currency(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))
