"""Text columns: trimming, identifiers, names and payloads."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.once import filled_once
from ledgerloom.vocab import MISSING_SENTINELS

#: Letters that equal an ASCII one regardless of case, besides its capital, and that one.
_FOLDS = ("\u0130\u0131\u017f\u212a", "iisk")


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends (plain ``trim`` only drops blanks)."""
    return F.btrim(c, F.lit(" \t\r\n"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sentinel_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_SENTINELS), c)


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any word occurs; plain substring search beats one large pattern."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def folded(c: Column) -> Column:
    """Lower case in which letters are equal wherever a case-insensitive pattern takes them as equal."""
    odd = contains_any(c, list(_FOLDS[0]))
    return F.lower(F.when(odd, F.translate(c, *_FOLDS)).otherwise(c))


def rarest_words(phrases: list[str]) -> list[str]:
    """Words of which a text holds one if it holds one of the phrases, whatever the blanks between their words."""
    longest = {max(p.split(), key=len) for p in phrases}
    return sorted(w for w in longest if not any(o != w and o in w for o in longest))


def ends_with_any(c: Column, suffixes: list[str]) -> Column:
    low = F.lower(c)
    return reduce(or_, [F.endswith(low, F.lit(s)) for s in suffixes])


def tax_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[.\-\s]", "")


def currency_code(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(F.contains(c, F.lit("$")), "COP")
        .when(F.contains(c, F.lit("€")), "EUR")
        .when(F.contains(up, F.lit("USD")), "USD")
        .when(F.contains(up, F.lit("MXN")), "MXN")
        .otherwise(up)
    )


def cufe_from_url(c: Column) -> Column:
    """The document code carried as a query parameter of the tax office's validator URL."""
    return filled_once(
        F.regexp_extract(
            c, r"(?i)https?://(?:www\.)?dian\.gov\.co/validador/\S*\?cufe=([0-9a-f\-]{32,96})", 1
        )
    )


def header_name(c: Column) -> Column:
    """Normalised table column header: lower case, underscores, no dots, plain vowels."""
    return F.translate(F.lower(strip(c)), " áéíóú.", "_aeiou")


def clean_xml(c: Column) -> Column:
    """Drop characters XML does not allow; each run becomes one blank."""
    return F.regexp_replace(c, r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]+", " ")


def clean_xml_latin1(c: Column) -> Column:
    """The stricter cleaning that also drops everything above U+00FF."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x7E\x80-\xFF]+", " ")


def literal_pattern(c: Column) -> Column:
    """A case-insensitive pattern matching the value literally, with one group."""
    quoted = F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iu)(\\Q"), quoted, F.lit("\\E)"))


def file_stem(c: Column) -> Column:
    """File name without folder and last extension; a leading dot is part of the name."""
    name = F.substring_index(c, "/", -1)
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def mailbox_key(c: Column) -> Column:
    """Mailbox address reduced to letters, digits and underscores, safe in a path."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9]", "_")


def item_signature(description: Column, quantity: Column, unit_price: Column) -> list[Column]:
    """The typed key that identifies a line item within its invoice."""
    return [
        F.lower(strip(F.coalesce(description, F.lit("")))).alias("sig_description"),
        quantity.alias("sig_quantity"),
        unit_price.alias("sig_unit_price"),
    ]
