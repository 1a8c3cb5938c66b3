"""Date columns. All results are calendar dates, so no time zone is involved.

Every accepted shape is rewritten to year-month-day by a chain of replacements
and parsed once; a value that fits no shape stays as it is and parses to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip
from ledgerloom.vocab import MONTHS_EN, MONTHS_ES

_ISO = "yyyy-M-d"
# Fixed shapes, all over 1-2 digit days and months:
_DAY_FIRST = (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$3-$1")
_YEAR_FIRST = (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3")
# Two-digit years: 69-99 belong to the 1900s.
_OLD_SHORT_YEAR = (r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1")
_NEW_SHORT_YEAR = (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$", "20$4-$3-$1")
_WORDED_DE = (r"^(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})$", "$3-$2-$1")
_WORDED = (r"^(\d{1,2})\s+(\p{L}+)\s+(\d{4})$", "$3-$2-$1")


def _rewrite(v: Column, *shapes: tuple[str, str]) -> Column:
    for shape, iso in shapes:
        v = F.regexp_replace(v, shape, F.lit(iso))
    return v


def _month_number() -> Column:
    """Spanish names, English names and their three-letter forms to month numbers."""
    table = {}
    for names in (MONTHS_ES, MONTHS_EN, [m[:3] for m in MONTHS_EN]):
        table.update({name: str(i) for i, name in enumerate(names, start=1)})
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _numeric(v: Column) -> Column:
    return _rewrite(v, _DAY_FIRST, _YEAR_FIRST, _OLD_SHORT_YEAR, _NEW_SHORT_YEAR)


def _worded(v: Column) -> Column:
    parts = F.split(_rewrite(F.lower(v), _WORDED_DE, _WORDED), "-")
    month = F.try_element_at(_month_number(), F.get(parts, F.lit(1)))
    return F.concat(F.get(parts, F.lit(0)), F.lit("-"), month, F.lit("-"), F.get(parts, F.lit(2)))


def date_numeric(c: Column) -> Column:
    """Numeric dates with four- or two-digit years."""
    return F.try_to_date(_numeric(strip(c)), _ISO)


def date_long(c: Column) -> Column:
    """Every date shape a document may print, including month names."""
    v = strip(c)
    return F.try_to_date(F.when(v.rlike(r"\p{L}"), _worded(v)).otherwise(_numeric(v)), _ISO)


def date_iso(c: Column) -> Column:
    return F.try_to_date(strip(c), "yyyy-MM-dd")


def date_storage(c: Column) -> Column:
    """Dates as stored or typed in a correction: ISO, or day first before an optional comma."""
    day_first = _rewrite(strip(F.substring_index(c, ",", 1)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"))
    return F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$|^[^/]*/[^/]*/[^/]*$"), day_first), _ISO)
