"""Text cleaning, lenient number parsing and labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from regioflux.functions.missing import not_in

# Fixed values.
BLANKS = " \t\r\n"
MISSING_TOKENS = ("N/A", "", "NA")
COUNTY_SUFFIXES = (
    " County",
    " Parish",
    " Borough",
    " Census Area",
    " Municipality",
    " City and Borough",
)

# Decimal or scientific notation. Without it a cast would also accept Java suffixes such as 5d or 5f.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim_blank(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def drop_commas(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(""))


def tokens_to_null(x: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    return F.when(not_in(x, tokens), x)


def to_number(x: Column) -> Column:
    """Text to double; text that is no number becomes null instead of failing the job."""
    text = trim_blank(x.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_count(x: Column) -> Column:
    """A published count such as ' 1,234 ' or 'N/A' to double."""
    return to_number(tokens_to_null(drop_commas(trim_blank(x))))


def strip_suffixes(
    x: Column, suffixes: Sequence[str] = COUNTY_SUFFIXES, longest_first: bool = False
) -> Column:
    """Removes each suffix in turn from the end.

    In the default order ' Borough' goes before ' City and Borough', so 'Sitka City and Borough' ends as
    'Sitka City and'. longest_first=True removes the whole suffix.
    """
    order = sorted(suffixes, key=len, reverse=True) if longest_first else suffixes
    for suffix in order:
        x = F.regexp_replace(x, re.escape(suffix) + "$", "")
    return x


def pad_code(x: Column, digits: int) -> Column:
    """Region code as text with its leading zeros; longer codes stay as they are."""
    text = x.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def number_text(x: Column) -> Column:
    """Number as a label: whole numbers without a decimal point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def thousands(x: Column) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(x, 0)


def paste(*parts: Column | str, sep: str = " ") -> Column:
    """Joins the parts; a missing part prints as NA. Plain strings are taken as text."""
    columns: list[Column] = []
    for part in parts:
        if columns and sep:
            columns.append(F.lit(sep))
        as_column = F.lit(part) if isinstance(part, str) else part.cast("string")
        columns.append(F.coalesce(as_column, F.lit("NA")))
    return F.concat(*columns)


def sanitize_names(names: Sequence[str]) -> list[str]:
    """Header texts to valid column names: other characters become dots, repeats get .1, .2, ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9._]", ".", name)
        if not re.match(r"^([A-Za-z]|\.(?![0-9]))", base):
            base = "X" + base
        candidate, repeat = base, 0
        while candidate in taken:
            repeat += 1
            candidate = f"{base}.{repeat}"
        taken.add(candidate)
        result.append(candidate)
    return result
