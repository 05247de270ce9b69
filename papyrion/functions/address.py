"""Cell addresses: A1 references, column letters, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(col: Column) -> Column:
    """Column number to letters, bijective base 26, up to three letters."""
    one = lambda n: F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
    rest = lambda n: F.floor((n - 1) / 26).cast("int")
    second, third = rest(col), rest(rest(col))
    return F.concat(F.when(third > 0, one(third)).otherwise(""), F.when(second > 0, one(second)).otherwise(""), one(col))


def column(ref: Column) -> Column:
    """The column number of an A1 reference, 0 if it is malformed."""
    word = F.regexp_extract(ref, r"^([A-Z]+)\d+$", 1)
    digits = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0), lambda a, c: a * 26 + c)


def row(ref: Column) -> Column:
    """The row number of an A1 reference, 0 if it is malformed."""
    return F.coalesce(F.nullif(F.regexp_extract(ref, r"^[A-Z]+(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def reference(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def span(start_row: Column, start_col: Column, end_row: Column, end_col: Column) -> Column:
    """A range such as A1:D9."""
    return F.concat(reference(start_row, start_col), F.lit(":"), reference(end_row, end_col))
