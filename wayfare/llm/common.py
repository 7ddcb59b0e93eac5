"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other letter stays as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def digest(c: Column) -> Column:
    """128 bits of a string, as 16 bytes."""
    return F.unhex(F.md5(c))


def free_name(df: DataFrame, want: str) -> str:
    """`want`, or `want` with underscores added until no column of df bears it."""
    taken = {x.lower() for x in df.columns}
    while want.lower() in taken:
        want += "_"
    return want
