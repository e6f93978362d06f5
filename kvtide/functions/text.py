"""Small scalar functions: file names, UTF-8, shortening for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(number: Column, kind: str) -> Column:
    """Six digits, or more if the number has more, and a suffix: 000042.wal."""
    return F.when(number.isNotNull(), F.format_string(f"%06d.{kind}", number))


def shortened(c: Column, width: int) -> Column:
    """At most width characters, the last three of them dots if any were left out."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def to_utf8(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def from_utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")
