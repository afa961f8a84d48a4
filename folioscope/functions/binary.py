"""Little-endian numbers, NUL-terminated text and UUIDs in binary columns, as plain expressions.

Reading past the end of a value gives null rather than an error or a shorter number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piece(data: Column, start: int | Column, length: int | Column) -> Column:
    """``length`` bytes from ``start`` (from 0); null if they are not all there."""
    s, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.when(F.octet_length(data) >= s + n, F.substring(data, s + 1, n))


def unsigned(data: Column, start: int | Column, width: int) -> Column:
    """A little-endian number of ``width`` bytes, as long; null if it is cut off or doesn't fit in 63 bits."""
    s = start if isinstance(start, Column) else F.lit(start)
    h = F.hex(piece(data, s, width))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])
    value = F.conv(turned, 16, 10).cast("decimal(20,0)")
    return F.when(value < F.lit(str(2**63)).cast("decimal(20,0)"), value.cast("long"))


def uuid_text(data: Column, start: int = 8) -> Column:
    """Sixteen bytes as canonical text."""
    return F.regexp_replace(F.lower(F.hex(piece(data, start, 16))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def nul_list(data: Column) -> Column:
    """NUL-separated Latin-1 strings, up to the first empty one."""
    parts = F.split(F.decode(data, "ISO-8859-1"), "\\x00")
    end = F.array_position(parts, "")
    return F.when(end > 0, F.slice(parts, 1, end.cast("int") - 1)).otherwise(parts)


def trim_nul(text: Column) -> Column:
    """Text without NULs at its end."""
    return F.regexp_replace(text, "\\x00+$", "")
