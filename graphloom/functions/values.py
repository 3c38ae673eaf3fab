"""Small value helpers: JSON that may be plain text, dates, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_or_text(col: Column | str) -> Column:
    """``col`` as JSON text: valid JSON stays, anything else becomes a JSON string."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.try_parse_json(col).isNotNull(), col).otherwise(F.to_json(F.array(col)).substr(F.lit(2), F.length(F.to_json(F.array(col))) - 2))


def as_text(col: Column, kind: str) -> Column:
    """Any value as text: containers as JSON, the rest by a cast."""
    return F.to_json(col) if kind.startswith(("struct", "array", "map")) else col.cast("string")


def date_stamp(ts: Column | str) -> Column:
    """Day of observation as ``dd-MM-yyyy``."""
    return F.date_format(ts, "dd-MM-yyyy")


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two epoch-second values."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return ((end - start) * 1000).cast("bigint")
