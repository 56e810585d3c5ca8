"""Keys derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest16(position: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(position.cast("string"), F.lit(":"), text), 256), 1, 16)


def doc_id(session: Column, position: Column, text: Column) -> Column:
    """Business key of a turn: session and a digest of position and text."""
    return F.concat(session, F.lit("::"), digest16(position, text))


def numeric_id(doc: Column) -> Column:
    """60-bit integer key of a business key."""
    return F.conv(F.substring(F.sha2(doc, 256), 1, 15), 16, 10).cast("bigint")
