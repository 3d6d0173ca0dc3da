"""Times compare as seconds since 1970 (UTC); those without a zone are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def epoch(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x) / 1e6
    return F.unix_micros(x) / 1e6
