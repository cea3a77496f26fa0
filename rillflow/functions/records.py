"""Output records: ``event_time$output_time$count`` under the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_time(time: Column) -> Column:
    """yyyyMMddHHmmss and up to five digits of the second's fraction, without trailing zeros."""
    return F.concat(F.date_format(time, "yyyyMMddHHmmss"), F.regexp_replace(F.date_format(time, "SSSSS"), "0+$", ""))


def output_record(df: DataFrame, key: str, event_time: str, output_time: Column, count: Column | None = None) -> DataFrame:
    """key (0 for null) and value."""
    value = F.concat_ws("$", compact_time(F.col(event_time)), compact_time(output_time), (F.lit(1) if count is None else count).cast("string"))
    return df.select(F.coalesce(F.col(key), F.lit(0)).alias("key"), value.alias("value"))


def parse_compact_time(text: Column) -> Column:
    """Inverse of ``compact_time``."""
    fraction = F.rpad(F.substring(text, 15, 5), 5, "0")
    return F.to_timestamp(F.concat(F.substring(text, 1, 14), F.lit("."), fraction), "yyyyMMddHHmmss.SSSSS")


def parse_record(df: DataFrame, value: str = "value") -> DataFrame:
    """event_time, output_time and event_count of output records, beside the other columns."""
    parts = F.split(value, r"\$")
    return df.withColumns({"event_time": parse_compact_time(parts[0]), "output_time": parse_compact_time(parts[1]), "event_count": parts[2].cast("long")})
