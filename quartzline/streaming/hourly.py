"""Hourly last values of a stream: an extension, which keeps a history up to date while rows arrive.

An hour's row comes out once the watermark has passed the hour, so the state holds the open hours only, one row for each
key. Rows that are later than ``late`` are left out, as the watermark does it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_hour(rows: DataFrame, keys: list[str], time_col: str, value_cols: list[str], tie_col: str, late: str = "1 hour") -> DataFrame:
    """keys, hour (its start) and the values of the hour's last row by time, then by ``tie_col``; for streams and tables alike.

    Rows without a time are left out; a null key is a key of its own, and a null value of the last row stays null.
    """
    last = F.max_by(F.struct(*value_cols), F.struct(time_col, tie_col)).alias("last")
    grouped = rows.filter(F.col(time_col).isNotNull()).withWatermark(time_col, late).groupBy(*keys, F.window(time_col, "1 hour")).agg(last)
    return grouped.select(*keys, F.col("window.start").alias("hour"), "last.*")
