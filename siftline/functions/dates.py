"""Publish dates: the found string as a timestamp, and ages against a given time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published(raw: Column) -> Column:
    """ISO date or date-time, offset cut off; null unless it holds T or - and reads as one."""
    cut = F.replace(F.substring_index(F.substring_index(raw, "+", 1), "Z", 1), F.lit("T"), F.lit(" ")).substr(1, 19)
    good = cut.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}(:\d{2}(:\d{2})?)?)?$")
    full = F.rpad(F.when(F.length(cut) == 10, F.concat(cut, F.lit(" 00"))).otherwise(cut), 19, ":00:00")
    full = F.when(F.length(cut) == 13, F.concat(cut, F.lit(":00:00"))).when(F.length(cut) == 16, F.concat(cut, F.lit(":00"))).otherwise(full)
    return F.when(raw.rlike("[T-]") & good, full.try_cast("timestamp_ntz"))


def hours(pub_date: Column, as_of: Column) -> Column:
    """Age in hours; negative for a date to come."""
    return F.timestamp_diff("SECOND", pub_date, as_of) / 3600.0
