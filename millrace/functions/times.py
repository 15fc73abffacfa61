"""Times of sources, and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import BUSINESS_ZONE, NAIVE


def instant(raw: Column, zone: str = BUSINESS_ZONE) -> Column:
    """A time with an offset, or `2026/05/01 08:00:00` in the business zone."""
    naive = F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit("yyyy/MM/dd HH:mm:ss")), zone)
    return F.when(raw.rlike(NAIVE), naive).otherwise(raw.try_cast("timestamp"))


def business_date(ts: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone).cast("date")


def calendar_parts(day: Column) -> dict[str, Column]:
    iso = F.extract(F.lit("DOW_ISO"), day)
    return {
        "date_sk": F.date_format(day, "yyyyMMdd").cast("int"), "year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "day": F.dayofmonth(day),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day).cast("int"), "iso_week": F.weekofyear(day), "iso_weekday": iso.cast("int"), "year_month": F.date_format(day, "yyyy-MM"),
        "month_name": F.date_format(day, "MMMM"), "weekday_name": F.date_format(day, "EEEE"), "is_weekend": iso >= 6, "month_start": F.trunc(day, "month"), "month_end": F.last_day(day),
        "quarter_start": F.trunc(day, "quarter"), "quarter_end": F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1),
        "is_month_start": day == F.trunc(day, "month"), "is_month_end": day == F.last_day(day), "is_quarter_start": day == F.trunc(day, "quarter"), "is_quarter_end": day == F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1),
        "is_year_start": day == F.trunc(day, "year"), "is_year_end": day == F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1),
    }
