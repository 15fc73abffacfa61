"""Hashes, surrogate keys and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_of(**fields: Column) -> Column:
    """A JSON object with its fields in the given order; nulls stay in it."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def json_hash(**fields: Column) -> Column:
    return F.sha2(json_of(**fields), 256)


def surrogate_key(*parts: Column) -> Column:
    """A positive long: the first 15 hex digits of the SHA-256 of the parts, joined by pipes. 0 is kept for Unknown."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def utc_text(ts: Column) -> Column:
    """A time as `2026-05-01 00:00:00+00`."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00'")


def row_json(*names: str) -> Column:
    return json_of(**{n: F.col(n) for n in names})
