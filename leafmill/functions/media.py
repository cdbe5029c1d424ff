"""Durations and dates as feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col, strip


def clock_to_seconds(raw: Column | str) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` in whole seconds; zero and anything else are null."""
    parts = F.transform(F.split(strip(col(raw)), ":"), lambda p: p.try_cast("double"))
    whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: total * 60 + p.cast("bigint"))
    return F.nullif(whole, F.lit(0).cast("bigint"))


def parse_date(text: Column | str) -> Column:
    text = col(text)
    return F.coalesce(*[
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
        for shape, fmt in (
            (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
            (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
        )
    ])
