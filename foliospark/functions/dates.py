"""Date functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import let, trim

EARLIEST_YEAR = 1950
DAYS_AHEAD = 366


def valid_date(text: Column, now: datetime) -> Column:
    """A real calendar day YYYY-MM-DD, not before 1950 nor more than 366 days ahead of now; else null."""
    latest = (now + timedelta(days=DAYS_AHEAD)).date()

    def checked(t):
        day = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t).try_cast("date")
        return F.when((F.year(day) >= EARLIEST_YEAR) & (day <= F.lit(latest)), t)

    return let(trim(text), checked)


def chosen_date(document: Column, scan: Column, now: datetime) -> tuple[Column, Column]:
    """The document's date, else the scan's, else empty; and which of them it is."""
    own, other = valid_date(document, now), valid_date(scan, now)
    return F.coalesce(own, other, F.lit("")), F.when(own.isNotNull(), "document").when(other.isNotNull(), "scan").otherwise("none")
