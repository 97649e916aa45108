"""Age of data, from its metadata and from event times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import dtype_of, ref
from plumbline.functions.parsing import parse_int

SHORT_YEARS = 5
LONG_YEARS = 15
UNKNOWN = "unknown"


def _known(text: Column) -> Column:
    return F.when((text != "") & (text != UNKNOWN), text)


def year_of(text: Column) -> Column:
    """The year at the start of a date text, NULL if there is none."""
    return parse_int(F.left(_known(text), F.lit(4)))


def currentness_band(age: Column, short: int = SHORT_YEARS, long: int = LONG_YEARS) -> Column:
    """100 within the short limit, 50 within the long one, 0 beyond; NULL without an age."""
    return F.when(age.isNull(), F.lit(None)).when(age <= short, 100.0).when(age <= long, 50.0).otherwise(0.0)


def metadata_age(
    metadata: DataFrame,
    as_of_year: int,
    creation_col: str = "creation_date",
    updated_col: str = "last_updated",
) -> DataFrame:
    """Adds the years and ages of creation and last update to metadata rows.

    Without a last update its date is the creation date; where that gives no
    year, the age since update is that of the creation.
    """
    updated = F.coalesce(F.nullif(ref(updated_col), F.lit("")), ref(creation_col))
    created_year, updated_year = year_of(ref(creation_col)), year_of(updated)
    now = F.lit(as_of_year)
    return metadata.withColumns(
        {
            "creation_year": created_year,
            "creation_age_years": now - created_year,
            "updated_year": updated_year,
            "updated_age_years": now - updated_year,
            "age_since_update_years": now - F.coalesce(updated_year, created_year),
        }
    )


def collection_span(period: Column) -> Column:
    """Years between the first and the last year of a text such as 2018-2021.

    Parts shorter than four characters (months, days) are passed over; one
    unreadable part leaves the span unknown.
    """
    parts = F.filter(
        F.split(F.replace(_known(period), F.lit(" "), F.lit("")), "-"), lambda p: F.length(p) >= 4
    )
    years = F.transform(parts, lambda p: parse_int(F.left(p, F.lit(4))))
    readable = (F.size(years) > 0) & ~F.exists(years, lambda y: y.isNull())
    return F.when(readable, F.element_at(years, -1) - F.element_at(years, 1))


def record_bands(
    df: DataFrame,
    event_time: str,
    as_of_year: int,
    short: int = SHORT_YEARS,
    long: int = LONG_YEARS,
) -> DataFrame:
    """Rows in each currentness band of their event time, and the mean band."""
    band = currentness_band(F.lit(as_of_year) - F.year(ref(event_time)), short, long)
    return df.select(band.alias("band")).agg(
        F.count("band").alias("dated_rows"),
        F.count_if(F.col("band") == 100.0).alias("current_rows"),
        F.count_if(F.col("band") == 50.0).alias("ageing_rows"),
        F.count_if(F.col("band") == 0.0).alias("outdated_rows"),
        F.avg("band").alias("record_currentness"),
    )


def stale_rows(
    df: DataFrame, event_time: str, as_of: dt.date | str, limit_years: int = SHORT_YEARS
) -> DataFrame:
    """Rows whose event time lies more than the limit before ``as_of``.

    The bound is a literal of the column's own type, so it reaches the scan.
    """
    bound = F.add_months(F.lit(str(as_of)).cast("date"), -12 * limit_years)
    return df.filter(ref(event_time) < bound.cast(dtype_of(df, event_time)))
