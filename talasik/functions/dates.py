"""Loosely written dates and times as ISO text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talasik.functions.text import strip, strip_citations

#: Values that state no date (fixed values).
NO_DATE = ("", "not indicated", "n/a", "na", "unknown", "unspecified")
#: Day formats read natively, month first (fixed values).
FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy", "MMM-d-yyyy", "MMMM-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy")


def _parsed(text: pd.Series) -> pd.Series:
    def one(t):
        d = pd.to_datetime(t, errors="coerce") if t else pd.NaT
        return None if pd.isna(d) else d.strftime("%Y-%m-%d")

    return text.map(one)


def normalize_date(column: Column, fallback: bool = False) -> Column:
    """YYYY-MM-DD or NULL; day first only where the first number can be no month.

    Native formats cover what logbooks hold; with `fallback`, pandas reads what they don't, in a UDF.
    """
    text = strip_citations(column)
    told = F.when(~F.lower(text).isin(*NO_DATE), F.initcap(F.regexp_replace(text, r"\.", "")))
    read = F.coalesce(*[F.try_to_timestamp(told, F.lit(f)) for f in FORMATS])
    swapped = F.try_to_timestamp(F.regexp_replace(told, r"^(1[3-9]|2\d|3[01])([-/])(\d{1,2})([-/]\d{4})$", "$3$2$1$4"), F.lit("M/d/yyyy"))
    swapped = F.coalesce(swapped, F.try_to_timestamp(F.regexp_replace(told, r"^(1[3-9]|2\d|3[01])-(\d{1,2})-(\d{4})$", "$2-$1-$3"), F.lit("M-d-yyyy")))
    native = F.date_format(F.coalesce(read, swapped), "yyyy-MM-dd")
    return F.coalesce(native, F.pandas_udf(_parsed, "string")(told)) if fallback else native


def normalize_time(column: Column) -> Column:
    """HH:MM or NULL: HH:MM stays unchecked, H:MM with or without AM and PM, HHMM."""
    text = strip(column)
    parts = r"(?i)^(\d{1,2}):(\d{2})\s*(AM|PM)?$"
    hour, half = F.regexp_extract(text, parts, 1).try_cast("int"), F.upper(F.regexp_extract(text, parts, 3))
    hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return (
        F.when(text.rlike(r"^\d{2}:\d{2}$"), text)
        .when(text.rlike(parts), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(text, parts, 2)))
        .when(text.rlike(r"^\d{4}$"), F.concat(F.substring(text, 1, 2), F.lit(":"), F.substring(text, 3, 2)))
    )


def _day(column: Column) -> Column:
    return F.when(column.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(column, F.lit("yyyy-M-d")))


def month_of(column: Column) -> Column:
    """1 to 12, 0 where the text is no ISO day."""
    return F.coalesce(F.month(_day(column)), F.lit(0))


def weekday_of(column: Column) -> Column:
    """0 for Monday to 6, -1 where the text is no ISO day."""
    return F.coalesce(F.weekday(_day(column)), F.lit(-1))


def period_of(column: Column) -> Column:
    """Late Night 22-5, Morning 6-11, Afternoon 12-17, Evening 18-21, else Unknown."""
    hour = F.when(F.substring(column, 1, 5).rlike(r"^([01]?\d|2[0-3]):[0-5]\d$|^([01]?\d|2[0-3]):[0-5]$"), F.regexp_extract(column, r"^(\d{1,2}):", 1).cast("int"))
    return F.when(hour.isNull(), "Unknown").when((hour >= 22) | (hour < 6), "Late Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")
