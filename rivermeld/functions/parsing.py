"""Column functions that clean dirty text: dates, durations, numbers, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: date layouts the readings export uses
DATE_LAYOUTS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ssX",
                "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(text: Column | str) -> Column:
    """Timestamp of the first layout that fits; null for anything else."""
    c = F.trim(column(text).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in DATE_LAYOUTS])


def duration_hours(text: Column | str) -> Column:
    """Hours of 'hh:mm:ss', 'N days hh:mm:ss' or 'N day(s), hh:mm:ss'; null when malformed.

    Plain splits and casts: this runs on every row of the returns, where regular expressions cost most.
    """
    c = F.trim(column(text).cast("string"))
    head = F.get(F.split(c, ":"), F.lit(0))
    has_days = head.contains("day")
    days = F.when(has_days, F.substring_index(head, " ", 1).try_cast("int")).otherwise(F.lit(0))
    hours = F.when(has_days, F.substring_index(head, " ", -1)).otherwise(head).try_cast("int")
    minutes = F.get(F.split(c, ":"), F.lit(1)).try_cast("int")
    seconds = F.get(F.split(c, ":"), F.lit(2)).try_cast("double")
    fits = (F.size(F.split(c, ":")) == 3) & (days >= 0) & (hours >= 0) & (minutes >= 0) & (seconds >= 0)
    return F.when(fits, (days * 86400 + hours * 3600 + minutes * 60 + seconds) / 3600)


def number_or_zero(text: Column | str) -> Column:
    """Number in the text, else zero."""
    return F.coalesce(column(text).try_cast("double"), F.lit(0.0))


def clean_name(name: str) -> str:
    """A header cell without line breaks or outer blanks."""
    return " ".join(name.split("\n")).strip()


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])
