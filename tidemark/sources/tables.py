"""Parquet tables of one directory, and small helpers on their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read ``directory/name.parquet``. Times are read as UTC, whatever the session had before."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column | str) -> Column:
    """The timestamp without zone of microseconds since 1970."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_micros(column).cast("timestamp_ntz")


def day_number(column: Column | str) -> Column:
    """Days since 1970 of a date or timestamp, as int."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_date(F.to_date(column))


def day_of(number: Column | str) -> Column:
    """The date of a day number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.date_from_unix_date(number)
