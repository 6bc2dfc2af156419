"""Lenient parsing of text, numbers, flags and dates; display formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType

# Plain decimal text. A cast alone would also take Java literals such as '1d'.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_from_text(text: Column) -> Column:
    """Double from decimal text, NULL for anything else."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def soft_int(text: Column) -> Column:
    """Integer from text, rounding half up; NULL when not a number or too large."""
    return F.coalesce(text.try_cast("int"), F.round(number_from_text(text)).try_cast("int"))


def soft_bool(text: Column) -> Column:
    return text.try_cast("boolean")


def lenient_number(df: DataFrame, name: str) -> Column:
    """Number from a numeric or text column; ``'12%'`` is 0.12, bad text is NULL."""
    column = F.col(name)
    if not isinstance(df.schema[name].dataType, StringType):
        number = column.cast("double")
        return F.when(~F.isnan(number), number)
    text = F.trim(column)
    number = number_from_text(F.regexp_replace(text, "%+$", ""))
    return F.when(text.endswith("%"), number / 100).otherwise(number)


def lenient_date(df: DataFrame, name: str) -> Column:
    """Date from a date, timestamp, ``yyyymmdd`` number or ISO text; else NULL."""
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, DateType):
        return column
    if isinstance(kind, NumericType):
        return F.try_to_date(column.cast("bigint").cast("string"), "yyyyMMdd")
    if isinstance(kind, StringType):
        return date_from_text(column)
    return column.cast("date")


def date_from_text(column: Column) -> Column:
    text = F.trim(column)
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))
    return F.coalesce(compact, iso)


def flag(df: DataFrame, name: str) -> Column:
    """0/1 from boolean, number or text; NULL and non-numeric text are 0."""
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, BooleanType):
        return F.coalesce(column.cast("int"), F.lit(0))
    number = lenient_number(df, name) if isinstance(kind, NumericType) else number_from_text(column)
    return F.coalesce((number != 0).cast("int"), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient; NULL when the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def round_scaled(value: Column, digits: int) -> Column:
    """Half-up rounding of the scaled binary value, as SQL engines on doubles do."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """First of ``candidates`` that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)
