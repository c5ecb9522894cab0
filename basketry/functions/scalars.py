"""Scalar functions of the retail queries as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default texts and formats of the retail data.
NO_CATEGORY = "Sin categoría"
UNKNOWN_CATEGORY = "Desconocida"
NO_SEGMENT = "Sin clasificar"
UNUSUAL = "Patrón inusual"
REASON_SEPARATOR = " | "
CUSTOMER_PREFIX = "Cliente "
PRODUCT_PREFIX = "Producto "
ITEM_PREFIX = "Item "
LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def text_length(text: Column) -> Column:
    return F.length(text)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def plain(text: Column) -> Column:
    """Collated so that comparison and search ignore case and accents."""
    return F.collate(F.trim(text), "UNICODE_CI_AI")


def contains_plain(text: Column, part: Column) -> Column:
    return F.contains(plain(text), plain(part))


def day_of(stamp: Column) -> Column:
    return F.to_date(stamp)


def date_part(text: Column) -> Column:
    """The part of an ISO text before the time."""
    return F.split_part(text, F.lit("T"), F.lit(1))


def parse_day(text: Column, as_of: Column) -> Column:
    """``yyyy-MM-dd`` at the start of the day; a missing text means ``as_of``."""
    return F.when(text.isNull(), as_of).otherwise(
        F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd"))
    )


def days_back(as_of: Column, days: Column) -> Column:
    return F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")


def to_id(text: Column) -> Column:
    return text.try_cast("bigint")


def leading_number(text: Column) -> Column:
    """The number a text starts with, or null."""
    return F.regexp_extract(text, LEADING_NUMBER, 1).try_cast("double")


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def filled(text: Column) -> Column:
    """Null for an empty text, which counts as absent."""
    return F.when(text != "", text)


def join_reasons(*reasons: Column) -> Column:
    joined = F.concat_ws(REASON_SEPARATOR, *reasons)
    return F.coalesce(filled(joined), F.lit(UNUSUAL))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)


def percent(value: Column) -> Column:
    return F.format_string("%.1f", value * 100)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def floor_at_one(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(value))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def generated_name(prefix: str, ident: Column) -> Column:
    return F.concat(F.lit(prefix), ident.cast("string"))
