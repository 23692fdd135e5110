"""Typed column expressions: lenient numbers, dates, names, safe ratios."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters removed before text is read as a number.
CURRENCY_CLASS = r"[,$€£₦\s]"

# Name parts that mark a column as a key.
ID_WORDS = ["id", "code", "key", "uuid", "no", "num", "number", "sku"]

# Endings that make a column an identifier whatever its values.
STRONG_ID_ENDING = (
    r"(?i)(?:(?:Key|Id|UUID|GUID|Pk|Fk|RowId|RowKey)$|_(?:key|id|uuid|guid|pk|fk|rowid|rowkey)$)"
)
STRICT_ID_ENDING = r"(?:_|^)(?i:key|id|uuid|guid|pk|fk|rowid|rowkey)$|[a-z0-9](?:Key|Id|ID|UUID|GUID|Pk|Fk)$"

# Date layouts tried in order; one is kept per column by its hit rate.
# Time-only layouts are left out on purpose: they would read as 1970.
DATE_LAYOUTS = [
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d H:m",
    "M/d/yyyy",
    "d/M/yyyy",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "yyyy/M/d",
    "d-M-yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d-MMM-yyyy",
]

_NUMBER_SHAPE = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def c(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def text_to_number(text: Column) -> Column:
    """Currency and grouping characters dropped; anything else not a number is NULL."""
    bare = F.regexp_replace(text, CURRENCY_CLASS, "")
    return F.when(bare.rlike(_NUMBER_SHAPE), bare.try_cast("double"))


def to_number_lenient(df: DataFrame, name: str) -> Column:
    """The column as a number: as it is, or leniently parsed from text; NaN is NULL."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c(name), F.lit(None).cast(dtype))
    if is_number(dtype):
        return c(name)
    if isinstance(dtype, T.BooleanType):
        return c(name).cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_number(c(name))
    return F.lit(None).cast("double")


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c(name), F.lit(None).cast(dtype))
    return c(name)


def layout_shape(layout: str) -> str:
    """A pattern that every text of a date layout matches, from its letters."""
    shapes = {"yyyy": r"[+-]?\d{4,}", "MMM": r"\p{L}+\.?", "SSSSSS": r"\d{1,9}", "'T'": "T"}
    parts = re.findall(r"yyyy|MMM|SSSSSS|'T'|[MdHms]|.", layout)
    return "(?i)^" + "".join(shapes.get(p, r"\d{1,2}" if p in "MdHms" else re.escape(p)) for p in parts) + "$"


def parse_layout(text: Column, layout: str) -> Column:
    """The text as a time of this layout; texts of another shape are not parsed."""
    bare = F.trim(text)
    return F.when(bare.rlike(layout_shape(layout)), F.try_to_timestamp(bare, F.lit(layout)).cast("timestamp_ntz"))


def to_time(df: DataFrame, name: str, layout: str | None = None) -> Column:
    """The column as a naive timestamp; text needs the layout found for it."""
    dtype = type_of(df, name)
    if is_time(dtype):
        return c(name).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType) and layout:
        return parse_layout(c(name), layout)
    return F.lit(None).cast("timestamp_ntz")


def month_label(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM")


def name_parts(name: Column) -> Column:
    """Lower-case words of a column name, split at camel case and punctuation."""
    spaced = F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    return F.filter(F.split(spaced, r"[^a-z0-9]+"), lambda w: w != "")


def names_a_key(name: Column) -> Column:
    return F.arrays_overlap(name_parts(name), F.array(*[F.lit(w) for w in ID_WORDS]))


def ends_like_key(name: Column, strict: bool = False) -> Column:
    return name.rlike(STRICT_ID_ENDING if strict else STRONG_ID_ENDING)


def key_stem(name: Column) -> Column:
    """The name without its id, code, key and number words."""
    ids = F.array(*[F.lit(w) for w in ID_WORDS])
    return F.array_join(F.filter(name_parts(name), lambda w: ~F.array_contains(ids, w)), "")


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "")


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent; NULL when the whole is zero or missing."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def as_text(df: DataFrame, name: str) -> Column:
    """A comparable text form; nested values become JSON."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(c(name))
    return known(df, name).cast("string")
