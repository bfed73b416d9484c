"""Column classes and the one rule for missing values.

A missing value is SQL NULL or, in a floating-point column, NaN. Spark keeps the two apart
(``sum`` and ``max`` return NaN, ``count`` counts it), so operators read columns through
:func:`value`, which turns NaN into NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"

FIXED_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def quoted(name: str) -> str:
    """The name as one identifier, also when it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def raw(name: str) -> Column:
    return F.col(quoted(name))


def class_of(data_type: T.DataType) -> str:
    """numeric, categorical, datetime, boolean or other. Booleans are never numeric."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.StringType):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def field_of(df: DataFrame, name: str) -> T.StructField:
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}; the table has {df.columns}")
    return df.schema[name]


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if class_of(f.dataType) in classes]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The numeric columns, in table order, or those among the named ones in the order named."""
    if columns is None:
        return columns_of(df, NUMERIC)
    return [c for c in columns if class_of(field_of(df, c).dataType) == NUMERIC]


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    data_type = field_of(df, name).dataType
    if is_floating(data_type):
        return F.nanvl(raw(name), F.lit(None).cast(data_type))
    return raw(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE: booleans count 0 and 1, date columns are epoch microseconds."""
    kind = class_of(field_of(df, name).dataType)
    if kind == BOOLEAN:
        return raw(name).cast("int").cast("double")
    if kind == DATETIME:
        return micros(raw(name), field_of(df, name).dataType).cast("double")
    if kind != NUMERIC:
        raise ValueError(f"column {name!r} is not numeric")
    return value(df, name).cast("double")


def micros(column: Column, data_type: T.DataType) -> Column:
    """Epoch microseconds of a date or timestamp. Those of a timestamp without time zone count from 1970-01-01 00:00 on the same
    clock, whatever the session's time zone."""
    if not isinstance(data_type, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    minutes = (F.unix_date(column.cast("date")).cast("bigint") * 24 + F.hour(column)) * 60 + F.minute(column)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")


def from_micros(m: Column, data_type: T.DataType) -> Column:
    """Epoch microseconds back to the column's timestamp type (dates become timestamps)."""
    whole = F.round(m).cast("bigint")
    if isinstance(data_type, T.TimestampNTZType):
        seconds = (whole.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.timestamp_micros(whole)


def clean(df: DataFrame) -> DataFrame:
    """Every floating-point column with NaN read as NULL; the table itself if it has none."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[value(df, c).alias(c) for c in df.columns])


def data_bytes(df: DataFrame, name: str) -> Column:
    """Aggregate: estimated bytes of the non-null values."""
    data_type = field_of(df, name).dataType
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(raw(name)).cast("long")), F.lit(0).cast("long"))
    if isinstance(data_type, T.DecimalType):
        width = 8 if data_type.precision <= 18 else 16
    else:
        width = FIXED_WIDTH.get(data_type.simpleString())
    if width is None:
        text = F.to_json(raw(name))
        return F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0).cast("long"))
    return (F.count(value(df, name)) * F.lit(width)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as DOUBLE; NULL for an empty table."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def groupable(column: Column, data_type: T.DataType) -> Column:
    """The value in a form Spark can group by: maps become sorted entry arrays, at any depth."""
    if isinstance(data_type, T.MapType):
        entries = F.map_entries(column)
        entry = T.StructType([
            T.StructField("key", data_type.keyType), T.StructField("value", data_type.valueType),
        ])
        return F.array_sort(F.transform(entries, lambda e: groupable(e, entry)))
    if isinstance(data_type, T.ArrayType) and has_map(data_type):
        return F.transform(column, lambda e: groupable(e, data_type.elementType))
    if isinstance(data_type, T.StructType) and has_map(data_type):
        fields = [groupable(column.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(has_map(f.dataType) for f in data_type.fields)
    return False
