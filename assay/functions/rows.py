"""Text forms of table rows, for digests that have to agree across engines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession, functions as F, types as T


def field_text(field: T.StructField, double_scale: int | None = None) -> Column:
    """An unambiguous text form of one column; NULL is ``~``, strings carry their byte length.

    Times are epoch microseconds. With ``double_scale`` doubles are rounded to that many
    decimals and shown as scaled integers.
    """
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)) and double_scale is not None:
        scaled = F.rint(column * F.lit(float(10**double_scale)))
        whole = F.when(F.abs(scaled) < F.lit(9e18), scaled.cast("bigint").cast("string"))
        text = F.coalesce(whole, column.cast("string"))
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, T.TimestampNTZType):
        text = _ntz_micros(column).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(column))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.concat(F.octet_length(column).cast("string"), F.lit(":"), column)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        json = F.to_json(column, {"ignoreNullFields": "false"})
        text = F.concat(F.octet_length(json).cast("string"), F.lit(":"), json)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("~"))


def _ntz_micros(column: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(column.cast("timestamp"))
    seconds = (F.unix_date(column.cast("date")) * 24 + F.hour(column)) * 60 + F.minute(column)
    micros = F.date_format(column, "ssSSSSSS").cast("bigint")
    return seconds.cast("bigint") * 60_000_000 + micros


def row_text(fields: Iterable[T.StructField], double_scale: int | None = None) -> Column:
    return F.concat_ws("|", *[field_text(field, double_scale) for field in fields])
