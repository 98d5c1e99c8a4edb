"""Text forms: normalization, manifest lines, reports, sizes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
#: Bytes of texts that are normalized at once, or one text.
BYTES_AT_ONCE = 1 << 20


@F.arrow_udf(StringType())
def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield normalized(values)


def normalized(values: pa.Array) -> pa.Array:
    """NFC of each text. A few texts at a time are Python's, the others stay in Arrow's buffers."""
    if values.null_count == len(values):
        return values
    sizes, pieces, first = pc.fill_null(pc.binary_length(values), 0).to_pylist(), [], 0
    while first < len(values):
        last, held = first + 1, sizes[first]
        while last < len(values) and held + sizes[last] <= BYTES_AT_ONCE:
            held += sizes[last]
            last += 1
        texts = values.slice(first, last - first).to_pylist()
        pieces.append(pa.array([text and unicodedata.normalize("NFC", text) for text in texts], values.type))
        first = last
    return pa.concat_arrays(pieces)


def nfc(value: Column) -> Column:
    """Unicode NFC. Pure ASCII text is already normal and stays in the JVM's result."""
    return F.coalesce(_nfc(F.when(value.rlike("[^\\x00-\\x7F]"), value)), value)


def manifest_line(digest: Column, path: Column) -> Column:
    return F.concat(digest, F.lit("  "), path)


def json_report(source_relative: Column, attempts: Column, unix_time: Column, reason: Column) -> Column:
    return F.to_json(
        F.struct(
            source_relative.alias("source_relative"),
            attempts.alias("attempts"),
            unix_time.alias("unix_time"),
            reason.alias("reason"),
        )
    )


def format_bytes(size: Column) -> Column:
    """Whole units with one decimal, truncated; integers only, so nothing rounds up."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scale = F.lit(1024**power).cast("bigint")
        whole = F.floor(F.shiftright(size, 10 * power)).cast("bigint")
        tenth = F.shiftright((size - whole * scale) * 10, 10 * power)
        text = F.when(size < scale, text).otherwise(
            F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"), F.lit(f" {unit}"))
        )
    return text


def format_bytes_rounded(size: Column) -> Column:
    """One decimal, rounded half up."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = size.cast("double") / F.lit(float(1024**power))
        text = F.when(size < F.lit(1024**power), text).otherwise(F.format_string(f"%.1f {unit}", scaled))
    return text


def base64url_encode(value: Column) -> Column:
    encoded = F.regexp_replace(F.base64(value.cast("binary")), "[\\r\\n]", "")
    return F.translate(encoded, "+/", "-_")


def base64url_decode(value: Column) -> Column:
    """The UTF-8 text, or NULL when the code is malformed."""
    return F.try_to_binary(F.translate(value, "-_", "+/"), F.lit("base64")).cast("string")


#: Severity of each log level.
LOG_SEVERITY = {"Info": 0, "Success": 0, "Warning": 1, "Retry": 1, "Error": 2, "Quarantine": 2}

#: What a job in each phase is called.
PHASE_LABELS = {
    "Sanity": "preparing",
    "Scanning": "preparing",
    "Copying": "copying",
    "Cooldown": "cooling down",
    "Verifying": "verifying",
    "Done": "done",
    "Failed": "failed",
}


def status_label(phase: Column) -> Column:
    return _lookup(phase, PHASE_LABELS, "waiting")


def log_severity(level: Column) -> Column:
    return _lookup(level, LOG_SEVERITY, 0)


def _lookup(key: Column, table: dict, default) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)
