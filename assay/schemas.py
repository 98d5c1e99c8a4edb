"""Column layouts shared by the operators."""

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("abs_path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("atime", T.TimestampType()),
        T.StructField("scan_error", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("digest", T.StringType(), False),
    ]
)

VERIFY_RESULT = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("expected", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("base_path", T.StringType(), False),
        T.StructField("rule_seq", T.IntegerType(), False),
        T.StructField("negated", T.BooleanType(), False),
        T.StructField("dir_only", T.BooleanType(), False),
        T.StructField("path_pattern", T.BooleanType(), False),
        T.StructField("regex", T.StringType(), False),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("source_relative", T.StringType(), False),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)

COPY_OUTCOME = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("digest", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_kind", T.StringType()),
        T.StructField("io_kind", T.StringType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("times_kept", T.BooleanType()),
        T.StructField("finished_ms", T.LongType()),
    ]
)

PROGRESS_EVENT = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType(), False),
        T.StructField("phase", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
