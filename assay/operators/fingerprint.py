"""Order-insensitive fingerprints of tables, and writes verified by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from assay.functions.digests import digest_to_bigint
from assay.functions.rows import row_text

PROBE_BYTES = 10 << 20

#: A row's 128 bits are added up in pieces of so many hex digits: 32 bits, so that a BIGINT holds 2^31 rows' worth.
_LIMB_DIGITS = 8


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, double_scale: int | None = None) -> Column:
    """MD5 over the row's fields, in hex."""
    fields = [df.schema[name] for name in (columns or df.columns)]
    return F.md5(row_text(fields, double_scale).cast("binary"))


def table_fingerprint(
    df: DataFrame,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    double_scale: int | None = None,
) -> DataFrame:
    """Row count, and sum and xor of all 128 bits of the rows' digests, per key or for the whole table.

    One pass with partial aggregation: a task sends one row per key. A digest is four limbs
    of 32 bits, added and xored each for itself as plain numbers; the sum is the four
    limbs' sums, in hex, the highest first. ``double_scale`` compares doubles as decimals, for
    engines that print them differently.
    """
    return df.groupBy(*keys).agg(*_aggregates(df, columns, double_scale))


def _aggregates(df: DataFrame, columns: Sequence[str] | None = None, double_scale: int | None = None) -> list[Column]:
    digest, none = row_hash(df, columns, double_scale), F.lit(0)
    limbs = [F.conv(F.substring(digest, 1 + _LIMB_DIGITS * i, _LIMB_DIGITS), 16, 10).cast("bigint") for i in range(4)]
    sums = [F.lpad(F.lower(F.hex(F.coalesce(F.sum(limb), none))), 16, "0") for limb in limbs]
    xors = [F.lpad(F.lower(F.hex(F.coalesce(F.bit_xor(limb), none))), _LIMB_DIGITS, "0") for limb in limbs]
    return [F.count("*").alias("n_rows"), F.concat(*sums).alias("hash_sum"), F.concat(*xors).alias("hash_xor")]


def same_fingerprint(written: dict, read_back: DataFrame) -> bool:
    return written == table_fingerprint(read_back).first().asDict()


class VerificationError(RuntimeError):
    """What was read back is not what was written."""


def verified_write(df: DataFrame, target: str, mode: str = "errorifexists") -> DataFrame:
    """Write to a staging folder, read it back, compare fingerprints, then promote it.

    The fingerprint is taken of the rows as they are written, so ``df`` is computed once and
    need not be repeatable. The staging folder lies next to the target, so promotion is a
    rename within one store.
    """
    spark = df.sparkSession
    staging = f"{target.rstrip('/')}.staging-{df.sparkSession.sparkContext.applicationId}"
    if mode == "errorifexists" and _exists(spark, target):
        raise FileExistsError(target)
    seen = Observation()
    df.observe(seen, *_aggregates(df)).write.mode("overwrite").parquet(staging)
    read_back = spark.read.schema(df.schema).parquet(staging)
    if not same_fingerprint(seen.get, read_back):
        fs, path = _filesystem(spark, staging)
        fs.delete(path(staging), True)
        raise VerificationError(f"{staging} differs from what was written")
    promote_with_backup(spark, staging, target)
    return spark.read.schema(df.schema).parquet(target)


def promote_with_backup(spark: SparkSession, staged: str, target: str) -> None:
    """Rename ``staged`` to ``target``; what was there is kept aside until that worked."""
    fs, path = _filesystem(spark, target)
    backup = None
    if fs.exists(path(target)):
        millis = int(spark.sql("SELECT unix_millis(now())").first()[0])
        backup = f"{target.rstrip('/')}.verify.old.{millis}"
        if not fs.rename(path(target), path(backup)):
            raise OSError(f"cannot move {target} aside")
    if not fs.rename(path(staged), path(target)):
        if backup:
            fs.rename(path(backup), path(target))
        raise OSError(f"cannot promote {staged}")
    if backup:
        fs.delete(path(backup), True)


def preflight_probe(spark: SparkSession, target: str, ids: DataFrame | None = None) -> DataFrame:
    """Write deterministic noise to the target store, read it back, compare, delete it.

    Noise is drawn from ``ids (id)``; 16 bytes a row, 10 MiB by default. Raises
    :class:`VerificationError` on a mismatch; otherwise returns the probe's fingerprint.
    """
    ids = spark.range(PROBE_BYTES // 16) if ids is None else ids
    probe = ids.select("id", digest_to_bigint(F.md5(F.col("id").cast("string").cast("binary"))).alias("noise"))
    place = f"{target.rstrip('/')}/.verify-probe.tmp"
    fs, path = _filesystem(spark, place)
    try:
        result = table_fingerprint(verified_write(probe, place, mode="overwrite"))
        row = result.first()
    finally:
        fs.delete(path(place), True)
    return spark.createDataFrame([row], result.schema)


def _filesystem(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(location).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, location: str) -> bool:
    fs, path = _filesystem(spark, location)
    return fs.exists(path(location))
