"""Name lookups and leftovers of interrupted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions import paths


def lookup_name_ci(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``(wanted, found, exact)`` for each name wanted: the exact name when listed, else a case-insensitive match.

    Every lower-cased name is reduced to its first spelling before joining, so names that
    differ only in case do not multiply; exact matches are a join of their own.
    """
    names = listing.select(F.col("path").alias("found")).distinct()
    exact = names.select(F.col("found").alias("wanted"), F.lit(True).alias("exact"))
    folded = names.groupBy(F.lower("found").alias("folded")).agg(F.min("found").alias("near"))
    keys = wanted.select(F.col("path").alias("wanted")).distinct().withColumn("folded", F.lower("wanted"))
    joined = keys.join(exact, "wanted", "left").join(folded, "folded", "left")
    return joined.select(
        "wanted",
        F.when(F.col("exact"), F.col("wanted")).otherwise(F.col("near")).alias("found"),
        F.coalesce("exact", F.lit(False)).alias("exact"),
    )


def recover_backups(listing: DataFrame, marker: str = paths.BACKUP_MARKER) -> DataFrame:
    """``(path, final_path, action)``: restore a backup whose final file is gone, else delete it.

    Of several backups of one missing file the first by name is restored.
    """
    is_backup = paths.is_backup_name(paths.file_name(F.col("path")), marker)
    backups = listing.filter(is_backup).select(
        "path", paths.backup_final_name(F.col("path"), marker).alias("final_path")
    )
    finals = listing.filter(~is_backup).select(F.col("path").alias("final_path"))
    first = backups.groupBy("final_path").agg(F.min("path").alias("path"))
    restored = first.join(finals, "final_path", "left_anti").select("path", F.lit("restore").alias("action"))
    joined = backups.join(restored, "path", "left")
    return joined.select("path", "final_path", F.coalesce("action", F.lit("delete")).alias("action"))
