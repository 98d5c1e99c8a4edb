"""Filters and guards over entry tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions import paths
from assay.functions.rows import row_text
from assay.functions.text import nfc


def entries_from_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], root: str, double_scale: int | None = None
) -> DataFrame:
    """Rows of an ordinary table as entries: ``keys`` make the path, ``columns`` the payload.

    Key values must not contain a slash.
    """
    path = F.concat_ws("/", F.lit(root), *[F.col(key).cast("string") for key in keys])
    payload = row_text([df.schema[name] for name in columns], double_scale)
    return df.select(path.alias("path"), payload.alias("payload")).withColumn(
        "size", F.octet_length("payload").cast("bigint")
    )


def keep_regular_files(entries: DataFrame) -> DataFrame:
    """Drop directories, links and devices."""
    return entries.filter(F.col("kind") == "file")


def _parts_below_root(path: Column, root_parts: int) -> Column:
    parts = paths.path_parts(path)
    return F.slice(parts, root_parts + 1, F.greatest(F.size(parts) - root_parts, F.lit(0))) if root_parts else parts


def skip_junk_basic(entries: DataFrame, root_parts: int = 0) -> DataFrame:
    """Drop tool caches and OS litter with everything below them.

    ``root_parts`` leading components are the chosen root, which is kept whatever its name.
    """
    parts = _parts_below_root(F.col("path"), root_parts)
    return entries.filter(~paths.in_junk_basic(parts, F.col("is_dir")))


def skip_junk_extended(entries: DataFrame, root_parts: int = 0) -> DataFrame:
    parts = _parts_below_root(F.col("path"), root_parts)
    return entries.filter(~paths.in_junk_extended(parts, F.col("is_dir")))


def name_violations(
    entries: DataFrame, writes_manifest: bool = True, only_top_level: bool = False
) -> DataFrame:
    """``(path, violation)`` for names that would break or overwrite the manifest.

    ``only_top_level`` reserves the names for files directly below the destination;
    otherwise a top directory of that name counts too.
    """
    reserved = paths.is_reserved_single if only_top_level else paths.is_reserved_first
    violation = F.when(paths.has_newline(F.col("path")), "newline")
    if writes_manifest:
        violation = violation.when(reserved(F.col("path")), "reserved")
    return entries.select("path", violation.alias("violation")).filter("violation IS NOT NULL")


def require_clean_names(entries: DataFrame, writes_manifest: bool = True) -> None:
    """Refuse a run whose entries include a name that breaks the manifest."""
    first = name_violations(entries, writes_manifest).head(1)
    if first:
        raise ValueError(f"{first[0].violation} name: {first[0].path!r}")


def require_non_empty(entries: DataFrame, what: str = "entries") -> None:
    if entries.isEmpty():
        raise ValueError(f"no {what}")


def overlap_guard(pairs: DataFrame) -> DataFrame:
    """``(source, destination)`` pairs that must be refused."""
    return pairs.filter(paths.overlaps(F.col("source"), F.col("destination")))


def total_bytes(entries: DataFrame) -> DataFrame:
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))
    return entries.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))


def any_reserved(entries: DataFrame, name: str = paths.MANIFEST_NAME) -> DataFrame:
    """One row: does any entry own the manifest's name."""
    owned = F.bool_or(paths.is_reserved_first(F.col("path"), [name]))
    return entries.agg(F.coalesce(owned, F.lit(False)).alias("any_reserved"))


def nfc_collision_last_wins(entries: DataFrame) -> DataFrame:
    """One row per NFC name: the surviving raw name and how many names fell together.

    The raw name that sorts last survives. Counting before shuffling keeps a heavily
    repeated name cheap.
    """
    return (
        entries.withColumn("nfc_name", nfc(F.col("name")))
        .groupBy("nfc_name")
        .agg(F.max("name").alias("name"), F.count("*").alias("n_names"))
    )


def order_by_components(entries: DataFrame) -> DataFrame:
    """Component order: ``a/b`` comes before ``a-b``."""
    return entries.orderBy(F.split("path", "/"))


def order_by_name(entries: DataFrame) -> DataFrame:
    """Byte order."""
    return entries.orderBy("path")


def order_by_name_ci(entries: DataFrame) -> DataFrame:
    """Siblings without regard to case, ties in byte order."""
    return entries.orderBy(F.transform(F.split("path", "/"), F.lower), "path")
