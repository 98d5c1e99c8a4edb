"""What an interrupted transfer still has to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.digests import digest_equal
from assay.functions.paths import MANIFEST_NAME, is_reserved_first, path_parts, record_key
from assay.operators.verify import folded

SKIP, COPY = "SKIP", "COPY"


def resume_size_precheck(previous: DataFrame, destination: DataFrame) -> DataFrame:
    """``(path, size_differs)``: two known sizes that differ, of either side, mean copy, without hashing."""
    known = F.when(F.col("size") > 0, F.col("size"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("path").agg(F.min(known).alias(f"{name}_low"), F.max(known).alias(f"{name}_high"))

    both = side(previous, "recorded").join(side(destination, "found"), "path")
    differs = F.least("recorded_low", "found_low") != F.greatest("recorded_high", "found_high")
    return both.select("path", F.coalesce(differs, F.lit(False)).alias("size_differs"))


def _sizes_differ() -> Column:
    recorded, found = F.col("recorded_size"), F.col("found_size")
    return F.coalesce((recorded > 0) & (found > 0) & (recorded != found), F.lit(False))


def resume_plan(
    source: DataFrame, previous: DataFrame, destination: DataFrame, unique: bool = False
) -> DataFrame:
    """``(path, action, reason)`` per source entry.

    SKIP only when the entry is in the previous manifest, exists at the destination, and
    both contents still match the manifest. The inputs are ``(path, digest)`` tables; a
    NULL digest means unreadable. A path whose rows disagree counts as changed on that side,
    and a manifest that has two digests of a path can't vouch for either. All three meet on
    path, so each is shuffled once.
    """
    src = folded(source, "source_digest", "given", "source_mixed", unique)
    prev = folded(previous, "recorded", "listed", "recorded_mixed", unique).drop("listed")
    dest = folded(destination, "found", "exists", "found_mixed", unique)
    reason = (
        F.when(F.col("recorded_mixed"), "conflicting_records")
        .when(F.col("recorded").isNull(), "new")
        .when(F.col("exists").isNull(), "missing_at_destination")
        .when(F.col("found").isNull(), "destination_unreadable")
        .when(F.col("found_mixed") | ~digest_equal(F.col("found"), F.col("recorded")), "destination_changed")
        .when(F.col("source_digest").isNull(), "source_unreadable")
        .when(F.col("source_mixed") | ~digest_equal(F.col("source_digest"), F.col("recorded")), "source_changed")
        .otherwise("verified")
    )
    planned = src.join(prev, "path", "left").join(dest, "path", "left")
    return planned.select("path", reason.alias("reason")).select(
        "path", F.when(F.col("reason") == "verified", SKIP).otherwise(COPY).alias("action"), "reason"
    )


def resume_candidates(source: DataFrame, previous: DataFrame, destination: DataFrame) -> DataFrame:
    """Source entries that could be skipped, with both sides' ``abs_path``.

    Everything that already fails on presence or size is left out, so only these files
    need their contents read. Listings and the newest records hold each path once.
    """
    prev = previous.select("path", F.col("digest").alias("recorded"), F.col("size").alias("recorded_size"))
    dest = destination.select(
        "path", F.col("abs_path").alias("destination_path"), F.col("size").alias("found_size")
    )
    return source.join(prev, "path").join(dest, "path").filter(~_sizes_differ())


def previous_for_same_tree(records: DataFrame, tree_id: str) -> DataFrame:
    """Records of earlier runs into the same destination tree, with their component key."""
    same = records.filter(F.col("tree_id") == tree_id)
    return same.select(
        record_key(F.col("path")).alias("record_key"), F.array_join(path_parts(F.col("path")), "/").alias("path"), "digest", "size"
    )


def pick_resume_manifest(
    entries: DataFrame, at_destination: DataFrame, checkpoint: DataFrame, name: str = MANIFEST_NAME
) -> DataFrame:
    """The manifest to resume from: the destination's, else the checkpoint.

    The destination's is passed over when there is none or when the user's own data
    carries its name.
    """
    owned = not entries.filter(is_reserved_first(F.col("path"), [name])).isEmpty()
    take_destination = not owned and not at_destination.isEmpty()
    chosen, origin = (at_destination, "destination") if take_destination else (checkpoint, "checkpoint")
    return chosen.select("path", "digest", F.lit(origin).alias("origin"))
