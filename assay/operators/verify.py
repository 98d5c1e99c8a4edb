"""Expected against actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.digests import digest_equal

OK, FAIL, MISSING, EXTRA, UNREADABLE = "OK", "FAIL", "MISSING", "EXTRA", "UNREADABLE"
DUPLICATE = "DUPLICATE"


def sizes_by_path(rows: DataFrame, low: str, high: str, unique: bool = False) -> DataFrame:
    """Each path once, with the smallest and largest size among its rows.

    Repeats collapse before the shuffle, and the join that follows reuses the
    partitioning, so a path holding a third of all rows never meets itself.
    """
    if unique:
        return rows.select("path", F.col("size").alias(low), F.col("size").alias(high))
    return rows.groupBy("path").agg(F.min("size").alias(low), F.max("size").alias(high))


def folded(rows: DataFrame, digest: str, present: str, mixed: str, unique: bool = False) -> DataFrame:
    """Each path once: its digest, NULL if any of its rows has none, and whether its rows disagree."""
    if unique:
        return rows.select("path", F.col("digest").alias(digest), F.lit(True).alias(present), F.lit(False).alias(mixed))
    same = F.lower("digest")
    folded = rows.groupBy("path").agg(
        F.max("digest").alias("last"), F.min(same).alias("low"), F.max(same).alias("high"), F.bool_or(F.col("digest").isNull()).alias("unread")
    )
    return folded.select(
        "path",
        F.when(~F.col("unread"), F.col("last")).alias(digest),
        F.lit(True).alias(present),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias(mixed),
    )


def _sides(expected: DataFrame, actual: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame]:
    left = folded(expected, "expected", "listed", "listed_mixed", unique)
    return left, folded(actual, "actual", "found", "found_mixed", unique)


def _status(expected: Column, actual: Column, listed: Column, found: Column, mixed: Column) -> Column:
    # Presence is tested before content, so missing is never mistaken for unreadable.
    return (
        F.when(found.isNull(), MISSING)
        .when(listed.isNull(), EXTRA)
        .when(actual.isNull(), UNREADABLE)
        .when(mixed, DUPLICATE)
        .when(digest_equal(expected, actual), OK)
        .otherwise(FAIL)
    )


def _verdicts(joined: DataFrame) -> DataFrame:
    mixed = F.col("listed_mixed") | F.col("found_mixed")
    status = _status(F.col("expected"), F.col("actual"), F.col("listed"), F.col("found"), mixed)
    return joined.select(
        "path",
        status.alias("status"),
        "expected",
        "actual",
        F.when(status == UNREADABLE, "unreadable").alias("error"),
    )


def check_full(expected: DataFrame, actual: DataFrame, unique: bool = False) -> DataFrame:
    """Two-sided check of ``(path, digest)`` tables: OK, FAIL, MISSING, EXTRA, UNREADABLE.

    A path that is present with a NULL digest in any row could not be read. A path whose rows on one side
    have different digests is DUPLICATE, never OK. Pass ``unique=True``
    when both sides are known to hold each path once.
    """
    left, right = _sides(expected, actual, unique)
    return _verdicts(left.join(right, "path", "full_outer"))


def verify_manifest(manifest: DataFrame, actual: DataFrame, unique: bool = False) -> DataFrame:
    """One verdict per manifest row; extra files are not reported."""
    left, right = _sides(manifest, actual, unique)
    return _verdicts(left.join(right, "path", "left"))


def missing_entries(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("path").distinct().join(actual.select("path"), "path", "left_anti").orderBy("path")


def extra_entries(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_entries(actual, expected)


def entries_to_hash(expected: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries worth hashing: those an expectation exists for.

    Join on path before any content is read; the optimizer cannot move a join below a
    task that reads files.
    """
    return entries.join(expected.select("path"), "path", "left_semi")


def union_results(results: DataFrame) -> DataFrame:
    """One item list: missing, extra, then the checked entries, each by path."""
    rank = F.when(F.col("status") == MISSING, 0).when(F.col("status") == EXTRA, 1).otherwise(2)
    return results.withColumn("section", rank).orderBy("section", "path")


def sorted_problems(results: DataFrame) -> DataFrame:
    """Missing and extra entries, sorted."""
    return results.filter(F.col("status").isin(MISSING, EXTRA)).select("status", "path").orderBy("status", "path")


def status_summary(results: DataFrame, cancelled: bool = False) -> DataFrame:
    """One row of counts; ``checked`` leaves out missing and extra entries, all others add up to it."""

    def n(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return results.agg(
        n(OK, FAIL, UNREADABLE, DUPLICATE).alias("checked"),
        n(OK).alias("ok"),
        n(FAIL).alias("fail"),
        n(MISSING).alias("missing"),
        n(EXTRA).alias("extra"),
        n(UNREADABLE).alias("hash_errors"),
        n(DUPLICATE).alias("duplicates"),
        F.lit(False).alias("partial"),
        F.lit(cancelled).alias("cancelled"),
    )


def failed_summary(spark, error: str) -> DataFrame:
    """The summary of a run that broke off before any entry was checked."""
    counts = ["checked", "ok", "fail", "missing", "extra"]
    columns = [F.lit(0).cast("bigint").alias(name) for name in counts]
    return spark.range(1).select(
        F.lit(error).alias("error"),
        *columns,
        F.lit(1).cast("bigint").alias("hash_errors"),
        F.lit(0).cast("bigint").alias("duplicates"),
        F.lit(False).alias("partial"),
        F.lit(False).alias("cancelled"),
    )


def problem_counts(results: DataFrame) -> DataFrame:
    """Problems per status and in total, for a one-sided check."""
    problems = results.filter(F.col("status").isin(MISSING, FAIL, UNREADABLE, DUPLICATE))
    return (
        problems.rollup("status")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("status", F.lit("TOTAL")).alias("status"), "n")
    )


def generate_summary(entries: DataFrame, payload: str = "payload", cancelled: bool = False) -> DataFrame:
    """Counts of a manifest run; partial when something could not be hashed or the run was cut short."""
    ok = F.count_if(F.col(payload).isNotNull())
    errors = F.count_if(F.col(payload).isNull())
    return entries.agg(
        ok.alias("checked"),
        ok.alias("ok"),
        errors.alias("hash_errors"),
        ((errors > 0) | F.lit(cancelled)).alias("partial"),
        F.lit(cancelled).alias("cancelled"),
    )


def manifest_bytes(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Bytes a verification will read: sizes at the destination, 0 where missing.

    A path whose rows disagree about its size counts with the largest, and in ``n_mixed``.
    """
    sizes = manifest.select("path").distinct().join(sizes_by_path(actual, "low", "high"), "path", "left")
    return sizes.agg(
        F.count("*").alias("n_entries"),
        F.coalesce(F.sum(F.coalesce("high", F.lit(0))), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("low") != F.col("high")).alias("n_mixed"),
    )


def verify_copy(written: DataFrame, read_back: DataFrame) -> DataFrame:
    """Entries whose digest when read back differs from the one taken while writing.

    So does every path whose rows disagree on either side: all digests known of it have to be one.
    """
    same = F.lower("digest")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("path").agg(F.max("digest").alias(name), F.min(same).alias(f"{name}_low"), F.max(same).alias(f"{name}_high"))

    both = side(written, "written").join(side(read_back, "read_back"), "path")
    differ = F.least("written_low", "read_back_low") != F.greatest("written_high", "read_back_high")
    return both.filter(differ).select("path", "written", "read_back")


def byte_count_check(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Entries whose byte counts differ, between the sides or among the rows of one."""
    both = sizes_by_path(source, "least_read", "bytes_read").join(sizes_by_path(destination, "least_written", "bytes_written"), "path")
    differ = F.least("least_read", "least_written") != F.greatest("bytes_read", "bytes_written")
    return both.filter(differ).select("path", "bytes_read", "bytes_written")


def final_reverify(manifest: DataFrame, actual: DataFrame, unique: bool = False) -> DataFrame:
    """One row: how many manifest entries were checked, how many failed, and whether the run passes."""
    results = verify_manifest(manifest, actual, unique)
    bad = F.count_if(F.col("status") != OK)
    return results.agg(F.count("*").alias("checked"), bad.alias("problems"), (bad == 0).alias("passed"))


def first_problem(results: DataFrame, order: str = "path") -> DataFrame:
    """Fail-fast form: the first bad record in ``order``."""
    return results.filter(F.col("status") != OK).orderBy(order).limit(1)


def copy_summary(outcomes: DataFrame) -> DataFrame:
    """Copied and failed counts; the failed paths themselves are :func:`failed_paths`."""
    return outcomes.agg(
        F.count_if(F.col("status").isin("COPIED", "SKIPPED")).alias("copied"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )


def failed_paths(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("status = 'FAILED'").select("path").orderBy("path")
