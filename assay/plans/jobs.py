"""Whole jobs: copy a tree, verify one, make and check a folder's checksums."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assay.functions.digests import digest_equal
from assay.functions.paths import MANIFEST_NAME
from assay.operators import copying, entries as guards, fingerprint, resume, runs, verify
from assay.options import JobOptions
from assay.schemas import COPY_OUTCOME
from assay.plans.storing import store
from assay.session import scratch_dir, shared_dir
from assay.sources import filetree, readers, stores, writers
from assay.sources.events import JobEvents


class RunStopped(RuntimeError):
    """The breaker ended a run; what was copied before is in its checkpoint."""


@dataclass(frozen=True)
class CopyResult:
    manifest: DataFrame
    outcomes: DataFrame
    failures: DataFrame
    verification: DataFrame


def copy_tree(
    spark: SparkSession,
    source: str,
    destination: str,
    options: JobOptions = JobOptions(),
    checkpoint_table: str | None = None,
    waves: int = 1,
    events: str | None = None,
) -> CopyResult:
    """Probe, scan, plan, copy with read-back, verify everything again, and only then write the manifest.

    Before the plan, backups that an interrupted run left at the destination are put back
    and its temporary files go. Without ``checkpoint_table`` the checkpoint lies in a folder
    below the shared scratch folder, where a later run of the same pair finds it.
    Tasks copy in parallel, each a stretch of the files in component order. The first that
    meets a device failure or too many failures in a row stops all of them; what they have
    done by then is kept. Streaks over the edges of stretches are found after each wave.
    ``events`` is a folder for PROGRESS_EVENT rows, written while the job runs:
    ``events.event_stream`` follows it, ``progress_stream`` folds it.
    Each wave's outcomes are stored before anything else happens and are the checkpoint
    a later run resumes from.
    """
    if overlapping(spark, source, destination):
        raise ValueError(f"{destination} lies in {source} or would overwrite it")
    stores.make_parents(f"{destination.rstrip('/')}/x")
    left = filetree.scan_all(spark, destination)
    copying.recover_interrupted(spark, destination, left)
    copying.clean_stale_temps(spark, destination, listing=left)
    table = checkpoint_table or shared_dir(spark, "copy-checkpoints")
    report = JobEvents(events, f"copy-{uuid.uuid4().hex}")
    report.phase("Scanning")
    key = spark.range(1).select(writers.checkpoint_key(F.lit(source), F.lit(destination))).first()[0]

    junk = {False: None, True: "basic"}.get(options.skip_junk, options.skip_junk)
    listed = filetree.scan_tree(spark, source, skip_junk=junk, respect_ignore_files=options.respect_ignore_files)
    files = guards.keep_regular_files(listed)
    guards.require_non_empty(files, "files to copy")
    guards.require_clean_names(files, writes_manifest=not options.no_manifest)

    if options.probe:
        fingerprint.preflight_probe(spark, destination)
    work = _plan(spark, files, destination, table, key, options)
    run = f"run-{uuid.uuid4().hex}"
    stop_file = f"{scratch_dir(spark, 'stop')}/stop"
    if events:
        to_copy = work.filter("action = 'COPY'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        report.phase("Copying", int(to_copy))
    for wave in range(waves):
        part = work.filter(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave) if waves > 1 else work
        outcomes = copying.verified_copy(part.filter("action = 'COPY'"), destination, options, stop_file=stop_file, events=report)
        rows = outcomes.unionByName(_skipped(part), allowMissingColumns=True)
        writers.write_checkpoint(rows.withColumn("wave", F.lit(wave)), f"{table}/{key}", run, "run")
        done = _outcomes(spark, f"{table}/{key}/run={run}")
        _set_aside(done.filter((F.col("wave") == wave) & (F.col("status") == "FAILED")), destination)
        _stop_if_broken(done, options)

    report.phase("Verifying")
    failures = done.filter("status = 'FAILED'")
    manifest = done.filter("digest IS NOT NULL").select("path", "digest")
    guards.require_non_empty(manifest, "file copied")
    result = _read_back(spark, manifest, destination, options.digest)
    verification = verify.final_reverify(manifest, result, unique=True)
    if not verification.first()["passed"]:
        raise RunStopped(f"the final verification failed: {verification.first()}")
    if not options.no_manifest:
        writers.write_manifest_bundle(manifest, destination, verification, options.digest)
    report.phase("Done")
    return CopyResult(manifest, done, failures, verification)


def overlapping(spark: SparkSession, source: str, destination: str) -> bool:
    pair = spark.range(1).select(F.lit(source).alias("source"), F.lit(destination).alias("destination"))
    return not guards.overlap_guard(pair).isEmpty()


def _plan(
    spark: SparkSession, files: DataFrame, destination: str, table: str, key: str, options: JobOptions
) -> DataFrame:
    """Work list with an action and, for entries to skip, the recorded digest."""
    previous = _previous(spark, files, destination, table, key, options)
    if previous is None:
        return files.select("path", "abs_path", "size", F.lit("COPY").alias("action"), F.lit(None).cast("string").alias("recorded"))
    there = filetree.scan_without_root(spark, destination)
    # Contents are read last, and only of files that presence and size leave open.
    open_files = resume.resume_candidates(files.select("path", "abs_path", "size"), previous, there)
    at_destination = filetree.digest_files(
        open_files.select("path", F.col("destination_path").alias("abs_path"), F.col("found_size").alias("size")), options.digest
    )
    intact, _ = store(
        open_files.join(at_destination.select("path", "digest"), "path").filter(digest_equal(F.col("digest"), F.col("recorded"))),
        "intact",
    )
    at_source = filetree.digest_files(intact.select("path", "abs_path", "size"), options.digest)
    same = intact.drop("digest").join(at_source.select("path", "digest"), "path")
    skip = same.filter(digest_equal(F.col("digest"), F.col("recorded"))).select("path", "recorded")
    planned = files.select("path", "abs_path", "size").join(skip, "path", "left")
    action = F.when(F.col("recorded").isNull(), "COPY").otherwise("SKIP")
    return store(planned.withColumn("action", action), "plan")[0]


def _previous(spark, files, destination, table, key, options) -> DataFrame | None:
    """``(path, digest, size)`` of the manifest at the destination, else of the checkpoint."""
    placed = f"{destination.rstrip('/')}/{MANIFEST_NAME}"
    if stores.exists(placed) and guards.any_reserved(files).first()[0] is False:
        manifest = readers.read_manifest(spark, placed, digest=options.digest)
        return manifest.withColumn("size", F.lit(0).cast("bigint"))
    if not _has_rows(spark, table, key):
        return None
    # What cannot be read of an earlier run is copied again.
    rows = _outcomes(spark, f"{table}/{key}", ignoreCorruptFiles="true").filter("digest IS NOT NULL")
    return writers.newest_per_path(rows, size="bytes")


def _has_rows(spark: SparkSession, table: str, key: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{key}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _skipped(part: DataFrame) -> DataFrame:
    return part.filter("action = 'SKIP'").select(
        "path",
        F.col("recorded").alias("digest"),
        F.col("size").alias("bytes"),
        F.lit(0).alias("attempts"),
        F.lit("SKIPPED").alias("status"),
        F.unix_millis(F.now()).alias("finished_ms"),
    )


def _outcomes(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    schema = T.StructType([*COPY_OUTCOME, T.StructField("wave", T.IntegerType())])
    return spark.read.schema(schema).options(**options).parquet(folder)


def _set_aside(failures: DataFrame, destination: str) -> None:
    """Quarantine records come first, whatever the failures lead to."""
    if failures.isEmpty():
        return
    reports = failures.select(
        F.col("path").alias("source_relative"), "attempts", F.unix_seconds(F.now()).alias("unix_time"), "reason"
    )
    writers.write_quarantine(reports, destination)


def _stop_if_broken(done: DataFrame, options: JobOptions) -> None:
    if done.filter("status = 'FAILED'").isEmpty():
        return
    neutral = F.col("status").isin("SKIPPED", "STOPPED")
    status = F.when(F.col("status") == "FAILED", "FAIL").when(neutral, "SKIP").otherwise("OK")
    log = done.select(F.lit(0).alias("run_id"), F.split("path", "/").alias("parts"), status.alias("status"), "error_class")
    stops = runs.failure_circuit_breaker(log, order=["parts"], limit=options.failure_limit)
    at = stops.first()["stop_position"]
    if at is not None:
        raise RunStopped(f"the device seems to fail: stopped at entry {at} in component order")


def _read_back(spark: SparkSession, manifest: DataFrame, destination: str, digest: str) -> DataFrame:
    """Digests of the listed files at the destination, read once; what is not there has no row."""
    there = filetree.scan_without_root(spark, destination).select("path", "abs_path", "size")
    return store(filetree.digest_files(verify.entries_to_hash(manifest, there), digest), "read-back")[0]


def verify_tree(spark: SparkSession, target: str, digest: str = "xxh3_128") -> DataFrame:
    """Every row of a manifest (a file, or the one in a folder) against the files beside it."""
    placed = readers.resolve_manifest(target)
    manifest = readers.read_manifest(spark, placed, digest=digest)
    guards.require_non_empty(manifest, "rows in the manifest")
    root = placed.rpartition("/")[0]
    return verify.verify_manifest(manifest, _read_back(spark, manifest, root, digest), unique=True)


def generate_checksums(spark: SparkSession, directory: str) -> DataFrame:
    """Write the folder's checksum file; returns ``(path, digest, error)`` of each file."""
    digested, _ = store(filetree.digest_files(filetree.scan_flat(spark, directory), "md5"), "digests")
    writers.write_checksums_file(digested.filter("digest IS NOT NULL").select("path", "digest"), directory)
    return digested


def check_checksums(spark: SparkSession, directory: str) -> DataFrame:
    """Two-sided check of a folder against its checksum file; only expected files are hashed."""
    expected = readers.read_checksums(spark, f"{directory.rstrip('/')}/checksums.txt")
    listed = filetree.scan_flat(spark, directory)
    hashed, _ = store(filetree.digest_files(verify.entries_to_hash(expected, listed), "md5"), "digests")
    extra = listed.join(expected.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("digest"))
    return verify.check_full(expected, hashed.select("path", "digest").unionByName(extra))
