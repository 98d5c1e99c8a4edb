"""Manifest, checkpoint and quarantine sinks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.functions import paths
from assay.functions.digests import xxh3_128_hex
from assay.functions.paths import CHECKSUMS_NAME, MANIFEST_NAME, MANIFEST_README
from assay.functions.text import base64url_encode, json_report, manifest_line
from assay.operators.manifests import latest_per_path, manifest_lines
from assay.operators.runs import quarantine_rows
from assay.plans.storing import store
from assay.session import scratch_dir
from assay.sources import stores

QUARANTINE_DIR = ".quarantine"
#: Reports that a task writes, or reads, if there are more than tasks.
REPORTS_PER_TASK = 20_000
#: Reports that are pushed to the device together.
REPORTS_AT_ONCE = 2000

#: A file of many parts is written in pieces of so many bytes, by so many tasks at most.
PIECE_BYTES, MOST_TASKS = 64 << 20, 2000

README_TEXT = """\
The manifest beside this file lists the {digest} digest of every file in this folder.
To check the files:

    {tool} -c {manifest}
"""
CHECK_TOOLS = {"xxh3_128": "xxhsum", "md5": "md5sum", "sha256": "sha256sum"}


def write_manifest(manifest: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Sorted ``digest␠␠path`` lines as part files whose names follow the order.

    Returns the lines. Reading the folder, or joining its parts by
    :func:`publish_single_file`, gives the whole manifest.
    """
    # Sorting samples its input, which may read files: the narrow rows are stored first.
    lines = manifest_lines(store(manifest, "unsorted")[0])
    lines.write.mode(mode).text(folder)
    return lines


def write_checksums(manifest: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """As :func:`write_manifest`, sorted by name."""
    lines = store(manifest, "unsorted")[0].orderBy("path").select(manifest_line(F.col("digest"), F.col("path")).alias("value"))
    lines.write.mode(mode).text(folder)
    return lines


def publish_single_file(parts: str, target: str) -> str:
    """Join sorted part files into one file of any size, for exchange with tools that want one.

    The sizes of the parts before a part tell where it begins, so tasks copy pieces of
    ``PIECE_BYTES`` straight to their places; a piece that is copied again is the same. Stores
    that write files only from front to back get theirs streamed by one task. The file has a
    temporary name until it is whole. No bytes pass the driver.
    """
    spark = SparkSession.active()
    children = sorted((c for c in stores.list_dir(parts) if c["name"].startswith("part-") and c["size"]), key=lambda c: c["name"])
    starts = list(accumulate((c["size"] for c in children), initial=0))
    rows = [(f"{parts}/{c['name']}", start, c["size"]) for c, start in zip(children, starts, strict=False)]
    table = spark.createDataFrame(rows, "part string, start long, size long")
    write = _in_places if stores.is_posix(target) else _in_order
    temporary, written = write(table, target, starts[-1])
    try:
        if written != starts[-1]:
            raise OSError(f"{written} of {starts[-1]} bytes were written to {temporary}")
        stores.move(temporary, target)
    except BaseException:
        stores.delete(temporary)
        raise
    return target


def _in_places(parts: DataFrame, target: str, size: int) -> tuple[str, int]:
    """Every task writes its pieces where they belong; the file and the bytes written."""
    temporary = f"{target}.verify.tmp.1"
    stores.make_parents(target)
    with stores.open_write(temporary) as out:
        out.truncate(size)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [stores.copy_range(**piece, target=temporary) for piece in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"length": pa.array(lengths, pa.int64())})

    begin = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(PIECE_BYTES))).alias("begin")
    pieces = parts.select("part", "start", "size", begin).select(
        "part", "begin", F.least(F.lit(PIECE_BYTES), F.col("size") - F.col("begin")).alias("length"), (F.col("start") + F.col("begin")).alias("at")
    )
    tasks = max(1, min(-(-size // PIECE_BYTES) + parts.sparkSession.sparkContext.defaultParallelism, MOST_TASKS))
    try:
        written = pieces.repartition(tasks).mapInArrow(copy, "length long").agg(F.sum("length")).first()[0]
    except BaseException:
        stores.delete(temporary)
        raise
    return temporary, written or 0


def _in_order(parts: DataFrame, target: str, size: int) -> tuple[str, int]:
    """One task streams all parts, under a name of its attempt; the file and the bytes written."""
    folder = target.rpartition("/")[0]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        name, written = f"{folder}/.{attempt}{paths.TEMP_MARKER}.{attempt}", 0
        with stores.open_write(name) as out:
            for batch in batches:
                for part in batch.column("part").to_pylist():
                    with stores.open_read(part) as stream:
                        while block := stream.read(stores.BLOCK_BYTES):
                            out.write(block)
                            written += len(block)
            stores.sync(out)
        yield pa.RecordBatch.from_pydict({"name": [name], "length": pa.array([written], pa.int64())})

    stores.make_parents(target)
    return tuple(parts.coalesce(1).sortWithinPartitions("start").mapInArrow(copy, "name string, length long").first())


def write_manifest_bundle(manifest: DataFrame, destination: str, verification: DataFrame, digest: str = "xxh3_128") -> str:
    """Manifest and a short README, only once the final verification has passed."""
    if not verification.first()["passed"]:
        raise ValueError("the final verification did not pass; no manifest is written")
    parts = scratch_dir(manifest.sparkSession, "manifest")
    write_manifest(manifest, parts)
    target = publish_single_file(parts, f"{destination.rstrip('/')}/{MANIFEST_NAME}")
    readme = README_TEXT.format(digest=digest, tool=CHECK_TOOLS[digest], manifest=MANIFEST_NAME)
    _write_small(f"{destination.rstrip('/')}/{MANIFEST_README}", readme)
    return target


def write_checksums_file(manifest: DataFrame, directory: str) -> str:
    parts = scratch_dir(manifest.sparkSession, "checksums")
    write_checksums(manifest, parts)
    return publish_single_file(parts, f"{directory.rstrip('/')}/{CHECKSUMS_NAME}")


def _write_small(target: str, content: str, temporary: str | None = None) -> None:
    temporary = temporary or f"{target}.verify.tmp.1"
    stores.make_parents(target)
    with stores.open_write(temporary) as out:
        out.write(content.encode("utf-8"))
        stores.sync(out)
    stores.move(temporary, target)


def _write_together(folder: str, temporary: str, names: list[str], contents: list[str]) -> None:
    """Small files, all on the device before the first has its name; of equal names the last stays."""
    written = [f"{temporary}{i:04d}" for i in range(len(names))]
    for file, content in zip(written, contents, strict=True):
        with stores.open_write(file) as out:
            out.write((content + "\n").encode("utf-8"))
    stores.sync_files(written)
    for file, name in zip(written, names, strict=True):
        stores.move(file, f"{folder}/{name}")


def checkpoint_key(source: Column, destination: Column) -> Column:
    """24 hex digits naming the checkpoint of one (source, destination) pair."""
    return F.substring(F.sha2(F.concat(source, destination).cast("binary"), 256), 1, 24)


def checkpoint_key_xxh3(source: Column, destination: Column) -> Column:
    """XXH3-128 over both names with a NUL between."""
    return xxh3_128_hex(F.concat(source, F.lit("\u0000"), destination))


def write_checkpoint(outcomes: DataFrame, table: str, key: str, column: str = "checkpoint_key") -> None:
    """Append finished entries; rewriting everything after each one would cost O(n²) bytes."""
    outcomes.withColumn(column, F.lit(key)).write.mode("append").partitionBy(column).parquet(table)


def read_checkpoint_table(spark: SparkSession, table: str, key: str, size: str = "size") -> DataFrame:
    """Newest ``(path, digest, size)`` per path of one checkpoint; failed entries carry no digest."""
    rows = spark.read.parquet(table).filter(F.col("checkpoint_key") == key).filter("digest IS NOT NULL")
    return newest_per_path(rows, size)


def newest_per_path(rows: DataFrame, size: str = "size") -> DataFrame:
    """``(path, digest, size)`` of the row of each path that was finished last."""
    return latest_per_path(rows.withColumn("size", F.col(size)), "finished_ms", "digest", "size")


def checkpoint_lines(records: DataFrame) -> DataFrame:
    """Records in the exchange format of a checkpoint file."""
    size = F.col("size").cast("string")
    return records.select(F.concat_ws("\t", "digest", size, base64url_encode(F.col("path"))).alias("value"))


def write_quarantine(failures: DataFrame, destination: str) -> DataFrame:
    """One JSON report per failed entry, a file named by ``report_name``; returns the rows.

    A report is written under a name of its task's attempt and renamed, so a task that is run
    again, or twice at once, leaves one file per name.
    """
    folder = f"{destination.rstrip('/')}/{QUARANTINE_DIR}"
    rows = quarantine_rows(failures)
    text = json_report(F.col("source_relative"), F.col("attempts"), F.col("unix_time"), F.col("reason"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        temporary = f"{folder}/.{attempt}{paths.TEMP_MARKER}.{attempt}"
        stores.make_parents(temporary)
        for batch in batches:
            names, reports = (batch.column(c).to_pylist() for c in ("report_name", "report"))
            for some in range(0, len(names), REPORTS_AT_ONCE):
                _write_together(folder, temporary, names[some : some + REPORTS_AT_ONCE], reports[some : some + REPORTS_AT_ONCE])
            yield batch.drop_columns(["report", "place"])

    reported = rows.withColumns({"report": text, "place": F.monotonically_increasing_id()})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    stored, seen = store(reported, "failures", n=F.count("*"))
    width = int(failures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one name go to one task, so that the last of them stays
    spread = stored.repartition(max(width, -(-seen["n"] // REPORTS_PER_TASK)), "report_name").sortWithinPartitions("place")
    # stored: the files are written once, with the times that the rows tell
    return store(spread.mapInArrow(write, schema), "reports")[0]
