"""Manifest, checksum and checkpoint files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assay.functions import paths, text
from assay.operators import manifests
from assay.plans.sizing import BROADCAST_LIMIT_BYTES, estimated_bytes
from assay.plans.storing import store
from assay.schemas import QUARANTINE
from assay.sources import stores
from assay.sources.treesource import SHARES
from assay.sources.writers import QUARANTINE_DIR, REPORTS_PER_TASK


OPEN_COST_BYTES = 4 << 20
OFFSET_BYTES = 512
#: File names that a task passes on together.
NAMES_AT_ONCE = 10_000


def numbered_lines(spark: SparkSession, location: str) -> DataFrame:
    """``(line_no, value)`` of a text file, or of a folder of part files in name order.

    The file is split like any other: each split counts its lines, the counts are summed
    in order, and a line's number is its place in its split plus what came before. Only
    ``\\n`` ends a line.
    """
    lines = spark.read.option("lineSep", "\n").text(location).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    counted = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # A split is never smaller than the open cost, which bounds the number of offsets.
    splits = estimated_bytes(lines) // OPEN_COST_BYTES + len(lines.inputFiles())
    small = splits * OFFSET_BYTES <= BROADCAST_LIMIT_BYTES
    joined = lines.join(F.broadcast(offsets) if small else offsets, ["file", "block"])
    return joined.select((F.col("offset") + F.col("place") - F.col("first") + 1).alias("line_no"), "value")


def resolve_manifest(target: str, name: str = paths.MANIFEST_NAME) -> str:
    """The manifest itself, or the one in the folder given."""
    return target if stores.is_file(target) else f"{target.rstrip('/')}/{name}"


def read_manifest(
    spark: SparkSession, target: str, mode: str = "FAILFAST", digest: str = "xxh3_128"
) -> DataFrame:
    """``(path, digest)`` of a manifest file, the last line winning for a repeated path."""
    lines = numbered_lines(spark, target)
    return manifests.accept_manifest(manifests.parse_manifest_lines(lines, digest), mode)


def read_checksums(spark: SparkSession, location: str, mode: str = "FAILFAST") -> DataFrame:
    """``(path, digest)`` of a flat checksums file; any bad line fails it."""
    return manifests.accept_checksums(numbered_lines(spark, location), mode)


# Fixed value: the header of a checkpoint file, after the writer's own name.
CHECKPOINT_HEADER = "^[A-Z0-9]+-SHA256-1$"


def read_checkpoint(spark: SparkSession, location: str) -> DataFrame | None:
    """``(tree_id, path, digest, size)`` of a checkpoint file; None when the header is wrong."""
    lines = numbered_lines(spark, location)
    head = {row.line_no: row.value for row in lines.filter("line_no <= 2").collect()}
    header = spark.range(1).select(F.lit(head.get(1, "")).rlike(CHECKPOINT_HEADER)).first()[0]
    if not header or 2 not in head:
        return None
    tree_id = spark.range(1).select(text.base64url_decode(F.lit(head[2].rstrip("\r")))).first()[0]
    records = parse_checkpoint_records(lines.filter("line_no > 2"))
    return records.select(F.lit(tree_id).alias("tree_id"), "path", "digest", "size")


def parse_checkpoint_records(lines: DataFrame) -> DataFrame:
    """``(path, digest, size)`` of ``digest⇥size⇥base64url(path)`` lines; malformed ones fall away."""
    fields = F.split(F.regexp_replace("value", "\\r$", ""), "\t", 3)
    path = text.base64url_decode(F.element_at("fields", 3))
    return (
        lines.select(fields.alias("fields"))
        .filter(F.size("fields") == 3)
        .select(
            F.array_join(paths.path_parts(path), "/").alias("path"),
            F.element_at("fields", 1).alias("digest"),
            F.coalesce(F.element_at("fields", 2).try_cast("bigint"), F.lit(0)).alias("size"),
        )
    )


def read_quarantine(spark: SparkSession, destination: str) -> DataFrame:
    """QUARANTINE rows of the reports that ``write_quarantine`` left, with the name of each.

    Tasks list the folder, each a share of the names, and open the reports, so their number
    burdens neither the driver nor a single task.
    """
    folder = f"{destination.rstrip('/')}/{QUARANTINE_DIR}"

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column(0).to_pylist():
                # unfinished ones begin with a dot
                found = stores.file_names(folder, lambda name, share=share: name[0] not in "._" and crc32(name.encode()) % SHARES == share)
                while some := list(islice(found, NAMES_AT_ONCE)):
                    yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    listed = spark.range(0, SHARES, 1, SHARES).mapInArrow(names, "path string")
    files, seen = store(listed, "listing", n=F.count("*"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 1000):
                rows = []
                for name in batch.column(0).slice(some, 1000).to_pylist():
                    with stores.open_read(f"{folder}/{name}") as stream:
                        lines = stream.read().decode("utf-8").split("\n")
                    rows += [(name, line) for line in lines if line.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.string()) for i in (0, 1)], ["path", "value"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = files.repartition(max(width, -(-seen["n"] // REPORTS_PER_TASK)), "path")
    report = F.from_json("value", QUARANTINE)
    return spread.mapInArrow(read, "path string, value string").select(report.alias("report"), "path").select("report.*", F.col("path").alias("report_name"))
