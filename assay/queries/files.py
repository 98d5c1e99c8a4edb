"""File-shaped operators: every document becomes a file, and the operators run on those."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assay.functions import paths
from assay.operators import copying, manifests, resume, verify
from assay.options import JobOptions
from assay.plans import jobs
from assay.plans.storing import store
from assay.queries import fixtures as X
from assay.queries.registry import Tables, query
from assay.session import scratch_dir
from assay.sources import filetree, readers, stores, treesource, writers

SRC = X.with_(X.SOURCE)
QUICK = JobOptions(digest="md5", backoff_unit_secs=0.0)

_exported: dict[tuple[str, str], str] = {}


def write_files(entries: DataFrame, root: str) -> None:
    """One file per ``(path, payload)``, written by the executors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{root}/{row['path']}"
                stores.make_parents(target)
                with stores.open_write(target) as out:
                    out.write((row["payload"] or "").encode("utf-8"))
            yield batch.select(["path"])

    written = entries.select("path", F.col("payload").cast("string").alias("payload")).mapInArrow(write, "path string")
    written.write.format("noop").mode("overwrite").save()


def source_files(t: Tables) -> str:
    """The folder holding this table's documents as files; written once a session."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _exported:
        place = scratch_dir(t.spark, "files")
        write_files(X.source_entries(t), place)
        _exported[key] = place
    return _exported[key]


@query(SRC + "SELECT path, size FROM source")
def scan_tree(t: Tables):
    return filetree.scan_tree(t.spark, f"{source_files(t)}/root").select("path", "size")


@query(SRC + "SELECT path, size FROM source WHERE starts_with(path, 'root/') AND contains(path, '/en/') AND size > 100")
def scan_tree_source(t: Tables):
    """The listing as a data source, which opens no folder that the conditions rule out."""
    listed = treesource.read_tree(t.spark, f"{source_files(t)}/root").filter("kind = 'file' AND size > 100")
    return listed.filter(F.col("path").startswith("root/") & F.col("path").contains("/en/")).select("path", "size")


@query(SRC + "SELECT path, size FROM source")
def stream_tree(t: Tables):
    """New files as a stream, run until none is left."""
    target, root = scratch_dir(t.spark, "arrived"), f"{source_files(t)}/root"
    feed = treesource.stream_tree(t.spark, root, settleSeconds="0").select("path", "size").writeStream.format("parquet")
    feed.option("path", target).option("checkpointLocation", f"{target}.offsets").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(target)


@query(SRC + "SELECT substr(path, 6) AS path, size FROM source")
def scan_without_root(t: Tables):
    return filetree.scan_without_root(t.spark, f"{source_files(t)}/root").select("path", "size")


@query(
    X.with_(X.TREE)
    + """SELECT path FROM (SELECT path, string_split(lower(path), '/') AS parts FROM tree_files)
         WHERE len(list_filter(parts[2:len(parts) - 1], lambda d: d IN ("""
    + ", ".join(f"'{name}'" for name in paths.BASIC_JUNK_DIRS)
    + """) OR regexp_matches(d, '^[.].*cache$|-venv$|^[.]pytest-tmp|[.]egg-info$|[.]build$|[.]dist$'))) = 0"""
)
def scan_tree_skip_junk(t: Tables):
    return filetree.scan_tree(t.spark, f"{_tree_files(t)}/root", skip_junk="basic").select("path")


def _tree_files(t: Tables) -> str:
    place = scratch_dir(t.spark, "tree")
    files = X.path_tree(t).filter("NOT is_dir").select("path", F.col("path").alias("payload"))
    write_files(files, place)
    return place


@query(SRC + "SELECT regexp_extract(path, '[^/]*$') AS path, size FROM source")
def scan_flat(t: Tables):
    place = scratch_dir(t.spark, "flat")
    names = X.source_entries(t).select(paths.file_name(F.col("path")).alias("path"), "payload")
    mac = t.spark.range(1).select(F.lit(".DS_Store").alias("path"), F.lit("x").alias("payload"))
    write_files(names.unionByName(mac), place)
    return filetree.scan_flat(t.spark, place).select("path", "size")


@query(SRC + "SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) || '-gone' AS path, TRUE AS warned FROM source")
def scan_tolerant(t: Tables):
    # Every folder, and one beside it that has vanished.
    root = source_files(t)
    folders = X.source_entries(t).select(paths.parent_dir(F.col("path")).alias("path")).distinct()
    both = folders.unionByName(folders.select(F.concat("path", F.lit("-gone")).alias("path")))
    listed = filetree.list_directories(both.withColumn("abs_path", F.concat(F.lit(f"{root}/"), "path")))
    return filetree.scan_warnings(listed).select("path", F.col("scan_error").startswith("vanished").alias("warned"))


@query(SRC + "SELECT path, size, TRUE AS has_mtime FROM source")
def file_stats(t: Tables):
    stats = filetree.file_stats(filetree.scan_tree(t.spark, f"{source_files(t)}/root"))
    return stats.select("path", "size", F.col("mtime").isNotNull().alias("has_mtime"))


@query(SRC + "SELECT path, md5(payload) AS digest FROM source")
def digest_files(t: Tables):
    entries = filetree.scan_tree(t.spark, f"{source_files(t)}/root")
    return filetree.digest_files(entries, "md5").select("path", "digest")


@query(
    X.with_(X.TREE)
    + """SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS base_path, 1::INT AS rule_seq, '^p_' || page_id || '[^/]*$' AS regex
         FROM (SELECT min(page_id) AS page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/x' AS path
               FROM (SELECT CAST(regexp_extract(path, 'p_([0-9]+)', 1) AS BIGINT) AS page_id, path FROM tree_files) GROUP BY 2)"""
)
def read_ignore_rules(t: Tables):
    # One ignore file in every folder, naming its first page.
    place = scratch_dir(t.spark, "ruled")
    files = X.path_tree(t).filter("NOT is_dir")
    page = F.regexp_extract("path", "p_([0-9]+)", 1).cast("bigint")
    firsts = files.groupBy(paths.parent_dir(F.col("path")).alias("folder")).agg(F.min(page).alias("page"))
    line = F.concat(F.lit("p_"), F.col("page").cast("string"), F.lit("*\n# done\n"))
    write_files(firsts.select(F.concat("folder", F.lit("/.gitignore")).alias("path"), line.alias("payload")), place)
    rules, _ = filetree.read_ignore_rules(filetree.scan_without_root(t.spark, place))
    return rules.select("base_path", "rule_seq", "regex")


@query(SRC + "SELECT path, md5(payload) AS digest, size AS bytes, CAST(1 AS INT) AS attempts, 'COPIED' AS status FROM source")
def verified_copy(t: Tables):
    place = scratch_dir(t.spark, "copied")
    entries = filetree.scan_tree(t.spark, f"{source_files(t)}/root")
    outcomes, _ = store(copying.verified_copy(entries, place, QUICK), "outcomes")
    return outcomes.select("path", "digest", "bytes", "attempts", "status")


@query(SRC + "SELECT count(*) AS checked, 0::BIGINT AS problems, TRUE AS passed FROM source")
def copy_tree(t: Tables):
    place = scratch_dir(t.spark, "job")
    return jobs.copy_tree(t.spark, f"{source_files(t)}/root", place, QUICK).verification


@query(SRC + "SELECT path, CASE substr(md5(path), 1, 1) WHEN '0' THEN 'COPIED' WHEN '1' THEN 'COPIED' ELSE 'SKIPPED' END AS status FROM source")
def copy_tree_resumed(t: Tables):
    # A finished copy loses some files (0) and has others altered (1); the next run puts back just those.
    place, table = scratch_dir(t.spark, "job"), scratch_dir(t.spark, "checkpoint")
    jobs.copy_tree(t.spark, f"{source_files(t)}/root", place, QUICK, checkpoint_table=table)
    source = X.source_entries(t)
    fault = X.draw(F.col("path"), 1)
    write_files(source.filter(fault == "1").select("path", F.reverse("payload").alias("payload")), place)
    lost = source.filter(fault == "0").select("path", F.concat(F.lit(f"{place}/"), "path").alias("abs_path"))
    copying.delete_files(lost).count()
    resumed = jobs.copy_tree(t.spark, f"{source_files(t)}/root", place, QUICK, checkpoint_table=table)
    return resumed.outcomes.select("path", "status")


def _bundle(t: Tables) -> str:
    """A folder with the documents' manifest; returns the manifest's place."""
    place = scratch_dir(t.spark, "bundle")
    stores.make_parents(f"{place}/x")
    manifest = manifests.digest_entries(X.source_entries(t)).select("path", "digest")
    return writers.write_manifest_bundle(manifest, place, verify.final_reverify(manifest, manifest))


@query(SRC + "SELECT md5(payload) || '  ' || path AS value, row_number() OVER (ORDER BY string_split(path, '/')) AS line_no FROM source")
def write_manifest_bundle(t: Tables):
    return readers.numbered_lines(t.spark, _bundle(t)).select("line_no", "value")


@query(SRC + "SELECT path, md5(payload) AS digest FROM source")
def resolve_manifest(t: Tables):
    folder = _bundle(t).rpartition("/")[0]
    return readers.read_manifest(t.spark, readers.resolve_manifest(folder))


@query(SRC + "SELECT 'manifest.xxh3' AS path, CAST(sum(32 + 2 + strlen(path) + 1) AS BIGINT) AS size FROM source")
def scan_single(t: Tables):
    return filetree.scan_single(t.spark, _bundle(t)).select("path", "size")


@query(
    SRC
    + """SELECT path, CASE substr(md5(path), 1, 1) WHEN '0' THEN 'MISSING' WHEN '1' THEN 'FAIL' ELSE 'OK' END AS status FROM source"""
)
def verify_tree(t: Tables):
    # A manifest of the documents, and a folder from which some are missing and in which some are altered.
    place = scratch_dir(t.spark, "received")
    source = X.source_entries(t)
    fault = X.draw(F.col("path"), 1)
    altered = F.when(fault == "1", F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    write_files(source.filter(fault != "0").select("path", altered.alias("payload")), place)
    manifest = source.select("path", F.md5(F.col("payload").cast("binary")).alias("digest"))
    writers.write_manifest_bundle(manifest, place, t.spark.range(1).select(F.lit(True).alias("passed")))
    return jobs.verify_tree(t.spark, place, digest="md5").select("path", "status")


@query(
    SRC
    + """SELECT path, md5(payload) AS recorded, size AS found_size FROM source WHERE substr(md5(path), 1, 1) > '1'"""
)
def resume_candidates(t: Tables):
    source = filetree.scan_tree(t.spark, f"{source_files(t)}/root")
    fault = X.draw(F.col("path"), 1)
    recorded = X.source_entries(t).select("path", F.md5(F.col("payload").cast("binary")).alias("digest"), "size")
    previous = recorded.filter(fault != "0")
    there = source.select("path", "abs_path", (F.col("size") + (fault == "1").cast("int")).alias("size"))
    return resume.resume_candidates(source, previous, there).select("path", "recorded", "found_size")


@query(SRC + "SELECT path || '.verify.tmp.' || doc_id AS path, TRUE AS deleted FROM source")
def clean_stale_temps(t: Tables):
    place = scratch_dir(t.spark, "stale")
    source = X.source_entries(t)
    left = F.concat("path", F.lit(".verify.tmp."), F.col("doc_id").cast("string"))
    write_files(source.select("path", "payload").unionByName(source.select(left.alias("path"), "payload")), place)
    return copying.clean_stale_temps(t.spark, place).select("path", "deleted")


@query(SRC + "SELECT 'checksums.txt' AS name, count(*) AS ok, 0::BIGINT AS fail, 0::BIGINT AS missing FROM source")
def check_folder(t: Tables):
    place = scratch_dir(t.spark, "folder")
    names = X.source_entries(t).select(paths.file_name(F.col("path")).alias("path"), "payload")
    write_files(names, place)
    jobs.generate_checksums(t.spark, place)
    summary = verify.status_summary(jobs.check_checksums(t.spark, place))
    return summary.select(F.lit(paths.CHECKSUMS_NAME).alias("name"), "ok", "fail", "missing")
