"""File trees as entry tables.

A tree is listed in rounds. Each round spreads the directories still to be listed over
the cluster; a task lists its share and walks on below it until it has opened a fixed
number of directories or entries, and hands the rest to the next round. A directory of many
names is handed on in shares of its names. So no task is stuck with a large subtree, the driver never holds a listing, a small tree takes one round, and
pruned directories are never opened. Spark's ``binaryFile`` source is no substitute: it
leaves out empty and hidden files and holds whole contents in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay import schemas
from assay.functions import paths
from assay.functions.text import nfc
from assay.operators import ignore
from assay.plans import scans
from assay.plans.storing import store
from assay.sources import stores, treesource

DIRS_PER_TASK = 64

#: Directories a task opens, or entries it lists, before it hands on what is left.
WALK_BUDGET, ENTRY_BUDGET = 1000, 20_000
#: A directory of more names than this is listed in so many shares; each costs a pass over the names.
ONE_SHARE, SHARES = 5000, 32

_LISTED = (
    "parent string, name string, abs_path string, kind string, size long, mtime long, atime long, scan_error string, open boolean, share int, shares int"
)
_LISTED_ARROW = pa.schema(
    [
        ("parent", pa.string()), ("name", pa.string()), ("abs_path", pa.string()), ("kind", pa.string()),
        ("size", pa.int64()), ("mtime", pa.int64()), ("atime", pa.int64()), ("scan_error", pa.string()),
        ("open", pa.bool_()), ("share", pa.int32()), ("shares", pa.int32()),
    ]
)
_ROWS_PER_BATCH = 10_000


def _walk(batch: pa.RecordBatch, budget: int, skips: Callable[[str], bool] | None, hand_on: bool) -> Iterator[dict]:
    """Rows of the batch's directories and of what the budgets allow to open below them; rows of kind ``share`` are handed on."""
    todo = deque(batch.to_pylist())
    budget += len(todo)
    listed = 0
    while todo:
        directory = todo.popleft()
        base = directory["abs_path"].rstrip("/")
        budget -= 1
        share, shares = directory.get("share", 0), directory.get("shares", 1)
        rest = {"parent": directory["path"], "name": "", "abs_path": directory["abs_path"], "kind": "share", "open": True}
        wanted = (lambda name, share=share, shares=shares: crc32(name.encode()) % shares == share) if shares > 1 else None
        try:
            if hand_on and shares == 1 and stores.has_more_names(base or "/", ONE_SHARE):
                yield from (rest | {"share": i, "shares": SHARES} for i in range(SHARES))
                continue
            if hand_on and listed > ENTRY_BUDGET:
                yield rest | {"share": share, "shares": shares}
                continue
            for child in stores.list_dir(base or "/", wanted):
                listed += 1
                row = child | {"parent": directory["path"], "abs_path": f"{base}/{child['name']}", "open": False}
                if child["kind"] == "dir":
                    path = f"{directory['path']}/{child['name']}" if directory["path"] else child["name"]
                    if skips and skips(path):
                        continue
                    row["open"] = len(todo) >= budget
                    if not row["open"]:
                        todo.append({"path": path, "abs_path": row["abs_path"]})
                yield row
        except FileNotFoundError as error:
            if not directory["path"]:
                raise
            if share == 0:
                gone = {"parent": directory["path"], "name": "", "abs_path": base, "kind": "gone", "open": False}
                yield gone | {"scan_error": f"vanished: {error.strerror}"}


def _list_round(
    directories: DataFrame, n_dirs: int, budget: int = 0, skips: Callable[[str], bool] | None = None, hand_on: bool = False
) -> DataFrame:
    def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _walk(batch, budget, skips, hand_on)
            while chunk := list(islice(rows, _ROWS_PER_BATCH)):
                yield pa.RecordBatch.from_pylist(chunk, _LISTED_ARROW)

    spark = directories.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n_dirs, max(width, -(-n_dirs // DIRS_PER_TASK))))
    listed = directories.repartition(tasks).mapInArrow(list_batches, _LISTED)
    path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
    return listed.select(
        F.when(F.col("name") == "", F.col("parent")).otherwise(path).alias("path"),
        "abs_path",
        (F.col("kind") == "dir").alias("is_dir"),
        "kind",
        F.greatest("size", F.lit(0)).alias("size"),
        F.timestamp_micros("mtime").alias("mtime"),
        F.timestamp_micros("atime").alias("atime"),
        "scan_error",
        "open",
        "share",
        "shares",
    )


def scan_tree(
    spark: SparkSession,
    root: str,
    include_root: bool = True,
    skip_junk: str | None = None,
    respect_ignore_files: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """ENTRY rows of the regular files below ``root`` (or of ``root`` itself, if a file).

    ``include_root`` puts the root's own name in front of each path. ``skip_junk`` is
    ``"basic"`` or ``"extended"``; the root is exempt from it. Rows with a
    ``scan_error`` (vanished, not UTF-8) are kept for :func:`scan_warnings`.
    """
    if stores.is_file(root):
        return scan_single(spark, root)
    entries = scan_all(spark, root, skip_junk, respect_ignore_files, keep)
    return with_root_name(entries.filter(F.col("kind").isin("file", "gone")), root, include_root)


def scan_without_root(spark: SparkSession, root: str, **options) -> DataFrame:
    """Listing without the root's name in front: a whole volume, or a file system's root."""
    return scan_tree(spark, root, include_root=False, **options)


def with_root_name(entries: DataFrame, root: str, include_root: bool = True) -> DataFrame:
    name = root.rstrip("/").rpartition("/")[2]
    if not include_root or not name:
        return entries
    return entries.withColumn("path", F.concat(F.lit(name + "/"), F.col("path")))


def scan_single(spark: SparkSession, location: str) -> DataFrame:
    """One file as one entry named by its base name."""
    if not stores.is_file(location):
        raise IsADirectoryError(location)
    name = location.rstrip("/").rpartition("/")[2]
    size, mtime, atime = stores.stat_file(location)
    row = spark.range(1).select(
        F.lit(name).alias("path"),
        F.lit(location).alias("abs_path"),
        F.lit(False).alias("is_dir"),
        F.lit("file").alias("kind"),
        F.lit(size).cast("bigint").alias("size"),
        F.timestamp_micros(F.lit(mtime).cast("bigint")).alias("mtime"),
        F.timestamp_micros(F.lit(atime).cast("bigint")).alias("atime"),
        F.lit(None).cast("string").alias("scan_error"),
    )
    return row


def scan_all(
    spark: SparkSession,
    root: str,
    skip_junk: str | None = None,
    respect_ignore_files: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All kinds of entries below ``root``, with paths relative to it and pruned subtrees left out.

    ``keep`` and ignore files are applied between rounds, so these go one level a round.
    """
    junk = {None: None, "basic": paths.is_junk_basic, "extended": paths.is_junk_extended}[skip_junk]
    skips = paths.junk_dir_test(skip_junk) if skip_junk else None
    budget = 0 if respect_ignore_files or keep else WALK_BUDGET
    directories = spark.createDataFrame([("", root)], "path string, abs_path string")
    rules = spark.createDataFrame([], schemas.RULE)
    n_dirs, rounds = 1, []
    while n_dirs:
        listed = _list_round(directories, n_dirs, budget, skips, hand_on=True)
        found, seen = store(listed, "listing", n_open=F.count_if("open"))
        n_dirs = seen["n_open"]
        shares = found.filter("kind = 'share'").select("path", "abs_path", "share", "shares")
        found = found.filter("kind <> 'share'").drop("share", "shares")
        if junk is not None:
            found = found.filter((F.col("kind") == "gone") | ~junk(paths.path_parts(F.col("path")), F.col("is_dir")))
        if keep is not None:
            found = keep(found)
        if respect_ignore_files:
            rules = _extend_rules(rules, found)
            found = _drop_ignored(found, rules)
        rounds.append(found)
        directories = found.filter("open").select("path", "abs_path", F.lit(0).alias("share"), F.lit(1).alias("shares")).unionByName(shares)
    return reduce(DataFrame.unionByName, rounds).drop("open")


def list_directories(directories: DataFrame) -> DataFrame:
    """One level below each of ``(path, abs_path)``; a vanished directory becomes a row with a ``scan_error``."""
    return _list_round(directories, directories.count()).drop("open", "share", "shares")


def _extend_rules(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rules so far plus those of the ignore files in the directories just listed."""
    files = found.filter("kind = 'file' AND path RLIKE '(^|/)[.]gitignore$'")
    lines = read_ignore_lines(files).filter("error IS NULL")
    return rules.unionByName(store(ignore.rules_from_lines(lines), "rules")[0])


def _drop_ignored(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Every listed path lies in a kept directory, so only its own verdict is open."""
    known = rules.limit(ignore.COMPILED_RULES + 1).collect()
    if not known:
        return found
    if len(known) <= ignore.COMPILED_RULES:
        return found.filter(~ignore.compile_rules(known)(F.col("path"), F.col("is_dir")))
    return found.join(ignore.ignored_paths(found, rules), ["path", "is_dir"], "left_anti").select(*found.columns)


_LINES = "base_path string, line_no int, value string, error string"


def read_ignore_lines(files: DataFrame) -> DataFrame:
    """``(base_path, line_no, value, error)`` of ignore files; an unreadable one yields one error row.

    A file has to be UTF-8 throughout. It is streamed by one task; rules files are
    written by hand.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("base_path", pa.string()), ("line_no", pa.int32()), ("value", pa.string()), ("error", pa.string())]
        )
        for batch in batches:
            for file in batch.to_pylist():
                base = file["path"].rpartition("/")[0]
                try:
                    with stores.open_read(file["abs_path"]) as stream:
                        lines = stream.read().decode("utf-8").split("\n")
                except (OSError, UnicodeDecodeError) as error:
                    rows = [{"base_path": base, "line_no": 0, "value": None, "error": str(error)}]
                else:
                    rows = [
                        {"base_path": base, "line_no": no, "value": line, "error": None}
                        for no, line in enumerate(lines, start=1)
                    ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "abs_path").mapInArrow(read, _LINES)


def read_ignore_rules(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of every ``.gitignore`` among ``entries``, and ``(base_path, error)`` warnings."""
    files = entries.filter("kind = 'file' AND path RLIKE '(^|/)[.]gitignore$'")
    lines = read_ignore_lines(files)
    warnings = lines.filter("error IS NOT NULL").select("base_path", "error")
    return ignore.rules_from_lines(lines.filter("error IS NULL")), warnings


def scan_flat(spark: SparkSession, directory: str, own_name: str = paths.CHECKSUMS_NAME) -> DataFrame:
    """Everything but directories in one folder, by NFC name, without the engine's own artifacts.

    Several tasks list it, each a share of the names, and none holds the folder as a list.
    """
    listed = treesource.read_tree(spark, directory, recursive="false", includeRoot="false").filter("NOT is_dir AND kind <> 'gone'")
    named = listed.withColumn("path", nfc(F.col("path")))
    return store(named.filter(~paths.is_own_artifact(F.col("path"), own_name)), "listing")[0].orderBy("path")


def scan_warnings(entries: DataFrame) -> DataFrame:
    """Entries that vanished or could not be named, which a scan tolerates."""
    return entries.filter("scan_error IS NOT NULL").select("path", "scan_error")


def file_stats(entries: DataFrame) -> DataFrame:
    """Size and times; an unknown or negative size counts as 0."""
    return entries.select(
        "path", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("size"), "mtime", "atime"
    )


def digest_files(entries: DataFrame, digest: str = "xxh3_128", bytes_per_task: int = 4 << 30) -> DataFrame:
    """``(path, size, digest, error)`` of files, streamed block by block on the executors.

    Contents never enter a DataFrame. Files are spread by number and volume; an
    unreadable file gets a NULL digest and its error.
    """

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                row = {"path": file["path"], "size": file["size"], "digest": None, "error": None}
                try:
                    row["digest"] = stores.digest_file(file["abs_path"], digest)
                except OSError as error:
                    row["error"] = str(error)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    spread = spread_by_size(entries.select("path", "abs_path", "size"), bytes_per_task)
    return spread.mapInArrow(hash_batches, "path string, size long, digest string, error string")


def spread_by_size(files: DataFrame, bytes_per_task: int = 4 << 30, files_per_task: int = 20_000) -> DataFrame:
    """Spread files over enough tasks for their volume and number, both counted while the list is stored.

    A file weighs its bytes and a fixed share for opening it. Files are laid end to end and
    the line is cut into equal lengths, one per task: the file's middle decides. So a task
    holds at most one length and one file more, and files of one size are dealt evenly; a
    file above the length bounds its task, since one sequential digest cannot be split.
    """
    weight = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)) + F.lit(max(1, bytes_per_task // files_per_task))
    sliced = files.withColumns({"_weight": weight.cast("decimal(38,0)"), scans.SLICE: F.spark_partition_id()})
    stored, total = store(sliced, "work", weight=F.sum("_weight"), n=F.count("*"))
    if not total["n"]:
        return stored.select(*files.columns)
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = min(max(int(total["weight"]) // bytes_per_task + 1, width), total["n"])
    laid = scans.running(stored, [], ["path"], {"_upto": F.col("_weight")})
    middle = (F.col("_upto") - F.col("_weight") / 2).cast("double")
    task = F.least(F.floor(middle * n_tasks / float(total["weight"])), F.lit(n_tasks - 1)).cast("int")
    return laid.repartitionById(n_tasks, task).select(*files.columns)
