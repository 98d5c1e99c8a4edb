"""Verified file copies, run as tasks that report one outcome row per file."""

from __future__ import annotations

import errno
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from assay.functions import paths
from assay.functions.errors import DEVICE, DEVICE_IO_KINDS, FILE, TRANSIENT
from assay.operators.lookup import recover_backups
from assay.options import JobOptions
from assay.schemas import COPY_OUTCOME
from assay.plans.storing import store
from assay.sources import stores
from assay.sources.events import JobEvents, TaskEvents
from assay.sources.filetree import scan_all, spread_by_size

# The I/O kinds the error classes tell apart.
_IO_KINDS = {
    errno.ENOSPC: "StorageFull",
    errno.EACCES: "PermissionDenied",
    errno.EPERM: "PermissionDenied",
    errno.ENOENT: "NotFound",
    errno.ETIMEDOUT: "TimedOut",
}

_ARROW_OUTCOME = to_arrow_schema(COPY_OUTCOME)


class AttemptFailed(Exception):
    def __init__(self, kind: str, error: BaseException | str):
        super().__init__(str(error))
        self.kind = kind
        self.io_kind = _IO_KINDS.get(getattr(error, "errno", None), "Other")

    @property
    def error_class(self) -> str:
        if self.kind == "SourceRead":
            return FILE
        if self.kind == "HashMismatch":
            return TRANSIENT
        return DEVICE if self.io_kind in DEVICE_IO_KINDS else TRANSIENT


STOP_CHECK_SECS = 0.5
#: Files, and bytes in all, that are written before the first of them is synced.
FILES_AT_ONCE, BYTES_AT_ONCE = 250, 8 << 20
#: Files that a task deletes.
DELETES_PER_TASK = 10_000


def verified_copy(
    work: DataFrame,
    destination: str,
    options: JobOptions = JobOptions(),
    backup: bool = False,
    stop_file: str | None = None,
    events: JobEvents | None = None,
) -> DataFrame:
    """Copy each ``(path, abs_path, size)`` to ``destination/path``; one outcome row per file.

    Each file is written under a temporary name while being digested, synced, read back
    and digested again, and renamed last; small files are written some at a time before they are synced. Temporary names carry the task attempt, so a
    rerun or speculative task cannot collide, and a repeated copy ends in the same file.
    A task has a stretch of the files in component order. After a device failure, or
    ``failure_limit`` failures in a row, it leaves the rest of them alone (``STOPPED``) and
    leaves ``stop_file`` behind, at the sight of which the others stop as well: their
    outcomes so far are kept. Tasks report to ``events`` as they go.
    The copying happens when the outcome is read: write it out first, then use that.
    """
    root = destination.rstrip("/")
    told, job, phase = (events.folder, events.job, events.phases) if events else (None, "", 0)

    def copy_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        share = _Share(root, context.taskAttemptId(), options, backup, stop_file)
        progress = TaskEvents(told, job, phase, context.partitionId())
        last = None
        for batch in batches:
            rows = []
            for file, row in share.copy_all(batch.to_pylist()):
                last = file["path"]
                rows.append(row)
                progress.done(last, file["size"] or 0, f"{last}: {row['reason']}" if row["status"] == "FAILED" else None)
            yield pa.RecordBatch.from_pylist(rows, _ARROW_OUTCOME)
        progress.flush(last)

    spread = spread_by_size(work.select("path", "abs_path", "size")).sortWithinPartitions(F.split("path", "/"))
    return spread.mapInArrow(copy_batches, COPY_OUTCOME)


class _Share:
    """The files of one task."""

    def __init__(self, root: str, task: int, options: JobOptions, backup: bool, stop_file: str | None = None):
        self.root, self.task, self.options, self.backup, self.stop_file = root, task, options, backup, stop_file
        self.device_failed = self.stopped = False
        self.streak, self.looked = 0, 0.0

    def copy_all(self, files: list[dict]) -> Iterator[tuple[dict, dict]]:
        """Each file with its outcome, in order.

        Files that are small together are written and synced first, and then read back and renamed
        one by one, so that the device commits its journal about once for all of them.
        """
        first = 0
        while first < len(files):
            last, size, targets = first, 0, set()
            while last < len(files) and last - first < FILES_AT_ONCE and files[last]["path"] not in targets:
                size += files[last]["size"] or 0
                if size > BYTES_AT_ONCE and last > first:
                    break
                targets.add(files[last]["path"])
                last += 1
            group = files[first:last]
            written = self._write_ahead(group) if last - first > 1 else {}
            for file in group:
                yield file, self.copy(file, written.pop(file["path"], None))
            first = last

    def _write_ahead(self, files: list[dict]) -> dict[str, tuple[str, int] | AttemptFailed]:
        """By path, what the first attempt at writing the file led to; ends with the first failure of the device."""
        written: dict[str, tuple[str, int] | AttemptFailed] = {}
        for file in files:
            if self._is_stopped():
                break
            temporary = self._temporary(file["path"], 1)
            try:
                written[file["path"]] = _write(file["abs_path"], temporary, self.options.digest)
            except AttemptFailed as failure:
                stores.delete(temporary)
                written[file["path"]] = failure
                if failure.error_class == DEVICE:
                    break
        for path, done in written.items():
            if isinstance(done, tuple):
                try:
                    stores.sync_file(self._temporary(path, 1))
                except OSError as error:
                    written[path] = AttemptFailed("DestinationWrite", error)
        return written

    def _temporary(self, path: str, attempt: int) -> str:
        return f"{self.root}/{path}{paths.TEMP_MARKER}.{self.task}{attempt:03d}"

    def copy(self, file: dict, written: tuple[str, int] | AttemptFailed | None = None) -> dict:
        """The outcome of one file; ``written`` is what writing it ahead led to."""
        row = dict.fromkeys(COPY_OUTCOME.names) | {"path": file["path"], "bytes": file["size"], "attempts": 0}
        if self._is_stopped():
            if isinstance(written, tuple):
                stores.delete(self._temporary(file["path"], 1))
            return row | {"status": "STOPPED", "finished_ms": _now_ms()}
        row |= self._try(file["abs_path"], file["path"], written) | {"finished_ms": _now_ms()}
        self.streak = self.streak + 1 if row["status"] == "FAILED" else 0
        if self.device_failed or self.streak >= self.options.failure_limit:
            self.stopped = True
            if self.stop_file:
                stores.make_parents(self.stop_file)
                stores.open_write(self.stop_file).close()
        return row

    def _is_stopped(self) -> bool:
        now = time.monotonic()
        if not self.stopped and self.stop_file and now - self.looked >= STOP_CHECK_SECS:
            self.looked, self.stopped = now, stores.exists(self.stop_file)
        return self.stopped

    def _try(self, source: str, path: str, written: tuple[str, int] | AttemptFailed | None = None) -> dict:
        options, attempt, target = self.options, 0, f"{self.root}/{path}"
        while True:
            attempt += 1
            temporary = self._temporary(path, attempt)
            try:
                if isinstance(written, AttemptFailed):
                    raise written
                digest, size, times_kept = _attempt(source, target, temporary, options.digest, self.backup, written)
            except AttemptFailed as failure:
                written = None
                stores.delete(temporary)
                cls = failure.error_class
                unlimited = cls == TRANSIENT and options.unlimited_retries
                if cls != DEVICE and attempt < (options.attempt_ceiling if unlimited else options.max_retries):
                    time.sleep(options.backoff_unit_secs * (1 << min(attempt - 1, 5)))
                    continue
                self.device_failed = cls == DEVICE
                # Retries used up replace the error itself, and concern the file only.
                kind, cls = (failure.kind, DEVICE) if self.device_failed else ("RetriesExhausted", FILE)
                failed = {"status": "FAILED", "attempts": attempt, "error_kind": kind, "error_class": cls}
                return failed | {"io_kind": failure.io_kind, "reason": str(failure)}
            copied = {"status": "COPIED", "attempts": attempt, "digest": digest, "bytes": size}
            return copied | {"times_kept": times_kept}


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


def _attempt(
    source: str, target: str, temporary: str, digest: str, backup: bool, ahead: tuple[str, int] | None = None
) -> tuple[str, int, bool]:
    """Digest and size of what ``target`` has, and whether with the source's times; ``ahead`` is of a file already written."""
    written, size = ahead or _write(source, temporary, digest, synced=True)
    try:
        read_back = stores.digest_file(temporary, digest)
    except OSError as error:
        raise AttemptFailed("VerifyRead", error) from error
    if read_back != written:
        raise AttemptFailed("HashMismatch", f"written {written}, read back {read_back}")
    times_kept = stores.copy_times(source, temporary)
    try:
        (_promote_with_backup if backup else stores.move)(temporary, target)
    except OSError as error:
        raise AttemptFailed("DestinationWrite", error) from error
    return written, size, times_kept


def _write(source: str, temporary: str, digest: str, synced: bool = False) -> tuple[str, int]:
    """One read of the source feeds both the digest and the copy."""
    state, n_read, n_written = stores.new_digest(digest), 0, 0
    try:
        reader = stores.open_read(source)
    except OSError as error:
        raise AttemptFailed("SourceRead", error) from error
    with reader:
        try:
            stores.make_parents(temporary)
            writer = stores.open_write(temporary)
        except OSError as error:
            raise AttemptFailed("DestinationWrite", error) from error
        with writer:
            while True:
                try:
                    block = reader.read(stores.BLOCK_BYTES)
                except OSError as error:
                    raise AttemptFailed("SourceRead", error) from error
                if not block:
                    break
                n_read += len(block)
                state.update(block)
                try:
                    rest = memoryview(block)
                    while rest:
                        n = writer.write(rest)
                        n_written += n
                        rest = rest[n:]
                except OSError as error:
                    raise AttemptFailed("DestinationWrite", error) from error
            try:
                (stores.sync if synced else stores.begin_sync)(writer)
            except OSError as error:
                raise AttemptFailed("DestinationWrite", error) from error
    if n_written != n_read:
        raise AttemptFailed("DestinationWrite", f"{n_written} bytes written, {n_read} read")
    return state.hexdigest(), n_read


def _promote_with_backup(temporary: str, target: str) -> None:
    aside = None
    if stores.exists(target):
        aside = f"{target}{paths.BACKUP_MARKER}.{_now_ms()}"
        stores.move(target, aside)
    try:
        stores.move(temporary, target)
    except OSError:
        if aside:
            stores.move(aside, target)
        raise
    if aside:
        stores.delete(aside)


def stale_temps(listing: DataFrame) -> DataFrame:
    """Leftover temporary files of interrupted runs."""
    return listing.filter((F.col("kind") == "file") & paths.is_temp_name(paths.file_name(F.col("path"))))


def clean_stale_temps(spark, destination: str, dry_run: bool = False, listing: DataFrame | None = None) -> DataFrame:
    """``(path, abs_path, deleted)`` of leftovers below ``destination``; deleting is best effort.

    ``listing`` is what :func:`scan_all` found there, if that is known.
    """
    found = stale_temps(scan_all(spark, destination) if listing is None else listing).select("path", "abs_path")
    if dry_run:
        return found.withColumn("deleted", F.lit(False))

    return delete_files(found)


def delete_files(files: DataFrame) -> DataFrame:
    """Delete each ``(path, abs_path)``; the stored report tells which went."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_quietly(stores.delete, location) for location in batch.column("abs_path").to_pylist()]
            yield batch.append_column("deleted", pa.array(done, pa.bool_()))

    return store(_spread(files, "abs_path").mapInArrow(remove, "path string, abs_path string, deleted boolean"), "report")[0]


def _spread(files: DataFrame, column: str) -> DataFrame:
    """Neighbours share a task, and no task has many: tasks that delete in the same folders wait for each other."""
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(max(width, -(-files.count() // DELETES_PER_TASK)), column)


def recover_interrupted(spark, destination: str, listing: DataFrame | None = None) -> DataFrame:
    """Put back each backup whose final file is gone, delete the others; returns the actions taken."""
    root = destination.rstrip("/")
    found = scan_all(spark, destination) if listing is None else listing
    actions = recover_backups(found.filter("kind = 'file'"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                backup, final = f"{root}/{row['path']}", f"{root}/{row['final_path']}"
                restore = row["action"] == "restore"
                done.append(_quietly(stores.move, backup, final) if restore else _quietly(stores.delete, backup))
            yield batch.append_column("done", pa.array(done, pa.bool_()))

    schema = "path string, final_path string, action string, done boolean"
    return store(actions.mapInArrow(act, schema), "report")[0]


def _quietly(action, *args) -> bool:
    try:
        action(*args)
    except OSError:
        return False
    return True
