"""Progress events that a running job leaves as small files, for a stream to follow.

A task reports after every chunk of its files. Chunks are cut by the files alone and a
chunk's file is named by job, task and number, so a task that is run again writes the same
names with the same sums: a stream, which reads a name once, counts nothing twice.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from assay.schemas import PROGRESS_EVENT
from assay.sources import stores

CHUNK_FILES, CHUNK_BYTES = 64, 256 << 20
#: The driver's events come before or after those of all tasks of a phase.
_PER_PHASE = 1 << 48


def write_events(folder: str, name: str, rows: list[dict]) -> None:
    """One file of JSON lines, in place all at once; names with a dot are no input of a stream."""
    hidden, target = f"{folder}/.{name}.{time.time_ns()}", f"{folder}/{name}.json"
    stores.make_parents(target)
    with stores.open_write(hidden) as out:
        out.write("".join(json.dumps(row) + "\n" for row in rows).encode())
        stores.sync(out)
    stores.move(hidden, target)


def event(job: str, seq: int, kind: str, **fields) -> dict:
    return {"job_id": job, "seq": seq, "ts": datetime.now(timezone.utc).isoformat(), "kind": kind, **fields}


class JobEvents:
    """What the driver reports about one job; without a folder it reports nothing."""

    def __init__(self, folder: str | None, job: str):
        self.folder, self.job, self.phases = folder.rstrip("/") if folder else None, job, 0

    def phase(self, name: str, total_bytes: int | None = None) -> None:
        if not self.folder:
            return
        self.phases += 1
        seq = self.phases * _PER_PHASE
        rows = [event(self.job, seq, "Phase", phase=name), event(self.job, seq + 1, "Log", level="Info", message=name)]
        if total_bytes is not None:
            rows.append(event(self.job, seq + 2, "TotalBytes", bytes=total_bytes))
        write_events(self.folder, f"{self.job}-phase-{self.phases}", rows)


class TaskEvents:
    """Bytes and files of one task, chunk by chunk."""

    def __init__(self, folder: str | None, job: str, phase: int, task: int):
        self.folder, self.job, self.phase, self.task = folder, job, phase, task
        self.chunk = self.files = self.bytes = 0
        self.rows: list[dict] = []

    def done(self, path: str, size: int, message: str | None = None) -> None:
        """A file is through, copied or not; failures advance progress by their size as well."""
        if not self.folder:
            return
        self.files, self.bytes = self.files + 1, self.bytes + size
        if message:
            self.rows.append(event(self.job, self._seq(), "Log", level="Quarantine", message=message))
        if self.files >= CHUNK_FILES or self.bytes >= CHUNK_BYTES:
            self.flush(path)

    def _seq(self) -> int:
        return self.phase * _PER_PHASE + ((self.task + 1) << 24) + (self.chunk << 8) + min(len(self.rows), 255)

    def flush(self, path: str | None) -> None:
        if not self.folder or not self.files:
            return
        self.rows += [event(self.job, self._seq(), "CurrentFile", file=path), event(self.job, self._seq() + 1, "BytesAdvanced", bytes=self.bytes)]
        write_events(self.folder, f"{self.job}-{self.phase}-{self.task}-{self.chunk}", self.rows)
        self.chunk, self.files, self.bytes, self.rows = self.chunk + 1, 0, 0, []


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all jobs that report to ``folder``, as they come."""
    return spark.readStream.schema(PROGRESS_EVENT).json(folder)
