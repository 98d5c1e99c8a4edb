"""A file tree as a Spark data source, in batch and as a stream of new files.

    treesource.register(spark)
    spark.read.format("filetree").load("/mnt/archive").filter("path LIKE 'archive/2024%' AND size > 0")
    spark.readStream.format("filetree").load("/mnt/inbox")

Options: ``includeRoot`` (``true``: the root's own name leads each path), ``recursive``
(``true``), ``skipJunk`` (``basic`` or ``extended`` leaves those directories out), ``tasks``,
and for streams ``settleSeconds``.

Planning opens directories from the top until there is enough to share out, and keeps only
names of directories. Each of them, opened or not, becomes a partition that a task lists;
an opened one is split into shares of its names, so that a directory of a million files is
read by several tasks, each of which streams the names and looks at its own. Conditions on
``path``, ``kind`` and ``size`` are applied while listing: directories that can't hold a wanted
path are never opened.

A stream's offset is a time: a micro-batch has the files whose entry last changed (created,
renamed, written) since the one before. Files younger than ``settleSeconds`` wait for the next
one, since a clock may lag; a file that is written again arrives again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema

from assay.functions import paths
from assay.schemas import ENTRY
from assay.sources import stores

NAME = "filetree"
#: Directories that planning opens at most, and partitions it makes at most.
PLAN_DIRS, PARTITIONS = 64, 256
#: Shares that an opened directory's names are split into; each share costs a pass over the names.
SHARES = 8
SETTLE_SECONDS = 2.0
_ROWS_PER_BATCH = 10_000
_ARROW = to_arrow_schema(ENTRY)


@dataclass(frozen=True)
class Wanted:
    """What the pushed conditions leave over."""

    prefixes: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None
    changed_after: int | None = None
    changed_until: int | None = None

    def below(self, directory: str) -> bool:
        """Whether a wanted path may lie below a directory."""
        inside = directory + "/" if directory else ""
        return all(p.startswith(inside) or inside.startswith(p) for p in self.prefixes) and all(p.startswith(inside) for p in self.exact)

    def row(self, row: dict) -> bool:
        path, size = row["path"], row["size"]
        return (
            all(path.startswith(p) for p in self.prefixes)
            and all(path == p for p in self.exact)
            and all(row["kind"] == k for k in self.kinds)
            and (self.least is None or (size is not None and size >= self.least))
            and (self.most is None or (size is not None and size <= self.most))
        )

    def fresh(self, changed: int | None) -> bool:
        if self.changed_until is None:
            return True
        return changed is not None and self.changed_after < changed <= self.changed_until


@dataclass
class Listing(InputPartition):
    """Directories (path, location) to list, whole subtrees or one level each, and which share of their names."""

    directories: list
    deep: bool
    share: int = 0
    shares: int = 1

    def __post_init__(self):
        super().__init__(None)


class _Tree:
    """What readers of both kinds have in common."""

    def __init__(self, options: dict):
        options = {key.lower(): value for key, value in options.items()}
        self.root = options["path"].rstrip("/") or "/"
        name = self.root.rpartition("/")[2]
        self.top = name if options.get("includeroot", "true").lower() == "true" else ""
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.junk = options.get("skipjunk")
        self.tasks = int(options.get("tasks", "32"))

    def skips(self) -> Callable[[str], bool]:
        junk = paths.junk_dir_test(self.junk) if self.junk else lambda path: False
        lead = len(self.top) + 1 if self.top else 0
        return lambda path: junk(path[lead:])

    def plan(self, wanted: Wanted) -> list[Listing]:
        if stores.is_file(self.root):
            return [Listing([(self.root.rpartition("/")[2], self.root)], False)]
        top = (self.top, self.root)
        if not self.recursive:
            return [Listing([top], False, share, SHARES) for share in range(SHARES)]
        skips, opened, waiting = self.skips(), [], deque([top])
        while waiting and len(opened) < PLAN_DIRS and len(waiting) < self.tasks:
            path, location = waiting.popleft()
            opened.append((path, location))
            try:
                for child in stores.list_dir(location):
                    below = f"{path}/{child['name']}" if path else child["name"]
                    if child["kind"] == "dir" and not skips(below) and wanted.below(below):
                        waiting.append((below, f"{location.rstrip('/')}/{child['name']}"))
            except FileNotFoundError:
                if location == self.root:
                    raise
        each = max(1, -(-len(waiting) // PARTITIONS))
        waiting = list(waiting)
        deep = [Listing(waiting[i : i + each], True) for i in range(0, len(waiting), each)]
        return [Listing([d], False, share, SHARES) for d in opened for share in range(SHARES)] + deep

    def rows(self, listing: Listing, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        found = self._single(listing.directories[0]) if listing.directories[0][1] == self.root and stores.is_file(self.root) else self._walk(listing, wanted)
        kept = (row for row, changed in found if wanted.row(row) and (row["kind"] == "dir" or wanted.fresh(changed)))
        while chunk := list(islice(kept, _ROWS_PER_BATCH)):
            yield pa.RecordBatch.from_pylist(chunk, _ARROW.remove_metadata())

    @staticmethod
    def _single(file):
        path, location = file
        size, mtime, atime = stores.stat_file(location)
        yield _entry(path, location, {"kind": "file", "size": size, "mtime": mtime, "atime": atime, "scan_error": None}), mtime

    def _walk(self, listing: Listing, wanted: Wanted):
        skips, todo = self.skips(), deque(listing.directories)
        while todo:
            path, location = todo.popleft()
            base = location.rstrip("/")
            mine = None if listing.shares == 1 else lambda name: crc32(name.encode("utf-8", "replace")) % listing.shares == listing.share
            try:
                for child in stores.list_dir(location, mine):
                    below = f"{path}/{child['name']}" if path else child["name"]
                    if child["kind"] == "dir":
                        if skips(below):
                            continue
                        if listing.deep and wanted.below(below):
                            todo.append((below, f"{base}/{child['name']}"))
                    yield _entry(below, f"{base}/{child['name']}", child), child.get("changed", child["mtime"])
            except FileNotFoundError as error:
                if location == self.root:
                    raise
                gone = {"kind": "gone", "size": None, "mtime": None, "atime": None, "scan_error": f"vanished: {error.strerror}"}
                if listing.share == 0:
                    yield _entry(path, base, gone), None


def _entry(path: str, location: str, child: dict) -> dict:
    size = child["size"]
    return {"path": path, "abs_path": location, "is_dir": child["kind"] == "dir", "kind": child["kind"], "size": None if size is None else max(size, 0),
            "mtime": child["mtime"], "atime": child["atime"], "scan_error": child["scan_error"]}


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree, self.wanted = _Tree(options), Wanted()

    def pushFilters(self, filters):
        taken = {"prefixes": [], "exact": [], "kinds": [], "least": [], "most": []}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            match f:
                case StringStartsWith() if column == "path":
                    taken["prefixes"].append(f.value)
                case EqualTo() if column == "path":
                    taken["exact"].append(f.value)
                case EqualTo() if column == "kind":
                    taken["kinds"].append(f.value)
                case GreaterThan() | GreaterThanOrEqual() if column == "size":
                    taken["least"].append(f.value + isinstance(f, GreaterThan))
                case LessThan() | LessThanOrEqual() if column == "size":
                    taken["most"].append(f.value - isinstance(f, LessThan))
                case _:
                    yield f
        self.wanted = Wanted(
            tuple(taken["prefixes"]), tuple(taken["exact"]), tuple(taken["kinds"]), max(taken["least"], default=None), min(taken["most"], default=None)
        )

    def partitions(self):
        return self.tree.plan(self.wanted)

    def read(self, partition):
        return self.tree.rows(partition, self.wanted)


@dataclass
class Window(InputPartition):
    listing: Listing
    after: int
    until: int

    def __post_init__(self):
        super().__init__(None)


class TreeStream(DataSourceStreamReader):
    """Files whose entry changed within a window of time; directories are not rows of a stream."""

    def __init__(self, options: dict):
        self.tree, self.settle = _Tree(options), float({k.lower(): v for k, v in options.items()}.get("settleseconds", SETTLE_SECONDS))

    def initialOffset(self) -> dict:
        return {"until": -(2**62)}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1_000_000)}

    def partitions(self, start: dict, end: dict):
        if end["until"] <= start["until"]:  # the clock was set back
            return []
        return [Window(listing, start["until"], end["until"]) for listing in self.tree.plan(Wanted())]

    def read(self, partition: Window):
        wanted = Wanted(kinds=("file",), changed_after=partition.after, changed_until=partition.until)
        return self.tree.rows(partition.listing, wanted)

    def commit(self, end: dict) -> None:
        pass


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """ENTRY rows of everything below ``root``, or of a file."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)


def stream_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """ENTRY rows of the files below ``root``, each when it appears or changes."""
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(root)
