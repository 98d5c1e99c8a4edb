"""File access inside tasks: the local or mounted file system, or any store Arrow reaches by URI."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import re
import stat
import sys
from collections.abc import Callable, Iterator
from itertools import islice

BLOCK_BYTES = 1024 * 1024


def is_posix(location: str) -> bool:
    return "://" not in location or location.startswith("file:")


def local_path(location: str) -> str:
    return location.removeprefix("file:").replace("//", "/", 1) if location.startswith("file:") else location


def _arrow(location: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(location)


def _times(info: os.stat_result) -> dict:
    return {"mtime": info.st_mtime_ns // 1000, "atime": info.st_atime_ns // 1000}


def list_dir(location: str, wanted: Callable[[str], bool] | None = None) -> Iterator[dict]:
    """Children of one directory: name, kind (dir, file, link, other), size, times, error.

    Only names that are ``wanted`` are looked at. Links are reported, never followed. A child that vanishes while listed keeps a row
    with its error, as does a name that is not UTF-8; any other failure is raised.
    """
    if not is_posix(location):
        yield from (row for row in _list_store(location) if wanted is None or wanted(row["name"]))
        return
    with os.scandir(local_path(location)) as children:
        for child in children:
            name = child.name.encode("utf-8", "replace").decode("utf-8")
            if wanted is not None and not wanted(name):
                continue
            row = {"name": name, "kind": "other", "size": None, "mtime": None, "atime": None, "scan_error": None}
            try:
                info = child.stat(follow_symlinks=False)
            except FileNotFoundError as error:
                yield row | {"kind": "gone", "scan_error": f"vanished: {error.strerror}"}
                continue
            kind = {stat.S_IFDIR: "dir", stat.S_IFREG: "file", stat.S_IFLNK: "link"}.get(stat.S_IFMT(info.st_mode), "other")
            if name != child.name:
                row["scan_error"] = "name is not UTF-8"
            # a file moved or copied here keeps its modification time; the time its entry changed tells
            changed = max(info.st_ctime_ns, info.st_mtime_ns) // 1000
            yield row | {"kind": kind, "size": info.st_size if kind == "file" else None, "changed": changed} | _times(info)


def file_names(location: str, wanted: Callable[[str], bool]) -> Iterator[str]:
    """Names of the files of one directory that are ``wanted``; where the directory tells what is a file, none is looked at."""
    if not is_posix(location):
        yield from (row["name"] for row in _list_store(location) if row["kind"] == "file" and wanted(row["name"]))
        return
    with os.scandir(local_path(location)) as children:
        for child in children:
            name = child.name.encode("utf-8", "replace").decode("utf-8")
            if wanted(name) and child.is_file(follow_symlinks=False):
                yield name


def has_more_names(location: str, most: int) -> bool:
    """Whether a mounted directory has more than ``most`` names; stores list a directory at once, so it doesn't matter there."""
    if not is_posix(location):
        return False
    with os.scandir(local_path(location)) as children:
        return next(islice(children, most, None), None) is not None


def _list_store(location: str) -> Iterator[dict]:
    from pyarrow import fs

    store, root = _arrow(location)
    kinds = {fs.FileType.Directory: "dir", fs.FileType.File: "file"}
    for info in store.get_file_info(fs.FileSelector(root)):
        mtime = info.mtime_ns // 1000 if info.mtime_ns else None
        yield {
            "name": info.base_name,
            "kind": kinds.get(info.type, "other"),
            "size": info.size if info.type == fs.FileType.File else None,
            "mtime": mtime,
            "atime": None,
            "scan_error": None,
        }


def open_read(location: str):
    if is_posix(location):
        return open(local_path(location), "rb", buffering=0)
    store, path = _arrow(location)
    return store.open_input_stream(path)


def open_write(location: str):
    if is_posix(location):
        return open(local_path(location), "wb", buffering=0)
    store, path = _arrow(location)
    return store.open_output_stream(path)


def copy_range(part: str, begin: int, length: int, target: str, at: int) -> int:
    """Copy bytes [begin, begin + length) of ``part`` to the place ``at`` of a mounted file that is there; how many they were."""
    source = open_read(part) if is_posix(part) else _arrow(part)[0].open_input_file(_arrow(part)[1])
    left = length
    with source, open(local_path(target), "r+b", buffering=0) as out:
        source.seek(begin)
        out.seek(at)
        while left > 0 and (block := source.read(min(BLOCK_BYTES, left))):
            done = 0
            while done < len(block):
                done += out.write(block[done:])
            left -= len(block)
        sync(out)
    return length - left


def sync(stream) -> None:
    """Push written bytes to the device where the store has such a notion."""
    if isinstance(stream, io.FileIO):
        os.fsync(stream.fileno())


def begin_sync(stream) -> None:
    """Have written bytes sent to the device without waiting, so that :func:`sync` of many files waits about once; best effort."""
    drop_cached(stream)


def sync_file(location: str) -> None:
    """:func:`sync` of a file that was written and closed."""
    if is_posix(location):
        with open(local_path(location), "rb", buffering=0) as stream:
            sync(stream)


def sync_files(locations: list[str]) -> None:
    """:func:`sync` of files of one folder that were written and closed, by one request for all that waits there instead of one for each."""
    if locations and is_posix(locations[0]) and _sync_all is not None:
        folder = os.open(os.path.dirname(local_path(locations[0])), os.O_RDONLY)
        try:
            if _sync_all(folder):
                raise OSError(ctypes.get_errno(), os.strerror(ctypes.get_errno()), locations[0])
        finally:
            os.close(folder)
    else:
        for location in locations:
            sync_file(location)


def _find_sync_all() -> Callable[[int], int] | None:
    """``syncfs`` of a Linux that reports by it what could not be written (5.8 and later)."""
    release = re.match(r"(\d+)\.(\d+)", os.uname().release) if sys.platform == "linux" else None
    if release is None or (int(release[1]), int(release[2])) < (5, 8):
        return None
    return getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)


_sync_all = _find_sync_all()


def drop_cached(stream) -> None:
    """Ask for a read from the device rather than from memory; best effort."""
    if isinstance(stream, io.FileIO) and hasattr(os, "posix_fadvise"):
        os.posix_fadvise(stream.fileno(), 0, 0, os.POSIX_FADV_DONTNEED)


def stat_file(location: str) -> tuple[int, int | None, int | None]:
    """Size, and modification and access time in epoch microseconds."""
    if is_posix(location):
        info = os.stat(local_path(location))
        return info.st_size, *_times(info).values()
    store, path = _arrow(location)
    info = store.get_file_info(path)
    if info.size is None:
        raise FileNotFoundError(location)
    return info.size, info.mtime_ns // 1000 if info.mtime_ns else None, None


def size_of(location: str) -> int:
    return stat_file(location)[0]


def is_file(location: str) -> bool:
    if is_posix(location):
        return os.path.isfile(local_path(location))
    store, path = _arrow(location)
    return store.get_file_info(path).is_file


def make_parents(location: str) -> None:
    if is_posix(location):
        os.makedirs(os.path.dirname(local_path(location)), exist_ok=True)
    else:
        store, path = _arrow(location)
        store.create_dir(path.rpartition("/")[0], recursive=True)


def move(source: str, target: str) -> None:
    if is_posix(source):
        os.replace(local_path(source), local_path(target))
    else:
        store, path = _arrow(source)
        store.move(path, _arrow(target)[1])


def exists(location: str) -> bool:
    try:
        size_of(location)
    except FileNotFoundError:
        return False
    return True


def delete(location: str) -> None:
    """Remove a file; one that is already gone is fine."""
    try:
        if is_posix(location):
            os.remove(local_path(location))
        else:
            store, path = _arrow(location)
            store.delete_file(path)
    except FileNotFoundError:
        pass


def copy_times(source: str, target: str) -> bool:
    """Best effort; tells whether it worked."""
    if not (is_posix(source) and is_posix(target)):
        return False
    try:
        info = os.stat(local_path(source))
        os.utime(local_path(target), ns=(info.st_atime_ns, info.st_mtime_ns))
    except OSError:
        return False
    return True


def new_digest(name: str):
    if name == "xxh3_128":
        from xxhash import xxh3_128

        return xxh3_128()
    return hashlib.new(name)


class ShortReadError(OSError):
    """The file ended before its logical size."""


def digest_file(location: str, digest: str) -> str:
    """Stream exactly the file's logical size through a digest, a block at a time."""
    remaining = size_of(location)
    state = new_digest(digest)
    with open_read(location) as stream:
        drop_cached(stream)
        while remaining > 0:
            block = stream.read(min(BLOCK_BYTES, remaining))
            if not block:
                raise ShortReadError(f"{remaining} bytes missing")
            state.update(block)
            remaining -= len(block)
    return state.hexdigest()
