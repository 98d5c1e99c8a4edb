"""Path arithmetic and name predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

TEMP_MARKER = ".verify.tmp"
BACKUP_MARKER = ".verify.old"

# File names of the exchange formats, and names of tool caches and OS litter in lower case.
MANIFEST_NAME = "manifest.xxh3"
MANIFEST_README = "manifest.README.txt"
CHECKSUMS_NAME = "checksums.txt"
BASIC_JUNK_DIRS = (
    ".agents", ".claude", ".eggs", ".mplconfig", ".nox", ".tox", ".venv", "__pycache__", "build", "dist",
    "node_modules", "target", "venv",
)
BASIC_JUNK_FILES = (".ds_store", "desktop.ini", "thumbs.db")
EXTENDED_JUNK_DIRS = (
    ".agents", ".angular", ".claude", ".codex", ".cxx", ".dart_tool", ".eggs", ".externalnativebuild", ".gradle",
    ".idea", ".kotlin", ".mplconfig", ".next", ".nox", ".nuxt", ".svelte-kit", ".tauri", ".terraform", ".tox",
    ".turbo", ".venv", ".vscode", "__pycache__", "bower_components", "build", "cmakefiles", "coverage",
    "deriveddata", "dist", "htmlcov", "node_modules", "target", "venv",
)
EXTENDED_JUNK_FILES = (
    ".coverage", ".ds_store", ".eslintcache", ".localized", "desktop.ini", "nuitka-crash-report.xml", "thumbs.db",
)
_DIR_FAMILIES = r"^[.].*cache$|-venv$|^[.]pytest-tmp|[.]egg-info$|[.]build$|[.]dist$"
_EXTENDED_DIR_FAMILIES = _DIR_FAMILIES + "|^cmake-build-"
_EXTENDED_FILE_FAMILIES = r"^[.]coverage[.]|^[.]trashed-|^[.]_|[.]idsig$|[.]pyc$|[.]pyo$"


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def record_key(path: Column) -> Column:
    """Components joined by NUL, a separator no file name can hold."""
    return F.array_join(path_parts(path), "\u0000")


def normalize_path_key(path: Column) -> Column:
    """One spelling per component list: ``a//b``, ``a/./b`` and ``a/b/`` all become ``a/b``."""
    kept = F.filter(F.split(path, "/"), lambda part, i: (part != "") & ((part != ".") | (i == 0)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def relative_path(abs_path: Column, root: Column, root_name: Column | None = None) -> Column:
    """``abs_path`` below ``root``, prefixed by the root's own name when one is given."""
    below = F.substring(abs_path, F.length(root) + 2, F.length(abs_path))
    return below if root_name is None else F.concat_ws("/", root_name, below)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last component; empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Proper ancestor directories, outermost first."""
    parts = path_parts(path)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"),
    )


def _junk_dir_name(name: Column, exact: Sequence[str], families: str) -> Column:
    return name.isin(*exact) | name.rlike(families)


def is_junk_basic(parts: Column, is_dir: Column) -> Column:
    """Whether the last of ``parts`` (below the chosen root) is a tool cache or OS litter."""
    name = F.lower(F.element_at(parts, -1))
    return F.when(is_dir, _junk_dir_name(name, BASIC_JUNK_DIRS, _DIR_FAMILIES)).otherwise(
        name.isin(*BASIC_JUNK_FILES)
    )


def is_junk_extended(parts: Column, is_dir: Column) -> Column:
    name = F.lower(F.element_at(parts, -1))
    generated = (name == "gen") & (F.lower(F.try_element_at(parts, F.lit(-2))) == "src-tauri")
    as_dir = _junk_dir_name(name, EXTENDED_JUNK_DIRS, _EXTENDED_DIR_FAMILIES) | F.coalesce(generated, F.lit(False))
    as_file = name.isin(*EXTENDED_JUNK_FILES) | name.rlike(_EXTENDED_FILE_FAMILIES)
    return F.when(is_dir, as_dir).otherwise(as_file)


def junk_dir_test(kind: str) -> Callable[[str], bool]:
    """The directory side of the junk rules as a plain function, for tasks that walk a tree."""
    exact, families = {
        "basic": (set(BASIC_JUNK_DIRS), re.compile(_DIR_FAMILIES)),
        "extended": (set(EXTENDED_JUNK_DIRS), re.compile(_EXTENDED_DIR_FAMILIES)),
    }[kind]

    def is_junk(path: str) -> bool:
        lowered = path.lower()
        name = lowered.rpartition("/")[2]
        generated = kind == "extended" and f"/{lowered}".endswith("/src-tauri/gen")
        return name in exact or bool(families.search(name)) or generated

    return is_junk


def _any_junk(parts: Column, is_dir: Column, exact_dirs, dir_families, own: Column, generated: bool) -> Column:
    lowered = F.transform(parts, F.lower)
    above = F.slice(lowered, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.exists(above, lambda name: _junk_dir_name(name, exact_dirs, dir_families))
    if generated:
        joined = F.concat(F.lit("/"), F.array_join(above, "/"), F.lit("/"))
        hit = hit | joined.contains("/src-tauri/gen/")
    return (F.size(parts) > 0) & (hit | own)


def in_junk_basic(parts: Column, is_dir: Column) -> Column:
    """As :func:`is_junk_basic`, or below a directory that is: a dropped directory drops its subtree."""
    return _any_junk(parts, is_dir, BASIC_JUNK_DIRS, _DIR_FAMILIES, is_junk_basic(parts, is_dir), False)


def in_junk_extended(parts: Column, is_dir: Column) -> Column:
    return _any_junk(
        parts, is_dir, EXTENDED_JUNK_DIRS, _EXTENDED_DIR_FAMILIES, is_junk_extended(parts, is_dir), True
    )


def has_newline(path: Column) -> Column:
    return path.rlike("[\\r\\n]")


def is_reserved_first(path: Column, names: Sequence[str] = (MANIFEST_NAME, MANIFEST_README)) -> Column:
    """The first component would collide with the manifest written next to it."""
    return F.element_at(F.split(path, "/"), 1).isin(*names)


def is_reserved_single(path: Column, names: Sequence[str] = (MANIFEST_NAME, MANIFEST_README)) -> Column:
    """A file at the very top carries a reserved name."""
    parts = path_parts(path)
    return (F.size(parts) == 1) & F.try_element_at(parts, F.lit(1)).isin(*names)


def is_unsafe_path(path: Column) -> Column:
    """Absolute, climbing, or drive-prefixed: could lead outside the destination."""
    return path.startswith("/") | F.array_contains(F.split(path, "[/\\\\]"), "..") | path.rlike("^[A-Za-z]:|^\\\\")


def is_path_like(name: Column) -> Column:
    return name.contains("/") | name.contains("\\")


def is_own_artifact(name: Column, checksums_name: str = CHECKSUMS_NAME) -> Column:
    return (name == checksums_name) | name.endswith(".DS_Store")


def temp_name(name: Column, attempt: Column, marker: str = TEMP_MARKER) -> Column:
    return F.concat(name, F.lit(marker + "."), attempt.cast("string"))


def is_temp_name(name: Column, marker: str = TEMP_MARKER) -> Column:
    """``<name><marker>`` or ``<name><marker>.<digits>``."""
    return name.rlike(f"{_quote(marker)}([.][0-9]+)?$")


def is_temp_name_loose(name: Column, marker: str = TEMP_MARKER) -> Column:
    """Also the copies some stores make of a taken name, ``... (1)``."""
    return name.contains(marker + ".") | name.contains(marker + " (")


def is_backup_name(name: Column, marker: str = BACKUP_MARKER) -> Column:
    return name.rlike(f"{_quote(marker)}[.][0-9]+$")


def backup_final_name(name: Column, marker: str = BACKUP_MARKER) -> Column:
    return F.substring_index(name, marker + ".", 1)


def overlaps(source: Column, destination: Column) -> Column:
    """The destination lies in the source, or copying would write the source over itself."""
    source, destination = F.rtrim(source, F.lit("/")), F.rtrim(destination, F.lit("/"))
    inside = (destination == source) | destination.startswith(F.concat(source, F.lit("/")))
    return inside | (F.concat(destination, F.lit("/"), file_name(source)) == source)


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "__")


def _quote(marker: str) -> str:
    return "".join(f"[{c}]" if not c.isalnum() else c for c in marker)
