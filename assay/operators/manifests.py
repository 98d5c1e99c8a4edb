"""Manifest tables: build, deduplicate, validate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from assay.functions import paths
from assay.functions.digests import DIGESTS, valid_digest
from assay.functions.text import manifest_line, nfc
from assay.plans.skew import spread_join
from assay.plans.storing import store


def digest_entries(entries: DataFrame, digest: str = "md5", payload: str = "payload") -> DataFrame:
    """``(path, size, digest)`` of entries carrying their content; a NULL payload stays unreadable.

    The digest is taken where the content is read, so only its hex text is ever shuffled.
    """
    content = F.col(payload)
    return entries.select("path", "size", DIGESTS[digest](content).alias("digest"))


def generate_manifest(entries: DataFrame, digest: str = "md5", payload: str = "payload") -> DataFrame:
    """``(path, digest)`` of every readable entry. The sinks sort; a table needs no order."""
    readable = entries.filter(F.col(payload).isNotNull())
    return digest_entries(readable, digest, payload).select("path", "digest")


def unreadable_entries(entries: DataFrame, payload: str = "payload") -> DataFrame:
    """The other output of :func:`generate_manifest`: entries that could not be hashed."""
    return entries.filter(F.col(payload).isNull()).select("path", F.lit("unreadable").alias("error"))


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """``digest␠␠path`` lines in component order, ready for a text sink."""
    ordered = manifest.orderBy(F.split("path", "/"))
    return ordered.select(manifest_line(F.col("digest"), F.col("path")).alias("value"))


def last_wins_by_key(manifest: DataFrame, order: str = "line_no") -> DataFrame:
    """One digest per path, that of the latest line."""
    return manifest.groupBy("path").agg(F.max_by("digest", order).alias("digest"))


def latest_per_path(rows: DataFrame, order: str, *values: str) -> DataFrame:
    """The newest row of each path of an append-only outcome table."""
    newest = F.max_by(F.struct(*values), order)
    return rows.groupBy("path").agg(newest.alias("newest")).select("path", "newest.*")


def duplicate_keys(lines: DataFrame, name: str = "path", order: str = "line_no") -> DataFrame:
    """Names occurring more than once, with the line of the second occurrence.

    Two ranks per name are all that is needed; the rank filter is applied before the
    shuffle as well, so a name on a third of all lines sends two rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(name).orderBy(order))
    seconds = lines.select(name, order).withColumn("rank", rank).filter("rank <= 2")
    return seconds.filter("rank = 2").select(name, F.col(order).alias("second_line"))


def split_lines(lines: DataFrame, line_end: str) -> DataFrame:
    """``(line_no, value, valid_utf8, separated, digest, path)``: only the first double space separates."""
    value, at = F.col("value"), F.col("at")
    valid = F.call_function("is_valid_utf8", value).alias("valid_utf8")
    cut = lines.select("line_no", valid, F.regexp_replace(value, line_end, "").alias("value"))
    return cut.withColumn("at", F.instr(value, "  ")).select(
        "line_no",
        "value",
        "valid_utf8",
        (at > 0).alias("separated"),
        F.substring(value, F.lit(1), at - 1).alias("digest"),
        F.substring(value, at + 2, F.length(value)).alias("path"),
    )


def parse_manifest_lines(lines: DataFrame, digest: str = "xxh3_128") -> DataFrame:
    """Every line of a manifest with its verdict: ``(line_no, state, digest, path)``.

    States: VALID, BLANK, NO_SEPARATOR, BAD_DIGEST, UNSAFE, BAD_ENCODING.
    """
    state = (
        F.when(~F.col("valid_utf8"), "BAD_ENCODING")
        .when(F.col("value") == "", "BLANK")
        .when(~F.col("separated"), "NO_SEPARATOR")
        .when(~valid_digest(F.col("digest"), digest), "BAD_DIGEST")
        .when(paths.is_unsafe_path(F.col("path")), "UNSAFE")
        .otherwise("VALID")
    )
    return _with_state(split_lines(lines, "[\\r\\n]+$"), state)


def parse_checksum_lines(lines: DataFrame) -> DataFrame:
    """As :func:`parse_manifest_lines` for flat checksum files, which are stricter.

    States: VALID, SKIPPED (own artifacts, before the duplicate test), NO_SEPARATOR
    (blank lines too), BAD_DIGEST, EMPTY_NAME, PATH_IN_NAME, BAD_ENCODING, DUPLICATE.
    """
    parsed = classify_checksum_lines(lines)
    valid = parsed.filter("state = 'VALID'")
    first = valid.groupBy("path").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))
    # Only names that do repeat are looked up; one of them may be on most lines.
    repeated = first.filter("n > 1").select("path", "first_line", F.lit("VALID").alias("state"))
    joined = spread_join(parsed, repeated, ["path", "state"], "left")
    state = F.when(F.col("line_no") > F.col("first_line"), "DUPLICATE").otherwise(F.col("state"))
    return joined.select("line_no", state.alias("state"), "digest", "path")


def classify_checksum_lines(lines: DataFrame) -> DataFrame:
    """Each line judged by itself; repeated names are still VALID."""
    state = (
        F.when(~F.col("valid_utf8"), "BAD_ENCODING")
        .when(~F.col("separated"), "NO_SEPARATOR")
        .when(~valid_digest(F.col("digest")), "BAD_DIGEST")
        .when(F.col("path") == "", "EMPTY_NAME")
        .when(paths.is_path_like(F.col("path")), "PATH_IN_NAME")
        .when(paths.is_own_artifact(F.col("path")), "SKIPPED")
        .otherwise("VALID")
    )
    split = split_lines(lines, "\\r$").withColumn("path", nfc(F.col("path")))
    return _with_state(split, state)


def accept_checksums(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """``(path, digest)`` of checksum lines. FAILFAST raises at the first bad or repeated one, PERMISSIVE drops them."""
    valid = accept_lines(classify_checksum_lines(lines), mode, also_bad=_first_repeat)
    return valid.groupBy("path").agg(F.min_by("digest", "line_no").alias("digest"))


def _first_repeat(parsed: DataFrame) -> Row | None:
    repeats = duplicate_keys(parsed.filter("state = 'VALID'"))
    found = repeats.agg(F.min("second_line").alias("line_no")).first()
    return None if found.line_no is None else Row(line_no=found.line_no, state="DUPLICATE")


def _with_state(split: DataFrame, state: Column) -> DataFrame:
    usable = F.col("state") == "VALID"
    return split.withColumn("state", state).select(
        "line_no",
        "state",
        F.when(usable, F.lower("digest")).alias("digest"),
        F.when(usable, F.col("path")).alias("path"),
    )


def accept_manifest(parsed: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """``(path, digest)`` of a parsed manifest, keyed by components, last line winning.

    FAILFAST raises at the first bad line; PERMISSIVE leaves bad lines to
    :func:`bad_lines`.
    """
    valid = accept_lines(parsed, mode).withColumn("path", paths.normalize_path_key(F.col("path")))
    return last_wins_by_key(valid)


def accept_lines(
    parsed: DataFrame, mode: str = "FAILFAST", also_bad: Callable[[DataFrame], Row | None] | None = None
) -> DataFrame:
    """The valid lines. FAILFAST stores the parsed lines and looks for bad ones in the same pass."""
    if mode == "FAILFAST":
        first_bad = F.min(F.when(_is_bad(), F.struct("line_no", "state")))
        parsed, seen = store(parsed, "lines", first_bad=first_bad)
        bad = [row for row in (seen["first_bad"], also_bad and also_bad(parsed)) if row]
        if bad:
            worst = min(bad, key=lambda row: row.line_no)
            raise ValueError(f"line {worst.line_no}: {worst.state}")
    return parsed.filter("state = 'VALID'")


def _is_bad() -> Column:
    return ~F.col("state").isin("VALID", "BLANK", "SKIPPED")


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(_is_bad()).select("line_no", "state")
