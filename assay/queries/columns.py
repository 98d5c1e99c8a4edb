"""Column functions, predicates and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import digests, errors, numbers, paths, text
from assay.operators import entries as E, runs
from assay.queries import fixtures as X
from assay.queries.registry import Tables, query

SRC = X.with_(X.SOURCE)

# Digests ----------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5_hex(t: Tables):
    return t.documents.select("doc_id", digests.md5_hex(F.col("text")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hex(t: Tables):
    return t.documents.select("doc_id", digests.sha256_hex(F.col("text")).alias("digest"))


@query()
def xxh3_128_hex(t: Tables):
    return t.documents.select("doc_id", digests.xxh3_128_hex(F.col("text")).alias("digest"))


@query(
    SRC
    + """SELECT path, CASE WHEN short THEN NULL ELSE md5(payload) END AS digest,
              CASE WHEN short THEN '1 bytes missing' END AS error
         FROM (SELECT *, substr(md5(path), 1, 1) = '5' AS short FROM source)"""
)
def digest_exact_len(t: Tables):
    # A tail after the logical end for every entry, and one byte too few for some.
    source = X.source_entries(t)
    short = X.draw(F.col("path"), 1) == "5"
    content = F.when(short, F.col("payload")).otherwise(F.concat("payload", F.lit("tail")))
    size = F.col("size") + short.cast("int")
    exact = digests.digest_exact_len(content, size)
    return source.select("path", exact.alias("exact")).select("path", "exact.digest", "exact.error")


@query(
    SRC
    + """SELECT path, substr(md5(path), 1, 1) <> '1' AS equal FROM source"""
)
def digest_equal(t: Tables):
    source = X.source_entries(t)
    digest = F.md5(F.col("payload").cast("binary"))
    other = F.when(X.draw(F.col("path"), 1) == "1", F.reverse(F.concat(digest, F.lit("0")))).otherwise(F.upper(digest))
    return source.select("path", digests.digest_equal(digest, other).alias("equal"))


@query(X.with_(X.SOURCE, X.LINES) + "SELECT line_no, regexp_matches(substr(value, 1, sep - 1), '^[0-9A-Fa-f]{32}$') AS valid FROM split")
def valid_digest(t: Tables):
    lines = X.manifest_text(t)
    head = F.substring(F.col("value"), F.lit(1), F.instr("value", "  ") - 1)
    return lines.select("line_no", digests.valid_digest(head).alias("valid"))


# Text ---------------------------------------------------------------------------------


@query(X.with_(X.NAMES) + "SELECT doc_id, nfc_normalize(name) AS name FROM names")
def nfc(t: Tables):
    return X.names(t).select("doc_id", text.nfc(F.col("name")).alias("name"))


@query("SELECT page_id, string_split(regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', ''), '/') AS parts, replace(regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', ''), '/', chr(0)) AS key FROM pages")
def path_parts(t: Tables):
    url = F.col("url")
    return t.pages.select("page_id", paths.path_parts(url).alias("parts"), paths.record_key(url).alias("key"))


@query(
    SRC
    + "SELECT path, replace(path, '/', chr(0)) AS key FROM source"
)
def record_key(t: Tables):
    return X.source_entries(t).select("path", paths.record_key(F.concat(F.lit("/"), "path")).alias("key"))


@query(SRC + "SELECT doc_id, path FROM source")
def normalize_path_key(t: Tables):
    noisy = F.concat(F.regexp_replace("path", "/doc", "//./doc"), F.lit("/"))
    return X.source_entries(t).select("doc_id", paths.normalize_path_key(noisy).alias("path"))


@query("SELECT doc_id, regexp_replace(text, '[/\\\\:*?\"<>|]', '__', 'g') AS name FROM documents")
def sanitize_name(t: Tables):
    return t.documents.select("doc_id", paths.sanitize_name(F.col("text")).alias("name"))


@query(
    """SELECT doc_id, '{"source_relative":"' || source || '","attempts":3,"unix_time":' || doc_id || ',"reason":"' ||
       replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')
       || '"}' AS report FROM documents"""
)
def json_report(t: Tables):
    report = text.json_report(F.col("source"), F.lit(3), F.col("doc_id"), F.col("text"))
    return t.documents.select("doc_id", report.alias("report"))


_BIG = "CAST(n_chars AS BIGINT) * n_chars * (1 + doc_id)"


def _big(t: Tables):
    return t.documents.withColumn("size", F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") + 1))


_UNITS = "WHEN size < 1048576 THEN {kb} WHEN size < 1073741824 THEN {mb} WHEN size < 1099511627776 THEN {gb} ELSE {tb} END"


def _truncated(power: int, unit: str) -> str:
    scale = 1024**power
    return f"(size // {scale}) || '.' || ((size % {scale}) * 10 // {scale}) || ' {unit}'"


def _rounded(power: int, unit: str) -> str:
    scale = 1024**power
    tenths = f"((size * 20 + {scale}) // {2 * scale})"
    return f"({tenths} // 10) || '.' || ({tenths} % 10) || ' {unit}'"


def _units(form) -> str:
    named = dict(kb=form(1, "KB"), mb=form(2, "MB"), gb=form(3, "GB"), tb=form(4, "TB"))
    return "CASE WHEN size < 1024 THEN size || ' B' " + _UNITS.format(**named)


@query(f"SELECT doc_id, {_units(_truncated)} AS shown FROM (SELECT doc_id, {_BIG} AS size FROM documents)")
def format_bytes(t: Tables):
    return _big(t).select("doc_id", text.format_bytes(F.col("size")).alias("shown"))


@query(f"SELECT doc_id, {_units(_rounded)} AS shown FROM (SELECT doc_id, {_BIG} AS size FROM documents)")
def format_bytes_rounded(t: Tables):
    return _big(t).select("doc_id", text.format_bytes_rounded(F.col("size")).alias("shown"))


@query("SELECT doc_id, translate(base64(encode(text)), '+/', '-_') AS code FROM documents")
def base64url_encode(t: Tables):
    return t.documents.select("doc_id", text.base64url_encode(F.col("text")).alias("code"))


@query("SELECT doc_id, text FROM documents")
def base64url_decode(t: Tables):
    code = text.base64url_encode(F.col("text"))
    return t.documents.select("doc_id", text.base64url_decode(code).alias("text"))


@query(SRC + "SELECT md5(payload) || '  ' || path AS line FROM source")
def manifest_line(t: Tables):
    digest = F.md5(F.col("payload").cast("binary"))
    return X.source_entries(t).select(text.manifest_line(digest, F.col("path")).alias("line"))


@query(
    X.with_(X.PROGRESS_LOG)
    + """SELECT event_id, CASE phase WHEN 'Scanning' THEN 'preparing' WHEN 'Copying' THEN 'copying'
                            WHEN 'Verifying' THEN 'verifying' ELSE 'done' END AS label FROM progress_log"""
)
def status_label(t: Tables):
    return X.progress_log(t).select("event_id", text.status_label(F.col("phase")).alias("label"))


# Numbers ------------------------------------------------------------------------------


@query(
    X.with_(X.ERROR_LOG)
    + """SELECT event_id, 1::BIGINT << CAST(least(attempt - 1, 5) AS INT) AS wait_s FROM error_log"""
)
def backoff_seconds(t: Tables):
    return X.error_log(t).select("event_id", numbers.backoff_seconds(F.col("attempt")).alias("wait_s"))


@query(
    """SELECT event_id, CAST(least(a::HUGEINT + b, 9223372036854775807) AS BIGINT) AS total
       FROM (SELECT event_id, 9223372036854775807 - event_id * 3 AS a, event_id * 2 + user_id * 100 AS b FROM events)"""
)
def saturating_add(t: Tables):
    left = F.lit(2**63 - 1) - F.col("event_id") * 3
    right = F.col("event_id") * 2 + F.col("user_id") * 100
    return t.events.select("event_id", numbers.saturating_add(left, right).alias("total"))


@query(
    """SELECT event_id, CAST(least(2 * a::HUGEINT, 9223372036854775807) AS BIGINT) AS work
       FROM (SELECT event_id, event_id * 922337203685477 AS a FROM events)"""
)
def doubled_work(t: Tables):
    # ids beyond 10,000 leave the range of BIGINT: such sizes are held at its end, as their doubles are
    size = F.least(F.col("event_id").cast("decimal(19,0)") * F.lit(922337203685477), F.lit(numbers.INT64_MAX)).cast("bigint")
    return t.events.select("event_id", F.when(F.col("event_id").isNotNull(), numbers.doubled_work(size)).alias("work"))


_PROGRESS = "(SELECT event_id, event_id - 100 AS completed, user_id * 60 - 60 AS total FROM events)"


def _progress(t: Tables):
    return t.events.select(
        "event_id", (F.col("event_id") - 100).alias("completed"), (F.col("user_id") * 60 - 60).alias("total")
    )


@query(
    f"""SELECT event_id, CASE WHEN total = 0 THEN 0.0::DOUBLE
               ELSE least(greatest(completed::DOUBLE / total::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS fraction FROM {_PROGRESS}"""
)
def progress_fraction(t: Tables):
    return _progress(t).select(
        "event_id", numbers.progress_fraction(F.col("completed"), F.col("total")).alias("fraction")
    )


@query(
    f"""SELECT event_id, CASE WHEN total > 0 THEN least(greatest(completed, 0), total) * 1000 // total
                              ELSE 0::BIGINT END AS permille FROM {_PROGRESS}"""
)
def progress_permille(t: Tables):
    return _progress(t).select(
        "event_id", numbers.progress_permille(F.col("completed"), F.col("total")).alias("permille")
    )


@query(X.with_(X.SOURCE) + "SELECT path || '.verify.tmp.' || (1 + doc_id % 5) AS name FROM source")
def temp_name(t: Tables):
    attempt = F.pmod("doc_id", F.lit(5)) + 1
    return X.source_entries(t).select(paths.temp_name(F.col("path"), attempt).alias("name"))


# Errors -------------------------------------------------------------------------------

LOG = X.with_(X.ERROR_LOG)


def classified(t: Tables):
    kinds = errors.classify_error(F.col("error_kind"), F.col("io_kind"))
    return X.error_log(t).withColumn("error_class", kinds)


@query(LOG + "SELECT event_id, error_kind, io_kind, error_class FROM classified")
def classify_error(t: Tables):
    return classified(t).select("event_id", "error_kind", "io_kind", "error_class")


@query(
    """SELECT event_id, outer_type = 'Security' OR (CASE WHEN errno IS NOT NULL THEN errno IN ('ENOSPC', 'EROFS')
              ELSE event_type = 'view' END) OR user_id = 7 AS fatal,
              coalesce(props, 'Errno') AS root_cause
       FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'Security' ELSE 'Io' END AS outer_type,
                    CASE substr(md5(props), 1, 1) WHEN '0' THEN 'ENOSPC' WHEN '1' THEN 'EROFS' WHEN '2' THEN 'EIO' END AS errno
             FROM events)""",
    name="classify_fatal",
)
def classify_fatal(t: Tables):
    first = F.substring(F.md5(F.col("props").cast("binary")), 1, 1)
    errno = F.when(first == "0", "ENOSPC").when(first == "1", "EROFS").when(first == "2", "EIO")

    def cause(kind, errno, flagged, message):
        return F.struct(
            kind.alias("type"), errno.alias("errno"), flagged.alias("provider_fatal"), message.alias("message")
        )

    outer = F.when(F.col("event_type") == "signup", "Security").otherwise("Io")
    none = F.lit(None).cast("string")
    causes = F.array(
        cause(outer, none, F.col("event_type") == "view", F.lit("outer")),
        cause(F.lit("Errno"), errno, F.lit(False), F.col("props")),
    )
    fatal = errors.classify_fatal(F.col("causes"), F.col("user_id") != 7)
    root = errors.root_cause(F.col("causes"))
    return t.events.withColumn("causes", causes).select("event_id", fatal.alias("fatal"), root.alias("root_cause"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'Errno' ELSE props END AS root_cause FROM events"""
)
def root_cause(t: Tables):
    message = F.when(F.col("event_type") != "error", F.col("props"))
    chain = F.array(
        F.struct(F.lit("Io").alias("type"), F.lit("outer").alias("message")),
        F.struct(F.lit("Errno").alias("type"), message.alias("message")),
    )
    return t.events.select("event_id", errors.root_cause(chain).alias("root_cause"))


@query(
    LOG
    + """SELECT event_id, error_class, attempt,
                CASE error_class WHEN 'DEVICE' THEN FALSE ELSE attempt < 3 END AS bounded,
                CASE error_class WHEN 'DEVICE' THEN FALSE WHEN 'TRANSIENT' THEN TRUE ELSE attempt < 3 END AS unlimited
         FROM classified"""
)
def retry_policy(t: Tables):
    cls, attempt = F.col("error_class"), F.col("attempt")
    return classified(t).select(
        "event_id",
        "error_class",
        "attempt",
        errors.retry_allowed(cls, attempt, 3).alias("bounded"),
        errors.retry_allowed(cls, attempt, 3, unlimited=True).alias("unlimited"),
    )


@query(
    LOG
    + """SELECT event_id, error_class, CASE error_class WHEN 'DEVICE' THEN 'stop' ELSE 'continue' END AS "then"
         FROM classified"""
)
def quarantine_decision(t: Tables):
    return runs.quarantine_decision(classified(t)).select("event_id", "error_class", "then")


# Path predicates and filters ---------------------------------------------------------

TREE = X.with_(X.TREE)

_FAMILIES = "^[.].*cache$|-venv$|^[.]pytest-tmp|[.]egg-info$|[.]build$|[.]dist$"
_BASIC = ", ".join(f"'{name}'" for name in paths.BASIC_JUNK_DIRS)
_EXTENDED = ", ".join(f"'{name}'" for name in paths.EXTENDED_JUNK_DIRS)


def _junk_sql(exact: str, families: str, file_rule: str, pair: str) -> str:
    """SQL of the surviving paths, root exempt: no component below it is a junk folder or file."""
    folders = "CASE WHEN is_dir THEN parts[2:] ELSE parts[2:len(parts) - 1] END"
    return (
        TREE
        + f"""SELECT path, is_dir FROM (SELECT *, string_split(lower(path), '/') AS parts FROM tree)
        WHERE len(list_filter({folders}, lambda d: d IN ({exact}) OR regexp_matches(d, '{families}'))) = 0
          AND (is_dir OR NOT ({file_rule})) AND NOT ({pair})"""
    )


@query(_junk_sql(_BASIC, _FAMILIES, "parts[-1] IN ('.ds_store', 'thumbs.db', 'desktop.ini')", "FALSE"))
def skip_junk_basic(t: Tables):
    return E.skip_junk_basic(X.path_tree(t), root_parts=1)


@query(
    _junk_sql(
        _EXTENDED,
        _FAMILIES + "|^cmake-build-",
        "regexp_matches(parts[-1], '^[.]coverage[.]|^[.]trashed-|^[.]_|[.]idsig$|[.]pyc$|[.]pyo$')",
        "starts_with(path, 'root/src-tauri/gen/') OR (is_dir AND path = 'root/src-tauri/gen')",
    )
)
def skip_junk_extended(t: Tables):
    return E.skip_junk_extended(X.path_tree(t), root_parts=1)


@query(
    TREE
    + """SELECT regexp_replace(path, '^root', 'target') AS path, is_dir
         FROM (SELECT *, string_split(path, '/') AS parts FROM tree)
         WHERE len(list_filter(CASE WHEN is_dir THEN parts[2:] ELSE parts[2:len(parts) - 1] END,
                               lambda d: d IN ("""
    + _BASIC
    + f") OR regexp_matches(d, '{_FAMILIES}'))) = 0"
)
def root_exempt(t: Tables):
    # The chosen root itself carries a junk name.
    renamed = X.path_tree(t).withColumn("path", F.regexp_replace("path", "^root", "target"))
    return E.skip_junk_basic(renamed, root_parts=1)


@query(
    TREE
    + """SELECT path, 'root/' || substr(path, 6) AS again, regexp_extract(path, '[^/]*$') AS name,
                regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM tree"""
)
def relative_path(t: Tables):
    absolute = F.concat(F.lit("/mnt/store/"), "path")
    again = paths.relative_path(absolute, F.lit("/mnt/store/root"), F.lit("root"))
    return X.path_tree(t).select(
        "path", again.alias("again"), paths.file_name(F.col("path")).alias("name"), paths.parent_dir(F.col("path")).alias("parent")
    )


@query(TREE + "SELECT path FROM tree WHERE NOT is_dir")
def keep_regular_files(t: Tables):
    kinds = X.path_tree(t).withColumn("kind", F.when(F.col("is_dir"), "dir").otherwise("file"))
    return E.keep_regular_files(kinds).select("path")


@query("SELECT text AS path, 'newline' AS violation FROM documents WHERE regexp_matches(text, '[\\r\\n]')")
def reject_newline_names(t: Tables):
    return E.name_violations(t.documents.withColumnRenamed("text", "path"), writes_manifest=False)


_RESERVED = X.with_(
    X.SOURCE,
    """renamed AS (
  SELECT CASE substr(md5(path), 1, 1) WHEN '0' THEN 'manifest.xxh3' WHEN '1' THEN 'manifest.README.txt/' || path
              WHEN '2' THEN path || '/manifest.xxh3' ELSE path END AS path, path AS original FROM source)""",
)


def _reserved(t: Tables):
    fault = X.draw(F.col("path"), 1)
    renamed = (
        F.when(fault == "0", "manifest.xxh3")
        .when(fault == "1", F.concat(F.lit("manifest.README.txt/"), "path"))
        .when(fault == "2", F.concat("path", F.lit("/manifest.xxh3")))
        .otherwise(F.col("path"))
    )
    return X.source_entries(t).select(renamed.alias("path"), F.col("path").alias("original"))


@query(
    _RESERVED
    + """SELECT original, regexp_matches(path, '^manifest[.](xxh3|README[.]txt)(/|$)') AS first_component,
                path IN ('manifest.xxh3', 'manifest.README.txt') AS single FROM renamed"""
)
def reject_reserved_names(t: Tables):
    path = F.col("path")
    return _reserved(t).select(
        "original",
        paths.is_reserved_first(path).alias("first_component"),
        paths.is_reserved_single(path).alias("single"),
    )


@query(_RESERVED + "SELECT coalesce(bool_or(path = 'manifest.xxh3' OR starts_with(path, 'manifest.xxh3/')), FALSE) AS any_reserved FROM renamed")
def any_reserved(t: Tables):
    return E.any_reserved(_reserved(t))


_UNSAFE = X.with_(
    X.SOURCE,
    """odd AS (
  SELECT path AS original, CASE substr(md5(path), 1, 1) WHEN '0' THEN '/' || path WHEN '1' THEN '../' || path
         WHEN '2' THEN 'C:' || path WHEN '3' THEN replace(path, '/doc', '/../doc') WHEN '4' THEN replace(path, '/doc', '/..doc')
         ELSE path END AS path FROM source)""",
)


@query(
    _UNSAFE
    + """SELECT original, starts_with(path, '/') OR regexp_matches(path, '(^|/)[.][.](/|$)')
                OR regexp_matches(path, '^[A-Za-z]:') AS unsafe,
                contains(path, '/') AS path_like FROM odd"""
)
def reject_unsafe_paths(t: Tables):
    fault = X.draw(F.col("path"), 1)
    odd = (
        F.when(fault == "0", F.concat(F.lit("/"), "path"))
        .when(fault == "1", F.concat(F.lit("../"), "path"))
        .when(fault == "2", F.concat(F.lit("C:"), "path"))
        .when(fault == "3", F.replace("path", F.lit("/doc"), F.lit("/../doc")))
        .when(fault == "4", F.replace("path", F.lit("/doc"), F.lit("/..doc")))
        .otherwise(F.col("path"))
    )
    return X.source_entries(t).select(
        F.col("path").alias("original"), paths.is_unsafe_path(odd).alias("unsafe"), paths.is_path_like(odd).alias("path_like")
    )


_NAMED = X.with_(
    X.SOURCE,
    """named AS (
  SELECT doc_id, 'doc_' || doc_id || CASE substr(md5(path), 1, 1) WHEN '0' THEN '.DS_Store' WHEN '1' THEN '.ds_store'
         WHEN '2' THEN '.verify.tmp' WHEN '3' THEN '.verify.tmp.12' WHEN '4' THEN '.verify.tmp.1a' WHEN '5' THEN '.verify.tmp (1)'
         WHEN '6' THEN '.verify.old.1700000000000' ELSE '.txt' END AS name FROM source)""",
)

_SUFFIXES = {
    "0": ".DS_Store",
    "1": ".ds_store",
    "2": ".verify.tmp",
    "3": ".verify.tmp.12",
    "4": ".verify.tmp.1a",
    "5": ".verify.tmp (1)",
    "6": ".verify.old.1700000000000",
}


def _named(t: Tables):
    fault, suffix = X.draw(F.col("path"), 1), None
    for digit, ending in _SUFFIXES.items():
        suffix = (F if suffix is None else suffix).when(fault == digit, F.lit(ending))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix.otherwise(".txt"))
    return X.source_entries(t).select("doc_id", name.alias("name"))


@query(_NAMED + "SELECT name FROM named WHERE NOT ends_with(name, '.DS_Store') AND name <> 'checksums.txt'")
def skip_own_artifacts(t: Tables):
    return _named(t).filter(~paths.is_own_artifact(F.col("name"))).select("name")


@query(
    _NAMED
    + """SELECT name, regexp_matches(name, '[.]verify[.]tmp([.][0-9]+)?$') AS temp,
                contains(name, '.verify.tmp.') OR contains(name, '.verify.tmp (') AS loose,
                regexp_matches(name, '[.]verify[.]old[.][0-9]+$') AS backup FROM named"""
)
def is_temp_name(t: Tables):
    name = F.col("name")
    return _named(t).select(
        "name",
        paths.is_temp_name(name).alias("temp"),
        paths.is_temp_name_loose(name).alias("loose"),
        paths.is_backup_name(name).alias("backup"),
    )


@query(
    X.with_(
        X.SOURCE,
        """pairs AS (
  SELECT '/' || path AS source, CASE substr(md5(path), 1, 1) WHEN '0' THEN '/' || path || '/copy' WHEN '1' THEN '/' || path || '-copy'
         WHEN '2' THEN regexp_extract('/' || path, '^(.*)/[^/]*$', 1) WHEN '3' THEN '/' || path || '/' ELSE '/backup' END AS destination FROM source)""",
    )
    + """SELECT source, destination FROM pairs
         WHERE starts_with(rtrim(destination, '/') || '/', source || '/')
            OR destination || '/' || regexp_extract(source, '[^/]*$') = source"""
)
def overlap_guard(t: Tables):
    fault, source = X.draw(F.col("path"), 1), F.concat(F.lit("/"), "path")
    destination = (
        F.when(fault == "0", F.concat(source, F.lit("/copy")))
        .when(fault == "1", F.concat(source, F.lit("-copy")))
        .when(fault == "2", paths.parent_dir(source))
        .when(fault == "3", F.concat(source, F.lit("/")))
        .otherwise("/backup")
    )
    return E.overlap_guard(X.source_entries(t).select(source.alias("source"), destination.alias("destination")))


@query(SRC + "SELECT path, substr(sha256('/src' || path), 1, 24) AS key FROM source")
def checkpoint_key(t: Tables):
    from assay.sources.writers import checkpoint_key as key

    return X.source_entries(t).select("path", key(F.lit("/src"), F.col("path")).alias("key"))
