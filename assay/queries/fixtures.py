"""Inputs derived from the given tables, in both dialects.

Faults are dealt out by the leading hex digits of a path's MD5, so both engines damage
the same entries and the whole table stays in play on every side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.queries.registry import Tables


def draw(path: Column, digit: int) -> Column:
    return F.substring(F.md5(path.cast("binary")), digit, 1)


# Source entries -------------------------------------------------------------------

SOURCE = """
source AS (
  SELECT 'root/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS payload,
         CAST(strlen(text) AS BIGINT) AS size, doc_id
  FROM documents)"""


def source_entries(t: Tables) -> DataFrame:
    path = F.concat_ws(
        "/", F.lit("root"), "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return t.documents.select(
        path.alias("path"),
        F.col("text").alias("payload"),
        F.octet_length("text").cast("bigint").alias("size"),
        "doc_id",
    )


# Destination: entries missing (0), altered (1), unreadable (2), and copies nobody listed (3).

DESTINATION = """
destination AS (
  SELECT path, CASE substr(md5(path), 1, 1) WHEN '2' THEN NULL WHEN '1' THEN payload || 'x' ELSE payload END AS payload,
         size + CASE substr(md5(path), 1, 1) WHEN '1' THEN 1 ELSE 0 END AS size
  FROM source WHERE substr(md5(path), 1, 1) <> '0'
  UNION ALL
  SELECT 'root/extra/doc_' || doc_id || '.txt', payload, size FROM source WHERE substr(md5(path), 1, 1) = '3')"""


def destination_entries(t: Tables) -> DataFrame:
    source = source_entries(t).withColumn("fault", draw(F.col("path"), 1))
    altered = F.col("fault") == "1"
    payload = F.when(altered, F.concat("payload", F.lit("x"))).when(F.col("fault") != "2", F.col("payload"))
    there = source.filter("fault <> '0'").select(
        "path", payload.alias("payload"), (F.col("size") + altered.cast("int")).alias("size")
    )
    name = F.concat(F.lit("root/extra/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    extra = source.filter("fault = '3'").select(name.alias("path"), "payload", "size")
    return there.unionByName(extra)


# The same sides with repeated rows. Listed paths come again with the same digest in upper case (5: a) or
# with another one and another size (5: b); found ones likewise (6: a, b), and again unreadable (6: c).

REPEATS = """
expected_rows AS (
  SELECT path, md5(payload) AS digest, size FROM source
  UNION ALL
  SELECT path, CASE substr(md5(path), 5, 1) WHEN 'a' THEN upper(md5(payload)) ELSE md5(payload || 'y') END,
         size + CASE substr(md5(path), 5, 1) WHEN 'a' THEN 0 ELSE 1 END
  FROM source WHERE substr(md5(path), 5, 1) IN ('a', 'b')),
actual_rows AS (
  SELECT path, md5(payload) AS digest, size FROM destination
  UNION ALL
  SELECT path, CASE substr(md5(path), 6, 1) WHEN 'a' THEN upper(md5(payload)) WHEN 'b' THEN md5(payload || 'z') END,
         size + CASE substr(md5(path), 6, 1) WHEN 'b' THEN 1 ELSE 0 END
  FROM destination WHERE substr(md5(path), 6, 1) IN ('a', 'b', 'c')),
listed AS (
  SELECT path, count(DISTINCT lower(digest)) > 1 AS mixed, bool_or(digest IS NULL) AS unread, lower(min(digest)) AS digest, count(DISTINCT size) > 1 AS sizes_mixed
  FROM expected_rows GROUP BY path),
there AS (
  SELECT path, count(DISTINCT lower(digest)) > 1 AS mixed, bool_or(digest IS NULL) AS unread, lower(min(digest)) AS digest, count(DISTINCT size) > 1 AS sizes_mixed
  FROM actual_rows GROUP BY path),
judged AS (
  SELECT coalesce(l.path, t.path) AS path,
         CASE WHEN t.path IS NULL THEN 'MISSING' WHEN l.path IS NULL THEN 'EXTRA' WHEN t.unread THEN 'UNREADABLE'
              WHEN l.mixed OR t.mixed THEN 'DUPLICATE' WHEN l.digest = t.digest THEN 'OK' ELSE 'FAIL' END AS status
  FROM listed l FULL OUTER JOIN there t ON l.path = t.path)"""


def _again(rows: DataFrame, digit: int, letter: str) -> DataFrame:
    """``(path, digest, size)`` of rows (path, payload, size), some of them a second time."""
    fault, digest = draw(F.col("path"), digit), F.md5(F.col("payload").cast("binary"))
    other = F.md5(F.concat("payload", F.lit(letter)).cast("binary"))
    second = rows.filter(fault.isin("a", "b", "c") if letter == "z" else fault.isin("a", "b"))
    second = second.select("path", F.when(fault == "a", F.upper(digest)).when(fault == "b", other).alias("digest"), (F.col("size") + (fault == "b").cast("int")).alias("size"))
    return rows.select("path", digest.alias("digest"), "size").unionByName(second)


def expected_rows(t: Tables) -> DataFrame:
    return _again(source_entries(t), 5, "y")


def actual_rows(t: Tables) -> DataFrame:
    return _again(destination_entries(t), 6, "z")


# The previous run recorded two thirds of the entries; since then some sources changed.

PREVIOUS = """
previous AS (
  SELECT path, md5(payload) AS digest, size FROM source WHERE substr(md5(path), 2, 1) < 'b'),
changed AS (
  SELECT path, payload || CASE WHEN substr(md5(path), 3, 1) = '0' THEN '!' ELSE '' END AS payload FROM source)"""


def previous_manifest(t: Tables) -> DataFrame:
    source = source_entries(t)
    return source.filter(draw(F.col("path"), 2) < "b").select(
        "path", F.md5(F.col("payload").cast("binary")).alias("digest"), "size"
    )


def changed_source(t: Tables) -> DataFrame:
    mark = F.when(draw(F.col("path"), 3) == "0", "!").otherwise("")
    return source_entries(t).select("path", F.concat("payload", mark).alias("payload"), "size")


# Manifest text with one line per document: one space (0), bad hex (1), climbing path (2), blank
# line (3), repeated later in upper case with another digest (4).

LINES = """
lines AS (
  SELECT doc_id + 1 AS line_no,
         CASE substr(md5(path), 4, 1)
           WHEN '0' THEN md5(payload) || ' ' || path
           WHEN '1' THEN 'zz' || substr(md5(payload), 3) || '  ' || path
           WHEN '2' THEN md5(payload) || '  ../' || path
           WHEN '3' THEN ''
           ELSE md5(payload) || '  ' || path END AS value
  FROM source
  UNION ALL
  SELECT doc_id + 1000000000, upper(md5(payload || '!')) || '  ' || path
  FROM source WHERE substr(md5(path), 4, 1) = '4'),
split AS (
  SELECT line_no, value, strpos(value, '  ') AS sep FROM lines),
parsed AS (
  SELECT line_no, substr(value, 1, sep - 1) AS digest, substr(value, sep + 2) AS path,
         CASE WHEN value = '' THEN 'BLANK'
              WHEN sep = 0 THEN 'NO_SEPARATOR'
              WHEN NOT regexp_matches(substr(value, 1, sep - 1), '^[0-9A-Fa-f]{32}$') THEN 'BAD_DIGEST'
              WHEN list_contains(string_split(substr(value, sep + 2), '/'), '..') THEN 'UNSAFE'
              ELSE 'VALID' END AS state
  FROM split)"""


def manifest_text(t: Tables) -> DataFrame:
    source = source_entries(t).withColumn("fault", draw(F.col("path"), 4))
    digest = F.md5(F.col("payload").cast("binary"))
    value = (
        F.when(F.col("fault") == "0", F.concat(digest, F.lit(" "), "path"))
        .when(F.col("fault") == "1", F.concat(F.lit("zz"), F.substring(digest, 3, 30), F.lit("  "), "path"))
        .when(F.col("fault") == "2", F.concat(digest, F.lit("  ../"), "path"))
        .when(F.col("fault") == "3", "")
        .otherwise(F.concat(digest, F.lit("  "), "path"))
    )
    once = source.select((F.col("doc_id") + 1).alias("line_no"), value.alias("value"))
    later = F.upper(F.md5(F.concat("payload", F.lit("!")).cast("binary")))
    again = source.filter("fault = '4'").select(
        (F.col("doc_id") + 1_000_000_000).alias("line_no"), F.concat(later, F.lit("  "), "path").alias("value")
    )
    return once.unionByName(again)


# Flat checksum lines: NFD names everywhere, a path in the name (0), no name (1), an own
# artifact (2), a repeat under the neighbour's name (3), one space (4).

CHECKSUM_LINES = """
checksum_lines AS (
  SELECT doc_id + 1 AS line_no,
         CASE substr(md5(path), 5, 1)
           WHEN '0' THEN md5(payload) || '  sub/doc_' || doc_id
           WHEN '1' THEN md5(payload) || '  '
           WHEN '2' THEN md5(payload) || '  doc_' || doc_id || '.DS_Store'
           WHEN '3' THEN upper(md5(payload)) || '  copie' || chr(769) || '.txt'
           WHEN '4' THEN md5(payload) || ' doc_' || doc_id
           ELSE md5(payload) || '  doc' || 'e' || chr(769) || '_' || doc_id END AS value
  FROM source),
checksum_split AS (
  SELECT line_no, value, strpos(value, '  ') AS sep FROM checksum_lines),
checksum_states AS (
  SELECT line_no, lower(substr(value, 1, sep - 1)) AS digest, nfc_normalize(substr(value, sep + 2)) AS name,
         CASE WHEN sep = 0 THEN 'NO_SEPARATOR'
              WHEN NOT regexp_matches(substr(value, 1, sep - 1), '^[0-9A-Fa-f]{32}$') THEN 'BAD_DIGEST'
              WHEN substr(value, sep + 2) = '' THEN 'EMPTY_NAME'
              WHEN contains(substr(value, sep + 2), '/') THEN 'PATH_IN_NAME'
              WHEN ends_with(value, '.DS_Store') THEN 'SKIPPED'
              ELSE 'VALID' END AS state
  FROM checksum_split),
checksum_parsed AS (
  SELECT line_no, CASE WHEN state = 'VALID' THEN digest END AS digest, CASE WHEN state = 'VALID' THEN name END AS path,
         CASE WHEN state = 'VALID' AND line_no > min(line_no) OVER (PARTITION BY name, state) THEN 'DUPLICATE'
              ELSE state END AS state
  FROM checksum_states)"""


def checksum_text(t: Tables) -> DataFrame:
    source = source_entries(t).withColumn("fault", draw(F.col("path"), 5))
    digest, number = F.md5(F.col("payload").cast("binary")), F.col("doc_id").cast("string")
    fault = F.col("fault")
    value = (
        F.when(fault == "0", F.concat(digest, F.lit("  sub/doc_"), number))
        .when(fault == "1", F.concat(digest, F.lit("  ")))
        .when(fault == "2", F.concat(digest, F.lit("  doc_"), number, F.lit(".DS_Store")))
        .when(fault == "3", F.concat(F.upper(digest), F.lit("  copie\u0301.txt")))
        .when(fault == "4", F.concat(digest, F.lit(" doc_"), number))
        .otherwise(F.concat(digest, F.lit("  doce\u0301_"), number))
    )
    return source.select((F.col("doc_id") + 1).alias("line_no"), value.alias("value"))


# Run, progress and error logs --------------------------------------------------------

RUN_LOG = """
run_log AS (
  SELECT user_id AS run_id, ts, event_id,
         CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'SKIP' ELSE 'OK' END AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position
  FROM events)"""

ONE_RUN_LOG = RUN_LOG.replace("user_id AS run_id", "0::BIGINT AS run_id").replace("PARTITION BY user_id ", "")

RUN_ORDER = ("ts", "event_id")


def run_log(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "view", "SKIP").otherwise("OK")
    return t.events.select(F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"))


PROGRESS_LOG = """
progress_log AS (
  SELECT user_id AS job_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'TotalBytes' WHEN 'purchase' THEN 'BytesAdvanced' WHEN 'click' THEN 'CurrentFile'
                         WHEN 'view' THEN 'Phase' ELSE 'Log' END AS kind,
         CAST(floor(value * CASE event_type WHEN 'signup' THEN 1000 ELSE 100 END) AS BIGINT) AS bytes,
         'doc_' || event_id || '.txt' AS file,
         CASE substr(md5(props), 1, 1) WHEN '0' THEN 'Copying' WHEN '1' THEN 'Verifying' WHEN '2' THEN 'Done'
              ELSE 'Scanning' END AS phase
  FROM events)"""

ONE_JOB_LOG = PROGRESS_LOG.replace("user_id AS job_id", "0::BIGINT AS job_id")


def progress_log(t: Tables) -> DataFrame:
    event, first = F.col("event_type"), F.substring(F.md5(F.col("props").cast("binary")), 1, 1)
    kind = (
        F.when(event == "signup", "TotalBytes")
        .when(event == "purchase", "BytesAdvanced")
        .when(event == "click", "CurrentFile")
        .when(event == "view", "Phase")
        .otherwise("Log")
    )
    phase = (
        F.when(first == "0", "Copying").when(first == "1", "Verifying").when(first == "2", "Done").otherwise("Scanning")
    )
    scale = F.when(event == "signup", 1000).otherwise(100)
    return t.events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        "event_id",
        kind.alias("kind"),
        F.floor(F.col("value") * scale).cast("bigint").alias("bytes"),
        F.concat(F.lit("doc_"), F.col("event_id").cast("string"), F.lit(".txt")).alias("file"),
        phase.alias("phase"),
        F.col("props").alias("message"),
    )


ERROR_KINDS = (
    "HashMismatch", "RetriesExhausted", "SanityFailed", "SourceRead", "DestinationWrite", "VerifyRead", "Manifest", "Io",
)
IO_KINDS = ("StorageFull", "PermissionDenied", "NotFound", "TimedOut", "Other")

_KINDS = ", ".join(f"'{kind}'" for kind in ERROR_KINDS)
_IOS = ", ".join(f"'{kind}'" for kind in IO_KINDS)

ERROR_LOG = f"""
error_log AS (
  SELECT event_id, user_id, ts, list_extract([{_KINDS}], 1 + CAST(event_id % 8 AS INT)) AS error_kind,
         list_extract([{_IOS}], 1 + CAST(event_id % 5 AS INT)) AS io_kind, 1 + event_id % 6 AS attempt
  FROM events),
classified AS (
  SELECT *, CASE WHEN error_kind = 'SanityFailed' THEN 'DEVICE'
                 WHEN error_kind IN ('RetriesExhausted', 'SourceRead', 'Manifest') THEN 'FILE'
                 WHEN error_kind = 'HashMismatch' THEN 'TRANSIENT'
                 WHEN io_kind IN ('StorageFull', 'PermissionDenied', 'NotFound') THEN 'DEVICE'
                 ELSE 'TRANSIENT' END AS error_class
  FROM error_log)"""


def error_log(t: Tables) -> DataFrame:
    def pick(names, column):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(column, F.lit(len(names))) + 1).cast("int"))

    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        pick(ERROR_KINDS, F.col("event_id")).alias("error_kind"),
        pick(IO_KINDS, F.col("event_id")).alias("io_kind"),
        (F.pmod("event_id", F.lit(6)) + 1).alias("attempt"),
    )


# A path tree with junk and build folders ----------------------------------------------

DIRS = (
    "src", "node_modules", ".mypy_cache", ".build-venv", "pkg.egg-info", "app.exe.build", "target", "dist", ".git", "docs",
    "src-tauri", "cmake-build-debug",
)
EXTENSIONS = ("py", "pyc", "log", "md")

_DIRS = ", ".join(f"'{name}'" for name in DIRS)
_EXTENSIONS = ", ".join(f"'{name}'" for name in EXTENSIONS)

TREE = f"""
tree_files AS (
  SELECT 'root/' || list_extract([{_DIRS}], 1 + CAST(page_id % 12 AS INT)) || '/' ||
         CASE WHEN page_id % 7 = 5 THEN 'gen' ELSE CAST(page_id % 7 AS VARCHAR) END || '/p_' ||
         page_id || '.' || list_extract([{_EXTENSIONS}], 1 + CAST(page_id % 4 AS INT)) AS path, FALSE AS is_dir
  FROM pages),
tree AS (
  SELECT path, is_dir FROM tree_files
  UNION
  SELECT regexp_extract(path, '^([^/]+/[^/]+)/', 1), TRUE FROM tree_files
  UNION
  SELECT regexp_extract(path, '^([^/]+/[^/]+/[^/]+)/', 1), TRUE FROM tree_files)"""


def path_tree(t: Tables) -> DataFrame:
    page = F.col("page_id")

    def pick(names, n):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(page, F.lit(n)) + 1).cast("int"))

    seventh = F.pmod(page, F.lit(7))
    inner = F.when(seventh == 5, "gen").otherwise(seventh.cast("string"))
    name = F.concat(F.lit("p_"), page.cast("string"), F.lit("."), pick(EXTENSIONS, 4))
    files = t.pages.select(F.concat_ws("/", F.lit("root"), pick(DIRS, 12), inner, name).alias("path"))
    folders = files.select(
        F.explode(F.array(F.substring_index("path", "/", 2), F.substring_index("path", "/", 3))).alias("path")
    ).distinct()
    return files.withColumn("is_dir", F.lit(False)).unionByName(folders.withColumn("is_dir", F.lit(True)))


# Parsed rules: base, order, negated, directories only, path pattern, regex.

RULES = (
    ("", 1, False, True, False, "^target$"),
    ("", 2, False, False, False, "^[^/]*[.]log$"),
    ("", 3, False, False, True, "^docs/[^/]*$"),
    ("", 4, True, True, True, "^docs/3$"),
    ("", 5, False, False, True, "^(?:.*/)?[0-2]/p_[0-9][^/]*[.]pyc$"),
    ("docs/3", 1, True, False, False, "^p_[^/]*[.]log$"),
    ("src", 1, False, False, False, "^p_[^/][^/]*[.]md$"),
)

_RULE_ROWS = ", ".join(
    f"('{base}', {seq}, {negated}, {dir_only}, {pattern}, '{regex}')"
    for base, seq, negated, dir_only, pattern, regex in RULES
)

RULES_SQL = f"""
rules(base_path, rule_seq, negated, dir_only, path_pattern, regex) AS (VALUES {_RULE_ROWS}),
below AS (SELECT substr(path, 6) AS path, is_dir FROM tree),
bases AS (
  SELECT path, is_dir, '' AS base_path FROM below
  UNION ALL
  SELECT path, is_dir, string_split(path, '/')[1] FROM below WHERE len(string_split(path, '/')) > 1
  UNION ALL
  SELECT path, is_dir, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM below
  WHERE len(string_split(path, '/')) > 2),
matches AS (
  SELECT b.path, b.is_dir, r.base_path, r.rule_seq, r.negated
  FROM bases b JOIN rules r USING (base_path)
  WHERE (b.is_dir OR NOT r.dir_only)
    AND regexp_matches(CASE WHEN NOT r.path_pattern THEN regexp_extract(b.path, '[^/]*$')
                            WHEN r.base_path = '' THEN b.path
                            ELSE substr(b.path, length(r.base_path) + 2) END, r.regex)),
verdicts AS (
  SELECT path, is_dir, NOT arg_max(negated, CASE WHEN base_path = '' THEN 0
                                             ELSE len(string_split(base_path, '/')) END * 1000 + rule_seq) AS ignored
  FROM matches GROUP BY path, is_dir),
ignored_dirs AS (SELECT path FROM verdicts WHERE ignored AND is_dir),
survivors AS (
  SELECT path, is_dir FROM below b
  WHERE NOT EXISTS (SELECT 1 FROM ignored_dirs d WHERE starts_with(b.path, d.path || '/'))
    AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.path = b.path AND v.is_dir = b.is_dir AND v.ignored))"""


def tree_below_root(t: Tables) -> DataFrame:
    return path_tree(t).withColumn("path", F.substring(F.col("path"), F.lit(6), F.length("path")))


def rules(t: Tables) -> DataFrame:
    from assay.schemas import RULE

    return t.spark.createDataFrame(list(RULES), RULE)


# Names with every e-acute taken apart ---------------------------------------------------

NAMES = "names AS (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS name FROM documents)"


def names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")).alias("name"))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(cte.strip() for cte in ctes) + "\n"
