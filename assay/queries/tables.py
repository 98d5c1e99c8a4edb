"""Manifests, their text forms, totals and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions import digests, text
from assay.operators import entries as E, fingerprint, manifests, runs, verify
from assay.queries import fixtures as X
from assay.queries.registry import Tables, query
from assay.session import scratch_dir
from assay.sources import readers, writers

SRC = X.with_(X.SOURCE)
LINES = X.with_(X.SOURCE, X.LINES)
CHECKSUMS = X.with_(X.SOURCE, X.CHECKSUM_LINES)
DEST = X.with_(X.SOURCE, X.DESTINATION)

LINEITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINEITEM_KEY = "'row/' || " + " || '/' || ".join(LINEITEM_KEYS)
LINEITEM_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_TEXT = """CAST(round_even(l_quantity * 100, 0) AS BIGINT) || '|' || CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) || '|' ||
  CAST(round_even(l_discount * 100, 0) AS BIGINT) || '|' || CAST(round_even(l_tax * 100, 0) AS BIGINT) || '|' ||
  strlen(l_returnflag) || ':' || l_returnflag || '|' || strlen(l_linestatus) || ':' || l_linestatus || '|' || epoch_us(l_shipdate)"""


@query(f"SELECT {LINEITEM_KEY} AS path, md5({LINEITEM_TEXT}) AS digest FROM lineitem")
def generate_manifest(t: Tables):
    rows = E.entries_from_rows(t.lineitem, LINEITEM_KEYS, LINEITEM_VALUES, "row", double_scale=2)
    return manifests.generate_manifest(rows)


@query(DEST + "SELECT path, md5(payload) AS digest FROM destination WHERE payload IS NOT NULL")
def generate_manifest_documents(t: Tables):
    return manifests.generate_manifest(X.destination_entries(t))


@query(DEST + "SELECT path, 'unreadable' AS error FROM destination WHERE payload IS NULL")
def generate_manifest_failures(t: Tables):
    return manifests.unreadable_entries(X.destination_entries(t))


@query(
    DEST
    + """SELECT count(payload) AS checked, count(payload) AS ok, count(*) - count(payload) AS hash_errors,
                count(*) > count(payload) AS partial, FALSE AS cancelled FROM destination"""
)
def generate_summary(t: Tables):
    return verify.generate_summary(X.destination_entries(t))


@query(SRC + "SELECT count(*) AS n_entries, CAST(sum(size) AS BIGINT) AS total_bytes FROM source")
def total_bytes(t: Tables):
    return E.total_bytes(X.source_entries(t))


@query(
    DEST
    + """SELECT count(*) FILTER (payload IS NOT NULL) AS copied, count(*) FILTER (payload IS NULL) AS failed FROM destination"""
)
def copy_summary(t: Tables):
    outcome = F.when(F.col("payload").isNull(), "FAILED").otherwise("COPIED")
    return verify.copy_summary(X.destination_entries(t).select("path", outcome.alias("status")))


@query(
    LINES
    + """SELECT line_no, state, CASE state WHEN 'VALID' THEN lower(digest) END AS digest,
                CASE state WHEN 'VALID' THEN path END AS path FROM parsed"""
)
def parse_manifest_lines(t: Tables):
    return manifests.parse_manifest_lines(X.manifest_text(t))


def _written_lines(t: Tables, lines: DataFrame) -> str:
    place = scratch_dir(t.spark, "lines")
    lines.orderBy("line_no").select("value").write.text(place)
    return place


@query(LINES + "SELECT path, lower(arg_max(digest, line_no)) AS digest FROM parsed WHERE state = 'VALID' GROUP BY path")
def read_manifest(t: Tables):
    place = _written_lines(t, X.manifest_text(t))
    return readers.read_manifest(t.spark, place, mode="PERMISSIVE")


@query(LINES + "SELECT row_number() OVER (ORDER BY line_no) AS line_no, state FROM parsed QUALIFY state NOT IN ('VALID', 'BLANK')")
def read_manifest_bad_lines(t: Tables):
    place = _written_lines(t, X.manifest_text(t))
    return manifests.bad_lines(manifests.parse_manifest_lines(readers.numbered_lines(t.spark, place)))


@query(CHECKSUMS + "SELECT path, digest FROM checksum_parsed WHERE state = 'VALID'")
def read_checksums(t: Tables):
    place = _written_lines(t, X.checksum_text(t))
    return readers.read_checksums(t.spark, place, mode="PERMISSIVE")


@query(CHECKSUMS + "SELECT line_no, state, digest, path FROM checksum_parsed")
def parse_checksum_lines(t: Tables):
    parsed = manifests.parse_checksum_lines(X.checksum_text(t))
    valid = F.col("state").isin("VALID", "DUPLICATE")
    return parsed.select("line_no", "state", F.when(valid, F.col("digest")).alias("digest"), F.when(valid, F.col("path")).alias("path"))


@query(LINES + "SELECT path, arg_max(lower(digest), line_no) AS digest FROM parsed WHERE state = 'VALID' GROUP BY path")
def last_wins_by_key(t: Tables):
    parsed = manifests.parse_manifest_lines(X.manifest_text(t))
    return manifests.last_wins_by_key(parsed.filter("state = 'VALID'"))


@query(
    CHECKSUMS
    + """SELECT name AS path, line_no AS second_line FROM checksum_states WHERE state = 'VALID'
         QUALIFY row_number() OVER (PARTITION BY name ORDER BY line_no) = 2"""
)
def duplicate_keys(t: Tables):
    valid = manifests.parse_checksum_lines(X.checksum_text(t)).filter("state IN ('VALID', 'DUPLICATE')")
    return manifests.duplicate_keys(valid)


_CHECKPOINT = X.with_(
    X.SOURCE,
    """records AS (
  SELECT doc_id, path, CASE substr(md5(path), 1, 1) WHEN '0' THEN md5(payload) WHEN '1' THEN md5(payload) || chr(9) || 'many' || chr(9) || path
         ELSE '' END AS odd, payload, size FROM source)""",
)


@query(
    X.with_(X.SOURCE)
    + """SELECT path, sha256(payload) AS digest, CASE substr(md5(path), 1, 1) WHEN '1' THEN 0 ELSE size END AS size
         FROM source WHERE substr(md5(path), 1, 1) <> '0'"""
)
def read_checkpoint(t: Tables):
    # Two fields only (0: dropped), a size that is no number (1: counts as 0).
    fault = X.draw(F.col("path"), 1)
    digest = digests.sha256_hex(F.col("payload"))
    code = text.base64url_encode(F.col("path"))
    size = F.when(fault == "1", "many").otherwise(F.col("size").cast("string"))
    record = F.when(fault == "0", F.concat_ws("\t", digest, size)).otherwise(F.concat_ws("\t", digest, size, code))
    body = X.source_entries(t).select((F.col("doc_id") + 3).alias("line_no"), record.alias("value"))
    tree = text.base64url_encode(F.lit("content://tree/é"))
    head = t.spark.range(1).select(
        F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.lit("DEMO-SHA256-1").alias("value")),
                          F.struct(F.lit(2).alias("line_no"), tree.alias("value")))).alias("row")
    ).select("row.*")
    place = _written_lines(t, head.unionByName(body))
    return readers.read_checkpoint(t.spark, place).select("path", "digest", "size")


@query(SRC + "SELECT md5(payload) || '  ' || path AS value, row_number() OVER (ORDER BY string_split(path, '/')) AS line_no FROM source")
def write_manifest(t: Tables):
    place = scratch_dir(t.spark, "manifest")
    writers.write_manifest(manifests.digest_entries(X.source_entries(t)), place)
    return readers.numbered_lines(t.spark, place).select("line_no", "value")


@query(SRC + "SELECT md5(payload) || '  doc_' || doc_id AS value, row_number() OVER (ORDER BY 'doc_' || doc_id) AS line_no FROM source")
def write_checksums(t: Tables):
    place = scratch_dir(t.spark, "checksums")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    flat = X.source_entries(t).select(name.alias("path"), digests.md5_hex(F.col("payload")).alias("digest"))
    writers.write_checksums(flat, place)
    return readers.numbered_lines(t.spark, place).select("line_no", "value")


@query(X.with_(X.SOURCE, X.PREVIOUS) + "SELECT path, md5(payload) AS digest, CAST(strlen(payload) AS BIGINT) AS size FROM changed")
def write_checkpoint(t: Tables):
    # Two runs append to the same table; the newest row of each path counts.
    place = scratch_dir(t.spark, "checkpoint")
    for stamp, entries in enumerate([X.source_entries(t), X.changed_source(t)]):
        size = F.octet_length("payload").cast("bigint").alias("size")
        rows = entries.select("path", digests.md5_hex(F.col("payload")).alias("digest"), size)
        writers.write_checkpoint(rows.withColumn("finished_ms", F.lit(stamp).cast("bigint")), place, "k1")
    return writers.read_checkpoint_table(t.spark, place, "k1")


@query(
    X.with_(X.ERROR_LOG)
    + """SELECT error_kind || '/' || event_id AS source_relative, CAST(attempt AS INT) AS attempts, epoch_us(ts) // 1000000 AS unix_time,
                io_kind AS reason, error_kind || '__' || event_id || '.' || epoch_us(ts) // 1000000 || '.failed.json' AS report_name
         FROM error_log"""
)
def write_quarantine(t: Tables):
    place = scratch_dir(t.spark, "quarantine")
    failures = _failures(t)
    writers.write_quarantine(failures, place)
    return readers.read_quarantine(t.spark, place)


def _failures(t: Tables) -> DataFrame:
    log = X.error_log(t)
    return log.select(
        F.concat_ws("/", "error_kind", F.col("event_id").cast("string")).alias("source_relative"),
        F.col("attempt").cast("int").alias("attempts"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix_time"),
        F.col("io_kind").alias("reason"),
    )


@query(
    X.with_(X.ERROR_LOG)
    + """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence,
                'quarantine-' || (epoch_us(ts) // 1000000 * 1000) || '-' ||
                row_number() OVER (PARTITION BY user_id ORDER BY event_id) || '.json' AS report_name FROM error_log"""
)
def quarantine_sequence(t: Tables):
    failures = X.error_log(t).select(
        "event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix_time")
    )
    return runs.quarantine_sequence(failures, "user_id", ["event_id"]).drop("unix_time")


@query(
    X.with_(X.NAMES)
    + """, flat AS (
  SELECT CASE WHEN substr(md5(name), 1, 1) < '8' THEN 'cafe' || chr(769) ELSE 'café' END || '_' || substr(md5(name), 2, 1) AS name FROM names)
SELECT nfc_normalize(name) AS nfc_name, max(name) AS name, count(*) AS n_names FROM flat GROUP BY 1"""
)
def nfc_collision_last_wins(t: Tables):
    name = F.col("name")
    stem = F.when(X.draw(name, 1) < "8", "cafe\u0301").otherwise("café")
    flat = X.names(t).select(F.concat(stem, F.lit("_"), X.draw(name, 2)).alias("name"))
    return E.nfc_collision_last_wins(flat)


# Orders: the position of every entry is part of the result --------------------------------


@query(X.with_(X.TREE) + "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS done, count(*) OVER () AS total FROM tree")
def done_of_total(t: Tables):
    tree = X.path_tree(t).withColumn("parts", F.split("path", "/"))
    return runs.done_of_total(tree, ["parts"]).select("path", "done", "total")


@query(X.with_(X.TREE) + "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM tree")
def order_by_components(t: Tables):
    return _positions(t, E.order_by_components(X.path_tree(t)))


@query(X.with_(X.TREE) + "SELECT path, row_number() OVER (ORDER BY path) AS position FROM tree")
def order_by_name(t: Tables):
    return _positions(t, E.order_by_name(X.path_tree(t)))


@query(X.with_(X.SOURCE) + "SELECT path, row_number() OVER (ORDER BY string_split(lower(path), '/'), path) AS position FROM (SELECT CASE WHEN substr(md5(path), 1, 1) < '8' THEN upper(path) ELSE path END AS path FROM source)")
def order_by_name_ci(t: Tables):
    shown = F.when(X.draw(F.col("path"), 1) < "8", F.upper("path")).otherwise(F.col("path"))
    return _positions(t, E.order_by_name_ci(X.source_entries(t).select(shown.alias("path"))))


def _positions(t: Tables, ordered: DataFrame) -> DataFrame:
    """Line numbers of a sorted listing once written, which is what its order is for."""
    place = scratch_dir(t.spark, "ordered")
    ordered.select("path").write.text(place)
    return readers.numbered_lines(t.spark, place).select(
        F.col("value").alias("path"), F.col("line_no").alias("position")
    )


# Fingerprints -------------------------------------------------------------------------------

_ROW = f"l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || {LINEITEM_TEXT}"
_LIMBS = [f"CAST(('0x' || substr(d, {1 + 8 * i}, 8)) AS BIGINT)" for i in range(4)]
_SUMS = (
    "count(*) AS n_rows, "
    + " || ".join(f"printf('%016x', CAST(sum({limb}) AS BIGINT))" for limb in _LIMBS)
    + " AS hash_sum, "
    + " || ".join(f"printf('%08x', bit_xor({limb}))" for limb in _LIMBS)
    + " AS hash_xor"
)
_FINGERPRINT = f"""
WITH hashed AS (SELECT *, md5({_ROW}) AS d FROM lineitem)
SELECT {{keys}} {_SUMS} FROM hashed {{group}}"""


@query(_FINGERPRINT.format(keys="l_returnflag, l_linestatus,", group="GROUP BY l_returnflag, l_linestatus"))
def table_fingerprint(t: Tables):
    return fingerprint.table_fingerprint(t.lineitem, ["l_returnflag", "l_linestatus"], double_scale=2)


@query(_FINGERPRINT.format(keys="", group=""))
def verified_write(t: Tables):
    target = scratch_dir(t.spark, "verified")
    written = fingerprint.verified_write(t.lineitem, target)
    return fingerprint.table_fingerprint(written, double_scale=2)


@query(_FINGERPRINT.format(keys="", group=""))
def promote_with_backup(t: Tables):
    # A table stands where the verified one is to go.
    target = scratch_dir(t.spark, "promoted")
    t.orders.write.parquet(target)
    written = fingerprint.verified_write(t.lineitem, target, mode="overwrite")
    return fingerprint.table_fingerprint(written, double_scale=2)


@query(
    f"""WITH hashed AS (
  SELECT md5(l_orderkey || '|' || CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 15)) AS BIGINT)) AS d
  FROM lineitem)
SELECT {_SUMS} FROM hashed"""
)
def preflight_probe(t: Tables):
    # As much noise as the table about to be written has rows.
    target = scratch_dir(t.spark, "probed")
    return fingerprint.preflight_probe(t.spark, target, t.lineitem.select(F.col("l_orderkey").alias("id")))
