"""Expected against actual, resume plans, ignore rules, name lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import ignore, lookup, manifests, resume, verify
from assay.queries import fixtures as X
from assay.queries.registry import Tables, query

SIDES = X.with_(
    X.SOURCE,
    X.DESTINATION,
    """expected AS (SELECT path, md5(payload) AS digest, size FROM source),
actual AS (SELECT path, md5(payload) AS digest, size FROM destination),
checked AS (
  SELECT coalesce(e.path, a.path) AS path,
         CASE WHEN a.path IS NULL THEN 'MISSING' WHEN e.path IS NULL THEN 'EXTRA' WHEN a.digest IS NULL THEN 'UNREADABLE'
              WHEN lower(a.digest) = lower(e.digest) THEN 'OK' ELSE 'FAIL' END AS status,
         e.digest AS expected, a.digest AS actual
  FROM expected e FULL OUTER JOIN actual a ON e.path = a.path),
results AS (
  SELECT path, status, expected, actual, CASE WHEN status = 'UNREADABLE' THEN 'unreadable' END AS error FROM checked)""",
)


def expected(t: Tables):
    return manifests.digest_entries(X.source_entries(t))


def actual(t: Tables):
    return manifests.digest_entries(X.destination_entries(t))


def results(t: Tables):
    return verify.check_full(expected(t), actual(t))


@query(SIDES + "SELECT path, status, expected, actual, error FROM results")
def check_full(t: Tables):
    return results(t)


@query(SIDES + "SELECT path, status, expected, actual, error FROM results WHERE status <> 'EXTRA'")
def verify_manifest(t: Tables):
    return verify.verify_manifest(expected(t), actual(t))


@query(SIDES + "SELECT path FROM expected ANTI JOIN actual USING (path)")
def missing_entries(t: Tables):
    return verify.missing_entries(X.source_entries(t), X.destination_entries(t))


@query(SIDES + "SELECT path FROM actual ANTI JOIN expected USING (path)")
def extra_entries(t: Tables):
    return verify.extra_entries(X.source_entries(t), X.destination_entries(t))


@query(SIDES + "SELECT path, size FROM actual SEMI JOIN expected USING (path)")
def entries_to_hash(t: Tables):
    return verify.entries_to_hash(X.source_entries(t), X.destination_entries(t)).select("path", "size")


@query(
    SIDES
    + """SELECT path, status, CASE status WHEN 'MISSING' THEN 0 WHEN 'EXTRA' THEN 1 ELSE 2 END AS section FROM results"""
)
def union_results(t: Tables):
    return verify.union_results(results(t)).select("path", "status", "section")


@query(SIDES + "SELECT status, path FROM results WHERE status IN ('MISSING', 'EXTRA') ORDER BY status, path")
def sorted_problems(t: Tables):
    return verify.sorted_problems(results(t))


@query(SIDES + "SELECT path, status FROM results WHERE status NOT IN ('OK', 'EXTRA') ORDER BY path LIMIT 1")
def first_problem(t: Tables):
    return verify.first_problem(verify.verify_manifest(expected(t), actual(t))).select("path", "status")


@query(
    SIDES
    + """SELECT count(*) FILTER (status IN ('OK', 'FAIL', 'UNREADABLE', 'DUPLICATE')) AS checked, count(*) FILTER (status = 'OK') AS ok,
                count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'MISSING') AS missing,
                count(*) FILTER (status = 'EXTRA') AS extra, count(*) FILTER (status = 'UNREADABLE') AS hash_errors,
                count(*) FILTER (status = 'DUPLICATE') AS duplicates, FALSE AS partial, FALSE AS cancelled FROM results"""
)
def status_summary(t: Tables):
    return verify.status_summary(results(t))


@query(
    SIDES
    + """SELECT coalesce(status, 'TOTAL') AS status, count(*) AS n FROM results
         WHERE status IN ('MISSING', 'FAIL', 'UNREADABLE') GROUP BY ROLLUP (status)"""
)
def problem_counts(t: Tables):
    return verify.problem_counts(results(t))


@query(
    SIDES
    + """SELECT count(*) AS checked, count(*) FILTER (status <> 'OK') AS problems,
                count(*) FILTER (status <> 'OK') = 0 AS passed FROM results WHERE status <> 'EXTRA'""",
)
def final_reverify(t: Tables):
    return verify.final_reverify(expected(t), actual(t))


@query(
    SIDES
    + """SELECT count(*) AS n_entries, CAST(sum(coalesce(a.size, 0)) AS BIGINT) AS total_bytes, 0::BIGINT AS n_mixed
         FROM expected e LEFT JOIN actual a USING (path)"""
)
def manifest_bytes(t: Tables):
    return verify.manifest_bytes(X.source_entries(t), X.destination_entries(t))


@query(
    SIDES
    + """SELECT e.path, e.digest AS written, a.digest AS read_back FROM expected e JOIN actual a USING (path)
         WHERE e.digest <> a.digest"""
)
def verify_copy(t: Tables):
    return verify.verify_copy(expected(t), actual(t))


@query(
    SIDES
    + """SELECT e.path, e.size AS bytes_read, a.size AS bytes_written FROM expected e JOIN actual a USING (path)
         WHERE e.size <> a.size"""
)
def byte_count_check(t: Tables):
    return verify.byte_count_check(X.source_entries(t), X.destination_entries(t))


# The same with paths that come more than once, on both sides -------------------------------

REPEATED = X.with_(X.SOURCE, X.DESTINATION, X.REPEATS)


@query(REPEATED + "SELECT path, status FROM judged")
def check_full_repeats(t: Tables):
    return verify.check_full(X.expected_rows(t), X.actual_rows(t)).select("path", "status")


@query(
    REPEATED
    + """SELECT count(*) FILTER (status NOT IN ('MISSING', 'EXTRA')) AS checked, count(*) FILTER (status = 'OK') AS ok,
                count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'MISSING') AS missing,
                count(*) FILTER (status = 'EXTRA') AS extra, count(*) FILTER (status = 'UNREADABLE') AS hash_errors,
                count(*) FILTER (status = 'DUPLICATE') AS duplicates, FALSE AS partial, FALSE AS cancelled FROM judged"""
)
def status_summary_repeats(t: Tables):
    return verify.status_summary(verify.check_full(X.expected_rows(t), X.actual_rows(t)))


@query(
    REPEATED
    + """SELECT coalesce(status, 'TOTAL') AS status, count(*) AS n FROM judged
         WHERE status NOT IN ('OK', 'EXTRA') GROUP BY ROLLUP (status)"""
)
def problem_counts_repeats(t: Tables):
    return verify.problem_counts(verify.verify_manifest(X.expected_rows(t), X.actual_rows(t)))


@query(
    REPEATED
    + """SELECT path FROM (SELECT path, digest FROM expected_rows WHERE path IN (SELECT path FROM actual_rows)
                           UNION ALL SELECT path, digest FROM actual_rows WHERE path IN (SELECT path FROM expected_rows))
         GROUP BY path HAVING count(DISTINCT lower(digest)) > 1"""
)
def verify_copy_repeats(t: Tables):
    return verify.verify_copy(X.expected_rows(t), X.actual_rows(t)).select("path")


@query(
    REPEATED
    + """SELECT path FROM (SELECT path, size FROM expected_rows WHERE path IN (SELECT path FROM actual_rows)
                           UNION ALL SELECT path, size FROM actual_rows WHERE path IN (SELECT path FROM expected_rows))
         GROUP BY path HAVING count(DISTINCT size) > 1"""
)
def byte_count_check_repeats(t: Tables):
    return verify.byte_count_check(X.expected_rows(t), X.actual_rows(t)).select("path")


@query(
    REPEATED
    + """SELECT count(*) AS n_entries, CAST(sum(coalesce(a.size, 0)) AS BIGINT) AS total_bytes, count(*) FILTER (a.sizes > 1) AS n_mixed
         FROM listed LEFT JOIN (SELECT path, max(size) AS size, count(DISTINCT size) AS sizes FROM actual_rows GROUP BY path) a USING (path)"""
)
def manifest_bytes_repeats(t: Tables):
    return verify.manifest_bytes(X.expected_rows(t), X.actual_rows(t))


# Resume ---------------------------------------------------------------------------------

RESUME = X.with_(
    X.SOURCE,
    X.DESTINATION,
    X.PREVIOUS,
    """planned AS (
  SELECT s.path, CASE WHEN p.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'missing_at_destination'
                      WHEN d.payload IS NULL THEN 'destination_unreadable'
                      WHEN md5(d.payload) <> p.digest THEN 'destination_changed'
                      WHEN md5(s.payload) <> p.digest THEN 'source_changed' ELSE 'verified' END AS reason
  FROM changed s LEFT JOIN previous p ON s.path = p.path LEFT JOIN destination d ON s.path = d.path)""",
)


@query(RESUME + "SELECT path, CASE reason WHEN 'verified' THEN 'SKIP' ELSE 'COPY' END AS action, reason FROM planned")
def resume_plan(t: Tables):
    source = manifests.digest_entries(X.changed_source(t))
    return resume.resume_plan(source, X.previous_manifest(t), actual(t))


@query(
    X.with_(X.SOURCE, X.DESTINATION, X.REPEATS, X.PREVIOUS)
    + """, recorded AS (
  SELECT path, count(DISTINCT digest) > 1 AS mixed, min(digest) AS digest FROM (
    SELECT path, digest FROM previous UNION ALL
    SELECT path, CASE substr(md5(path), 7, 1) WHEN 'a' THEN digest ELSE md5(digest) END FROM previous WHERE substr(md5(path), 7, 1) IN ('a', 'b'))
  GROUP BY path)
SELECT s.path, CASE WHEN r.mixed THEN 'conflicting_records' WHEN r.path IS NULL THEN 'new' WHEN t.path IS NULL THEN 'missing_at_destination'
                    WHEN t.unread THEN 'destination_unreadable' WHEN t.mixed OR t.digest <> r.digest THEN 'destination_changed'
                    WHEN s.mixed OR s.digest <> r.digest THEN 'source_changed' ELSE 'verified' END AS reason
FROM listed s LEFT JOIN recorded r ON s.path = r.path LEFT JOIN there t ON s.path = t.path"""
)
def resume_plan_repeats(t: Tables):
    previous, fault = X.previous_manifest(t), X.draw(F.col("path"), 7)
    again = previous.filter(fault.isin("a", "b")).withColumn("digest", F.when(fault == "a", F.col("digest")).otherwise(F.md5(F.col("digest").cast("binary"))))
    return resume.resume_plan(X.expected_rows(t), previous.unionByName(again), X.actual_rows(t)).select("path", "reason")


@query(
    REPEATED
    + """SELECT path, sizes > 1 AS size_differs FROM (
           SELECT path, count(DISTINCT size) AS sizes FROM (
             SELECT path, size, 'e' AS side FROM expected_rows UNION ALL SELECT path, size, 'a' FROM actual_rows)
           GROUP BY path HAVING count(DISTINCT side) = 2)"""
)
def resume_size_precheck_repeats(t: Tables):
    return resume.resume_size_precheck(X.expected_rows(t), X.actual_rows(t))


@query(
    RESUME
    + """SELECT p.path, p.size > 0 AND d.size > 0 AND p.size <> d.size AS size_differs
         FROM previous p JOIN destination d USING (path)"""
)
def resume_size_precheck(t: Tables):
    return resume.resume_size_precheck(X.previous_manifest(t), X.destination_entries(t))


@query(
    RESUME
    + """SELECT replace(path, '/', chr(0)) AS record_key, path, digest, size FROM previous
         WHERE contains(path, '/en/')"""
)
def previous_for_same_tree(t: Tables):
    # Each language went into a destination tree of its own.
    records = X.previous_manifest(t).withColumn("tree_id", F.element_at(F.split("path", "/"), 3))
    return resume.previous_for_same_tree(records, "en")


@query(
    X.with_(X.SOURCE, X.PREVIOUS)
    + "SELECT path, digest, 'destination' AS origin FROM previous"
)
def pick_resume_manifest(t: Tables):
    source = X.source_entries(t)
    checkpoint = manifests.digest_entries(X.changed_source(t))
    return resume.pick_resume_manifest(source, X.previous_manifest(t), checkpoint)


@query(
    X.with_(X.SOURCE, X.PREVIOUS) + "SELECT path, md5(payload) AS digest, 'checkpoint' AS origin FROM changed"
)
def pick_resume_manifest_name_taken(t: Tables):
    source = X.source_entries(t).select(F.concat(F.lit("manifest.xxh3/"), "path").alias("path"))
    checkpoint = manifests.digest_entries(X.changed_source(t))
    return resume.pick_resume_manifest(source, X.previous_manifest(t), checkpoint)


# Ignore rules ---------------------------------------------------------------------------

RULED = X.with_(X.TREE, X.RULES_SQL)


@query(RULED + "SELECT path, is_dir FROM survivors")
def apply_ignore_rules(t: Tables):
    return ignore.apply_ignore_rules(X.tree_below_root(t), X.rules(t)).select("path", "is_dir")


@query(RULED + "SELECT path, is_dir FROM survivors")
def apply_ignore_rules_joined(t: Tables):
    # The way taken for rule tables too long to compile.
    return ignore.apply_ignore_rules(X.tree_below_root(t), X.rules(t), compiled_rules=0).select("path", "is_dir")


@query(RULED + "SELECT path, is_dir, base_path, rule_seq, negated FROM matches")
def ignore_rule_join(t: Tables):
    return ignore.ignore_rule_join(X.tree_below_root(t), X.rules(t))


@query(RULED + "SELECT path, is_dir, ignored FROM verdicts")
def last_match_wins(t: Tables):
    return ignore.last_match_wins(ignore.ignore_rule_join(X.tree_below_root(t), X.rules(t)))


@query(
    RULED
    + """SELECT path, is_dir FROM below b
         WHERE NOT EXISTS (SELECT 1 FROM ignored_dirs d WHERE starts_with(b.path, d.path || '/') OR (b.is_dir AND b.path = d.path))"""
)
def prune_subtree(t: Tables):
    tree = X.tree_below_root(t)
    dropped = ignore.ignored_paths(tree, X.rules(t)).filter("is_dir").select("path")
    return ignore.prune_subtree(tree, dropped).select("path", "is_dir")


@query(
    X.with_(X.TREE)
    + """SELECT path AS base_path, CAST(1 AS INT) AS rule_seq, '^[^/]*\\.log$' AS regex, TRUE AS negated, FALSE AS dir_only, FALSE AS path_pattern FROM tree WHERE is_dir
         UNION ALL
         SELECT path, CAST(2 AS INT), '^(?:.*/)?' || replace(regexp_extract(path, '[^/]*$'), '.', '\\.') || '[^/]*$', FALSE, TRUE, TRUE FROM tree WHERE is_dir AND NOT contains(path, '-')"""
)
def parse_ignore_rule(t: Tables):
    # Every folder brings an ignore file of three lines, one of them a comment.
    folders = X.path_tree(t).filter("is_dir").select("path")
    name = F.substring_index("path", "/", -1)
    glob = F.when(~F.col("path").contains("-"), F.concat(F.lit("/**/"), name, F.lit("*/"))).otherwise("# none")
    lines = folders.select(
        F.col("path").alias("base_path"), F.posexplode(F.array(F.lit("!*.log  "), glob, F.lit("# a comment")))
    ).select("base_path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("value"))
    return ignore.rules_from_lines(lines)


@query(
    X.with_(X.TREE)
    + "SELECT path, '^' || replace(replace(path, '.', '\\.'), '-', '\\-') || '[^/]*[^/]$' AS regex FROM tree"
)
def glob_to_regex(t: Tables):
    from assay.functions.globs import glob_regex

    return X.path_tree(t).select("path", glob_regex(F.concat("path", F.lit("*?"))).alias("regex"))


@query(
    RULED
    + """SELECT base_path, rule_seq, row_number() OVER (ORDER BY len(string_split(base_path, '/')) * CAST(base_path <> '' AS INT), base_path, rule_seq) AS applied
         FROM (SELECT base_path, rule_seq FROM rules WHERE base_path <> '' UNION ALL SELECT DISTINCT path, 1 FROM below WHERE is_dir)"""
)
def append_rules(t: Tables):
    from assay.operators.runs import number_rows

    folders = X.tree_below_root(t).filter("is_dir").select(F.col("path").alias("base_path")).distinct()
    own = folders.select(
        "base_path", F.lit(1).alias("rule_seq"), F.lit(False).alias("negated"), F.lit(False).alias("dir_only"),
        F.lit(False).alias("path_pattern"), F.lit("^x$").alias("regex"),
    )
    ordered = ignore.append_rules(X.rules(t).filter("base_path <> ''"), own)
    depth = ordered.withColumn("depth", F.size(F.split("base_path", "/")))
    # Equal (base, line) pairs of the two sets are numbered apart by their regex.
    numbered = number_rows(depth, [], ["depth", "base_path", "rule_seq", "regex"], "applied")
    return numbered.select("base_path", "rule_seq", "applied")


# Lookups --------------------------------------------------------------------------------

LISTING = X.with_(
    X.SOURCE,
    """listing AS (
  SELECT CASE substr(md5(path), 1, 1) WHEN '0' THEN path WHEN '1' THEN NULL ELSE upper(path) END AS path FROM source
  UNION SELECT path FROM source WHERE substr(md5(path), 1, 1) = '3'),
wanted AS (SELECT path FROM source)""",
)


@query(
    LISTING
    + """SELECT w.path AS wanted, CASE WHEN e.path IS NOT NULL THEN w.path ELSE n.near END AS found,
                e.path IS NOT NULL AS exact
         FROM wanted w LEFT JOIN (SELECT DISTINCT path FROM listing) e ON w.path = e.path
         LEFT JOIN (SELECT lower(path) AS folded, min(path) AS near FROM listing GROUP BY 1) n ON lower(w.path) = n.folded"""
)
def lookup_name_ci(t: Tables):
    source = X.source_entries(t).select("path")
    fault = X.draw(F.col("path"), 1)
    shown = F.when(fault == "0", F.col("path")).when(fault != "1", F.upper("path"))
    listing = source.select(shown.alias("path")).unionByName(source.filter(fault == "3"))
    return lookup.lookup_name_ci(source, listing)


BACKUPS = X.with_(
    X.SOURCE,
    """listing AS (
  SELECT path FROM source WHERE substr(md5(path), 1, 1) NOT IN ('0', '1')
  UNION ALL
  SELECT path || '.verify.old.17' || doc_id FROM source WHERE substr(md5(path), 1, 1) IN ('0', '1', '2')
  UNION ALL
  SELECT path || '.verify.old.18' || doc_id FROM source WHERE substr(md5(path), 1, 1) IN ('0', '3')),
backups AS (
  SELECT path, regexp_replace(path, '[.]verify[.]old[.][0-9]+$', '') AS final_path FROM listing
  WHERE regexp_matches(path, '[.]verify[.]old[.][0-9]+$'))""",
)


@query(
    BACKUPS
    + """SELECT path, final_path,
                CASE WHEN final_path NOT IN (SELECT path FROM listing)
                      AND path = min(path) OVER (PARTITION BY final_path) THEN 'restore' ELSE 'delete' END AS action
         FROM backups"""
)
def recover_backups(t: Tables):
    source = X.source_entries(t).withColumn("fault", X.draw(F.col("path"), 1))

    def backup(prefix: str, *faults: str):
        name = F.concat("path", F.lit(f".verify.old.{prefix}"), F.col("doc_id").cast("string"))
        return source.filter(F.col("fault").isin(*faults)).select(name.alias("path"))

    kept = source.filter(~F.col("fault").isin("0", "1")).select("path")
    return lookup.recover_backups(kept.unionByName(backup("17", "0", "1", "2")).unionByName(backup("18", "0", "3")))
