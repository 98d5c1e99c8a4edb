import pytest
from pyspark.sql import functions as F

from assay.operators import manifests, verify
from assay.schemas import MANIFEST, VERIFY_RESULT
from assay.sources import readers, stores, writers

A, B = "a" * 32, "b" * 32


def write(tmp_path, content: bytes, name="manifest.xxh3"):
    target = tmp_path / name
    target.write_bytes(content)
    return str(target)


def as_dict(frame):
    return {row.path: row.digest for row in frame.collect()}


def test_manifest_reading_rules(spark, tmp_path):
    content = f"{A}  x/y.txt\r\n\n{A}   lead\n{A.upper()}  two  spaces\n{A}  x//y.txt\n{B}  ./x\n{B}  x/./y.txt".encode()
    read = as_dict(readers.read_manifest(spark, write(tmp_path, content)))
    # Only the first double space separates, spellings of one path are one key, the last line wins.
    assert read == {"x/y.txt": B, " lead": A, "two  spaces": A, "./x": B}


@pytest.mark.parametrize(
    "line, state",
    [
        (f"{A} x", "NO_SEPARATOR"),
        (f"{A[1:]}  x", "BAD_DIGEST"),
        (f"+{A[1:]}  x", "BAD_DIGEST"),
        (f"{A}  ../x", "UNSAFE"),
        (f"{A}  /x", "UNSAFE"),
        (f"{A}  C:\\x", "UNSAFE"),
    ],
)
def test_a_bad_line_fails_the_manifest_with_its_number(spark, tmp_path, line, state):
    place = write(tmp_path, f"{A}  fine\n\n{line}\n".encode())
    with pytest.raises(ValueError, match=f"line 3: {state}"):
        readers.read_manifest(spark, place)
    assert as_dict(readers.read_manifest(spark, place, mode="PERMISSIVE")) == {"fine": A}


@pytest.mark.parametrize(
    "line, state",
    [
        ("", "NO_SEPARATOR"),
        (f"{A}  ", "EMPTY_NAME"),
        (f"{A}  d/x", "PATH_IN_NAME"),
        (f"{A}  d\\x", "PATH_IN_NAME"),
        (f"{B}  fine", "DUPLICATE"),
        (f"{B}  cafe\u0301", "DUPLICATE"),
        (f"{A[1:]}g  x", "BAD_DIGEST"),
    ],
)
def test_checksums_are_stricter(spark, tmp_path, line, state):
    place = write(tmp_path, f"{A}  fine\n{A}  caf\u00e9\n{A}  .DS_Store\n{line}\n{A}  .DS_Store".encode(), "checksums.txt")
    with pytest.raises(ValueError, match=f"line 4: {state}"):
        readers.read_checksums(spark, place)


def test_lines_that_are_not_utf8_fail(spark, tmp_path):
    place = write(tmp_path, f"{A}  ok\n{A}  ".encode() + b"\xff\xfe\n")
    for read in (readers.read_manifest, readers.read_checksums):
        with pytest.raises(ValueError, match="line 2: BAD_ENCODING"):
            read(spark, place)


def test_checksums_normalize_names_and_digests(spark, tmp_path):
    place = write(tmp_path, f"{A.upper()}  cafe\u0301\r\n{B}  checksums.txt\n".encode(), "checksums.txt")
    assert as_dict(readers.read_checksums(spark, place)) == {"caf\u00e9": A}


def test_line_numbers_hold_across_splits(spark, tmp_path):
    count = 60_000
    place = write(tmp_path, "".join(f"line {n} {'x' * (n % 90)}\n" for n in range(1, count + 1)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert spark.read.text(place).rdd.getNumPartitions() > 4
        lines = readers.numbered_lines(spark, place)
        wrong = lines.filter(F.split("value", " ")[1].cast("bigint") != F.col("line_no"))
        assert (lines.count(), wrong.count()) == (count, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_manifest_is_in_component_order_and_reads_back(spark, tmp_path):
    rows = [("a-b", A), ("a/b", B), ("a", A), ("a/b/c", B), ("a.b", A)]
    manifest = spark.createDataFrame(rows, "path string, digest string")
    parts, target = str(tmp_path / "parts"), str(tmp_path / "manifest.xxh3")
    writers.write_manifest(manifest, parts)
    writers.publish_single_file(parts, target)
    written = open(target).read().splitlines()
    assert [line[34:] for line in written] == ["a", "a/b", "a/b/c", "a-b", "a.b"]
    assert as_dict(readers.read_manifest(spark, target)) == dict(rows)
    assert as_dict(readers.read_manifest(spark, parts)) == dict(rows)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_of_any_size_make_one_file(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(writers, "PIECE_BYTES", piece)
    parts, target = tmp_path / "parts", tmp_path / "new" / "manifest.xxh3"
    parts.mkdir()
    bodies = [b"first\n", b"", "zweite é\n".encode() * 3, b"x" * 20, b"end\n"]
    for i, body in enumerate(bodies):
        (parts / f"part-{i:05}").write_bytes(body)
    (parts / "_SUCCESS").write_bytes(b"no part")
    writers.publish_single_file(str(parts), str(target))
    assert target.read_bytes() == b"".join(bodies)
    assert [p.name for p in target.parent.iterdir()] == [target.name]


def test_stores_that_write_in_order_are_streamed(spark, tmp_path):
    parts = [(str(tmp_path / f"part-{i}"), i * 3, 3) for i in range(5)]
    for i, (place, *_) in enumerate(parts):
        open(place, "w").write(f"{i}{i}\n")
    table = spark.createDataFrame(parts[::-1], "part string, start long, size long")
    name, written = writers._in_order(table, str(tmp_path / "out" / "all"), 15)
    assert written == 15 and open(name).read() == "00\n11\n22\n33\n44\n"


def test_a_part_that_is_cut_short_leaves_no_file(spark, tmp_path, monkeypatch):
    parts, target = tmp_path / "parts", tmp_path / "manifest.xxh3"
    parts.mkdir()
    (parts / "part-0").write_bytes(b"short")
    listed = [{"name": "part-0", "size": 9}]
    monkeypatch.setattr(writers.stores, "list_dir", lambda place: listed)
    with pytest.raises(OSError, match="5 of 9"):
        writers.publish_single_file(str(parts), str(target))
    assert [p.name for p in tmp_path.iterdir()] == ["parts"]


def test_without_rows_the_file_is_empty(spark, tmp_path):
    none = spark.createDataFrame([], "path string, digest string")
    assert open(writers.write_checksums_file(none, str(tmp_path))).read() == ""


def test_a_bundle_is_one_file_and_a_readme(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PIECE_BYTES", 10)
    rows = [("a-b", A), ("a/b", B), ("a", A)]
    manifest = spark.createDataFrame(rows, "path string, digest string")
    passed = spark.createDataFrame([(True,)], "passed boolean")
    target = writers.write_manifest_bundle(manifest, str(tmp_path), passed)
    assert stores.is_file(target) and readers.resolve_manifest(str(tmp_path)) == target
    assert as_dict(readers.read_manifest(spark, target)) == dict(rows)
    sums = writers.write_checksums_file(manifest, str(tmp_path))
    assert stores.is_file(sums) and [r.value[34:] for r in spark.read.text(sums).collect()] == ["a", "a-b", "a/b"]


def test_checkpoint_file(spark, tmp_path):
    from base64 import urlsafe_b64encode as code

    def b64(value):
        return code(value.encode()).decode()

    body = [f"{A}\t12\t{b64('x/é')}", f"{A}\tmany\t{b64('//y/')}", "only\ttwo", f"{B}\t-1\t{b64('z')}\r"]
    place = write(tmp_path, "\n".join(["DEMO-SHA256-1", b64("tree:1"), *body]).encode(), "c.scm")
    rows = {tuple(row) for row in readers.read_checkpoint(spark, place).collect()}
    assert rows == {("tree:1", "x/é", A, 12), ("tree:1", "y", A, 0), ("tree:1", "z", B, -1)}
    assert readers.read_checkpoint(spark, write(tmp_path, b"other\nx\n", "d.scm")) is None


def test_checkpoint_lines_read_back(spark):
    records = spark.createDataFrame([("a/é", A, 3)], "path string, digest string, size long")
    assert readers.parse_checkpoint_records(writers.checkpoint_lines(records)).select(
        "path", "digest", "size"
    ).collect() == records.collect()


def test_checkpoint_table_keeps_the_newest_row_per_path(spark, tmp_path):
    schema = "path string, digest string, size long, finished_ms long"
    table = str(tmp_path / "checkpoint")
    for rows in ([("a", A, 1, 1), ("b", A, 1, 1)], [("a", B, 2, 2)], [("c", None, 9, 3)]):
        writers.write_checkpoint(spark.createDataFrame(rows, schema), table, "k")
    assert as_dict(writers.read_checkpoint_table(spark, table, "k")) == {"a": B, "b": A}


def test_checkpoint_key_xxh3(evaluate):
    from xxhash import xxh3_128_hexdigest

    assert evaluate(writers.checkpoint_key_xxh3(F.lit("/s"), F.lit("/d"))) == xxh3_128_hexdigest(b"/s\x00/d")


SIDES = "path string, digest string"


def test_sha256_manifests(spark, tmp_path):
    place = write(tmp_path, f"{A}{B}  x/y\n".encode(), "m.sha256")
    assert as_dict(readers.read_manifest(spark, place, digest="sha256")) == {"x/y": A + B}
    with pytest.raises(ValueError, match="BAD_DIGEST"):
        readers.read_manifest(spark, place)


def test_a_table_of_rows_becomes_a_manifest(spark):
    from assay.operators.entries import entries_from_rows

    df = spark.createDataFrame([(1, 2, 1.25, None), (1, 3, 2.0, "x")], "a int, b long, x double, s string")
    manifest = manifests.generate_manifest(entries_from_rows(df, ["a", "b"], ["x", "s"], "t", double_scale=2))
    assert manifest.columns == MANIFEST.names
    import hashlib

    assert as_dict(manifest) == {
        "t/1/2": hashlib.md5(b"125|~").hexdigest(), "t/1/3": hashlib.md5(b"200|1:x").hexdigest(),
    }


def test_check_full_statuses(spark):
    expected = spark.createDataFrame([("ok", A.upper()), ("bad", A), ("gone", A), ("dark", A)], SIDES)
    actual = spark.createDataFrame([("ok", A), ("bad", B), ("dark", None), ("new", B)], SIDES)
    results = verify.check_full(expected, actual)
    assert results.columns == VERIFY_RESULT.names
    assert {r.path: r.status for r in results.collect()} == {
        "ok": "OK", "bad": "FAIL", "gone": "MISSING", "dark": "UNREADABLE", "new": "EXTRA",
    }
    summary = verify.status_summary(results).first().asDict()
    assert summary == {
        "checked": 3, "ok": 1, "fail": 1, "missing": 1, "extra": 1, "hash_errors": 1, "duplicates": 0, "partial": False, "cancelled": False,
    }
    one_sided = verify.verify_manifest(expected, actual)
    assert {r.status: r.n for r in verify.problem_counts(one_sided).collect()} == {
        "FAIL": 1, "MISSING": 1, "UNREADABLE": 1, "TOTAL": 3,
    }
    assert verify.first_problem(one_sided).first().path == "bad"
    assert verify.final_reverify(expected, actual).first().asDict() == {"checked": 4, "problems": 3, "passed": False}


def test_a_path_on_a_third_of_both_sides_stays_one_row(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("path"),
        F.lit(A).alias("digest"),
    )
    results = verify.check_full(rows, rows)
    assert results.count() == 2001 and results.filter("status = 'OK'").count() == 2001


def test_run_level_error_is_one_row(spark):
    row = verify.failed_summary(spark, "cannot open").first()
    assert (row.error, row.hash_errors, row.checked) == ("cannot open", 1, 0)


def test_duplicate_keys(spark):
    lines = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 9)], "path string, line_no long")
    assert [tuple(r) for r in manifests.duplicate_keys(lines).collect()] == [("a", 3)]


def test_rows_that_disagree_about_a_path_are_never_ok(spark):
    from assay.operators import verify

    schema = "path string, digest string"
    listed = spark.createDataFrame([("p", "bbbb"), ("q", "bbbb"), ("r", "aaaa"), ("r", "AAAA"), ("s", "cc"), ("s", "dd")], schema)
    there = spark.createDataFrame([("p", "bbbb"), ("p", "aaaa"), ("q", None), ("q", "bbbb"), ("r", "aaaa"), ("s", "dd")], schema)
    expected = {"p": "DUPLICATE", "q": "UNREADABLE", "r": "OK", "s": "DUPLICATE"}
    assert {r.path: r.status for r in verify.check_full(listed, there).collect()} == expected
    assert {r.path: r.status for r in verify.verify_manifest(listed, there).collect()} == expected
