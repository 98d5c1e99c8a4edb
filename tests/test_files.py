import errno
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from assay.operators import copying, fingerprint, resume
from assay.options import JobOptions
from assay.plans import jobs
from assay.sources import filetree, readers, stores, writers

QUICK = JobOptions(backoff_unit_secs=0.0, unlimited_retries=False, no_manifest=False)


@pytest.fixture
def tree(tmp_path):
    """Empty, hidden, underscored, spaced and non-ASCII names, big blocks, deep folders, a link."""
    root = tmp_path / "photos"
    files = {
        "empty": b"",
        ".hidden": b"h",
        "_underscore": b"u",
        "with space%.txt": b"s",
        "caf\u00e9.txt": b"nfc",
        "cafe\u0301.txt": b"nfd",
        "one-mib": b"m" * (1 << 20),
        "one-mib-plus": b"m" * ((1 << 20) + 1),
        "big": os.urandom((4 << 20) + 77),
        "/".join("abcdefghij") + "/leaf": b"deep",
        "node_modules/dep.js": b"junk",
        "build": b"a file called build",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / "link").symlink_to(root / "big")
    (root / "linked-dir").symlink_to(root / "a")
    return root, files


def listed(frame):
    return {row.path: row.size for row in frame.collect()}


def test_scan_lists_every_regular_file_once(spark, tree):
    root, files = tree
    assert listed(filetree.scan_tree(spark, str(root))) == {f"photos/{n}": len(c) for n, c in files.items()}
    assert set(listed(filetree.scan_without_root(spark, str(root)))) == set(files)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_rounds_cover_the_tree_whatever_a_task_may_open(spark, tree, monkeypatch, budget):
    root, files = tree
    monkeypatch.setattr(filetree, "WALK_BUDGET", budget)
    rows = filetree.scan_without_root(spark, str(root), skip_junk="extended").collect()
    assert sorted(row.path for row in rows) == sorted(set(files) - {"node_modules/dep.js"})


def test_scan_of_one_file(spark, tree):
    root, _ = tree
    assert listed(filetree.scan_tree(spark, str(root / "one-mib"))) == {"one-mib": 1 << 20}
    assert listed(filetree.scan_single(spark, str(root / "empty"))) == {"empty": 0}
    with pytest.raises(IsADirectoryError):
        filetree.scan_single(spark, str(root))


def test_junk_is_pruned_but_the_root_is_exempt(spark, tree, tmp_path):
    root, files = tree
    renamed = tmp_path / "target"
    root.rename(renamed)
    kept = set(listed(filetree.scan_tree(spark, str(renamed), skip_junk="basic")))
    assert kept == {f"target/{name}" for name in files} - {"target/node_modules/dep.js"}


def test_ignore_files_of_every_level_apply(spark, tmp_path):
    for name, content in {
        ".gitignore": "*.log\nout/\n", "keep.txt": "", "x.log": "", "sub/.gitignore": "!x.log\n", "sub/x.log": "",
        "sub/y.log": "", "out/.gitignore": "!*\n", "out/x.txt": "",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    kept = set(listed(filetree.scan_without_root(spark, str(tmp_path), respect_ignore_files=True)))
    assert kept == {".gitignore", "keep.txt", "sub/.gitignore", "sub/x.log"}
    assert len(listed(filetree.scan_without_root(spark, str(tmp_path)))) == 8


def test_flat_scan(spark, tree):
    root, _ = tree
    (root / ".DS_Store").write_bytes(b"")
    (root / "checksums.txt").write_bytes(b"")
    rows = filetree.scan_flat(spark, str(root)).collect()
    names = [row.path for row in rows]
    assert names == sorted(names)
    assert names.count("caf\u00e9.txt") == 2 and ".DS_Store" not in names and "checksums.txt" not in names
    assert "link" in names and "linked-dir" in names


def test_missing_root_fails_and_a_vanished_folder_does_not(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        filetree.scan_tree(spark, str(tmp_path / "nowhere")).count()
    gone = spark.createDataFrame([("gone", str(tmp_path / "gone"))], "path string, abs_path string")
    row = filetree.list_directories(gone).first()
    assert (row.path, row.kind) == ("gone", "gone") and "vanished" in row.scan_error


def test_digests_of_files(spark, tree):
    root, files = tree
    entries = filetree.scan_without_root(spark, str(root))
    got = {row.path: row.digest for row in filetree.digest_files(entries).collect()}
    assert got == {name: xxh3_128_hexdigest(content) for name, content in files.items()}


def test_unreadable_file_gets_an_error(spark, tmp_path):
    gone = spark.createDataFrame([("x", str(tmp_path / "x"), 1)], "path string, abs_path string, size long")
    row = filetree.digest_files(gone).first()
    assert row.digest is None and "No such file" in row.error


def copied(destination):
    return {
        os.path.relpath(os.path.join(folder, name), destination): open(os.path.join(folder, name), "rb").read()
        for folder, _, names in os.walk(destination)
        for name in names
    }


def test_copy_then_verify_then_damage(spark, tree, tmp_path):
    root, files = tree
    destination = tmp_path / "card"
    result = jobs.copy_tree(spark, str(root), str(destination), QUICK)
    there = copied(destination)
    assert {k: v for k, v in there.items() if k.startswith("photos/")} == {f"photos/{n}": c for n, c in files.items()}
    assert set(there) - {f"photos/{n}" for n in files} == {"manifest.xxh3", "manifest.README.txt"}
    assert result.verification.first().passed
    assert os.stat(root / "big").st_mtime_ns == os.stat(destination / "photos/big").st_mtime_ns

    (destination / "photos/big").write_bytes(b"flipped")
    (destination / "photos/empty").unlink()
    (destination / "photos/extra").write_bytes(b"")
    got = {row.path: row.status for row in jobs.verify_tree(spark, str(destination)).collect()}
    assert got.pop("photos/big") == "FAIL" and got.pop("photos/empty") == "MISSING"
    assert set(got.values()) == {"OK"} and "photos/extra" not in got


def test_resume_repairs_what_changed_and_skips_the_rest(spark, tree, tmp_path):
    root, files = tree
    destination, table = tmp_path / "card", str(tmp_path / "checkpoint")
    options = JobOptions(backoff_unit_secs=0.0)
    jobs.copy_tree(spark, str(root), str(destination), options, checkpoint_table=table)
    (destination / "photos/big").write_bytes(b"x" * len(files["big"]))
    (root / ".hidden").write_bytes(b"H")
    (destination / "photos/_underscore").unlink()
    result = jobs.copy_tree(spark, str(root), str(destination), options, checkpoint_table=table)
    status = {row.path: row.status for row in result.outcomes.collect()}
    again = {path for path, s in status.items() if s == "COPIED"}
    assert again == {"photos/big", "photos/.hidden", "photos/_underscore"}
    assert set(status.values()) == {"COPIED", "SKIPPED"}
    assert (destination / "photos/.hidden").read_bytes() == b"H"
    assert (destination / "photos/big").read_bytes() == files["big"]


def test_entries_gone_from_the_source_leave_the_manifest(spark, tree, tmp_path):
    root, _ = tree
    destination, table = tmp_path / "card", str(tmp_path / "checkpoint")
    jobs.copy_tree(spark, str(root), str(destination), QUICK, checkpoint_table=table)
    (root / "one-mib").unlink()
    result = jobs.copy_tree(spark, str(root), str(destination), QUICK, checkpoint_table=table)
    assert "photos/one-mib" not in {row.path for row in result.manifest.collect()}


def test_overlap_newline_and_reserved_names_are_refused(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a").write_text("a")
    with pytest.raises(ValueError, match="lies in"):
        jobs.copy_tree(spark, str(root), str(root / "inner"), QUICK)
    with pytest.raises(ValueError, match="lies in"):
        jobs.copy_tree(spark, str(root), str(tmp_path), QUICK)
    (root / "two\nlines").write_text("b")
    with pytest.raises(ValueError, match="newline"):
        jobs.copy_tree(spark, str(root), str(tmp_path / "d"), QUICK)
    named = tmp_path / "manifest.xxh3"
    named.mkdir()
    (named / "a").write_text("a")
    with pytest.raises(ValueError, match="reserved"):
        jobs.copy_tree(spark, str(named), str(tmp_path / "d"), QUICK)
    jobs.copy_tree(spark, str(named), str(tmp_path / "d"), JobOptions(backoff_unit_secs=0.0))
    with pytest.raises(ValueError, match="no files"):
        (tmp_path / "void").mkdir()
        jobs.copy_tree(spark, str(tmp_path / "void"), str(tmp_path / "d"), QUICK)


def work_of(spark, rows):
    return spark.createDataFrame(rows, "path string, abs_path string, size long")


def test_unreadable_source_is_quarantined_and_the_rest_is_copied(spark, tmp_path):
    (tmp_path / "good").write_text("g")
    work = work_of(spark, [("good", str(tmp_path / "good"), 1), ("lost", str(tmp_path / "lost"), 1)])
    rows = {row.path: row for row in copying.verified_copy(work, str(tmp_path / "out"), QUICK).collect()}
    assert rows["good"].status == "COPIED"
    lost = rows["lost"]
    assert (lost.status, lost.error_class, lost.error_kind, lost.attempts) == ("FAILED", "FILE", "RetriesExhausted", 3)
    assert os.listdir(tmp_path / "out") == ["good"]


def test_a_blocked_destination_is_retried_and_leaves_no_temporary_file(spark, tmp_path):
    (tmp_path / "f").write_text("f")
    (tmp_path / "out" / "f" / "occupied").mkdir(parents=True)
    work = work_of(spark, [("f", str(tmp_path / "f"), 1)])
    row = copying.verified_copy(work, str(tmp_path / "out"), QUICK).first()
    assert (row.status, row.attempts) == ("FAILED", 3)
    assert os.listdir(tmp_path / "out") == ["f"]


def test_a_device_failure_ends_the_share_of_its_task(tmp_path, monkeypatch):
    import errno

    tried = []

    def full(source, *_):
        tried.append(source)
        raise copying.AttemptFailed("DestinationWrite", OSError(errno.ENOSPC, "full"))

    monkeypatch.setattr(copying, "_attempt", full)
    share = copying._Share(str(tmp_path), 1, QUICK, False)
    rows = [share.copy({"path": p, "abs_path": p, "size": 1}) for p in "abc"]
    assert [row["status"] for row in rows] == ["FAILED", "STOPPED", "STOPPED"] and tried == ["a"]
    assert (rows[0]["error_class"], rows[0]["io_kind"], rows[0]["attempts"]) == ("DEVICE", "StorageFull", 1)


def test_damage_while_writing_is_noticed(tmp_path, monkeypatch):
    (tmp_path / "f").write_text("f")
    monkeypatch.setattr(stores, "digest_file", lambda location, digest: "0" * 32)
    with pytest.raises(copying.AttemptFailed) as failure:
        copying._attempt(str(tmp_path / "f"), str(tmp_path / "g"), str(tmp_path / "g.tmp"), "md5", False)
    assert (failure.value.kind, failure.value.error_class) == ("HashMismatch", "TRANSIENT")
    assert not (tmp_path / "g").exists()


def test_promotion_restores_the_backup_when_it_fails(tmp_path):
    (tmp_path / "f").write_text("old")
    with pytest.raises(OSError):
        copying._promote_with_backup(str(tmp_path / "missing"), str(tmp_path / "f"))
    assert (tmp_path / "f").read_text() == "old" and os.listdir(tmp_path) == ["f"]
    (tmp_path / "new").write_text("new")
    copying._promote_with_backup(str(tmp_path / "new"), str(tmp_path / "f"))
    assert (tmp_path / "f").read_text() == "new" and os.listdir(tmp_path) == ["f"]


def test_short_read(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"abc")
    monkeypatch.setattr(stores, "size_of", lambda location: 5)
    with pytest.raises(stores.ShortReadError, match="2 bytes missing"):
        stores.digest_file(str(tmp_path / "f"), "md5")


def test_other_stores_are_reached_through_arrow(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(stores, "_arrow", lambda uri: (fs.LocalFileSystem(), uri.removeprefix("store://")))
    root = f"store://{tmp_path}"
    stores.make_parents(f"{root}/d/x.tmp")
    with stores.open_write(f"{root}/d/x.tmp") as out:
        out.write(b"abc")
        stores.sync(out)
    stores.move(f"{root}/d/x.tmp", f"{root}/d/x")
    assert [(c["name"], c["kind"], c["size"]) for c in stores.list_dir(f"{root}/d")] == [("x", "file", 3)]
    assert [(c["name"], c["kind"]) for c in stores.list_dir(root)] == [("d", "dir")]
    assert stores.digest_file(f"{root}/d/x", "md5") == "900150983cd24fb0d6963f7d28e17f72"
    assert stores.is_file(f"{root}/d/x") and not stores.is_file(f"{root}/d")
    stores.delete(f"{root}/d/x")
    stores.delete(f"{root}/d/x")
    assert not stores.exists(f"{root}/d/x")


def test_leftovers_of_interrupted_runs(spark, tmp_path):
    names = ["a", "a.verify.tmp", "d/b.verify.tmp.12", "d/c.verify.tmp.x", "a.verify.old.1", "gone.verify.old.1", "gone.verify.old.2"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    root = str(tmp_path)
    dry = copying.clean_stale_temps(spark, root, dry_run=True).collect()
    assert {row.path for row in dry} == {"a.verify.tmp", "d/b.verify.tmp.12"} and (tmp_path / "a.verify.tmp").exists()
    copying.clean_stale_temps(spark, root)
    actions = {row.path: row.action for row in copying.recover_interrupted(spark, root).collect()}
    assert actions == {"a.verify.old.1": "delete", "gone.verify.old.1": "restore", "gone.verify.old.2": "delete"}
    assert set(copied(root)) == {"a", "gone", "d/c.verify.tmp.x"}


def test_checksum_folder(spark, tree):
    root, _ = tree
    (root / "linked-dir").unlink()
    (root / "cafe\u0301.txt").unlink()
    jobs.generate_checksums(spark, str(root))
    assert {row.status for row in jobs.check_checksums(spark, str(root)).collect()} == {"OK"}
    (root / "empty").unlink()
    (root / "fresh").write_text("x")
    (root / "build").write_text("changed")
    problems = {row.path: row.status for row in jobs.check_checksums(spark, str(root)).filter("status <> 'OK'").collect()}
    assert problems == {"empty": "MISSING", "fresh": "EXTRA", "build": "FAIL"}


def test_empty_folder_gets_an_empty_checksum_file(spark, tmp_path):
    jobs.generate_checksums(spark, str(tmp_path))
    assert (tmp_path / "checksums.txt").read_bytes() == b""


def test_too_many_failures_in_a_row_stop_the_run(spark, tmp_path, monkeypatch):
    source = tmp_path / "src"
    source.mkdir()
    for n in range(8):
        (source / f"f{n}").write_text("x")
    blocked = tmp_path / "card" / "src"
    for n in range(2, 7):
        (blocked / f"f{n}" / "occupied").mkdir(parents=True)
    with pytest.raises(jobs.RunStopped, match="entry 7"):
        jobs.copy_tree(spark, str(source), str(tmp_path / "card"), QUICK)


def test_a_failing_store_stops_a_large_copy_early(spark, tmp_path, monkeypatch):
    source = tmp_path / "src"
    source.mkdir()
    for n in range(400):
        (source / f"f{n:03d}").write_text("x")
    for n in range(3, 9):  # in a row, early in the tree
        (tmp_path / "card" / "src" / f"f{n:03d}" / "occupied").mkdir(parents=True)
    table = str(tmp_path / "done")
    slow = JobOptions(backoff_unit_secs=0.05, unlimited_retries=False)
    with pytest.raises(jobs.RunStopped, match="entry 8"):
        jobs.copy_tree(spark, str(source), str(tmp_path / "card"), slow, checkpoint_table=table)
    counts = dict(spark.read.parquet(table).groupBy("status").count().collect())
    assert counts["FAILED"] == 5 and counts["STOPPED"] >= 190 and sum(counts.values()) == 400
    reports = os.listdir(tmp_path / "card" / ".quarantine")
    assert sorted(r.split(".")[0] for r in reports) == [f"src__f{n:03d}" for n in range(3, 8)]


def test_a_copy_reports_while_it_runs(spark, tree, tmp_path, monkeypatch):
    from assay.sources import events
    from assay.streaming import progress

    monkeypatch.setattr(events, "CHUNK_FILES", 2)
    root, files = tree
    (tmp_path / "card" / "photos" / "empty" / "occupied").mkdir(parents=True)
    told = str(tmp_path / "events")
    result = jobs.copy_tree(spark, str(root), str(tmp_path / "card"), QUICK, events=told)
    progress.progress_stream(events.event_stream(spark, told), str(tmp_path / "state")).awaitTermination()
    state = progress.current_state(spark, str(tmp_path / "state")).first()
    total = sum(map(len, files.values()))
    assert (state.phase, state.total_bytes, state.completed_bytes) == ("Done", total, total)
    assert result.outcomes.count() == len(files) and any("photos/empty" in line for line in state.log)
    names = [n for n in os.listdir(told) if n.endswith(".json")]
    assert len(names) >= len(files) // 2


def test_a_repeated_task_reports_the_same(tmp_path):
    from assay.sources import events

    def lines(task):
        for n in range(130):
            task.done(f"f{n}", n, "bad" if n == 5 else None)
        task.flush("f129")
        return {p.name: [{k: v for k, v in json.loads(line).items() if k != "ts"} for line in p.read_text().splitlines()] for p in tmp_path.iterdir()}

    first, again = (lines(events.TaskEvents(str(tmp_path), "job", 2, 7)) for _ in range(2))
    assert first == again and len(first) == 3
    rows = [row for rows in first.values() for row in rows]
    assert sum(r.get("bytes", 0) for r in rows) == sum(range(130)) and len({r["seq"] for r in rows}) == len(rows)


def test_pick_resume_manifest(spark):
    rows, entries = "path string, digest string", "path string"
    placed = spark.createDataFrame([("a", "1")], rows)
    stored = spark.createDataFrame([("a", "2")], rows)
    own = spark.createDataFrame([("manifest.xxh3",)], entries)
    other = spark.createDataFrame([("x/manifest.xxh3",)], entries)
    assert resume.pick_resume_manifest(other, placed, stored).first().origin == "destination"
    assert resume.pick_resume_manifest(own, placed, stored).first().origin == "checkpoint"
    assert resume.pick_resume_manifest(other, placed.limit(0), stored).first().digest == "2"


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 == 0, "a|b").alias("s"))
    one = fingerprint.table_fingerprint(df).first()
    assert one == fingerprint.table_fingerprint(df.orderBy(F.rand(1))).first()
    assert one != fingerprint.table_fingerprint(df.withColumn("s", F.coalesce("s", F.lit("")))).first()
    assert one != fingerprint.table_fingerprint(df.filter("id <> 5")).first()
    moved = spark.createDataFrame([("a|1:b", "c")], "x string, y string")
    assert fingerprint.table_fingerprint(moved).first() != fingerprint.table_fingerprint(
        spark.createDataFrame([("a", "b|1:c")], "x string, y string")
    ).first()


def test_fingerprint_of_times_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000123' AS t UNION ALL SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.9'")
    utc = fingerprint.table_fingerprint(df).first()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert fingerprint.table_fingerprint(df).first() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_verified_write(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    df = spark.range(100).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("m"))
    assert fingerprint.verified_write(df, target).count() == 100
    with pytest.raises(FileExistsError):
        fingerprint.verified_write(df, target)
    assert fingerprint.verified_write(df.limit(7), target, mode="overwrite").count() == 7
    monkeypatch.setattr(fingerprint, "same_fingerprint", lambda written, read_back: False)
    with pytest.raises(fingerprint.VerificationError):
        fingerprint.verified_write(df, target, mode="overwrite")
    assert spark.read.parquet(target).count() == 7


def test_probe_leaves_nothing_behind(spark, tmp_path):
    assert fingerprint.preflight_probe(spark, str(tmp_path)).first().n_rows == 655_360
    assert [name for name in os.listdir(tmp_path) if "probe" in name and not name.endswith(".crc")] == []


def test_options_are_clamped():
    wild = JobOptions(cooldown_secs=500, max_retries=0).clamp_options()
    assert (wild.cooldown_secs, wild.max_retries) == (120, 1)


def test_files_are_dealt_by_volume(spark):
    task = F.spark_partition_id().alias("task")
    even = spark.range(100).select(F.format_string("f%03d", "id").alias("path"), F.lit("x").alias("abs_path"), F.lit(100 << 30).alias("size"))
    tasks = filetree.spread_by_size(even, bytes_per_task=101 << 30).select(task).collect()
    assert len({row.task for row in tasks}) == len(tasks) == 100
    mixed = even.withColumn("size", F.when(F.col("path") == "f050", F.lit(1000)).when(F.col("path") < "f003", F.lit(None)).otherwise(10))
    placed = filetree.spread_by_size(mixed, bytes_per_task=200, files_per_task=200)
    loads = placed.groupBy(task).agg(F.sum(F.coalesce("size", F.lit(0)) + 1).alias("load"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
    assert sum(row.n for row in loads) == 100
    assert all(row.load <= 200 + row.largest + 1 for row in loads)
    assert filetree.spread_by_size(even.limit(0)).count() == 0


def test_copy_puts_backups_back_probes_and_finds_its_checkpoint(spark, tmp_path):
    source, card = tmp_path / "src", tmp_path / "card"
    source.mkdir()
    (source / "a").write_text("a")
    (source / "Thumbs.db").write_text("t")
    (source / ".idea").mkdir()
    (source / ".idea" / "b").write_text("b")
    card.mkdir()
    (card / "other.verify.old.1").write_text("o")
    options = JobOptions(backoff_unit_secs=0.0, skip_junk="extended")
    assert {row.status for row in jobs.copy_tree(spark, str(source), str(card), options).outcomes.collect()} == {"COPIED"}
    again = jobs.copy_tree(spark, str(source), str(card), options)
    assert {(row.path, row.status) for row in again.outcomes.collect()} == {("src/a", "SKIPPED")}
    assert set(copied(card)) == {"other", "src/a"}


def test_an_unreadable_checkpoint_is_no_obstacle(spark, tmp_path):
    source, card, table = tmp_path / "src", tmp_path / "card", tmp_path / "checkpoint"
    source.mkdir()
    (source / "a").write_text("a")
    options = JobOptions(backoff_unit_secs=0.0)
    jobs.copy_tree(spark, str(source), str(card), options, checkpoint_table=str(table))
    for part in table.rglob("part-*.parquet"):
        part.write_bytes(b"broken")
    for crc in table.rglob(".*.crc"):
        crc.unlink()
    result = jobs.copy_tree(spark, str(source), str(card), options, checkpoint_table=str(table))
    assert {(row.path, row.status) for row in result.outcomes.collect()} == {("src/a", "COPIED")}


def test_a_bad_device_stops_the_copy_before_it_begins(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a").write_text("a")
    monkeypatch.setattr(fingerprint, "same_fingerprint", lambda written, read_back: False)
    with pytest.raises(fingerprint.VerificationError):
        jobs.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "card"), QUICK)
    assert copied(tmp_path / "card") == {}


def test_large_folders_are_listed_in_shares_by_several_tasks(spark, tmp_path, monkeypatch):
    names = {f"a/f{n}" for n in range(40)} | {f"a/d{n}/g" for n in range(3)} | {f"b{n}/f" for n in range(9)} | {"café"}
    for name in names:
        (tmp_path / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / name).write_text(name)
    monkeypatch.setattr(filetree, "ONE_SHARE", 10)
    monkeypatch.setattr(filetree, "ENTRY_BUDGET", 4)
    rows = filetree.scan_all(spark, str(tmp_path / "top"))
    assert sorted(r.path for r in rows.collect()) == sorted(names | {"a", "a/d0", "a/d1", "a/d2"} | {f"b{n}" for n in range(9)})
    assert set(rows.columns) == set(filetree.list_directories(spark.createDataFrame([("", str(tmp_path))], "path string, abs_path string")).columns)
    share = [{"path": "a", "abs_path": str(tmp_path / "top" / "a")}]
    walked = list(filetree._walk(pa.RecordBatch.from_pylist(share), 0, None, True))
    assert {r["kind"] for r in walked} == {"share"} and len(walked) == filetree.SHARES  # nothing of it is left to this task


def test_leftovers_are_deleted_by_several_tasks(spark, tmp_path):
    files = [(f"f{n}", str(tmp_path / f"f{n}")) for n in range(50)]
    for _, place in files:
        open(place, "w").close()
    one = spark.createDataFrame(files, "path string, abs_path string").coalesce(1)
    report = copying.delete_files(one)
    assert {r.path for r in report.filter("deleted").collect()} == {p for p, _ in files}
    assert len(report.inputFiles()) > 1 and os.listdir(tmp_path) == []


def test_files_written_ahead_end_as_if_copied_one_by_one(tmp_path, monkeypatch):
    for n in range(6):
        (tmp_path / f"s{n}").write_bytes(b"x" * n)
    work = [{"path": f"p{n}", "abs_path": str(tmp_path / f"s{n}"), "size": n} for n in range(6)]
    share = copying._Share(str(tmp_path / "out"), 1, QUICK, False)
    again = [*work[:3], work[1], {"path": "gone", "abs_path": str(tmp_path / "none"), "size": 1}, *work[3:]]
    rows = [row for _, row in share.copy_all(again)]
    assert [(r["path"], r["status"], r["attempts"]) for r in rows] == [(f["path"], *(("FAILED", QUICK.max_retries) if f["path"] == "gone" else ("COPIED", 1))) for f in again]
    assert sorted(os.listdir(tmp_path / "out")) == [f"p{n}" for n in range(6)]
    # files written ahead when the device fails leave nothing behind
    attempt, full = copying._attempt, copying.AttemptFailed("DestinationWrite", OSError(errno.ENOSPC, "full"))

    def filling(source, *rest):
        if source.endswith("s2"):
            raise full
        return attempt(source, *rest)

    monkeypatch.setattr(copying, "_attempt", filling)
    share = copying._Share(str(tmp_path / "full"), 1, QUICK, False)
    assert [row["status"] for _, row in share.copy_all(work)] == ["COPIED", "COPIED", "FAILED", "STOPPED", "STOPPED", "STOPPED"]
    assert sorted(os.listdir(tmp_path / "full")) == ["p0", "p1"]


def test_reports_come_back_with_their_names_and_the_last_of_a_name_stays(spark, tmp_path):
    rows = [(f"a/{n}", 1, 5, f"r{n}") for n in range(30)] + [("a/7", 2, 5, "later"), ("café + b", 3, 6, None)]
    failures = spark.createDataFrame(rows, "source_relative string, attempts int, unix_time long, reason string").coalesce(1)
    reports = writers.write_quarantine(failures, str(tmp_path))
    assert reports.count() == 32 and len(reports.inputFiles()) > 1
    back = {r.source_relative: (r.attempts, r.unix_time, r.reason, r.report_name) for r in readers.read_quarantine(spark, str(tmp_path)).collect()}
    assert back["a/7"] == (2, 5, "later", "a__7.5.failed.json") and back["café + b"] == (3, 6, None, "café + b.6.failed.json")
    assert len(back) == 31 == len(os.listdir(tmp_path / ".quarantine"))


def test_reports_are_pushed_to_the_device_together_and_listed_without_a_look_at_each(tmp_path, monkeypatch):
    synced, every = [], stores._sync_all
    monkeypatch.setattr(stores, "_sync_all", lambda folder: synced.append(sorted(os.listdir(tmp_path))) or 0)
    monkeypatch.setattr(stores, "sync_file", lambda location: synced.append(location))
    names = [f"r{n}.failed.json" for n in range(600)]
    writers._write_together(str(tmp_path), f"{tmp_path}/.t", names, names)
    # one request while all are written and none has its name
    assert len(synced) == 1 and len(synced[0]) == 600 and all(name.startswith(".t") for name in synced[0])
    assert sorted(os.listdir(tmp_path)) == sorted(names) and (tmp_path / names[7]).read_text() == names[7] + "\n"
    synced.clear()
    monkeypatch.setattr(stores, "_sync_all", None)
    stores.sync_files([f"{tmp_path}/{name}" for name in names])
    assert synced == [f"{tmp_path}/{name}" for name in names]
    if every:
        monkeypatch.setattr(stores, "_sync_all", lambda folder: -1)
        with pytest.raises(OSError):
            stores.sync_files([f"{tmp_path}/{names[0]}"])
    (tmp_path / "folder").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / names[0])
    assert sorted(stores.file_names(str(tmp_path), lambda name: name != names[0])) == sorted(names[1:])
    with pytest.raises(FileNotFoundError):
        list(stores.file_names(f"{tmp_path}/none", bool))
