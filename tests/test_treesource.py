"""File trees as a data source."""

import os
import time

import pytest
from pyspark.sql import functions as F

from assay.sources import filetree, stores, treesource


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "photos"
    for n in range(60):
        place = root / f"d{n % 5}" / f"e{n % 3}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{n}").write_bytes(b"x" * n)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "dep.js").write_bytes(b"j")
    (root / ".hidden").write_bytes(b"")
    (root / "link").symlink_to(root / ".hidden")
    return root


def entries(frame):
    return sorted((r.path, r.abs_path, r.kind, r.size, r.mtime, r.scan_error) for r in frame.filter("kind = 'file'").collect())


@pytest.mark.parametrize("tasks", ["1", "4", "32"])
def test_same_rows_as_the_listing_in_rounds(spark, tree, tasks):
    assert entries(treesource.read_tree(spark, str(tree), tasks=tasks)) == entries(filetree.scan_tree(spark, str(tree)))
    bare = treesource.read_tree(spark, str(tree), tasks=tasks, includeRoot="false", skipJunk="basic")
    assert entries(bare) == entries(filetree.scan_without_root(spark, str(tree), skip_junk="basic"))
    kinds = dict(treesource.read_tree(spark, str(tree), tasks=tasks).groupBy("kind").count().collect())
    assert kinds == {"file": 62, "dir": 21, "link": 1}


def test_one_file_and_none(spark, tree, tmp_path):
    assert [(r.path, r.size) for r in treesource.read_tree(spark, str(tree / "d0" / "e0" / "f30")).collect()] == [("f30", 30)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert treesource.read_tree(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="No such file"):
        treesource.read_tree(spark, str(tmp_path / "missing")).count()


def test_conditions_reach_the_listing(spark, tree, monkeypatch):
    for condition, expected in (("startswith(path, 'photos/d1/')", 12), ("path = 'photos/d2/e2/f2'", 1), ("size >= 50 AND size < 53", 3), ("size > 58", 1)):
        frame = treesource.read_tree(spark, str(tree)).filter("kind = 'file'").filter(condition)
        assert frame.count() == expected
    reader = treesource.TreeReader({"path": str(tree)})
    wanted = treesource.StringStartsWith(("path",), "photos/d1/e2/")
    left = list(reader.pushFilters([wanted, treesource.EqualTo(("scan_error",), "x")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    opened, plain = [], stores.list_dir
    monkeypatch.setattr(stores, "list_dir", lambda location, *a: opened.append(location) or plain(location, *a))
    rows = [row for p in reader.partitions() for batch in reader.read(p) for row in batch.to_pylist()]
    assert {r["path"].rpartition("/")[0] for r in rows} == {"photos/d1/e2"}
    assert {o.removeprefix(str(tree)) for o in opened} == {"", "/d1", "/d1/e2"}


def test_wide_directories_are_shared_out(spark, tmp_path, monkeypatch):
    for n in range(500):
        (tmp_path / f"n{n}").write_bytes(b"")
    reader = treesource.TreeReader({"path": str(tmp_path), "recursive": "false", "includeRoot": "false"})
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert len(parts) == treesource.SHARES and sum(sizes) == 500 and max(sizes) < 120
    assert filetree.scan_flat(spark, str(tmp_path)).count() == 500


def test_a_stream_has_each_new_file_once(spark, tree, tmp_path):
    target, place = str(tmp_path / "out"), str(tmp_path / "offsets")

    def run():
        time.sleep(0.4)
        feed = treesource.stream_tree(spark, str(tree), settleSeconds="0.2").select("path", "size")
        feed.writeStream.format("parquet").option("path", target).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path for r in spark.read.parquet(target).collect())

    first = run()
    assert len(first) == 62 and len(set(first)) == 62
    old = tree / "d0" / "moved"
    (tmp_path / "outside").write_bytes(b"y")
    os.utime(tmp_path / "outside", (1_000_000_000, 1_000_000_000))
    os.rename(tmp_path / "outside", old)  # keeps its old modification time
    (tree / "d9").mkdir()
    (tree / "d9" / "new").write_bytes(b"z")
    assert run() == sorted([*first, "photos/d0/moved", "photos/d9/new"])
    assert len(run()) == 64
