"""Every registered query against its SQL on the smallest given tables."""

import pytest
from compare import connect, duckdb_rows, spark_rows

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, duck, name):
    ours = spark_rows(queries()[name](spark, FOLDER))
    sql = oracle_sql().get(name)
    if sql is None:
        assert ours[1]
    else:
        assert ours == duckdb_rows(duck, sql)


def test_xxh3_query_matches_the_package(spark):
    from xxhash import xxh3_128_hexdigest

    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    for doc_id, digest in queries()["xxh3_128_hex"](spark, FOLDER).collect():
        assert digest == xxh3_128_hexdigest(texts[doc_id].encode())


def test_doubled_work_of_ids_beyond_the_range(spark, tmp_path):
    top, unit = 2**63 - 1, 922337203685477
    spark.createDataFrame([(1,), (4999,), (5001,), (10_001,), (600_000,), (None,)], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    works = {r.event_id: r.work for r in queries()["doubled_work"](spark, str(tmp_path)).collect()}
    assert works == {1: 2 * unit, 4999: 9998 * unit, 5001: top, 10_001: top, 600_000: top, None: None}


def test_entry_is_one_summary_row(spark):
    assert entry(spark).count() == 1


def test_queries_run_from_any_folder(tmp_path):
    """Workers get the package even when the session was started elsewhere without it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
         .config('spark.checkpoint.dir', 'file://{tmp_path}/scratch').getOrCreate())
from __spark_entry__ import queries
print(queries()['parse_ignore_rule'](spark, {FOLDER!r}).count(), queries()['scan_tree'](spark, {FOLDER!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["104", "200"], done.stderr[-2000:]
