import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import runs
from assay.schemas import PROGRESS_EVENT
from assay.streaming import breaker, checksum, progress

LOG = "run_id int, seq long, status string"


def feed(spark, folder, batches, schema, first=0):
    """One file per batch, in order, read one file at a time."""
    import os

    for number, rows in enumerate(batches, first):
        part = f"{folder}/staged-{number}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(part)
        os.makedirs(f"{folder}/in", exist_ok=True)
        source = next(f"{part}/{name}" for name in os.listdir(part) if name.endswith(".json"))
        os.utime(source, (1_600_000_000 + number, 1_600_000_000 + number))
        os.rename(source, f"{folder}/in/{number}.json")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def expected_stops(spark, rows, reset_on_skip=False):
    batch = runs.failure_circuit_breaker(spark.createDataFrame([r for r in rows if r[0] is not None], LOG), reset_on_skip=reset_on_skip)
    return {r.run_id: r.stop_position for r in batch.filter("stop_position IS NOT NULL").collect()}


@pytest.mark.parametrize("reset_on_skip", [False, True])
def test_breaker_across_batches_and_restarts(spark, tmp_path, reset_on_skip):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 1, 2, None]), n, rng.choices(["FAIL", "OK", "SKIP"], [6, 2, 2])[0]) for n in range(300)]
    rows += [(7, 400 + n, "FAIL") for n in range(9)]  # this run is cut between its third and fourth failure
    batches = [rows[:100], rows[100:303], rows[303:]]
    for batch in batches:
        rng.shuffle(batch)
    alerts, folder = [], str(tmp_path / "state")
    for n, some in ((0, batches[:2]), (2, batches[2:])):  # a new query: state and position come from the folder
        stream = feed(spark, str(tmp_path), some, LOG, first=n)
        query = breaker.stream_breaker(stream, folder, reset_on_skip=reset_on_skip, alert=lambda df: alerts.extend(df.collect()))
        query.awaitTermination()
        if n == 0:
            assert 7 not in {r.run_id for r in alerts}
    expected = expected_stops(spark, rows, reset_on_skip)
    assert {r.run_id: r.stop_position for r in breaker.tripped_runs(spark, folder).collect()} == expected
    assert expected[7] == 5 and len(alerts) == len(expected) == breaker.tripped_runs(spark, folder).count()


def test_breaker_stops_in_the_batch_it_happens(spark, tmp_path):
    rows = [(1, n, "FAIL") for n in range(12)]
    seen = []
    stream = feed(spark, str(tmp_path), [rows[:3], rows[3:6], rows[6:]], LOG)
    query = breaker.run_stops(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    query.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(1, 1, 5)]


def test_device_failure_stops_at_once():
    log = pd.DataFrame({"status": ["OK", "FAIL", "FAIL"], "error_class": [None, "FILE", "DEVICE"]})
    assert breaker.stop_of(log, 0, 5, False) == (3, 2)
    assert breaker.stop_of(log.iloc[1:2], 4, 5, False) == (1, 5)
    assert breaker.stop_of(log.iloc[:0], 2, 5, False) == (None, 2)


PROGRESS = PROGRESS_EVENT


def job_events(rng, n):
    kinds = ["TotalBytes", "BytesAdvanced", "BytesAdvanced", "CurrentFile", "Phase", "Log", "CooldownLeft"]
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        kind = rng.choice(kinds)
        ts = start + timedelta(milliseconds=130 * i + rng.randrange(100))
        rows.append((rng.choice("aab"), i, ts, kind, f"p{i}", rng.randint(0, 99) * (1 if i % 3 else 4), f"f{i}", "Info", f"m{i}"))
    return rows


def test_progress_across_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = job_events(rng, 240)
    batches = [rows[n : n + 50] for n in range(0, 240, 50)]
    for batch in batches:
        rng.shuffle(batch)
    updates, folder = [], str(tmp_path / "state")
    for first, some in ((0, batches[:2]), (2, batches[2:])):
        stream = feed(spark, str(tmp_path), some, PROGRESS, first=first)
        progress.progress_stream(stream, folder, keep_lines=4, report=lambda state: updates.append(state.count())).awaitTermination()
    got = {row.job_id: row for row in progress.current_state(spark, folder).collect()}
    rows.sort(key=lambda r: r[1])
    events = spark.createDataFrame(rows, PROGRESS)
    states = {row.job_id: row for row in runs.latest_state(events).collect()}
    totals = runs.running_progress(events).groupBy("job_id").agg(
        F.max_by(F.struct("total_bytes", "completed_bytes"), "seq").alias("t")
    )
    for job_id, t in totals.collect():
        row = got[job_id]
        assert (row.total_bytes, row.completed_bytes) == (t.total_bytes, t.completed_bytes)
        state = states[job_id]
        assert (row.phase, row.current_file, row.n_events) == (state.phase, state.current_file, state.n_events)
        assert row.log == [f"m{n}" for j, n, _, kind, *_ in rows if j == job_id and kind == "Log"][-4:]
    assert len(updates) == 5


def test_updates_on_phase_changes_or_after_a_second(spark, tmp_path):
    rng = random.Random(6)
    rows = job_events(rng, 200)
    expected, last, seen = [], {}, Counter()
    for job, n, ts, kind, *_ in rows:
        seen[job] += 1
        if kind == "Phase" or job not in last or ts - last[job] > timedelta(seconds=1):
            last[job] = ts
            expected.append((job, ts, kind == "Phase", seen[job]))
    folder = str(tmp_path / "state")
    for first, some in ((0, [rows[:70]]), (1, [rows[70:90], rows[90:]])):
        stream = feed(spark, str(tmp_path), some, PROGRESS, first=first)
        progress.throttled_updates(stream, folder, order=["seq"]).awaitTermination()
    got = progress.kept_rows(spark, folder).select("job_id", "at", "phase_changed", "n_events").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_silent_jobs_show_their_last_state_by_a_timer(spark, tmp_path):
    rows = [("a", n, None, "CurrentFile", None, None, f"f{n}", None, None) for n in range(3)]
    seen, folder = [], str(tmp_path / "state")
    stream = feed(spark, str(tmp_path), [rows[:1], rows[1:]], PROGRESS)
    query = progress.throttled_updates(stream, folder, order=["seq"], clock="processing", seconds=1, every="0.2 seconds", report=lambda df: seen.extend(df.collect()))
    try:
        deadline = time.time() + 60
        while time.time() < deadline and (not seen or seen[-1].current_file != "f2"):
            time.sleep(0.2)
    finally:
        query.stop()
    # the last event comes right after one that is shown, and nothing comes after it
    assert [r.current_file for r in seen] in (["f0", "f2"], ["f0", "f1", "f2"])
    assert all((b.at - a.at).total_seconds() > 1 for a, b in zip(seen, seen[1:]))


def test_manifest_stream_writes_each_path_once_even_when_restarted(spark, tmp_path):
    schema = "path string, payload string, size long"
    rows = [(f"p{n % 30}" if n % 3 else "hot", f"x{n}", 1) for n in range(300)]
    stream = feed(spark, str(tmp_path), [rows[:200], rows[200:]], schema)
    target = str(tmp_path / "manifest")
    checksum.stream_checksum(stream, target).awaitTermination()
    checksum.stream_checksum(stream, target).awaitTermination()
    written = spark.read.parquet(target)
    assert written.count() == written.select("path").distinct().count() == len({row[0] for row in rows})


def test_streams_keep_keyed_state_whatever_store_the_session_names(spark, tmp_path):
    setting, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, plain)
    try:
        rows = [(1, n, "FAIL") for n in range(4)], [(1, 4, "FAIL"), (2, 5, "OK")]
        breaker.stream_breaker(feed(spark, tmp_path, rows, LOG), str(tmp_path / "out")).awaitTermination()
        assert breaker.tripped_runs(spark, str(tmp_path / "out")).collect() == [(1, 5)]
        events = [("j", 1, "TotalBytes", 10), ("j", 2, "BytesAdvanced", 4)], [("j", 3, "BytesAdvanced", 5)]
        jobs = feed(spark, tmp_path / "jobs", events, "job_id string, seq long, kind string, bytes long")
        progress.progress_stream(jobs, str(tmp_path / "state")).awaitTermination()
        assert progress.current_state(spark, str(tmp_path / "state")).select("job_id", "total_bytes", "completed_bytes").collect() == [("j", 10, 9)]
        assert spark.conf.get(setting) == plain  # the session's own setting is left as it was
    finally:
        spark.conf.set(setting, before)


def test_larger_tables_are_streamed_in_more_files_not_larger_ones(spark, tmp_path, monkeypatch):
    from assay.queries import logs
    from assay.queries.registry import Tables
    from assay.queries.fixtures import source_entries

    docs = [(n, f"text {n}" * 50, "en", "web", 300) for n in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    t = Tables(spark, str(tmp_path))
    monkeypatch.setattr(logs, "FEED_BYTES", 2000)
    rows = logs._as_stream(t, source_entries(t), "payload-feed")
    done = rows.select("path").writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted(spark.table("streamed").toPandas()["path"]) == sorted(f"root/web/en/doc_{n}.txt" for n in range(400))
    batches = [p["sources"][0]["numInputRows"] for p in done.recentProgress if p["numInputRows"]]
    assert len(batches) == logs.MICRO_BATCHES
    files = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert logs.feed_files(files) > 4 and logs.feed_files(spark.range(1)) == 4
