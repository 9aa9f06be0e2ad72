"""Runs that are stopped, tables that change in part, and what runs cost."""

import glob
import json
import os
import subprocess
import sys
import textwrap
import time

import pytest

from termsieve.operators import evaluate, jobs, storage
from termsieve.sources import eventlog

F = evaluate.F


def slow(spark, seconds):
    """Rows that take their time."""

    def run(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(40, numPartitions=40).mapInArrow(run, "id long")


def test_a_run_that_is_stopped_leaves_nothing(spark, tmp_path):
    path, began = str(tmp_path / "findings"), time.time()
    assert jobs.run_job(spark, 7, lambda: slow(spark, 6), path, lambda: time.time() > began + 3, poll=0.2) == "cancelled"
    assert time.time() - began < 25 and not glob.glob(f"{path}/*")
    assert jobs.run_job(spark, 8, lambda: spark.range(5), path, lambda: False) == "completed"
    assert jobs.run_job(spark, 8, lambda: spark.range(6), path, lambda: False) == "completed"
    assert [(r.run_id, r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()] == [(8, 6)]
    # Asked for only after the work was done: it does not count either, and what was stored stays.
    assert jobs.run_job(spark, 8, lambda: spark.range(9), path, lambda: True) == "cancelled"
    assert spark.read.parquet(path).count() == 6


def test_jobs_started_after_the_request_are_stopped_too(spark, tmp_path):
    done = []

    def work():
        for k in range(3):
            try:
                slow(spark, 6).count()
            except Exception:
                done.append(k)
        return spark.range(1)

    began = time.time()
    assert jobs.run_job(spark, 9, work, str(tmp_path / "f"), lambda: time.time() > began + 2, poll=0.2) == "cancelled"
    assert done == [0, 1, 2]


def test_an_error_of_a_run_is_raised(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        jobs.run_job(spark, 1, lambda: 1 / 0, str(tmp_path / "f"), lambda: False)
    assert not glob.glob(str(tmp_path / "f" / "*"))


def test_upsert_writes_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    storage.upsert(rows, path, "k", buckets=16)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    assert len(before) == 16
    storage.upsert(spark.createDataFrame([(5, "new"), (5000, "more")], "k long, v string"), path, "k", buckets=16)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    assert len(after) == 16 and len(set(before) - set(after)) in (1, 2) and all(after[f] == before[f] for f in set(before) & set(after))
    got = {r.k: r.v for r in storage.upserted(spark, path).collect()}
    assert len(got) == 1001 == storage.upserted(spark, path).count() and {k for k, v in got.items() if v != "old"} == {5, 5000}
    storage.upsert(rows.limit(0), path, "k", buckets=16)
    assert storage.upserted(spark, path).count() == 1001


def test_costs_of_runs_from_the_event_log(spark, tmp_path):
    """A session of its own writes a log; the jobs of two runs and of none are in it."""
    log = tmp_path / "log"
    log.mkdir()
    script = f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession
        from termsieve.operators import jobs
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://{log}").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        for run in (3, 12):
            jobs.run_job(s, run, lambda: s.range(run * 1000).selectExpr("id % 10 AS g").groupBy("g").count(), {str(tmp_path / "out")!r}, lambda: False)
        s.range(10).count()
        s.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, timeout=240, capture_output=True)
    got = {r.run_id: r for r in eventlog.run_metrics(spark, str(log)).collect()}
    assert set(got) == {3, 12}
    for r in got.values():
        assert r.jobs >= 1 and r.failed_jobs == 0 and r.tasks >= 2 and 0 < r.cpu_s < 60 and 0 < r.runtime_s < 120 and r.shuffled > 0
    with open(log / "local-9", "w") as f:
        start = {"Event": "SparkListenerJobStart", "Job ID": 900, "Submission Time": 5000, "Stage IDs": [901, 902], "Properties": {"spark.job.tags": f"x,{jobs.TAG}44,y"}}
        for line in (start, *({"Event": "SparkListenerTaskEnd", "Stage ID": 901, "Task Info": {"Failed": k == 1}, "Task Metrics": {"Executor CPU Time": 10**9}, "Task Executor Metrics": {"JVMHeapMemory": 9, "ProcessTreeJVMRSSMemory": k * 10**8, "ProcessTreePythonRSSMemory": 10**7}} for k in range(4))):
            f.write(json.dumps(line, separators=(",", ":")) + "\n")
        f.write('{"Event":"SparkListenerTaskEnd","Stage I')  # a line that is cut off
    got = {r.run_id: r for r in eventlog.run_metrics(spark, str(log)).collect()}
    # A job that has no end in the log failed; its memory is that of the largest process tree.
    assert set(got) == {3, 12, 44} and (got[44].failed_jobs, got[44].tasks, got[44].failed_tasks, got[44].cpu_s, got[44].peak_rss_mb) == (1, 4, 1, 4.0, 310.0)
