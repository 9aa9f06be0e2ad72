"""What runs cost, from Spark's event log read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import TAG

#: The fields that are read, by the names that Spark writes.
EVENT = """`Event` string, `Job ID` long, `Stage IDs` array<long>, `Properties` map<string, string>, `Stage ID` long, `Submission Time` long, `Completion Time` long, `Job Result` struct<`Result`: string>,
`Task Info` struct<`Launch Time`: long, `Finish Time`: long, `Failed`: boolean, `Executor ID`: string>,
`Task Metrics` struct<`Executor CPU Time`: long, `Executor Run Time`: long, `JVM GC Time`: long, `Peak Execution Memory`: long, `Disk Bytes Spilled`: long, `Input Metrics`: struct<`Records Read`: long>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>>,
`Task Executor Metrics` struct<`JVMHeapMemory`: long, `JVMOffHeapMemory`: long, `ProcessTreeJVMRSSMemory`: long, `ProcessTreePythonRSSMemory`: long>"""


def events(spark: SparkSession, path: str) -> DataFrame:
    """(app, e): the events of jobs and tasks in a folder of logs, a row a line; lines that are cut off are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_\d+)?(?:\.inprogress|\.zstd|\.lz4)*$", 1).alias("app"))
    some = lines.where(F.rlike("value", F.lit(r'"Event":"SparkListener(JobStart|JobEnd|TaskEnd)"')))
    return some.select("app", F.from_json("value", EVENT).alias("e")).where("e.Event IS NOT NULL")


def run_metrics(spark: SparkSession, path: str, tag: str = TAG) -> DataFrame:
    """Per run: jobs (and how many of them failed or were interrupted), tasks, seconds from its first job's start to its last
    job's end, CPU seconds, seconds of garbage collection, the largest memory of an executor while it had a task of the run (in
    MB; of a process tree where the log has it, else of the JVM; null if its tasks were too short to be sampled), bytes shuffled and spilled, rows read.

    A run's jobs bear its tag. A stage is of the first job that names it, so what several jobs share counts once.
    """
    all_ = events(spark, path)
    started = all_.where("e.Event = 'SparkListenerJobStart'").select("app", F.col("e")["Job ID"].alias("job"), F.col("e")["Submission Time"].alias("began"), F.col("e")["Stage IDs"].alias("stages"), F.regexp_extract(F.col("e")["Properties"]["spark.job.tags"], tag + r"(\d+)", 1).alias("run"))
    jobs = started.where("run <> ''").withColumn("run_id", F.col("run").cast("long")).drop("run")
    ended = all_.where("e.Event = 'SparkListenerJobEnd'").select("app", F.col("e")["Job ID"].alias("job"), F.col("e")["Completion Time"].alias("ended"), (F.col("e")["Job Result"]["Result"] != "JobSucceeded").alias("failed"))
    of_job = jobs.join(ended, ["app", "job"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.coalesce("failed", F.lit(True))).alias("failed_jobs"), ((F.max("ended") - F.min("began")) / 1000).alias("runtime_s")
    )
    stages = jobs.select("app", "job", "run_id", F.explode("stages").alias("stage")).groupBy("app", "stage").agg(F.min_by("run_id", "job").alias("run_id"))
    tasks = all_.where("e.Event = 'SparkListenerTaskEnd'").select("app", F.col("e")["Stage ID"].alias("stage"), F.col("e")["Task Metrics"].alias("m"), F.col("e")["Task Executor Metrics"].alias("x"), F.col("e")["Task Info"]["Failed"].alias("failed"))
    tree, heap = F.col("x")["ProcessTreeJVMRSSMemory"] + F.col("x")["ProcessTreePythonRSSMemory"], F.col("x")["JVMHeapMemory"] + F.col("x")["JVMOffHeapMemory"]
    of_task = tasks.join(stages, ["app", "stage"]).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("failed").alias("failed_tasks"),
        (F.sum(F.col("m")["Executor CPU Time"]) / 1e9).alias("cpu_s"),
        (F.sum(F.col("m")["JVM GC Time"]) / 1000).alias("gc_s"),
        (F.nullif(F.max(F.when(tree > 0, tree).otherwise(heap)), F.lit(0)) / 1e6).alias("peak_rss_mb"),
        F.sum(F.col("m")["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffled"),
        F.sum(F.col("m")["Disk Bytes Spilled"]).alias("spilled"),
        F.sum(F.col("m")["Input Metrics"]["Records Read"]).alias("rows_read"),
    )
    return of_job.join(of_task, "run_id", "left")
