"""Runs as Spark jobs that can be stopped: every job of a run bears its tag, and its output counts only if the run ended well."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import exists, move, remove

#: Before the id of a run in the tag of its jobs.
TAG = "termsieve-run-"


def run_job(spark: SparkSession, run_id: int, work: Callable[[], DataFrame], path: str, asked: Callable[[], bool], poll: float = 0.5) -> str:
    """Writes what the work gives to `path`/run_id=<id> in place of what was there: 'completed'. When `asked` says so, its
    jobs are interrupted and nothing is left: 'cancelled'. An error of the work is raised, and leaves nothing either.

    The work may run any number of jobs; those that it starts after the request are interrupted as well. asked: for
    instance whether the row of the run in the table of runs has cancel_requested.
    """
    tag, staging = f"{TAG}{run_id}", f"{path.rstrip('/')}/_staging-{run_id}-{uuid.uuid4().hex}"  # a name that readers skip
    context, failed = spark.sparkContext, []

    def go() -> None:
        context.addJobTag(tag)  # of this thread's jobs
        context.setInterruptOnCancel(True)
        try:
            work().write.parquet(staging)
        except BaseException as e:  # noqa: BLE001  said by the thread that waits
            failed.append(e)
        finally:
            context.removeJobTag(tag)

    thread, stop = threading.Thread(target=go, daemon=True), False
    thread.start()
    while thread.is_alive():
        thread.join(poll)
        stop = stop or asked()
        if stop:
            context.cancelJobsWithTag(tag)
    if stop or failed or asked():
        if exists(spark, staging):
            remove(spark, staging)
        if stop or not failed:
            return "cancelled"
        raise failed[0]
    place = f"{path.rstrip('/')}/run_id={run_id}"
    if exists(spark, place):
        remove(spark, place)
    move(spark, staging, place)
    return "completed"
