"""The life of runs as tables: starting, progress, cancelling, finishing, and what a lost worker leaves behind.

runs: run_id, status, total, done, message, started_at, finished_at, cancel_requested. Every step is a projection of the
table; `plans.report.latest_wins` stores what it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.state import TERMINAL

LOST = "The worker stopped during this run"


def _where(runs: DataFrame, which: Column, **new: Column) -> DataFrame:
    return runs.withColumns({name: F.when(which, value).otherwise(F.col(name)) for name, value in new.items()})


def _ended() -> Column:
    return F.col("status").isin(*TERMINAL)


def started(runs: DataFrame, which: Column, total: Column, now: Column) -> DataFrame:
    """Marks runs as running from nothing done. A run that has ended, as one cancelled in the queue, stays as it is."""
    return _where(runs, which & ~_ended(), status=F.lit("running"), total=total, done=F.lit(0).cast("long"), started_at=now)


def progressed(runs: DataFrame, which: Column, done: Column, message: Column) -> DataFrame:
    """Takes over progress of running runs; one whose cancellation is asked for becomes cancelled instead."""
    live, asked = which & (F.col("status") == "running"), F.coalesce("cancel_requested", F.lit(False))
    return _where(_where(runs, live & ~asked, done=done, message=message), live & asked, status=F.lit("cancelled"))


def finished(runs: DataFrame, which: Column, status: str, now: Column) -> DataFrame:
    """Ends runs that have not ended."""
    if status not in TERMINAL:
        raise ValueError(f"{status} does not end a run")
    return _where(runs, which & ~_ended(), status=F.lit(status), finished_at=now)


def interrupted(runs: DataFrame, now: Column) -> DataFrame:
    """What a new worker does first: runs still running belong to one that is gone."""
    return _where(runs, F.col("status") == "running", message=F.lit(LOST), finished_at=now, status=F.lit("interrupted"))


def cancel_requested(runs: DataFrame, which: Column, now: Column) -> DataFrame:
    """A queued run is cancelled at once; a running one is asked to stop, which its next progress sees."""
    out = _where(runs, which & (F.col("status") == "running"), cancel_requested=F.lit(True))
    return _where(out, which & (F.col("status") == "queued"), finished_at=now, status=F.lit("cancelled"))
