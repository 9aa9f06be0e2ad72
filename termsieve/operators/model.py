"""Requests to a text model as a Spark step: answers and a log of every attempt from one pass, in rounds that are kept.

requests: key, stage and what the model function needs. A round deals at most lanes * per_round requests that have no answer
yet to `lanes` tasks and appends what they give to a folder, a row an attempt; the next round leaves out what is there by
an anti-join on the key. So an answer that is stored is never asked for again, in this run or in a later one; if an executor is
lost, only requests of its unfinished task are. A task has its share of the rate, and the rounds stop before
the day's limit, whatever fails.

The model is any function of a request and the settings; it returns the text of its answer with token counts, or raises
Refused. A request that no attempt can mend keeps its error in the log and is asked again by the next run only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import children

# Seconds before each new attempt, statuses of a service that is busy, lines of a transcription.
DELAYS = (2, 4, 8, 16)
BUSY = (429, 500, 502, 503, 504)
MOST_LINES = 200
#: What ends a step, beside that nothing is left to ask.
LIMIT, GONE = "limit", "unavailable"

ATTEMPTS = "key string, stage string, attempt int, ok boolean, answer string, error string, gone boolean, input_tokens long, output_tokens long, latency_ms long, run string, created_at timestamp"
_FIELDS = [f.split()[0] for f in ATTEMPTS.split(", ")]
_SCHEMA = pa.schema(
    [("key", pa.string()), ("stage", pa.string()), ("attempt", pa.int32()), ("ok", pa.bool_()), ("answer", pa.string()), ("error", pa.string()), ("gone", pa.bool_()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("latency_ms", pa.int64()), ("run", pa.string()), ("created_at", pa.timestamp("us", tz="UTC"))]
)


@dataclass(frozen=True)
class Settings:
    """What is asked for: the same answer every time, as JSON of `schema` (DDL), without thinking where a model can."""

    model: str
    schema: str
    temperature: float = 0.0
    think: bool = False
    max_output_tokens: int = 1024


@dataclass(frozen=True)
class Said:
    """thinking: tokens that are billed as output though they are no part of the answer."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    thinking: int = 0


class Refused(Exception):
    """status: of the service, None if it was not reached. key: whether it is the access key that was refused."""

    def __init__(self, message: str, status: int | None = None, key: bool = False):
        super().__init__(message)
        self.status, self.key = status, key

    def __reduce__(self):
        return Refused, (str(self), self.status, self.key)


#: (request, settings) to what the model said.
Model = Callable[[dict, Settings], Said]


@dataclass
class Lane:
    """One task's requests: apart, tried again while the service is busy, `budget` attempts in all. clock and sleep can be
    given for tests."""

    model: Model
    settings: Settings
    apart: float
    budget: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free_at: float = float("-inf")

    def _once(self, request: dict) -> dict:
        """The row of one attempt, made when the lane is free; `again`: whether another one may help."""
        self.sleep(max(0.0, self.free_at - self.clock()))
        began = self.clock()
        self.free_at = began + self.apart
        row = dict.fromkeys(_FIELDS) | {"ok": False, "gone": False, "again": False, "input_tokens": 0, "output_tokens": 0}
        try:
            said = self.model(request, self.settings)
            row |= {"ok": True, "answer": said.text, "input_tokens": said.input_tokens, "output_tokens": said.output_tokens + said.thinking}
        except Refused as e:
            row |= {"error": str(e) if e.status is None else f"HTTP {e.status}: {e}", "gone": e.key or e.status is None, "again": not e.key and (e.status is None or e.status in BUSY)}
        return row | {"latency_ms": round(1000 * (self.clock() - began))}

    def attempts(self, request: dict) -> Iterator[dict]:
        for number, wait in enumerate((0, *DELAYS), 1):
            if not self.budget:
                return
            self.budget -= 1
            self.sleep(wait)
            row = self._once(request)
            yield row | {"key": request["key"], "stage": request["stage"], "attempt": number}
            if not row["again"]:
                return


class Log:
    """The attempts kept in a folder, a round appended at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        if not children(self.spark, self.path):
            return self.spark.createDataFrame([], ATTEMPTS)
        return self.spark.read.schema(ATTEMPTS).parquet(self.path)

    def calls(self) -> DataFrame:
        """A row for every attempt, as `plans.report.usage` takes them."""
        return self.rows().drop("answer", "gone", "run")

    def answers(self, schema: str) -> DataFrame:
        """(key, answer) of those whose answer has the form that was asked for: an object with no field missing."""
        said = self.rows().where("ok").select("key", readable("answer", schema).alias("answer"))
        return said.where("answer IS NOT NULL").groupBy("key").agg(F.any_value("answer").alias("answer"))

    def bad_answers(self, schema: str) -> DataFrame:
        """(key, answer): the beginning of what has not that form."""
        return self.rows().where(F.col("ok") & readable("answer", schema).isNull()).select("key", F.substring("answer", 1, 300).alias("answer"))


#: What a field of a type is in JSON.
_IN_JSON = {"string": "STRING", "array": "ARRAY", "struct": "OBJECT", "int": "BIGINT", "long": "BIGINT", "bigint": "BIGINT", "boolean": "BOOLEAN"}


def readable(answer: str, schema: str) -> Column:
    """The answer as a struct; null where it is no object, or a field is missing or of another kind."""
    got, said, whole = F.from_json(answer, schema), F.try_parse_json(answer), F.lit(True)
    for field in StructType.fromDDL(schema).fields:
        kind = _IN_JSON.get(field.dataType.simpleString().partition("<")[0])
        whole = whole & got[field.name].isNotNull()
        if kind:
            whole = whole & F.startswith(F.schema_of_variant(F.try_variant_get(said, f"$.{field.name}", "variant")), F.lit(kind))
    return F.when(whole, got)


def ask_all(
    requests: DataFrame, model: Model, settings: Settings, path: str, lanes: int = 4, per_round: int = 20, per_minute: float = 60, per_day: int = 2000, used_today: int = 0, sleep: Callable[[float], None] = time.sleep
) -> str | None:
    """Asks what has no answer yet, in order of the key; None when all was asked, else what ended it (LIMIT, GONE).

    requests: key (different for each), stage, and any columns for the model. used_today: attempts of today that the folder
    does not know of.
    """
    spark, log, run_id, names = requests.sparkSession, Log(requests.sparkSession, path), uuid.uuid4().hex, requests.columns
    today = F.col("created_at") >= F.date_trunc("day", F.current_timestamp())

    def lane_of(left: int):
        def run(batches):
            number = TaskContext.get().partitionId()
            lane = Lane(model, settings, 60 * lanes / per_minute, left // lanes + (number < left % lanes), sleep=sleep)
            for batch in batches:
                for request in batch.to_pylist():
                    rows = [row | {"run": run_id, "created_at": datetime.now(timezone.utc)} for row in lane.attempts(request)]
                    yield pa.RecordBatch.from_pylist([{f: r[f] for f in _FIELDS} for r in rows], schema=_SCHEMA)
                    if not rows or rows[-1]["gone"]:
                        return  # the others of this task stay for later

        return run

    while True:
        rows = log.rows()
        left = per_day - used_today - rows.where(today).count()
        pending = requests.join(rows.where(F.col("ok") | (F.col("run") == run_id)).select("key").distinct(), "key", "left_anti")
        mine = rows.where(F.col("run") == run_id).groupBy("key").agg(F.max("ok").alias("ok"), F.max("gone").alias("gone"))
        if not mine.where("gone AND NOT ok").isEmpty():
            return GONE
        if pending.isEmpty():
            return None
        if left <= 0:
            return LIMIT
        some = pending.orderBy("key").limit(min(left, lanes * per_round)).repartitionByRange(lanes, "key")
        some.select(*names).mapInArrow(lane_of(left), ATTEMPTS).write.mode("append").parquet(log.path)


def lines_of_images(log: Log) -> DataFrame:
    """(key, pos, text): the lines of transcribed images, without empty ones, MOST_LINES at most."""
    said = log.answers("lines array<string>").select("key", F.transform("answer.lines", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias("lines"))
    return said.select("key", F.posexplode(F.slice(F.filter("lines", lambda x: x != ""), 1, MOST_LINES)).alias("pos", "text"))


def paused(step: Callable[[], dict]) -> dict:
    """The result of a step of a run; what fails in it is said in `error`, and the run goes on without it."""
    try:
        return {"enabled": True} | step()
    except Exception as e:  # noqa: BLE001  only this step is over
        return {"enabled": True, "error": f"{type(e).__name__}: {e}"}
