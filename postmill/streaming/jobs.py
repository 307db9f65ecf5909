"""Recognition jobs: one pure reducer of messages to states, for streams and for the replay of a log.

Messages have job_id and type, and by type: start (total, at_ms), stage (stage, progress, at_ms, current_image,
durations), result (image_index, status, text, duration_ms, current, total), control (status: what was asked
for), pause, finish (status, error, duration_ms, at_ms, durations). A job is there from its start to its finish;
other messages without a job are ignored, and the state goes with the finish.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from postmill.session import materialise

RECOGNISING = "recognizing-images"
ENDED = ("completed", "error", "canceled")
#: A state as columns; results are by image, the last one of an image holds.
COLUMNS = "status string, current long, total long, progress int, stage string, stage_started_ms long, current_image long, started_ms long, durations map<string,long>, results map<string,struct<status:string,text:string,duration_ms:long>>, error string, duration_ms long, applied long"
#: What the state of a stream holds of a job besides its results; life is the seq of the start that it began with.
JOB = "life long, applied long, status string, current long, total long, progress int, stage string, stage_started_ms long, current_image long, started_ms long, durations map<string,long>, error string, duration_ms long, n_results long"
JOB_FIELDS = [f.split()[0] for f in JOB.split(", ")]
RESULT = "status string, text string, duration_ms long"
RESULT_FIELDS = RESULT.replace(" ", ":").replace(",:", ",")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def begun(message: dict) -> dict:
    return {"status": "running", "current": 0, "total": message.get("total") or 0, "progress": 0, "stage": "", "started_ms": message.get("at_ms"), "durations": {}, "n_results": 0, "applied": 1}


def clamped(progress: float) -> int:
    return int(min(100, max(0, progress)))


def step(job: dict | None, message: dict, is_new: Callable[[int], bool]) -> tuple[dict | None, dict | None]:
    """The job after a message, the same object where nothing changes, and the result that the message brings.

    A job is all but its results, of which it has the number; is_new tells whether an image has none yet. So a message
    costs the same however many results there are. Stages set the progress, results never lower it.
    """
    kind = message["type"]
    if job is None:
        return (begun(message) if kind == "start" else None), None
    new = {**job, "applied": job["applied"] + 1}
    if kind == "finish":
        status = "canceled" if job["status"] == "canceled" else message["status"]
        spent = message.get("duration_ms")
        if spent is None and message.get("at_ms") is not None and job.get("started_ms") is not None:
            spent = max(0, message["at_ms"] - job["started_ms"])
        done = status == "completed"
        new |= {"status": status, "error": None if status == "canceled" else message.get("error"), "current": job["total"] if done else job["current"], "progress": 100 if done else job["progress"]}
        return new | {"duration_ms": spent, "durations": job["durations"] | (message.get("durations") or {})}, None
    if job["status"] in ENDED:
        return job, None
    if kind == "stage":
        if message["stage"] == job["stage"] == RECOGNISING:  # progress inside recognition comes from results
            return job, None
        progress = message.get("progress")
        new |= {"stage": message["stage"], "progress": job["progress"] if progress is None else clamped(progress), "stage_started_ms": message.get("at_ms"), "current_image": message.get("current_image")}
        return new | {"durations": job["durations"] | (message.get("durations") or {})}, None
    if kind == "result":
        n = job["n_results"] + is_new(message["image_index"])
        total = message.get("total") or job["total"]
        current = message["current"] if message.get("current") is not None else n
        reached = 50 + math.floor(min(current, total) / max(1, total) * 45 + 0.5)
        new |= {"n_results": n, "total": total, "current": current, "stage": RECOGNISING, "progress": max(job["progress"], reached)}
        return new, {k: message.get(k) for k in ("status", "text", "duration_ms")}
    if kind == "control":
        return new | {"status": message["status"]}, None
    if kind == "pause" and job["status"] == "pausing":
        return new | {"status": "paused"}, None
    return job, None


def advance(state: dict | None, message: dict) -> dict | None:
    """The state, a job with its results by image, after a message; the same object where nothing changes."""
    results = state["results"] if state else {}
    job, found = step(state, message, lambda image: str(image) not in results)
    if job is state or job is None:
        return state
    return {**job, "results": results if found is None else results | {str(message["image_index"]): found}}


def as_messages(messages: DataFrame, order: list[str]) -> DataFrame:
    """job_id, the order's columns and each message as JSON, so that columns that are null or missing look alike."""
    return messages.select("job_id", *order, F.to_json(F.struct(*(c for c in messages.columns if c not in ("job_id", *order)))).alias("message"))


def as_columns(states: DataFrame) -> DataFrame:
    rows = states.withColumn("state", F.from_json("state", COLUMNS)).select("job_id", "state.*")
    return rows.withColumn("results", F.transform_keys("results", lambda k, v: k.cast("int")))


def replay(messages: DataFrame, order: list[str]) -> DataFrame:
    """The last state of every job of a log, in the given order. A job's messages are read one by one, never held together."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, job, last, results = None, None, None, {}
        for frame in batches:
            out = []
            for own, message in zip(frame["job_id"], frame["message"], strict=True):
                if own != name:
                    if last:
                        out.append((name, json.dumps({**last, "results": results})))
                    name, job, last, results = own, None, None, {}
                parsed = json.loads(message)
                if job is None and parsed["type"] == "start":
                    results = {}
                job, found = step(job, parsed, lambda image, held=results: str(image) not in held)
                if found:
                    results[str(parsed["image_index"])] = found
                last = job or last
                if job and parsed["type"] == "finish":
                    job = None
            yield pd.DataFrame(out, columns=["job_id", "state"])
        if last:
            yield pd.DataFrame([(name, json.dumps({**last, "results": results}))], columns=["job_id", "state"])

    rows = as_messages(messages, order).repartition("job_id").sortWithinPartitions("job_id", *order).select("job_id", "message")
    return as_columns(rows.mapInPandas(fold, f"job_id {messages.schema['job_id'].dataType.simpleString()}, state string"))


class Jobs(StatefulProcessor):
    """Typed state of every job: one value, and a map of its results by image. A batch reads and writes the value once
    and those results that its messages touch, so its cost doesn't grow with what a job already has."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.results = handle.getMapState("results", "image_index int", RESULT)
        self.alarm = handle.getValueState("alarm", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        job = dict(zip(JOB_FIELDS, self.job.get(), strict=True)) if self.job.exists() else None
        if job:
            job["durations"] = dict(job["durations"] or ())
        touched: dict[int, dict] = {}
        changed = cleared = False
        for row in sorted(rows, key=lambda r: r["seq"]):
            message = json.loads(row["message"])
            before = job
            job, found = step(job, message, lambda image, cleared=cleared: image not in touched and (cleared or not self.results.containsKey((image,))))
            if before is None and job:
                job["life"] = row["seq"]
            if found:
                touched[message["image_index"]] = found
            changed |= job is not before
            if before and job and message["type"] == "finish":
                yield self.row(key, job, True, touched)
                self.forget()
                job, touched, changed, cleared = None, {}, False, True
        if job and changed:
            self.job.update(tuple(job.get(f) for f in JOB_FIELDS))
            for image, found in touched.items():
                self.results.updateValue((image,), tuple(found[f] for f in ("status", "text", "duration_ms")))
            yield self.row(key, job, False, touched)
        if job and self.idle_ms:
            self.postpone(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.alarm.clear()
        self.forget()
        return iter(())

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        """A job as held_jobs() returns it."""
        job = initialState.asDict(recursive=True)
        job["durations"] = dict(job["durations"] or ())
        self.job.update(tuple(job[f] for f in JOB_FIELDS))
        for image, found in dict(job["results"] or ()).items():
            self.results.updateValue((image,), tuple(found[f] for f in ("status", "text", "duration_ms")))
        if self.idle_ms:
            self.postpone(timerValues)

    def forget(self) -> None:
        self.job.clear()
        self.results.clear()
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
            self.alarm.clear()

    def postpone(self, timers: TimerValues) -> None:
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
        at = timers.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def row(self, key: tuple, job: dict, ended: bool, touched: dict[int, dict]) -> Row:
        found = {image: Row(**x) for image, x in touched.items()}
        return Row(job_id=key[0], **{f: job.get(f) for f in JOB_FIELDS}, ended=ended, touched=found)


def with_rocks(spark: SparkSession) -> None:
    """Typed state needs the store that has column families; a session that names another one is left alone and fails clearly."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


def reduce_stream(messages: DataFrame, idle: str | None = "30 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Changes of jobs after every batch of messages with an order `seq`: job_id, what a job is now, whether it ended, and
    the results that the batch touched. A finished job's state goes; one that stays silent for `idle` is forgotten, too.

    A batch's messages come in any order, batches in that of seq. `initial` holds jobs as held_jobs() returns
    them, for a stream that goes on where another one stopped. latest() makes states of the changes.
    """
    with_rocks(messages.sparkSession)
    kind = messages.schema["job_id"].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    changes = f"job_id {kind}, {JOB}, ended boolean, touched map<int,struct<{RESULT_FIELDS}>>"
    rows = as_messages(messages, ["seq"])  # Python reads a row field by field, so few fields
    return rows.groupBy("job_id").transformWithState(Jobs(idle_ms), changes, "Append", "ProcessingTime" if idle_ms else "None", initial and initial.groupBy("job_id"))


def latest(changes: DataFrame) -> DataFrame:
    """The last state of every job, like replay(), from all changes of a stream. Aggregates with map-side combining; a
    job's results come together in its own row only."""
    now = F.struct("life", "applied")
    jobs = changes.groupBy("job_id").agg(F.max_by(F.struct(*JOB_FIELDS), now).alias("job")).select("job_id", "job.*")
    each = changes.select("job_id", "life", "applied", F.explode("touched").alias("image", "result"))
    each = each.groupBy("job_id", "life", "image").agg(F.max_by("result", "applied").alias("result"))
    held = each.groupBy("job_id", "life").agg(F.map_from_entries(F.collect_list(F.struct("image", "result"))).alias("results"))
    return jobs.join(held, ["job_id", "life"], "left").withColumn("results", F.coalesce("results", F.create_map().cast(f"map<int,struct<{RESULT_FIELDS}>>")))


def held_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A variable of a stopped stream's state, read from its checkpoint as a table."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def held_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live jobs of a stopped stream: job_id, what a job is, and its results by image."""
    jobs = held_state(spark, checkpoint, "job").select(F.col("key.job_id").alias("job_id"), "value.*")
    found = held_state(spark, checkpoint, "results").select(F.col("key.job_id").alias("job_id"), F.struct("user_map_key.image_index", F.col("user_map_value").alias("result")).alias("entry"))
    found = found.groupBy("job_id").agg(F.map_from_entries(F.collect_list("entry")).alias("results"))
    return jobs.join(found, "job_id", "left")


def append_segments(messages: DataFrame, path: str, key: str, order: str, segments: int) -> None:
    """A log as files that a stream reads in order: segments by ranges of `order`, appended one after the other, in
    each of which all messages of a key stand in one file, so that no batch may end between two of them."""
    rows = materialise(messages, "log")  # read several times
    cuts = [] if segments < 2 else sorted(set(rows.approxQuantile(order, [k / segments for k in range(1, segments)], 0.01)))
    part = sum((F.when(F.col(order) >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        rows.where(part == k).repartition(key).write.mode("append").parquet(path)
    if not rows.head(1):
        rows.sparkSession.createDataFrame([], messages.schema).write.mode("append").parquet(path)


def run_to_end(changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that its source has and returns all that it ever wrote to the folder."""
    run = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return changes.sparkSession.read.schema(changes.schema).parquet(path)
