"""The batch queue as a keyed reducer of events: one item of a batch at a time, from queued to its end.

Events have task_id, seq and type, and by type: batch (urls, with_ocr, at_ms), opened, extracted (note_id, n_images,
selection_error, job_id), progress (job_id, progress), finished (job_id, status, error), exported (outcome, filename),
failed (error), stop, resume. Each is taken only where it fits: what is said of another item or job than the present
one changes nothing. Ends of an item bring the next one; the last one's, or a stop, ends the batch.

The history has a row for every step: of an item its index, note_id, status, error and filename, of a batch (index
null) started, finished or rejected with its error. progress is the batch's after the step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from postmill.functions import names
from postmill.operators import jobs
from postmill.streaming.jobs import held_state, with_rocks

#: Items of a batch at most, and minutes after which a running batch gives way to a new one.
LIMIT, STALE_MINUTES = 20, 30
#: Progress of a batch when its item opens, is read, is recognised first, is exported with and without recognition.
OPENING, EXTRACTING, RECOGNISING, EXPORTING_RECOGNISED, EXPORTING = 2, 15, 5, 98, 92
TASK = "running boolean, current_index int, progress int, stop_requested boolean, with_ocr boolean, job_id string, started_ms long"
TASK_FIELDS = [f.split()[0] for f in TASK.split(", ")]
ITEM = "pos int, url string, note_id string, status string, error string, filename string"
ITEM_FIELDS = [f.split()[0] for f in ITEM.split(", ")]
HISTORY = "seq long, step int, index int, note_id string, status string, error string, filename string, progress int"


class Batch:
    """A task, its items and the rows that an event adds to the history."""

    def __init__(self, task: dict | None, items: list[dict]) -> None:
        self.task, self.items, self.rows = task, items, []

    def note(self, seq: int, index: int | None, **shown: str | None) -> None:
        self.rows.append({"seq": seq, "step": len(self.rows), "index": index, "note_id": None, "status": None, "error": None, "filename": None} | shown | {"progress": self.task["progress"] if self.task and self.task["running"] else None})

    def put(self, seq: int, index: int, progress: int, **changes: str | None) -> None:
        self.items[index] = self.items[index] | changes
        self.task["progress"] = progress
        self.note(seq, index, **{f: self.items[index][f] for f in ("note_id", "status", "error", "filename")})

    def go_on(self, seq: int) -> None:
        """Opens the next waiting item; without one, or once a stop was asked for, the batch ends."""
        task = self.task
        task["job_id"] = None
        waiting = [i for i, item in enumerate(self.items) if item["status"] == "queued"]
        if waiting and not task["stop_requested"]:
            task["current_index"] = waiting[0]
            self.put(seq, waiting[0], OPENING, status="opening")
            return
        for i in waiting:
            self.put(seq, i, task["progress"], status="canceled")
        task["progress"] = task["progress"] if task["stop_requested"] else 100
        self.note(seq, None, status="finished")
        task["running"] = False

    def end(self, seq: int, status: str, error: str | None = None, filename: str | None = None) -> None:
        self.put(seq, self.task["current_index"], 0, status=status, error=error, filename=filename)
        self.go_on(seq)

    def start(self, event: dict) -> None:
        """A batch of at most LIMIT items, counted before notes that come twice are taken once: at their first place, as they came last."""
        seq, now, old = event["seq"], event["at_ms"], self.task
        items = event["items"] or []
        unique = list({item["note_id"]: item for item in items}.values())
        error = None
        if old and old["running"] and (now is None or old["started_ms"] is None or now - old["started_ms"] < STALE_MINUTES * 60_000):
            error = "BUSY"
        elif len(items) > LIMIT:
            error = "BATCH_LIMIT"
        elif not unique or any(not item["note_id"] for item in unique):
            error = "SELECTION_EMPTY"
        if error:
            self.note(seq, None, status="rejected", error=error)
            return
        self.task = {"running": True, "current_index": 0, "progress": 0, "stop_requested": False, "with_ocr": bool(event["with_ocr"]), "job_id": None, "started_ms": now}
        self.items = [{"pos": pos, "url": item["url"], "note_id": item["note_id"], "status": "queued", "error": None, "filename": None} for pos, item in enumerate(unique)]
        self.note(seq, None, status="started")
        self.go_on(seq)

    def take(self, event: dict) -> None:
        kind, seq, task = event["type"], event["seq"], self.task
        if kind == "batch":
            self.start(event)
            return
        if not task or not task["running"]:
            return
        index = task["current_index"]
        status = self.items[index]["status"]
        if kind == "stop":
            task["stop_requested"] = True
        elif kind == "resume":
            waits = status in ("ocr", "exporting")  # for what its job or its export ends with
            self.put(seq, index, task["progress"] if waits else 0)
            if not waits:
                self.go_on(seq)
        elif kind == "failed":
            self.end(seq, "error", event["error"])
        elif kind == "opened" and status == "opening":
            self.put(seq, index, EXTRACTING, status="extracting")
        elif kind == "extracted" and status == "extracting":
            if event["note_id"] != self.items[index]["note_id"]:
                self.end(seq, "error", "TITLE_MISMATCH")
            elif not event["n_images"]:
                self.end(seq, "error", "NO_IMAGES")
            elif not task["with_ocr"]:
                self.put(seq, index, EXPORTING, status="exporting")
            elif event["selection_error"]:
                self.end(seq, "error", f"OCR_SELECTION:{event['selection_error']}")
            else:
                task["job_id"] = event["job_id"]
                self.put(seq, index, RECOGNISING, status="ocr")
        elif kind == "progress" and status == "ocr" and event["job_id"] == task["job_id"]:
            task["progress"] = event["progress"]
        elif kind == "finished" and status == "ocr" and event["job_id"] == task["job_id"]:
            if event["status"] == "completed":
                self.put(seq, index, EXPORTING_RECOGNISED, status="exporting")
            else:
                self.end(seq, "error", event["error"] or "OCR_FAILED")
        elif kind == "exported" and status == "exporting":
            outcome = event["outcome"] or ""
            if outcome.startswith("error:"):
                self.end(seq, "error", outcome.removeprefix("error:"))
            else:
                self.end(seq, "skipped" if outcome == "skipped" else "completed", "DUPLICATE" if outcome == "skipped" else None, event["filename"])


class Queue(StatefulProcessor):
    """State of every task: one value, and the list of its items, which a batch's limit bounds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", TASK)
        self.items = handle.getListState("items", ITEM)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        batch = Batch(None, [])
        if self.task.exists():
            batch = Batch(dict(zip(TASK_FIELDS, self.task.get(), strict=True)), [dict(zip(ITEM_FIELDS, item, strict=True)) for item in self.items.get()])
        for row in sorted(rows, key=lambda r: r["seq"]):
            batch.rows = []
            batch.take({"seq": row["seq"], **json.loads(row["event"])})
            for made in batch.rows:
                yield Row(task_id=key[0], **made)
        self.keep(batch.task, batch.items)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        """A task as held_tasks() returns it."""
        task = initialState.asDict(recursive=True)
        self.keep(task, task["queue"])

    def keep(self, task: dict | None, items: list[dict]) -> None:
        if task and task["running"]:
            self.task.update(tuple(task[f] for f in TASK_FIELDS))
            self.items.put([tuple(item[f] for f in ITEM_FIELDS) for item in items])
        else:
            self.task.clear()
            self.items.clear()


def with_items(events: DataFrame) -> DataFrame:
    """Events whose urls (array) are items with their note ids; an address of no note has an empty one."""
    items = F.transform("urls", lambda url: F.struct(url.alias("url"), F.coalesce(names.note_id(url), F.lit("")).alias("note_id")))
    return events.withColumn("items", items).drop("urls")


def run_queue(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """task_id and the history's columns of a stream of events (see above); a task that isn't running holds no state.

    A batch's events come in any order, batches in that of seq. `initial` holds tasks as recovered() returns them.
    """
    with_rocks(events.sparkSession)
    kind = events.schema["task_id"].dataType.simpleString()
    rows = with_items(events)
    told = F.to_json(F.struct(*(c for c in rows.columns if c not in ("task_id", "seq"))), {"ignoreNullFields": "false"})
    rows = rows.select("task_id", "seq", told.alias("event"))  # Python reads a row field by field, so few fields
    return rows.groupBy("task_id").transformWithState(Queue(), f"task_id {kind}, {HISTORY}", "Append", "None", initial and initial.groupBy("task_id"))


def held_tasks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The running tasks of a stopped stream: task_id, what a task is, and its queue (array of items)."""
    tasks = held_state(spark, checkpoint, "task").select(F.col("key.task_id").alias("task_id"), "value.*")
    items = held_state(spark, checkpoint, "items").select(F.col("key.task_id").alias("task_id"), F.col("list_element").alias("item"))
    return tasks.join(items.groupBy("task_id").agg(F.array_sort(F.collect_list("item")).alias("queue")), "task_id")


def recovered(tasks: DataFrame, job_states: DataFrame) -> DataFrame:
    """Running tasks (see held_tasks()) as they go on after a restart, by what is known of their jobs.

    job_states: job_id, status, error, alive. An interrupted item waits again, or is canceled once a stop was asked for; an
    item whose job ended is exported or fails with it, one whose job lives stays, and one whose job is lost fails. A
    stream that starts from the result (initial of run_queue()) goes on with an event "resume" for each task.
    """
    known = tasks.join(job_states.select("job_id", F.col("status").alias("job_status"), F.col("error").alias("job_error"), "alive"), "job_id", "left")
    status, alive, stopped = F.col("job_status"), F.coalesce("alive", F.lit(False)), F.col("stop_requested")

    def one(item: Column) -> Column:
        failed = (item["status"] == "ocr") & F.coalesce(status.isin("error", "canceled"), F.lit(False))
        error = F.when(failed, F.coalesce(F.nullif("job_error", F.lit("")), F.lit("OCR_FAILED"))).otherwise(F.coalesce(jobs.recover_error(item["status"], status, alive), item["error"]))
        return item.withField("error", error).withField("status", F.when(failed, "error").otherwise(jobs.recover(item["status"], status, alive, stopped)))

    waits = F.exists("queue", lambda item: item["status"] == "ocr")
    made = known.withColumn("queue", F.transform("queue", one)).withColumn("job_id", F.when(waits, F.col("job_id")))
    return made.select("task_id", *TASK_FIELDS, "queue")
