"""Keyed state of jobs and of the batch queue: constant cost, restarts from stored state, steps of a batch."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.streaming import jobs, queue

LOG = "job_id string, seq long, type string, stage string, image_index int, total long, progress int, status string, text string, at_ms long"


def job_log(spark, n):
    """A job of n results (each image twice), one that finishes and starts again, one that never ends."""
    rows = [("big", 0, "start", None, None, n, None, None, None, 10)]
    rows += [("big", 1 + i, "result", None, i % (n // 2), n, None, "success", f"t{i}", None) for i in range(n)]
    rows += [("twice", 5, "start", None, None, 2, None, None, None, 1), ("twice", 6, "result", None, 0, 2, None, "empty", "a", None), ("twice", 7, "finish", None, None, None, None, "completed", None, 9)]
    rows += [("twice", 8, "result", None, 1, 2, None, "late", "b", None), ("twice", n // 2, "start", None, None, 3, None, None, None, 70), ("twice", n // 2 + 1, "result", None, 2, 3, None, "success", "c", None)]
    rows += [("open", 9, "start", None, None, 4, None, None, None, 2), ("open", n - 1, "stage", "recognizing-images", None, None, 30, None, None, 3), ("open", n, "result", None, 1, 4, None, "success", "d", None)]
    return spark.createDataFrame(rows, LOG)


def shown(states):
    return {r.job_id: (r.status, r.current, r.total, r.progress, r.stage, r.applied, r.duration_ms, {k: tuple(v) for k, v in r.results.items()}) for r in states.collect()}


def stream_of(spark, log, path, segments, files=4):
    jobs.append_segments(log, path, "job_id", "seq", segments)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(path)


def test_ten_thousand_results_cost_the_same_to_the_end(spark, tmp_path):
    log = job_log(spark, 10_000)
    stream = jobs.reduce_stream(stream_of(spark, log, str(tmp_path / "log"), 10, 1), idle=None)
    changes = jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert shown(jobs.latest(changes)) == shown(jobs.replay(log, ["seq"]))
    sizes = [r.n for r in changes.where("job_id = 'big'").select(F.size("touched").alias("n"), "applied").orderBy("applied").collect()]
    assert len(sizes) >= 8 and max(sizes) <= 1500  # a batch hands on what it touched, not what there is
    progress = sorted(tmp_path.joinpath("out").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    assert max(f.stat().st_size for f in progress) < 100_000


def test_jobs_go_on_from_stored_state(spark, tmp_path):
    log = job_log(spark, 400)
    first = jobs.run_to_end(jobs.reduce_stream(stream_of(spark, log.where("seq < 150"), str(tmp_path / "a"), 2), idle=None), str(tmp_path / "out1"), str(tmp_path / "check1"))
    held = jobs.held_jobs(spark, str(tmp_path / "check1"))
    assert {(r.job_id, r.n_results, len(r.results or {})) for r in held.collect()} == {("big", 149, 149), ("open", 0, 0)}
    second = jobs.run_to_end(jobs.reduce_stream(stream_of(spark, log.where("seq >= 150"), str(tmp_path / "b"), 2), idle=None, initial=held), str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert shown(jobs.latest(first.unionByName(second))) == shown(jobs.replay(log, ["seq"]))


def test_a_stream_stopped_between_batches_repeats_and_loses_nothing(spark, tmp_path):
    log, path = job_log(spark, 400), str(tmp_path / "log")
    for low, high in ((0, 100), (100, 250), (250, 500)):  # each run of the same query finds a longer log
        jobs.append_segments(log.where((F.col("seq") >= low) & (F.col("seq") < high)), path, "job_id", "seq", 1)
        changes = jobs.run_to_end(jobs.reduce_stream(spark.readStream.schema(log.schema).parquet(path), idle=None), str(tmp_path / "out"), str(tmp_path / "check"))
    assert shown(jobs.latest(changes)) == shown(jobs.replay(log, ["seq"]))
    assert changes.groupBy("job_id", "life", "applied").count().where("count > 1").count() == 0


def test_an_empty_log_is_a_stream(spark, tmp_path):
    none = job_log(spark, 10).where("seq < 0")
    changes = jobs.run_to_end(jobs.reduce_stream(stream_of(spark, none, str(tmp_path / "log"), 3), idle=None), str(tmp_path / "out"), str(tmp_path / "check"))
    assert jobs.latest(changes).collect() == []


def test_few_fields_go_to_python(spark, tmp_path):
    log = job_log(spark, 10)
    log.write.parquet(str(tmp_path / "log"))
    read = lambda df: spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    events = log.select(F.col("job_id").alias("task_id"), "seq", "type", F.array("text").alias("urls"), *(F.lit(None).cast("string").alias(k) for k in ("note_id", "job_id", "status", "error", "outcome", "filename")))
    for made in (jobs.reduce_stream(read(log)), queue.run_queue(read(events))):
        assert made._jdf.queryExecution().analyzed().children().head().output().size() <= 4


# --- the queue ------------------------------------------------------------------------------------
EVENT = {k: None for k in ("items", "with_ocr", "at_ms", "note_id", "n_images", "selection_error", "job_id", "progress", "status", "error", "outcome", "filename")}


def items(*ids):
    return [{"url": f"u{i}-{n}", "note_id": i} for n, i in enumerate(ids)]


def told(*events):
    batch, rows = queue.Batch(None, []), []
    for seq, (kind, more) in enumerate(events):
        batch.rows = []
        batch.take({**EVENT, "seq": seq, "type": kind, **more})
        rows += [(r["index"], r["status"], r["error"], r["progress"]) for r in batch.rows]
    return batch, rows


def test_one_item_at_a_time():
    done = [("opened", {}), ("extracted", {"note_id": "a", "n_images": 1}), ("exported", {"outcome": "write", "filename": "f.md"})]
    batch, rows = told(("batch", {"items": items("a", "b", "a"), "at_ms": 0}), *done, ("exported", {"outcome": "write"}), ("opened", {}), ("extracted", {"note_id": "x", "n_images": 1}))
    assert rows == [(None, "started", None, 0), (0, "opening", None, 2), (0, "extracting", None, 15), (0, "exporting", None, 92), (0, "completed", None, 0), (1, "opening", None, 2), (1, "extracting", None, 15), (1, "error", "TITLE_MISMATCH", 0), (None, "finished", None, 100)]
    assert [item["url"] for item in batch.items] == ["ua-2", "ub-1"]  # at its first place, as it came last


def test_recognition_and_stop():
    _, rows = told(
        ("batch", {"items": items("a", "b", "c"), "with_ocr": True, "at_ms": 0}),
        ("opened", {}),
        ("extracted", {"note_id": "a", "n_images": 2, "job_id": "j"}),
        ("progress", {"job_id": "other", "progress": 77}),
        ("progress", {"job_id": "j", "progress": 60}),
        ("stop", {}),
        ("finished", {"job_id": "other", "status": "error"}),
        ("finished", {"job_id": "j", "status": "completed"}),
        ("exported", {"outcome": "skipped"}),
    )
    assert rows[3:] == [(0, "ocr", None, 5), (0, "exporting", None, 98), (0, "skipped", "DUPLICATE", 0), (1, "canceled", None, 0), (2, "canceled", None, 0), (None, "finished", None, 0)]


def test_limits_of_a_batch():
    many = items(*(f"n{i % 3}" for i in range(21)))
    assert told(("batch", {"items": many, "at_ms": 0}))[1] == [(None, "rejected", "BATCH_LIMIT", None)]  # counted before repeated notes go
    assert len(told(("batch", {"items": many[:20], "at_ms": 0}))[0].items) == 3
    for bad in ([], None, items("a", "")):
        assert told(("batch", {"items": bad, "at_ms": 0}))[1] == [(None, "rejected", "SELECTION_EMPTY", None)]
    minute = 60_000
    for later, second in ((29 * minute, "rejected"), (30 * minute, "started")):
        rows = told(("batch", {"items": items("a"), "at_ms": 0}), ("batch", {"items": items("b"), "at_ms": later}))[1]
        assert rows[2][1] == second
    assert told(("batch", {"items": items("a"), "at_ms": None}), ("batch", {"items": items("b"), "at_ms": 1}))[1][2] == (None, "rejected", "BUSY", 2)


@pytest.mark.parametrize("seed", range(20))
def test_every_item_ends_once(seed):
    rng = random.Random(seed)
    kinds = ("opened", "extracted", "exported", "finished", "failed", "stop", "progress", "resume", "batch")
    events = [("batch", {"items": items(*"abcdef"), "at_ms": 0, "with_ocr": seed % 2 > 0})]
    for _ in range(200):
        events.append((rng.choices(kinds, (9, 9, 9, 9, 1, 0.1, 3, 0, 0))[0], {"note_id": rng.choice("abcdef"), "n_images": rng.randrange(4), "job_id": "j", "status": rng.choice(("completed", "error")), "outcome": rng.choice(("write", "skipped", "error:X")), "progress": 50}))
    batch, rows = told(*events)
    ends = [r[0] for r in rows if r[1] in ("completed", "skipped", "error", "canceled")]
    assert ends == sorted(set(ends)) and not batch.task["running"] and len(ends) == 6
    assert [r for r in rows if r[0] is None][-1][1] == "finished"


def test_recovered_tasks(spark):
    item = lambda pos, status: (pos, f"u{pos}", f"n{pos}", status, None, None)
    schema = f"task_id string, {queue.TASK}, queue array<struct<{', '.join(f.replace(' ', ': ') for f in queue.ITEM.split(', '))}>>"
    cells = [("wait", "extracting", None, False), ("stopped", "opening", None, True), ("done", "ocr", "j-done", False), ("live", "ocr", "j-live", False), ("bad", "ocr", "j-bad", False), ("gone", "ocr", "j-gone", False), ("dead", "ocr", "j-dead", False)]
    tasks = spark.createDataFrame([(t, True, 0, 40, stop, True, job, 1, [item(0, s), item(1, "queued")]) for t, s, job, stop in cells], schema)
    known = spark.createDataFrame([("j-done", "completed", None, False), ("j-live", "running", None, True), ("j-bad", "error", "E", False), ("j-dead", "running", None, False)], "job_id string, status string, error string, alive boolean")
    got = {r.task_id: (r.queue[0].status, r.queue[0].error, r.job_id, r.queue[1].status) for r in queue.recovered(tasks, known).collect()}
    assert got == {
        "wait": ("queued", None, None, "queued"),
        "stopped": ("canceled", None, None, "queued"),
        "done": ("exporting", None, None, "queued"),
        "live": ("ocr", None, "j-live", "queued"),
        "bad": ("error", "E", None, "queued"),
        "gone": ("error", "OCR_INTERRUPTED", None, "queued"),
        "dead": ("error", "OCR_INTERRUPTED", None, "queued"),
    }
