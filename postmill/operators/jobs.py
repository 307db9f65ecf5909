"""Jobs: status counts, estimates, stage durations, replay of message logs, queue transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "skipped", "error", "canceled")
LIVE = ("running", "pausing", "canceling")
#: Milliseconds that stages are assumed to take.
STAGE_MS = {"loading-runtime": 50, "loading-models": 150, "creating-sessions": 300, "finalizing": 100}
IMAGE_MS = 500
INITIAL = ("loading-runtime", "loading-models", "creating-sessions")


def status_counts(items: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    count = {s: F.count_if(F.col(status) == s).alias(n) for s, n in zip(TERMINAL, ("completed", "skipped", "failed", "canceled"), strict=True)}
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *count.values(), F.count_if(F.col(status).isin(*TERMINAL)).alias("terminal"))


def batch_eta(elapsed_ms: Column, terminal: Column, total: Column) -> Column:
    """Time left at the pace so far; null before anything is done, 0 at the end."""
    return F.when(terminal > 0, elapsed_ms / terminal * (total - terminal))


def average_image_ms(durations: Column) -> Column:
    fine = F.filter(durations, lambda d: d > 0)
    return F.when(F.size(fine) > 0, F.aggregate(fine, F.lit(0.0), lambda a, x: a + x) / F.size(fine)).otherwise(F.lit(float(IMAGE_MS)))


def initialization_ms(durations: Column) -> Column:
    out = F.lit(0).cast("long")
    for stage in INITIAL:
        out = out + F.coalesce(F.try_element_at(durations, F.lit(stage)), F.lit(0)).cast("long")
    return out


def live_durations(durations: Column, stage: Column, status: Column, started_ms: Column, now_ms: Column) -> Column:
    """Stage durations with the time that a live job has spent in its present stage."""
    more = F.greatest(F.lit(0).cast("long"), now_ms - F.coalesce(started_ms, now_ms))
    old = F.coalesce(durations, F.create_map().cast("map<string,bigint>"))
    grown = F.map_concat(F.map_filter(old, lambda k, v: k != stage), F.create_map(stage, F.coalesce(F.try_element_at(old, stage), F.lit(0).cast("long")) + more))
    return F.when(status.isin(*LIVE), grown).otherwise(old)


def remaining_ms(status: Column, stage: Column, stage_elapsed: Column, images_left: Column, average_ms: Column, image_elapsed: Column) -> Column:
    """Estimate by stage: what is left of it, all later stages, and the images; null while paused, 0 at the end."""
    zero = F.lit(0.0)
    images = F.greatest(zero, F.greatest(zero, images_left) * average_ms - F.when(stage == "recognizing-images", F.coalesce(image_elapsed, zero)).otherwise(zero))
    order = ["loading-runtime", "loading-models", "creating-sessions", "recognizing-images", "finalizing"]
    out = F.when(status == "paused", F.lit(None).cast("double")).when(~status.isin(*LIVE), zero)
    for i, name in enumerate(order):
        own = images if name == "recognizing-images" else F.greatest(zero, F.lit(float(STAGE_MS[name])) - F.greatest(zero, stage_elapsed))
        later = sum(STAGE_MS.get(x, 0) for x in order[i + 1 :])
        out = out.when(stage == name, own + later + (images if "recognizing-images" in order[i + 1 :] else zero))
    return out


def stage_durations(events: DataFrame, job: str, stage: str, ts_ms: str, order: list[str]) -> DataFrame:
    """Milliseconds per job and stage, counted at changes of stage; the last stage's run has no end yet."""
    over = Window.partitionBy(job).orderBy(*order)
    changes = events.withColumn("_before", F.lag(stage).over(over)).where(~F.col("_before").eqNullSafe(F.col(stage)))
    spans = changes.withColumn("_ms", F.lead(ts_ms).over(over) - F.col(ts_ms))
    return spans.groupBy(job, stage).agg(F.coalesce(F.sum("_ms"), F.lit(0).cast("long")).alias("duration_ms"))


def queue_head(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.where("status = 'queued'").groupBy(*keys).agg(F.min_by(F.struct(*[c for c in items.columns if c not in keys]), "pos").alias("r")).select(*keys, "r.*")


def patch_item(queue: Column, index: Column, **changes: Column) -> Column:
    """A queue (array of structs) with fields of the item at an index replaced; an index outside it changes nothing."""
    def patched(item: Column) -> Column:
        for name, value in changes.items():
            item = item.withField(name, value)
        return item

    return F.transform(queue, lambda item, i: F.when(i == index, patched(item)).otherwise(item))


def next_step(status: Column, valid_url: Column, same_id: Column, n_images: Column, with_ocr: Column, selection_error: Column, job_status: Column, export: Column) -> Column:
    """Status and error that an item comes to next: opening, extracting, then recognising where asked for, exporting, and
    what the export or the recognition ended with. Errors are those of an item; the rest of the queue goes on."""
    def moved(to: str, error: Column | None = None) -> Column:
        return F.struct(F.lit(to).alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error"))

    failed = (
        F.when(~same_id, "AUTO_CLIP_TITLE_MISMATCH")
        .when(n_images == 0, "AUTO_CLIP_NO_IMAGES")
        .when(with_ocr & selection_error.isNotNull(), F.concat(F.lit("AUTO_CLIP_OCR_SELECTION:"), selection_error))
    )
    return (
        F.when((status == "queued") & ~valid_url, moved("error", F.lit("AUTO_CLIP_URL_INVALID")))
        .when(status == "queued", moved("opening"))
        .when(status == "opening", moved("extracting"))
        .when((status == "extracting") & failed.isNotNull(), moved("error", failed))
        .when((status == "extracting") & with_ocr, moved("ocr"))
        .when(status == "extracting", moved("exporting"))
        .when((status == "ocr") & (job_status == "completed"), moved("exporting"))
        .when((status == "ocr") & job_status.isin("error", "canceled"), F.struct(job_status.alias("status"), F.lit(None).cast("string").alias("error")))
        .when((status == "exporting") & export.startswith("error:"), moved("error", F.substring(export, F.lit(7), F.length(export))))
        .when((status == "exporting") & (export == "skipped"), moved("skipped"))
        .when((status == "exporting") & export.isNotNull(), moved("completed"))
        .otherwise(F.struct(status.alias("status"), F.lit(None).cast("string").alias("error")))
    )


def panel_view(tasks: DataFrame, jobs: DataFrame, history: DataFrame) -> DataFrame:
    """What a panel shows of every task: tasks (task_id, running, output, current_index, progress, job_id, started_at,
    stop_requested, queue), the stage of its job (job_id, stage) and how many history entries there are by output (output, entries)."""
    stage = jobs.select("job_id", "stage")
    total = F.coalesce(F.size("queue"), F.lit(0))
    rows = tasks.join(stage, "job_id", "left").join(history, "output", "left")
    return rows.select("task_id", F.coalesce("running", F.lit(False)).alias("running"), "output", F.coalesce("current_index", F.lit(0)).alias("current_index"), F.greatest(F.lit(0), total).alias("total"), F.coalesce("progress", F.lit(0)).alias("progress"), "stage", "started_at", F.coalesce("stop_requested", F.lit(False)).alias("stop_requested"), "queue", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


def stop_gracefully(status: Column) -> Column:
    """Items after a stop: what waits is canceled, what runs goes on, what ended stays."""
    return F.when(status == "queued", "canceled").otherwise(status)


def lost_job(status: Column, job_status: Column, alive: Column) -> Column:
    """Whether an item waits for a job that is neither ended nor alive; a null job status is no job."""
    ended = F.coalesce(job_status.isin("completed", "error", "canceled"), F.lit(False))
    return (status == "ocr") & ~ended & ~(job_status.isNotNull() & alive)


def recover(status: Column, job_status: Column, alive: Column | None = None, stopped: Column | None = None) -> Column:
    """Items after a restart: interrupted work without a job waits again (once a stop was asked for it is canceled),
    a live job goes on, an ended job's item exports, and a lost job's item fails."""
    lost = lost_job(status, job_status, F.lit(True) if alive is None else alive)
    again = F.when(F.lit(False) if stopped is None else stopped, "canceled").otherwise("queued")
    return F.when(status.isin("opening", "extracting", "exporting"), again).when(lost, "error").when((status == "ocr") & (job_status == "completed"), "exporting").when((status == "ocr") & job_status.isin("error", "canceled"), job_status).otherwise(status)


def recover_error(status: Column, job_status: Column, alive: Column | None = None) -> Column:
    return F.when(lost_job(status, job_status, F.lit(True) if alive is None else alive), "OCR_INTERRUPTED")


def may_take_over(busy: Column, updated_at: Column, now: Column, minutes: int = 30) -> Column:
    """Whether a new batch may start: none runs, or it is at least so old; one of unknown age stays."""
    return ~busy | F.coalesce(updated_at <= now - F.expr(f"interval {minutes} minutes"), F.lit(False))


def active_only(items: DataFrame) -> DataFrame:
    return items.where("status <> 'completed'")


def queue_key(items: Column) -> Column:
    """What a view of the queue (array of url, title, status, error, filename) depends on, as one text."""
    def one(item: Column) -> Column:
        return F.concat_ws("\x1f", *(F.coalesce(item[c].cast("string"), F.lit("")) for c in ("url", "title", "status", "error", "filename")))

    return F.array_join(F.transform(items, one), "\x1e")
