"""Queries that keep state: streams over logs of events in segments, restarts from stored state, stored tables."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import export, state
from postmill.plans.queries import SQL, job_messages, query, shown_states
from postmill.session import scratch, table
from postmill.streaming import jobs, queue

SEGMENTS = 3


def as_stream(messages: DataFrame, key: str, segments: int = SEGMENTS) -> DataFrame:
    """Messages with an order `seq`, put into a log of segments and read back as a stream."""
    path = scratch(messages.sparkSession, "log")
    jobs.append_segments(messages, path, key, "seq", segments)
    return messages.sparkSession.readStream.schema(messages.schema).option("maxFilesPerTrigger", 16).parquet(path)


@query(SQL["job_latest_state"])
def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What job_latest_state replays, as a stream of several batches with typed state."""
    messages = job_messages(spark, sf_dir).withColumnRenamed("event_id", "seq").drop("ts")
    changes = jobs.reduce_stream(as_stream(messages, "job_id"), idle=None)
    return shown_states(jobs.latest(jobs.run_to_end(changes, scratch(spark, "changes"), scratch(spark, "checkpoint"))))


# --- the batch queue ------------------------------------------------------------------------------
JOBS = [("j0", "completed", None, False), ("j1", "running", None, True), ("j2", "error", "E2", False)]


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as those of a task: batches of up to 23 addresses of three notes, some with a foreign one."""
    e, k = F.col("event_id"), F.col("event_id") % 32
    block = F.floor(e / 32).cast("long")
    kind = F.when(k.isin(0, 31), "batch").when(k <= 6, "opened").when(k <= 12, "extracted").when(k <= 15, "progress").when(k <= 19, "finished").when(k <= 27, "exported").when(k <= 29, "failed").otherwise("stop")
    foreign = lambda i: (e % 10 == 0) & (i == 3)
    url = lambda i: F.when(foreign(i), F.lit("https://foreign.example.org/x")).otherwise(F.concat(F.lit("https://www.xiaohongshu.com/explore/n"), (i % 3).cast("string"), F.lit("?v="), i.cast("string")))
    numbers = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(23).cast("long")), lambda i: i <= block % 24)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        (2 * e).alias("seq"),
        kind.alias("type"),
        F.transform(numbers, url).alias("urls"),
        (e % 3 > 0).alias("with_ocr"),
        F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 20).alias("at_ms"),
        F.concat(F.lit("n"), (block % 3).cast("string")).alias("note_id"),
        (e % 7).alias("n_images"),
        F.when(e % 11 == 0, "range-invalid").alias("selection_error"),
        F.concat(F.lit("j"), (block % 4).cast("string")).alias("job_id"),
        (e % 90).cast("int").alias("progress"),
        F.when(e % 2 == 0, "completed").otherwise("error").alias("status"),
        F.when(e % 3 == 0, "E").alias("error"),
        F.when(e % 5 == 0, "skipped").when(e % 5 == 1, "error:FULL").otherwise("write").alias("outcome"),
        F.concat(F.lit("f"), e.cast("string")).alias("filename"),
    )


def history_sql(restart: bool) -> str:
    """The queue as a fold over each task's numbered events; `restart` puts one after the first half, with what is known of the jobs."""
    again = "union all select user_id, 2 * (select max(event_id) // 2 from events) + 1, 'resume', 0, false, 0, '', 0, null, '', 0, '', null, '', null from events where event_id <= (select max(event_id) // 2 from events) group by 1" if restart else ""
    return f"""with recursive v as (
  select user_id as task_id, 2 * event_id as seq, case when event_id % 32 in (0, 31) then 'batch' when event_id % 32 <= 6 then 'opened' when event_id % 32 <= 12 then 'extracted' when event_id % 32 <= 15 then 'progress'
      when event_id % 32 <= 19 then 'finished' when event_id % 32 <= 27 then 'exported' when event_id % 32 <= 29 then 'failed' else 'stop' end as type,
    event_id // 32 % 24 as n_urls, event_id % 3 > 0 as e_ocr, epoch_us(ts) // 1000 // 20 as at_ms, 'n' || (event_id // 32 % 3) as e_note, event_id % 7 as n_images, case when event_id % 11 = 0 then 'range-invalid' end as sel,
    'j' || (event_id // 32 % 4) as e_job, event_id % 90 as e_progress, case when event_id % 2 = 0 then 'completed' else 'error' end as e_status, case when event_id % 3 = 0 then 'E' end as e_error,
    case event_id % 5 when 0 then 'skipped' when 1 then 'error:FULL' else 'write' end as outcome, 'f' || event_id as filename from events {again}),
e as (select *, row_number() over (partition by task_id order by seq) as k, seq % 20 = 0 and n_urls >= 3 as strange from v),
r as (
  select distinct task_id, 0::bigint as k, 0::bigint as seq, false as running, 0::bigint as n, 0::bigint as cur, '' as status, false as stop, false as ocr, null::varchar as job, 0::bigint as progress, 0::bigint as began,
    []::struct(i bigint, status varchar, error varchar, filename varchar, progress bigint)[] as made from e
  union all
  select task_id, k, seq, case when act = 'start' then true when closes then false else running end, case when act = 'start' then n_new else n end, case when opens then target else cur end,
    case when opens then 'opening' when act = 'put' then to_status else status end, case when act = 'start' then false when act = 'stop' then true else stop end, case when act = 'start' then e_ocr else ocr end,
    case when opens or closes then null when act = 'put' and to_status = 'ocr' and type = 'extracted' then e_job else job end,
    case when opens then 2 when closes then 100 when act in ('put', 'tell') then to_progress else progress end, case when act = 'start' then at_ms else began end,
    list_concat(case when act = 'reject' then [{{'i': null, 'status': 'rejected', 'error': rejected, 'filename': null, 'progress': case when running then progress end}}]
        when act = 'start' then [{{'i': null, 'status': 'started', 'error': null, 'filename': null, 'progress': 0}}]
        when act in ('put', 'end') then [{{'i': cur, 'status': to_status, 'error': to_error, 'filename': to_file, 'progress': case when act = 'end' then 0 else to_progress end}}] else [] end,
      case when opens then [{{'i': target, 'status': 'opening', 'error': null, 'filename': null, 'progress': 2}}] else [] end,
      case when closes then list_transform(range(target, n), lambda x: {{'i': x, 'status': 'canceled', 'error': null, 'filename': null, 'progress': 0}}) else [] end,
      case when closes then [{{'i': null, 'status': 'finished', 'error': null, 'filename': null, 'progress': case when stop then 0 else 100 end}}] else [] end)
  from (
    select *, act = 'start' or (act = 'end' and not stop and target < n) as opens, act = 'end' and (stop or target >= n) as closes from (
      select *, case when act = 'start' then 0 when to_status = 'queued' then cur else cur + 1 end as target from (
        select *, least(n_urls, 3) as n_new,
          case when type = 'batch' then case when rejected is null then 'start' else 'reject' end when not running then 'none' when type = 'stop' then 'stop' when type = 'failed' then 'end'
            when type = 'resume' then case when status = 'ocr' and job in ('j0', 'j1') then 'put' else 'end' end
            when type = 'opened' and status = 'opening' then 'put'
            when type = 'extracted' and status = 'extracting' then case when e_note <> 'n' || ((cur + 1) % 3) or n_images = 0 or (ocr and sel is not null) then 'end' else 'put' end
            when type = 'progress' and status = 'ocr' and e_job = job then 'tell'
            when type = 'finished' and status = 'ocr' and e_job = job then case when e_status = 'completed' then 'put' else 'end' end
            when type = 'exported' and status = 'exporting' then 'end' else 'none' end as act,
          case when type = 'failed' then 'error' when type = 'opened' then 'extracting' when type = 'extracted' then case when e_note <> 'n' || ((cur + 1) % 3) or n_images = 0 or (ocr and sel is not null) then 'error' when ocr then 'ocr' else 'exporting' end
            when type = 'finished' then case when e_status = 'completed' then 'exporting' else 'error' end when type = 'exported' then case outcome when 'skipped' then 'skipped' when 'write' then 'completed' else 'error' end
            when type = 'resume' then case when status <> 'ocr' then case when stop then 'canceled' else 'queued' end when job = 'j0' then 'exporting' when job = 'j1' then 'ocr' else 'error' end end as to_status,
          case when type = 'failed' then e_error when type = 'extracted' then case when e_note <> 'n' || ((cur + 1) % 3) then 'TITLE_MISMATCH' when n_images = 0 then 'NO_IMAGES' when ocr and sel is not null then 'OCR_SELECTION:' || sel end
            when type = 'finished' and e_status <> 'completed' then coalesce(e_error, 'OCR_FAILED') when type = 'exported' then case outcome when 'skipped' then 'DUPLICATE' when 'error:FULL' then 'FULL' end
            when type = 'resume' and status = 'ocr' then case job when 'j2' then 'E2' when 'j3' then 'OCR_INTERRUPTED' end end as to_error,
          case when type = 'exported' and outcome in ('skipped', 'write') then filename end as to_file,
          case when type in ('opened') then 15 when type = 'extracted' then case when ocr then 5 else 92 end when type = 'finished' then 98 when type = 'resume' then progress else e_progress end as to_progress
        from (
          select r.task_id, e.k, e.seq, running, n, cur, r.status, stop, ocr, job, progress, began, e.* exclude (task_id, k, seq),
            case when running and at_ms - began < 1800000 then 'BUSY' when n_urls > 20 then 'BATCH_LIMIT' when n_urls = 0 or strange then 'SELECTION_EMPTY' end as rejected
          from r join e on e.task_id = r.task_id and e.k = r.k + 1)))))
select task_id, seq, step, x.i as "index", case when x.i is not null then 'n' || ((x.i + 1) % 3) end as note_id, x.status, x.error, x.filename, x.progress
from (select task_id, seq, unnest(range(0, len(made))) as step, unnest(made) as x from r)"""


@query(history_sql(False))
def batch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of all items of the batches that the events tell of."""
    made = queue.run_queue(as_stream(queue_events(spark, sf_dir), "task_id"))
    return jobs.run_to_end(made, scratch(spark, "history"), scratch(spark, "checkpoint"))


@query(history_sql(True))
def restarted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a stream that ends after half of the events and one that goes on from its stored state."""
    events = queue_events(spark, sf_dir)
    half = 2 * (events.agg(F.max("seq")).first()[0] // 4) if events.head(1) else 0
    checkpoint = scratch(spark, "checkpoint")
    first = jobs.run_to_end(queue.run_queue(as_stream(events.where(F.col("seq") <= half), "task_id")), scratch(spark, "history"), checkpoint)
    known = spark.createDataFrame(JOBS, "job_id string, status string, error string, alive boolean")
    held = queue.recovered(queue.held_tasks(spark, checkpoint), known)
    resume = held.select("task_id", F.lit(half + 1).cast("long").alias("seq"), F.lit("resume").alias("type"))
    rest = events.where(F.col("seq") > half).unionByName(resume, allowMissingColumns=True)
    second = jobs.run_to_end(queue.run_queue(as_stream(rest, "task_id"), held), scratch(spark, "history"), scratch(spark, "checkpoint"))
    return first.unionByName(second)


# --- stored tables --------------------------------------------------------------------------------
def in_parts(rows: DataFrame, number: str, parts: int = 3) -> list[DataFrame]:
    """Rows in the order of a number, as parts of about the same size."""
    cuts = rows.approxQuantile(number, [k / parts for k in range(1, parts)], 0.05) or [0.0] * (parts - 1)
    edges = [float("-inf"), *cuts, float("inf")]
    return [rows.where((F.col(number) > low) & (F.col(number) <= high)) for low, high in pairwise(edges)]


@query(SQL["history_upsert"])
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What history_upsert makes of all events at once, stored in parts with a compaction between."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    order = [(-F.unix_micros(F.col("ts").cast("timestamp"))).alias("late"), (-F.col("event_id")).alias("id")]
    store = export.history_store(spark, scratch(spark, "history"), rows.schema, ["user_id", "event_type"], order)
    for k, part in enumerate(in_parts(rows, "event_id")):
        store.append(part)
        if k == 1:
            store.compact()
    return store.read().drop("ts")


@query(SQL["state_table"])
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What state_table makes of all events at once, stored in parts and compacted after each."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("id"), "value", (F.col("event_type") == "error").alias("cleared"), "ts", "event_id")
    store = state.state_store(spark, scratch(spark, "state"), log.schema, ["ts", "event_id"])
    for part in in_parts(log, "event_id"):
        store.append(part)
        store.compact()
    return store.read().select("key", "id", "value")
