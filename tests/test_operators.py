import io
import json
import tarfile
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_paragraphs import joined, repaired
from pyspark.sql import functions as F

from postmill.functions import names as N
from postmill.functions import text as T
from postmill.operators import export, extract, jobs, lines, metrics, ranks, scan, state, vision
from postmill.operators.sessions import BATCH, THREADS, greedy, onnx_sessions, option
from postmill.sources.html import Selectors
from postmill.sources.packages import character_list, model_packages, tar_members
from postmill.streaming.jobs import advance, append_segments, held_jobs, latest, reduce_stream, replay, run_to_end

URL = "https://www.xiaohongshu.com/explore/abc123"


def page(notes: dict) -> str:
    return f"<html><script>window.__INITIAL_STATE__={json.dumps({'note': {'noteDetailMap': notes}}, ensure_ascii=False)}</script></html>"


VISIBLE = """
      <main class="note-content">
        <h1 class="title">DOM 标题</h1>
        <div id="detail-desc">DOM 正文 #城市</div>
        <div class="author-wrapper"><span class="name">DOM 作者</span></div>
        <div class="swiper-slide"><img src="https://sns-webpic-qc.xhscdn.com/dom.jpg"></div>
      </main>
"""
DOM = """
      <aside><a href="/user/profile/wrong"><span class="name">Wrong author</span></a></aside>
      <section class="note-detail-mask">
        <div class="media-container">
          <div class="swiper-slide"><img src="https://sns-webpic-qc.xhscdn.com/1.jpg"></div>
          <div class="swiper-slide swiper-slide-duplicate"><img src="https://sns-webpic-qc.xhscdn.com/1.jpg"></div>
          <div class="swiper-slide"><img src="https://sns-webpic-qc.xhscdn.com/2.jpg"></div>
        </div>
        <div class="author-wrapper">
          <a class="name" href="/user/profile/u-cmu">CMU Author</a>
        </div>
        <main class="note-content">
          <h1 id="detail-title">CMU title</h1>
          <div id="detail-desc">CMU body #CMU</div>
          <div class="bottom-container"><span class="date">06-26</span></div>
        </main>
        <div class="interact-container">
          <span class="like-wrapper"><span class="count">186</span></span>
          <span class="collect-wrapper"><span class="count">121</span></span>
          <span class="chat-wrapper"><span class="count">11</span></span>
        </div>
      </section>
"""
LAZY = """<head><title>Shown | 小红书</title><meta name="description" content="meta body"></head><div id="noteContainer">
<div class="note-scroller"><div class="content">scrolled<br>body</div><span class="publish-time">2026/07/26</span></div>
<div class="author"><img src="/me.png"><span class="name">An author</span></div>
<div class="carousel"><img src="data:image/gif;base64,R0" data-src="//sns-img.xhscdn.com/lazy.jpg"><img src="https://elsewhere.example/x.jpg"><div class="avatar"><img src="https://sns-img.xhscdn.com/face.jpg"></div></div>
<a class="tag" href="#">#city</a><div class="engage-bar-style"><span class="share-wrapper"><i class="count">7</i></span></div></div>"""


def test_document_source(spark):
    rows = [(0, URL, VISIBLE), (1, URL, DOM), (2, URL, LAZY)]
    got = [r.data for r in extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()]
    a, b, c = got
    assert (a.title, a.body, a.author_name, a.image_urls, a.tags) == ("DOM 标题", "DOM 正文 #城市", "DOM 作者", ["https://sns-webpic-qc.xhscdn.com/dom.jpg"], ["城市"])
    assert (b.title, b.author_id, b.author_name, b.published_at) == ("CMU title", "u-cmu", "CMU Author", "06-26")
    assert b.image_urls == [f"https://sns-webpic-qc.xhscdn.com/{i}.jpg" for i in (1, 2)]
    assert (b.metrics.liked, b.metrics.collected, b.metrics.comment, b.metrics.shared) == ("186", "121", "11", "")
    assert (c.title, c.body, c.published_at, c.author_name, c.metrics.shared, c.tags) == ("Shown", "scrolled\nbody", "2026/07/26", "An author", "7", ["city"])
    assert (c.image_urls, c.author_avatar) == (["https://sns-img.xhscdn.com/lazy.jpg"], "https://www.xiaohongshu.com/me.png")


def test_state_fields(spark):
    own = {"note_id": "abc123", "description": "d", "content": "c", "images": [{"infoList": [{"imageScene": "x", "url": "//a/0.jpg"}, {"imageScene": "WB_DFT", "url": "//a/1.jpg"}]}], "user": {"user_id": 7, "name": "N", "avatarUrl": "//a/me.jpg"}, "interactInfo": {"share_count": 3, "liked_count": 0}, "lastUpdateTime": 1753516200000}
    wrapped = page({"value": {"zzz": {"data": {"note": own}}}, "_value": {"abc123": {"note": {"noteId": "abc123", "title": "wrong"}}}}).replace('"content"', '"gone": undefined, "content"')
    row = (0, URL, '<title>A  title</title><meta content="Meta &amp; title" property="og:title">' + wrapped)
    got = extract.extract(spark.createDataFrame([row], "page_id int, url string, html string")).first()
    d = got.data
    assert (got.source, d.id, d.title, d.body, d.author_id, d.author_name, d.author_avatar) == ("initial-state", "abc123", "Meta & title", "d", "7", "N", "https://a/me.jpg")
    assert (d.image_urls, d.metrics.shared, d.metrics.liked, d.published_at) == (["https://a/1.jpg"], "3", "0", "1753516200000")


def test_dates(spark):
    cases = {"2026/07/26": "2026-07-26T00:00:00.000Z", "Jul 26, 2026": "2026-07-26T00:00:00.000Z", "Sun, 26 Jul 2026 07:50:00 GMT": "2026-07-26T07:50:00.000Z", "07/26": "07/26", "7.26": "7.26", "2026-7-6 8:05": "2026-07-06T08:05:00.000Z", "3 days ago": "3 days ago", "yesterday": "yesterday", "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", T.iso_date(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in rows} == cases


def test_extract(spark):
    own = {"noteId": "abc123", "title": "标题", "desc": "正文 #旅行[话题]# #杭州[话题]#", "time": 1753516200, "user": {"userId": "u", "nickname": "N"}, "interactInfo": {"likedCount": "10"}, "tagList": [{"name": "杭州"}], "imageList": [{"urlDefault": "//a/1.jpg"}, {"urlPre": "https://a/2.jpg"}]}
    rows = [(0, URL, page({"zzz": {"note": {"noteId": "other"}}, "abc123": {"note": own}})), (1, URL, DOM), (2, "https://example.com/explore/abc123", DOM), (3, URL, "")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    a, b = got[0], got[1]
    assert (a.source, a.data.id, a.data.tags, a.data.metrics.liked, a.data.image_urls) == ("initial-state", "abc123", ["杭州", "旅行"], "10", ["https://a/1.jpg", "https://a/2.jpg"])
    assert (b.source, b.data.title, b.data.author_id, b.data.author_name, b.data.published_at) == ("dom", "CMU title", "u-cmu", "CMU Author", "06-26")
    assert b.data.image_urls == ["https://sns-webpic-qc.xhscdn.com/1.jpg", "https://sns-webpic-qc.xhscdn.com/2.jpg"] and (b.data.metrics.liked, b.data.metrics.collected, b.data.metrics.comment) == ("186", "121", "11")
    assert (got[2].error, got[3].error) == ("unsupported", "not-found")
    note = extract.normalise(extract.extract(spark.createDataFrame(rows[:1], "page_id int, url string, html string")), "now").first()
    assert (note.cover, note.published_at, note.images[1]["index"]) == ("https://a/1.jpg", "2025-07-26T07:50:00.000Z", 1)


PARTS = st.lists(st.sampled_from(["a", "Zz", "9", "中", "文", " ", "  ", "\t", ",", ".", ";", "!", ")", "(", "（", "-", "é", "\u3000", "%", "]", "{"]), max_size=9).map("".join)


@given(PARTS, PARTS)
@settings(max_examples=600, deadline=None)
def test_joining_repairs_as_the_whole_would(left, right):
    left, right = repaired(repaired(left)), repaired(repaired(right))
    for sep in ("", " "):
        if repaired(left) == left and repaired(right) == right:
            assert joined(left + sep, right) == repaired(left + sep + right)


def test_policy(spark):
    cells = [(e, s, p) for e, s in ((False, False), (True, True), (True, False)) for p in ("skip", "overwrite", "new-version")]
    got = [r.a for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, e boolean, s boolean, p string").orderBy("i").select(export.policy_action(F.col("e"), F.col("s"), F.col("p")).alias("a")).collect()]
    assert got == ["write"] * 3 + ["skipped", "write", "versioned", "versioned", "error:NOTE_ID_MISMATCH", "versioned"]


def test_history(spark):
    rows = spark.createDataFrame([("n1", "download", 1), ("n1", "vault", 2), ("n1", "download", 3)], "note_id string, output string, at int")
    got = export.upsert_history(rows, ["note_id", "output"], [(-F.col("at")).alias("o")]).collect()
    assert [(r.output, r.at) for r in got] == [("download", 3), ("vault", 2)]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.md", "x"), (2, "a.md", "yy")], "pos int, filename string, markdown string")
    got = export.write_files(export.unique_names(rows, [F.col("pos")]), str(tmp_path)).collect()
    assert sorted((r.target, r.bytes, r.error) for r in got) == [("a (1).md", 2, None), ("a.md", 1, None)]
    assert (tmp_path / "a (1).md").read_text() == "yy"


def test_batch(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], "id string, pos int, v int")
    got = scan.dedupe_last(rows, ["id"], ["v"]).orderBy("pos").collect()
    assert [(r.id, r.v) for r in got] == [("a", 3), ("b", 2)]
    assert spark.range(1).select(scan.batch_error(F.lit(21)).alias("e")).first().e == "BATCH_LIMIT"


def test_queue(spark):
    rows = spark.createDataFrame([("queued", None), ("extracting", None), ("ocr", None), ("ocr", "running"), ("ocr", "completed"), ("completed", None)], "s string, j string")
    got = [(r.a, r.b, r.c) for r in rows.select(jobs.stop_gracefully(F.col("s")).alias("a"), jobs.recover(F.col("s"), F.col("j")).alias("b"), jobs.recover_error(F.col("s"), F.col("j")).alias("c")).collect()]
    assert got == [("canceled", "queued", None), ("extracting", "queued", None), ("ocr", "error", "OCR_INTERRUPTED"), ("ocr", "ocr", None), ("ocr", "exporting", None), ("completed", "completed", None)]


MESSAGES = [("j", 0, "start", None, None, 4, None, None, 1000), ("j", 1, "stage", "recognizing-images", None, 4, 50, None, 1100), ("j", 2, "result", None, 0, 4, None, "success", None), ("j", 3, "result", None, 0, 4, None, "empty", None), ("j", 4, "result", None, 2, 4, None, "success", None), ("k", 5, "result", None, 1, 2, None, None, None), ("k", 6, "start", None, None, 2, None, None, 5), ("k", 7, "result", None, 1, 2, None, "error", None), ("j", 8, "finish", None, None, 4, None, "completed", 1700), ("j", 9, "result", None, 3, 4, None, None, None), ("m", 10, "stage", "finalizing", None, 1, 5, None, None)]
SCHEMA = "job_id string, seq int, type string, stage string, image_index int, total int, progress int, status string, at_ms long"


def test_replay_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame(MESSAGES, SCHEMA)
    shown = lambda r: (r.status, r.current, r.progress, r.applied, r.duration_ms, {k: v.status for k, v in r.results.items()})
    batch = {r.job_id: shown(r) for r in replay(rows, ["seq"]).collect()}
    assert batch == {"j": ("completed", 4, 100, 6, 700, {0: "empty", 2: "success"}), "k": ("running", 1, 73, 2, None, {1: "error"})}
    for n in range(3):  # three batches, so that states are kept and cleared between them
        rows.where((F.col("seq") >= 4 * n) & (F.col("seq") < 4 * n + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = run_to_end(reduce_stream(source, idle=None), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.job_id: shown(r) for r in latest(changes).collect()} == batch
    assert [(r.job_id, r.life, r.n_results) for r in held_jobs(spark, str(tmp_path / "check")).collect()] == [("k", 6, 1)]


def test_reducer():
    state = None
    for message in ({"type": "start", "total": 2, "at_ms": 10}, {"type": "stage", "stage": "loading-models", "progress": 130, "at_ms": 20, "durations": {"loading-runtime": 5}}, {"type": "stage", "stage": "creating-sessions", "progress": 30, "at_ms": 30, "current_image": 1, "durations": {"loading-models": 7, "loading-runtime": 6}}):
        state = advance(state, message)
    assert (state["progress"], state["stage_started_ms"], state["current_image"], state["durations"]) == (30, 30, 1, {"loading-runtime": 6, "loading-models": 7})
    asked = advance(state, {"type": "control", "status": "pausing"})
    assert advance(asked, {"type": "pause"})["status"] == "paused" and advance(state, {"type": "pause"}) is state
    canceled = advance(state, {"type": "control", "status": "canceled"})
    assert advance(canceled, {"type": "result", "image_index": 0}) is canceled
    ended = advance(canceled, {"type": "finish", "status": "error", "error": "E", "at_ms": 60})
    assert (ended["status"], ended["error"], ended["duration_ms"]) == ("canceled", None, 50)
    failed = advance(state, {"type": "finish", "status": "error", "error": "E", "duration_ms": 3})
    assert (failed["status"], failed["error"], failed["duration_ms"], failed["progress"]) == ("error", "E", 3, 30)
    assert advance(None, {"type": "result", "image_index": 0}) is None


def test_queue_steps(spark):
    cells = [("queued", False, True, 1, False, None, None, None), ("queued", True, True, 1, False, None, None, None), ("opening", True, True, 1, False, None, None, None), ("extracting", True, False, 1, True, None, None, None), ("extracting", True, True, 0, True, None, None, None), ("extracting", True, True, 1, True, "range-empty", None, None), ("extracting", True, True, 1, True, None, None, None), ("extracting", True, True, 1, False, "range-empty", None, None), ("ocr", True, True, 1, True, None, "completed", None), ("ocr", True, True, 1, True, None, "running", None), ("exporting", True, True, 1, True, None, None, "error:X"), ("exporting", True, True, 1, True, None, None, "skipped"), ("exporting", True, True, 1, True, None, None, "write")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, status string, url boolean, same boolean, n int, ocr boolean, sel string, job string, export string")
    got = [(r.s.status, r.s.error) for r in rows.select("i", jobs.next_step(*(F.col(c) for c in rows.columns[1:])).alias("s")).orderBy("i").collect()]
    assert got == [("error", "AUTO_CLIP_URL_INVALID"), ("opening", None), ("extracting", None), ("error", "AUTO_CLIP_TITLE_MISMATCH"), ("error", "AUTO_CLIP_NO_IMAGES"), ("error", "AUTO_CLIP_OCR_SELECTION:range-empty"), ("ocr", None), ("exporting", None), ("exporting", None), ("ocr", None), ("error", "X"), ("skipped", None), ("completed", None)]
    queue = spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("url"), F.lit("queued").alias("status")) for x in "ab")).alias("q"))
    assert [tuple(x) for x in queue.select(jobs.patch_item(F.col("q"), F.lit(1), status=F.lit("opening")).alias("q")).first().q] == [("a", "queued"), ("b", "opening")]


def test_restart(spark):
    rows = spark.createDataFrame([("exporting", None, True), ("ocr", "running", False), ("ocr", "running", True), ("ocr", "canceled", False), ("opening", None, False)], "s string, j string, a boolean")
    got = [tuple(r) for r in rows.select(jobs.recover(F.col("s"), F.col("j"), F.col("a")), jobs.recover(F.col("s"), F.col("j"), F.col("a"), F.lit(True)), jobs.recover_error(F.col("s"), F.col("j"), F.col("a"))).collect()]
    assert got == [("queued", "canceled", None), ("error", "error", "OCR_INTERRUPTED"), ("ocr", "ocr", None), ("canceled", "canceled", None), ("queued", "canceled", None)]


def test_results_set_the_stage():
    state = advance(advance(None, {"type": "start", "total": 2}), {"type": "result", "image_index": 0, "total": 2})
    assert (state["progress"], state["stage"]) == (73, "recognizing-images")
    assert advance(state, {"type": "stage", "stage": "recognizing-images", "progress": 10}) is state
    later = advance(state, {"type": "stage", "stage": "finalizing", "progress": 96})
    assert (later["progress"], later["stage"]) == (96, "finalizing")


def test_current_article(spark):
    pick = lambda *t: spark.range(1).select(scan.current_article(F.array(*(F.lit(x).cast("string") for x in t))).alias("t")).first().t
    assert pick("小红书", None, "ab  c | 小红书", "abd") == "ab c" and pick("", "小红书") == "当前文章"


def test_tiles(spark):
    rows = spark.createDataFrame([(1080, 5000), (1080, 1900)], "w long, h long")
    got = sorted((r.h, r.tile, r.top, r.tile_height) for r in vision.tiles(rows, "w", "h").collect())
    assert got == [(1900, 0, 0, 1900), (5000, 0, 0, 1728), (5000, 1, 1590, 1728), (5000, 2, 3180, 1728), (5000, 3, 4770, 230)]


def test_ctc(spark):
    steps = [(i, [0.9 if c == k else 0.05 for c in range(3)]) for i, k in enumerate((1, 1, 0, 1, 2))]
    got = vision.ctc_decode(spark.createDataFrame([(1, *s) for s in steps], "k int, n int, p array<double>"), ["k"], "n", "p", ["a", "b"]).first()
    assert got.text == "aab" and got.score == pytest.approx(0.9)


def test_reading_order():
    assert vision.reading_order([(50, 10), (10, 15), (30, 40)]) == [1, 0, 2]


def test_boxes():
    plane = np.zeros((64, 64), np.float32)
    plane[10:20, 8:50] = 0.9
    plane[40:52, 20:40] = 0.8
    boxes = vision.decode_boxes(plane, 128, 128)
    assert len(boxes) == 2 and boxes[0][1][0][1] < boxes[1][1][0][1]
    (x0, y0), _, (x1, y1), _ = boxes[0][1]
    assert x0 <= 16 and x1 >= 98 and y0 <= 20 and y1 >= 38
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert np.allclose(vision.least_rectangle(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]])), square)
    assert vision.crop(np.arange(300, dtype=np.uint8).reshape(10, 10, 3), square).shape == (4, 4, 3)
    assert vision.normalised_planes(np.zeros((2, 3, 4), np.uint8)).shape == (3, 2, 3)


def test_boxes_of_rows(spark):
    plane = np.zeros((64, 64), np.float32)
    plane[10:20, 8:50] = 0.9
    rows = spark.createDataFrame([(1, plane.ravel().tolist()), (2, []), (3, None)], "n int, plane array<float>")
    got = {r.n: r.b for r in rows.select("n", vision.boxes("plane", F.lit(64), F.lit(128), F.lit(128)).alias("b")).collect()}
    assert (got[2], got[3], len(got[1])) == ([], [], 1)
    (score, corners), = vision.decode_boxes(plane, 128, 128)
    assert got[1][0].score == pytest.approx(score) and [(p.x, p.y) for p in got[1][0].poly] == corners


def test_text_widths(spark):
    rows = spark.createDataFrame([(0, 100, 48), (1, 4000, 48), (2, 1001, 60), (3, 5, 0)], "n int, w long, h long")
    rows = rows.select("n", vision.text_width(F.col("w"), F.col("h")).alias("t")).select("n", "t.*")
    assert sorted(map(tuple, rows.collect())) == [(0, 320, 100), (1, 3200, 3200), (2, 800, 800), (3, 320, 240)]
    got = vision.text_batches(rows.withColumn("k", F.lit(1)), ["k"], "n", "padded", 2).collect()
    assert sorted((r.n, r.batch, r.batch_width) for r in got) == [(0, 0, 320), (1, 1, 3200), (2, 1, 3200), (3, 0, 320)]


def test_queue_key(spark):
    items = F.array(F.struct(*(F.lit(x).cast("string").alias(c) for c, x in (("url", "u"), ("title", "t"), ("status", "queued"), ("error", None), ("filename", None)))))
    assert spark.range(1).select(jobs.queue_key(F.concat(items, items)).alias("k")).first().k == "u\x1ft\x1fqueued\x1f\x1f\x1eu\x1ft\x1fqueued\x1f\x1f"


def test_idle_jobs_are_forgotten(spark, tmp_path):
    def put(*messages):
        spark.createDataFrame(messages, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def wait(what):
        end = time.monotonic() + 60
        while time.monotonic() < end:
            if any(what(r) for r in spark.table("idle_jobs").collect()):
                return True
            time.sleep(0.5)

    put(MESSAGES[0])
    stream = reduce_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle="1 second")
    run = stream.writeStream.format("memory").queryName("idle_jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        assert wait(lambda r: r.applied == 1)
        time.sleep(6)  # longer than idle and a few batches
        put(MESSAGES[2], MESSAGES[6])
        assert wait(lambda r: r.job_id == "k")
        assert sorted((r.job_id, r.applied) for r in spark.table("idle_jobs").collect()) == [("j", 1), ("k", 1)]  # the result came too late
    finally:
        run.stop()


def test_packages(spark, tmp_path):
    with tarfile.open(tmp_path / "m.tar", "w") as tar:
        info = tarfile.TarInfo("m/inference.yml")
        data = ("x: 1\nPostProcess:\n  character_dict:\n" + "".join(f"  - '{chr(0x4E00 + i)}'\n" for i in range(120))).encode()
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    got = tar_members(spark, str(tmp_path / "m.tar")).first()
    assert got.member == "m/inference.yml"
    assert len(letters := character_list(bytes(got.content).decode())) == 121 and letters[0] == "一" and letters[-1] == " "
    with pytest.raises(ValueError):
        character_list("character_dict:\n  - a\n")


def reader():
    class Reader:  # made here, so that it travels to workers
        """Finds bright regions and reads each as its number by width; fails on an image that is all white."""

        def detect(self, planes):
            if (planes > 2).all():
                raise ValueError("too bright")
            return (planes[0] > 0).astype(np.float32)

        def recognise(self, batch):
            return [(f"w{int((crop[0, 24] > 0).sum())}", 0.5) for crop in batch]

    return Reader


def test_recognise(spark):
    long = np.zeros((4000, 64, 3), np.uint8)
    long[30:50, 8:56] = 200
    long[3900:3920, 8:40] = 200
    white = np.full((64, 64, 3), 255, np.uint8)
    rows = [(0, long.tobytes(), 64, 4000, None), (1, white.tobytes(), 64, 64, None), (2, None, 64, 64, None), (3, None, 64, 64, "HTTP_ERROR:500"), (4, np.zeros((64, 64, 3), np.uint8).tobytes(), 64, 64, None), (5, b"abc", 64, 64, None)]
    images = spark.createDataFrame(rows, "image_index int, pixels binary, width long, height long, error string")
    got = {r.image_index: r for r in vision.recognise(images, ["image_index"], reader()).collect()}
    assert [got[i].status for i in range(6)] == ["success", "error", "error", "error", "empty", "error"]
    assert (got[1].error, got[2].error, got[3].error) == ("ValueError: too bright", "Image download failed.", "HTTP_ERROR:500")
    assert len(got[0].lines) == 2 and got[0].text.count("w") == 2
    tops = [min(p.y for p in x.poly) for x in got[0].lines]
    assert tops[0] < 40 and 3880 < tops[1] < 3910
    with pytest.raises(NotImplementedError):
        vision.recognise(images, ["image_index"])


def test_texts_come_back_in_reading_order():
    rgb = np.zeros((256, 480, 3), np.uint8)
    for i, wide in enumerate((300, 40, 200, 420)):
        rgb[10 + 60 * i : 40 + 60 * i, 20 : 20 + wide] = 200
    found = vision.lines_of(rgb, reader()(), batch=2)
    widths = [max(p["x"] for p in x["poly"]) - min(p["x"] for p in x["poly"]) for x in found]
    assert sorted(range(4), key=lambda i: widths[i]) == [1, 2, 0, 3] and [x["poly"][0]["y"] for x in found] == sorted(x["poly"][0]["y"] for x in found)


def test_numbers_within_large_keys(spark):
    rows = [(k, i * 7919 % 4001 // (1 + 3 * (k == "hot")), i) for i in range(4001) for k in (("hot", None, f"k{i % 50}") if i % 3 else ("hot",))]
    got = ranks.numbered(spark.createDataFrame(rows, "k string, v long, i long").repartition(5), ["k"], [F.col("v")]).collect()
    assert sorted((r.k or "", r.v, r.i) for r in got) == sorted((k or "", v, i) for k, v, i in rows)
    of = {}
    for r in got:
        of.setdefault(r.k, []).append((r._k, r.v, r._n))
    assert all([x[0] for x in sorted(x)] == list(range(1, len(x) + 1)) and {y[2] for y in x} == {len(x)} and [y[1] for y in sorted(x)] == sorted(y[1] for y in x) for x in of.values())
    # equal values of one key take several parts, too
    assert ranks.numbered(spark.createDataFrame([("a", 1)] * 4000, "k string, v long"), ["k"], [F.col("v")]).agg(F.countDistinct("_k"), F.max("_k"), F.min("_n")).first()[:] == (4000, 4000, 4000)


def test_summary_without_nulls(spark):
    got = metrics.summary(spark.createDataFrame([("a", 3.0), ("a", None), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None)], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 4, 3.8, 1.0, 3.0, 9.0, 9.0), ("b", 0, None, None, None, None, None)]


def proto(*fields):
    """A protocol buffer message of (number, value): texts, bytes, whole numbers and messages."""
    def number(n):
        return bytes([n]) if n < 128 else bytes([n % 128 + 128]) + number(n // 128)

    out = b""
    for key, value in fields:
        if isinstance(value, int):
            out += number(key * 8) + number(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += number(key * 8 + 2) + number(len(value)) + value
    return out


def onnx_model(rank_in, rank_out, *nodes):
    """A model that passes its input through nodes (operator, attribute, whole numbers, more attributes)."""
    shaped = lambda name, rank: proto((1, name), (2, proto((1, proto((1, 1), (2, proto(*((1, proto((2, f"{name}{i}"))) for i in range(rank)))))))))
    made = []
    for i, (kind, attribute, values, *more) in enumerate(nodes):
        listed = proto((1, attribute), (20, 7), *((8, v) for v in values))
        others = [(5, proto((1, name), (20, 2), (3, v))) for name, v in more]
        made.append((1, proto((1, "x" if i == 0 else f"t{i}"), (2, "y" if i == len(nodes) - 1 else f"t{i + 1}"), (4, kind), (5, listed), *others)))
    graph = proto(*made, (2, "g"), (11, shaped("x", rank_in)), (12, shaped("y", rank_out)))
    return proto((1, 8), (8, proto((1, ""), (2, 13))), (7, graph))


def package(path, **files):
    with tarfile.open(path, "w") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(f"m/inference.{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def test_models_of_packages_read_images(spark, tmp_path):
    settings = ("PostProcess:\n  character_dict:\n" + "".join(f"  - '{chr(0x4E00 + i)}'\n" for i in range(120))).encode()
    # text is where any colour is bright; a step's class is its brightest colour
    detection = package(tmp_path / "det.tar", onnx=onnx_model(4, 4, ("ReduceMax", "axes", [1], ("keepdims", 1))), yml=settings)
    recognition = package(tmp_path / "rec.tar", yml=settings, onnx=onnx_model(4, 3, ("ReduceMean", "axes", [2], ("keepdims", 0)), ("Transpose", "perm", [0, 2, 1])))
    lost = package(tmp_path / "lost.tar", yml=settings)
    assert [(r.path.rsplit("/")[-1], r.error) for r in model_packages(spark, str(tmp_path / "*.tar")).orderBy("path").collect()] == [("det.tar", None), ("lost.tar", "MODEL_PACKAGE_INCOMPLETE"), ("rec.tar", None)]
    with pytest.raises(ValueError, match="MODEL_PACKAGE_INCOMPLETE"):
        onnx_sessions(spark, detection, lost)
    page = np.zeros((96, 96, 3), np.uint8)
    page[8:28, 12:84, 0], page[48:68, 12:84, 1] = 255, 255
    images = spark.createDataFrame([(1, bytearray(page.tobytes()), 96, 96, None), (2, bytearray(96 * 96 * 3), 96, 96, None), (3, bytearray(b"short"), 96, 96, None), (4, None, 96, 96, "HTTP_ERROR:404")], "i int, pixels binary, width long, height long, error string")
    sessions = onnx_sessions(spark, detection, recognition, threads=1, batch=1)
    got = vision.recognise(images, ["i"], sessions).orderBy("i").collect()
    assert [(r.i, r.status, r.text) for r in got] == [(1, "success", "丁\n一"), (2, "empty", ""), (3, "error", ""), (4, "error", "")]
    assert got[2].error and got[3].error == "HTTP_ERROR:404" and sessions.name != onnx_sessions(spark, detection, recognition).name
    session = sessions()
    assert session.batch == 1 and session.detect(np.zeros((3, 32, 64), np.float32)).shape == (32, 64)
    session.close()
    assert session.models == []


def test_session_options_and_greedy_decoding():
    assert [option(x, THREADS) for x in (None, 0, 2.9, 99, float("nan"), "3", True)] == [4, 1, 2, 8, 4, 4, 4] and [option(x, BATCH) for x in (None, -5, 33)] == [8, 1, 32]
    steps = np.eye(4, dtype=np.float32)[[0, 1, 1, 0, 1, 3, 2, 2]] * np.arange(1, 9, dtype=np.float32)[:, None]
    assert greedy(np.stack([steps, 0 * steps]), ["a", "b"]) == [("aab", (2 + 5 + 7) / 3), ("", 0.0)]  # class 3 has no character
    with pytest.raises(ValueError):
        greedy(steps, ["a"])


def test_state_table(spark, tmp_path):
    schema, path = "key string, id string, value string, cleared boolean, at int", str(tmp_path / "state")
    log = [("job", "a", "1", None, 1), ("job", "a", None, True, 2), ("job", "b", "2", False, 3), ("job", "a", None, True, 4), ("job", "b", "3", False, 5), ("gone", "x", "4", False, 1), ("gone", "x", None, True, 2), ("none", "x", None, True, 1), ("back", "x", "5", False, 1), ("back", "x", None, True, 2), ("back", "x", "6", False, 3), (None, "n", "7", False, 1)]
    for part in (log[:4], log[4:]):
        state.state_store(spark, path, schema, ["at"]).append(spark.createDataFrame(part, schema))
    assert sorted(((r.key or "", r.id, r.value) for r in state.state_store(spark, path, schema, ["at"]).read().collect())) == [("", "n", "7"), ("back", "x", "6"), ("job", "b", "3")]


def test_references_that_were_cut(spark):
    """Texts of the test tables may end inside a reference, which their SQL leaves; browsers read it, and so does the site's profile."""
    html = "<h1>x&amp;y &#65; &amp</h1><article>&lt;a&gt; a&ampb &copy &notit; &</article><nav><a href='?a=1&lt=2'>t</a></nav>"
    got = spark.createDataFrame([(html,)], "html string")
    read = lambda site: got.select(extract.document_fields(F.col("html"), F.lit("https://m.example.org/en/1"), site).alias("f")).first().f
    cut = read(N.TEST_SITE)
    assert (cut.title, cut.body, cut.tags) == ("x&y A &amp", "<a> a&ampb &copy &notit; &", ["t"])
    assert read(N.SiteProfile(selectors=Selectors(title=("h1",), body=("article",)))).title == "x&y A &"


def test_regions_are_those_of_a_plain_flood():
    rng = np.random.default_rng(3)
    for _ in range(200):
        mask = rng.random(rng.integers(1, 20, 2)) < rng.choice([0.2, 0.4, 0.7, 1.0])
        left, want = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
        whole = {p for p in left if all((p[0] + a, p[1] + b) in left for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        while left:
            todo = own = {min(left, key=lambda p: (p[1], p[0]))}
            while todo:
                todo = {(x + a, y + b) for x, y in todo for a in (-1, 0, 1) for b in (-1, 0, 1)} & left - own
                own = own | todo
            left -= own
            if len(own) >= 4 and len(own - whole) >= 4:
                want.append((len(own), own - whole))
        assert [set(map(tuple, b.tolist())) for b in vision.components(mask)] == [b for _, b in sorted(want, key=lambda w: -w[0])]


def test_images_are_recognised_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Counting:
        def detect(self, planes):
            with open(calls, "a") as f:
                f.write("x")
            return np.zeros(planes.shape[1:], np.float32)

    images = spark.range(6).select("id", F.when(F.col("id") > 0, F.lit(bytes(8 * 8 * 3))).alias("pixels"), F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), F.lit(None).cast("string").alias("error"))
    assert sorted(r.status for r in vision.recognise(images, ["id"], Counting).collect()) == ["empty"] * 5 + ["error"]
    assert len(open(calls).read()) == 5


def plain_sample(rgb, u, v):
    """Bilinear values at (u, v), point by point."""
    u, v = np.clip(u, 0, rgb.shape[1] - 1), np.clip(v, 0, rgb.shape[0] - 1)
    x, y = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1, a, b = np.minimum(x + 1, rgb.shape[1] - 1), np.minimum(y + 1, rgb.shape[0] - 1), (u - x)[..., None], (v - y)[..., None]
    return np.floor((rgb[y, x] * (1 - a) + rgb[y, x1] * a) * (1 - b) + (rgb[y1, x] * (1 - a) + rgb[y1, x1] * a) * b + 0.5).astype(np.uint8)


def test_upright_crops_are_pixels_and_scaling_is_plain():
    rgb = np.random.default_rng(5).integers(0, 256, (60, 90, 3)).astype(np.uint8)
    box = lambda x, y, x1, y1: np.array([[x, y], [x1, y], [x1, y1], [x, y1]])
    for x, y, x1, y1 in ((3, 5, 80, 20), (0, 0, 89, 59), (10, 2, 20, 50)):
        got, want = vision.crop(rgb, box(x, y, x1, y1)), plain_sample(rgb, *np.meshgrid(np.arange(x, x1), np.arange(y, y1)))
        assert np.array_equal(got, np.rot90(want) if y1 - y >= 1.5 * (x1 - x) else want) and np.shares_memory(got, rgb)
    assert vision.crop(rgb, np.array([[3, 5], [40, 9], [39, 20], [2, 16]])).shape == (11, 37, 3)
    for part, w, h in ((rgb, 200, 48), (rgb, 33, 128), (rgb[7:40, 4:50], 46, 7), (rgb[:1, :1], 5, 48), (rgb[::-1, ::2], 45, 61)):
        u, v = np.meshgrid((np.arange(w) + 0.5) * part.shape[1] / w - 0.5, (np.arange(h) + 0.5) * part.shape[0] / h - 0.5)
        assert np.array_equal(vision.resized(part, w, h), plain_sample(part, u, v))


def test_an_image_of_unknown_width_leaves_others_as_they_are(spark):
    rgb = np.zeros((64, 64, 3), np.uint8)
    rgb[20:40, 8:56] = 200
    rows = [(0, rgb.tobytes(), 64, 64, None), (1, rgb.tobytes(), None, 64, None), (2, rgb.tobytes(), 64, 64, None)]
    images = spark.createDataFrame(rows, "i int, pixels binary, width long, height long, error string").coalesce(1)
    got = {r.i: r.status for r in vision.recognise(images, ["i"], reader()).collect()}
    assert got == {0: "success", 1: "error", 2: "success"}


def test_upright_boxes_score_as_others():
    plane = np.random.default_rng(6).random((40, 60)).astype(np.float32)
    for x, y, x1, y1 in ((3, 5, 50, 20), (0, 0, 59, 39), (2.5, 3.25, 30.5, 9.75), (-4, -2, 70, 50), (7.1, 3, 7.3, 9)):
        quad = np.array([[x, y], [x1, y], [x1, y1], [x, y1]], float)
        py, px = np.mgrid[0:40, 0:60]
        within = vision.inside(quad, px + 0.5, py + 0.5)
        assert vision.region_score(plane, quad) == (float(plane[within].mean()) if within.any() else 0.0)
        assert np.array_equal(vision.least_rectangle(np.array([*quad, *quad[::2]])), quad)
