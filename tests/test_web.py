"""Downloads and the vault against a small server of this process."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from postmill.operators import lines
from postmill.sources import synthetic, web
from postmill.sources.vault import VaultSource

STAMP = "20260102-030405"


def note(id_: str, body: str = "x") -> str:
    return f'---\ntitle: "t"\nnote_id: "{id_}"\n---\n{body}\n'


@pytest.fixture
def store():
    kept = {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, content: bytes = b""):
            self.send_response(status)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1)
            if self.path.startswith("/image"):
                return self.answer(200, self.path.encode()) if self.path != "/image-gone" else self.answer(410)
            if self.headers.get("Authorization") != "Bearer k":
                return self.answer(401)
            if self.path == "/":
                return self.answer(200, b'{"authenticated": true, "service": "notes"}')
            if self.path.endswith("/"):
                here = unquote(self.path)
                below = [k.removeprefix(here) for k in list(kept) if k.startswith(here)]
                names = sorted({b.split("/")[0] + "/" * ("/" in b) for b in below})
                return self.answer(200, json.dumps({"files": names}).encode()) if names else self.answer(404)
            text = kept.get(unquote(self.path))
            return self.answer(404) if text is None else self.answer(200, text.encode())

        def do_PUT(self):
            kept[unquote(self.path)] = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.answer(204)

        def do_DELETE(self):
            self.answer(204 if kept.pop(unquote(self.path), None) is not None else 404)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", kept
    server.shutdown()


def test_ordered_and_bounded():
    busy, most, lock = [0], [0], threading.Lock()

    def load(i):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.02 if i % 2 else 0.001)
        with lock:
            busy[0] -= 1
        return i

    assert list(web.ordered(load, range(20))) == list(range(20)) and most[0] <= web.AHEAD
    assert list(web.ordered(load, [])) == []


def test_downloads(spark, store):
    base, _ = store
    rows = spark.createDataFrame([(1, f"{base}/image/a"), (2, None), (3, ""), (4, f"{base}/image-gone"), (5, "no address"), (6, f"{base}/image/b")], "n int, url string")
    got = {r.n: (bytes(r.content) if r.content is not None else None, r.error) for r in web.download_images(rows).collect()}
    assert got == {1: (b"/image/a", None), 2: (None, "IMAGE_URL_MISSING"), 3: (None, "IMAGE_URL_MISSING"), 4: (None, "HTTP_ERROR:410"), 5: (None, "ValueError"), 6: (b"/image/b", None)}
    assert web.download_images(rows.where("n > 9")).count() == 0


def test_vault_policies(spark, store):
    base, kept = store
    kept |= {"/vault/Clips/own.md": note("a"), "/vault/Clips/other.md": note("z"), "/vault/Clips/plain.md": "no front matter"}
    names = [(0, "fresh", "skip"), (1, "own", "skip"), (2, "own", "overwrite"), (3, "own", "new-version"), (4, "other", "skip"), (5, "other", "overwrite"), (6, "other", "new-version"), (7, "plain", "skip"), (8, None, "skip")]
    rows = spark.createDataFrame([(i, n and f"{n}.md", note("a", f"body {i}"), "a", p) for i, n, p in names], "pos int, filename string, markdown string, note_id string, policy string")
    got = {r.pos: (r.target, r.action, r.error) for r in web.put_notes(rows, base, "k", "Clips", STAMP).collect()}
    assert got == {
        0: ("fresh.md", "written", None),
        1: ("own.md", "skipped", None),
        2: ("own.md", "written", None),
        3: (f"own_更新-{STAMP}.md", "versioned", None),
        4: (f"other_更新-{STAMP}.md", "versioned", None),
        5: (None, None, "NOTE_ID_MISMATCH"),
        6: (f"other_更新-{STAMP}-2.md", "versioned", None),
        7: (f"plain_更新-{STAMP}.md", "versioned", None),
        8: (None, None, "FILENAME_INVALID"),
    }
    assert kept["/vault/Clips/own.md"] == note("a", "body 2") and kept[f"/vault/Clips/other_更新-{STAMP}-2.md"] == note("a", "body 6")
    again = {r.pos: r.target for r in web.put_notes(rows.where("pos in (3, 6)"), base, "k", "Clips", STAMP).collect()}
    assert again == {3: f"own_更新-{STAMP}.md", 6: f"other_更新-{STAMP}-2.md"}  # a repeated task stores nothing twice


def test_vault_errors(spark, store):
    base, _ = store
    assert web.Vault(base, "k").ping() == "notes"
    with pytest.raises(PermissionError, match="UNAUTHORIZED"):
        web.Vault(base, "bad").ping()
    row = spark.createDataFrame([(1, "a.md", "x", "a", "skip")], "pos int, filename string, markdown string, note_id string, policy string")
    assert web.put_notes(row, base, "bad", "", STAMP).first().error == "UNAUTHORIZED"
    assert web.put_notes(row, "http://127.0.0.1:9", "k", "", STAMP).first().error == "CONNECTION_FAILED"
    with pytest.raises(TimeoutError, match="CONNECTION_TIMEOUT"):
        web.Vault(base, "k", timeout=0.2).call("GET", "/slow")


def test_version_conflict(store):
    base, kept = store
    kept |= {"/vault/a.md": note("z")} | {f"/vault/a_更新-{STAMP}{f'-{k}' if k > 1 else ''}.md": note("y") for k in range(1, web.VERSIONS + 1)}
    assert web.put_note(web.Vault(base, "k"), "a.md", "x", "a", "skip", STAMP) == (None, None, "VERSION_CONFLICT")


NOTES = "pos int, filename string, markdown string, note_id string, policy string"


def write(rows, base, job, **more):
    rows.write.format("vault").options(url=base, key="k", folder="Clips", stamp=STAMP, job=job, **more).mode("append").save()


def test_vault_as_a_sink(spark, store):
    base, kept = store
    spark.dataSource.register(VaultSource)
    kept |= {"/vault/Clips/own.md": note("a"), "/vault/Clips/other.md": note("z")}
    names = [(0, "fresh", "skip"), (1, "own", "skip"), (2, "own", "overwrite"), (3, "own", "new-version"), (4, "other", "skip"), (5, "other", "overwrite"), (8, None, "skip")]
    rows = spark.createDataFrame([(i, n and f"{n}.md", note("a", f"body {i}"), "a", p) for i, n, p in names], NOTES).repartition(3)
    write(rows, base, "one")
    report = spark.read.format("vault").options(url=base, key="k", folder="Clips", job="one").load()
    assert {r.pos: (r.target, r.action, r.error) for r in report.collect()} == {
        0: ("fresh.md", "written", None),
        1: ("own.md", "skipped", None),
        2: ("own.md", "written", None),
        3: (f"own_更新-{STAMP}.md", "versioned", None),
        4: (f"other_更新-{STAMP}.md", "versioned", None),
        5: (None, None, "NOTE_ID_MISMATCH"),
        8: (None, None, "FILENAME_INVALID"),
    }
    assert kept["/vault/Clips/own.md"] == note("a", "body 2") and [k for k in kept if ".staged" in k] == ["/vault/Clips/.staged/one.jsonl"]
    write(rows.where("pos < 0"), base, "none")
    assert spark.read.format("vault").options(url=base, key="k", folder="Clips", job="none").load().count() == 0


def test_a_killed_task_leaves_nothing_to_be_seen(spark, store):
    base, kept = store
    spark.dataSource.register(VaultSource)
    rows = spark.createDataFrame([(i, f"n{i}.md", f"text {i}", "a", "skip") for i in range(12)], NOTES).repartition(3)

    @F.udf("string")
    def breaking(i: int, text: str) -> str:
        if i == 7:
            raise RuntimeError("killed")
        return text

    with pytest.raises(Exception, match="killed"):
        write(rows.withColumn("markdown", breaking("pos", "markdown")), base, "bad")
    assert [k for k in kept if ".staged/bad/" not in k] == []  # what tasks stage that outlive the abort stays hidden
    for _ in range(12):  # killed tasks take a moment to end
        web.Vault(base, "k", "Clips").sweep(".staged/bad")
        time.sleep(0.25)
    assert kept == {}
    kept["/vault/Clips/.staged/good/of-a-lost-executor/0"] = "half"
    write(rows, base, "good")
    assert sorted(k for k in kept if ".staged" not in k) == sorted(f"/vault/Clips/n{i}.md" for i in range(12))
    assert [k for k in kept if ".staged" in k] == ["/vault/Clips/.staged/good.jsonl"]


def test_images_by_host(spark, store):
    base, _ = store
    rows = spark.createDataFrame([(i, f"{base}/image/{i}") for i in range(40)] + [(100, "http://127.0.0.2:9/x"), (101, None)], "n int, url string")
    dealt = web.by_host(rows, slots=2)
    parts = dealt.withColumn("p", F.spark_partition_id()).withColumn("host", F.try_parse_url("url", F.lit("HOST"))).groupBy("host").agg(F.countDistinct("p").alias("tasks"))
    assert all(r.tasks <= 2 for r in parts.collect()) and dealt.columns == ["n", "url"]
    got = {r.n: (r.content and bytes(r.content), r.error) for r in web.download_images(dealt).collect()}
    assert got == {i: (f"/image/{i}".encode(), None) for i in range(40)} | {100: (None, "URLError"), 101: (None, "IMAGE_URL_MISSING")}


def test_stress_lines(spark):
    made = synthetic.stress_results(spark, 3, 4)
    assert made.count() == 3 and len(made.first().lines) == 4 and made.select(F.size(F.split("text", "\n")).alias("n")).first().n == 4
    assert [r.text.count("application record") for r in lines.clean_images(made).collect()] == [4, 4, 4]
