"""Sources and sinks over HTTP: image downloads and a vault that stores notes by REST.

What goes wrong with one row is a column of that row. Both run inside Arrow batches, a bounded number of
requests ahead of the row that is handed out.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException
from urllib import error, parse, request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE_TIMEOUT, VAULT_TIMEOUT = 30.0, 7.0
AHEAD = 3
VERSIONS = 100
NOTE_ID = re.compile(r"^note_id:\s*(.+?)\s*$", re.M)


def ordered(load: Callable, items: Iterable, ahead: int = AHEAD) -> Iterator:
    """load(item) of every item, in the items' order, at most `ahead` of them loaded or waiting at once."""
    with ThreadPoolExecutor(ahead) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(load, item))
            if len(waiting) == ahead:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def image_bytes(url: str | None, timeout: float = IMAGE_TIMEOUT) -> tuple[bytes | None, int, str | None]:
    """Content, milliseconds and error of one download; no cookies are sent."""
    if not url:
        return None, 0, "IMAGE_URL_MISSING"
    began = time.monotonic()
    content = problem = None
    try:
        with request.urlopen(url, timeout=timeout) as reply:
            content = reply.read()
    except error.HTTPError as e:
        problem = f"HTTP_ERROR:{e.code}"
    except (OSError, ValueError, HTTPException) as e:
        problem = type(e).__name__
    return content, int((time.monotonic() - began) * 1000 + 0.5), problem


def by_host(images: DataFrame, url: str = "url", slots: int = 4) -> DataFrame:
    """Images dealt to tasks by their host, those of one host to `slots` tasks at most: no host is asked by more than
    slots * AHEAD requests at a time, and none, however many images it has, takes all tasks."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    keyed = images.withColumn("_host", host).withColumn("_slot", F.pmod(F.xxhash64(F.col(url)), F.lit(slots)))
    return keyed.repartition("_host", "_slot").drop("_host", "_slot")


def download_images(images: DataFrame, url: str = "url", timeout: float = IMAGE_TIMEOUT) -> DataFrame:
    """Adds content, duration_ms and error to images. A null or empty address is an error of its row."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in images.schema.fields)}, content binary, duration_ms long, error string"

    def fetch(batches):
        for batch in batches:
            # a row at a time goes out, so that memory holds AHEAD images and not a batch of them
            for i, (content, took, problem) in enumerate(ordered(lambda u: image_bytes(u, timeout), batch.column(url).to_pylist())):
                more = [pa.array([content], pa.binary()), pa.array([took], pa.int64()), pa.array([problem], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *more], [*batch.schema.names, "content", "duration_ms", "error"])

    return images.mapInArrow(fetch, schema)


class Vault:
    """A store of notes behind GET and PUT of /vault/<path>."""

    def __init__(self, base: str, key: str, folder: str = "", timeout: float = VAULT_TIMEOUT):
        self.base, self.key, self.folder, self.timeout = base.rstrip("/"), key, folder.strip("/"), timeout

    def call(self, method: str, path: str, body: bytes | None = None) -> tuple[int, bytes]:
        """Status and content; raises TimeoutError or ConnectionError alone."""
        headers = {"Authorization": f"Bearer {self.key}"} | ({"Content-Type": "text/markdown; charset=utf-8"} if body is not None else {})
        try:
            with request.urlopen(request.Request(self.base + path, body, headers, method=method), timeout=self.timeout) as reply:
                return reply.status, reply.read()
        except error.HTTPError as e:
            return e.code, b""
        except (OSError, HTTPException) as e:
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            raise (TimeoutError("CONNECTION_TIMEOUT") if late else ConnectionError("CONNECTION_FAILED")) from e

    def path(self, name: str) -> str:
        return "/vault/" + "/".join(parse.quote(p, safe="-_.!~*'()") for p in f"{self.folder}/{name}".strip("/").split("/"))

    def read(self, name: str) -> str | None:
        """A note's text; null if there is none."""
        status, content = self.call("GET", self.path(name))
        return None if status == 404 else content.decode() if accepted(status) else None

    def write(self, name: str, text: str) -> None:
        accepted(self.call("PUT", self.path(name), text.encode())[0])

    def delete(self, name: str) -> None:
        """Removes a note; one that isn't there is as good as removed."""
        status = self.call("DELETE", self.path(name))[0]
        if status != 404:
            accepted(status)

    def listed(self, folder: str) -> list[str]:
        """Names in a folder, those of folders with a slash at the end; none where there is no such folder."""
        status, content = self.call("GET", f"{self.path(folder)}/")
        return [] if status == 404 else json.loads(content)["files"] if accepted(status) else []

    def sweep(self, folder: str) -> None:
        """Removes all that a folder holds, whoever put it there."""
        for name in self.listed(folder):
            if name.endswith("/"):
                self.sweep(f"{folder}/{name[:-1]}")
            else:
                self.delete(f"{folder}/{name}")

    def ping(self) -> str | None:
        """The service's name; raises like the other calls, also where it answers that the key isn't known."""
        status, content = self.call("GET", "/")
        accepted(status)
        try:
            told = json.loads(content)
        except ValueError:
            told = None
        if not isinstance(told, dict):
            return None
        if told.get("authenticated") is False:
            raise PermissionError("UNAUTHORIZED")
        return told.get("service") or told.get("name")


def accepted(status: int) -> bool:
    if status in (401, 403):
        raise PermissionError("UNAUTHORIZED")
    if not 200 <= status < 300:
        raise ValueError(f"HTTP_ERROR:{status}")
    return True


def stored_id(text: str) -> str | None:
    """The note id in a stored note's front matter, if it is a JSON string that isn't blank."""
    found = NOTE_ID.search(text)
    try:
        value = json.loads(found[1]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, str) and value.strip() else None


def put_note(vault: Vault, name: str, text: str, note: str, policy: str, stamp: str) -> tuple[str | None, str | None, str | None]:
    """Target, action and error of one note under a duplicate policy."""
    try:
        old = vault.read(name)
        same = old is not None and stored_id(old) == note
        if same and policy == "skip":
            return name, "skipped", None
        if old is None or (same and policy == "overwrite"):
            vault.write(name, text)
            return name, "written", None
        if policy == "overwrite":
            return None, None, "NOTE_ID_MISMATCH"
        stem = re.sub(r"(?i)\.md\Z", "", name)
        for k in range(1, VERSIONS + 1):
            target = f"{stem}_更新-{stamp}{f'-{k}' if k > 1 else ''}.md"
            if (there := vault.read(target)) is None:
                vault.write(target, text)
            if there is None or there == text:
                return target, "versioned", None
        return None, None, "VERSION_CONFLICT"
    except (TimeoutError, ConnectionError, PermissionError, ValueError) as e:
        return None, None, str(e)


def put_notes(notes: DataFrame, base: str, key: str, folder: str, stamp: str, timeout: float = VAULT_TIMEOUT) -> DataFrame:
    """Stores notes (pos, filename, markdown, note_id, policy) and returns pos, target, action, error.

    Notes with one name go one after another, by pos, so that a later one sees an earlier one; a name has no
    more than VERSIONS versions. A version that already holds a note's very text is taken for an earlier try
    of the same task, so identical notes of one batch share a version. A null name is an error; a null text is empty.
    """

    def put(batches):
        vault = Vault(base, key, folder, timeout)
        for batch in batches:
            rows = batch.to_pylist()
            done = [put_note(vault, r["filename"], r["markdown"] or "", r["note_id"], r["policy"], stamp) if r["filename"] else (None, None, "FILENAME_INVALID") for r in rows]
            columns = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([r["pos"] for r in rows], pa.int64()), *(pa.array(list(c), pa.string()) for c in columns)], ["pos", "target", "action", "error"])

    rows = notes.select(F.col("pos").cast("long").alias("pos"), "filename", "markdown", "note_id", "policy")
    return rows.repartition("filename").sortWithinPartitions("filename", "pos").mapInArrow(put, "pos long, target string, action string, error string")
