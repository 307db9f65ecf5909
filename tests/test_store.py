"""Stored tables: versions, readers beside writers, crashes, compaction."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from postmill.operators import export, state
from postmill.operators.store import Store

SCHEMA = "note string, output string, at long, file string"


def history(spark, path, most=5):
    return export.history_store(spark, path, SCHEMA, ["note", "output"], [(-F.col("at")).alias("late")], most)


def rows(spark, *cells):
    return spark.createDataFrame(list(cells), SCHEMA)


def held(store, number=None):
    return sorted((r.note, r.output, r.at) for r in store.read(number).collect())


def test_upserts_survive_compaction_and_old_readers(spark, tmp_path):
    store = history(spark, str(tmp_path / "h"))
    assert held(store) == [] and store.compact() == 1 and held(store) == []
    store.append(rows(spark, *((f"n{i}", "download", i, "f") for i in range(7))))
    before = store.read()
    number = store.version()[0]
    store.append(rows(spark, ("n3", "download", 10, "g"), ("n3", "vault", 11, "g")))
    newest = [("n3", "download", 10), ("n3", "vault", 11), ("n4", "download", 4), ("n5", "download", 5), ("n6", "download", 6)]
    assert held(store) == newest
    store.compact()
    assert held(store) == newest and store.version()[1]["log"] == []
    assert len(before.collect()) == 5 and held(store, number) == [(f"n{i}", "download", i) for i in range(2, 7)]  # a reader of an older version
    gone = store.clean(keep=1)
    assert len(gone) == 3 and held(store) == newest
    store.append(rows(spark, ("n9", "download", 12, "h")))
    assert held(history(spark, str(tmp_path / "h"))) == sorted([*newest, ("n9", "download", 12)])[0:2] + [("n5", "download", 5), ("n6", "download", 6), ("n9", "download", 12)]


def test_a_crash_between_write_and_swap_stores_nothing(spark, tmp_path, monkeypatch):
    store = history(spark, str(tmp_path / "h"))
    store.append(rows(spark, ("a", "download", 1, "f")))

    def crash(*_):
        raise RuntimeError("killed")

    for step in (lambda: store.append(rows(spark, ("b", "download", 2, "f"))), store.compact):
        monkeypatch.setattr(Store, "put_version", crash)
        with pytest.raises(RuntimeError):
            step()
        monkeypatch.undo()
        assert held(history(spark, str(tmp_path / "h"))) == [("a", "download", 1)]
    assert len(store.clean()) == 2
    store.append(rows(spark, ("b", "download", 2, "f")))
    assert held(store) == [("a", "download", 1), ("b", "download", 2)]


def test_a_faster_writer_is_met_and_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    mine, other = history(spark, path), history(spark, path)
    mine.append(rows(spark, ("a", "download", 1, "f")))
    stale = mine.version()
    other.append(rows(spark, ("b", "download", 2, "f")))
    once = [stale]
    monkeypatch.setattr(mine, "version", lambda number=None: once.pop() if once else Store.version(mine, number))
    assert mine.append(rows(spark, ("c", "download", 3, "f"))) == 3
    assert held(other) == [("a", "download", 1), ("b", "download", 2), ("c", "download", 3)]
    # a compaction that another append and then another compaction overtake
    put, tries = mine.put_version, []

    def late(number, content):
        if not tries:
            tries.append(other.append(rows(spark, ("d", "download", 4, "f"))))
        return put(number, content)

    monkeypatch.setattr(mine, "put_version", late)
    mine.compact()
    monkeypatch.undo()
    assert held(other)[-1] == ("d", "download", 4) and len(other.version()[1]["log"]) == 1


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "h")
    store = history(spark, path, 100)
    work = [threading.Thread(target=lambda k=k: [history(spark, path, 100).append(rows(spark, (f"n{k}", "download", i, "f"), (f"m{k}-{i}", "vault", i, "f"))) for i in range(3)]) for k in range(3)]
    for t in work:
        t.start()
    store.compact()
    for t in work:
        t.join()
    assert held(store) == sorted([(f"n{k}", "download", 2) for k in range(3)] + [(f"m{k}-{i}", "vault", i) for k in range(3) for i in range(3)])


def test_state_is_the_same_however_it_is_compacted(spark, tmp_path):
    rng = random.Random(3)
    schema = "key string, id string, value long, cleared boolean, at long"
    log = [(rng.choice("xyz"), rng.choice("ab"), i, rng.random() < 0.4, i) for i in range(60)]
    whole = spark.createDataFrame(log, schema)
    store = state.state_store(spark, str(tmp_path / "s"), schema, ["at"])
    for a in range(0, 60, 20):
        store.append(spark.createDataFrame(log[a : a + 20], schema))
        now = sorted(tuple(r) for r in state.current(whole.where(F.col("at") < a + 20), ["at"]).collect())
        assert sorted((r.key, r.id, r.value) for r in store.read().collect()) == now
        store.compact()
        assert sorted((r.key, r.id, r.value) for r in store.read().collect()) == now
