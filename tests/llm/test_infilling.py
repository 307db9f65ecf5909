"""Infilling against a plain cut, its round trip, its lazy passes and odd rows."""

import hashlib
import re
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import infilling
from test_llm import DATA, ODD, docs_of, texts


def plainly(doc_id, text):
    """The contract word by word."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_every_document_equals_the_contract(spark):
    ours = {r[0]: tuple(r)[1:] for r in infilling.fill_in_middle(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert ours == {i: plainly(i, t) for i, t in texts()}
    assert {r[1] for r in ours.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [*ODD, (20, "has <M> inside"), (21, "<"), (22, "<P<S<M"), (23, "😀é́ x" * 9), (24, "a\x00b\r\n"), (25, "P>S>M>" * 5)]
    made = infilling.fill_in_middle(docs_of(spark, rows))
    kept = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in kept))) == sorted(map(str, ((i, *plainly(i, t)) for i, t in rows)))
    assert sorted((str(r.doc_id), r.back) for r in kept) == sorted((str(i), t or "") for i, t in rows)
    assert infilling.fill_in_middle(docs_of(spark, [])).collect() == []


@given(st.text(alphabet="<>PSMab é\n", max_size=40), st.integers(0, 50), st.integers(0, 50))
def test_cuts_equal_those_of_a_list(text, x, y):
    for unit in (infilling.CODE_POINT, r"\w+", r"[^ ]", r"\S+\s*"):
        pattern = re.compile(unit)
        ends = [0] + [m.end() for m in pattern.finditer(text)]
        n = infilling.counted(pattern, text)
        assert n == len(ends) - 1
        low, high = sorted((x % (n + 1), y % (n + 1)))
        assert infilling.cuts(pattern, text, low, high) == (ends[low], ends[high])


def test_no_list_of_units(spark):
    text, pattern = "word and " * 200_000, re.compile(r"\S+")
    tracemalloc.start()
    n = infilling.counted(pattern, text)
    infilling.cuts(pattern, text, n // 3, n - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 20_000


def test_other_units_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"one two  three {i} four\n") for i in range(200)], "doc_id int, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    rows = infilling.fill_in_middle(docs, unit=r"\S+", seed=9, plain=0, suffix_first=50, marks=marks)
    rows = rows.withColumn("back", infilling.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.n for r in rows} == {5} and {r.form for r in rows} == {"psm", "spm"}
    assert all(r.back == f"one two  three {r.doc_id} four\n" for r in rows)
    assert all(r.output.split(marks[2])[1] == "" or not r.output.split(marks[2])[1][-1].isspace() for r in rows)
    for bad in (dict(unit=r"\d*"), dict(marks=("ab", "bc", "x")), dict(marks=("aa", "b", "c")), dict(marks=("", "b", "c"))):
        with pytest.raises(ValueError):
            infilling.fill_in_middle(docs, **bad)
