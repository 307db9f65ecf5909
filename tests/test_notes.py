"""Export plans against one note after another, and the job from pages to notes."""

import random

from pyspark.sql import functions as F

from postmill.operators import export, notes

STAMP = "2026-01-02 03:04:05"


def one_by_one(incoming, vault):
    """What happens to each note when they are stored singly, in order."""
    there, out = {}, {}
    for name, note in sorted(vault):
        there.setdefault(name, note)
    for pos, name, note, policy in sorted(incoming):
        if name not in there:
            there[name] = note
            out[pos] = ("write", name, None)
            continue
        same = there[name] == note
        if same and policy in ("skip", "overwrite"):
            out[pos] = ({"skip": "skipped", "overwrite": "write"}[policy], name, None)
        elif policy == "overwrite":
            out[pos] = (None, None, "NOTE_ID_MISMATCH")
        else:
            names = (f"{name.removesuffix('.md')}_更新-20260102-030405{f'-{k}' if k > 1 else ''}.md" for k in range(1, 5))
            free = next((n for n in names if n not in there), None)
            if free:
                there[free] = note
            out[pos] = ("versioned", free, None) if free else (None, None, "VERSION_CONFLICT")
    return out


def test_batches_are_settled_as_one_by_one(spark):
    rng = random.Random(5)
    versions = [f"f{i}_更新-20260102-030405{s}.md" for i in range(4) for s in ("", "-2")]
    for _ in range(3):
        incoming = [(pos, f"f{rng.randrange(9)}.md", f"n{pos}", rng.choice(("skip", "overwrite", "new-version"))) for pos in range(40)]
        vault = [(f"f{i}.md", rng.choice([f"n{p}" for p, name, *_ in incoming if name == f"f{i}.md"] or ["z"])) for i in range(4)] + [(v, "y") for v in rng.sample(versions, 3)]
        rows = spark.createDataFrame(incoming, "pos int, filename string, note_id string, policy string")
        made = export.settle(rows, spark.createDataFrame(vault, "filename string, note_id string"), ["pos"], F.to_timestamp(F.lit(STAMP)), most=4)
        assert {r.pos: (r.action, r.target, r.error) for r in made.collect()} == one_by_one(incoming, vault)
    none = rows.where("pos < 0")
    assert export.settle(none, spark.createDataFrame([], "filename string, note_id string"), ["pos"], F.to_timestamp(F.lit(STAMP))).collect() == []


def page(number, images):
    urls = ", ".join(f'{{"urlDefault": "https://sns.xhscdn.com/{number}-{i}.jpg"}}' for i in range(images))
    return f'<script>window.__INITIAL_STATE__={{"note":{{"noteDetailMap":{{"n{number}":{{"note":{{"noteId":"n{number}","title":"Title {number}","desc":"Body","user":{{"nickname":"A"}},"imageList":[{urls}]}}}}}}}}}}</script>'


def test_the_whole_job(spark):
    site = "https://www.xiaohongshu.com/explore/"
    rows = [(1, f"{site}n1", page(1, 3), "skip"), (2, f"{site}n2", page(2, 0), "skip"), (3, "https://foreign.example.org/n3", page(3, 1), "skip"), (4, f"{site}other", page(4, 1), "skip"), (5, f"{site}n5", page(5, 3), "overwrite"), (6, f"{site}n6", page(6, 2), "skip")]
    pages = spark.createDataFrame(rows, "k int, url string, html string, policy string")
    footer = "This footer stands on every one of them"
    box = lambda top: [{"x": float(x), "y": float(y)} for x, y in ((0, top), (99, top), (99, top + 20), (0, top + 20))]
    seen = [(1, 0, "", [("one", 1.0, box(0)), ("line", 1.0, box(22)), (footer, 1.0, box(90))]), (1, 1, f"second\n{footer}", []), (1, 2, "not selected", []), (5, 0, "", []), (6, 0, "six", [])]
    results = spark.createDataFrame(seen, "k int, image_index int, text string, lines array<struct<text:string,score:double,poly:array<struct<x:double,y:double>>>>")
    vault = spark.createDataFrame([("Title 6_A_2026-01-02.md", "n6")], "filename string, note_id string")
    made = notes.note_job(pages, "k", results, vault, captured_at="2026-01-02T03:04:05.000Z", stamp=STAMP, mode="custom", pages_wanted="1-2")
    got = {r.k: r for r in made.collect()}
    assert {k: (r.action, r.target, r.error) for k, r in got.items()} == {
        1: ("write", "Title 1_A_2026-01-02.md", None),
        2: (None, None, "NO_IMAGES"),
        3: (None, None, "unsupported"),
        4: (None, None, "TITLE_MISMATCH"),
        5: ("write", "Title 5_A_2026-01-02.md", None),
        6: ("skipped", "Title 6_A_2026-01-02.md", None),
    }
    assert f"## 图片文字\n\n### 图片 1\n\none line\n\n{footer}\n\n### 图片 2\n\nsecond\n" in got[1].markdown and "not selected" not in got[1].markdown
    assert "ocr_image_count: 0" in got[5].markdown and got[6].markdown is None
    assert sorted(r.note_id for r in notes.history_of(made, "vault", "2026-01-02").collect()) == ["n1", "n5"]
