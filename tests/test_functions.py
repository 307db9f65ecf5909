import random

import pytest
from plain_paragraphs import folded, glued, repaired
from pyspark.sql import Row
from pyspark.sql import functions as F

from postmill.functions import names as N
from postmill.functions import ranges as R
from postmill.functions import text as T
from postmill.operators import jobs, lines, metrics, render, scan
from postmill.operators.paragraphs import paragraphs


def value(spark, column, **fields):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in fields.items()) or "x int"
    row = tuple(v for _, v in fields.values()) or (1,)
    return spark.createDataFrame([row], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [("contribution?Am I ready", "contribution? Am I ready"), ("他非常关注AI，也申请Harvard项目", "他非常关注 AI，也申请 Harvard 项目"), (" a , b ( c ) ", "a, b (c)"), ("end.Next 3.14", "end. Next 3.14")])
def test_repair_spacing(spark, given, want):
    assert value(spark, T.repair_spacing(F.col("t")), t=("string", given)) == want
    assert repaired(given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("exam-", "ple", "example"), ("of", "the", "of the"), ("项目", "MIT", "项目 MIT"), ("x", "3", "x 3"), ("普林", "斯顿", "普林斯顿"), ("end.", "Next", "end. Next")])
def test_join_wrapped(spark, a, b, want):
    assert value(spark, T.join_wrapped(F.col("a"), F.col("b")), a=("string", a), b=("string", b)) == want
    assert glued(a, b) == want


def test_tags_and_dates(spark):
    tags = T.distinct_tags(F.col("t"))
    assert value(spark, tags, t=("array<string>", ["旅行", "#旅行[话题]#", "旅行", " "])) == ["旅行"]
    assert value(spark, T.inline_tags(F.col("b")), b=("string", "正文 #旅行[话题]# #杭州[话题]#")) == ["旅行[话题]", "杭州[话题]"]
    for given, want in [("1753516200", "2025-07-26T07:50:00.000Z"), ("06-26", "06-26"), ("", None), ("gestern", "gestern"), ("9999999999", "2286-11-20T17:46:39.000Z"), ("10000000000", "1970-04-26T17:46:40.000Z"), (None, None)]:
        assert value(spark, T.iso_date(F.col("d")), d=("string", given)) == want


def test_search_key(spark):
    assert value(spark, T.search_key(F.col("t")), t=("string", "新二 ＣＳ 专业大盘点-其他泛 CS 篇")) == "新二cs专业大盘点其他泛cs篇"
    rows = spark.createDataFrame([("新二CS专业",), ("其他",)], "title string")
    assert [r.title for r in scan.keyword_filter(rows, "新二 cs").collect()] == ["新二CS专业"]
    assert scan.keyword_filter(rows, " ").count() == 2
    assert scan.keyword_filter(rows, " ", empty_matches=False).count() == 0


@pytest.mark.parametrize(("url", "want"), [("https://www.xiaohongshu.com/user/profile/author/6a4def78000000002103e295?xsec_token=token", "6a4def78000000002103e295"), ("https://www.xiaohongshu.com/explore/abc123", "abc123"), ("https://www.xiaohongshu.com/search_result/search456", "search456"), ("https://www.xiaohongshu.com/discovery/item/xyz789", "xyz789"), ("https://www.xiaohongshu.com/x?note_id=q%201", "q 1"), ("https://example.com/explore/abc123", ""), ("not a url", ""), (None, "")])
def test_note_id(spark, url, want):
    assert value(spark, N.note_id(F.col("u")), u=("string", url)) == want


@pytest.mark.parametrize(("text", "count"), [("1,3-5", 4), ("1-3,2-4", 4), ("1，3至5", 4), ("", None), ("5-3", None), ("1,,3", None)])
def test_page_count(spark, text, count):
    assert value(spark, R.page_count(F.col("r")), r=("string", text)) == count


@pytest.mark.parametrize(("mode", "text", "total", "want", "error"), [("all", "", 4, [0, 1, 2, 3], None), ("skip-cover", "", 4, [1, 2, 3], None), ("skip-cover", "", 1, None, "no-images"), ("custom", "1，3至5,3", 6, [0, 2, 3, 4], None), ("custom", "", 4, None, "range-required"), ("custom", "1,,3", 4, None, "range-invalid"), ("custom", "4-2", 4, None, "range-out-of-bounds"), ("custom", "2-5", 4, None, "range-out-of-bounds")])
def test_selection(spark, mode, text, total, want, error):
    got = value(spark, R.selection(F.col("m"), F.col("r"), F.col("n")), m=("string", mode), r=("string", text), n=("int", total))
    assert (got["indexes"], got["error"]) == (want, error)


def test_page_list(spark):
    assert value(spark, R.page_list(F.col("i")), i=("array<int>", [0, 2, 3, 4, 6])) == "1,3-5,7"
    assert value(spark, R.page_list(F.col("i")), i=("array<int>", [])) == ""


def test_file_names(spark):
    name = N.markdown_filename(F.col("t"), F.col("a"), F.col("d"), "2026-07-29")
    assert value(spark, name, t=("string", "A/B:C*D?"), a=("string", "作者<>|"), d=("string", "2026-07-26T08:30:00.000Z")) == "A B C D_作者_2026-07-26.md"
    at = F.lit("2026-08-23 14:05:09").cast("timestamp")
    assert value(spark, N.versioned_filename(F.col("f"), at, F.lit(1)), f=("string", "文章_作者_2026-08-23.md")) == "文章_作者_2026-08-23_更新-20260823-140509.md"
    assert value(spark, N.versioned_filename(F.col("f"), at, F.lit(2)), f=("string", "文章.md")) == "文章_更新-20260823-140509-2.md"
    assert value(spark, N.note_path(F.lit("a"), F.col("f")), f=("string", "../note.md"))["error"] == "FILENAME_INVALID"
    assert value(spark, N.note_path(F.lit("a"), F.col("f")), f=("string", "note.txt"))["error"] == "FILENAME_INVALID"
    assert value(spark, N.encode_path(F.col("p")), p=("string", "a b/(c)!~'*é.md")) == "a%20b/(c)!~'*%C3%A9.md"


LINE = "array<struct<text:string,score:double,poly:array<struct<x:double,y:double>>>>"


def line(text, top, left=0.0):
    corners = [(left, top), (left + 400, top), (left + 400, top + 20), (left, top + 20)]
    return {"text": text, "score": 0.99, "poly": [{"x": float(x), "y": float(y)} for x, y in corners]}


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([("Please consider this letter a formal", 0), ("endorsement of your talent.", 24), ("New paragraph starts here.", 70)], "Please consider this letter a formal endorsement of your talent.\n\nNew paragraph starts here."),
        ([("1. First item", 0), ("2. Second item", 24)], "1. First item\n\n2. Second item"),
        ([("申请结果", 0), ("这是一段新的正文。", 55), ("第一段已经结束。", 105), ("第二段从这里开始。", 155)], "申请结果\n\n这是一段新的正文。\n\n第一段已经结束。\n\n第二段从这里开始。"),
        ([("普林", 0), ("斯顿项目", 90)], "普林\n\n斯顿项目"),
        ([("MIT Sloan 金融硕士：高性价比", 0), ("的顶级入场券", 50), ("你会发现 MIT 的入门难度更容易够到。 普林", 100), ("斯顿 MFin 对研究要求更高。", 150)], "MIT Sloan 金融硕士：高性价比的顶级入场券\n\n你会发现 MIT 的入门难度更容易够到。 普林斯顿 MFin 对研究要求更高。"),
    ],
)
def test_paragraphs(spark, given, want):
    rows = [line(t, float(y)) for t, y in given]
    assert folded(rows) == want
    assert spark.createDataFrame([(rows,)], f"l {LINE}").select(paragraphs(F.col("l")).alias("t")).first().t == want


def test_paragraphs_equal_a_plain_fold(spark):
    draw, rows = random.Random(8), []
    words = ["one", "two-", "Three", "汉字", "的", "，", "end.", "完。", "”", ")", "?", "1. item", "- x", "a)", "x:", "[", "(", "42", "7", "B", " ", "", "\t", "·", "done!”", "é", "-", "了么", "三个字", "ok,then", "我"]
    for i in range(1500):
        made, top = [], 0.0
        for _ in range(draw.randrange(1, 9)):
            top += draw.choice([22, 24, 30, 36, 45, 60, 90])
            left, tall = draw.choice([0, 0, 0, 5, 25, 60]), draw.choice([18, 20, 20, 20, 24, 30])
            made.append({"text": draw.choice(["", " "]).join(draw.choice(words) for _ in range(draw.randrange(0, 4))), "score": 1.0, "poly": [{"x": float(x), "y": float(y)} for x, y in ((left, top), (left + 99, top), (left + 99, top + tall), (left, top + tall))][: 4 if draw.random() < 0.99 else 3]})
        rows.append((i, made))
    got = {r.i: r.t for r in spark.createDataFrame([*rows, (-1, None), (-2, [])], f"i int, l {LINE}").select("i", paragraphs(F.col("l")).alias("t")).collect()}
    assert (got.pop(-1), got.pop(-2)) == ("", "")
    different = [(made, got[i], folded(made)) for i, made in rows if got[i] != folded(made)]
    assert not different, (len(different), [x["text"] for x in different[0][0]], different[0][1:])


def test_clean_images_drops_long_lines_seen_before(spark):
    footer = "this footer is on every single image"
    rows = [("n", i, "", [line(f"unique line number {i}", 0.0), line(footer, 80.0)]) for i in (0, 1)] + [("n", 2, "第一张图\nHello", [])]
    got = {r.image_index: r.text for r in lines.clean_images(spark.createDataFrame(rows, f"note_id string, image_index int, text string, lines {LINE}")).collect()}
    assert footer in got[0] and footer not in got[1] and got[2] == "第一张图\nHello"


def test_collapse_adjacent(spark):
    rows = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate([("Hello!", 0.8), ("hello", 0.9), ("x", 0.5), ("Hello", 0.7)])], "k int, n int, text string, score double")
    got = lines.collapse_adjacent(rows, ["k"], ["n"], "text", "score").orderBy("n").collect()
    assert [(r.text, r.score) for r in got] == [("hello", 0.9), ("x", 0.5), ("Hello", 0.7)]


def test_candidates_fold(spark):
    rows = spark.createDataFrame([("a", 0, "u0", "ab", None), ("a", 1, "u1", "abcd", "Z"), ("a", 2, "u2", "abce", "Y")], "k string, pos int, href string, title string, author string")
    got = scan.candidates(rows, ["k"], ("author",)).first()
    assert (got.title, got.author, got.pos) == ("abcd", "Z", 0)


def test_estimates(spark):
    got = jobs.remaining_ms(F.lit("running"), F.lit("recognizing-images"), F.lit(4000.0), F.lit(2.0), F.lit(4000.0), F.lit(1000.0))
    assert value(spark, got) == 7100
    assert value(spark, jobs.remaining_ms(F.lit("completed"), F.lit("finalizing"), F.lit(0.0), F.lit(0.0), F.lit(500.0), F.lit(0.0))) == 0
    assert value(spark, jobs.remaining_ms(F.lit("paused"), F.lit("finalizing"), F.lit(0.0), F.lit(0.0), F.lit(500.0), F.lit(0.0))) is None
    live = jobs.live_durations(F.col("d"), F.lit("creating-sessions"), F.lit("running"), F.lit(8000), F.lit(9000))
    assert value(spark, jobs.initialization_ms(live), d=("map<string,bigint>", {"loading-runtime": 120, "loading-models": 150})) == 1270
    assert value(spark, metrics.nearest_rank(F.col("x"), 0.5), x=("array<double>", [1.0, 2.0, 3.0, 4.0])) == 3


NOTE = "id string, title string, url string, platform string, author_name string, author_id string, published_at string, captured_at string, tags array<string>, metrics struct<liked:string,collected:string,comment:string,shared:string>, body string, ocr array<struct<image_index:int,text:string>>"


def test_markdown(spark):
    note = ("abc123", '周末散步：路线 "A"', "u", "p", "小林", "user-1", "2026-07-26T08:30:00.000Z", "2026-07-28T10:00:00.000Z", ["杭州", "散步"], ("128", "54", "12", None), "第一段\n\n第二段", [Row(image_index=0, text="第一张图\nHello")])
    df = spark.createDataFrame([note], NOTE)
    text = df.select(render.markdown("zh-CN", True).alias("m")).first().m
    for part in ('title: "周末散步：路线 \\"A\\""', 'tags: ["杭州", "散步"]', "ocr: true", "ocr_image_count: 1", "## 正文\n\n第一段\n\n第二段", "## 图片文字\n\n### 图片 1\n\n第一张图\nHello"):
        assert part in text
    assert "### 图片 2" not in text and text.endswith("\n")
    plain = df.select(render.markdown("en").alias("m")).first().m
    assert "ocr: false" in plain and "## Content" in plain and "Text from images" not in plain
    read = lambda m: value(spark, render.read_note_id(F.col("m")), m=("string", m))
    assert (read(text), read("---\ntitle: x\n---"), read("note_id: not-json")) == ("abc123", None, None)
