"""Markdown with front matter: rendering, reading ids back, attaching results to images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import clean_body, trim, yaml_list, yaml_string

#: Headings by language.
HEADINGS = {"zh-CN": ("正文", "图片文字", "图片"), "zh-TW": ("正文", "圖片文字", "圖片"), "en": ("Content", "Text from images", "Image")}
#: Front matter keys in order, with the note's fields.
FRONT = [("title", "title"), ("source", "url"), ("platform", "platform"), ("note_id", "id"), ("author", "author_name"), ("author_id", "author_id"), ("published_at", "published_at"), ("captured_at", "captured_at")]
COUNTS = [("liked_count", "liked"), ("collected_count", "collected"), ("comment_count", "comment"), ("shared_count", "shared")]


def attach_results(images: Column, results: Column) -> Column:
    """Images with the result at their own place."""
    return F.transform(images, lambda image, i: image.withField("ocr", F.get(results, i)))


def markdown(language: str = "en", include_ocr: bool = False, tags: str = "tags", metrics: str = "metrics", ocr: str = "ocr") -> Column:
    """Rendered note. ocr: array<struct<image_index, text>> of cleaned results by image."""
    body_head, text_head, image_head = HEADINGS[language]
    found = F.coalesce(F.col(ocr), F.array().cast("array<struct<image_index:int,text:string>>")) if include_ocr else F.array().cast("array<struct<image_index:int,text:string>>")
    lines = [F.lit("---"), *(F.concat(F.lit(f"{key}: "), yaml_string(F.col(field))) for key, field in FRONT), F.concat(F.lit("tags: "), yaml_list(F.col(tags)))]
    lines += [F.concat(F.lit(f"{key}: "), yaml_string(F.col(f"{metrics}.{field}"))) for key, field in COUNTS]
    lines += [F.lit(f"ocr: {str(include_ocr).lower()}"), F.concat(F.lit("ocr_image_count: "), F.size(found).cast("string")), F.lit("---")]
    body = clean_body(F.coalesce(F.col("body"), F.lit("")))
    images = F.array_join(F.transform(found, lambda r: F.concat(F.lit(f"### {image_head} "), (r["image_index"] + 1).cast("string"), F.lit("\n\n"), clean_body(r["text"]))), "\n\n")
    sections = F.concat_ws("\n\n", F.concat_ws("\n", *lines), F.concat(F.lit("# "), F.col("title")), F.when(body != "", F.concat(F.lit(f"## {body_head}\n\n"), body)), F.when(F.size(found) > 0, F.concat(F.lit(f"## {text_head}\n\n"), images)))
    return F.concat(sections, F.lit("\n"))


def read_note_id(text: Column) -> Column:
    """The id in a rendered note's front matter; null unless it is a JSON string that isn't blank."""
    raw = F.regexp_extract(text, r"(?m)^note_id:\s*(.+?)\s*$", 1)
    value = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(raw.rlike(r'\A"(?:[^"\\]|\\.)*"\z') & (trim(value) != ""), value)


def ocr_of(images: DataFrame, note: str = "note_id") -> DataFrame:
    """Cleaned results per note as the array that markdown() takes."""
    return images.groupBy(note).agg(F.array_sort(F.collect_list(F.struct("image_index", "text"))).alias("ocr"))
