"""From pages to stored notes: one job of extraction, image selection, recognised texts, cleaning, rendering and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.names import SITE, SiteProfile, markdown_filename, note_id
from postmill.functions.ranges import selection
from postmill.operators import export, extract, lines, render
from postmill.session import materialise


def note_job(pages: DataFrame, key: str, results: DataFrame, vault: DataFrame, *, captured_at: str, stamp: str, mode: str = "all", pages_wanted: str = "", language: str = "zh-CN", site: SiteProfile = SITE, most: int | None = 100) -> DataFrame:
    """key, note_id, filename, target, action, error and markdown of every page.

    pages: key (one row each), url, html, policy. results: key, image_index, text, lines of what was recognised in the
    images; ones of images that aren't selected or that have no text count for nothing, and a note whose images gave none
    is stored without. vault: filename, note_id; a name has at most `most` versions there. What fails has its error and goes no further; the rest goes on.

    Images are cleaned twice, as a recogniser hands them on: each by itself, by geometry where it has lines, and then the
    texts of a note together, where a long line stays only where it stands first.
    """
    own_id = note_id(F.col("url"), site)
    found = materialise(extract.extract(pages.select(key, "url", "html", "policy"), site).drop("html"), "notes")
    notes = extract.normalise(found, captured_at).withColumn("_wanted", selection(F.lit(mode), F.lit(pages_wanted), F.size("images")))
    unfit = F.coalesce("error", extract.consistency_error(F.col("id"), own_id, F.col("images")), F.concat(F.lit("OCR_SELECTION:"), F.col("_wanted.error")))
    notes = notes.withColumn("error", unfit).withColumn("_wanted", F.col("_wanted.indexes"))
    failed = notes.where("error is not null").select(key, F.col("id").alias("note_id"), *(F.lit(None).cast("string").alias(c) for c in ("filename", "target", "action")), "error", F.lit(None).cast("string").alias("markdown"))
    good = notes.where("error is null")

    wanted = good.select(key, F.explode("_wanted").alias("image_index"))
    chosen = results.join(wanted, [key, "image_index"], "left_semi").withColumn("_image", F.struct(key, "image_index"))
    single = lines.clean_images(chosen, "_image", "image_index").select(F.col(f"_image.{key}").alias(key), "image_index", "text")
    texts = lines.clean_images(single, key, "image_index").withColumn("image_index", F.col("image_index").cast("int"))
    rendered = good.join(render.ocr_of(texts, key), key, "left").withColumn("markdown", render.markdown(language, include_ocr=True))
    named = rendered.select(key, F.col("id").alias("note_id"), "policy", markdown_filename(F.col("title"), F.col("author_name"), F.col("published_at"), captured_at[:10]).alias("filename"), "markdown")
    named = materialise(named, "rendered")  # ranks and joins below read it several times
    planned = export.settle(named.drop("markdown"), vault, [key], F.to_timestamp(F.lit(stamp)), most)
    stored = planned.join(named.select(key, "markdown"), key).withColumn("markdown", F.when(F.col("action").isin("write", "versioned"), F.col("markdown")))
    return stored.select(*failed.columns).unionByName(failed)


def history_of(jobs: DataFrame, output: str, completed_at: str) -> DataFrame:
    """What a job adds to the history: note_id, output, filename, completed_at of what was stored; skipped notes aren't."""
    return jobs.where(F.col("action").isin("write", "versioned")).select("note_id", F.lit(output).alias("output"), F.col("target").alias("filename"), F.lit(completed_at).alias("completed_at"))
