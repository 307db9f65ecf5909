"""Notes out of pages: embedded state first, the document's elements where there is none."""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.names import SITE, SiteProfile, is_site_url, note_id
from postmill.functions.text import distinct_tags, first_text, https_image, inline_tags, iso_date, strip_site_suffix, trim
from postmill.operators.scan import plain_text, unescape
from postmill.sources.html import Page, note_fields

NOTE = "id string, title string, body string, author_id string, author_name string, author_avatar string, image_urls array<string>, tags array<string>, published_at string, metrics struct<liked:string,collected:string,comment:string,shared:string>"
#: Where the embedded state is and under which names its fields come.
STATE = r"(?s)__INITIAL_STATE__\s*=\s*(\{.*?\})\s*(?:;\s*)?</script>"
MAPS = ("$.note.noteDetailMap.value", "$.note.noteDetailMap._value", "$.note.noteDetailMap")
IMAGE = "array<struct<urlDefault:string,urlPre:string,url:string,infoList:array<struct<imageScene:string,url:string>>>>"


def at(json: Column, *paths: str) -> Column:
    """The first of several fields of a JSON text that isn't blank."""
    return first_text(*(F.get_json_object(json, f"$.{p}") for p in paths))


def meta_content(html: Column, name: str) -> Column:
    """The content of the first meta element of that property or name; an empty text without one."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*[\"']{re.escape(name)}[\"'])[^>]*>", 0)
    return trim(unescape(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*([\"'])(.*?)\1", 2)))


def from_state(pages: DataFrame, site: SiteProfile = SITE) -> DataFrame:
    """Adds data (null without embedded state). The entry whose own id is the address's wins, after it the
    preferred key's entry, then the first one in the document's order."""
    # the state is a script's object: what it leaves undefined is none in JSON
    state = F.regexp_replace(F.nullif(F.regexp_extract("html", STATE, 1), F.lit("")), r"(?<=[:,\[])\s*undefined(?=\s*[,}\]])", "null")
    entries = F.coalesce(*(F.map_entries(F.from_json(F.get_json_object(state, p), "map<string,string>")) for p in MAPS))
    rows = pages.withColumn("_entries", entries).withColumn("_url_id", note_id(F.col("url"), site))

    def rank(entry: Column, pos: Column) -> Column:
        note = F.coalesce(F.get_json_object(entry["value"], "$.note"), F.get_json_object(entry["value"], "$.data.note"), entry["value"])
        return F.get(F.transform(F.array(note), lambda n: F.struct((at(n, "noteId", "note_id", "id") != F.col("_url_id")).alias("other"), (entry["key"] != F.col("_url_id")).alias("key"), pos.alias("pos"), n.alias("note"))), 0)  # read once

    note = F.array_min(F.transform("_entries", rank))["note"]
    rows = rows.withColumn("_note", note)
    n, user, counted = F.col("_note"), F.col("_user"), F.col("_counts")
    rows = rows.withColumn("_user", F.get_json_object(n, "$.user")).withColumn("_counts", F.get_json_object(n, "$.interactInfo"))
    tags = F.transform(F.from_json(F.get_json_object(n, "$.tagList"), "array<struct<name:string,title:string>>"), lambda t: first_text(t["name"], t["title"]))
    listed = F.coalesce(F.from_json(F.get_json_object(n, "$.imageList"), IMAGE), F.from_json(F.get_json_object(n, "$.images"), IMAGE))
    images = F.transform(listed, lambda i: https_image(first_text(i["urlDefault"], i["urlPre"], i["url"], F.get(F.filter(i["infoList"], lambda x: F.contains(F.lower(x["imageScene"]), F.lit("wb_dft"))), F.lit(0))["url"], F.get(i["infoList"], F.lit(0))["url"])))
    body = at(n, "desc", "description", "content")
    counts = {"liked": ("likedCount", "liked_count"), "collected": ("collectedCount", "collected_count"), "comment": ("commentCount", "comment_count"), "shared": ("shareCount", "sharedCount", "share_count")}
    none = F.array().cast("array<string>")
    data = F.struct(
        F.coalesce(F.nullif(at(n, "noteId", "note_id", "id"), F.lit("")), "_url_id").alias("id"),
        first_text(at(n, "title"), meta_content(F.col("html"), "og:title"), plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
        body.alias("body"),
        at(user, "userId", "user_id", "id").alias("author_id"),
        at(user, "nickname", "nickName", "name").alias("author_name"),
        https_image(at(user, "avatar", "image", "avatarUrl")).alias("author_avatar"),
        distinct_tags(F.coalesce(images, none)).alias("image_urls"),
        distinct_tags(F.coalesce(tags, none), inline_tags(body)).alias("tags"),
        at(n, "time", "publishTime", "publishedAt", "lastUpdateTime").alias("published_at"),
        F.struct(*(at(counted, *fields).alias(name) for name, fields in counts.items())).alias("metrics"),
    )
    return rows.withColumn("data", F.when(n.isNotNull(), data)).drop("_entries", "_url_id", "_note", "_user", "_counts")


DOCUMENT = "struct<title:string,body:string,author_id:string,author_name:string,author_avatar:string,image_urls:array<string>,tags:array<string>,published_at:string,liked:string,collected:string,comment:string,shared:string>"


def document_fields(html: Column, url: Column, site: SiteProfile = SITE) -> Column:
    """Raw fields (DOCUMENT) of a page's elements, by ordered lists of selectors; null of a null page. Only these two
    columns go to Python."""
    where = site.selectors

    @F.arrow_udf(DOCUMENT)
    def read(pages: pa.Array, urls: pa.Array) -> pa.Array:
        kind = pa.struct([(k, pa.list_(pa.string()) if k in ("image_urls", "tags") else pa.string()) for k in ("title", "body", "author_id", "author_name", "author_avatar", "image_urls", "tags", "published_at", "liked", "collected", "comment", "shared")])
        return pa.array([None if page.as_py() is None else note_fields(Page(page.as_py(), where.whole_references), address.as_py() or "", where) for page, address in zip(pages, urls, strict=True)], kind)

    return read.asNondeterministic()(html, url)  # so that no filter on its result makes the plan parse pages twice


def document_data(f: Column, url: Column, site: SiteProfile = SITE) -> Column:
    """A note's data of the raw fields of a page's elements."""
    return F.struct(
        note_id(url, site).alias("id"),
        strip_site_suffix(f["title"], site.title_suffix).alias("title"),
        f["body"].alias("body"),
        *(f[k].alias(k) for k in ("author_id", "author_name")),
        https_image(f["author_avatar"]).alias("author_avatar"),
        distinct_tags(F.transform(f["image_urls"], https_image)).alias("image_urls"),
        distinct_tags(f["tags"], inline_tags(f["body"])).alias("tags"),
        f["published_at"].alias("published_at"),
        F.struct(*(f[k].alias(k) for k in ("liked", "collected", "comment", "shared"))).alias("metrics"),
    )


def extract(pages: DataFrame, site: SiteProfile = SITE) -> DataFrame:
    """Adds data, source and error. Pages are read once; elements are only looked for where there is no embedded state."""
    rows = from_state(pages, site).withColumnRenamed("data", "_state")
    stateless = F.col("_state").isNull()
    rows = rows.withColumn("_f", document_fields(F.when(stateless, F.coalesce("html", F.lit(""))), F.when(stateless, F.col("url")), site))
    rows = rows.withColumn("data", F.coalesce("_state", document_data(F.col("_f"), F.col("url"), site))).withColumn("source", F.when(stateless, "dom").otherwise("initial-state")).drop("_state", "_f")
    error = F.when(~is_site_url(F.col("url"), site) | (note_id(F.col("url"), site) == ""), "unsupported").when((F.col("source") == "dom") & (F.col("data.title") == "") & (F.col("data.body") == ""), "not-found")
    return rows.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


def normalise(rows: DataFrame, captured_at: str, platform: str = "xiaohongshu") -> DataFrame:
    """Extracted data as a note: defaults, numbered images, cover, clean tags and dates. The time is a parameter."""
    d = F.col("data")
    return rows.select(
        *[c for c in rows.columns if c != "data"],
        d["id"].alias("id"),
        F.lit(platform).alias("platform"),
        F.coalesce(F.nullif(d["title"], F.lit("")), F.lit("Untitled Xiaohongshu note")).alias("title"),
        d["body"].alias("body"),
        F.nullif(d["author_id"], F.lit("")).alias("author_id"),
        F.coalesce(F.nullif(d["author_name"], F.lit("")), F.lit("Unknown author")).alias("author_name"),
        F.transform(d["image_urls"], lambda u, i: F.struct(i.alias("index"), u.alias("url"))).alias("images"),
        F.get(d["image_urls"], F.lit(0)).alias("cover"),
        distinct_tags(d["tags"]).alias("tags"),
        iso_date(d["published_at"]).alias("published_at"),
        F.lit(captured_at).alias("captured_at"),
        d["metrics"].alias("metrics"),
    )


def consistency_error(extracted_id: Column, url_id: Column, images: Column) -> Column:
    return F.when(extracted_id != url_id, "TITLE_MISMATCH").when(F.size(images) == 0, "NO_IMAGES")
