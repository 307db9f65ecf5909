"""Addresses, file names, vault paths, settings and locales as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import WS, trim
from postmill.sources.html import Selectors

RESERVED = r"[<>:\"/\\|?*\x00-\x1f]"


@dataclass(frozen=True)
class SiteProfile:
    """What depends on the site. Fixed values of the default profile are the site's own forms."""

    host: str = r"(?i)(^|\.)xiaohongshu\.com$"
    note_path: str = r"/(?:explore|search_result|discovery/item|user/profile/[^/]+)/([a-zA-Z0-9]+)"
    id_parameter: str = "note_id"
    title_suffix: str = "小红书"
    selectors: Selectors = Selectors()


SITE = SiteProfile()
#: The shape of the test tables' addresses, /<language>/<number>, and where their pages have what a note has. Their texts
#: were cut after they were escaped, so some end in a part of a reference, which stays as it is.
TEST_SITE = SiteProfile(
    host=r"(?i)\.example\.(com|net|org)$",
    note_path=r"/[a-z]{2}/([a-zA-Z0-9]+)",
    selectors=Selectors(title=("h1",), body=("article",), date=(".ad",), author=("footer",), tags="nav a", liked=("nav a",), collected=("nav a",), comment=("nav",), shared=(".none",), whole_references=True, unmarked=("liked", "collected")),
)


def is_site_url(url: Column, site: SiteProfile = SITE) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).rlike(site.host), F.lit(False))


def note_id(url: Column, site: SiteProfile = SITE) -> Column:
    """The note's id in an address of the site, else an empty text."""
    path = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), site.note_path, 1)
    query = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(site.id_parameter)))
    return F.when(is_site_url(url, site), F.coalesce(F.nullif(path, F.lit("")), query, F.lit(""))).otherwise(F.lit(""))


def is_note_url(url: Column, site: SiteProfile = SITE) -> Column:
    return note_id(url, site) != ""


def scope_label(url: Column, site: SiteProfile = SITE) -> Column:
    """Which kind of page an address shows; a note's address is a note under any of its path forms."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(is_note_url(url, site), "note").when(path.startswith("/search_result"), "search").when(path.startswith("/user/profile/"), "profile").when(path.startswith("/explore"), "feed").otherwise("page")


def safe_part(value: Column, fallback: str = "untitled") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(value, RESERVED, " "), rf"{WS}+", " ")
    return F.coalesce(F.nullif(trim(F.regexp_replace(cleaned, r"[. ]+\z", "")), F.lit("")), F.lit(fallback))


def markdown_filename(title: Column, author: Column, published_at: Column, today: str) -> Column:
    date = F.left(F.coalesce(F.nullif(published_at, F.lit("")), F.lit(today)), F.lit(10))
    base = F.left(F.concat_ws("_", safe_part(title), safe_part(author, "unknown-author"), date), F.lit(150))
    return F.concat(F.regexp_replace(base, r"[. ]+\z", ""), F.lit(".md"))


def versioned_filename(filename: Column, at: Column, collision: Column) -> Column:
    stamp = F.date_format(at, "yyyyMMdd-HHmmss")
    return F.concat(F.regexp_replace(filename, r"(?i)\.md\z", ""), F.lit("_更新-"), stamp, F.when(collision > 1, F.concat(F.lit("-"), collision.cast("string"))).otherwise(F.lit("")), F.lit(".md"))


def note_folder(value: Column) -> Column:
    return F.regexp_replace(F.replace(trim(value), F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")


def api_base(value: Column) -> Column:
    return F.regexp_replace(trim(value), r"/+\z", "")


def api_key(value: Column) -> Column:
    return F.regexp_replace(trim(value), rf"(?i)\ABearer{WS}+", "")


def note_path(folder: Column, filename: Column) -> Column:
    """Struct of path and error: names must end in .md and have no reserved characters."""
    name = trim(filename)
    bad = ~F.lower(name).endswith(".md") | name.rlike(RESERVED)
    return F.struct(F.when(~bad, F.concat(note_folder(folder), F.lit("/"), name)).alias("path"), F.when(bad, F.lit("FILENAME_INVALID")).alias("error"))


def encode_path(path: Column) -> Column:
    """Each segment percent-encoded as in addresses, the slashes kept."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def settings_error(folder: Column, base: Column, key: Column, require_key: bool = True) -> Column:
    """The first rule that a vault's settings break, or null."""
    folder, base, key = note_folder(folder), api_base(base), api_key(key)
    segment = F.exists(F.split(folder, "/"), lambda s: (s == "") | s.isin(".", "..") | s.rlike(r"[\x00-\x1f:*?\"<>|]"))
    shape = r"(?i)\A(https?)://([^/:?#]+):(\d+)\z"
    port = F.regexp_extract(base, shape, 3)
    standard = ((F.lower(F.regexp_extract(base, shape, 1)) == "http") & (port == "80")) | ((F.lower(F.regexp_extract(base, shape, 1)) == "https") & (port == "443"))
    return (
        F.when(folder == "", "note-folder-required")
        .when(segment, "note-folder-invalid")
        .when(base == "", "api-url-required")
        .when(~base.rlike(shape) | standard, "api-url-invalid")
        .when(~F.lower(F.regexp_extract(base, shape, 2)).isin("127.0.0.1", "localhost"), "api-url-not-local")
        .when(F.lit(require_key) & (key == ""), "api-key-required")
    )


def ui_language(tag: Column) -> Column:
    tag = F.lower(F.replace(tag, F.lit("_"), F.lit("-")))
    return F.when(tag.rlike("^zh-tw(-|$)"), "zh-TW").when(tag.rlike("^zh-cn(-|$)"), "zh-CN").otherwise("en")


def effective_language(tag: Column, previewed: Column) -> Column:
    """The language that a preview asks for, if it is one of the three, else that of the tag."""
    return F.when(previewed.isin("en", "zh-CN", "zh-TW"), previewed).otherwise(ui_language(F.coalesce(tag, F.lit("en"))))


def message(catalogue: dict[str, str], key: Column, *values: Column) -> Column:
    """A catalogue's text for a key with $1, $2, ... filled in; the key itself if it is unknown."""
    listed = F.create_map(*(F.lit(x) for pair in catalogue.items() for x in pair)) if catalogue else F.create_map().cast("map<string,string>")
    out = F.coalesce(F.try_element_at(listed, key), key)
    for i, value in reversed(list(enumerate(values, 1))):
        out = F.replace(out, F.lit(f"${i}"), value.cast("string"))
    return out


def api_error(status: Column) -> Column:
    """HTTP status as an error code; null for success."""
    return F.when(status.isin(401, 403), "UNAUTHORIZED").when(~status.between(200, 299), F.concat(F.lit("HTTP_ERROR:"), status.cast("string")))
