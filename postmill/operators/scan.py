"""Page scan: anchors, candidates per note, keyword filter, batch selection."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.names import SITE, SiteProfile, note_id
from postmill.functions.text import collapse, plain_key, search_key, strip_site_suffix

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
LONGEST_TITLE = 180


def unescape(col: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        col = F.replace(col, F.lit(code), F.lit(char))
    return col


def plain_text(html: Column) -> Column:
    return collapse(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "")))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, title of every link with an address, in page order."""
    found = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "pos", unescape(F.regexp_extract("a", ANCHOR, 1)).alias("href"), plain_text(F.regexp_extract("a", ANCHOR, 2)).alias("title"))


def with_preview(links: DataFrame, cards: DataFrame) -> DataFrame:
    """Links with their card's author and its largest image; cards: card_id, author, images (url, w, h)."""
    size = F.transform("images", lambda i, k: F.struct((-(i["w"] * i["h"])).alias("s"), k.alias("k"), i["url"].alias("url")))
    looks = cards.select("card_id", "author", F.array_min(size)["url"].alias("thumbnail"))
    return links.join(looks, "card_id", "left")


def note_links(links: DataFrame, site: SiteProfile = SITE, url: str = "url") -> DataFrame:
    rows = links.withColumn("note_id", note_id(F.col(url), site))
    return rows.where((F.col("note_id") != "") & (F.col("title") != "") & (F.length("title") <= LONGEST_TITLE))


def candidates(links: DataFrame, keys: list[str], extras: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the longest title (the first of equals) with its address.

    An extra is that of the last link that was longer than all before it and had one, or the first
    one found after that; links that are no longer than the longest so far only fill gaps. A running
    maximum tells the two apart, so only the small (position, extra) pairs are gathered per key.
    """
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = links.withColumn("grows", F.length("title") > F.coalesce(F.max(F.length("title")).over(before), F.lit(-1)))
    out = [F.max_by(F.struct("href", "title"), F.struct(F.length("title"), -F.col("pos"))).alias("best"), F.min("pos").alias("pos")]
    for x in extras:
        out += [F.max_by(x, F.when(F.col("grows") & F.col(x).isNotNull(), F.col("pos"))).alias(f"{x}_grown"), F.min_by(x, F.when(F.col(x).isNotNull(), F.col("pos"))).alias(f"{x}_first")]
    return rows.groupBy(*keys).agg(*out).select(*keys, "pos", F.col("best.href").alias("href"), F.col("best.title").alias("title"), *(F.coalesce(f"{x}_grown", f"{x}_first").alias(x) for x in extras))


def current_article(titles: Column, site: SiteProfile = SITE, missing: str = "当前文章") -> Column:
    """The longest of several titles once the site's suffix is cut; blank and brand-only ones don't count."""
    cut = F.transform(titles, lambda t: collapse(strip_site_suffix(F.coalesce(t, F.lit("")), site.title_suffix, "|_-")))
    kept = F.filter(cut, lambda t: (t != "") & (t != site.title_suffix))
    return F.coalesce(F.array_max(F.transform(kept, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"], F.lit(missing))


def keyword_filter(rows: DataFrame, query: str, title: str = "title", empty_matches: bool = True) -> DataFrame:
    """Rows whose title has every term of a query, both as search keys."""
    terms = [k for k in map(plain_key, query.split()) if k]
    if not terms:
        return rows if empty_matches else rows.where(F.lit(False))
    key = search_key(F.col(title))
    return rows.where(reduce(and_, (F.contains(key, F.lit(t)) for t in terms)))


def select_batch(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """The first `most` rows of each group by position."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def batch_error(count: Column, most: int = 20) -> Column:
    """The cap is checked before repetitions are dropped."""
    return F.when(count > most, "BATCH_LIMIT").when(count == 0, "SELECTION_EMPTY")


def dedupe_last(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows with one key the last one, at the first one's place."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "pos").alias("r"), F.min("pos").alias("pos")).select(*keys, "pos", "r.*")


def keep_selected(selection: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Selected keys that are still candidates."""
    return selection.join(found.select(key).distinct(), key, "left_semi")


def retain_previous(found: DataFrame, before: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Candidates of a rescan, with what an earlier scan knew where the new one is null."""
    old = before.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return found.join(old, key, "left").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))
