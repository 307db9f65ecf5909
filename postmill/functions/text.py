"""Text expressions: trimming, search keys, spacing repair, tags, dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the white space of the web page's language, wider than Java's \s.
WS = r"[\s\p{Z}\x{FEFF}]"


def trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A{WS}+|{WS}+\z", "")


def collapse(col: Column) -> Column:
    return trim(F.regexp_replace(col, rf"{WS}+", " "))


def first_text(*cols: Column) -> Column:
    """The first value that isn't blank, trimmed; an empty text if there is none."""
    return F.coalesce(*(F.nullif(trim(c.cast("string")), F.lit("")) for c in cols), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no expression for."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def search_key(col: Column, normalise: bool = True) -> Column:
    """Comparable form: compatibility-composed, lower case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfkc(col) if normalise else col), r"[\s\p{Z}\p{P}\p{S}\x{FEFF}]+", "")


def plain_key(text: str) -> str:
    """search_key() of a single text."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if not c.isspace() and c != "\ufeff" and unicodedata.category(c)[0] not in "PSZ")


def repair_spacing(col: Column) -> Column:
    """Spacing of recognised text: runs collapsed, none before closing or after opening marks, some after
    punctuation between words and between Han and Latin letters.

    No rule makes or parts a pair of a Han and a Latin letter but the two for these; so they come first, and only
    where a character as high as Han ones is seen.
    """
    parted = F.regexp_replace(F.regexp_replace(col, r"(\p{IsHan})([A-Za-z])", "$1 $2"), r"([A-Za-z])(\p{IsHan})", "$1 $2")
    col = F.when(col.rlike(r"[\x{2E80}-\x{10FFFF}]"), parted).otherwise(col)
    for pattern, to in (
        (r"[\t\f\x0B ]+", " "),
        (rf"{WS}+([,.;:!?%）)\]}}])", "$1"),
        (rf"([（(\[{{]){WS}+", "$1"),
        (r"([A-Za-z0-9][,;:!?])(?=[A-Za-z])", "$1 "),
        (r"([A-Za-z0-9]\.)(?=[A-Z])", "$1 "),
    ):
        col = F.regexp_replace(col, pattern, to)
    return trim(col)


def needs_space(left: Column, right: Column) -> Column:
    """Whether a space belongs between the end of one line and the start of the next."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    latin, digit, han = r"\A[A-Za-z]\z", r"\A[0-9]\z", r"\A\p{IsHan}\z"
    into_latin = b.rlike(latin) & a.rlike(r"\A[A-Za-z0-9.!?,;:\p{IsHan}]\z")
    return into_latin | (a.rlike(latin) & (b.rlike(digit) | b.rlike(han)))


def join_wrapped(left: Column, right: Column) -> Column:
    """Two lines of one paragraph as one; a hyphen before a small letter goes."""
    hyphen = left.endswith("-") & right.rlike(r"\A[a-z]")
    cut = F.concat(F.regexp_replace(left, r"-\z", ""), right)
    return repair_spacing(F.when(hyphen, cut).otherwise(F.concat(left, F.when(needs_space(left, right), F.lit(" ")).otherwise(F.lit("")), right)))


def clean_body(col: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(col, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def clean_tag(col: Column) -> Column:
    """A tag without leading marks, topic suffix and trailing marks."""
    for pattern in (r"\A#+", r"\[话题\]#*\z", r"#+\z"):
        col = F.regexp_replace(trim(col), pattern, "") if pattern == r"\A#+" else F.regexp_replace(col, pattern, "")
    return trim(col)


def distinct_tags(*lists: Column) -> Column:
    """Union of tag lists, cleaned, in order of first occurrence, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), clean_tag), lambda t: t != ""))


def inline_tags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"#([^#\s\p{Z}\x{FEFF}]+)"), F.lit(1))


def strip_site_suffix(title: Column, site: str = "小红书", dashes: str = "-_–—|") -> Column:
    return F.regexp_replace(title, rf"{WS}*[{dashes.replace('-', '')}\-]{WS}*{site}.*\z", "")


def https_image(url: Column, cdn: str = r"xhscdn\.com") -> Column:
    """Image addresses with a scheme, and with TLS for the content network."""
    url = trim(url)
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.rlike(rf"(?i)\Ahttp://[^/]*{cdn}/"), F.regexp_replace(url, r"(?i)\Ahttp:", "https:")).otherwise(url)


#: Forms of dates beyond ISO that are read, in UTC; weekdays before them are skipped.
DATE_FORMS = ("yyyy/M/d[ H:mm[:ss]]", "yyyy-M-d[ H:mm[:ss]]", "yyyy.M.d", "M/d/yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]")


def iso_date(value: Column) -> Column:
    """Seconds, milliseconds, dates and timestamps as ISO text; month-day as it stands; other text unchanged; empty as null."""
    value = trim(value.cast("string"))
    number = F.try_to_number(value, F.lit("9999999999999"))
    millis = F.when(number < 10_000_000_000, number * 1000).otherwise(number)
    shape = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    plain = F.regexp_replace(F.regexp_replace(value, r"(?i)\A(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"(?i)\s*(?:GMT|UTC|Z)\z", "")
    other = F.coalesce(*(F.date_format(F.try_to_timestamp(plain, F.lit(form)), shape) for form in DATE_FORMS), value)
    return (
        F.when(value == "", F.lit(None))
        .when(value.rlike(r"\A\d{1,2}[-/.]\d{1,2}\z"), value)
        .when(value.rlike(r"\A\d{10,13}\z"), F.date_format(F.timestamp_millis(millis.cast("long")), shape))
        .when(value.rlike(r"\A\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?\z"), F.coalesce(F.date_format(F.try_to_timestamp(value), shape), value))
        .when(value.rlike(r"\d") & (F.length(value) < 60), other)
        .otherwise(value)
    )


def yaml_string(value: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, yaml_string), ", "), F.lit("]"))


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def duration_label(ms: Column) -> Column:
    """Fixed labels: seconds, minutes and seconds, or minutes."""
    seconds = half_up(ms / 1000).cast("long")
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" 秒"))).when(rest > 0, F.concat(minutes.cast("string"), F.lit(" 分 "), rest.cast("string"), F.lit(" 秒"))).otherwise(F.concat(minutes.cast("string"), F.lit(" 分钟")))
