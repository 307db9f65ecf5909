"""Spans of pattern matches in code points, with DataFrame functions alone.

Cutting a text at a pattern and taking all its matches walk the same matches, so the lengths of the
parts between and of the matches give each match's place. Patterns use possessive quantifiers and
start only where a run of their first class starts, so a text is read in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def empty() -> Column:
    return F.array().cast(SPAN)


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds _p_<kind> (lengths between matches) and _m_<kind> (matches); a text that fails a kind's cheap test has none."""
    cols = {}
    for kind, (pattern, likely) in patterns.items():
        cols[f"_m_{kind}"] = F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        cols[f"_p_{kind}"] = F.when(likely, F.transform(F.split(text, pattern, -1), lambda p: F.length(p))).otherwise(F.array().cast("array<int>"))
    return df.withColumns(cols)


def matches(kind: str, rank: int, keep) -> Column:
    """Spans of one kind; keep tells from a match's text whether it stays.

    Matches are folded in blocks whose lists are joined at the end, so that a text with very many
    doesn't copy its list for each.
    """
    found, parts = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
    start = F.struct(F.lit(0).alias("at"), empty().alias("out"))

    def step(acc: Column, i: Column) -> Column:
        value = F.get(found, i)
        begin = acc["at"] + F.get(parts, i)
        end = begin + F.length(value)
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), begin.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.coalesce(keep(value), F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        places = F.sequence(first, F.least(first + BLOCK, F.size(found)) - 1)
        now = F.aggregate(places, F.struct(acc["now"]["at"].alias("at"), empty().alias("out")), step)
        return F.struct(now.alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    blocks = F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK))
    none = F.struct(start.alias("now"), F.array().cast(f"array<{SPAN}>").alias("done"))
    folded = F.aggregate(blocks, none, block, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]["out"]))))
    return F.when(F.size(found) > 0, folded).otherwise(empty())


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, *by: str) -> Column:
    """Spans in the order of the named fields."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*(s[k].alias(f"k{i}") for i, k in enumerate(by)), s.alias("span"))))
    return F.transform(keyed, lambda x: x["span"])


def overlapping(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def redacted(text: str, spans: str, label) -> Column:
    """The text with each span (by start; overlapping ones as one) replaced by label(kind of the first)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), label(s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"))

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))))
