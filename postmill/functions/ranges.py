"""Page ranges such as `1,3-5`: grammar, expansion, counting, selection, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import WS, trim

GRAMMAR = r"\A[0-9]+(?:-[0-9]+)?(?:,[0-9]+(?:-[0-9]+)?)*\z"


def normalise(value: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(trim(value), "[，、]", ","), "[–—~～至]", "-")
    return F.regexp_replace(out, rf"{WS}+", "")


def bounds(value: Column) -> Column:
    """Struct of first and last page of each token; nulls for numbers beyond 18 digits."""
    def one(token: Column) -> Column:
        first = F.substring_index(token, "-", 1).try_cast("long")
        return F.struct(first.alias("a"), F.substring_index(token, "-", -1).try_cast("long").alias("b"))

    return F.transform(F.split(normalise(value), ","), one)


def pages(value: Column) -> Column:
    """Distinct pages of a range that has no reversed token, ascending; null if the grammar or a token is bad."""
    tokens = bounds(value)
    sound = normalise(value).rlike(GRAMMAR) & F.forall(tokens, lambda t: F.coalesce((t["a"] >= 1) & (t["b"] >= t["a"]), F.lit(False)))
    spans = F.transform(tokens, lambda t: F.sequence(F.least(t["a"], t["b"]), F.greatest(t["a"], t["b"])))
    return F.when(sound, F.array_sort(F.array_distinct(F.flatten(spans))))


def page_count(value: Column) -> Column:
    """Number of distinct pages, from merged spans rather than their pages; null as for pages() and beyond 2^53 - 1."""
    tokens = bounds(value)
    sound = normalise(value).rlike(GRAMMAR) & F.forall(tokens, lambda t: F.coalesce((t["a"] >= 1) & (t["b"] >= t["a"]) & (t["b"] < 1 << 53), F.lit(False)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def step(acc: Column, t: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), t["b"] - F.greatest(acc["reach"], t["a"] - 1))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["reach"], t["b"]).alias("reach"))

    return F.when(sound, F.aggregate(F.array_sort(tokens), start, step, lambda acc: acc["n"]))


def selection(mode: Column, value: Column, total: Column) -> Column:
    """Struct of zero-based image indexes and error."""
    plain, tokens = normalise(value), bounds(value)
    outside = F.exists(tokens, lambda t: ~F.coalesce((t["a"] >= 1) & (t["b"] >= t["a"]) & (t["b"] <= total), F.lit(False)))
    first = F.when(mode == "skip-cover", 1).otherwise(0)
    error = (
        F.when((total < 1) | ((mode != "custom") & (total <= first)), "no-images")
        .when((mode == "custom") & (plain == ""), "range-required")
        .when((mode == "custom") & ~plain.rlike(GRAMMAR), "range-invalid")
        .when((mode == "custom") & outside, "range-out-of-bounds")
    )
    chosen = F.when(mode == "custom", F.transform(pages(value), lambda p: (p - 1).cast("int"))).otherwise(F.sequence(first, F.greatest(first, total.cast("int") - 1)))
    return F.struct(F.when(error.isNull(), chosen).alias("indexes"), error.alias("error"))


def image_selection_error(indexes: Column, urls: Column) -> Column:
    """Error code if an index is outside the note's images or its image has no address; null otherwise."""
    bad = F.exists(indexes, lambda i: F.coalesce(F.get(urls, i.cast("int")), F.lit("")) == "")
    return F.when((F.size(indexes) == 0) | bad, "IMAGE_SELECTION_INVALID")


def page_list(indexes: Column) -> Column:
    """Zero-based indexes as `1,3-5,7`."""
    ordered = F.array_sort(F.array_distinct(indexes))
    def step(acc: Column, i: Column) -> Column:
        page = i.cast("long") + 1
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), page.alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] + 1 == page), grown).otherwise(F.concat(acc, F.array(F.struct(page.alias("a"), page.alias("b")))))

    spans = F.aggregate(ordered, F.array().cast("array<struct<a:bigint,b:bigint>>"), step)
    return F.array_join(F.transform(spans, lambda s: F.when(s["a"] == s["b"], s["a"].cast("string")).otherwise(F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string")))), ",")
