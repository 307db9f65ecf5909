"""Recognised lines of an image as paragraphs, by DataFrame functions alone.

Whether a line opens a paragraph depends on where it stands, on how it begins and on how the text before it ends. Of
that text a fold keeps no more than this: whether it ends a sentence, what follows its last end of a sentence (four
characters tell), and its last character. So the fold over a text's lines makes a mark for each line, and texts
are put together afterwards, each paragraph once, from lines whose joints are decided by the two lines that meet there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import WS, needs_space, repair_spacing

#: What marks list items, ends of sentences and continuations, and the distances in heights of a line.
LIST_ITEM = rf"\A(?:[-•●▪]|(?:[0-9]+|[A-Za-z])[.)、]){WS}+"
STOPS, CLOSERS = "。！？!?；;", "”’\"')）】"
GOES_ON = r"\A[的得地了着过和与及或但而也就都不没更最则却并a-z]"
OPEN_ENDS = "，,、：:（([【"
SENTENCE_ENDS = "。！？.!?"
GAP, WIDE_GAP, INDENT, SHIFT, RATIO = 0.72, 2.5, 1.15, 2.0, 1.35
TAIL = 3


def middle(values: Column) -> Column:
    """Median of an array of numbers; 0 of none."""
    ranked, n = F.array_sort(values), F.size(values)
    half = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(ranked, half) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2).otherwise(F.lit(0.0))


def features(line: Column) -> Column:
    """What the fold asks of a line, made once: its repaired text, its box and how the text begins and ends."""
    text = repair_spacing(F.coalesce(line["text"], F.lit("")))
    xs, ys = F.transform(line["poly"], lambda p: p["x"].cast("double")), F.transform(line["poly"], lambda p: p["y"].cast("double"))
    top, bottom = F.array_min(ys), F.array_max(ys)
    return F.struct(text.alias("text"), F.array_min(xs).alias("left"), top.alias("top"), bottom.alias("bottom"), F.greatest(F.lit(1.0), bottom - top).alias("height"))


def ends_and_starts(line: Column) -> Column:
    text = line["text"]
    one_stop = F.translate(text, STOPS, STOPS[0] * len(STOPS))
    rest = F.regexp_replace(F.substring_index(one_stop, STOPS[0], -1), rf"{WS}+", "")
    bare = F.rtrim(text, F.lit(CLOSERS))
    return F.struct(
        *(line[c].alias(c) for c in ("text", "left", "top", "bottom", "height")),
        ((bare != "") & F.contains(F.lit(STOPS), F.right(bare, F.lit(1)))).alias("stops"),
        ((bare == "") & (text != "")).alias("closers"),
        F.contains(one_stop, F.lit(STOPS[0])).alias("has_stop"),
        F.left(rest, F.lit(TAIL + 1)).alias("rest"),
        F.right(text, F.lit(1)).alias("last"),
        text.rlike(LIST_ITEM).alias("item"),
        text.rlike(GOES_ON).alias("goes_on"),
        text.rlike(r"\A\p{IsHan}").alias("han"),
    )


def marks(lines: Column, height: Column, left: Column) -> Column:
    """For each line p (it opens a paragraph), j (it is joined to what is before) or b (it is blank), as one text."""
    start = F.struct(F.lit("").alias("marks"), F.lit(False).alias("stops"), F.lit("").alias("rest"), F.lit("").alias("last"))

    def step(acc: Column, i: Column) -> Column:
        line, before = F.get(lines, i), F.get(lines, i - 1)
        gap = line["top"] - before["bottom"]
        tall, low = F.greatest(before["height"], line["height"]), F.least(before["height"], line["height"])
        near = (gap <= WIDE_GAP * height) & (tall / F.greatest(F.lit(1.0), low) <= RATIO) & (F.abs(line["left"] - before["left"]) <= SHIFT * height)
        short = F.length(acc["rest"]).between(1, TAIL) & acc["rest"].rlike(r"\A\p{IsHan}+\z") & line["han"]
        bridged = ~acc["stops"] & ~line["item"] & near & (F.contains(F.lit(OPEN_ENDS), acc["last"]) | line["goes_on"] | short)
        parted = ((gap > GAP * height) & ~bridged) | line["item"] | ((line["left"] - left > INDENT * height) & F.contains(F.lit(SENTENCE_ENDS), acc["last"]))
        opens = (acc["last"] == "") | F.coalesce(parted, F.lit(True))
        stops = line["stops"] | (~opens & line["closers"] & acc["stops"])
        rest = F.when(opens | line["has_stop"], line["rest"]).otherwise(F.left(F.concat(acc["rest"], line["rest"]), F.lit(TAIL + 1)))
        grown = F.struct(F.concat(acc["marks"], F.when(opens, "p").otherwise("j")).alias("marks"), stops.alias("stops"), rest.alias("rest"), line["last"].alias("last"))
        blank = F.struct(F.concat(acc["marks"], F.lit("b")).alias("marks"), acc["stops"].alias("stops"), acc["rest"].alias("rest"), acc["last"].alias("last"))
        return F.when(line["text"] == "", blank).otherwise(grown)

    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda acc: acc["marks"])


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def put_together(texts: Column, kinds: Column) -> Column:
    """Paragraphs of lines that aren't blank (texts) with their marks (kinds, p or j); a hyphen before a small letter goes."""
    joined = lambda i: F.get(kinds, i) == "j"
    hyphened = lambda i: joined(i) & F.get(texts, i - 1).endswith("-") & F.get(texts, i).rlike(r"\A[a-z]")

    def piece(text: Column, i: Column) -> Column:
        own = F.when(F.coalesce(hyphened(i + 1), F.lit(False)), F.regexp_replace(text, r"-\z", "")).otherwise(text)
        spaced = joined(i) & ~hyphened(i) & needs_space(F.get(texts, i - 1), text)
        return F.when(F.coalesce(spaced, F.lit(False)), F.concat(F.lit(" "), own)).otherwise(own)

    def assembled(made: Column) -> Column:
        pieces, begins = made["pieces"], made["begins"]

        def part(b: Column, j: Column) -> Column:
            n = F.coalesce(F.get(begins, j + 1), F.size(pieces)) - b
            return F.when(n == 1, F.get(pieces, b)).otherwise(repair_spacing(F.array_join(F.slice(pieces, b + 1, n), "")))  # a line alone is repaired already

        return F.array_join(F.filter(F.transform(begins, part), lambda p: p != ""), "\n\n")

    begins = F.filter(F.transform(kinds, lambda k, i: F.when(k == "p", i)), lambda i: i.isNotNull())
    return named(F.struct(F.transform(texts, piece).alias("pieces"), begins.alias("begins")), assembled)


def paragraphs(lines: Column) -> Column:
    """Text of an image's lines array<struct<text, score, poly>>: paragraphs with a blank line between; lines as they are if one
    of them has no box (fewer than four corners). A null or empty array is an empty text."""

    def by_geometry(own: Column) -> Column:
        height, left = middle(F.transform(own, lambda x: x["height"])), middle(F.transform(own, lambda x: x["left"]))
        told = named(F.struct(own.alias("l"), height.alias("h"), left.alias("x")), lambda s: F.split(marks(s["l"], s["h"], s["x"]), ""))

        def assembled(kinds: Column) -> Column:
            texts = F.filter(F.transform(own, lambda x: x["text"]), lambda t: t != "")
            return named(F.struct(texts.alias("t"), F.filter(kinds, lambda k: k.isin("p", "j")).alias("k")), lambda s: put_together(s["t"], s["k"]))

        return named(told, assembled)

    boxed = F.forall(lines, lambda x: F.coalesce(F.size(x["poly"]) >= 4, F.lit(False)))
    plain = F.array_join(F.filter(F.transform(lines, lambda x: repair_spacing(F.coalesce(x["text"], F.lit("")))), lambda t: t != ""), "\n")
    shaped = named(F.transform(F.transform(lines, features), ends_and_starts), by_geometry)
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, F.lit("")).when(boxed, shaped).otherwise(plain)
