"""Recognised lines: collapse, cross-image duplicates, geometry, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import clean_body, nfkc, repair_spacing, search_key
from postmill.operators.paragraphs import paragraphs
from postmill.session import materialise, with_facts

SHORTEST_KEY = 12


def collapse_adjacent(lines: DataFrame, keys: list[str], order: list[str], text: str, score: str) -> DataFrame:
    """Of each run of lines with equal normalised text the one with the highest score, the first of equals."""
    norm = F.lower(F.regexp_replace(F.col(text), r"[\s\p{Z}\x{FEFF}，。！？、,.!?;；:：]+", ""))
    over = Window.partitionBy(*keys).orderBy(*order)
    rows = lines.withColumn("_n", norm).withColumn("_new", F.when(F.lag("_n").over(over).eqNullSafe(F.col("_n")), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rank = Window.partitionBy(*keys, "_run").orderBy(F.desc(score), *order)
    return rows.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_n", "_new", "_k", "_run")


def repeats(keyed: DataFrame, order: list[str]) -> DataFrame:
    """The first place and the number of rows of every key that comes more than once."""
    return keyed.groupBy("key").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def first_long_lines(lines: DataFrame, note: str, order: list[str], text: str, normalise: bool = True) -> DataFrame:
    """Drops a line whose key of at least SHORTEST_KEY characters came before in the same note; blank and short ones stay.

    Keys are made once and compared by their MD5 with the note; lines without one go past the join.
    """
    found = search_key(F.col(text), normalise)
    rows = lines.select(F.struct(*lines.columns).alias("row"), found.alias("found"), F.struct(*order).alias("at"))
    key = F.when(F.length("found") >= SHORTEST_KEY, F.md5(F.concat(F.col(f"row.{note}").cast("string"), F.lit("\x1f"), F.col("found"))))
    rows = materialise(rows.select("row", "at", key.alias("key")), "lines")
    long = rows.where("key is not null")
    told = with_facts(long, repeats(long, ["at"]), "key", "n", rows.count(), keep=True)
    kept = told.where("first is null or first.at = at").select("row")
    return rows.where("key is null").select("row").unionByName(kept).select("row.*")


def clean_images(results: DataFrame, note: str = "note_id", image: str = "image_index", text: str = "text") -> DataFrame:
    """Cross-image cleaning: spacing repaired, long lines once per note, empty results dropped.

    Images with lines (array<struct<text, score, poly>>, where there is such a column) lose their blank lines and are put
    together by geometry; others keep the lines of their text. Images stay whole rows, however many a note has: lines are
    repaired once, only hashes of long ones are dealt out, and what comes back to an image are the numbers of the
    lines that it loses.
    """
    split = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    lined = F.coalesce(F.size("lines") > 0, F.lit(False)) if "lines" in results.columns else F.lit(False)
    own = F.col("lines") if "lines" in results.columns else F.lit(None).cast("array<struct<text:string,score:double,poly:array<struct<x:double,y:double>>>>")
    repaired = F.when(lined, F.transform(own, lambda x: F.replace(repair_spacing(F.coalesce(x["text"], F.lit(""))), F.lit("\n"), F.lit(" ")))).otherwise(F.transform(split, repair_spacing))
    rows = results.where(lined | F.col(text).isNotNull())
    rows = rows.select(F.col(note).alias("note"), F.col(image).alias("image"), own.alias("boxes"), lined.alias("lined"), F.array_join(repaired, "\n").alias("lines"))

    def hashed(line: Column) -> Column:
        key = F.transform(F.array(search_key(line, False)), lambda k: F.when(F.length(k) >= SHORTEST_KEY, F.md5(F.concat(F.coalesce(F.col("note").cast("string"), F.lit("")), F.lit("\x1f"), k))))
        return F.get(key, 0)

    rows = rows.withColumn("keys", nfkc("lines")).withColumn("keys", F.transform(F.split("keys", "\n"), hashed))
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "texts")
    n_long = rows.agg(F.sum(F.size(F.filter("keys", lambda k: k.isNotNull())))).first()[0] or 0
    long = rows.select("image", "place", F.posexplode("keys").alias("line_no", "key")).where("key is not null")
    told = with_facts(long, repeats(long, ["image", "line_no", "place"]), "key", "n", n_long)
    lost = told.where(F.struct("image", "line_no", "place") != F.col("first")).groupBy("place").agg(F.collect_set("line_no").alias("lost"))
    # written, so that its size is known: up to Spark's own bound it goes to the images, beyond it they are shuffled
    kept = rows.join(materialise(lost, "lost"), "place", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
    stays = lambda x, i: F.when(~F.array_contains("lost", i), x)
    line = F.filter(F.transform(F.split("lines", "\n"), stays), lambda x: x.isNotNull())
    texts = F.split("lines", "\n")
    box = F.filter(F.transform("boxes", lambda x, i: F.when((F.get(texts, i) != "") & ~F.array_contains("lost", i), x)), lambda x: x.isNotNull())
    made = F.when(F.col("lined"), paragraphs(box)).otherwise(clean_body(F.array_join(line, "\n")))
    return kept.select(F.col("note").alias(note), F.col("image").alias(image), made.alias(text)).where(F.col(text) != "")


def line_bounds(poly: Column) -> Column:
    """left, top, right, bottom, height of a polygon; null with fewer than four points."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"), F.greatest(F.lit(1.0), F.array_max(ys) - F.array_min(ys)).alias("height"))
    return F.when(F.size(poly) >= 4, box)


def median(values: str | Column) -> Column:
    """Exact median; the mean of the two middle values; 0 of none."""
    return F.coalesce(F.median(values), F.lit(0.0))


def compact(results: DataFrame, text: Column) -> DataFrame:
    """Results whose geometry is dropped once their text is clean; ones without lines stay as they are."""
    had = F.size("lines") > 0
    return results.withColumn("text", F.when(had, text).otherwise(F.col("text"))).withColumn("lines", F.filter("lines", lambda _: F.lit(False)))


def translate_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of an image's tiles as one list, their polygons moved by the tile's top."""
    moved = F.transform("lines", lambda x: x.withField("poly", F.transform(x["poly"], lambda p: F.struct(p["x"].alias("x"), (p["y"] + F.col("top")).alias("y")))))
    rows = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile", moved.alias("lines")))).alias("t"))
    return rows.select(*keys, F.flatten(F.transform("t", lambda x: x["lines"])).alias("lines"))
