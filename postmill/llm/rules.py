"""Quality rules: a table of thresholds compiled into one projection.

Measures are counted with array functions inside each row, without a shuffle or user function.
Words in repeated eight-word windows are found by hashing the windows; only texts that have a
repeated window sort them. The verdict is the conjunction of RULES, each a ratio with bounds. The stop-word rule
abstains where no list applies: if the document's lang is given and none of LISTED, or if fewer than half of
its words have a Latin letter.

Cases: null and empty texts have no words and fail the base rule; repeated rows each give a row;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import long_id, table

WINDOW = 8
#: Frequent function words of four languages.
STOP_WORDS = "the of and to in is that it for on was with as be by this are at from a an or not der die das und den von zu ein eine ist mit für im auf des sich dem nicht als auch le la les de des et un une est que qui dans pour par sur du en au pas plus ce il el los las y con por del se no una su para al lo como más".split()
LISTED = ("en", "de", "fr", "es")
#: name, numerator, denominator, least and greatest ratio, words that a text needs for the rule to apply
RULES = [
    ("word_length", "word_chars", "n_words", 2.0, 25.0, 1),
    ("symbols", "n_symbols", "n_words", None, 0.3, 1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.3, 1),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.3, 1),
]


def compiled(rules: list[tuple]) -> Column:
    """One boolean expression that holds where every rule does."""
    verdict = F.lit(True)
    for _, over, under, least, most, words in rules:
        ratio = F.col(over) / F.greatest(F.col(under), F.lit(1))
        fine = F.lit(True)
        if least is not None:
            fine = fine & (ratio >= least)
        if most is not None:
            fine = fine & (ratio <= most)
        verdict = verdict & ((F.col("n_words") < words) | fine)
    return verdict


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text."""
    listed = F.coalesce(F.lower(F.col("lang").cast("string")).isin(*LISTED), F.lit(True)) if "lang" in docs.columns else F.lit(True)
    rows = docs.select(long_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), listed.alias("listed"))
    rows = rows.withColumn("words", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # a text without a list counts as if every word were on it
        F.when(F.col("listed") & (2 * F.size(F.filter("words", lambda w: w.rlike("[A-Za-z]"))) >= F.size("words")), F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).otherwise(F.size("words")).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.size("hashes") >= WINDOW, windows)).drop("hashes")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    twice = F.filter("sorted", lambda x, i: x["h"].eqNullSafe(F.get("sorted", i - 1)["h"]) | x["h"].eqNullSafe(F.get("sorted", i + 1)["h"]))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    covered = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("places")


def judge(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, measures, base_failed and kept of every document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured(docs).withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & compiled(rules)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lower(lang) in ('{"', '".join(LISTED)}'), true) as listed from documents),
w as (
  select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (
  select r, i, array_to_string(words[i : i + 7], ' ') as g from (select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
rep as (
  select r, count(distinct p) as n from (
    select r, unnest(range(i, i + 8)) as p from (select r, i, count(*) over (partition by r, g) as k from g) where k > 1) group by r),
m as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    case when listed and 2 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]'))) >= len(words) then
      len(list_filter(words, lambda x: lower(x) in ({", ".join("'" + x + "'" for x in dict.fromkeys(STOP_WORDS))}))) else len(words) end as n_stop_words
  from w left join rep using (r)),
f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / greatest(n_words, 1) between 2 and 25 and n_symbols / greatest(n_words, 1) <= 0.3
  and (n_words < 50 or n_stop_words / greatest(n_words, 1) >= 0.02) and n_dup_lines / greatest(n_lines, 1) <= 0.3
  and n_repeat_words / greatest(n_words, 1) <= 0.3 as kept
from f
"""
