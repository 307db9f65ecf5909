"""Personal data: known forms, and information-theoretic sanitisation of what reveals them.

Base kinds are e-mail addresses, IP addresses, card and phone numbers. A protected entity is a base value, or
what several share: the domain of an address, the network (first three parts) of an IP address. Over the corpus,
p(e) is the share of documents that have entity e, p(t) that of documents that have term t (a whole word) outside
base spans, and p(t, e) that of documents that have both, wherever in them. A term's disclosure of e is its
pointwise mutual information log2 p(t, e) / (p(t) p(e)) as a share of e's information -log2 p(e); it is 1 if t
never comes without e. All three count every row, repeated ones as often as they come. A term that reaches
`disclosure` beside at least `support` different surroundings of e (the `REACH` characters on either side; copies
of one passage are one surrounding) is a span of kind `term` wherever it stands in a document that has e.
sanitise() generalises spans to the name of their kind and removes terms.

All counts cover the whole corpus and are hash aggregates with map-side combining; the corpus's terms are only
counted when some pair has enough support, and pairs are formed of terms that have it. Nothing is collected;
facts of an entity or a text that very many rows share are broadcast in bounded number. Cases: null texts count
as empty; an empty text has no spans; repeated rows each give a row; other columns are left out, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import spans as S
from postmill.llm.common import long_id, materialise, table, with_facts

KINDS = ("email", "ip", "card", "phone")
REACH = 60
#: The forms that are looked for; each starts where a run of its first class starts or the match before ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{2,}+"


def fine_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def fine_card(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[\x20-]", ""))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, doubled(digits.substr(i, F.lit(1)).cast("int"))).otherwise(digits.substr(i, F.lit(1)).cast("int")))
    luhn = F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(F.length(digits).between(16, 19), luhn).otherwise(F.lit(False))


def fine_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans of the base kinds by kind and start."""
    rows = docs.select(long_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    likely = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"(?<![0-9])(?:[0-9][\x20-]?+){16}"),
        "phone": text.rlike(r"\+[0-9]"),
    }
    rows = S.with_matches(rows, "text", {k: (FORMS[k], likely[k]) for k in KINDS})
    keep = {"email": lambda v: F.lit(True), "ip": fine_ip, "card": fine_card, "phone": fine_phone}
    base = F.concat(*(S.matches(k, rank, keep[k]) for rank, k in enumerate(KINDS)))
    return rows.select("doc_id", "text", base.alias("base"))


def entity_keys(e: Column) -> Column:
    """What a base span stands for: its value in one form, and the domain or network that others share."""
    value, digits = F.lower(e["value"]), F.regexp_replace(e["value"], "[^0-9]", "")
    own = F.when(e["kind"].isin("card", "phone"), digits).otherwise(value)
    shared = F.when(e["kind"] == "email", F.regexp_replace(value, "^.*@", "@")).when(e["kind"] == "ip", F.regexp_replace(value, r"[0-9]+\z", ""))
    return F.filter(F.array(*(F.concat(e["kind"], F.lit(":"), x) for x in (own, shared))), lambda x: x.isNotNull())


def words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def outside(text: str, base: str) -> Column:
    """The text without its base spans."""
    return S.redacted(text, base, lambda kind: F.lit("\n"))


def bearers(found: DataFrame) -> DataFrame:
    """(row, times, entity, around): the entities of each different text, how often that text comes, and a hash of what surrounds the entity first."""
    texts = found.where(F.size("base") > 0).groupBy("row").agg(F.count(F.lit(1)).alias("times"), F.first("text").alias("text"), F.first("base").alias("base"))
    each = texts.select("row", "times", "text", F.explode("base").alias("e"))
    begin = F.greatest(F.lit(0), F.col("e.start") - REACH)
    around = F.xxhash64(F.substring("text", begin + 1, F.col("e.start") - begin), F.lit("\n"), F.substring("text", F.col("e.end") + 1, F.lit(REACH)))
    each = each.select("row", "times", F.explode(entity_keys(F.col("e"))).alias("entity"), F.struct(F.col("e.start"), around.alias("hash")).alias("first"))
    return each.groupBy("row", "entity").agg(F.first("times").alias("times"), F.min("first")["hash"].alias("around"))


def disclosing(docs: DataFrame, found: DataFrame, borne: DataFrame, n_rows: int, disclosure: float, support: int) -> DataFrame | None:
    """(entity, with_entity, terms): the terms whose disclosure of an entity reaches the threshold; None if no pair has the support."""
    of_entity = borne.groupBy("entity").agg(F.countDistinct("around").alias("contexts"), F.sum("times").alias("with_entity"), F.count(F.lit(1)).alias("n")).where((F.col("contexts") >= support) & (F.col("with_entity") < n_rows))
    of_entity = materialise(of_entity.select("entity", "with_entity", "n"), "entities")
    if not of_entity.head(1):
        return None
    kept = with_facts(borne, of_entity, "entity", "n", n_rows).select("row", "entity", "times", "around")
    plain = found.where(F.size("base") > 0).dropDuplicates(["row"]).select("row", F.explode(words(outside("text", "sorted"))).alias("term"))
    inside = plain.join(kept.select("row").distinct(), "row")
    seen = inside.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    inside = with_facts(inside, seen.withColumn("fine", F.lit(True)), "term", "n", n_rows).select("row", "term")
    pairs = inside.join(kept, "row").groupBy("entity", "term").agg(F.countDistinct("around").alias("contexts"), F.sum("times").alias("both")).where(F.col("contexts") >= support)
    pairs = materialise(pairs.select("entity", "term", "both"), "pairs")
    if not pairs.head(1):
        return None
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = docs.select(text.alias("text")).select(F.explode(words(F.col("text"))).alias("term"))
    # counted before the join, so that a common term meets it as one row; words inside base spans alone are taken off again
    hidden = found.where(F.size("base") > 0).select(F.explode(F.array_except(words(F.col("text")), words(outside("text", "sorted")))).alias("term"))
    counts = others.select("term", F.lit(1).alias("k")).unionByName(hidden.select("term", F.lit(-1).alias("k")))
    of_term = counts.groupBy("term").agg(F.sum("k").alias("with_term")).join(pairs.select("term").distinct(), "term")
    pmi = F.log2(F.col("both") * F.lit(float(n_rows)) / (F.col("with_term") * F.col("with_entity")))
    information = -F.log2(F.col("with_entity") / F.lit(float(n_rows)))
    told = pairs.join(of_term, "term").join(of_entity, "entity").where(pmi >= disclosure * information - 1e-9)
    return told.groupBy("entity").agg(F.first("n").alias("n"), F.collect_set("term").alias("terms"))


def find_personal(docs: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """doc_id, row (hash of the text), base (base spans) and spans (base spans and disclosing terms) of every document."""
    some = F.size("base") > 0
    rows = base_spans(docs).select("doc_id", F.xxhash64("text").alias("row"), "base", F.when(some, F.col("text")).alias("text"))
    found = materialise(rows.withColumn("sorted", F.when(some, S.ordered(F.col("base"), "start", "end"))), "spans")
    n_rows = found.count()
    borne = materialise(bearers(found), "bearers")
    told = disclosing(docs, found, borne, n_rows, disclosure, support)
    if told is None:
        return found.select("doc_id", "row", "base", F.col("base").alias("spans"))
    of_row = with_facts(borne.select("row", "entity", "times"), told, "entity", "n", n_rows).groupBy("row").agg(F.first("times").alias("times"), F.flatten(F.collect_set("terms")).alias("told"))
    marked = with_facts(found, of_row, "row", "times", n_rows, keep=True).withColumn("told", F.coalesce("told", F.array().cast("array<string>")))
    marked = S.with_matches(marked, "text", {"term": (TERM, F.size("told") > 0)})
    more = F.filter(S.matches("term", len(KINDS), lambda v: F.array_contains("told", F.lower(v))), lambda s: ~S.overlapping(s, F.col("base")))
    return marked.select("doc_id", "row", "base", F.concat("base", F.when(F.size("told") > 0, more).otherwise(S.empty())).alias("spans"))


def sanitise(docs: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """doc_id and text with base spans generalised to their kind and disclosing terms removed."""
    found = find_personal(docs, disclosure, support)
    spans = found.where(F.size("spans") > 0).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("spans").alias("spans"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = with_facts(rows, spans, "row", "n", docs.count(), keep=True).withColumn("spans", S.ordered(F.coalesce("spans", S.empty()), "start", "rank"))
    return rows.select("doc_id", S.redacted("text", "spans", lambda kind: F.when(kind == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))).alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS), F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))
