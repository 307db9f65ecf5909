"""Secret scan: known forms, and sliding-window Shannon entropy over candidate strings.

Base kinds are assignments, access keys and long hexadecimal runs. Further candidates are runs of at least
SHORTEST characters of an alphabet with a letter and a digit, or with letters of both cases alone, and of at least LETTERS letters of one case (a capital first is none).
A window slides over a candidate; its sum of c * log2(c) over character counts c changes only by the character that
comes and the one that goes, and the entropy is log2(WINDOW) less that sum over WINDOW. A candidate shorter
than WINDOW is one window of its own length. A candidate whose highest window passes the threshold of its character
class and length (which a random window of the class reaches but for a share of MISS) is a span of kind `entropy`,
unless the allow-list names the form of all of it or it overlaps a base span. Everything is DataFrame functions inside each row.

Keys of fewer than SHORTEST characters, and letters of one case alone of fewer than LETTERS, are found by the base kinds only.
Spans of equal start stand in the order of the kinds; they don't overlap within a kind. Texts are read whole, in linear time.
Cases: null texts count as empty; an empty text has no spans; repeated rows each give a row; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import spans as S
from postmill.llm.common import table

WINDOW, PART = 20, 64
SHORTEST, LETTERS = 16, 24
#: The forms that are looked for.
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*+[:=]\x20*+[\"']?"
VALUE = r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+|(?=[A-Z]?+[a-z]++[A-Z]|[A-Z]{{2,}}+[a-z]|[A-Za-z]{{{LETTERS}}})[A-Za-z]{{{SHORTEST},}}+(?![0-9+/_=-]))"
#: Share of random windows of a class that may fall below its threshold; a longer key has more windows and is missed less.
MISS = 0.001
#: Forms that look random and aren't secrets, each of a whole candidate: identifiers, words and short numbers
#: between separators (names, paths, placeholders), words before or after one number, words that each begin with a capital,
#: dates with a time or words, and a published sample key.
SEGMENT = r"(?:(?:[A-Z]{2,}+|(?:[A-Z][a-z]++|[a-z]{2,}+)++)[0-9]{0,4}+|[0-9]{1,4}+)"
#: Letters that can be spoken: no four consonants in a row before the last vowel, no five vowels.
SPOKEN = r"^(?:[^aeiouyAEIOUY\W\d_]{0,3}+[aeiouyAEIOUY]{1,4}+)++[^aeiouyAEIOUY\W\d_]{0,4}+$"
ALLOWED = [
    r"^(?:[A-Z]++|(?:[A-Z]?[a-z]{2,}+)++)[0-9]++$|^[0-9]++(?:[A-Z]++|(?:[A-Z]?[a-z]{2,}+)++)$",
    r"^[A-Z]?[a-z]{2,}+(?:[A-Z][a-z]{2,}+)++$",
    r"^[A-Z]*+[a-z]{3,}+(?:[A-Z]++[a-z]{3,}+)++[A-Z]*+$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9]{2}[_-]?[0-9]{2}(?:[_-]?[0-9]{2})?(?:[_-]?[0-9]{3,9})?(?:Z|UTC|[+-][0-9]{2}-?[0-9]{2})?$",
    rf"^[/_-]*+{SEGMENT}(?:[/_-]++{SEGMENT})++[/_=-]*+$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
]
LOGS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def partitions(n: int, most: int) -> Iterator[list[int]]:
    """All ways to write n as a sum of numbers up to most, largest first."""
    if n == 0:
        yield []
    for first in range(min(n, most), 0, -1):
        for rest in partitions(n - first, first):
            yield [first, *rest]


def least_entropy(symbols: int, miss: float, window: int = WINDOW) -> float:
    """The highest entropy that a window of equally likely symbols falls below with a chance of at most miss."""
    chance: dict[float, float] = {}
    for counts in partitions(window, window):
        if len(counts) <= symbols:
            ways = math.factorial(window) // math.prod(map(math.factorial, counts)) * math.perm(symbols, len(counts)) // math.prod(map(math.factorial, Counter(counts).values()))
            bits = round(math.log2(window) - sum(LOGS[c] for c in counts) / window, 9)
            chance[bits] = chance.get(bits, 0.0) + ways / symbols**window
    below = 0.0
    for bits in sorted(chance):
        below += chance[bits]
        if below > miss:
            break
    return bits - 1e-6  # sums of windows are rounded


#: Character classes of candidates and how many characters each has: hexadecimal, letters of one case, of both, then with digits.
CLASSES = ((r"^[0-9a-fA-F]+$", 16), (r"^[a-z]+$|^[A-Z]+$", 26), (r"^[A-Za-z]+$", 52), (r"^[0-9A-Z]+$|^[0-9a-z]+$", 36), (r"", 62))
#: By class: the entropy in bits that the highest window must reach, for candidates of SHORTEST, ... WINDOW and more characters.
THRESHOLDS = [(form, [least_entropy(symbols, MISS, n) for n in range(SHORTEST, WINDOW + 1)]) for form, symbols in CLASSES]
KINDS = ("assign", "access", "hex")


def own_entropy(value: Column) -> Column:
    """Bits of a text of at most WINDOW characters."""
    n = F.length(value)
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.get(F.array(*map(F.lit, LOGS)), n - F.length(F.replace(value, c, F.lit("")))))
    return F.log2(n.cast("double")) - total / n


def peak_entropy(value: Column) -> Column:
    """Bits of the window with the highest Shannon entropy, from incremental counts; of a shorter text those of all of it.

    The value is cut into parts of PART characters, each with the first characters of the next, so that
    taking a character doesn't read the value from its start and the time is linear in its length.
    """
    weigh = F.array(*map(F.lit, LOGS))
    gain = F.array(*(F.lit(b - a) for a, b in zip(LOGS, LOGS[1:], strict=False)))

    def least_sum(part: Column) -> Column:
        first = F.substring(part, 1, WINDOW)
        chars = F.filter(F.array_distinct(F.split(first, "")), lambda c: c != "")
        total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.get(weigh, WINDOW - F.length(F.replace(first, c, F.lit("")))))

        def step(acc: Column, i: Column) -> Column:
            # the window before place i loses its first character, then takes the character at its end
            rest = part.substr(i + 1, F.lit(WINDOW - 1))
            n_gone = WINDOW - 1 - F.length(F.replace(rest, part.substr(i, F.lit(1)), F.lit("")))
            n_come = WINDOW - 1 - F.length(F.replace(rest, part.substr(i + WINDOW, F.lit(1)), F.lit("")))
            return F.struct((acc["sum"] - F.get(gain, n_gone) + F.get(gain, n_come)).alias("sum"), F.least(acc["least"], acc["sum"]).alias("least"))

        steps = F.when(F.length(part) > WINDOW, F.sequence(F.lit(1), F.length(part) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(total.alias("sum"), F.lit(math.inf).alias("least")), step, lambda acc: F.least(acc["least"], acc["sum"]))

    cut = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    parts = F.zip_with(cut, F.slice(F.concat(cut, F.array(F.lit(""))), F.lit(2), F.size(cut)), lambda a, b: F.concat(a, F.left(b, F.lit(WINDOW - 1))))
    least = F.array_min(F.transform(F.filter(parts, lambda p: F.length(p) >= WINDOW), least_sum))
    return F.when(F.length(value) < WINDOW, own_entropy(value)).otherwise(F.lit(math.log2(WINDOW)) - least / WINDOW)


def suspicious(value: Column) -> Column:
    fine = F.lit(False)
    for form in ALLOWED:
        fine = fine | value.rlike(form)
    # a long word, also one of several words of which most letters are lower-case
    capitals = F.length(value) - F.length(F.regexp_replace(value, "[A-Z]", ""))
    fine = fine | (value.rlike(SPOKEN) & ((4 * capitals <= F.length(value)) | (capitals == F.length(value))))
    place = F.least(F.length(value), F.lit(WINDOW)) - SHORTEST
    need = F.lit(None).cast("double")
    for form, bits in reversed(THRESHOLDS):
        need = F.when(value.rlike(form), F.get(F.array(*map(F.lit, bits)), place)).otherwise(need)
    return ~fine & (peak_entropy(value) >= need)


def find_secrets(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_columns, text, base (spans of the base kinds) and spans (all, by start) of every document."""
    rows = docs.select(*id_columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    likely = {
        "assign": F.col("text").rlike(r"[:=]"),
        "access": F.contains(F.col("text"), F.lit("AKIA")),
        "hex": F.col("text").rlike(r"[0-9a-f]{24}"),
        "entropy": F.col("text").rlike(rf"[A-Za-z0-9+/_=-]{{{SHORTEST}}}"),
    }
    forms = {"assign": ASSIGN + VALUE, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    rows = S.with_matches(rows, "text", {k: (forms[k], likely[k]) for k in forms})
    value = lambda v: F.length(F.regexp_replace(v, "^" + ASSIGN, "")) >= 6
    every = lambda v: F.lit(True)
    base = S.ordered(F.concat(S.matches("assign", 0, value), S.matches("access", 1, every), S.matches("hex", 2, every)), "start", "rank")
    rows = rows.select(*id_columns, "text", base.alias("base"), S.matches("entropy", 3, suspicious).alias("more"))
    more = F.filter("more", lambda s: ~S.overlapping(s, F.col("base")))
    return rows.select(*id_columns, "text", "base", S.ordered(F.concat("base", more), "start", "rank").alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Documents with each secret in their text replaced by a label; n_chars follows. Texts without one stay as they are.

    The documents' columns travel as one struct, so none of them can clash with those made here.
    """
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), ("row",))
    label = S.redacted("text", "spans", lambda kind: F.concat(F.lit("[SECRET:"), kind, F.lit("]")))
    found = found.select("row", F.when(F.col("row.text").isNotNull(), label).alias("text"), (F.size("spans") > 0).alias("hit"))
    own = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(own["n_chars"])
    return found.select(*(F.col("text") if c == "text" else own[c].alias(c) for c in docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS), F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))
