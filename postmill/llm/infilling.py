"""Fill-in-the-middle: a text is cut at two ranks of its units and its parts are put in another order.

Units are the matches of a pattern, found left to right; by default every code point is one. A text is read
twice and no list of its units is ever made: the first pass counts the matches, which fixes both ranks,
the second advances one lazy iterator of matches to the lower rank and on to the higher one. What a text
takes besides itself and its output is therefore the same for every length.

The cut after rank k lies at the end of the k-th match (rank 0: the start of the text), so what stands between
two units goes with the latter, and what follows the last match is part of the suffix.

Edges: a null text is empty; an empty text, a text in which one of the three marks occurs and a text without any
unit at a rank stay what they are (the first two in form "plain"). Rows repeat as they come. A null doc_id counts as an
empty number, so such rows are cut alike. The draws depend on doc_id and seed alone, never on order or partitions.
Other columns are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import sliced, table

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"


def counted(pattern: re.Pattern, text: str) -> int:
    """First pass: how many units a text has."""
    return sum(1 for _ in pattern.finditer(text))


def cuts(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the ends of the low-th and the high-th unit, by one iterator that stops there."""
    units = pattern.finditer(text)
    first = next(islice(units, low - 1, None)).end() if low else 0
    return first, next(islice(units, high - low - 1, None)).end() if high > low else first


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain: int = 10, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of every document.

    `plain` percent of the documents stay plain; of the others `suffix_first` percent are written suffix, prefix,
    middle ("spm") and the rest prefix, suffix, middle ("psm"). No mark may overlap itself or another one.
    """
    pattern = re.compile(unit)
    if pattern.match(""):
        raise ValueError("a unit has at least one character")
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"the marks {a!r} and {b!r} overlap")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            out = []
            for text, h1, h2, form in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("h1", "h2", "form")), strict=True):
                text = text.as_py()
                n = counted(pattern, text)
                if not text or any(mark in text for mark in marks):
                    form = "plain"
                if form == "plain":
                    out.append((n, form, None, None, text))
                    continue
                a, b = cuts(pattern, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
                before, between, after = text[:a], text[a:b], text[b:]
                if form == "psm":
                    joined = f"{marks[0]}{before}{marks[1]}{after}{marks[2]}{between}"
                else:
                    joined = f"{marks[1]}{after}{marks[0]}{before}{marks[2]}{between}"
                out.append((n, form, a, b - a, joined))
            columns = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    form = F.when(h3 % 100 >= 100 - plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A mark never occurs in a part, so its first place is where it was put."""

    def halves(text: Column, mark: str) -> tuple[Column, Column]:
        at = F.instr(text, mark)
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(mark), F.length(text))

    _, rest = halves(output, marks[0])
    before, rest = halves(rest, marks[1])
    after, between = halves(rest, marks[2])
    psm = F.concat(before, between, after)
    _, rest = halves(output, marks[1])
    after, rest = halves(rest, marks[0])
    before, between = halves(rest, marks[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(before, between, after)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as x from documents),
h as (select *, length(text) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
    least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
p as (select *, substring(text, 1, a) as pre, substring(text, a + 1, b - a) as mid, substring(text, b + 1) as suf from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(text) as restored_sha256
from p
"""
