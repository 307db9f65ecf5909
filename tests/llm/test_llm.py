"""The training-data operators against brute force, exact round trips and odd rows."""

import hashlib
import math
import os
import random
import re
import string
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.llm import common, decontaminate, entries, jaccard, licenses, linear, packing, pii, quality, rules, secrets, sharding, toxicity

DATA = os.environ.get("POSTMILL_TEST_DATA", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    extra = ", label int, score double, row long, spans string, size int, words string, held_out string, slot int, shard int, base string, hit int, ids int, t int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, 7, "x", 3, "w", "h", 1, 2, "b", 1, 4, 5) for i, t in rows], SCHEMA + extra)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id row text here"), (6, LONG), (7, "x" * 50_000), (8, "a@b.c and password=secret123 " * 50)]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("name", sorted(entries.sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    ours, theirs = entries.QUERIES[name](spark, DATA).toPandas(), con.execute(entries.sql()[name]).df()
    show = lambda x: "" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) and x % 1 else str(int(x)) if isinstance(x, float) else str(x)
    tidy = lambda df: sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(ours.columns) == sorted(theirs.columns) and tidy(ours) == tidy(theirs)


def operators(spark, docs, labels):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    return {
        "quality": lambda: quality.score_quality(docs, labels),
        "rules": lambda: rules.judge(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, labels),
        "licenses": lambda: licenses.scan(docs),
        "pii": lambda: pii.find_personal(docs),
        "sanitise": lambda: pii.sanitise(docs),
        "sharding": lambda: sharding.place(docs, "doc_id", sharding.names(5), 101),
        "secrets": lambda: secrets.find_secrets(docs),
        "redaction": lambda: secrets.redact_secrets(docs),
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
        "decontaminate by joins": lambda: decontaminate.decontaminate(docs, bench, index_words=0),
        "jaccard": lambda: jaccard.jaccard_classes(docs),
        "packing": lambda: packing.best_fit(docs).where("piece = 0"),
    }


def test_odd_rows(spark, labels):
    for name, run in operators(spark, docs_of(spark, ODD), labels).items():
        assert run().count() == len(ODD), name


def test_odd_rows_have_their_defined_results(spark, labels):
    docs = docs_of(spark, ODD)
    run = {name: list(make().collect()) for name, make in operators(spark, docs, labels).items()}

    def of(name, *columns):
        """Values by doc_id, one for each of its rows."""
        out = {}
        for r in run[name]:
            out.setdefault(r.doc_id, []).append(r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns))
        return out

    short = {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 3), 5: (1, 3), None: (5, 17), 6: (30_000, len(LONG.replace(" ", ""))), 7: (1, 50_000), 8: (150, 50 * 26)}
    assert {k: set(v) for k, v in of("rules", "n_words", "word_chars").items()} == {k: {v} for k, v in short.items()}
    assert {k: v[0] for k, v in of("rules", "n_repeat_words").items() if v[0]} == {6: 30_000, 8: 150} and all(r.base_failed and not r.kept for r in run["rules"])
    assert all((r.n_units, r.license, r.dice) == (0, None, None) for r in run["licenses"])
    assert {k: len(v[0]) for k, v in of("pii", "spans").items() if v[0]} == {8: 50}
    hidden = dict(ODD) | {8: "[EMAIL] and password=secret123 " * 50}
    assert {k: v[0] for k, v in of("sanitise", "text").items()} == hidden
    assert {k: v[0] for k, v in of("redaction", "text").items()} == dict(ODD) | {8: "a@b.c and [SECRET:assign] " * 50}
    assert {k: len(v[0]) for k, v in of("secrets", "spans").items() if v[0]} == {8: 50}
    placed = {}
    for r in sharding.place(docs, "doc_id", sharding.names(5), 101).collect():
        placed.setdefault(r.doc_id, set()).add((r.slot, r.shard))
    assert all(len(x) == 1 and None not in x for x in placed.values())
    for name in ("decontaminate", "decontaminate by joins"):
        assert {k: v[0] for k, v in of(name, "n_words", "n_hit", "n_items").items()} == {1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 0, 0), 5: (1, 0, 0), None: (5, 0, 0), 6: (30_000, 0, 0), 7: (1, 0, 0), 8: (300, 0, 0)}
    like = {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 2), 5: (4, 2), None: (None, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0)}
    assert {k: set(v) for k, v in of("jaccard", "class_id", "n_links").items()} == {k: {v} for k, v in like.items()}
    ends = {}
    for r in packing.best_fit(docs).collect():
        ends.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {x[2] for k in (1, 2) for x in ends[k]} == {1} and len({x[1:] for k in (1, 2) for x in ends[k]}) == 1
    assert len({x for k in (4, 5) for x in ends[k]}) == 1 and [len(ends[k]) for k in (4, 5)] == [1, 2] and len(ends[6]) > 30
    for name in ("quality", "toxicity"):
        scores = of(name, "score")
        assert all(0 <= x <= 1 for v in scores.values() for x in v) and scores[1] == scores[2] and {*scores[4]} == {*scores[5]}


def test_empty_tables(spark, labels):
    for name, run in operators(spark, docs_of(spark, []), labels).items():
        assert run().count() == 0, name
    none = docs_of(spark, ODD[:4])
    assert {r.score for r in quality.score_quality(none, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(none, labels.limit(0)).collect()} == {0.5}
    assert not decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count()


def test_index_and_joined_fingerprints_agree(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.first().text
    odd = [(901, item), (901, item), (None, "x " + item + " y"), (902, "tiny phrase"), (903, "a Tiny, phrase."), (904, None), (905, "")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(spark.createDataFrame([("s1", "Tiny phrase"), ("s2", "tiny  phrase"), ("e", ""), (None, None), (None, item)], "item_id string, text string"))
    one, many = decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, index_words=0)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    got = Counter((r.doc_id, r.contaminated, r.n_items >= 1) for r in one.where("doc_id > 900 or doc_id is null").collect())
    assert got == {(901, True, True): 2, (None, True, True): 1, (902, True, True): 1, (903, True, True): 1, (904, False, False): 1, (905, False, False): 1}


@pytest.mark.parametrize("seed", range(6))
def test_winnowing_finds_every_window(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "c", "dd", "e"][: 2 + seed % 4])
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 3, 9, 10, 15, 40])))) for i in range(12)] + [(99, "")]
    index = decontaminate.Index(items, 10, 5)
    for _ in range(30):
        words = [word().encode() for _ in range(draw.randrange(60))]
        hit, found = set(), set()
        for item_id, text in items:
            own = text.encode().split()
            m = min(10, len(own))
            for q in range(len(own) - m + 1) if m else ():
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == own[q : q + m]:
                        hit |= set(range(p, p + m))
                        found.add(item_id)
        spans, ids = index.spans(common.word_hashes(words, common.WordHashes()))
        assert (set().union(*(range(a, b) for a, b in spans)) if spans else set(), ids) == (hit, found)


def brute_sets(rows, n=5):
    """Sets of runs of n words, by a plain reading of the definition."""
    out = []
    for _, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        out.append({tuple(words[i : i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def brute_classes(rows, threshold=Fraction(4, 5)):
    """{doc_id: (class, links)} from all pairs that share a run."""
    sets, owners = brute_sets(rows), {}
    for i, own in enumerate(sets):
        for run in own or {None}:
            owners.setdefault(run, []).append(i)
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, own in enumerate(sets):
        shared = Counter(j for run in own or {None} for j in owners[run] if j != i)
        for j, k in shared.items():
            if not own or Fraction(k, len(own) + len(sets[j]) - k) >= threshold:
                links[i] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    least = {d: min(g) for g in groups.values() for d in g}
    return {d: (least[d], n) for (d, _), n in zip(rows, links, strict=True)}


def test_jaccard_recall_in_split_buckets(spark):
    """Pairs near the threshold whose texts all share long passages, so that every bucket of a passage is split."""
    draw, rows = random.Random(21), []
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(3)]
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(130)]
        first = passages[i % 3] + own
        second = first[:]
        for at in draw.sample(range(70, 186, 6), 3 + i % 2):  # each change touches five runs: 0.83 to 0.78
            second[at] = f"c{i}x{at}"
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(second))]
    want = brute_classes(rows)
    links = sum(n for _, n in want.values())
    assert 200 <= links <= 600
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for options in ({}, {"whole": 40, "block": 32}, {"whole": 40, "block": 32, "depth": 1}):
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(df, **options).collect()}
        assert all(n <= want[d][1] for d, (_, n) in got.items())  # no link that isn't one
        recall = sum(n for _, n in got.values()) / links
        print(f"links found {recall:.4f} with {options}")
        assert recall >= 0.99


def test_jaccard_large_buckets_lose_no_links(spark):
    words = random.Random(11)
    templates = [[words.choice("abcdefgh") + str(words.randrange(10**6)) for _ in range(64)] for _ in range(4)]
    rows = [(100 * k + i, " ".join([*t[:30], f"v{i}", *t[31:]])) for k, t in enumerate(templates) for i in range(100)]
    # a common line alone makes no links; beyond SAMPLE tokens only a part of a set is compared
    line = " ".join(templates[0][:10])
    rows += [(1000 + i, line + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(100)]
    long = [f"l{j}" for j in range(300)]
    rows += [(2000 + i, " ".join([*long[: 20 + i], f"v{i}", *long[20 + i :]])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"whole": 40, "block": 32}, {"whole": 40, "block": 32, "depth": 1}, {"whole": 40, "block": 32, "depth": 0}):
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(df, **options).collect()}
        assert got == {i: (i, 0) if 1000 <= i < 2000 else (i // 100 * 100, 99) for i, _ in rows}


def test_prefixes_cover_what_like_sets_share():
    whole, sampled = jaccard.prefixes(0.8, 3e-5)
    assert whole[:6] == [1, 1, 1, 1, 1, 2] and whole[60] == 13
    assert all(a <= b <= c + 1 for c, (a, b) in enumerate(zip(whole, sampled, strict=True)))
    draws = np.random.default_rng(5).binomial(64, 0.8, 400_000)
    assert np.mean(draws < 64 - sampled[64] + 1) <= 6e-5


def test_jaccard_against_brute_force(spark):
    draw = random.Random(1)
    base = [f"w{draw.randrange(5000)}" for _ in range(300)]
    rows = texts()
    at = max(i for i, _ in rows) + 1
    for k in range(60):  # a group of near copies and a passage that many others share
        own = base[:]
        for _ in range(1 + k % 6):
            own[draw.randrange(300)] = f"x{draw.randrange(5000)}"
        rows.append((at + k, " ".join(own)))
        rows.append((at + 100 + k, " ".join(base[:60] + [f"y{draw.randrange(9000)}" for _ in range(200)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for options in ({}, {"block": 16, "whole": 24, "depth": 4}):  # also with splits and block pairs
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(df, **options).collect()}
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    edges += [(3000, i) for i in range(2000, 2600)] + [(i, 3001) for i in range(2300, 2800)]  # hubs, which are broadcast
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {i: 2000 for i in [*range(2000, 2800), 3000, 3001]}


def test_a_long_chain_converges(spark):
    order = random.Random(5).sample(range(700), 700)
    got = common.components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 700


def test_facts_of_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id") % 7).cast("long").alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 3").withColumn("f", F.col("k") * 10)
    got = common.with_facts(rows, facts, "k", "n", 3000)
    assert got.columns == ["k", "id", "f"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, 10 * k) for i in range(3000) for k in [1 if i < 1000 else i % 7] if k != 3)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*texts()[:120], (-1, None), (-2, "a  b\n\n c <|endoftext|> 'll"), (-3, LONG), (-4, " lead and trail "), (-5, "hello <|endoftext|> world"), (-6, "<|endoftext|><|endoftext|> <|end"), (-7, "")]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert [i for r in own for i in r.ids] == ids.tolist()
    assert tokenizer.encode(rows[-3][1], add_special_tokens=False).ids.count(50256) == 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_a_licence_beside_another(spark):
    gpl = dict(licenses.TEXTS)["GPL-3.0"].split("\n\n")[0].replace("\n", " ").rstrip(".")
    inside = f"We say to all who ask us about this archive of old prints that {gpl} and that nothing else is to be said about it by anyone at all in this house"
    line, bsd = "Released under the MIT License.", "This software is released under the BSD 3-Clause License."
    rows = {f"{line}\n{inside}": (2, "GPL-3.0"), inside: (1, "GPL-3.0"), f"{inside}\n\n{line}": (2, "GPL-3.0"), f"{line} {line}": (2, "MIT"), line: (1, "MIT"), f"so {bsd[:-1]} as they say": (1, "BSD-3-Clause"), bsd: (1, "BSD-3-Clause")}
    rows[f"Mind that all is, {line[:-1].lower()} it says, and that {bsd[:-1]} too it says here, in a long line of many words"] = (2, "BSD-3-Clause")
    got = licenses.scan(docs_of(spark, list(enumerate(rows)))).orderBy("doc_id").collect()
    assert {r.license for r in got[:1]} <= {"MIT", "GPL-3.0"} and all(r.dice > 0.75 for r in got)
    assert [r.n_units for r in got] == [n for n, _ in rows.values()]
    assert [r.license for r in got[1:] if r.n_units == 1] == [x for n, x in list(rows.values())[1:] if n == 1]


def test_licences_by_their_usual_words(spark):
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    texts = dict(licenses.TEXTS)
    rows = {
        "GPL-3.0": "Some prose first.\n\n" + gpl + "\n\nMore prose.",
        "BSD-3-Clause": texts["BSD-3-Clause"],
        "BSD-2-Clause": texts["BSD-2-Clause"],
        "BSD": "notes\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\nmore notes",
        "MIT": "Copyright 2020 Someone\n\n" + texts["MIT"].replace(", ", ",\n"),
        "Apache-2.0": "All of it was written at night. Licensed under the Apache License, Version 2.0. It ends here.",
        None: "Nothing of the kind is granted here, and the software is fine.",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows.values())], "doc_id long, text string")
    assert [r.license for r in licenses.scan(df).orderBy("doc_id").collect()] == list(rows)


def brute_window(text, threshold=0.75):
    """The licence of the likest run of words that begins with one of a template's bigrams and is as long."""
    words, found = re.findall("[a-z0-9]+", text.lower()), []
    for name, template in licenses.TEMPLATES:
        own = re.findall("[a-z0-9]+", template.lower())
        grams = set(zip(own, own[1:]))
        for i in range(len(words) - 1):
            here = words[i : i + len(own)]
            got = set(zip(here, here[1:]))
            if (words[i], words[i + 1]) in grams and 2 * len(got & grams) >= threshold * (len(got) + len(grams)):
                found.append((-2 * len(got & grams) / (len(got) + len(grams)), -len(grams), name))
    return min(found)[2] if found else None


def test_notices_inside_longer_sentences(spark):
    gpl = dict(licenses.TEXTS)["GPL-3.0"].split("\n\n")[0]
    rows = {
        "a long evening went by and " * 30 + "it was released under the\nMIT License so that all may have it " + "and so on " * 30: "MIT",
        "Mind that the pictures are licensed under CC BY-SA 4.0 unless we say otherwise in the text below it.": "CC-BY-SA-4.0",
        "Mind that the words, licensed under CC BY 4.0": "CC-BY-4.0",
        "He read aloud that " + gpl.rstrip(".") + " and then he closed the book and went to sleep for a very long time, as did all of us " * 3: "GPL-3.0",
        "They spoke of software, of the license that nobody has, of apache, of general public interest and of redistribution " * 9: None,
        "licensed licensed under under the the apache license license version": None,
        "Released under the MIT License.": "MIT",
        "license": None,
    }
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert [r.license for r in got] == list(rows.values()) == [brute_window(t) for t in rows]
    assert [r.n_units for r in got] == [1 if x else 0 for x in rows.values()] and got[0].dice == got[6].dice == 1


def test_rules_abstain_without_a_stop_list(spark):
    russian = " ".join(f"слово{i} и другое{i}" for i in range(40))
    english, junk = " ".join(f"the word{i} of a{i}" for i in range(40)), " ".join(f"zork{i} blat{i}" for i in range(40))
    rows = [(1, russian, None), (2, russian, "ru"), (3, english, "en"), (4, junk, None), (5, junk, "en"), (6, junk, "fi")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, True), 4: (False, False), 5: (False, False), 6: (False, True)}
    assert {r.kept for r in rules.judge(spark.createDataFrame([r[:2] for r in rows[:1]], "doc_id long, text string")).collect()} == {True}


def naive_best_fit(lengths, room, most):
    """The open bin with the least free space that fits, the last one of equals; the fullest, the last one of equals, closes."""
    free, out, made = {}, [], 0
    for n in lengths:
        fitting = [b for b in free if free[b] >= n]
        if fitting:
            least = min(free[b] for b in fitting)
            here = [b for b in fitting if free[b] == least][-1]
            left = free.pop(here)
        else:
            here, left, made = made, room, made + 1
        out.append((here, room - left))
        if left > n:
            free[here] = left - n  # put last, as the one touched last
            if len(free) > most:
                least = min(free.values())
                del free[[b for b in free if free[b] == least][-1]]
    return out


@pytest.mark.parametrize("most", [1, 3, 16, 1000])
def test_best_fit_against_a_naive_packer(most):
    draw = random.Random(most)
    lengths = [draw.randrange(1, 65) for _ in range(2000)]
    packer = packing.BestFit(64, most)
    assert [packer.put(n) for n in lengths] == naive_best_fit(lengths, 64, most)


def test_packing_is_tight_and_spreads_equal_ids(spark):
    draw = random.Random(4)
    rows = [(None if i % 2 else 7, " ".join(f"w{draw.randrange(999)}" for _ in range(draw.randrange(1, 400)))) for i in range(3000)]
    df = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), open_bins=64, group_documents=300)
    got = df.collect()
    assert len({r.sequence_id >> 36 for r in got}) == 10  # null and repeated ids don't gather in a group
    assert Counter(r.doc_id for r in got if r.piece == 0) == {None: 1500, 7: 1500}
    tight = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total, made = sum(r.length for r in tight), len({r.sequence_id for r in tight})
    assert total == sum(r.length for r in got) and made <= total / 1024 / 0.97  # half of these pieces are over 600 long


def test_the_fullest_bin_closes_in_the_order_of_arrival(spark):
    draw = random.Random(9)
    lengths = {row: draw.randrange(1, 1024) for row in range(1500)}
    made = spark.createDataFrame([(row, row, 0, 0, n, 0) for row, n in lengths.items()], packing.PIECES)
    order = [r.row for r in made.orderBy(F.xxhash64("row", F.lit(12)), "row").select("row").collect()]
    counts = {}
    for most in (4, 64, 2000):
        got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(made, 1500, open_bins=most).collect()}
        assert [got[row] for row in order] == naive_best_fit([lengths[row] for row in order], 1024, most)
        counts[most] = len({here for here, _ in got.values()})
    assert counts[4] > counts[64] > counts[2000] or counts[4] > counts[64] == counts[2000]
    packer = packing.BestFit(1024, 64)
    for row in order:
        packer.put(lengths[row])
    assert packer.closed > 100 and [lengths[row] for row in order] != sorted(lengths.values(), reverse=True)


def test_other_tokenizer_files_go_through_the_tokenizer(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    stored = json.load(open(path, encoding="utf-8"))
    changed = [("pre_tokenizer", stored["pre_tokenizer"] | {"add_prefix_space": True}), ("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", stored["pre_tokenizer"] | {"use_regex": False})]
    files = [(path, True), (public_tokenizers.path("word_bpe_49k.json"), False)]
    for i, (key, value) in enumerate(changed):
        (tmp_path / f"{i}.json").write_text(json.dumps(stored | {key: value}), encoding="utf-8")
        files.append((str(tmp_path / f"{i}.json"), False))
    for file, plain in files:
        encoder, whole = packing.Encoder(file), Tokenizer.from_file(file)
        assert encoder.plain == plain
        for text in ("Hello World again and again", "a  b\n c", "", "Ünder the SEA 42"):
            assert np.frombuffer(encoder(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_best_fit_is_bounded():
    draw, packer = random.Random(2), packing.BestFit(1024, 16)
    used = {}
    for _ in range(5000):
        n = draw.randrange(1, 1024)
        here, offset = packer.put(n)
        assert used.get(here, 0) == offset
        used[here] = offset + n
        assert used[here] <= 1024 and packer.open <= 16
        assert packer.open == sum(map(len, packer.bins)) and packer.bits == sum(1 << f for f, b in enumerate(packer.bins) if b)


FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    out = []
    for kind, form in FORMS:
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def noise(seed, alphabet, n=400):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


def test_personal_spans(spark):
    rows = [(i, noise(i, "a1.@-+ 4é😀_b(")) for i in range(60)] + [(100 + i, noise(i, "0123456789.  -+")) for i in range(60)] + [(300, "x a@b.c_d@e.f y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 4111 1111 1111 1111 +1 (383) 555-6083.")]
    got = {r.doc_id: r.base for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[doc_id]] == personal(text)


def brute_disclosing(texts, disclosure=0.9, support=3):
    """For each text the places of its disclosing words, counted as the definition says."""
    read = []
    for text in texts:
        base = [(kind, m) for kind, form in FORMS for m in re.finditer(form, text) if f"{kind}:{m.start()}:{m.end()}" in personal(text)]
        places = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", text) if not any(m.start() < b.end() and b.start() < m.end() for _, b in base)]
        around = {}
        for kind, m in sorted(base, key=lambda x: x[1].start()):
            digits, value = re.sub("[^0-9]", "", m[0]), m[0].lower()
            keys = [value, value[value.rindex("@") :]] if kind == "email" else [value, value[: value.rindex(".") + 1]] if kind == "ip" else [digits]
            for key in keys:
                around.setdefault((kind, key), (text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]))
        read.append((around, places))
    n = len(texts)
    with_entity = Counter(e for around, _ in read for e in around)
    with_term = Counter(t for _, places in read for t in {p[0] for p in places})
    both = Counter((e, t) for around, places in read for e in around for t in {p[0] for p in places})
    contexts = {}
    for around, places in read:
        for e, where in around.items():
            for t in {p[0] for p in places}:
                contexts.setdefault((e, t), set()).add(where)
    told = set()
    for (e, t), k in both.items():
        if len(contexts[e, t]) >= support and with_entity[e] < n:
            told |= {(e, t)} if math.log2(k * n / (with_term[t] * with_entity[e])) >= disclosure * -math.log2(with_entity[e] / n) - 1e-9 else set()
    return [[(s, e) for t, s, e in places if any((key, t) in told for key in around)] for around, places in read]


def test_disclosing_terms_against_brute_force(spark):
    draw, rows = random.Random(8), []
    mails = [f"user{i}@{d}" for i in range(4) for d in ("alpha.org", "beta.net")]
    for i in range(150):
        words = [f"w{draw.randrange(60)}" for _ in range(draw.randrange(5, 40))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            mail = draw.choice(mails)
            words.insert(draw.randrange(len(words)), f"<{mail}>")
            words += [f"friend{mail[4]}", "transport" if "alpha" in mail else "harbour,port"] if draw.random() < 0.9 else []
        if draw.random() < 0.2:
            words.append(f"at 10.2.3.{draw.randrange(9)} Subnét")
        rows += [(i, " ".join(words))] * draw.choice([1, 1, 1, 4])
    got = sorted((r.doc_id, [(s.start, s.end) for s in r.spans if s.kind == "term"]) for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_disclosing([t for _, t in rows])
    assert got == sorted((i, found) for (i, _), found in zip(rows, want, strict=True))
    told = {t[s:e].lower() for (_, t), found in zip(rows, want, strict=True) for s, e in found}
    assert {"subnét", "harbour", "transport"} <= told and len(told) < 20


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} Zanzibar wrote to x@y.org about thing{i * 7} and common words" + " a line apart" * 30 + "\nzanzibar") for i in range(6)] + [(50 + i, f"common words and other{i} wrote to about a line apart") for i in range(40)]
    for times in (1, 4):  # repeated rows count on both sides
        df = spark.createDataFrame(rows * times, "doc_id long, text string")
        got = {r.doc_id: [(s.value, s.start) for s in r.spans if s.kind == "term"] for r in pii.find_personal(df).collect()}
        assert all([w.lower() for w, _ in got[i]] == ["zanzibar"] * 2 for i in range(6)) and not any(got[50 + i] for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "anzibar" not in clean[0] and "[EMAIL]" in clean[0] and "x@y.org" not in clean[0] and clean[50] == rows[6][1]
    copies = spark.createDataFrame([(i, "one notice by Quillon to a@b.cd, copied whole") for i in range(30)] + rows[6:], "doc_id long, text string")
    assert not pii.find_personal(copies).selectExpr("explode(spans) s").where("s.kind = 'term'").count()


def secret_base(text):
    out = []
    for rank, (kind, form, least) in enumerate((("assign", r"""(?:(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(form, text) if len(m[1]) >= least]
    return [s for *_, s in sorted(out)]


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in (text.count(x) for x in set(text)))


def test_secret_spans(spark):
    draw = random.Random(5)
    parts = ["password=", "Token : ", "api_key='", "secret==", "AKIA", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "é", " ", "\n", "abc", '"', "12345"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(80))) for i in range(80)] + [(200, "see Xk3v9QpL7mZt2RwY8nBc and 123e4567-e89b-12d3-a456-426614174000 zzzzzzzzzzzzzzzzzzzzzzzz1")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[doc_id].base] == secret_base(text)
    assert [s.value for s in got[200].spans] == ["Xk3v9QpL7mZt2RwY8nBc"]


def test_random_keys_are_secrets_and_named_things_not(spark):
    draw, b62 = random.Random(12), string.ascii_letters + string.digits
    kinds = [(b62, 20), (b62, 24), (b62, 32), (b62 + "+/", 24), (b62 + "+/", 40), (b62 + "-_", 40), (string.ascii_lowercase + string.digits, 20), ("0123456789abcdef", 20)]
    rows = [(f"{len(a)}x{n}", key) for a, n in kinds for key in ("".join(draw.choice(a) for _ in range(n)) for _ in range(600)) if re.search("[0-9]", key) and re.search("[A-Za-z]", key)]
    rows += [("plain", x) for x in ("usr/local/lib/python3/site-packages", "2024-01-02T10-20-30Z", "2024-01-02-backup-server", "your-api-key-goes-here-1", "placeholder_of_some_token_12", "some_long_identifier_name12", "Articles/PageTitleOfThis/part2", "123e4567-e89b-12d3-a456-426614174000")]
    rows += [("secret", x) for x in ("Qz/7hT9kPw2LmXv4RtYbN8sD", "2024-01-02Qz7hT9kPw2LmXv4RtYbN8sD", "Qz7hT9kPw2LmXv4RtYbN8sDexample")]
    got = Counter((r.k, r.s) for r in spark.createDataFrame(rows, "k string, v string").select("k", secrets.suspicious(F.col("v")).alias("s")).collect())
    assert got["plain", True] == 0 and got["secret", False] == 0
    assert all(got[k, False] <= 3 for k, _ in rows if k != "plain")
    # the threshold is the quantile that it says: drawn again
    for (_, bits), a in zip(secrets.THRESHOLDS, ("0123456789abcdef", string.ascii_lowercase, string.ascii_letters, string.ascii_lowercase + string.digits, b62), strict=True):
        for n in (secrets.SHORTEST, secrets.WINDOW):
            assert np.mean([entropy("".join(draw.choice(a) for _ in range(n))) < bits[n - secrets.SHORTEST] for _ in range(20_000)]) <= 2 * secrets.MISS


def test_short_keys_and_keys_of_letters(spark):
    draw = random.Random(21)
    b62, b36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    kinds = [(a, n) for a in (b62, b36, b62 + "+/", b62 + "-_", "0123456789abcdef") for n in (16, 17, 18, 19)]
    kinds += [(a, n) for a in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase) for n in (24, 28, 32, 48)]
    rows = [(f"{len(a)}x{n}", f"so {key} it is") for a, n in kinds for key in ("".join(draw.choice(a) for _ in range(n)) for _ in range(500)) if not key.isdigit()]
    named = "DonaudampfschifffahrtskapitaenAnzug antidisestablishmentarianism pneumonoultramicroscopic AbstractSingletonProxyFactoryBean HTTPServerResponseWriter Undschlichgeheit"
    named += " release20240102030405 user1234567890123456 0123456789012345abc internationalization2024 counterrevolutionaries SupercalifragilisticExpialidocious some/long/path/to/file1"
    rows += [("plain", w) for w in named.split()]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = Counter((rows[r.doc_id][0], len(r.spans) > 0) for r in secrets.find_secrets(df).collect())
    assert got["plain", True] == 0
    for k in {k for k, _ in rows} - {"plain"}:  # a key with separators needs a digit, which 16 random characters may lack
        assert got[k, False] <= (0.05 if k.startswith("64") else 0.025) * (got[k, False] + got[k, True]), k


def test_entropy_by_increments(spark):
    rows = [(noise(i, "abcdef0123456789XYZ+/", 20 + i * 3),) for i in range(20)]
    rows += [(noise(n, "ab0", n),) for n in (63, 64, 65, 83, 84, 127, 128, 129, 150, 600)]
    for r in spark.createDataFrame(rows, "v string").select("v", secrets.peak_entropy(F.col("v")).alias("h")).collect():
        assert r.h == pytest.approx(max(entropy(r.v[i : i + 20]) for i in range(len(r.v) - 19)))


def test_very_long_candidates_take_linear_time(spark):
    key = noise(3, string.ascii_letters + string.digits, 1_000_000)
    df = spark.createDataFrame([(1, f"key {key} end")], "doc_id long, text string")
    began = time.perf_counter()
    got = secrets.find_secrets(df).first().spans
    assert [(s.kind, s.start, s.end) for s in got] == [("entropy", 4, 1_000_004)]
    assert time.perf_counter() - began < 60  # seconds on one core; quadratic work takes hours


def test_very_many_matches(spark):
    rows = [(1, "x password=abcdefg1" * 5000)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).first().base
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer("password=abcdefg1x?", rows[0][1])]


def test_redaction(spark):
    rows = [(1, "say password=hunter22 and 0123456789abcdef01234567 end", 7), (2, "clean text", 10), (3, None, None)]
    got = {r.doc_id: r for r in secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1].text == "say [SECRET:assign] and [SECRET:hex] end" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("clean text", 10, None)


def test_lookup_table():
    owner = sharding.fill(sharding.names(7), 1009)
    counts = np.bincount(owner)
    assert len(counts) == 7 and counts.max() - counts.min() <= 1
    fewer = sharding.fill(sharding.names(7)[:-1], 1009)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.fill(sharding.names(3), 10)


def test_hinge_loss():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 > 0, 1.0, -1.0)
    w, b = linear.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.ones(300), rounds=100)
    assert ((x @ w + b) * y > 0).mean() > 0.97


def test_string_kernel():
    def kernel(a, b):
        def features(w):
            s, out = [toxicity.START, *toxicity.ASCII[[ord(c) for c in w]].tolist(), toxicity.END], {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1)):
                        key = (s[i] * 64 + s[j]) * 64 + s[k]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return out

        p, q = features(a), features(b)
        return sum(v * q.get(c, 0) for c, v in p.items()) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))

    words = ["idiot", "idxiot", "tionidi", "scum", "a"]
    columns = np.arange(64**3)
    rows = toxicity.feature_rows(words, columns, 64**3)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert float(rows[i] @ rows[j]) == pytest.approx(kernel(a, b), abs=1e-5)
    assert toxicity.pieces("i.d.i.o.t") == ["idiot"] and "idiot" in toxicity.units("you i d i o t now")


def made_up(n, seed, bad):
    draw = random.Random(seed)
    syllables = ["ba", "ko", "ri", "mel", "tun", "sa", "fo", "ling", "der", "pa"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randrange(20, 60))]
        if label := int(draw.random() < 0.4):
            words = bad(words, draw)
        out.append((seed * 10_000 + i, " ".join(words), label))
    return out


def held_out_accuracy(spark, rows, score, label):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    got = score(docs, labels).where("held_out").collect()
    truth = {i: y for i, _, y in rows}
    return sum(r.predicted == truth[r.doc_id] for r in got) / len(got)


def test_toxicity_held_out(spark):
    def insert(words, draw):
        for _ in range(2):
            insult = draw.choice(["xenquib", "wuzzcat", "yoggvex"])
            words[draw.randrange(len(words))] = draw.choice([insult, insult, ".".join(insult), insult[:3] + "-" + insult[3:]])
        return words

    assert held_out_accuracy(spark, made_up(500, 1, insert), toxicity.score_toxicity, "toxic") > 0.95


def test_quality_held_out(spark):
    junk = lambda words, draw: [w + "###" if draw.random() < 0.7 else w for w in words]
    rows = [(i, t, 1 - y) for i, t, y in made_up(400, 2, junk)]
    assert held_out_accuracy(spark, rows, quality.score_quality, "quality") > 0.95


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t, _ in made_up(120, 3, lambda w, d: w)]
    bench = " ".join(f"q{i}" for i in range(30))
    rows += [(900, rows[0][1], "en", "s", 1), (901, "start " + bench + " end", "en", "s", 1), (902, "keep this password=hunter22 in mind", "en", "s", 1), (903, "you xenquib you", "en", "s", 1)]
    toxic = [(1000 + i, f"some words and xenquib number {i}", "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows + toxic, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(r[0], 1, 0) for r in rows[:120]] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    want = {i for i, (least, _) in brute_classes([r[:2] for r in rows[:121]]).items() if i == least} | {902}
    assert got == want


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    bench = " ".join(f"q{i}" for i in range(30))
    clean = [(i, t) for i, t, _ in made_up(120, 3, lambda w, d: w)]
    toxic = [(1000 + i, f"some words and xenquib number {i}") for i in range(60)]
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, "you xenquib you"), (7, "you xenquib there"), (7, clean[0][1] + " end"), (None, clean[1][1] + " end"), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in clean + toxic + odd], SCHEMA)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.remove_toxic(spark, docs, str(tmp_path)).collect()}
    assert not got & set(odd[:2]) and set(odd[2:]) <= got
    odd = [(None, "start " + bench), (8, bench + " end"), (8, "a clean row"), (None, "another clean row"), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in odd], SCHEMA)
    found = corpus_pipeline.remove_contaminated(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and {(r.doc_id, r.text) for r in found.collect()} == set(odd[2:])
    long = " ".join(f"u{i}" for i in range(80))
    odd = [(None, "one text here"), (None, "one text here"), (5, long), (None, long), (6, long + " more"), (9, "nine a"), (9, "nine b"), (9, "nine a"), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in odd], SCHEMA)
    found = corpus_pipeline.remove_near_duplicates(spark, docs, str(tmp_path))
    got = Counter((r.doc_id, r.text) for r in found.collect())
    assert found.columns == docs.columns
    assert got in [{(None, "one text here"): 1, (5, long): 1, (9, "nine a"): 1, (9, "nine b"): 1, (None, empty): 1} for empty in (None, "")]


def test_stages_take_odd_tables(spark, tmp_path):
    """Null, empty, long and repeated rows and clashing columns, and none at all, through every stage in turn."""
    import corpus_pipeline

    clean = made_up(60, 7, lambda w, d: w)
    toxic = [(5000 + i, f"some words and xenquib number {i}", 1) for i in range(30)]
    spark.createDataFrame([(i, 1, 0) for i, *_ in clean] + [(i, 1, 1) for i, *_ in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([r[:2] for r in clean + toxic] + ODD, []):
        docs = docs_of(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            found = common.materialise(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert found.columns == docs.columns
                docs = found
        if not rows:
            assert found.count() == 0
            continue
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(1, None), (4, "one"), (6, LONG), (7, "x" * 50_000), (None, "null id row text here")} <= kept  # 2 and 3 are as empty as 1, 5 as 4
        assert not any("password=" in (t or "") for _, t in kept) and not kept & {r[:2] for r in toxic}
        assert sum(len(r.ids) for r in found.collect()) == found.agg(F.sum("length")).first()[0]
        assert found.where("piece = 0").count() == docs.count()


def brute_decision(word, model):
    """Kernel decision of one word under the folded table, summed subsequence by subsequence."""
    out = []
    for part in toxicity.pieces(word):
        s, sums = [toxicity.START, *toxicity.ASCII[[ord(c) for c in part]].tolist(), toxicity.END], {}
        for i in range(len(s)):
            for k in range(i + 2, min(len(s), i + toxicity.SPAN + 1)):
                for j in range(i + 1, k):
                    code = (s[i] * 64 + s[j]) * 64 + s[k]
                    sums[code] = sums.get(code, 0) + toxicity.DECAY ** (k - i + 1)
        out.append(sum(v * float(model["table"][c]) for c, v in sums.items()) / math.sqrt(sum(v * v for v in sums.values())) + model["bias"])
    return max(out, default=model["bias"])


def toxic_examples(seed):
    rows = made_up(300, seed, lambda words, draw: [*words, draw.choice(["xenquib", "wuzzcat", "yoggvex", "pliddermot"])])
    return [(y, t.split()) for _, t, y in rows]


def test_toxicity_score_against_brute_force():
    model = toxicity.fit(toxic_examples(11))
    texts = ["ba kori xenquib", "meltun sa", "", "you,wuzzcat ba! x.e.n.q.u.i.b", "xenquib xenquib ko", "w u z z c a t"]
    for text, score in zip(texts, toxicity.scores(texts, model, toxicity.Decisions(model)), strict=True):
        floor = max(-1.0, model["bias"])
        top = sorted((max(floor, brute_decision(u, model)) for u, n in toxicity.units(text).items() for _ in range(n)), reverse=True)[:3]
        top += [floor] * (3 - len(top))
        margin = math.log(sum(math.exp(model["sharp"] * x) for x in top)) / model["sharp"]
        assert score == pytest.approx(1 / (1 + math.exp(-(model["slope"] * margin + model["offset"]))), abs=1e-4)


def test_folded_table_is_the_kernel_machine():
    """The table's decision is the Nyström kernel machine's: kernel row to landmarks, whitened, times its weights."""
    marks = ["xenquib", "wuzzcat", "badermot", "meltun"]
    column, table, used = toxicity.nystroem(marks)
    words = ["xenqguib", "wuzcat", "saba", "xenquib"]
    rows = toxicity.feature_rows(marks + words, np.arange(64**3), 64**3).astype(float)
    kernel = rows @ rows.T
    value, vector = np.linalg.eigh(kernel[:4, :4])
    features = kernel[4:, :4] @ vector / np.sqrt(value)
    ours = toxicity.projected(words, column, table.astype(np.float32)).astype(float)
    assert np.allclose(ours @ ours.T, features @ features.T, atol=3e-3)  # kept as short floats


def test_an_inserted_letter_does_not_hide_an_insult():
    model = toxicity.fit(toxic_examples(12))
    plain = "ba kori meltun sa fo lingder"
    assert toxicity.scores([plain], model, toxicity.Decisions(model))[0] < 0.7
    texts = [f"{plain} {w[:at]}{c}{w[at:]} ko" for w in ("xenquib", "wuzzcat", "yoggvex", "pliddermot") for at in range(1, len(w)) for c in "jhw"]
    caught = [s >= 0.7 for s in toxicity.scores(texts, model, toxicity.Decisions(model))]
    assert sum(caught) / len(caught) > 0.9


def test_dense_descent_agrees_with_the_sparse_one():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 6))
    y = np.where(x[:, 0] - x[:, 1] + draw.normal(size=200) > 0, 1.0, -1.0)
    one = linear.dual_coordinate_descent([(np.arange(6), r) for r in x], y, 6, np.ones(200), rounds=400)
    two = linear.dense_descent(np.vstack([x + 9, x]), np.arange(200, 400), y, np.ones(200), rounds=400)
    assert np.allclose(one[0], two[0], atol=0.02) and one[1] == pytest.approx(two[1], abs=0.02)


def test_quality_against_brute_force():
    """Ratios, weights' scale and the margin by a plain reading of the method."""
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["good", "fine", "Ok.", "x1"] if i % 2 else ["bad", "###", "x1", "lo lo"]) for _ in range(12)) for i in range(60)]
    rows, y = [quality.ngrams(t, quality.Words()) for t in texts], np.array([i % 2 for i in range(60)])
    model = quality.fit(rows, y)
    columns = sorted({int(c) for r in rows for c in r})
    count = {k: {c: 1 + sum(c in set(r.tolist()) for r, label in zip(rows, y, strict=True) if label == k) for c in columns} for k in (0, 1)}
    total = {k: sum(count[k].values()) + quality.WIDTH - len(columns) for k in (0, 1)}
    for c in columns:
        ratio = math.log(count[1][c] / total[1]) - math.log(count[0][c] / total[0])
        assert float(model["ratio"][c]) == pytest.approx(ratio, abs=1e-5)
    w = np.array([model["weight"][c] / model["ratio"][c] if abs(model["ratio"][c]) > 1e-6 else 0 for c in columns])
    for r, label in zip(rows, y, strict=True):
        v = np.array([model["ratio"][c] for c in r])
        margin = float(sum(w[columns.index(int(c))] * x for c, x in zip(r, v / np.linalg.norm(v), strict=True))) + model["bias"]
        assert margin == pytest.approx(quality.margin(r, model), abs=1e-4) and (quality.score_of(margin, model) >= 0.5) == bool(label)
    assert len(quality.ngrams("a b c", quality.Words())) == 3 + 1 + 1 + 1  # three words, one form, a pair and a triple of forms


def test_features_of_a_fit_stay_out_of_memory():
    words = [f"w{i:05d}x" for i in range(100_000)]
    column, features, _ = toxicity.nystroem([f"mark{i:03d}{chr(97 + i % 26)}" for i in range(200)])
    features = features.astype(np.float32)
    tracemalloc.start()
    made = toxicity.projected(words, column, features)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.shape == (100_000, features.shape[1]) and most < made.nbytes, (most, made.nbytes)
    assert (made[-100:] == toxicity.projected(words[-100:], column, features)).all()
    assert toxicity.projected([], column, features).shape == (0, features.shape[1])
