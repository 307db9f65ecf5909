"""SimHash classes against all pairs, its bit planes against plain distances, and odd rows."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import common, simhash
from test_llm import DATA, ODD, docs_of, texts


def plain_print(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, radius=3):
    prints = [plain_print(t) for _, t in rows]
    kinds = sorted(set(prints))
    up = {f: f for f in kinds}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, f in enumerate(kinds):
        for g in kinds[i + 1 :]:
            if (f ^ g).bit_count() <= radius:
                up[root(f)] = root(g)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, prints, strict=True)), key=str)


def test_query_equals_all_pairs(spark):
    got = sorted((tuple(r) for r in simhash.op12_simhash_near_dedup(spark, DATA).collect()), key=str)
    assert got == plain_classes(texts())
    assert len({r[2] for r in got}) < len(got)


def test_odd_rows(spark):
    rows = [*ODD, (None, None), (40, "ONE"), (41, "a b"), (42, "A  b"), (43, "a b c d"), (44, "é\x1cx É"), (-3, "a b c d")]
    got = sorted((tuple(r) for r in simhash.simhash_classes(docs_of(spark, rows)).collect()), key=str)
    assert got == plain_classes(rows)
    assert simhash.simhash_classes(docs_of(spark, [])).collect() == []
    only_null = simhash.simhash_classes(docs_of(spark, [(None, "no number at all"), (None, "no number at all")])).collect()
    assert [r.component_id for r in only_null] == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(0, 2**32))
def test_planes_equal_distances(radius, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, np.uint64)
    members = np.concatenate([base, *(base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 64, 30))])
    members = np.concatenate([members, members ^ (np.uint64(1) << np.uint64(rng.integers(0, 64)))])[:192]
    members = np.concatenate([members, np.zeros(192 - len(members), np.uint64)])
    queries, lanes = np.repeat(members, 3), np.tile(np.arange(3), 192)
    cells, hits = simhash.within(simhash.planes_of(members), queries, lanes, radius)
    found = np.zeros((192, 3), np.uint64)
    found[cells // 3, cells % 3] = hits
    got = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(192, -1), axis=1, bitorder="little").astype(bool)
    assert (got == (np.bitwise_count(members[:, None] ^ members[None, :]) <= radius)).all()


def classes_of(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=12), st.integers(0, 2**32), st.integers(0, 4))
def test_trees_are_those_of_all_links(sizes, seed, radius):
    rng = random.Random(seed)
    members, begins, edges = [], [], []
    for size in sizes:
        begins.append(len(members))
        own = [rng.getrandbits(64)]
        while len(own) < size:
            own.append(rng.choice(own) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) if rng.random() < 0.8 else rng.getrandbits(64))
        edges += [(begins[-1] + i, begins[-1] + j) for i in range(size) for j in range(i) if (own[i] ^ own[j]).bit_count() <= radius]
        members += own
    a, b = simhash.trees(np.array(members, np.uint64), np.array(begins), radius)
    assert len(a) == len(members) - len(set(classes_of(len(members), edges)))
    assert classes_of(len(members), zip(a.tolist(), b.tolist(), strict=True)) == classes_of(len(members), edges)


@pytest.mark.parametrize("whole, levels", [(1024, 4), (4, 1), (4, 2), (16, 4)])
def test_no_link_is_lost_by_dealing(spark, whole, levels):
    rng = random.Random(whole + levels)
    centre = [rng.getrandbits(64) for _ in range(40)]
    prints = set(centre)
    for c in centre[:8]:  # dense groups and chains beside lone fingerprints
        for _ in range(60):
            prints.add(c := (c if rng.random() < 0.5 else rng.choice(centre[:8])) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    prints = sorted(prints)
    signed = [f - 2**64 if f >> 63 else f for f in prints]
    nodes = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    found = simhash.link_trees(nodes, 3, whole, levels).distinct().collect()
    at = {f: i for i, f in enumerate(signed)}
    want = classes_of(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert classes_of(len(prints), [(at[r.a], at[r.b]) for r in found]) == want
