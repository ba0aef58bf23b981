import random
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from kalibra.llm import simhash


def plain_print(text, words=3):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    parts = [p for p in out.split(" ") if p]
    if not parts:
        return 0
    sh = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(prints):
    """Components by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def corpus(n=160, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "İx", "ÀB"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\x0b"), (n + 3, "x\x00y ﻿z \xa0w")]


def test_fingerprints():
    for _, text in corpus():
        assert int.from_bytes(simhash.fingerprint(text)) == plain_print(text)


def test_components_like_all_pairs(spark):
    rows = corpus()
    prints = [plain_print(t) for _, t in rows]
    want = dict(enumerate(plain_groups(prints)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (simhash.HOT, 3):  # with and without dealing out again
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, hot=hot).collect()}
        assert got == want


def test_links_within_a_hot_list(spark):
    """Fingerprints that nearly all share their postings."""
    rng = random.Random(1)
    prints = [0x1234567890ABCDEF ^ sum(1 << rng.randrange(12) for _ in range(2)) ^ (rng.randrange(4) << 60) for _ in range(80)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in set(signed)], "fp long")
    for hot in (10_000, 4):
        edges = simhash.links(df, simhash.Scratch(spark), hot)
        roots = {r.node: r.root for r in simhash.components(edges, simhash.Scratch(spark)).collect()}
        groups = plain_groups(prints)
        for i in range(80):
            for j in range(i):
                same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
                assert same == (groups[i] == groups[j])


def test_postings_cover_every_five_bytes():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.POSTINGS) for five in combinations(range(8), 5))


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(5, "a b c", "x"), (5, "a b c", "x"), (None, "a b c", "y"), (3, None, None)], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", 3), ("5", 5), ("5", 5), ("None", 5)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    kept = simhash.keep_one(docs.withColumnRenamed("fp", "row_"))
    assert kept.columns == ["doc_id", "text", "row_"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5"]
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_keep_one_catches_similar_texts(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, groups = [], {}
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 300, 1500]))]
        for c in range(rng.choice([1, 2, 5, 20])):
            words = list(base)
            for _ in range(len(words) // 60 if c else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert {groups[k] for k in kept} == set(range(25))  # no clean text is lost
    sets = {k: {tuple(rows[k][1].split()[i : i + 5]) for i in range(len(rows[k][1].split()) - 4)} for k in kept}
    for a in kept:
        for b in kept:
            assert a == b or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        assert simhash.differing(simhash.parities(a), simhash.parities(b)) <= len(np.setxor1d(a, b))
    a = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert simhash.differing(simhash.parities(a), simhash.parities(a[1000:])) > 700  # few fall together


def test_prefixes_of_similar_texts_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 80), dtype=np.uint64))
        common = np.sort(rng.choice(pool, len(pool) // 3, replace=False))
        rank = rng.permutation(len(common))
        drop = rng.integers(0, len(pool) // 5 + 1)
        b = np.delete(pool, rng.choice(len(pool), drop, replace=False))
        if 5 * len(b) >= 4 * len(pool):
            (x, n), (y, _) = (simhash.prefix(z, common, rank) for z in (pool, b))
            assert set(x.tolist()) & set(y.tolist())
            assert not set(x[:n].tolist()) & set(common.view(np.int64).tolist()) and set(x[n:].tolist()) <= set(common.view(np.int64).tolist())


@pytest.mark.parametrize("batch", [3, 1000])
def test_short_lists_and_long_ones(spark, batch):
    """Every pair of a list of up to SMALL rows, and all rows of the others, however batches cut them."""
    rng = random.Random(4)
    rows = [(k, 100 * k + i, 10, 0) for k in range(60) for i in range(rng.choice([1, 2, 3, 64, 65, 90]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = simhash.short_lists(spark.createDataFrame(rows, "k long, row long, size int, at int"), 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for k, row, _, _ in rows:
        by[k].append(row)
    pairs = {(max(a, b), min(a, b)) for x in by.values() if len(x) <= simhash.SMALL for a in x for b in x if a != b}
    assert {(r.a, r.b) for r in got if r.kind == 0} == pairs
    assert sorted((r.a, r.b) for r in got if r.kind == 1) == sorted((k, x) for k, own in by.items() if len(own) > simhash.SMALL for x in own)


def similar_groups(texts, words=5, similarity=0.8):
    """Of each text the first of its component, by all links of all pairs."""
    prints = [plain_print(t) for t in texts]
    sets = [set(simhash.shingles(t, words).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 3 or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def kept_like_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    want = sorted(set(similar_groups(texts)))
    print(len(texts), "texts", len(want), "groups", len(got), "kept")
    assert got == want


def variants(rng, n, length, least, most):
    base = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(length), rng.randint(least, most)):
            words[i] = f"v{rng.randrange(10**6)}"
        yield " ".join(words)


def test_groups_are_what_all_links_connect(spark):
    rng = random.Random(1)
    texts = [t for _ in range(2) for t in variants(rng, 100, 100, 1, 4)]
    rng.shuffle(texts)
    kept_like_all_pairs(spark, texts)


def test_long_lists_are_compared_in_full(spark):
    """Rows around a passage that all have, in pairs that are similar."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        own = [f"v{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(2):
            words = list(own)
            words[rng.randrange(30)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(words[:20] + passage + words[20:]))
    rng.shuffle(texts)
    kept_like_all_pairs(spark, texts)


def test_short_texts_are_found(spark):
    rng = random.Random(3)
    texts = []
    for n in range(9, 24):
        for _ in range(6):
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words), " ".join(words[1:] if rng.random() < 0.5 else words[:-1])]
    kept_like_all_pairs(spark, texts)


def test_common_shingles_are_compared_in_full(spark, monkeypatch):
    """With nearly all shingles common, so that all lists go by centres."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "OFTEN", 2)
    rng = random.Random(5)
    texts = [t for n in (30, 80) for t in variants(rng, 60, n, 1, 3)]
    rng.shuffle(texts)
    kept_like_all_pairs(spark, texts)


def test_a_long_list_of_alike_rows(spark):
    """5,000 rows that differ in one word each are one group."""
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(base[:30] + [f"x{i}"] + base[30:]) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]
