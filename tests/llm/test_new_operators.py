import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from kalibra.llm import bpe, kdmeans, runs
from kalibra.llm.shared import table
from tests.compare import DATA, assert_same

SF = f"{DATA}/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash."""
    texts = ["a b " * 40, "a b " * 40, None, "", " \n", "x" * 100_000, "one two three " * 9 + "\x85 end", "no id " * 20]
    keys = [0, 0, 1, 2, 3, 4, 5, None]
    return spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in zip(keys, texts)], "doc_id long, text string, ids string, n_tokens int, start int, runs int")


# Clustering


def plain_clusters(rows, k, rounds, size=64, scale=64):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(scale * float(x)) for x in vector]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}") if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for i in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == i]
            if mine:
                centres[i] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(key, *near(v)) for key, v in kept]
    per = {i: sum(d for _, d, o in found if o == i) for i in range(len(centres))}
    return sorted(((key, i, d, per[i], sum(per.values()), sha(",".join(map(str, centres[i])))) for key, d, i in found), key=str)


def test_clusters_of_the_table(spark):
    rows = [(r[0], r[1]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, kdmeans.op11_kdmeans(spark, SF).collect()), key=str) == plain_clusters(rows, 16, 3)


def test_clusters_in_sql(spark):
    assert_same(spark, kdmeans.op11_kdmeans, kdmeans.oracle())


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 7, "x") for k, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    tight = lambda c: [c + rng.random() / 50 for _ in range(64)]
    rows = [(i, tight(rng.choice([-3.0, 0.0, 2.5]))) for i in range(90)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (200, rows[1][1]), (201, None), (202, []), (203, [1.0] * 63), (204, [None] + [1.0] * 63), (205, [math.nan] + [1.0] * 63), (206, [math.inf] * 64), (None, rows[3][1]), (207, [0.0] * 64), (208, [-0.0] * 64), (209, [-1e-9] * 64)]
    assert sorted(map(tuple, kdmeans.clustered(vectors(spark, rows)).collect()), key=str) == plain_clusters(rows, 16, 3)
    few = rows[:5]
    assert sorted(map(tuple, kdmeans.clustered(vectors(spark, few)).collect()), key=str) == plain_clusters(few, 16, 3)
    assert kdmeans.clustered(vectors(spark, [])).count() == 0
    assert kdmeans.clustered(vectors(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="beyond"):
        kdmeans.clustered(vectors(spark, [(1, [1e20] * 64)])).count()


def forest(points, leaf, size):
    import pyarrow as pa

    found = kdmeans.leaves_of(points, leaf)
    data = lambda rows: pa.array([np.ascontiguousarray(x).tobytes() for x in rows], pa.binary())
    parts = [points[at] for at in found]
    cols = [pa.array([0] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array([at.tolist() for at in found]), data(p.astype(np.int32) for p in parts), pa.array([len(p) for p in parts]), *(data(f(p) for p in parts) for f in (lambda p: p.sum(0), lambda p: p.min(0), lambda p: p.max(0)))]
    return kdmeans.Forest(pa.RecordBatch.from_arrays(cols, names=list("abcdefgh")), size)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_filtering_is_exact_and_prunes(size):
    rng = np.random.default_rng(size)
    for spread, large in ((3, 0), (40, 0), (2000, 0), (2000, 1 << 24)):
        points = np.concatenate([rng.integers(-spread, spread + 1, (700, size)) + large + rng.integers(-9, 10) * spread for _ in range(4)])
        centres = np.concatenate([points[:12], points[:1]])  # with a tie that nothing may prune to the larger number
        f, seen, whole = forest(points, 16, size), [], 0
        for first, last, level, node, left in f.assigned(centres):
            own = np.concatenate([f.vectors(i) for i in range(first, last)])
            near = ((own[:, None] - centres) ** 2).sum(2).argmin(1)
            assert set(near.tolist()) <= set(left.tolist())
            if len(left) == 1:
                assert level[0][node] == len(own) and (level[1][node] == own.sum(0)).all()
                whole += len(own)
            seen.append(own)
        assert sorted(map(tuple, np.concatenate(seen))) == sorted(map(tuple, points))
        assert whole > 0 or spread == 3


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.loaded()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coder, library):
    rng = random.Random(1)
    signs = "aaab eé日本'st01-=\n\t  ﷺ́\x1c\x85 "
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(80)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_of_long_pieces(coder, library):
    rng = random.Random(4)
    for text in ["x" * 65_537, "x" * 30_001, "ab" * 20_001, "abcabcabd" * 5_001, " " * 40_001, "é" * 19_999, "=-" * 20_000 + "=", "".join(rng.choice("abcdefghij") for _ in range(50_000))]:
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_joins_any_split():
    """Ranks of random merges, where the order of merges often reaches far."""
    rng = random.Random(9)
    for _ in range(60):
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 40:
            both = rng.choice(tokens) + rng.choice(tokens)
            if both not in tokens and len(both) < 12:
                tokens.append(both)
        own = bpe.Bpe({t: i for i, t in enumerate(tokens)}, ".+")
        for _ in range(40):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(200)))
            whole, cut = own.merged(text), rng.randrange(len(text) + 1)
            assert own.merged_long(text) == whole == own.encoded(text) == own.join(own.merged(text[:cut]), own.merged(text[cut:]))


def test_bpe_query(spark, library):
    docs = {r[0]: r[1] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    found = bpe.op12_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r["doc_id"]]))


def test_bpe_of_odd_rows(spark, library):
    found = bpe.coded(odd_docs(spark), ids=True).collect()
    texts = [r["text"] or "" for r in odd_docs(spark).collect()]
    assert sorted(r["decoded"] for r in found) == sorted(texts)
    assert all(r["ids"] == library.encode_ordinary(r["decoded"]) and r["n_tokens"] == len(r["ids"]) for r in found)
    assert bpe.coded(odd_docs(spark).limit(0)).count() == 0


# Periodic runs


def plain_runs(t, least):
    n, out = len(t), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if t[i] != t[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and t[i] == t[i + p]:
                i += 1
            size = i + p - s
            if size >= max(least, 3 * p) and not any(t[s : s + size - q] == t[s + q : s + size] for q in range(1, p)):
                out.add((s, size, p))
    return sorted(out)


def some_words(rng):
    k, n, kind = rng.randrange(1, 5), rng.randrange(100), rng.randrange(4)
    if kind == 0:
        return [rng.randrange(k) for _ in range(n)]
    if kind == 1:
        return ([rng.randrange(k) for _ in range(rng.randrange(5))] + [rng.randrange(k) for _ in range(rng.randrange(1, 12))] * 9)[:n]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    t = [rng.randrange(k) for _ in range(rng.randrange(1, 6))]
    while len(t) < n:
        x = rng.randrange(len(t))
        t += t[x : rng.randrange(x, len(t)) + 1] * rng.randrange(1, 5)
    return t[:n]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for i in range(2500):
        t, least = some_words(rng), rng.choice([3, 6, 24])
        want = plain_runs(t, least)
        assert runs.found_runs(t, least) == want and runs.runs_of([str(x).encode() for x in t], least) == want
        if i % 10 == 0:
            after, shared, _ = runs.lyndon(t)
            for a, b in enumerate(after):
                assert b == next((j for j in range(a + 1, len(t)) if t[j:] < t[a:]), len(t))
                assert shared[a] == (0 if b == len(t) else next(m for m in range(len(t) + 1) if b + m == len(t) or t[a + m] != t[b + m]))


def test_lyndon_arrays_compare_in_linear_time():
    rng, n = random.Random(5), 20_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    nested = sum(([0] * k + [1] for k in range(200)), [])
    for t in ([0] * n, [0, 1] * (n // 2), b, nested, nested[::-1], [rng.randrange(2) for _ in range(n)], list(range(n)), ([0] * 99 + [1]) * 200, [rng.randrange(9) for _ in range(n // 5)] * 5):
        assert runs.lyndon(t)[2] <= 3 * len(t)


def plain_row(key, text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, 24)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *shown, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark):
    docs = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r[1] or "") < 20_000]
    found = {r["doc_id"]: tuple(r) for r in runs.op13_runs(spark, SF).collect()}
    assert len(found) == table(spark, SF, "documents").count()
    assert sum(r[1] > 0 for r in found.values()) > 5
    for key, text in docs:
        assert found[key] == plain_row(key, text)


def test_runs_of_odd_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    found = runs.periodic(odd_docs(spark), change=runs.planted, spans=True).collect()
    assert sorted(map(str, (tuple(r)[:8] for r in found))) == sorted(str(plain_row(*d)) for d in docs)
    plain = runs.periodic(odd_docs(spark), spans=True).where("doc_id = 0").first()
    assert [tuple(x) for x in plain["runs"]] == [(0, 80, 2)] and plain["collapsed"] == "a b"
    assert runs.periodic(odd_docs(spark).limit(0)).count() == 0
