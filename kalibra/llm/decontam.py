"""Benchmark decontamination by SimHash over item-sized windows.

Words are the runs left when ASCII punctuation counts as white space, lower-cased
in A-Z; shingles are WORDS words, weighted by how often they occur.  For every
item length that the benchmark has, a window of that many words slides over each
document, word by word; a shorter document is one window.  A window counts if its
weighted-shingle similarity, the shared weight over the larger of both weights,
is at least SIMILARITY.

Each window has a SimHash of its own, and a multi-index finds the items whose
fingerprints are within RADIUS bits of it: at that many, at least one of BLOCKS
blocks differs in no more than RADIUS // BLOCKS bits, so looking up all such
values of each block meets every one.  These candidates are verified by their
shingles.  RADIUS is wide, for texts of a similarity of 0.8 differ in 13 bits on
average with a deviation of about 3: over 31 is more than five deviations off.

Most windows need no fingerprint: one that holds less than SIMILARITY times an
item's weight in shingles of any item of that length can't reach the similarity
with one of them.  A running count of such shingles skips those, and loses none.

Items are broadcast in blocks of at most BLOCK_BYTES of text; a larger benchmark
takes more passes over the documents, one after another.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, release, table, worker_cache

WORDS, SIMILARITY = 5, 0.8
#: Of the fingerprints' BITS, so many may differ; the multi-index looks up BLOCKS blocks.
BITS, RADIUS, BLOCKS = 64, 31, 8
SIZE = BITS // BLOCKS
#: Of each value of a block, those within RADIUS // BLOCKS bits of it.
NEAR = [[v ^ sum(1 << p for p in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(SIZE), r)] for v in range(1 << SIZE)]
BLOCK_BYTES = 4 << 20
#: Lower-case A-Z, and punctuation as blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Of each run of width word hashes, one hash that depends on their order."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + max(n, 0)])
    return out


def sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums over shingles of their bits as -1 and 1: row i has those before shingle i."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)))


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """The items of one block: their shingles, fingerprints and which of them hold a shingle, by length in words."""

    def __init__(self, items: list[tuple[int, str]], width: int = WORDS, similarity: float = SIMILARITY):
        from xxhash import xxh64_intdigest

        self.similarity, self.ids, self.weights = similarity, [], []
        self.code: dict[bytes, int] = {}
        self.of: dict[tuple[int, int], list[int]] = defaultdict(list)  # (words, width) -> items
        for item, text in items:
            words = split(text)
            if not words:
                continue
            k = min(width, len(words))
            for w in words:
                self.code.setdefault(w, xxh64_intdigest(w, 1) | 1)
            self.of[len(words), k].append(len(self.ids))
            self.ids.append(item)
            self.weights.append(shingle_hashes(np.array([self.code[w] for w in words], np.uint64), k))
        self.shingles, self.prints, self.index, self.holders = {}, {}, {}, {}
        for key, own in self.of.items():
            # sorted by shingle: who holds it, of this length
            held = [np.unique(self.weights[i]) for i in own]
            every, who = np.concatenate(held), np.repeat(np.arange(len(own)), [len(h) for h in held])
            order = np.argsort(every, kind="stable")
            self.holders[key] = every[order], who[order]
            self.shingles[key] = np.unique(every)
            self.prints[key] = np.concatenate([packed(sums(self.weights[i])[-1:]) for i in own])
            index: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, fp in enumerate(self.prints[key].tolist()):
                for b in range(BLOCKS):
                    index[b, fp >> b * SIZE & (1 << SIZE) - 1].append(i)
            self.index[key] = dict(index)
        self.all = {k: np.unique(np.concatenate([s for (_, w), s in self.shingles.items() if w == k])) for k in {k for _, k in self.of}}

    def near(self, key: tuple[int, int], fp: int) -> set[int]:
        """The items of that length whose fingerprints are within RADIUS bits of fp."""
        index, prints = self.index[key], self.prints[key]
        found: set[int] = set()
        for b in range(BLOCKS):
            for v in NEAR[fp >> b * SIZE & (1 << SIZE) - 1]:
                found.update(index.get((b, v), ()))
        return {i for i in found if (int(prints[i]) ^ fp).bit_count() <= RADIUS}

    def search(self, text: str | None) -> dict[int, tuple[float, int, int, int]]:
        """The items that a text holds: similarity, differing bits, first word and words of the best window."""
        words = split(text)
        best: dict[int, tuple[float, int, int, int]] = {}
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        for k, every in self.all.items():
            if len(codes) < k:
                continue
            gap = np.concatenate(([0], np.cumsum(codes == 0)))
            whole = np.flatnonzero(gap[k:] == gap[:-k])  # shingles of known words only
            if not len(whole):
                continue
            at = whole[among(shingle_hashes_at(codes, whole, k), every)]
            if not len(at):
                continue
            for key, own in self.of.items():
                if key[1] == k:
                    self.windows(key, own, codes, at, words, best)
        return best

    def windows(self, key, own, codes, at, words, best) -> None:
        n, k = min(key[0], len(codes)), key[1]
        known = among(shingle_hashes_at(codes, at, k), self.shingles[key])
        at, span, weight = at[known], n - k + 1, key[0] - k + 1
        least = self.similarity * weight - 1e-9
        if len(at) < least:
            return
        # windows that begin at s hold the shingles s to s + span - 1
        marks = np.zeros(len(codes) - k + 2, np.int64)
        marks[at + 1] = 1
        held = np.cumsum(marks)
        starts = np.flatnonzero(held[span:] - held[:-span] >= least)
        if not len(starts):
            return
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            a, b = part[0], part[-1] + span
            hashes = shingle_hashes(coded(words, codes, a, b + k - 1), k)
            total = sums(hashes)
            rel = part - a
            prints = packed(total[rel + span] - total[rel]).tolist()
            every, who = self.holders[key]
            lo, hi = np.searchsorted(every, hashes), np.searchsorted(every, hashes, "right")
            held_by = Counter()
            for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                held_by.update(who[x:y].tolist())
            able = [i for i, c in held_by.items() if c >= least]
            near: dict[int, set[int]] = {}
            for i in sorted(able):
                item, counts = own[i], Counter(self.weights[own[i]].tolist())
                count = np.concatenate(([0], np.cumsum(among(hashes, np.unique(self.weights[item])))))
                for j in np.flatnonzero(count[rel + span] - count[rel] >= least).tolist():
                    s, fp = int(rel[j]), prints[j]
                    if fp not in near:
                        near[fp] = self.near(key, fp)
                    if i not in near[fp]:
                        continue
                    window = Counter(hashes[s : s + span].tolist())
                    alike = sum(min(c, window[h]) for h, c in counts.items()) / weight
                    if alike >= self.similarity:
                        apart = (fp ^ int(self.prints[key][i])).bit_count()
                        new = (alike, -apart, -(a + s))
                        old = best.get(item)
                        if old is None or new > (old[0], -old[1], -old[2]):
                            best[item] = (alike, apart, int(a + s), n)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def shingle_hashes_at(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(at), width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[at + i])
    return out


def coded(words: list[bytes], codes: np.ndarray, a: int, b: int) -> np.ndarray:
    """The hashes of words a to b - 1, those that no item has included."""
    from xxhash import xxh64_intdigest

    out = codes[a:b].copy()
    for i in np.flatnonzero(out == 0).tolist():
        out[i] = xxh64_intdigest(words[a + i], 1) | 1
    return out


def blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[DataFrame]:
    """The items in parts of about block_bytes of text, by a hash of their keys."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        yield items if n == 1 else items.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == i)


class Shared:
    """A block of items for the tasks: broadcast once, indexed once in each Python worker, which holds one block at a time."""

    def __init__(self, block: DataFrame, width: int, similarity: float):
        rows = [tuple(r) for r in block.where("text is not null").collect()]  # at most about BLOCK_BYTES of text
        self.rows = block.sparkSession.sparkContext.broadcast(rows)
        self.mark, self.width, self.similarity = uuid.uuid4().hex, width, similarity

    def items(self) -> Items:
        cache = worker_cache("decontam")
        if cache.get("items", ("",))[0] != self.mark:
            cache["items"] = None, None  # the last block goes before the next one comes
            cache["items"] = self.mark, Items(self.rows.value, self.width, self.similarity)
        return cache["items"][1]


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    width: int = WORDS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item_id, similarity, differing_bits, first_word, words): the best window of each item in each row of docs.

    Null and empty texts hold nothing and null or empty items are found nowhere.
    An item of fewer than width words is one shingle, its whole sequence.  Texts
    of any length are searched whole; clashing columns of docs play no part.
    Repeated rows and repeated items each give their rows.  Of windows alike in
    similarity and bits the first counts.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    items = items.select(F.col(item_key), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(items, item_key, "text", block_bytes):
        shared = Shared(block, width, similarity)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.items()
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    for i, found in index.search(text.as_py()).items():
                        rows.append((doc.as_py(), index.ids[i], *found))
                if rows:
                    names = [key, item_key, "similarity", "differing_bits", "first_word", "words"]
                    kinds = [batch.schema.field(0).type, None, pa.float64(), pa.int32(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        found = docs.select(F.col(key), F.col("text").cast("string")).mapInArrow(
            run, f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, similarity double, differing_bits int, first_word long, words int"
        )
        out = found if out is None else out.union(found)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def holder(shared: Shared):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.items()
        for texts in batches:
            yield pa.array((bool(index.search(x.as_py())) for x in texts), pa.bool_())
        release()

    return holds


def clean(docs: DataFrame, items: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item; each row is judged by its own text, where it lies.

    What is left after a block of items is written before the next one is searched.
    """
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    scratch, first = Scratch(docs.sparkSession), True
    for block in blocks(items, "item_id", "text", block_bytes):
        docs = docs if first else scratch.write(docs)
        docs, first = docs.where(~holder(Shared(block, width, similarity))(F.col("text").cast("string"))), False
    return docs
