"""SimHash near-duplicates through a byte-position inverted index.

Texts are lower-cased in A-Z, cut into words at ASCII white space and into word
shingles, repeats included; a fingerprint bit is set if over half of the
shingles' XXH64 values (seed 42) have it.  Fingerprints link at three or fewer
differing bits.

Two fingerprints that differ in at most three bits share at least five of their
eight positional bytes, and so at least three bytes of one half.  The postings
are therefore keyed by three positional bytes of one half (four choices in each
half): every pair that reaches the guaranteed minimum meets in one.  Within a
posting list the shared positional bytes of a pair are tallied, pairs with fewer
than five are dropped, and the rest are verified by their Hamming distance.

Copies are folded into one posting first, and a list yields a spanning forest of
its links, never all its pairs.  A list longer than ``HOT`` is dealt out once
more, by the ten choices of two further bytes that a linked pair must share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, components, fresh, released

WORDS, SEED, BITS, BYTES = 3, 42, 3, 8
LEAST = BYTES - BITS
HOT = 20_000
MANY = 1000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> bytes:
    """Eight bytes, the highest bits first; zero for a text without words."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return bytes(BYTES)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    found = b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, BYTES), axis=1)
    n = len(bits)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): one row per document, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(x.as_py(), words) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=[key, "fp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(released(run), f"`{key}` {kind}, fp long")


def byte_at(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(255))


def packed(column, positions, tag: int):
    out = F.lit(tag).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(byte_at(column, p))
    return out


#: The positional bytes of each posting: three of one half.
POSTINGS = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints as all links of at most BITS bits do."""
    out, left = [], np.unique(fps)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            apart = left ^ one
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            near = (shared >= LEAST) & (np.bitwise_count(apart) <= BITS)
            if near.any():
                found = left[near]
                out += [(int(one), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def runs(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Of rows (key, fp) in the order of their keys: each key with its fingerprints; a key with more than hot rows comes in parts, marked so."""
    held: list[np.ndarray] = []
    now, n, large = None, 0, False
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(keys):
            continue
        at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if now is None or keys[a] != now:
                if now is not None and (n > 1 or large):
                    yield now, np.concatenate(held) if held else fps[:0], large
                held, now, n, large = [], int(keys[a]), 0, False
            held.append(fps[a:b])
            n += b - a
            if n > hot:
                large = True
                yield now, np.concatenate(held), True
                held, n = [], 0
    if now is not None and (n > 1 or large):
        yield now, np.concatenate(held) if held else np.empty(0, np.int64), large


def links(fps: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(a, b): links between different fingerprints of the column fp that leave all linked ones connected."""
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("k").sortWithinPartitions("k")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, found, large in runs(batches, hot):
            if large:  # to be dealt out again
                rows, kind = [(key, int(x)) for x in found], 1
            else:
                rows, kind = forest(found), 0
            if rows:
                a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(rows), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    names=["kind", "a", "b"],
                )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, _ in runs(batches, 1 << 62):
            if rows := forest(found):
                a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keyed = fps.select(
        F.explode(F.array(*[packed(F.col("fp"), t, i) for i, t in enumerate(POSTINGS)])).alias("k"), F.col("fp")
    )
    found = scratch.write(dealt(keyed).mapInArrow(released(first), "kind int, a long, b long"))
    again = []
    for i, t in enumerate(POSTINGS):
        rest = [p for p in range(BYTES) if p not in t]
        again += [
            F.when(F.shiftrightunsigned("a", 24) == i, packed(F.col("b"), [*t, *two], 16 * i + j))
            for j, two in enumerate(combinations(rest, 2))
        ]
    hot_rows = found.where("kind = 1").select(F.explode(F.array_compact(F.array(*again))).alias("k"), F.col("b").alias("fp"))
    return found.where("kind = 0").select("a", "b").union(dealt(hot_rows).mapInArrow(released(second), "a long, b long"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, hot: int = HOT
) -> DataFrame:
    """(key, fp, component_id): a row per row of docs.

    component_id is the smallest key reachable over links, the own included.
    Null texts count as empty; empty texts have the fingerprint zero and link
    like any other.  Repeated rows are copies; an empty table gives no rows; a
    null key gets its group's smallest key, or null where all are null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = scratch.write(fingerprints(docs, key, text, words))
    folded = scratch.write(own.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n")))
    roots = components(links(folded.select("fp"), scratch, hot), scratch)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = (
        roots.join(folded, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("lowest"))
    )
    named = roots.join(lowest, "root").select(F.col("node"), "lowest")
    ids = folded.join(named, F.col("fp") == F.col("node"), "left")
    ids = scratch.write(ids.select("fp", F.coalesce("lowest", "low").alias("component_id"), "n"))
    # at most MANY fingerprints have more than one row in MANY; they needn't be dealt out
    rows = own.count()
    hot = F.broadcast(ids.where(F.col("n") * MANY > rows).drop("n"))
    rest = own.join(hot.select("fp"), "fp", "left_anti").join(ids.where(F.col("n") * MANY <= rows).drop("n"), "fp")
    return own.join(hot, "fp").select(key, "fp", "component_id").union(rest.select(key, "fp", "component_id"))


def hexed(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


# Beyond three bits
#
# Texts of a shingle similarity of 0.8 mostly differ in more than three bits of
# one fingerprint.  For these each text posts the first of its shingles in one
# order of all, so many that any two texts that are similar share one.  Pairs
# from the posting lists that parity bitmaps can't rule out are verified exactly.

SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Shorter lists are paired in full at once, longer ones by centres, whose number grows by GROWTH each round.
SMALL, GROWTH = 64, 16
#: Shingles that OFTEN or more of one text in SAMPLE have count as common, the first COMMON of them.
SAMPLE, OFTEN, COMMON = 8, 8, 100_000
#: Rows whose shingles a task holds at a time.
SLICE = 256


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        found = xxh64_digest(whole, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        found = b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first of a text's shingles, of which any two texts that are similar have one in common, and how many of them aren't common.

    Similar sets share at least similarity times the larger one's size, so the
    first that they share, in any order of all shingles, is within the first
    n - similarity * n + 1 of both.  The order is that of the hashes, with the
    common ones last by their rank.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), 0
    rare = n
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = common[at] == hashes
        hashes = np.concatenate((hashes[~often], hashes[often][np.argsort(rank[at[often]])]))
        rare = n - int(often.sum())
    kept = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return hashes[:kept].astype(np.int64), min(rare, kept)


def parities(hashes: np.ndarray) -> bytes:
    """A bitmap of two to four times as many bits as hashes: whether an odd number of them fall on a bit."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """At most as many as the elements that are in one of both sets only: each flips one bit of the bitmaps' difference."""
    a, b = (np.frombuffer(z, np.uint64) for z in (x, y))
    while len(a) != len(b):  # the halves of a bitmap make up that of half its bits
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def long_batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=names)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, in order, and their ranks by frequency; from one text in SAMPLE, as any choice leaves results the same."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield long_batch(["h"], np.concatenate([shingles(x.as_py(), words) for x in b.column(0)]).view(np.int64))

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(released(every), "h long")
    rows = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    found = rows["h"].to_numpy()[::-1].astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def sketched(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row, d1, d2, size, bits, own, rare): of rows (row, text) with words the digest, the number of shingles, their bitmap, and the postings, of which the first rare ones aren't common."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for b in slices(batches):
            rows, marks, sizes, bits, own, rare = [], [], [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py()
                hashes = shingles(text, words)
                if len(hashes):
                    first, n = prefix(hashes, common, rank, similarity)
                    rows.append(i)
                    marks.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    sizes.append(len(hashes))
                    bits.append(parities(hashes))
                    own.append(first)
                    rare.append(n)
            if rows:
                d = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                cols = [pa.array(rows, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), lists, pa.array(rare, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "d1", "d2", "size", "bits", "own", "rare"])

    return texts.select("row", "text").mapInArrow(released(run), "row long, d1 long, d2 long, size int, bits binary, own array<bigint>, rare int")


def able(a_size, a_at, b_size, b_at, similarity: float):
    """Whether what two rows share from their places in a list on can suffice; if that isn't the first shingle that they share, its list has them."""
    most = F.least(a_size - a_at, b_size - b_at)
    return most * (1 + similarity) >= similarity * (a_size + b_size) - 1e-6


def short_lists(posted: DataFrame, similarity: float) -> DataFrame:
    """Of postings (k, row, size, at): kind 0 is a pair (a, b) with a > b of a list of up to SMALL rows, kind 1 a row b of a longer list a."""
    names = ["kind", "a", "b", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.empty((0, 4), np.int64), None  # rows of the last list, unless it is a longer one already
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.concatenate((held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.int64)))
            last = cols[-1, 0]
            at = np.append(np.flatnonzero(np.diff(cols[:, 0], prepend=cols[0, 0] - 1)), len(cols))
            n = np.diff(at)
            long = (n > SMALL) | (cols[at[:-1], 0] == large)
            if n[-1] > SMALL:
                large = last
            elif not long[-1]:  # it may go on in the next batch
                n, long, at = n[:-1], long[:-1], at[:-1]
            held = cols[at[-1] :]
            yield from emitted(cols[: at[-1]], n, long)
        if len(held):
            yield from emitted(held, np.array([len(held)]), np.array([False]))

    def emitted(cols: np.ndarray, n: np.ndarray, long: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = cols[np.repeat(long, n)]
        if len(rows):
            yield long_batch(names, np.ones(len(rows)), *rows.T)
        short = ~long & (n > 1)
        rows, of = cols[np.repeat(short, n)], np.repeat(np.flatnonzero(short), n[short])
        found = []
        for step in range(1, SMALL):  # each row with that many rows later
            one, two = rows[:-step], rows[step:]
            same = of[:-step] == of[step:]
            if not same.any():
                break
            one, two = one[same], two[same]
            most = np.minimum(one[:, 2] - one[:, 3], two[:, 2] - two[:, 3])
            near = most * (1 + similarity) >= similarity * (one[:, 2] + two[:, 2]) - 1e-6
            found.append(np.column_stack((np.maximum(one[near, 1], two[near, 1]), np.minimum(one[near, 1], two[near, 1]))))
        if found and len(pairs := np.unique(np.concatenate(found), axis=0)):
            none = np.zeros(len(pairs), np.int64)
            yield long_batch(names, none, pairs[:, 0], pairs[:, 1], none, none)

    rows = posted.repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(released(run), "kind long, a long, b long, size long, at long")


def verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, scratch: Scratch, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar; only those that the bitmaps leave see the texts."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, m, n = (b.column(i).to_numpy() for i in range(4))
            most = (m + n) * (1 - similarity) / (1 + similarity) + 1e-6
            apart = [differing(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5))]
            near = np.array(apart, np.int64) <= most
            yield long_batch(["a", "b"], a[near], c[near])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            out = []
            for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if j != last:
                    last, own = j, shingles(y.as_py(), words)
                other = shingles(x.as_py(), words)
                both = len(np.intersect1d(own, other, True))
                if both and both >= similarity * (len(own) + len(other) - both):
                    out.append((i, j))
            if out:
                yield long_batch(["a", "b"], *zip(*out))

    def beside(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(rows.select(F.col("row").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in cols for side in "ab"])

    left = scratch.write(beside(pairs, marks, "size", "bits").mapInArrow(released(likely), "a long, b long"))
    rows = left.select(F.col("a").alias("row")).union(left.select("b")).distinct()
    return scratch.write(beside(left, texts.join(rows, "row", "left_semi"), "text").mapInArrow(released(exact), "a long, b long"))


def similar(texts: DataFrame, groups: DataFrame, scratch: Scratch, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(first, root): of the groups (row, root) of rows (row, text), those that links join with others; first is the root as given.

    Rows link if their shingle sets have at least that Jaccard similarity.  Short
    posting lists are paired in full.  The others, and all those of common
    shingles, are gone through in rounds: a list's next centres are paired with
    all its rows that are of other groups by then, and retire; it ends when all
    its rows have been centres or are of one group.  No list is held by a task.
    """
    sketches = scratch.write(sketched(texts, words, similarity))
    distinct = sketches.groupBy("d1", "d2").agg(F.min("row").alias("row")).select("row")
    own = sketches.join(distinct, "row", "left_semi")
    posted = own.select("row", "size", "rare", F.posexplode("own").alias("at", "k"))
    found = scratch.write(short_lists(posted.where("at < rare").select("k", "row", "size", "at"), similarity))
    hot = posted.where("at >= rare").select("k", "row", "size", "at")
    live = scratch.write(found.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("row"), F.col("size").cast("int").alias("size"), F.col("at").cast("int").alias("at")).union(hot))
    pairs = found.where("kind = 0").select("a", "b").distinct()
    met = live.select("row").union(pairs.select("a")).union(pairs.select("b")).distinct()
    met = scratch.write(met)  # all others share no posting; what follows is of these rows alone
    label = scratch.write(groups.join(met, "row", "left_semi").select("row", F.col("root").alias("first"), "root"))
    marks = scratch.write(sketches.join(met, "row", "left_semi").select("row", "size", "bits"))
    scratch.drop(sketches)
    tried, centres = None, 1
    while True:
        rooted = label.select("row", "root")
        dealt = live.join(rooted, "row")
        several = dealt.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k")
        dealt = scratch.write(dealt.join(several, "k", "left_semi"))
        order = Window.partitionBy("k").orderBy("row")
        chosen = dealt.withColumn("n", F.row_number().over(order)).where(F.col("n") <= centres)
        chosen = scratch.write(chosen.select("k", *[F.col(c).alias(f"_{c}") for c in ("row", "root", "size", "at")]))
        both = dealt.join(chosen, "k").where("root <> _root").where(able(F.col("size"), F.col("at"), F.col("_size"), F.col("_at"), similarity))
        more = both.select(F.greatest("row", "_row").alias("a"), F.least("row", "_row").alias("b")).distinct()
        if tried is None:  # the first round has the short lists' pairs too
            more = pairs.union(more).distinct()
            for side in "ab":
                more = more.join(rooted.select(F.col("row").alias(side), F.col("root").alias(f"r{side}")), side)
            more = more.where("ra <> rb").select("a", "b")
        else:
            more = more.join(tried, ["a", "b"], "left_anti")
        more = scratch.write(more)
        if tried is None:
            scratch.drop(found)
        tried = more if tried is None else tried.union(more)
        if not more.isEmpty() and not (new := verified(more, texts, marks, scratch, words, similarity)).isEmpty():
            one = label.select(F.col("row").alias("a"), F.col("root").alias("x"))
            two = label.select(F.col("row").alias("b"), F.col("root").alias("y"))
            edges = new.join(one, "a").join(two, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
            to = components(edges, scratch).select(F.col("node").alias("root"), F.col("root").alias("to"))
            old, label = label, scratch.write(label.join(to, "root", "left").select("row", "first", F.coalesce("to", "root").alias("root")))
            scratch.drop(old)
        gone = chosen.select("k", F.col("_row").alias("row"))
        old, live = live, scratch.write(dealt.drop("root").join(gone, ["k", "row"], "left_anti"))
        for x in (old, dealt, chosen):
            scratch.drop(x)
        if live.isEmpty():
            return label.where("first <> root").select("first", "root").distinct()
        centres *= GROWTH


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each group that with the smallest doc_id stays.

    Rows are near-duplicates if their fingerprints link, or if their five-word
    shingles have a similarity of 0.8 or more, and groups are what such links
    connect.  Rows that repeat a doc_id are rows of their own, of which one stays
    if they are alike.  Rows whose doc_id is null come after all others.
    """
    row, key = fresh(docs, "row_", "key_")
    scratch = Scratch(docs.sparkSession)
    own = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col(row).alias("row")
    )
    found = near_duplicates(own.select(order.alias(key), "text"), key)
    named = scratch.write(found.select(F.col(key).alias("key"), F.col("component_id").alias("lowest")))
    texts = own.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    groups = named.select(F.col("key.row").alias("row"), F.col("lowest.row").alias("root"))
    merged = scratch.write(similar(texts, groups, scratch))
    merged = merged.union(merged.select("root", "root").distinct()).toDF("first", "root")
    left = named.where("key = lowest").select(F.col("key.row").alias("row"), "key")
    keys = merged.join(left, F.col("first") == F.col("row")).select("root", "row", "key")
    lowest = keys.groupBy("root").agg(F.min("key").alias("lowest"))
    gone = keys.join(lowest, "root").where(F.col("key") != F.col("lowest")).select("row")
    kept = left.select("row").join(gone, "row", "left_anti").select(F.col("row").alias(row))
    return own.join(kept, row, "left_semi").drop(row)
