"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: attention stays
within a piece.  Documents are taken in batches of about BATCH tokens, as the
scan delivers them.  A batch opens as many sequences of CAPACITY tokens as it
fills, and its last tokens get sequences of powers of two, so no padding is left.

The costliest document is next, always.  It goes whole to the sequence of the
lowest cost that has room for it.  If none has, it is cut: a piece fills the
sequence of the lowest cost that has any room, and the rest takes its place
among the documents by its own cost.  A batch is all that a task holds in
memory, and packing needs no shuffle.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import released, table, worker_cache

CAPACITY, END = 1024, 0
LINEAR, QUADRATIC = 4096.0, 1.0
BATCH = 1 << 21
TOKENIZER = "byte_bpe_50k"
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(name: str = TOKENIZER):
    """The vocabulary's encoder: texts to lists of ids, strings of its added tokens as those.

    Of the two libraries that read this vocabulary the faster one runs; tests
    hold its ids against those of the other.
    """
    cache = worker_cache("packing")
    if name not in cache:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        cache[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: cache[name].encode(text, allowed_special="all")


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def powers(n: int) -> list[int]:
    """The powers of two that sum up to n, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents 0, 1, ... and the number of sequences.

    Of equal costs the first document and the first sequence are next.
    """
    total = sum(lengths)
    caps = np.array([capacity] * (total // capacity) + powers(total % capacity), np.int64)
    free, costs = caps.copy(), np.zeros(len(caps))
    left = [(-cost(n), i, 0, n) for i, n in enumerate(lengths) if n]
    heapq.heapify(left)
    pieces = []
    while left:
        _, i, start, length = heapq.heappop(left)
        fits = free >= length
        if not fits.any():
            fits = free > 0
        at = int(np.argmin(np.where(fits, costs, np.inf)))
        size = min(length, int(free[at]))
        pieces.append((i, start, size, at, int(caps[at] - free[at])))
        free[at] -= size
        costs[at] += cost(size)
        if length > size:
            heapq.heappush(left, (-cost(length - size), i, start + size, length - size))
    return pieces, len(caps)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, batch: int = BATCH, ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are its text's, the vocabulary's added tokens among them,
    then END; start counts its ids before the piece.  Null and empty texts have
    the one id END; texts of any length are encoded whole; repeated rows are
    packed each; clashing columns play no part; an empty table gives no rows.  sequence_id is the task's partition
    times 2 ** 32 plus a count from 0.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder()
        first = TaskContext.get().partitionId() << 32
        keys, codes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, keys, codes, held
            pieces, used = pack([len(c) for c in codes], capacity)
            cols = [np.array(c, np.int64) for c in zip(*pieces)]
            parts = [codes[i][s : s + n] for i, s, n, _, _ in pieces]
            out = [
                pa.array([keys[i] for i in cols[0]], kinds),
                pa.array(cols[1]),
                pa.array(cols[2]),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array([len(codes[i]) for i in cols[0]], pa.int64()),
                pa.array(cols[3] + first),
                pa.array(cols[4]),
            ]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                out.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            first += used
            keys, codes, held = [], [], 0
            return pa.RecordBatch.from_arrays(out, names=names)

        for part in batches:
            kinds = part.schema.field(0).type
            for k, t in zip(part.column(0), part.column(1)):
                keys.append(k.as_py())
                codes.append(np.array([*encode(t.as_py() or ""), END], "<u4"))
                held += len(codes[-1])
                if held >= batch:
                    yield flush()
        if keys:
            yield flush()

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(released(run), f"`{key}` {kind}, {SCHEMA}{', ids array<int>' if ids else ''}")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
