"""Byte-level BPE as a tree reduction.

Token sequences are a monoid: a text's sequence is the join of those of its
halves.  Texts are encoded by halves down to LEAF bytes, which plain merging
encodes, and two neighbours are joined by encoding a window around their border
anew: one token of either side, then two, four, and so on, until the window's
outer tokens agree with their neighbours outside.

Two tokens agree if encoding their bytes together yields these two again.  That
all adjacent tokens agree is all it takes for a sequence to be the encoding of
its bytes.  Suppose merging the whole ever merged across a border of two tokens
first.  Until then merges took place within tokens, and those within these two
came in the same order as in their bytes alone, as the least rank, leftmost,
is next in both; so there the same merge across the border would be next, and
they would not agree.  Tokens inside a window agree, as it was encoded, and those
beyond it agreed before, so only the window's two edges need a look, and what
is outside stays as it is.

Decoding concatenates the tokens' bytes up a tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import table, worker_cache

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Bytes that are merged without a tree.
LEAF = 4
#: Windows of more bytes are merged over a heap, of up to SHORT bytes remembered.
LONG, SHORT = 96, 32
#: A worker remembers so many short pieces, merges and pairs of tokens, the last ones, and up to so many before.
KNOWN = 1 << 17
NEVER = 1 << 60


class Known(dict):
    """Results of a function of short keys; those of two generations are kept, so old ones that no one asks for go."""

    def __init__(self, function: Callable, short: int):
        super().__init__()
        self.function, self.short, self.older = function, short, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.function(key)
            if len(key) > self.short:
                return out
        if len(self) >= KNOWN:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def plainer(pattern: str) -> str:
    r"""The pattern for texts of ASCII characters, which the standard library matches several times faster."""
    inside = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}
    written = lambda m: re.sub(r"\\p\{\w\}|\\s", lambda x: inside[x[0]], m[0])
    out = re.sub(r"\[[^]]*\]", written, pattern)
    return re.sub(r"\\p\{\w\}", lambda m: f"[{inside[m[0]]}]", out).replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")


class Bpe:
    """Encoder and decoder by the ranks of byte strings, which are the ids; pattern splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.plain, self.wide = re.compile(plainer(pattern)).findall, regex.compile(pattern).findall
        self.known = Known(self.piece, SHORT)
        self.merges = Known(self.merged, SHORT)
        self.agreed = Known(lambda pair: self.merged(pair[0] + pair[1]) == pair, 2)

    def pieces(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() else self.wide(text)

    def merged(self, text: bytes) -> tuple[bytes, ...]:
        """Plain merging: the adjacent pair of the least rank is next, the leftmost of equals."""
        if len(text) > LONG:
            return self.merged_long(text)
        get = self.ranks.get
        parts = [text[i : i + 1] for i in range(len(text))]
        order = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while order:
            least = min(order)
            if least == NEVER:
                break
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], NEVER)
        return tuple(parts)

    def merged_long(self, text: bytes) -> tuple[bytes, ...]:
        """The same for long texts: pairs wait in a heap by (rank, place), and those that changed meanwhile are passed over."""
        get, n = self.ranks.get, len(text)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, stop = heappop(waiting)
            if end[i] < 0:
                continue
            j = after[i]
            if j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                to = end[after[j]]
                if (r := get(text[i:to])) is not None:
                    heappush(waiting, (r, i, to))
            if before[i] >= 0 and (r := get(text[before[i] : stop])) is not None:
                heappush(waiting, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(text[i : end[i]])
            i = end[i]
        return tuple(out)

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left or right
        agree = self.agreed
        if agree[left[-1], right[0]]:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merges[b"".join(left[a:] + right[:b])]
            if (not a or agree[left[a - 1], window[0]]) and (b == len(right) or agree[window[-1], right[b]]):
                return left[:a] + window + right[b:]
            width *= 2

    def encoded(self, text: bytes) -> tuple[bytes, ...]:
        """By halves; the left one is LEAF times a power of two long, so that repetitions fall alike on both sides."""
        if len(text) <= LEAF:
            return self.merges[text]
        half = LEAF << ((len(text) - 1) // LEAF).bit_length() - 1
        return self.join(self.encoded(text[:half]), self.encoded(text[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece; what is a token itself is that one, whether or not merging reaches it."""
        data = text.encode()
        own = self.ranks.get(data)
        return (own,) if own is not None else tuple([self.ranks[t] for t in self.encoded(data)])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def loaded(name: str = TOKENIZER) -> Bpe:
    """The coder of a public vocabulary's file, once a worker."""
    cache = worker_cache("bpe")
    if name not in cache:
        import base64

        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as lines:
            cache[name] = Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, public_tokenizers.PATTERN)
    return cache[name]


def coded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, ids: bool = False) -> DataFrame:
    """A row per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and with ids the ids and the decoded text.

    The digests are of the ids, in decimal and joined by commas, and of the
    decoded bytes.  Null and empty texts have no ids; texts and single pieces of
    any length are coded whole; repeated rows get their row each; clashing
    columns play no part; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        names = bpe.names.__getitem__
        for b in batches:
            counts, first, second, codes, back = [], [], [], [], []
            for x in b.column(1):
                own = bpe.encode(x.as_py() or "")
                data = bpe.decode(own)
                counts.append(len(own))
                first.append(hashlib.sha256(",".join(map(names, own)).encode()).hexdigest())
                second.append(hashlib.sha256(data).hexdigest())
                if ids:
                    codes.append(own)
                    back.append(data.decode())
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            labels = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(codes, pa.list_(pa.int32())), pa.array(back, pa.string())]
                labels += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=labels)

    more = ", ids array<int>, decoded string" if ids else ""
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))
