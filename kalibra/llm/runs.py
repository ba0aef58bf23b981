"""Periodic runs of words by Lyndon arrays.

A run is a stretch with a smallest period that no neighbour extends.  Under one of
an order of words and its inverse, every run has a Lyndon root: a stretch of the
period's length, within the run, that is the longest Lyndon word from its start,
and ends where the next smaller suffix starts.  So two Lyndon arrays give a period
for each place, and every run is among these candidates.

``lyndon`` finds the next smaller suffix of all places from left to right.  A new
suffix is compared with those before it that have none yet, the last one first,
and is theirs if it is smaller.  Comparing takes the length that two suffixes
share, and that reuses what was matched earlier, with no suffix array and no hash:

* One of a chain of three suffixes shares with the next the smaller of what they
  share with the one between, if these two differ.
* The match that reaches farthest, of a and b up to end, makes i in between look
  like i - (b - a), whose comparisons are known: what is shared there is shared
  here, as long as it stays before end.
* Else words are compared, from end or beyond, and end moves with each equal
  word.  So words are compared about as often as there are words.

A place's period p goes with the length that it and the place p beyond share, known
from the comparison, and what they share to the left, looked up over at most p
words at the run's first root only.

Most texts have hardly a stretch where a long run can be.  In a run of period q
all words but the first q occurred at most q words before; ``stretches`` takes
such places, by powers of two, and gives the parts of a text that hold any long
run whole, with its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import table

#: A run is as many words long at least, and as many times its period.
LEAST, TIMES = 24, 3
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon(t: list[int]) -> tuple[list[int], list[int], int]:
    """Of each place the start of the next smaller suffix (the text's end if there is none), how much both share, and how often words were compared."""
    n = len(t)
    after, shared = [n] * n, [0] * n
    before, below = [-1] * n, [0] * n  # the nearest smaller suffix on the left, and what both share
    chains: list[tuple[list[int], list[int]]] = [([], [])] * n  # the places that a suffix was compared with, and what it shared with each
    a = b = end = compared = 0
    for i in range(1, n):
        places, lengths = [], []
        copy = chains[i - b + a] if i < end else None
        j, last, known, at = i - 1, -1, 0, 0
        while j >= 0:
            if last >= 0 and below[last] != known:
                smaller = below[last] > known
                length = known if smaller else below[last]
            else:
                length, exact = known, False
                if copy:
                    want, seen = j - b + a if j >= b else j, copy[0]
                    while at < len(seen) and seen[at] > want:
                        at += 1
                    if at < len(seen) and seen[at] == want:
                        length = copy[1][at]
                        exact = i + length < end
                        if not exact:
                            length = end - i
                if not exact:
                    begun, k, shift = i + length, i + length, i - j
                    while k < n and t[k] == t[k - shift]:
                        k += 1
                    compared += k - begun + 1
                    length = k - i
                    if k >= end:
                        a, b, end, copy = j, i, k, None
                smaller = i + length == n or t[i + length] < t[j + length]
            places.append(j)
            lengths.append(length)
            if not smaller:
                before[i], below[i] = j, length
                break
            after[j], shared[j] = i, length
            last, known, j = j, length, before[j]
        chains[i] = (places, lengths)
    return after, shared, compared


def found_runs(t: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least least places and TIMES periods, in order."""
    n, out = len(t), set()
    for order in (t, [-x for x in t]):
        after, shared, _ = lyndon(order)
        for i in range(n):
            j = after[i]
            p, right = j - i, shared[i]
            if right <= (TIMES - 2) * p or right + 2 * p <= least:  # fewer than p places can be added on the left
                continue
            if i >= p and after[i - p] == i and shared[i - p] >= p:
                continue  # a root of the same run lies before
            left = 0
            while left < p and i > left and t[i - left - 1] == t[j - left - 1]:
                left += 1
            length = left + p + right
            if left < p and length >= max(least, TIMES * p):
                out.add((i - left, length, p))
    return sorted(out)


def stretches(t: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Disjoint parts (from, to), in order, one of which holds each run of at least least places and TIMES periods with its neighbours."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    same = t[order[1:]] == t[order[:-1]]
    gap = np.full(n, n + 1, np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]

    def held(most: int, length: int) -> list[tuple[int, int]]:
        """Stretches of at least length places that all occurred at most most places before."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (gap <= most).astype(np.int8), [0]))))
        return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= length]

    low = least - least // TIMES  # up to this period the length decides, beyond it the period
    spans, q = [], 1
    if held(n, min(low, n)):
        while TIMES * q <= n:
            # periods q to 2 q - 1
            spans += [(max(0, a - 2 * q), min(n, b + 1)) for a, b in held(2 * q - 1, max((TIMES - 1) * q, least - 2 * q + 1, 1))]
            q *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's long runs, by start, then period."""
    if len(words) < least:
        return []
    first: dict[bytes, int] = {}
    ids = [first.setdefault(w, len(first)) for w in words]
    found = []
    for a, b in stretches(np.array(ids, np.int64), least):
        found += [(a + s, n, p) for s, n, p in found_runs(ids[a:b], least)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        depth[s + p] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, those of every tenth by the CRC-32 of its id made periodic from some word on; a null id plants nothing."""
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None, spans: bool = False) -> DataFrame:
    """A row per row of docs: key, n_runs, start, length, period and exponent_milli of the run with the most periods, runs_sha256, collapsed_sha256.

    Words are what spaces and the controls 9 to 13 part.  The first digest is of
    a line for each run, the second of the words that no run repeats; with spans
    the column runs has the runs and collapsed the text.  change may replace a row's
    words by its key.  Null and empty texts have no runs; of runs with equally
    many periods the first, then the shorter period, is shown; texts of any
    length are read whole; repeated rows get their row each; clashing columns
    play no part; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0), b.column(1)):
                words = (x.as_py() or "").encode().split()
                if change:
                    words = change(k.as_py(), words)
                found = runs_of(words)
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                kept = b" ".join(collapsed(words, found))
                row = (len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                rows.append((*row, [{"start": s, "length": n, "period": p} for s, n, p in found], kept.decode()) if spans else row)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            if spans:
                kinds += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=names + ["runs", "collapsed"] * spans)

    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if spans else ""
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}{more}")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic(table(spark, sf_dir, "documents"), change=planted)
