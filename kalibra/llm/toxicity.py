"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; the unlabelled sample is drawn from
all training text, whatever its labels.  With the class prior p, the risk of a
scorer f is ``p R+(pos) + max(0, R-(unl) - p R-(pos))``: the second term stands
for the negatives' risk and is kept from turning negative, where the gradient
step goes back up.  The classifier is linear in the presence of words and word
beginnings, trained with numpy; the prior is the share of toxic rows among the
labelled training rows.

Only the fit uses a bounded sample: POSITIVES and UNLABELLED rows, those of the
lowest hashes of their keys, and FEATURES features.  Scores cover whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, fresh, release, released, table, worker_cache

POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 1024
#: A feature's share among positives over that in unlabelled text, in logs, and its test statistic, at least.
LIFT, SIGNIFICANT = np.log(3.0), 5.0
#: Positives that have a feature, at least, and as a share.
LEAST, SHARE = 5, 0.01
#: Rows of the sample that share COPY of their lowest SKETCH hashes of word runs with an earlier row are its copies, and not learnt from.
SKETCH, COPY, RUN = 32, 8, 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Rows whose features a task holds at a time.
SLICE = 32
STEPS, RATE, DECAY = 800, 0.05, 1e-5
WORD = re.compile(r"[^\W\d_]+")


def counted(text: str | None) -> tuple[Counter, int]:
    words = WORD.findall((text or "").lower())
    return Counter(words), len(words)


def features(words: Counter) -> Counter:
    """How often words occur, and with a star the beginnings of the longer ones."""
    out = Counter(words)
    for w, c in words.items():
        for n in PREFIXES:
            if len(w) > n:
                out[w[:n] + "*"] += c
    return out


def rate(count, words):
    return np.log2(1 + 100 * count / words)


def held_out(key):
    """Rows that no label may be learnt from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


@dataclass
class Model:
    """Of each feature the weight of its presence and that of its rate among the words."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    bias: float = -20.0

    def score(self, text: str | None) -> float:
        words, n = counted(text)
        get = self.weights
        found: dict[str, int] = {w: words[w] for w in words.keys() & get.keys()}
        for size in PREFIXES:
            for w in words:
                if len(w) > size and (f := w[:size] + "*") in get:
                    found[f] = found.get(f, 0) + words[w]
        total = self.bias + sum(get[f][0] + get[f][1] * rate(c, n) for f, c in sorted(found.items()))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer that minimises the non-negative risk of logistic losses."""
    n = positive.shape[1]
    P, cp = np.unique(positive, axis=0, return_counts=True)
    U, cu = np.unique(unlabelled, axis=0, return_counts=True)
    P, U = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (P, U))
    cp, cu = cp / cp.sum(), cu / cu.sum()
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        fp, fu = P @ w, U @ w
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -500, 500))), 1 / (1 + np.exp(-np.clip(fu, -500, 500)))
        up = prior * (P.T @ (cp * (sp - 1)))
        down = U.T @ (cu * su) - prior * (P.T @ (cp * sp))
        g = up + down if cu @ soft(fu) - prior * (cp @ soft(fp)) >= 0 else -down
        g[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def sketch(text: str | None) -> list[int]:
    """The lowest hashes of the runs of RUN words."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().split()
    found = {xxh64_intdigest(" ".join(words[i : i + RUN])) >> 1 for i in range(max(1, len(words) - RUN + 1))}
    return sorted(found)[:SKETCH]


def copies(sketches: list[tuple[int, list[int]]]) -> list[int]:
    """The numbers of the rows that are copies of rows before them."""
    at: dict[int, list[int]] = {}
    out = []
    for i, (number, found) in enumerate(sketches):
        seen: dict[int, int] = {}
        for h in found:
            for j in at.get(h, ()):
                seen[j] = seen.get(j, 0) + 1
        if max(seen.values(), default=0) >= min(COPY, len(found)):
            out.append(number)
        else:
            for h in found:
                if len(at.setdefault(h, [])) < COPY:
                    at[h].append(i)
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str, positives: int, unlabelled: int) -> DataFrame:
    """(id, p, u): the keys of the bounded sample."""
    known = labels.where(~held_out(F.col(key)) & (F.col("toxic") == 1)).select(F.col(key).alias("id")).distinct()
    known = known.orderBy(F.xxhash64("id"), "id").limit(positives)
    every = docs.where(~held_out(F.col(key))).select(F.col(key).alias("id")).distinct()
    every = every.orderBy(F.xxhash64("id", F.lit("u")), "id").limit(unlabelled)
    both = known.select("id", F.lit(1).alias("p"), F.lit(0).alias("u")).union(every.select("id", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> Model:
    """The model learnt from the rows that aren't held out; without positives it scores every text 0, nearly."""
    scratch = Scratch(docs.sparkSession)
    seen = labels.where(~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").alias("t")).agg(F.avg("t")).first()[0]
    if not seen:
        return Model()
    prior = float(np.clip(seen, 0.001, 0.99))
    ids = scratch.write(sample(docs, labels, key, positives, unlabelled))  # at most positives + unlabelled rows
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("x")).join(F.broadcast(ids), "id")
    texts = texts.groupBy("id").agg(F.min("x").alias("x"), F.max("p").alias("p"), F.max("u").alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")  # what other operators held goes
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = [x.as_py() for x in b.column(0)]
            words = [counted(x) for x in texts]
            found = [sorted(features(w).items()) for w, _ in words]
            cols = [
                pa.array([n for _, n in words], pa.int64()),
                pa.array([[f for f, _ in x] for x in found], pa.list_(pa.string())),
                pa.array([[c for _, c in x] for x in found], pa.list_(pa.int64())),
                pa.array([sketch(x) for x in texts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=["n", "p", "u", "w", "f", "c", "s"])

    rows = texts.select("x", F.xxhash64("id").alias("n"), "p", "u").mapInArrow(released(run), "n long, p int, u int, w long, f array<string>, c array<long>, s array<long>")
    rows = scratch.write(rows)
    marks = rows.select("n", "p", "s").toArrow().to_pylist()
    marks.sort(key=lambda r: (-r["p"], r["n"]))
    drop = copies([(r["n"], r["s"]) for r in marks])
    if drop:
        gone = docs.sparkSession.createDataFrame([(n,) for n in drop], "n long")
        rows = rows.join(F.broadcast(gone), "n", "left_anti")
    n = rows.agg(F.sum("p"), F.sum("u")).first()
    if not n[0] or not n[1]:
        return Model()
    np_, nu = float(n[0]), float(n[1])
    tally = rows.select(F.explode("f").alias("f"), "p", "u").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    lift = F.ln((F.col("p") + 0.5) / (np_ + 1)) - F.ln((F.col("u") + 0.5) / (nu + 1))
    mean = (F.col("p") + F.col("u") + 1) / (np_ + nu + 2)
    z = (F.col("p") / np_ - F.col("u") / nu) / F.sqrt(mean * (1 - mean) * (1 / np_ + 1 / nu))
    chosen = tally.withColumns({"lift": lift, "z": z}).where(
        (F.col("lift") >= LIFT) & (F.col("z") >= SIGNIFICANT) & (F.col("p") >= max(LEAST, SHARE * np_))
    )
    names = [r.f for r in chosen.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()]
    if not names:
        return Model()
    at = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(at)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value
        for b in batches:
            pairs = [[(get[f], c) for f, c in zip(x, y) if f in get] for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([[p[i] for p in x] for x in pairs], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(3), b.column(4)], names=["w", "f", "c", "p", "u"])

    got = rows.select("w", "f", "c", "p", "u").mapInArrow(released(only), "w long, f array<long>, c array<long>, p int, u int").toArrow().to_pylist()
    k = len(names)
    x = np.zeros((len(got), 2 * k), np.float32)
    for i, r in enumerate(got):
        x[i, r["f"]] = 1
        x[i, [k + f for f in r["f"]]] = [rate(c, r["w"]) for c in r["c"]]
    p, u = (np.array([r[c] == 1 for r in got], bool) for c in "pu")
    if not p.any() or not u.any():
        return Model()
    w, bias = fit(x[p], x[u], prior)  # which sorts its rows
    return Model(dict(zip(names, zip(w[:k].tolist(), w[k:].tolist()))), bias)


def scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        one = Model(*shared.value).score
        found = pa.array((one(x.as_py()) for x in texts), pa.float64())
        release()
        return found

    return score


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted): a row per row of docs.

    Null and empty texts get the score of a text without features.  Of several
    labels of a key the largest counts; repeated rows get their score each; an
    empty table gives no rows.  A null key is never held out.
    """
    score = scorer(docs.sparkSession, train(docs, labels, key, text))
    out = docs.select(F.col(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), score(F.col(text).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic."""
    row, = fresh(docs, "score_")
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.withColumn(row, score(F.col("text").cast("string"))).where(F.col(row) < THRESHOLD).drop(row)
