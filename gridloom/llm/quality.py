"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Tokens are words in lower case, runs of punctuation, a mark for words in capitals and one for each piece
that repeats the piece before it. Every token has a
fixed sparse index vector from its hash; a token's word vector is its index vector plus the sum of the
index vectors of the tokens up to `REACH` places away in the sample. A document's vector is the mean of its
token vectors. Two layers in numpy turn it into a logit, and a temperature, chosen on a part of the
sample the layers have not seen, turns the logit into a probability.

Fitted on about `SAMPLE` labelled documents at most, by a hash of the key, among those with a crc32
remainder other than the held-out one; the vocabulary is the `VOCABULARY` most frequent tokens of the
sample. Both are fixed bounds of the model, so it does not grow with the corpus. Tokens outside the
vocabulary share vectors by shape. Null and empty texts pool to a zero vector and get the score the network
gives it. Without any label every score is 0.5. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Memo, draw, freed, release, remainder, small_batches

DIMENSIONS, NONZERO, REACH = 64, 6, 2
SAMPLE, VOCABULARY, LEAST = 4000, 8192, 5
HIDDEN, STEPS, RATE = 24, 400, 0.02
FOLDS, HELD_OUT = 5, 0
PART_ROWS = 4096
THRESHOLD = 0.3
AGAIN = "<again>"
_TOKENS = re.compile(r"\w+|[^\w\s]+")


def tokens(chunk: str) -> tuple[str, ...]:
    """Tokens of a piece of text without white space."""
    out = []
    for t in _TOKENS.findall(chunk):
        if len(t) > 1 and t.isupper():
            out.append("<capitals>")
        out.append(t.lower())
    return tuple(out)


def repeats(chunks: list[str]) -> int:
    return sum(map(eq, chunks, chunks[1:]))


def _shape(token: str) -> str:
    kind = "w" if token.isalpha() else "d" if token.isdigit() else "m" if token.isalnum() else "p"
    return f"<{kind}{min(len(token), 16) // 4}>"


def index_vectors(names: list[str]) -> np.ndarray:
    """Sparse ternary vectors, one per token, from the token's hash alone."""
    seed = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in names], dtype=np.uint64)
    out = np.zeros((len(names), DIMENSIONS), np.int8)
    for i in range(NONZERO):
        mixed = (seed + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out[np.arange(len(names)), (mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS] = np.where(mixed >> np.uint64(63), 1, -1)
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: doc_id, text, label, and whether the row is for the temperature."""
    kept = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, SAMPLE / 2 / n) for k, n in sizes.items()}
    chosen = kept.where(
        draw("doc_id", "quality") < F.when(F.col("label") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    )
    # at most about SAMPLE rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "label", (remainder("doc_id", FOLDS) == 1).alias("later")
    )


@freed
def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and token: how often, and the sum of the index vectors around it."""
    split = Memo(tokens)
    for batch in batches:
        names: dict[str, int] = {}
        lines = []
        for text in batch["text"]:
            chunks = (text or "").split()
            line = [names.setdefault(t, len(names)) for t in chain.from_iterable(map(split.__getitem__, chunks))]
            line += [names.setdefault(AGAIN, len(names))] * repeats(chunks)
            lines.append(np.array(line, np.int64))
        if not names:
            continue
        vectors = index_vectors(list(names)).astype(np.int32)
        total = np.zeros((len(names), DIMENSIONS), np.int32)
        count = np.zeros(len(names), np.int64)
        for line in filter(len, lines):
            own = vectors[line]
            around = np.zeros_like(own)
            for away in range(1, REACH + 1):
                around[:-away] += own[away:]
                around[away:] += own[:-away]
            order = np.argsort(line, kind="stable")
            used, starts, n = np.unique(line[order], return_index=True, return_counts=True)
            total[used] += np.add.reduceat(around[order], starts, axis=0)
            count[used] += n
        del vectors, lines
        listed = list(names)
        for at in range(0, len(listed), PART_ROWS):  # on its way out a row is held several times over
            part = slice(at, at + PART_ROWS)
            yield pd.DataFrame({"token": listed[part], "n": count[part], "around": list(total[part].astype(np.int64))})


@freed
def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, list] = {}
    for batch in batches:
        for token, n, around in zip(batch["token"], batch["n"], batch["around"]):
            known = sums.setdefault(token, [0, np.zeros(DIMENSIONS, np.int64)])
            known[0] += n
            known[1] += around
    rows = [(t, n, a) for t, (n, a) in sums.items() if n >= LEAST]
    yield pd.DataFrame(rows, columns=["token", "n", "around"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Pooler:
    """Text -> mean of its token vectors."""

    def __init__(self, words: list[str], table: np.ndarray):
        at = {t: i for i, t in enumerate(words)}
        self.table, self.again = table, at.get(AGAIN, 0)
        self.rows = Memo(lambda chunk: tuple(at.get(t, at.get(_shape(t), 0)) for t in tokens(chunk)))

    def __call__(self, text: str | None) -> np.ndarray:
        chunks = (text or "").split()
        rows = list(chain.from_iterable(map(self.rows.__getitem__, chunks)))
        rows += [self.again] * repeats(chunks)
        if not rows:
            return np.zeros(DIMENSIONS)
        counts = np.bincount(np.array(rows, np.int32))
        used = np.flatnonzero(counts)
        return counts[used] @ self.table[used] / len(rows)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Word vectors and network, from the bounded sample of labelled rows."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels)
    kind = "token string, n long, around array<long>"
    words = (
        sample.select("text").mapInPandas(_contexts, kind).repartition(8, "token").mapInPandas(_summed, kind)
        .orderBy(F.desc("n"), "token").limit(VOCABULARY).toPandas()
    )
    shapes = [AGAIN] * (AGAIN not in set(words["token"])) + [f"<{k}{i}>" for k in "wdmp" for i in range(5)]
    names = [*words["token"], *shapes]
    own = _unit(index_vectors(names).astype(np.float64))
    around = np.zeros_like(own)
    if len(words):
        around[: len(words)] = _unit(np.stack(list(words["around"])).astype(np.float64))
    table = own + around

    @freed
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pooler(names, table)
        for batch in batches:
            yield pd.DataFrame({"x": [pool(t) for t in batch["text"]], "label": batch["label"], "later": batch["later"]})

    rows = sample.mapInPandas(features, "x array<double>, label int, later boolean").toPandas()
    if not len(rows):
        return None
    x, y, later = np.stack(list(rows["x"])), rows["label"].to_numpy(float), rows["later"].to_numpy(bool)
    order = np.lexsort([*x.T, y])  # the same sample gives the same network, in whatever order it comes
    x, y, later = x[order], y[order], later[order]
    if later.all() or not later.any():
        later = np.arange(len(y)) % 4 == 0
    net = _train(x[~later], y[~later]) if (~later).any() else _train(x, y)
    heat = _temperature(_logit(net, x[later]), y[later]) if later.any() else 1.0
    return {"words": names, "table": table, "net": net, "heat": heat}


def _train(x: np.ndarray, y: np.ndarray) -> dict:
    rng = np.random.RandomState(7)
    net = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    x = (x - net["mean"]) / net["scale"]
    w = [rng.randn(DIMENSIONS, HIDDEN) / 8, np.zeros(HIDDEN), rng.randn(HIDDEN) / 5, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        error = weight * (_sigmoid(hidden @ w[2] + w[3]) - y) / len(y)
        back = np.outer(error, w[2]) * (1 - hidden**2)
        slopes = [x.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net | {"w": w}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(net: dict, x: np.ndarray) -> np.ndarray:
    w = net["w"]
    return np.tanh((x - net["mean"]) / net["scale"] @ w[0] + w[1]) @ w[2] + w[3]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    grid = np.exp(np.linspace(np.log(0.3), np.log(10), 40))
    loss = [-np.mean(np.log(np.where(y == 1, _sigmoid(z / t), 1 - _sigmoid(z / t)) + 1e-12)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs``, plus ``score`` and ``predicted``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        pool = known and Pooler(known["words"], known["table"])
        for texts in batches:
            if not known or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            rows = [_logit(known["net"], pool(t)[None]) for t in texts]  # one by one: equal texts, equal scores
            yield pd.Series(_sigmoid(np.concatenate(rows) / known["heat"]))
        del pool
        release(collect=False)

    return docs.withColumn("score", rate("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
