"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `ORDER` bytes deep, counted on a sample of labelled
documents and then frozen. The code length of a byte is that of the longest context the tree knows: a byte
seen there costs -log2(n / (total + distinct)), any other byte costs the escape, -log2(distinct / (total +
distinct)), and then its code length in the next shorter context, down to equal odds for all bytes. The
language with the shortest code for the whole text wins; ties go to the first in order of name.

The frozen statistics of all languages are laid out as one dense table, a row for each context, so scoring
is a table lookup per byte. Bytes rarer than `RARE` in the sample share one symbol; contexts of the greatest
depth seen fewer than `LEAST` times in all are left to their shorter context. The model's size depends on
these bounds, never on the corpus.

The sample takes about `SAMPLE` documents per language, by a hash of the key, among those with a language
and a crc32 remainder other than the held-out one. Null texts and texts without a letter are ``und`` with
score 0; without any labelled row every document is ``und``. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import draw, freed, release, remainder, small_batches

ORDER = 3
SAMPLE = 300
RARE = 8
LEAST = 24
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
SPAN = 1 << 18
#: Neighbouring bytes depend on each other; the score takes the mean difference over so many bytes.
SCORE_BYTES = 64.0


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)


def fit(docs: DataFrame) -> dict | None:
    """Frozen code lengths of all languages in the labelled part of ``docs``."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, SAMPLE / n))])
    sample = known.where(draw("doc_id", "language") < share[F.col("lang")])

    @freed
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                code = [np.concatenate([np.full(ORDER, 10, np.uint8), _bytes(t)]).astype(np.int64) for t in texts]
                for order in range(ORDER + 1):
                    grams = []
                    for c in code:
                        g = np.zeros(len(c) - ORDER, np.int64)
                        for back in range(order, -1, -1):
                            g = g << 8 | c[ORDER - back : len(c) - back]
                        grams.append(g)
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "size": order, "gram": gram, "n": n})

    small_batches(docs.sparkSession)
    counted = (
        sample.select("lang", "text").mapInPandas(count, "lang string, size int, gram long, n long")
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    return _freeze(counted, sorted(sizes))


def _freeze(counted: pd.DataFrame, langs: list[str]) -> dict:
    single = counted[counted["size"] == 0].groupby("gram")["n"].sum()
    common = np.array(sorted(single[single >= RARE].index), dtype=np.int64)
    symbol = np.full(256, len(common), dtype=np.int64)
    symbol[common] = np.arange(len(common))
    a = len(common) + 1
    tables: list[list[np.ndarray]] = []
    deep: np.ndarray | None = None
    gathered = {}
    for lang in langs:
        for order in range(ORDER + 1):
            part = counted[(counted["lang"] == lang) & (counted["size"] == order)]
            gram, n = part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.float64)
            index = np.zeros(len(gram), np.int64)
            for back in range(order, -1, -1):
                index = index * a + symbol[gram >> 8 * back & 255]
            keys, where = np.unique(index, return_inverse=True)
            gathered[lang, order] = keys, np.bincount(where, weights=n, minlength=len(keys))
    contexts, totals = [], []
    for lang in langs:
        keys, n = gathered[lang, ORDER]
        contexts.append(keys // a)
        totals.append(n)
    if contexts:
        found, where = np.unique(np.concatenate(contexts), return_inverse=True)
        deep = found[np.bincount(where, weights=np.concatenate(totals), minlength=len(found)) >= LEAST]
    base = a ** (ORDER - 1)
    cost = np.empty((base + len(deep), a, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        chance = np.full((1, a), 1 / 257)
        for order in range(ORDER):
            chance = np.tile(chance, (a if order else 1, 1))  # the shorter context ends the longer one
            chance = _mixed(chance, *gathered[lang, order], a)
        cost[:base, :, k] = -np.log2(chance)
        keys, n = gathered[lang, ORDER]
        at = np.searchsorted(deep, keys // a)
        ok = (at < len(deep)) & (deep[np.minimum(at, len(deep) - 1)] == keys // a) if len(deep) else np.zeros(len(keys), bool)
        cost[base:, :, k] = -np.log2(_mixed(chance[deep % base], at[ok] * a + keys[ok] % a, n[ok], a))
        tables.append([])
    row = np.tile(np.arange(base, dtype=np.int32), a)
    row[deep] = base + np.arange(len(deep), dtype=np.int32)
    return {"langs": langs, "symbol": symbol, "row": row, "cost": cost, "a": a}


def _mixed(shorter: np.ndarray, keys: np.ndarray, n: np.ndarray, a: int) -> np.ndarray:
    """Chances in each context (rows) from its counts and, after an escape, from the shorter context."""
    context, total = keys // a, np.bincount(keys // a, weights=n, minlength=len(shorter))
    distinct = np.bincount(context, minlength=len(shorter)).astype(np.float64)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    out = shorter * escape[:, None]
    out[context, keys % a] = n / (total + distinct)[context]
    return out


def code_lengths(model: dict, text: str) -> np.ndarray:
    """Bits of the whole text under each language."""
    a, symbols = model["a"], model["symbol"][_bytes(text)]
    symbols = np.concatenate([np.full(ORDER, model["symbol"][10]), symbols])
    bits = np.zeros(len(model["langs"]))
    for start in range(ORDER, len(symbols), SPAN):
        end = min(start + SPAN, len(symbols))
        context = np.zeros(end - start, np.int64)
        for back in range(ORDER, 0, -1):
            context = context * a + symbols[start - back : end - back]
        bits += model["cost"][model["row"][context], symbols[start:end]].sum(axis=0, dtype=np.float64)
    return bits


def judge(model: dict | None, text: str | None) -> tuple[str, float]:
    if model is None or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    bits = code_lengths(model, text)
    best = int(np.argmin(bits))
    scale = np.log(2) / max(1.0, len(text) / SCORE_BYTES)
    return model["langs"][best], float(1 / np.exp((bits[best] - bits) * scale).sum())


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` that the caller has, plus ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(shared.value, t) for t in texts], columns=["lang_pred", "score"])
        release(collect=False)

    return docs.withColumn("_judged", predict("text")).select(
        *docs.columns, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score")
    )
