"""I-Match fingerprints with randomised lexicons.

Terms are the distinct words between ASCII white space, A-Z as a-z, held as 64-bit hashes. Document frequencies over all documents
are counted in `BUCKETS` hash buckets, so they fit into a table of fixed size at any scale, and terms
outside the idf band are left out. The band is open at the rare end by default: rare terms tell texts apart
best, and a bucket never counts less than its term. Each of `LEXICONS` random functions nests lexicons that
halve from level to level; the finest one that still holds a term of the document is used, so long and short
documents are treated alike. The sorted distinct terms inside are hashed to 32 bits: one part of the
fingerprint. Likeness is the share of equal parts.

A document without a term in the band uses the hash of its whole text in every part. Null texts count as
empty; two empty texts are equal. Rows are put in descending order of doc_id (null last, equal ids by text)
to meet their next document. Repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, small_batches, stored, word_hashes

BUCKETS = 1 << 20
LEXICONS = 16
#: Shares of documents: more frequent terms are left out; the other end is open.
MOST_SHARE = 0.05
_MIX = np.array([xxhash.xxh64_intdigest(f"lexicon {i}") | 1 for i in range(LEXICONS)], dtype=np.uint64)
_SHIFT = np.uint64(29)


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


def terms(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of the distinct terms of each text."""
    return [np.unique(words) for words in word_hashes(texts)]


def bucket_counts(docs: DataFrame) -> DataFrame:
    """Documents per bucket, over all rows, stored; bucket -1 has the number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for found in terms(list(batch["text"])):
                seen[(found % np.uint64(BUCKETS)).astype(np.int64)] += 1  # once per bucket and document
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(seen[used], rows)})

    counted = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return stored(counted, "buckets")


def band(counts: DataFrame, most: float = MOST_SHARE) -> np.ndarray:
    """Which buckets lie in the band; a term in one or two documents of a tiny table is never common.

    Only the buckets above the band come to the driver: each holds a fixed share of the documents, so they are few
    whatever the size of the table.
    """
    total = counts.where("bucket < 0").agg(F.sum("n")).first()[0] or 0
    above = counts.where((F.col("bucket") >= 0) & (F.col("n") > max(2, most * total))).select("bucket").collect()
    kept = np.ones(BUCKETS, bool)
    kept[[r["bucket"] for r in above]] = False
    return kept


def fingerprint(hashes: np.ndarray, kept: np.ndarray, text: str) -> np.ndarray:
    """Parts of the fingerprint as unsigned 32-bit integers."""
    hashes = hashes[kept[(hashes % np.uint64(BUCKETS)).astype(np.int64)]]
    if not len(hashes):
        return np.full(LEXICONS, _hash(text) & 0xFFFFFFFF, dtype=np.uint32)
    mixed = hashes[:, None] * _MIX
    mixed ^= mixed >> _SHIFT
    mixed *= _MIX
    level = np.frexp(mixed.min(axis=0).astype(np.float64))[1]
    inside = mixed <= np.ldexp(1.0, level).astype(np.float64)
    mixed ^= mixed >> _SHIFT
    return (np.where(inside, mixed * _MIX, np.uint64(0)).sum(axis=0, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32)


def parts(texts: list[str | None], kept: np.ndarray) -> list[np.ndarray]:
    return [fingerprint(found, kept, text or "") for found, text in zip(terms(texts), texts)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many of the next text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, kept: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of all texts: columns of ``docs`` plus ``fingerprint``."""
    shared = docs.sparkSession.sparkContext.broadcast(band(bucket_counts(docs)) if kept is None else kept)

    @F.pandas_udf("string")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([p.tobytes().hex() for p in parts(list(texts), shared.value)])

    return docs.withColumn("fingerprint", make("text"))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document.

    Texts are range-partitioned by descending key once. A task knows the next document of all its rows but
    the last; those few go to the stored table with their texts and meet the head of the next task there.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(band(bucket_counts(docs)))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = f"{SCHEMA}, part int, head string, tail string"

    kinds = {"doc_id": "Int64", "n_chars": "Int64", "part": "Int32"}

    def rows(ids: list, texts: list[str], own: list, following: list[str], theirs: list) -> list[tuple]:
        new = [edited(t, after) for t, after in zip(texts, following)]
        made = parts(new, shared.value)
        return [
            (i, len(t), hashlib.sha256(n.encode("utf-8", "surrogatepass")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c))
            for i, t, n, a, b, c in zip(ids, texts, new, own, made, theirs)
        ]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), ([], [], [])
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"].astype(object)]
            texts = list(batch["text"])
            if not texts:
                continue
            own = parts(texts, shared.value)
            out = [] if last[0] else [(*[None] * 7, part, texts[0], None)]
            before = [a + b[: len(b) - 1] for a, b in zip(last, (ids, texts, own))]
            follow = 0 if last[0] else 1
            out += [(*r, None, None, None) for r in rows(*before, texts[follow:], own[follow:])]
            last = [ids[-1]], [texts[-1]], [own[-1]]
            yield pd.DataFrame(out, columns=[*names, "part", "head", "tail"]).astype(kinds)
        if last[0]:
            out = [(last[0][0], *[None] * 6, part, None, last[1][0])]
            yield pd.DataFrame(out, columns=[*names, "part", "head", "tail"]).astype(kinds)

    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(
        partitions(spark), F.desc("doc_id"), "text"
    ).sortWithinPartitions(F.desc("doc_id"), "text")
    walked = stored(ranged.mapInPandas(walk, schema), "fingerprints")
    edges = walked.where("part IS NOT NULL")
    heads = edges.where("head IS NOT NULL").select("part", "head")
    # one row per task: the head of the task that follows, and for the last the head of the first
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after"))
    tails = edges.where("tail IS NOT NULL").select("doc_id", "tail", "part").join(heads, "part")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"].astype(object)]
            texts, after = list(batch["tail"]), list(batch["after"])
            made = rows(ids, texts, parts(texts, shared.value), after, parts(after, shared.value))
            yield pd.DataFrame(made, columns=names).astype({"doc_id": "Int64"})

    closed = tails.select("doc_id", "tail", "after").mapInPandas(close, SCHEMA)
    return walked.where("part IS NULL").select(*names).unionByName(closed)
