"""Nearest neighbours with shifted space-filling curves.

Several random projections of the vectors, each shifted by a random offset, are ordered along a Hilbert
curve and range-partitioned by (curve, key). Every query is compared with the `WINDOW` rows before and after
it on each curve; the windows merge and are reranked by exact distance. That gives each query a bound on the
distance of its k-th neighbour.

Windows alone find the neighbours of data with few intrinsic dimensions only. A second pass makes the result
whole: the rows lie in blocks along the first curve, each with centre and radius, and a block is read for a
query unless its centre lies further than the query's bound plus the radius. Blocks are dealt into chunks that
a task can hold, and all queries pass each chunk in groups: to be compared, a vector moves once in all and a
query once per chunk. What a task has found tightens the bounds, and a first round over one block in `LEAD` tightens those of the
second, over all other blocks.

Distances within a block come from matrix products in single precision, of vectors less the block's centre.
They only leave out what lies beyond the bound by more than their rounding error; distances of the rest are
computed in double precision. That takes time with the number of queries times that of vectors, unless blocks
are left out.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose length
differs from the most frequent length. A repeated query id is searched once, a repeated candidate id is
reported once, at its smallest distance. Ties go to the smaller id. Of equal vectors in a block the k + 1
smallest ids are compared: whichever is the query's own, k others come before the ones left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gridloom.llm.common import freed, partitions, stored
from gridloom.llm.hilbert import hilbert_index

CURVES, AXES, BITS = 3, 8, 7
WINDOW = 64
#: Vectors of a block, queries of a group, rows on either side of one matrix product: its result stays in the cache.
BLOCK, GROUP, TILE = 2048, 2048, 512
#: Bytes of vectors that a task holds; one block in LEAD is searched first.
CHUNK_BYTES, LEAD = 128 << 20, 16
#: Bytes of the vectors gathered for windows at a time; pairs whose distance is computed at a time.
WINDOW_BYTES, PAIRS = 8 << 20, 32768
FOUND = "query_id long, vec_id long, score double"
#: In place of a block's number for what comes after all blocks of a chunk.
LAST = (1 << 63) - 1

_LONG, _DOUBLE = pa.int64(), pa.float64()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the components v of vectors that may take part, single precision if they come so, else double."""
    single = isinstance(vectors.select("embedding").schema[0].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    # not(array_contains(..)) holds neither with the value nor with a null among the components; NaN is the largest
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where(
        F.col("vec_id").isNotNull() & ~F.array_contains("v", F.lit(float("inf")).cast(kind)) & ~F.isnan(F.array_max("v"))
        & (F.array_min("v") > float("-inf")) & ((F.array_max("v") != 0) | (F.array_min("v") != 0))
    )


def _binary(v: np.ndarray) -> pa.Array:
    """One binary value per row."""
    width = v.dtype.itemsize * v.shape[1]
    offsets = np.arange(0, (len(v) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v))])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of binary values of one length."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def keyed(vectors: DataFrame, kind: str, curves: tuple[int, ...]) -> DataFrame:
    """One row per curve and vector: curve, key, vec_id, v as bytes."""
    names = ["curve", "key", "vec_id", "v"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(kind, copy=False)
            # lengths differ between tables: the direction gives the place
            unit = v.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            rows = _binary(v)
            for curve in curves:
                rng = np.random.RandomState(curve)
                axes = np.linalg.qr(rng.randn(v.shape[1], min(AXES, v.shape[1])))[0]
                flat = unit @ axes * np.sqrt(v.shape[1]) / 8
                cells = np.clip((flat + 0.5 + rng.rand(axes.shape[1]) / 8) * (1 << BITS), 0, (1 << BITS) - 1)
                key = hilbert_index(cells.astype(np.int64), BITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), curve, np.int32)), pa.array(key), batch.column("vec_id"), rows], names)

    return vectors.mapInArrow(freed(place), "curve int, key long, vec_id long, v binary")


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query, each id once, and their ranks from 0."""
    order = np.lexsort((score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[fresh], ids[fresh], score[fresh]
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    at = np.arange(len(ids))
    start = np.ones(len(ids), bool)
    start[1:] = query[1:] != query[:-1]
    rank = at - np.maximum.accumulate(np.where(start, at, 0))
    keep = rank < k
    return query[keep], ids[keep], score[keep], rank[keep]


def window_neighbours(ordered: DataFrame, kind: str, every: int, k: int) -> DataFrame:
    """Per query the best rows within its windows, with query_id and score; and each row of the first curve, with
    its block and v. Rows come in order of (curve, key)."""
    names = ["query_id", "vec_id", "score", "block", "v"]

    def windows(ids: np.ndarray, v: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, WINDOW_BYTES // (8 * v.shape[1] * (2 * WINDOW + 1)))
        for i in range(0, len(at), step):
            own = at[i : i + step]
            near = own[:, None] + np.arange(-WINDOW, WINDOW + 1)
            inside = (near >= 0) & (near < len(ids))
            near = np.clip(near, 0, len(ids) - 1)
            inside &= ids[near] != ids[own][:, None]
            d = np.sqrt(((v[near].astype(np.float64) - v[own].astype(np.float64)[:, None]) ** 2).sum(axis=2))
            a, b = np.nonzero(inside)
            query, found, score, _ = _best(ids[own][a], ids[near[a, b]], d[a, b], k)
            if len(query):
                n = len(query)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score), pa.nulls(n, _LONG), pa.nulls(n, pa.binary())], names)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, v, first, placed, batches = np.empty(0, np.int64), None, 0, 0, iter(batches)
        while True:
            batch = next(batches, None)
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                n = int(np.count_nonzero(batch.column("curve").to_numpy() == 0))  # the first rows
                if n:
                    block = (part << 32) + (placed + np.arange(n)) // BLOCK
                    placed += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, _LONG), batch.column("vec_id").slice(0, n), pa.nulls(n, _DOUBLE), pa.array(block), batch.column("v").slice(0, n)], names
                    )
                ids = np.append(ids, batch.column("vec_id").to_numpy())
                rows = _matrix(batch.column("v"), kind)
                v = rows if v is None else np.concatenate([v, rows])
            ready = max(0, len(ids) - (0 if batch is None else WINDOW))
            yield from windows(ids, v, first + np.flatnonzero(ids[first:ready] % every == 0))
            if batch is None:
                return
            cut = max(0, ready - WINDOW)
            first = max(first, ready) - cut
            ids, v = ids[cut:], v[cut:]

    return ordered.mapInArrow(freed(slide), f"{FOUND}, block long, v binary")


def _block(ids: list[np.ndarray], rows: list[np.ndarray], k: int) -> tuple:
    """ids, vectors, centre and radius of a block, and how often an id occurs at most; the vectors from the centre on."""
    ids, v = np.concatenate(ids), np.concatenate(rows)
    same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    keep = _equal(same, ids, k + 1)
    ids, v = ids[keep], v[keep]
    centre = v.mean(axis=0, dtype=np.float64).astype(v.dtype).astype(np.float64)
    away = np.sqrt(((v - centre) ** 2).sum(axis=1))
    order = np.argsort(away)
    return ids[order], v[order], centre, away[order[-1]], int(np.unique(ids, return_counts=True)[1].max())


def _equal(same: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows with the ``most`` smallest ids of each number in ``same``, each id once."""
    order = np.lexsort((ids, same))
    same, ids = same[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])
    order, same = order[fresh], same[fresh]
    at = np.arange(len(same))
    start = np.ones(len(same), bool)
    start[1:] = same[1:] != same[:-1]
    return np.sort(order[at - np.maximum.accumulate(np.where(start, at, 0)) < most])


def _within(left: np.ndarray, right: np.ndarray, border: np.ndarray, slack: np.ndarray, most: int, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``right`` and ``left`` with |left| ** 2 - 2 left right up to the border of the row of ``right``;
    those of a row that hold its ``most`` nearest rows suffice. No sum is off by more than slack."""
    squares = np.einsum("ij,ij->i", left, left)
    a, b = [], []
    for j in range(0, len(left), TILE):
        part, square = left[j : j + TILE], squares[j : j + TILE]
        least = (square.min() - border) / 2 - 1e-6 * np.abs(border)
        for i in range(0, len(right), TILE):
            some = right[i : i + TILE]
            product = np.matmul(part, some.T, out=products[: len(part), : len(some)])
            hit = np.flatnonzero(product.max(axis=0) >= least[i : i + TILE])
            if not len(hit):
                continue
            rough, near = square - 2 * product.T[hit], border[i + hit]
            if most <= len(part) and np.count_nonzero(rough <= near[:, None]) > 4 * most * len(hit):  # loose limits
                last = np.partition(rough, most - 1, axis=1)[:, most - 1]
                near = np.minimum(near, last + 2 * slack[i + hit])
            x, y = np.nonzero(rough <= near[:, None])
            a.append(i + hit[x])
            b.append(j + y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _search(blocks: list[tuple], q: np.ndarray, qids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of the blocks for each query, within its bound.

    Blocks and queries are compared in units in which no length is over 1, less the block's centre. With d components
    and a rounding unit of 2 ** -24 the products, the sums of squares and the rounded components put the square of a
    distance off by less than (3 d + 8) units of the square of both lengths' sum; (4 d + 32) are allowed.
    """
    rounding = (4 * q.shape[1] + 32) * 2.0**-24
    limit, score, found = bound.copy(), np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    size, last = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max()), 0.0
    # used again for each block: fresh memory of this size costs as much as what is done with it
    most = max(len(block[0]) for block in blocks)
    lefts, rights, products = (np.empty(shape, np.float32) for shape in ((most, q.shape[1]), q.shape, (TILE, TILE)))
    pending: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        """Take in the pairs that were found since the last time; limits that come late are only looser."""
        if not sum(len(x) for x, _, _ in pending):
            return
        a, i, d = map(np.concatenate, zip(*pending))
        pending.clear()
        inside = d <= limit[a] * (1 + 1e-9)
        a, i, d = a[inside], i[inside], d[inside]
        rows = np.unique(a)
        x, y = np.nonzero(np.isfinite(score[rows]))
        x = rows[x]
        row, i, d, rank = _best(np.append(a, x), np.append(i, found[x, y]), np.append(d, score[x, y]), k)
        score[row, rank], found[row, rank] = d, i
        limit[rows] = np.minimum(limit[rows], score[rows, k - 1])

    for ids, v, centre, radius, times in blocks:
        largest = size + np.sqrt((centre**2).sum()) + radius
        unit = 2.0 ** min(120, -np.ceil(np.log2(largest)))  # finite in single precision
        middle, power = (centre * unit).astype(v.dtype), v.dtype.type(unit)
        if unit != last:
            scaled, last = q * power, unit
        right = np.subtract(scaled, middle, out=rights, casting="same_kind")
        own = np.sqrt(np.einsum("ij,ij->i", right, right).astype(np.float64))
        reach = (limit * (1 + 1e-9) + radius) * unit
        near = np.flatnonzero(own * (1 - rounding) <= reach * (1 + rounding) + 1e-15)
        if not len(near):
            continue
        if len(near) < len(q):
            right, own = right[near], own[near]
        left = np.multiply(v, power, out=lefts[: len(v)]) if v.dtype == np.float32 else v * power
        left = np.subtract(left, middle, out=lefts[: len(v)], casting="same_kind")
        slack = rounding * (own + radius * unit) ** 2 + 1e-30
        with np.errstate(over="ignore"):
            border = ((limit[near] * unit * (1 + 1e-9)) ** 2 - own**2 + slack).astype(np.float32)
        a, b = _within(left, right, border, slack.astype(np.float32), (k + 1) * times, products)
        a = near[a]
        other = qids[a] != ids[b]
        a, b = a[other], b[other]
        d = [np.sqrt(((v[b[i : i + PAIRS]].astype(np.float64) - q[a[i : i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(a), PAIRS)]
        pending.append((a, ids[b], np.concatenate([*d, np.empty(0)])))
        if sum(len(x) for x, _, _ in pending) >= len(q):
            merge()
    merge()
    a, b = np.nonzero(np.isfinite(score))
    return qids[a], found[a, b], score[a, b]


def searched(blocks: DataFrame, queries: DataFrame, groups: int, chunks: int, kind: str, k: int) -> DataFrame:
    """The k best rows of each chunk for each query, within its bound. blocks: block, vec_id, v; queries: query_id, v, bound."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        head = group["query_id"].to_numpy("<i8").tobytes() + group["bound"].to_numpy("<f8").tobytes()
        return pd.DataFrame({"head": [head], "v": [np.stack(list(group["v"])).astype(kind).tobytes()]})

    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).applyInPandas(pack, "head binary, v binary")
    passing = packed.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(LAST).alias("block"), F.lit(None).cast("long").alias("vec_id"), "v", "head")
    held = blocks.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"), "block", "vec_id", "v", F.lit(None).cast("binary").alias("head"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, rows, last = [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column("chunk").to_numpy().astype(np.int64), batch.column("block").to_numpy()], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                key = tuple(keys[lo].tolist())
                if key != last and ids:
                    blocks.append(_block(ids, rows, k))
                    ids, rows = [], []
                if last is not None and key[0] != last[0]:
                    blocks = []
                last = key
                if key[1] != LAST:
                    ids.append(batch.column("vec_id").slice(lo, hi - lo).to_numpy())
                    rows.append(_matrix(batch.column("v").slice(lo, hi - lo), kind))
                    continue
                for i in range(lo, hi) if blocks else ():
                    head = batch.column("head")[i].as_buffer()
                    n = head.size // 16
                    qids, bound = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<f8", n, 8 * n)
                    q = np.frombuffer(batch.column("v")[i].as_buffer(), kind).reshape(n, -1)
                    query, vec, score = _search(blocks, q, qids, bound, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    return held.union(passing).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "block").mapInArrow(freed(compare), FOUND)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query, exact."""
    with shuffles_dropped(vectors.sparkSession):
        return _nearest(vectors, every, k)


def _nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    order = ["curve", "key", "vec_id"]
    kept = usable(vectors)
    usual = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    length, rows = (usual["n"], usual["rows"]) if usual else (0, 0)
    kind = "<f4" if kept.schema["v"].dataType.elementType == FloatType() else "<f8"

    def sorted_along(name: str, *curves: int) -> DataFrame:
        placed = keyed(kept.where(F.size("v") == length), kind, curves).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        return stored(window_neighbours(placed, kind, every, k), name)

    # a query's windows and the blocks come out of one sort
    first_curve, others = sorted_along("curve", 0), sorted_along("curves", *range(1, CURVES))
    blocks = first_curve.where("block IS NOT NULL").select("block", "vec_id", "v")

    asked = usable(vectors.where(F.col("vec_id").cast("long") % every == 0)).where(F.size("v") == length)
    asked = stored(asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"), (F.min("v") == F.max("v")).alias("one")), "queries")
    count = asked.count()
    if not count:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # windows of an id that has several vectors belong to any of them
    windows = first_curve.union(others).where("query_id IS NOT NULL").select("query_id", "vec_id", "score")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def best(found: DataFrame) -> DataFrame:
        whole = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return whole.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def bounded(found: DataFrame) -> DataFrame:
        bounds = best(found).groupBy("query_id").agg(F.max("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k)
        return stored(asked.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounds")

    def chunks(share: float, each: int) -> int:
        """As many as hold that share of the vectors, and so many for each task that runs at a time at least."""
        held = rows * length * np.dtype(kind).itemsize * share
        return max(-int(-held // CHUNK_BYTES), each * spark.sparkContext.defaultParallelism)

    windows = stored(best(windows.join(asked.where("one").select("query_id"), "query_id", "left_semi")).drop("rank"), "windows")
    groups = -(-count // GROUP)
    first = F.pmod(F.xxhash64("block", F.lit("lead")), F.lit(LEAD)) == 0
    # bounds are loose in the first round, and each chunk has to tighten them again: as few as keep all tasks busy
    lead = stored(best(searched(blocks.where(first), bounded(windows), groups, chunks(1 / LEAD, 1), kind, k)).drop("rank"), "lead")
    rest = searched(blocks.where(~first), bounded(windows.union(lead)), groups, chunks(1 - 1 / LEAD, 2), kind, k)
    return best(lead.union(rest))
