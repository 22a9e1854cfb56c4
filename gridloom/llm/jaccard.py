"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

A document's set holds the 64-bit hashes of its distinct `WORDS`-word shingles. Two documents link when
100 * intersection >= `PERCENT` * union. The steps:

1. Documents with equal sets fall into one class by two 64-bit sums over the set; its smallest doc_id
   stands for it from here on.
2. Classes that share the smallest value of one of `KEYS` hash functions are compared with the first of
   them. This links almost all near copies, however many there are, by stars instead of pairs.
3. The product. Shingles have one order for all documents: the frequent ones last, by how frequent they are,
   the rest first, by hash. Linked sets share shingles among their first n - ceil(0.8 n) + 1, so only that
   part of the incidence is multiplied, and only pairs that step 2 left in different components count. The
   columns are dealt into blocks by hash, a very frequent column into cells of pairs of row blocks. Each
   block adds up the overlaps of its pairs. Sizes m and n demand an overlap of alpha = ceil(0.8 (m + n) /
   1.8), so the first shared shingle has at most m - alpha others of its set before it, and n - alpha of the
   other: overlaps further back are not counted, and pairs without any are dropped.
4. What is left is compared exactly, on the whole sets, and the components of all links are formed.

No link between different sets is lost: step 2 only links what it has compared, and step 3 skips nothing but
pairs already in one component. Frequent shingles only decide the order, which any order would do.

Null and empty texts and texts without words have no shingle and link with nothing; texts with fewer words
have their whole sequence as one shingle. Rows without doc_id get no component. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import freed, mixed, partitions, small_batches, stored, word_hashes
from gridloom.llm.graph import components

WORDS, PERCENT = 5, 80
KEYS = 4
#: The most frequent shingles, at most so many, are ordered last. A task reports those it sees so often.
FREQUENT, REPORTED = 1 << 18, 3
HELD_HASHES = 1 << 22
CELL_ROWS = 1000
LEAD_ROWS = 500
#: Rows up to which a side is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_STEP = np.uint64(0x9FB21C651E98DF25)
_SALTS = [np.uint64(0xA24BAED4963EE407 * (i + 1) % (1 << 64)) for i in range(KEYS)]


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    if not len(words):
        return words
    size = min(WORDS, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = h * _STEP + words[i : len(words) - size + 1 + i]
    return np.unique(mixed(h))


def sets_of(texts) -> Iterator[np.ndarray]:
    return map(shingles, word_hashes(list(texts)))


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).astype(np.int64)


def often(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur ``least`` times or more, and how often; empties ``held`` and takes twice its size at most."""
    rows = np.concatenate([np.empty(0, np.uint64), *held])
    held.clear()
    rows.sort()
    grams = np.unique(rows[least - 1 :][rows[least - 1 :] == rows[: max(len(rows) - least + 1, 0)]])
    return grams, np.searchsorted(rows, grams, "right") - np.searchsorted(rows, grams)


def summaries(docs: DataFrame) -> DataFrame:
    """Per document its set size, the two sums and its keys; and per task the shingles frequent there."""
    names = ["doc_id", "n", "s1", "s2", "keys", "gram", "seen"]
    kinds = {"doc_id": "Int64", "n": "Int64", "s1": "Int64", "s2": "Int64", "gram": "Int64", "seen": "Int64"}

    @freed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def frequent() -> pd.DataFrame:
            grams, seen = often(held, REPORTED)
            made = pd.DataFrame({"gram": _signed(grams), "seen": seen}).reindex(columns=names).astype(kinds)
            return made.assign(keys=pd.Series([None] * len(made), dtype=object))

        for batch in batches:
            out = []
            for doc, s in zip(batch["doc_id"].astype(object), sets_of(batch["text"])):
                keys = [int(_signed(mixed(s ^ salt).min())) for salt in _SALTS] if len(s) else None
                m = mixed(s)
                s1, s2 = (int(_signed(x.sum(dtype=np.uint64))) for x in (m, mixed(m * _STEP)))
                out.append((doc, len(s), s1, s2, keys, None, None))
                held.append(s)
                size += len(s)
            yield pd.DataFrame(out, columns=names).astype(kinds)
            if size >= HELD_HASHES:
                yield frequent()
                held, size = [], 0
        yield frequent()

    small_batches(docs.sparkSession)
    schema = "doc_id long, n long, s1 long, s2 long, keys array<long>, gram long, seen long"
    return stored(docs.select("doc_id", "text").mapInPandas(run, schema), "shingle-sums")


def _fits(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _near(docs: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Join to texts; the asked rows are broadcast only when they are few."""
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    return docs.select(F.col("doc_id").alias(key), "text").join(asked, key)


def compared(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. The texts of each a meet those of its b in parts."""
    pairs = stored(pairs, f"{name}-pairs")
    leads = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / LEAD_ROWS).cast("int").alias("salts"))
    asked = (
        pairs.join(leads, "a")
        .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc"))
        .union(leads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0), F.col("a")))
    )
    asked = stored(asked, f"{name}-asked")
    order = ["a", "salt", "role", "doc"]
    met = _near(docs, asked, "doc").select(*order, "text").repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions(*order)

    @freed
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, heads = None, []
        for batch in batches:
            found = []
            for a, salt, role, doc, s in zip(batch["a"], batch["salt"], batch["role"], batch["doc"], sets_of(batch["text"])):
                if (a, salt) != lead:
                    lead, heads = (a, salt), []
                if role == 0:
                    heads.append(s)
                elif any(linked(head, s) for head in heads):
                    found.append((a, doc))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return stored(met.mapInPandas(compare, "a long, b long"), f"{name}-links")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def prefix(s: np.ndarray, grams: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The part of the set that linked sets must share in, in the common order."""
    length = len(s) - -(-PERCENT * len(s) // 100) + 1
    if len(grams):
        at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
        weight = np.where(grams[at] == s, seen[at], 0)
        if weight.any():
            s = s[np.lexsort((s, weight))]
    return s[:length]


_ENTRY = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("root", "<i8"), ("n", "<u4"), ("place", "<u4"), ("side", "u1")])


def _entries(doc: int, root: int, n: int, grams: np.ndarray, cells: dict[int, int]) -> np.ndarray:
    """Rows of the incidence; a very frequent column appears once for each cell its document's block is in."""
    out = np.empty(len(grams), _ENTRY)
    out["gram"], out["doc"], out["root"], out["n"], out["side"] = grams, doc, root, n, 0
    out["place"] = np.arange(len(grams))
    many = [i for i, g in enumerate(grams.tolist()) if g in cells] if cells else []
    if not many:
        return out
    parts = [np.delete(out, many)]
    for i in many:
        count = cells[int(grams[i])]
        own = hash((doc, 17)) % count
        cell = np.repeat(out[i : i + 1], count)
        for other in range(count):
            low, high = min(own, other), max(own, other)
            cell["gram"][other] = mixed(grams[i : i + 1] ^ np.uint64((low * count + high + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0]
            cell["side"][other] = 0 if own == other else 1 if own == low else 2
        parts.append(cell)
    return np.concatenate(parts)


def overlap_counts(block: np.ndarray) -> pd.DataFrame:
    """Pairs of rows of different components in a block of columns, with the number of columns they share."""
    block = block[np.argsort(block["gram"], kind="stable")]
    gram = block["gram"]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(gram)])
    if len(starts):
        mixed_roots = np.maximum.reduceat(block["root"], starts) != np.minimum.reduceat(block["root"], starts)
        block = block[np.repeat(mixed_roots, sizes)]
        sizes = sizes[mixed_roots]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(block)) - 1  # rows of the same column below
    found, held, ahead = [], 0, 1
    rows = np.flatnonzero(left >= ahead)
    totals: list[np.ndarray] = []
    while len(rows):
        a, b = block[rows], block[rows + ahead]
        na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
        alpha = -(-PERCENT * (na + nb) // (100 + PERCENT))
        ok = (a["root"] != b["root"]) & (a["doc"] != b["doc"]) & ((a["side"] == 0) | (a["side"] != b["side"]))
        ok &= (a["place"] <= na - alpha) & (b["place"] <= nb - alpha)  # false for sizes too far apart
        if ok.any():
            a, b = a[ok], b[ok]
            swap = a["doc"] > b["doc"]
            found.append(np.stack([np.where(swap, b["doc"], a["doc"]), np.where(swap, a["doc"], b["doc"])], axis=1))
            held += len(a)
            if held > 4_000_000:
                totals = [_added(found, totals)]
                found, held = [], 0
        ahead += 1
        rows = rows[left[rows] >= ahead]
    total = _added(found, totals)
    return pd.DataFrame(total, columns=["a", "b", "shared"])


def _added(found: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
    rows = [np.c_[f, np.ones(len(f), np.int64)] for f in found] + totals
    if not rows:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(rows)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    out = rows[starts]
    out[:, 2] = np.add.reduceat(rows[:, 2], starts)
    return out


def product_pairs(docs: DataFrame, marks: DataFrame, frequent: pd.DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that overlap where their sizes demand it."""
    spark = docs.sparkSession
    order = np.argsort(frequent["gram"].to_numpy(np.int64).view(np.uint64))
    grams, seen = frequent["gram"].to_numpy(np.int64).view(np.uint64)[order], frequent["seen"].to_numpy(np.int64)[order]
    cells = {int(g): -(-int(c) // CELL_ROWS) for g, c in zip(grams, seen) if c > CELL_ROWS}
    blocks = 4 * partitions(spark)
    shared = spark.sparkContext.broadcast((grams, seen, cells))

    @freed
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, seen, cells = shared.value
        held, size = [], 0

        def cut() -> pd.DataFrame:
            rows = np.concatenate(held) if held else np.empty(0, _ENTRY)
            block = (rows["gram"] >> np.uint64(20)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            ids, starts = np.unique(block[order], return_index=True)
            parts = np.split(rows[order], starts[1:]) if len(ids) else []
            return pd.DataFrame({"block": ids.astype(np.int32), "rows": [p.tobytes() for p in parts]})

        for batch in batches:
            for doc, root, skip, s in zip(batch["doc"], batch["root"], batch["skip"], sets_of(batch["text"])):
                if not skip and len(s):
                    held.append(_entries(int(doc), int(root), len(s), prefix(s, grams, seen), cells))
                    size += len(held[-1])
            if size > 1_000_000:
                yield cut()
                held, size = [], 0
        yield cut()

    @freed
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for block, rows in zip(batch["block"], batch["rows"]):
                if block != at and held:
                    yield overlap_counts(np.concatenate(held))
                    held = []
                at = block
                held.append(np.frombuffer(rows, _ENTRY))
        if held:
            yield overlap_counts(np.concatenate(held))

    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text").join(marks, "doc", "left")
    texts = texts.select("doc", "text", F.coalesce("root", "doc").alias("root"), F.coalesce("skip", F.lit(False)).alias("skip"))
    dealt = texts.mapInPandas(deal, "block int, rows binary").repartition(partitions(spark), "block").sortWithinPartitions("block")
    return dealt.mapInPandas(multiply, "a long, b long, shared long").select("a", "b").distinct()


def most_frequent(sums: DataFrame) -> pd.DataFrame:
    """Reported shingles with their counts, cut at the count that leaves at most FREQUENT of them."""
    grams = sums.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen"))
    step = F.floor(F.log2(F.col("seen").cast("double")) * 8)
    left, least = FREQUENT, None
    for row in grams.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("seen").alias("least")).orderBy(F.desc("step")).collect():
        left -= row["n"]  # a few hundred steps at most
        if left < 0:
            break
        least = row["least"]
    return grams.where(F.lit(False) if least is None else F.col("seen") >= least).toPandas()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = summaries(docs)
    rows = sums.where("gram IS NULL").select("doc_id", "n", "s1", "s2", "keys")
    frequent = most_frequent(sums)
    kind = ["n", "s1", "s2"]
    classes = stored(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*kind)
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("keys").alias("keys")), "classes",
    )
    keyed = classes.select(F.col("first").alias("doc"), "n", F.posexplode("keys").alias("which", "key"))
    heads = keyed.groupBy("which", "key").agg(F.min(F.struct("doc", "n")).alias("head"), F.count("*").alias("rows")).where("rows > 1")
    stars = (
        keyed.join(heads.select("which", "key", "head"), ["which", "key"])
        .where(F.col("doc") != F.col("head.doc")).where(_fits("n", "head.n"))
        .select(F.col("head.doc").alias("a"), F.col("doc").alias("b")).distinct()
    )
    near = compared(docs, stars, "stars")
    roots = components(near, "near")
    copies = rows.where("doc_id IS NOT NULL AND n > 0").join(classes.where("rows > 1").select(*kind, "first"), kind).where("doc_id <> first")
    marks = stored(
        roots.select(F.col("node").alias("doc"), "root", F.lit(False).alias("skip"))
        .union(copies.select("doc_id", F.col("first"), F.lit(True))).groupBy("doc").agg(F.min("root").alias("root"), F.min("skip").alias("skip")), "marks",
    )
    more = compared(docs, product_pairs(docs, marks, frequent), "product")
    if more.take(1):
        roots = components(near.union(more), "linked")
    first = rows.join(classes.where("rows > 1").select(*kind, "first"), kind, "left").withColumn("first", F.coalesce("first", "doc_id"))
    return first.join(roots, F.col("first") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "first").alias("component_id")
    )
