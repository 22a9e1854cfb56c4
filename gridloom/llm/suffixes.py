"""Exact removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes when a `DEPTH`-byte string that covers it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. Everything is judged on the input.

1. Documents with equal texts: all but the first go as a whole, if they hold `DEPTH` bytes at all.
2. Every window of `DEPTH` bytes has an anchor, its `GRAM`-byte substring with the smallest hash, so equal
   windows have equal anchors. Neighbouring windows with one anchor form a piece of text. Pieces meet by anchor;
   of equal pieces only the first matters, all windows of the others start earlier elsewhere. A task
   settles its own equal pieces first, so a passage that everyone has is one row per task, not one per copy.
3. Where different pieces share an anchor, their bytes are fetched. In each block of anchors the pieces are
   dealt into shards, each shard gets its Burrows-Wheeler transform, and the transforms are merged by
   refining their interleave two symbols at a time. Rows still in one class after `DEPTH` symbols are
   the repeated intervals; all but the earliest place in a class start earlier elsewhere.
4. The starts found come together per document; the bytes they cover go.

Null texts count as empty. Repeated rows (same doc_id and text) do not remove each other. Rows without a
doc_id are returned whole and remove nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bwt import repeated
from gridloom.llm.common import _BASE, _UNDO, _power, freed, mixed, partitions, release, small_batches, stored

DEPTH, GRAM = 100, 40
GRAMS = DEPTH - GRAM + 1
PLACE_BITS = 20
HELD_PIECES = 1 << 20
#: Pieces that go through one merge at most; a larger block of anchors is merged anchor by anchor.
MERGE_BYTES = 1 << 24
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
_LETTER = np.random.RandomState(12).randint(1, 1 << 62, 256, dtype=np.uint64)
PIECE = np.dtype([("anchor", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "u1"), ("settled", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("count", "u1")])


def _encoded(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces_of(data: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of concatenated texts: first window, number of windows, hash of the anchor, hash of the bytes.

    ``owner_end`` has, for every byte, where its text ends. At most 2 ** PLACE_BITS bytes.
    """
    n = len(data)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if n < DEPTH:
        return none
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, n), out=sums[1:])
    undo = _power(_UNDO, n)
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * undo[: n - GRAM + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = gram & ~low | np.arange(len(gram), dtype=np.uint64)
    # smallest key of GRAMS in a row: running minima from both ends of blocks of that length
    pad = -len(key) % GRAMS
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, GRAMS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[: len(key)]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: len(key)]
    windows = n - DEPTH + 1
    anchor = (np.minimum(back[:windows], ahead[GRAMS - 1 : GRAMS - 1 + windows]) & low).astype(np.int64)
    valid = np.flatnonzero(np.arange(windows) + DEPTH <= owner_end[:windows])
    if not len(valid):
        return none
    a = anchor[valid]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)])
    count = np.diff(np.r_[first, len(valid)])
    start = valid[first]
    h = (sums[start + count + DEPTH - 1] - sums[start]) * undo[start]
    return start, count, gram[a[first]], mixed(h ^ (count * 64 + a[first] - start).astype(np.uint64) * np.uint64(_BASE))


def _blocks(docs: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into blocks of bounded size; a text too long for one is cut with an overlap."""
    most, held, size = 1 << PLACE_BITS, [], 0
    for doc, data in docs:
        for at in range(0, max(1, len(data) - DEPTH + 1), most - DEPTH):
            part = data[at : at + most - 1] if len(data) >= most else data
            if size + len(part) > most:
                yield _block(held)
                held, size = [], 0
            held.append((doc, at, part))
            size += len(part)
            if len(data) < most:
                break
    if held:
        yield _block(held)


def _block(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, _, p in held], dtype=np.int64)
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(held)), sizes)
    doc, at = np.array([d for d, _, _ in held], dtype=np.int64), np.array([a for _, a, _ in held], dtype=np.int64)
    data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    return data, ends[which], doc[which], np.arange(len(data)) - (ends - sizes)[which] + at[which]


def settle(pieces: np.ndarray) -> np.ndarray:
    """Mark equal pieces that are not the first of their kind."""
    pieces = pieces[np.lexsort((pieces["settled"], pieces["start"], pieces["doc"], pieces["text"], pieces["anchor"]))]
    same = np.r_[False, (pieces["anchor"][1:] == pieces["anchor"][:-1]) & (pieces["text"][1:] == pieces["text"][:-1])]
    # the same place twice is one piece: a repeated row, or the overlap of a long text's cuts
    group = np.cumsum(~same) - 1
    starts = np.flatnonzero(~same)
    head = pieces[starts][group] if len(pieces) else pieces
    pieces["settled"] |= (same & ((pieces["doc"] != head["doc"]) | (pieces["start"] != head["start"]))).astype("u1")
    return pieces


def _dealt(block: np.ndarray, rows: np.ndarray, names: tuple[str, str], extra: dict) -> pd.DataFrame:
    order = np.argsort(block, kind="stable")
    ids, starts = np.unique(block[order], return_index=True)
    parts = np.split(rows[order], starts[1:]) if len(ids) else []
    return pd.DataFrame({names[0]: ids.astype(np.int32), names[1]: [p.tobytes() for p in parts], **extra})


def _block_of(values: np.ndarray, count: int) -> np.ndarray:
    return (mixed(values.astype(np.uint64)) >> np.uint64(17)) % np.uint64(count)


def found_starts(texts: DataFrame) -> DataFrame:
    """(doc, spans): per document the starts of windows that also start earlier; ``texts`` has doc, text."""
    spark = texts.sparkSession
    parts = partitions(spark)
    blocks = 4 * parts

    @freed
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            rows = settle(np.concatenate(held)) if held else np.empty(0, PIECE)
            return _dealt(_block_of(rows["anchor"], blocks), rows, ("block", "rows"), {})

        for batch in batches:
            for data, end, doc, place in _blocks([(int(d), _encoded(t)) for d, t in zip(batch["doc"], batch["text"])]):
                start, count, anchor, text = pieces_of(data, end)
                rows = np.zeros(len(start), PIECE)
                rows["anchor"], rows["text"], rows["count"] = anchor, text, count
                rows["doc"], rows["start"] = doc[start], place[start]
                held.append(rows)
                size += len(rows)
            if size >= HELD_PIECES:
                yield out()
                held, size = [], 0
        yield out()

    @freed
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _gathered(batches, "block", "rows", PIECE):
            rows = settle(rows)
            yield _spans(rows[rows["settled"] > 0], parts)
            rows = rows[rows["settled"] == 0]
            rows = rows[np.lexsort((rows["start"], rows["doc"], rows["text"], rows["anchor"]))]
            if len(rows):
                new = np.r_[True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["text"][1:] != rows["text"][:-1])]
                rows = rows[new]
                starts = np.flatnonzero(np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1]])
                sizes = np.diff(np.r_[starts, len(rows)])
                rows = rows[np.repeat(sizes > 1, sizes)]
                yield _dealt(_block_of(rows["doc"], parts), rows, ("part", "rows"), {"kind": 1})

    kinds = "part int, rows binary, kind int"
    met = stored(
        texts.mapInPandas(cut, "block int, rows binary").repartition(parts, "block").sortWithinPartitions("block").mapInPandas(meet, kinds),
        "pieces",
    )

    @freed
    def by_doc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _gathered(batches, "part", "rows", PIECE):
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            ids, starts = np.unique(rows["doc"], return_index=True)
            if len(ids):
                yield pd.DataFrame({"doc": ids, "wanted": [p.tobytes() for p in np.split(rows, starts[1:])]})

    wanted = stored(
        met.where("kind = 1").select("part", "rows").repartition(parts, "part").sortWithinPartitions("part").mapInPandas(by_doc, "doc long, wanted binary"),
        "wanted",
    )

    @freed
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[int, list[bytes]] = {}
            for text, blob in zip(batch["text"], batch["wanted"]):
                data, rows = _encoded(text), np.frombuffer(blob, PIECE)
                for row, block in zip(rows, _block_of(rows["anchor"], blocks).tolist()):
                    at = int(row["start"])
                    held.setdefault(block, []).append(row.tobytes() + data[at : at + int(row["count"]) + DEPTH - 1])
            yield pd.DataFrame({"block": list(held), "rows": [b"".join(v) for v in held.values()]}).astype({"block": "int32"})

    @freed
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blob in _gathered(batches, "block", "rows", None):
            rows, strings = _unpacked(blob)
            order = np.argsort(rows["anchor"], kind="stable")
            borders = np.flatnonzero(np.r_[True, np.diff(rows["anchor"][order].astype(np.int64)) != 0])
            at, size = 0, 0
            for i, border in enumerate(borders):
                end = borders[i + 1] if i + 1 < len(borders) else len(order)
                size += sum(len(strings[j]) for j in order[border:end])
                if size >= MERGE_BYTES or end == len(order):
                    chosen = order[at:end]
                    yield _spans(_earlier(rows[chosen], [strings[j] for j in chosen]), parts)
                    at, size = end, 0

    fetched = _joined(texts, wanted, "wanted").select("text", "wanted").mapInPandas(fetch, "block int, rows binary")
    merged = fetched.repartition(parts, "block").sortWithinPartitions("block").mapInPandas(merge, kinds)

    @freed
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _gathered(batches, "part", "rows", SPAN):
            rows = np.unique(rows)
            ids, starts = np.unique(rows["doc"], return_index=True)
            if len(ids):
                yield pd.DataFrame({"doc": ids, "spans": [_joined_spans(p) for p in np.split(rows, starts[1:])]})

    spans = met.where("kind = 0").union(merged).select("part", "rows").repartition(parts, "part").sortWithinPartitions("part")
    return stored(spans.mapInPandas(collect, "doc long, spans binary"), "spans")


def _gathered(batches: Iterator[pd.DataFrame], key: str, value: str, kind) -> Iterator:
    """Values of one key together; rows come sorted by key."""
    at, held = None, []
    for batch in batches:
        for k, v in zip(batch[key], batch[value]):
            if k != at and held:
                yield np.concatenate(held) if kind is not None else b"".join(held)
                held = []
            at = k
            held.append(np.frombuffer(v, kind).copy() if kind is not None else v)
    if held:
        yield np.concatenate(held) if kind is not None else b"".join(held)


def _spans(rows: np.ndarray, parts: int) -> pd.DataFrame:
    spans = np.empty(len(rows), SPAN)
    for name in SPAN.names:
        spans[name] = rows[name]
    return _dealt(_block_of(spans["doc"], parts), spans, ("part", "rows"), {"kind": 0})


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    rows, strings, at = [], [], 0
    while at < len(blob):
        row = np.frombuffer(blob, PIECE, 1, at)
        size = int(row["count"][0]) + DEPTH - 1
        rows.append(row)
        strings.append(blob[at + PIECE.itemsize : at + PIECE.itemsize + size])
        at += PIECE.itemsize + size
    return np.concatenate(rows), strings


def _earlier(rows: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Windows of the pieces that are not the earliest of their class."""
    group, string, offset = repeated(strings, DEPTH)
    doc, start = rows["doc"][string], rows["start"][string].astype(np.int64) + offset
    order = np.lexsort((start, doc, group))
    again = group[order][1:] == group[order][:-1]  # empty where no place has a twin in this block
    chosen = order[1:][again]
    out = np.empty(len(chosen), SPAN)
    out["doc"], out["start"], out["count"] = doc[chosen], start[chosen], 1
    return out


def _joined_spans(rows: np.ndarray) -> bytes:
    """Covered bytes as pairs (from, to), joined where they touch or overlap."""
    low = rows["start"].astype(np.int64)
    high = np.maximum.accumulate(low + rows["count"] + DEPTH - 1)
    new = np.r_[True, low[1:] > high[:-1]]
    last = np.r_[new[1:], True]
    return np.stack([low[new], high[last]], axis=1).astype("<u4").tobytes()


def _joined(texts: DataFrame, side: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Texts with a column per document; the side is broadcast only if it is small in rows and bytes."""
    size = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return texts.join(side, "doc", how)


def without_repeats(docs: DataFrame, decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``kept`` (bytes), ``n_bytes``, ``n_removed``, ``n_spans``.

    With ``decoded``, ``kept`` is text; a letter that a removal has cut in two is left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kind = ["h1", "h2", "size"]
    narrow = stored(
        texts.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.reverse("text")).alias("h2"), F.octet_length(body).alias("size"))
        .where(F.col("size") >= DEPTH), "texts",
    )
    first = narrow.groupBy(*kind).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select(*kind, "first")
    copies = stored(narrow.join(first, kind).where("doc <> first").select("doc").distinct().withColumn("copy", F.lit("1")), "copies")
    single = _joined(texts.where("doc IS NOT NULL"), copies, "copy", "left").where("copy IS NULL").select("doc", "text")
    spans = found_starts(single).withColumn("copy", F.lit(None).cast("string"))
    whole = copies.select("doc", F.lit(None).cast("binary").alias("spans"), "copy")
    marks = spans.unionByName(whole).groupBy("doc").agg(F.max("spans").alias("spans"), F.max("copy").alias("copy"))

    def remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, spans, copy in batches:
            out = []
            for t, s, c in zip(text, spans, copy):
                data = _encoded(t)
                pairs = np.frombuffer(s, "<u4").reshape(-1, 2) if isinstance(s, bytes) else np.empty((0, 2), "<u4")
                if isinstance(c, str) and len(data) >= DEPTH:
                    pairs = np.array([[0, len(data)]], "<u4")
                edges = [0, *pairs.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                whole = kept.decode("utf-8", "ignore") if decoded else kept
                out.append((whole, len(data), len(data) - len(kept), len(pairs)))
            yield pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])
        release(collect=False)

    # not "deterministic": else a filter on its numbers takes it apart into two calls, each in a worker of its own
    once = F.pandas_udf(remove, f"kept {'string' if decoded else 'binary'}, n_bytes long, n_removed long, n_spans long").asNondeterministic()
    marked = _joined(docs.withColumn("doc", F.col("doc_id").cast("long")), stored(marks, "removed"), "spans", "left")
    made = marked.withColumn("_made", once("text", "spans", "copy"))
    return made.select(*columns, *[F.col(f"_made.{c}").alias(c) for c in ("kept", "n_bytes", "n_removed", "n_spans")])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
