"""Conversation prefix trie by burst tries: suffix containers under trie heads, burst, sorted and swept.

A conversation is the sequence of its turn ids (16 bytes of the SHA-256 of role and text), held as one binary
value of 16 bytes a turn; texts are not moved. Equal sequences are one row with their number, so a group of
copies of any size is one suffix. At first one container under the root holds all sequences. Containers of
more than ``BURST`` turns burst: what all their sequences share becomes a chain of trie heads, and the next
turn id deals the rest into new containers. The remaining containers are sorted and swept, many in one task:
a stack holds the open nodes of the current sequence, and a node is written when its parent closes. Totals
of containers are then added up to the heads above them. A container that holds one sequence never bursts,
so every burst deals a container into at least two, and no task or row but that of one conversation grows
with a group.

Turns are ordered by number (null first), then role, the first 64 characters of the text and turn id. Null
role and text count as empty; rows without conv_id belong to no conversation and are left out. Equal rows
count as turns of their own. Extra columns do not pass. An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.operators.joins import lookup

ID = 16  # bytes of a turn id
BURST = 200_000  # turns that a container may hold
SHARED, FAMILY = 4, 20  # how many first turns may come from the family's first conversation; its size
BLOB = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE_SHA = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """Per conversation its turns in order: ``turns`` as an array of (id, words)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    key = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"),
        F.left(text, F.lit(64)).alias("lead"), F.left(key, F.lit(2 * ID)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its family of 20."""
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    own = lists.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_family"), "turns", h.alias("_h"))
    firsts = lists.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_family"), F.slice("turns", 1, SHARED - 1).alias("_first")
    )
    none = F.slice("turns", 1, 0)
    lead = F.when(F.col("_h") > 0, F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h"))).otherwise(none)
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return own.join(firsts, "_family", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, words, conv_id) -> pieces of the joined ids of equal sequences."""
    kept: list = []
    size = 0
    for batch in batches:
        made = []
        for seq, words, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kept and (kept[0] != seq or size > BLOB):
                made.append(kept)
                kept, size = [], 0
            if not kept:
                kept = [seq, words, c, []]
            kept[3].append(str(c))
            size += len(kept[3][-1]) + 1
        if made:
            yield _blob_rows(made)
    if kept:
        yield _blob_rows([kept])


def _blob_rows(made: list) -> pa.RecordBatch:
    seq, words, c, ids = zip(*made)
    return pa.record_batch(
        [pa.array(seq, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(c, pa.int64()),
         pa.array(map(len, ids), pa.int64()), pa.array([",".join(x).encode() for x in ids], pa.binary())],
        ["seq", "words", "conv_id", "n", "blob"],
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (seq, first id) -> one row per distinct sequence."""
    kept = None
    for batch in batches:
        made = []
        for seq, words, c, n, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if kept and kept[0] == seq:
                kept[3] += n
                kept[4].update(b"," + blob)
                continue
            if kept:
                made.append(kept)
            kept = [seq, words, c, n, hashlib.sha256(blob)]
        if made:
            yield _distinct_rows(made)
    if kept:
        yield _distinct_rows([kept])


def _distinct_rows(made: list) -> pa.RecordBatch:
    seq, words, c, n, sha = zip(*made)
    return pa.record_batch(
        [pa.array(seq, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
         pa.array([x.hexdigest() for x in sha], pa.string())],
        ["seq", "words", "first", "n", "ends"],
    )


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """Equal sequences as one row: ``seq, words, first, n, ends``. The ids of a large group are joined in pieces
    by ranges of conv_id, spread over tasks; only the digest runs through the pieces in turn."""
    packed = stored(rows.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id",
    ), "conversations")
    pieces = packed.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _blobs, "seq binary, words array<long>, conv_id long, n long, blob binary"
    )
    one = pieces.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _hashed, "seq binary, words array<long>, first long, n long, ends string"
    )
    return stored(one, "sequences")


def _shared(low: Column, high: Column, least: Column) -> Column:
    """Number of turns with which both sequences begin; the first ``least`` are known to be equal."""
    turns = F.least(F.octet_length(low), F.octet_length(high)) / ID
    at = lambda x, i: F.substring(x, (i - 1) * ID + 1, F.lit(ID))
    further = F.when(turns > least, F.sequence(least + 1, turns.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(further, least, lambda n, i: F.when((n == i - 1) & (at(low, i) == at(high, i)), i).otherwise(n))


def _head(depth: Column) -> Column:
    """Name of the node that a sequence passes at a depth."""
    return F.left(F.sha2(F.substring(F.col("seq"), F.lit(1), depth * ID), 256), F.lit(2 * ID))


def burst(distinct: DataFrame, most: int = BURST) -> tuple[DataFrame, DataFrame | None]:
    """Containers ``(head, depth, up, path, seq, ..)`` and the heads above them, None if the root needed no burst.

    A round moves only rows of containers that are too large; there are at most rows / ``most`` of those.
    """
    open_rows = distinct.select(
        F.lit("").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"),
        F.array().cast("array<string>").alias("path"), "*",
    )
    closed, heads = [], []
    while True:
        turns = F.octet_length("seq") / ID
        large = (
            open_rows.groupBy("head")
            .agg(
                F.sum((turns - F.col("depth") + 1).cast("long")).alias("_turns"), F.count("*").alias("_rows"),
                F.min("seq").alias("_low"), F.max("seq").alias("_high"), F.sum("n").alias("_convs"),
                F.min("first").alias("_first"), F.first("depth").alias("_depth"), F.first("up").alias("_up"),
                F.first("path").alias("_path"), F.min_by("words", "seq").alias("_words"),
                F.min_by("ends", "seq").alias("_ends"),
            )
            .where((F.col("_turns") > most) & (F.col("_rows") > 1))
            .withColumn("_to", _shared(F.col("_low"), F.col("_high"), F.col("_depth")))
        )
        large = stored(large, "heads")
        if large.isEmpty():
            closed.append(open_rows)
            break
        heads.append(large.select(
            "head", F.col("_depth").alias("depth"), F.col("_to").alias("last"), F.col("_up").alias("up"),
            F.col("_path").alias("path"), F.col("_first").alias("first"), F.col("_convs").alias("n"),
            F.slice("_words", F.lit(1), F.col("_to")).alias("words"),
            # the smallest sequence is the shared part itself if any conversation ends there
            F.when(F.octet_length("_low") == F.col("_to") * ID, F.col("_ends")).otherwise(NONE_SHA).alias("ends"),
        ))
        marked = lookup(open_rows, large.select("head", "_to", "_first"), ["head"])
        closed.append(marked.where("_to IS NULL").drop("_to", "_first"))
        longer = marked.where(F.octet_length("seq") / ID > F.col("_to"))
        open_rows = stored(longer.select(
            _head(F.col("_to") + 1).alias("head"), (F.col("_to") + 1).alias("depth"), F.col("_first").alias("up"),
            F.concat("path", F.array("head")).alias("path"), "seq", "words", "first", "n", "ends",
        ), "containers")
    rows, above = closed[0], heads[0] if heads else None
    for more in closed[1:]:
        rows = rows.unionByName(more)
    for more in heads[1:]:
        above = above.unionByName(more)
    return rows, above


class _Open:
    """A node on the stack: what is known of it so far, and its closed children."""

    __slots__ = ("children", "convs", "done", "ends", "first", "leaves", "saved", "words")

    def __init__(self, words: int):
        self.first, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.words, self.ends, self.done = words, NONE_SHA, []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (head, seq) -> nodes; the top node of a container carries ``path``."""
    stack: list[_Open] = []
    head = top = up = path = last = None
    out: list[list] = [[] for _ in range(9)]

    def close() -> None:
        node = stack.pop()
        node.saved += (node.convs - 1) * node.words
        node.leaves = node.leaves or 1
        depth = top + len(stack)
        for child in node.done:
            _put(out, child, depth + 1, node.first, None)
        node.done = []
        if not stack:
            _put(out, node, depth, up, path)
            return
        parent = stack[-1]
        parent.done.append(node)
        parent.children += 1
        parent.convs += node.convs
        parent.leaves += node.leaves
        parent.saved += node.saved
        parent.first = node.first if parent.first is None else min(parent.first, node.first)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(9)]
        for its_head, depth, its_up, its_path, seq, words, first, n, ends in zip(*columns):
            ids = [seq[i : i + ID] for i in range(depth * ID, len(seq), ID)]
            shared = 0
            if its_head == head:
                for a, b in zip(ids, last):
                    if a != b:
                        break
                    shared += 1
                shared += 1  # the top node
            while len(stack) > shared:
                close()
            if not stack:
                head, top, up, path = its_head, depth, its_up, its_path
            last = ids
            while len(stack) <= len(ids):
                at = depth + len(stack)
                stack.append(_Open(words[at - 1] if at else 0))
            node = stack[-1]
            node.convs, node.ends = node.convs + n, ends
            node.first = first if node.first is None else min(node.first, first)
        if len(out[0]) > 5000:
            yield _node_rows(out)
            out = [[] for _ in range(9)]
    while stack:
        close()
    if out[0]:
        yield _node_rows(out)


def _put(out: list[list], node: _Open, depth: int, parent: int | None, path: list | None) -> None:
    row = (node.first, depth, parent, node.convs, node.children, node.leaves, node.saved, node.ends, path)
    for column, value in zip(out, row):
        column.append(value)


def _node_rows(out: list[list]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.string())]
    names = [*[x.split()[0] for x in NODE.split(", ")], "path"]
    return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names)


def nodes(distinct: DataFrame, most: int = BURST) -> DataFrame:
    """All nodes of the trie over distinct sequences."""
    containers, heads = burst(distinct, most)
    names = [x.split()[0] for x in NODE.split(", ")]
    order = ["head", "depth", "up", "path", "seq", "words", "first", "n", "ends"]
    swept = (
        containers.select(*order).repartition("head").sortWithinPartitions("head", "seq")
        .mapInArrow(_sweep, f"{NODE}, path array<string>")
    )
    if heads is None:
        return swept.select(*names)
    swept, heads = stored(swept, "swept"), stored(heads, "trie-heads")
    # What lies under a head: leaves and savings of containers (on their top rows) and of the chains of heads below.
    own = F.col("n") - 1
    chain = F.slice("words", F.greatest(F.col("depth"), F.lit(1)), F.col("last") - F.greatest(F.col("depth"), F.lit(1)) + 1)
    along = heads.withColumn("_saved", own * F.aggregate(chain, F.lit(0).cast("long"), lambda a, b: a + b))
    parts = swept.where("path IS NOT NULL").select("path", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")).unionByName(
        along.select("path", F.lit(0).cast("long").alias("l"), F.col("_saved").alias("s"))
    )
    below = parts.select(F.explode("path").alias("head"), "l", "s").groupBy("head").agg(F.sum("l").alias("_l"), F.sum("s").alias("_s"))
    beside = swept.where("path IS NOT NULL").select("path").unionByName(heads.select("path"))
    children = beside.where(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("head")).agg(F.count("*").alias("_c"))
    joined = heads.join(below, "head", "left").join(children, "head", "left")
    at = joined.withColumn("_at", F.explode(F.sequence("depth", "last")))
    begin = F.greatest(F.col("_at"), F.lit(1))
    rest = F.aggregate(
        F.when(F.col("last") >= begin, F.slice("words", begin, F.col("last") - begin + 1)).otherwise(F.slice("words", 1, 0)),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    upper = at.select(
        F.col("first").alias("conv_id"), F.col("_at").cast("long").alias("depth"),
        F.when(F.col("_at") == F.col("depth"), F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("_at") == F.col("last"), F.col("_c")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("_l").alias("n_leaves"), (own * rest + F.col("_s")).alias("saved_tokens"),
        F.when(F.col("_at") == F.col("last"), F.col("ends")).otherwise(NONE_SHA).alias("ends_sha256"),
    )
    return swept.select(*names).unionByName(upper)


def prefix_trie(conversations: DataFrame, most: int = BURST) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations."""
    return nodes(distinct_sequences(rebuilt(sequences(conversations))), most)
