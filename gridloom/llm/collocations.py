"""Phrase collocations from count streams, in the layout of external stream estimation.

1. Words are counted per language; only those seen ``LEAST`` times can be part of a candidate.
2. Pairs of such words that stand together are counted. Every place where frequent pairs follow each other gives
   one window of three to ``LONGEST`` words, as far as its pairs are frequent. Windows are sorted; in that order all windows that begin with a phrase stand together, so one sweep with a stack
   counts every longer phrase. Phrases that run over a border of the sort are added up.
3. The counts of all frequent phrases are laid out twice. In prefix order (by first word, second word ..) a
   phrase follows its beginnings, so a sweep hands down the counts of its first parts and hands up the
   largest count of an extension to the right. In suffix order (by last word, last but one ..) the same sweep
   gives the counts of the rests and of the largest extension to the left.
4. Both streams meet in a merge join by phrase, which scores the cuts.

Phrases are ordered by their bytes with 0 between words (0 and 1 inside words are escaped), so the order of
keys is the order of word sequences. Borders come from a sample of the keys; a phrase whose extensions
reach over borders goes to every range it touches, so no range needs more than its own rows and no first or
last word gathers its phrases in one task. The windows of step 2 leave out rare words and pairs by two bit sets
of fixed size (``BITS``), filled from hashes; what is rare and meets the bit of something frequent only costs a
few more windows. Counts of phrases never depend on hashes.

Nothing is sampled but borders: counts cover all texts, phrases and languages. A null text is empty; a null
language counts as ``und``; repeated rows count again. Extra columns do not pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import mixed, partitions, small_batches, stored
from gridloom.operators.joins import lookup

LEAST, LONGEST, TOP, PARTS = 100, 5, 2000, 32
UNKNOWN = "und"
CHUNK_WORDS, FLUSH_WORDS, FLUSH_DISTINCT = 1 << 18, 1 << 21, 1 << 20  # bound what a task holds
BITS = 1 << 26  # of the set of frequent words: 8 MiB however many there are
_PART = 1 << 19  # bits that one row of it holds
BREAK = b"\xff"  # never part of UTF-8
_CLASSES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9
)


def _words(text: bytes) -> list[bytes]:
    """Words of a text, with BREAK between pieces."""
    data = text.translate(_CLASSES)
    if 0 in data or 1 in data:
        data = data.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return data.replace(b"\n", b" \xff ").split()


class _Block:
    """Words of one language as numbers; number 0 stands for BREAK."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {BREAK: 0}
        self.ids: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.open: list[bytes] = []
        self.size = 1

    def add(self, words: list[bytes]) -> None:
        self.open += words
        self.open.append(BREAK)
        self.size += len(words) + 1
        if len(self.open) > CHUNK_WORDS:
            self.number()

    def number(self) -> None:
        coded = pa.array(self.open, pa.binary()).dictionary_encode()
        own = coded.dictionary.to_pylist()
        table = np.fromiter((self.words.setdefault(w, len(self.words)) for w in own), np.int32, len(own))
        self.ids.append(table[coded.indices.to_numpy()])
        self.open = []


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Blocks of some FLUSH_WORDS words: language, word numbers, words."""
    blocks: dict[str, _Block] = {}

    def taken(lang: str) -> tuple[str, np.ndarray, list[bytes]]:
        block = blocks.pop(lang)
        if block.open:
            block.number()
        return lang, np.concatenate(block.ids), list(block.words)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                block = blocks.setdefault(lang, _Block())
                block.add(_words(text))
                if len(block.words) > FLUSH_DISTINCT:
                    yield taken(lang)
        while sum(b.size for b in blocks.values()) > FLUSH_WORDS:
            yield taken(max(blocks, key=lambda k: blocks[k].size))
    for lang in list(blocks):
        yield taken(lang)


def _rows(lang: str, words: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(words), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.record_batch([langs, pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "key", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; the total of a language goes under the empty word."""
    for lang, ids, words in _encoded(batches):
        n = np.bincount(ids, minlength=len(words))
        n[0] = n[1:].sum()
        yield _rows(lang, [b"", *words[1:]], n)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, group in batch.to_pandas().groupby("lang"):
            yield pa.record_batch([pa.array(_hashes(lang, group["key"].tolist()).view(np.int64))], ["h"])


def _pair_hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, group in batch.to_pandas().groupby("lang"):
            first, second = zip(*(key.split(b"\0") for key in group["key"]))
            both = _mixed_pair(_hashes(lang, list(first)), _hashes(lang, list(second)))
            yield pa.record_batch([pa.array(both.view(np.int64))], ["h"])


def _mixed_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the bit set that this task's hashes set: at most BITS / _PART rows."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        bits = batch.column(0).to_numpy().view(np.uint64) & np.uint64(BITS - 1)
        bits = np.sort(bits.astype(np.int64))
        for own in np.split(bits, np.flatnonzero(np.diff(bits // _PART)) + 1):
            if len(own):
                held = parts.setdefault(int(own[0] // _PART), np.zeros(_PART // 8, np.uint8))
                np.bitwise_or.at(held, own % _PART >> 3, (1 << (own & 7)).astype(np.uint8))
    if parts:
        yield pa.record_batch(
            [pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "bits"]
        )


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(*(batch.column(k).to_pylist() for k in range(2))):
            held = parts.setdefault(part, np.zeros(_PART // 8, np.uint8))
            held |= np.frombuffer(bits, np.uint8)
    if parts:
        yield pa.record_batch(
            [pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "bits"]
        )


def _bit_set(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes ``h``; BITS / 8 bytes come to the driver, however many there are."""
    kind = "part long, bits binary"
    parts = hashes.mapInArrow(_bit_rows, kind).repartition("part").mapInArrow(_joined_parts, kind)
    out = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = row["part"] * _PART // 8
        out[at : at + _PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _pair_counts(frequent) -> Callable:
    """Neighbouring frequent words and how often a block of this task has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _encoded(batches):
            known = _is_set(frequent.value, _hashes(lang, words))
            known[0] = False
            beside = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
            pairs, n = np.unique(ids[beside] * np.int64(len(words)) + ids[beside + 1], return_counts=True)
            for at in range(0, len(pairs), 200_000):
                first, second = (x.tolist() for x in np.divmod(pairs[at : at + 200_000], len(words)))
                yield _rows(lang, [words[i] + b"\0" + words[k] for i, k in zip(first, second)], n[at : at + 200_000])

    return run


def _windows(frequent, pairs) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _encoded(batches):
            hashes = _hashes(lang, words)
            known = _is_set(frequent.value, hashes)
            known[0] = False
            beside = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
            joined = np.zeros(len(ids), bool)  # is this word and the next one a frequent pair?
            joined[beside[_is_set(pairs.value, _mixed_pair(hashes[ids[beside]], hashes[ids[beside + 1]]))]] = True
            # words from every place to the end of its run of frequent pairs
            here = np.where(joined, np.int64(len(ids)), np.arange(len(ids)))
            length = np.minimum(np.minimum.accumulate(here[::-1])[::-1] - np.arange(len(ids)) + 1, LONGEST)
            place = np.flatnonzero(length > 2)
            if not len(place):
                continue
            window = np.full((len(place), LONGEST), 0, np.int64)  # 0 is BREAK: nothing there
            for k in range(LONGEST):
                inside = length[place] > k
                window[inside, k] = ids[place[inside] + k]
            # sorted as three numbers; a product of two word numbers stays below 2 ** 62
            v = len(words)
            keys = (window[:, 4], window[:, 2] * v + window[:, 3], window[:, 0] * v + window[:, 1])
            order = np.lexsort(keys)
            changed = np.zeros(len(order) - 1, bool)
            for key in keys:
                changed |= key[order[1:]] != key[order[:-1]]
            starts = np.flatnonzero(np.r_[True, changed])
            n = np.diff(np.r_[starts, len(order)])
            for some in range(0, len(starts), 100_000):
                part = starts[some : some + 100_000]
                rows = window[order[part]].tolist()
                yield _rows(lang, [b"\0".join([words[i] for i in row if i]) for row in rows], n[some : some + 100_000])

    return run


def _phrase_counts(least: int) -> Callable:
    """Windows sorted by (lang, key) -> phrases of three words or more that are frequent in this range, and those
    whose windows may go on in the ranges beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        lang, open_words, counts = None, [], []
        first: list | None = None  # of the first row: its beginnings may have begun in the range before

        def close(keep: int, edge: bool = False) -> None:
            while len(open_words) > keep:
                n, size = counts[-1], len(open_words)
                if size > 2 and (n >= least or edge or (first[0] == lang and first[1][:size] == open_words)):
                    out[0].append(lang)
                    out[1].append(b"\0".join(open_words))
                    out[2].append(n)
                open_words.pop()
                counts.pop()
                if open_words:
                    counts[-1] += n

        for batch in batches:
            for its_lang, key, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = key.split(b"\0")
                if first is None:
                    first = [its_lang, words]
                shared = 0
                if its_lang == lang:
                    for a, b in zip(words, open_words):
                        if a != b:
                            break
                        shared += 1
                if shared < len(open_words):
                    close(shared)
                lang = its_lang
                for word in words[shared:]:
                    open_words.append(word)
                    counts.append(0)
                counts[-1] += n
            if len(out[0]) > 10_000:
                yield _count_rows(out)
                out = ([], [], [])
        close(0, edge=True)
        if out[0]:
            yield _count_rows(out)

    return run


def _count_rows(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["lang", "key", "n"]
    )


def counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, key, n)`` of all phrases of 1 to LONGEST words with ``n >= least``, and ``(lang, n)`` of all words."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where(F.length("text") > 0)
    kind = "lang string, key binary, n long"
    words = texts.mapInArrow(_word_counts, kind).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = stored(words.where((F.col("n") >= least) | (F.octet_length("key") == 0)), "words")
    frequent = words.where(F.octet_length("key") > 0)
    bits = spark.sparkContext.broadcast(_bit_set(frequent.select("lang", "key").mapInArrow(_word_hashes, "h long")))
    pairs = texts.mapInArrow(_pair_counts(bits), kind).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.where(F.col("n") >= least), "pairs")
    pair_bits = spark.sparkContext.broadcast(_bit_set(pairs.select("lang", "key").mapInArrow(_pair_hash_rows, "h long")))
    windows = stored(texts.mapInArrow(_windows(bits, pair_bits), kind), "windows")
    swept = windows.repartitionByRange(partitions(spark), "lang", "key").sortWithinPartitions("lang", "key").mapInArrow(_phrase_counts(least), kind)
    longer = swept.groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(frequent.unionByName(pairs).unionByName(longer), "phrases"), words.where(F.octet_length("key") == 0).select("lang", "n")


def _ranges(rows: DataFrame) -> list[tuple[str, bytes]]:
    """Borders between ranges of about equal size, from a sample of some keys per range."""
    n, total = partitions(rows.sparkSession), rows.count()
    share = min(1.0, 64 * n / max(total, 1))
    keys = rows.where(F.pmod(F.xxhash64("lang", "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", "key").collect()
    keys = sorted((r["lang"].encode(), bytes(r["key"])) for r in keys)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def _dealt(borders: list[tuple[bytes, bytes]]) -> Callable:
    """Each phrase goes to its range, and its copy to those that its extensions reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        for batch in batches:
            lang, key, n, at, own = [], [], [], [], []
            for its_lang, its_key, count in zip(batch["lang"], batch["key"], batch["n"]):
                low = bisect_right(borders, (its_lang.encode(), its_key))
                high = bisect_right(borders, (its_lang.encode(), its_key + b"\x01"))  # above every extension
                for k in range(low, high + 1):
                    lang.append(its_lang)
                    key.append(its_key)
                    n.append(count)
                    at.append(k)
                    own.append(k == low)
            yield pd.DataFrame({"lang": lang, "key": key, "n": n, "at": at, "own": own})

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases in order -> counts of their beginnings, and the largest count of an extension by one word."""
    out: list[list] = [[] for _ in range(4)]
    place, stack = None, []  # open phrases: words, count, is it this range's own, largest extension

    def close(keep: int) -> None:
        while len(stack) > keep:
            words, n, own, most = stack.pop()
            row = (place[0], b"\0".join(words), [x[1] for x in stack] if own else None, most)
            for column, value in zip(out, row):
                column.append(value)

    for batch in batches:
        for at, lang, key, n, own in zip(*(batch.column(k).to_pylist() for k in range(5))):
            words = key.split(b"\0")
            keep = 0
            if place == (lang, at):
                keep = next((k for k, x in enumerate(stack) if x[0] != words[: k + 1]), len(stack))
            close(keep)
            place = (lang, at)
            if stack:
                stack[-1][3] = max(stack[-1][3], n)
            stack.append([words, n, own, 0])
        if len(out[0]) > 10_000:
            yield _neighbour_rows(out)
            out = [[] for _ in range(4)]
    close(0)
    if out[0]:
        yield _neighbour_rows(out)


def _neighbour_rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], ["lang", "key", "parts", "most"])


def turned(key: str) -> Column:
    """The key with its words from last to first."""
    words = F.split(F.col(key).cast("string"), "\\x00")
    return F.array_join(F.reverse(words), "\x00").cast("binary").alias(key)


def stream(phrases: DataFrame) -> DataFrame:
    """Sweep of phrases in the order of their keys: ``lang, key, parts, most``."""
    dealt = phrases.select("lang", "key", "n").mapInPandas(_dealt(_ranges(phrases)), "lang string, key binary, n long, at long, own boolean")
    ordered = dealt.select("at", "lang", "key", "n", "own").repartition("at").sortWithinPartitions("at", "lang", "key")
    swept = ordered.mapInArrow(_neighbours, "lang string, key binary, parts array<long>, most long")
    return swept.groupBy("lang", "key").agg(F.max("parts").alias("parts"), F.max("most").alias("most"))


def _text(key: Column) -> Column:
    """Words joined by a space, escapes undone."""
    text = F.replace(key.cast("string"), F.lit("\x00"), F.lit(" "))
    return F.replace(F.replace(text, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the cut of the lowest score, without those that a longer one contains as often."""
    longer = phrases.where(F.instr(F.col("key").cast("string"), "\x00") > 0)
    left = stream(phrases).where("size(parts) > 0").select("lang", "key", F.col("parts").alias("_l"), F.col("most").alias("_right"))
    back = stream(phrases.select("lang", turned("key"), "n")).where("size(parts) > 0")
    back = back.select("lang", turned("key"), F.reverse("parts").alias("_r"), F.col("most").alias("_left"))
    both = longer.select("lang", "key", F.col("n").alias("a")).hint("merge").join(left.hint("merge"), ["lang", "key"]).join(back.hint("merge"), ["lang", "key"])
    free = lookup(both.where("_right < a AND _left < a"), totals, ["lang"])
    # _l has the counts of the first 1, 2 .. words, _r those of what follows them
    wide = lambda c: c.cast("decimal(18,0)")
    cuts = F.transform(F.arrays_zip("_l", "_r"), lambda x, k: F.struct(
        (F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col("n"))).alias("up"), (wide(x["_l"]) * wide(x["_r"])).alias("down"),
        k.alias("k"), x["_l"].alias("l"), x["_r"].alias("r"),
    ))
    # whole-number division of decimals: exact beyond 64 bits
    rows = free.withColumn("_cuts", cuts).withColumn("_cut", F.expr(
        "array_min(transform(_cuts, c -> struct(c.up div c.down AS score, c.k AS k, c.l AS l, c.r AS r)))"
    ))
    return rows.select("lang", _text(F.col("key")).alias("phrase"), "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of every language."""
    found = scored(*counts(documents, least))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that the last step sees PARTS * top rows at most.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for group in ([F.col("lang"), part], [F.col("lang")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
    ranked = found
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
