"""What the operators of this folder share: stored tables, batches, memos, folds."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch_path

BATCH_ROWS = 500
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 256  # an entry of a short key and value, with its slot


def small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python in small batches, so long texts don't add up."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: later jobs survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def draw(key: str, salt: str) -> Column:
    """A repeatable number from 0 to 1 for each key."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Memo(dict):
    """Function with a memory that takes no more when it holds ``most`` bytes, so it is bounded whatever comes, and
    no result depends on it."""

    def __init__(self, function, most: int = MEMO_BYTES):
        super().__init__()
        self.function, self.room = function, most

    def __missing__(self, key):
        value = self.function(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.room > 0 and len(key) < 64:
            self[key] = value
            self.room -= ENTRY_BYTES


def release(collect: bool = True) -> None:
    """Hand freed memory back to the system: Spark uses a Python worker again for the stages that follow."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than that of GNU
        ctypes.CDLL(None).malloc_trim(0)


def freed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches, after which the worker keeps no memory that it has freed."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        release(collect=False)

    return run


BLOCK_BYTES = 1 << 20
_BASE, _UNDO = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: A-Z count as a-z, and all ASCII white space as one blank.
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_powers = {base: np.ones(1, dtype=np.uint64) for base in (_BASE, _UNDO)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; short ones are kept, 16 MB for a base at most."""
    if len(_powers[base]) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length() if n <= 2 * BLOCK_BYTES else n, base, dtype=np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if n > 2 * BLOCK_BYTES:
            return made
        _powers[base] = made
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _hashed(parts: list[bytes]) -> list[np.ndarray]:
    words = [part.translate(_FOLDED).split() for part in parts]
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return np.split(h[coded.indices.to_numpy()], np.cumsum([len(w) for w in words])[:-1])


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of its words, in order: runs without ASCII white space, A-Z as a-z."""
    block, size = [], 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size >= BLOCK_BYTES:
            yield from _hashed(block)
            block, size = [], 0
    if block:
        yield from _hashed(block)
