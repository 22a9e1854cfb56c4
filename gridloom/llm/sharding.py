"""Sharding along a Hilbert curve.

Language, source and size are quantised to `BITS` bits each (the names by hash, the size by logarithm), the
cell of each document gets its place on the Hilbert curve, and the order along the curve is cut into runs of
equal counts (law ``rows``). Files written from such shards have narrow ranges in every one of the
dimensions, so filters on any of them skip files. Equal texts take the metadata of their first row, so
copies lie side by side and share a shard unless a cut falls between them.

Only narrow rows are ordered: keys, sizes and hashes. They are range-partitioned by (place, text hash, key),
so a cell or a text that holds a third of all rows still spreads over many tasks, and each task adds the
number of rows before it. Null texts have size 1; null names take level 0; repeated rows each get a slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, stored
from gridloom.llm.hilbert import hilbert_index

BITS = 5
SHARDS = 8


def curve_places(keyed: DataFrame) -> DataFrame:
    """Adds ``place``, the index on the curve of (lang, source, size)."""

    @F.pandas_udf("long")
    def place(lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.Series:
        cells = np.stack([lang.to_numpy(np.int64), source.to_numpy(np.int64), size.to_numpy(np.int64)], axis=1)
        return pd.Series(hilbert_index(cells, BITS).astype(np.int64))

    def level(name: str):
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(name), F.lit(1 << BITS))).cast("long")

    steps = F.least(F.floor(F.log2(F.col("size").cast("double")) * 1.5), F.lit((1 << BITS) - 1)).cast("long")
    return keyed.withColumn("place", place(level("lang"), level("source"), steps))


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = stored(
        docs.select(
            "doc_id", (F.octet_length(bytes_of).cast("long") + 1).alias("size"), F.crc32(bytes_of).alias("text_crc32"),
            F.xxhash64("text").alias("hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        ), "shard-keys",
    )
    text = ["hash", "text_crc32", "size"]
    first = narrow.groupBy(*text).agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"), F.count("*").alias("n"))
    copied = first.where("n > 1").select(*text, F.col("first.lang").alias("first_lang"), F.col("first.source").alias("first_source"), F.lit(True).alias("copied"))
    alike = narrow.join(copied, text, "left").select(
        "doc_id", *text, *[F.when(F.col("copied"), F.col(f"first_{c}")).otherwise(F.col(c)).alias(c) for c in ("lang", "source")]
    )
    key = [*("place", "hash"), "doc_id"]
    ranged = curve_places(alike).repartitionByRange(partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    listed = stored(
        ranged.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")),
        "shard-order",
    )
    listed = listed.withColumn("line", F.col("line").bitwiseAND((1 << 33) - 1))
    # one row per task
    parts = listed.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    ranked = listed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("line"))
    shard = F.expr(f"(rank * {count}) DIV total")
    # the first rank of shard s is ceil(s * total / count)
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * total + {count - 1}) DIV {count}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
