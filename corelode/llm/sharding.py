"""Sharding: a keyed Feistel permutation over global row numbers, confined to [0, rows) by cycle walking.

Row number r goes to p = permute(r); its shard is p mod shards and its slot p div shards. Shard sizes differ by one row at
most, slots have no gaps, and either way is computable from r (or p) alone. Row numbers follow (id, CRC-32, size, text
hash): a range exchange of those few numbers, never of texts, then positions inside each range plus the ranges' offsets.

Defined results: a null text has size 1 and CRC 0; null ids come first; equal rows get different slots, which of them gets
which doesn't show; an empty table gives an empty result; other columns are ignored. A hot id is split, since the text's
hash and the row's place in the scan take part in the range bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import durable

ROUNDS = 4
# Odd multipliers of the round function, one a round.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
MASK = (1 << 32) - 1


def half_bits(rows: int) -> int:
    """Bits of either half of the smallest even-width domain that holds `rows` values."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def round_value(half: np.ndarray, k: int, seed: int) -> np.ndarray:
    """32 bits mixed from a half, the round and the seed."""
    x = ((half + np.uint64((seed + k) & MASK)) * np.uint64(MULTIPLIERS[k])) & np.uint64(MASK)
    x ^= x >> np.uint64(15)
    return (x * np.uint64(MULTIPLIERS[-1 - k]) & np.uint64(MASK)) >> np.uint64(7)


def _once(values: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = values >> b, values & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (round_value(left, k, seed) & mask), left
        else:
            left, right = right, left ^ (round_value(right, k, seed) & mask)
    return (left << b) | right


def permute(values: np.ndarray, rows: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of [0, rows) at `values`, or its inverse. A value that leaves the range walks on along its cycle,
    which comes back into the range, since it began there."""
    bits, out = half_bits(rows), _once(np.asarray(values, dtype=np.uint64), half_bits(rows), seed, back)
    while (far := out >= np.uint64(rows)).any():
        out[far] = _once(out[far], bits, seed, back)
    return out


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """df with `row_no` (0, 1, ... in `order`) and the number of rows. To the driver goes one count a partition."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie")
    d = durable(d.drop("__tie").withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__place"), 33)
    counts = sorted((r["p"], r["n"]) for r in d.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, rows in counts:
        offsets.append((p, total))
        total += rows
    at = spark.createDataFrame(offsets or [(0, 0)], "__part long, __offset long")
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.withColumn("__part", part).join(F.broadcast(at), "__part")  # a row for each partition
    return d.withColumn("row_no", F.col("__offset") + within).drop("__part", "__offset", "__place"), total


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> DataFrame:
    """(id, size, text_crc32, row_no, shard, slot) for each row of df."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    few = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    d, rows = numbered(few, ["id", "text_crc32", "size", "h"])

    def place(batches):
        for b in batches:
            p = permute(b.column("row_no").to_numpy(zero_copy_only=False), rows, seed).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names, "shard", "slot"])

    kind = df.schema[id_col].dataType.simpleString()
    out = d.select("id", "size", "text_crc32", "row_no").mapInArrow(place, f"id {kind}, size long, text_crc32 long, row_no long, shard int, slot long")
    return out.withColumnRenamed("id", id_col)


def locate(row_no: int, rows: int, shards: int = 8, seed: int = 20) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row_no]), rows, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, rows: int, shards: int = 8, seed: int = 20) -> int:
    """The row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), rows, seed, back=True)[0])
