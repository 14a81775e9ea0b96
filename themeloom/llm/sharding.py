"""Shards of near equal bytes by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import documents, text_bytes
from themeloom.session import cut_lineage

SHARDS = 24
UNITS = 256
"""Units of a shard: what is packed is about a shard's size through this, so that the driver packs a fixed number of items."""
TOGETHER = 8
"""A group of equal texts larger than a shard's size through this is placed in several parts."""


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Places items (rows; columns bytes, tokens, rows), large ones first, and returns the shard of each.

    Each goes to the shard whose residual capacity has the highest dot product with it, among those that still have room
    for its bytes; where none has, to the shard with the fewest bytes. Ties go to the smaller shard.
    """
    share = sizes / np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    residual = np.ones((shards, sizes.shape[1]))
    placed = np.zeros(len(sizes), np.int64)
    for item in np.lexsort((np.arange(len(sizes)), -share.max(axis=1), -share[:, 0])):
        vector = share[item]
        room = residual[:, 0] >= vector[0] - 1e-9
        best = np.argmax(np.where(room, residual @ vector, -np.inf)) if room.any() else np.argmax(residual[:, 0])
        residual[best] -= vector
        placed[item] = best
    return placed


def shard(df: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df`` with its shard and its place there: id, size, tokens, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8; tokens are counted as runs between white space. Rows of equal text (null
    and empty are equal) form a group. Small groups are hashed into units, large ones are cut into pieces by the hash of
    the id, pieces of one group stay together up to a shard's size through ``TOGETHER``. Units and parts of groups are
    packed by ``pack``: about ``shards * UNITS`` items whatever the input, so that is all the driver sees. Slots run from
    0 without gaps in each shard: a base for each unit or piece, and the position within it by id; repeated rows and null
    ids get slots of their own. An empty table gives an empty table.
    """
    spark, column = df.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(df.select(
        F.col(id), (F.length(text_bytes(text)) + 8).cast("long").alias("size"),
        F.when(F.trim(column) == "", 0).otherwise(F.length(column) - F.length(F.translate(column, " \t\n\r", "")) + 1).cast("long").alias("tokens"),
        F.crc32(text_bytes(text)).alias("text_crc32"), F.unhex(F.md5(text_bytes(text))).alias("__group"),
    ))
    groups = rows.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bytes_all, rows_all = rows.agg(F.sum("size"), F.count("*")).first()
    unit_bytes, unit_rows = max(1, (bytes_all or 0) // (shards * UNITS)), max(1, rows_all // (shards * UNITS))
    # At most twice shards * UNITS groups can be larger than a unit: a bounded table, sent to every task.
    large = groups.where((F.col("rows") > 1) & ((F.col("bytes") > unit_bytes) | (F.col("rows") > unit_rows))).select(
        F.col("__group"), F.col("bytes").alias("__bytes"),
        F.least(F.col("rows"), F.ceil(F.greatest(F.col("bytes") / unit_bytes, F.col("rows") / unit_rows))).alias("__pieces"),
    )
    item = F.struct(
        F.when(F.col("__pieces").isNull(), F.pmod(F.xxhash64("__group"), F.lit(shards * UNITS))).alias("unit"),
        F.when(F.col("__pieces").isNotNull(), F.col("__group")).alias("group"),
        F.pmod(F.xxhash64(F.col(id)), F.col("__pieces")).alias("piece"),
    )
    rows = rows.join(F.broadcast(large), "__group", "left").withColumn("__item", item)
    items = rows.groupBy("__item").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("__bytes").alias("group_bytes"),
    ).orderBy("__item").collect()
    part_of, parts, together = [], {}, max(1.0, (bytes_all or 0) / shards / TOGETHER)
    filled: dict[bytes, list] = {}
    for entry in items:
        if entry["__item"].group is None:
            key = (entry["__item"].unit, None, 0)
        else:
            state = filled.setdefault(entry["__item"].group, [0, 0.0])
            if state[1] and state[1] + entry.bytes > together:
                state[:] = [state[0] + 1, 0.0]
            state[1] += entry.bytes
            key = (None, bytes(entry["__item"].group), state[0])
        part_of.append(parts.setdefault(key, len(parts)))
    sizes = np.zeros((len(parts), 3))
    for part, entry in zip(part_of, items):
        sizes[part] += (entry.bytes, entry.tokens, entry.rows)
    placed, used, placements = pack(sizes, shards), [0] * shards, []
    for part, entry in zip(part_of, items):
        target = int(placed[part])
        placements.append((entry["__item"], target, used[target]))
        used[target] += entry.rows
    schema = spark.createDataFrame([], rows.select("__item").schema).select("__item", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("__base")).schema
    placement = spark.createDataFrame(placements, schema)
    order = Window.partitionBy("__item").orderBy(id, "text_crc32")
    numbered = rows.withColumn("__at", F.row_number().over(order))
    return numbered.join(F.broadcast(placement), numbered["__item"].eqNullSafe(placement["__item"])).select(
        id, "size", "tokens", "text_crc32", "shard", (F.col("__base") + F.col("__at") - 1).alias("slot"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents``; null texts count as empty, null and repeated ids get slots of their own (see ``shard``)."""
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
