"""Sharding by longest-processing-time scheduling: groups that stay together go, by falling size, to the least loaded shard.

The law is `bytes`: shard sizes come out near equal. Equal texts form a group. A group of at least
1/(shards * items_per_shard) of all bytes is an item of its own; the smaller groups are dealt by
hash into that many items. So the heap sees at most 2 * shards * items_per_shard items, whatever
the input, and an item made of small groups holds about total/(shards * items_per_shard) bytes.

Defined cases: a null text has no bytes and crc32 0, and all null texts form one group; an empty text likewise
forms another; repeated rows each get a slot; an empty table gives an empty result; other columns are ignored.
Ties between loads go to the smaller shard, between sizes to the smaller item key.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.llm.common import settle

ROW_BYTES = 16
#: Rows of an item that are numbered in one task.
SLOT_ROWS = 1_000


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: (key, size) -> shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        out[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def shard_by_size(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", items_per_shard: int = 256) -> DataFrame:
    """Returns id_col, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    if shards < 1 or items_per_shard < 1:
        raise ValueError("shards and items_per_shard must be positive")
    spark = df.sparkSession
    text = F.col(text_col)
    rows = settle(df.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("__a"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("again"), text)).alias("__b"),
        F.monotonically_increasing_id().alias("__row"),  # written once, so the numbers stay
    ))
    groups = rows.groupBy("__a", "__b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    n_items = shards * items_per_shard
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    least = max(1, -(-total // n_items))
    small = F.concat(F.lit("s"), F.pmod("__a", F.lit(n_items)).cast("string"))
    key = F.when(F.col("bytes") >= least, F.concat_ws("_", F.lit("g"), F.hex("__a"), F.hex("__b"))).otherwise(small)
    # at most n_items large groups and n_items hashed items
    items = groups.groupBy(key.alias("item"), (F.col("bytes") >= least).alias("large")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min(F.when(F.col("bytes") >= least, F.col("__a"))).alias("__a"), F.min(F.when(F.col("bytes") >= least, F.col("__b"))).alias("__b")
    ).collect()
    placed = schedule([(r["item"], r["bytes"]) for r in items], shards)
    plan = spark.createDataFrame([(r["item"], placed[r["item"]], -(-r["n"] // SLOT_ROWS)) for r in items], "item string, shard int, salts long")
    large = spark.createDataFrame([(r["__a"], r["__b"], r["item"]) for r in items if r["large"]], "__a long, __b long, __large string")
    salt = F.pmod(F.xxhash64("__row"), F.col("salts"))
    dealt = (
        rows.join(F.broadcast(large), ["__a", "__b"], "left").withColumn("item", F.coalesce("__large", small))
        .join(F.broadcast(plan), "item").withColumn("salt", salt)
        .select(id_col, "size", "text_crc32", "item", "shard", "salt", "__row")
    )
    before = Window.partitionBy("shard").orderBy("item", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "item", "salt").agg(F.count("*").alias("n")).select("shard", "item", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("item", "salt").orderBy("__row"))
    return (
        dealt.withColumn("rank", rank).join(starts.drop("shard"), ["item", "salt"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
