"""Placement of keys on shards by a permutation-filled lookup table (built-in functions only on the rows).

The table has a prime number of slots. Every shard has its own order of preference over all slots (an offset and a
step, both from the md5 of its name); shards take turns, and a shard whose turn it is claims the first free slot
of its order. All shards end with the same number of slots, give or take one, and a shard that joins or leaves
moves few slots of the others. The table does not grow with the data, so it is broadcast, and a row costs one
hash and one lookup.

Cases: a null key is placed as the text 'null'. Equal keys (repeated rows, ties) always share a shard, and empty
tables stay empty. Other columns pass through; result names that clash are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
TABLE_SIZE = 16381  # a prime, over 100 slots per shard: loads differ by less than one percent
MAX_TABLE = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MAX_TABLE}")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    place = [int(d[:8], 16) % size for d in digests]
    step = [int(d[8:16], 16) % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table, taken = [-1] * size, 0
    while True:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            table[place[shard]] = shard
            taken += 1
            if taken == size:
                return table


def table_rows(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard): the filled table as rows, from one literal."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard")
    )


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(size)).cast("int")


def place(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot and shard (the shard's number)."""
    rows = table_rows(df.sparkSession, fill_table(shards, size))
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.withColumn("__slot", slot_of(key, size)).select(*[F.col(f"`{c}`") for c in kept], F.col("__slot").alias("slot"))
    return placed.join(F.broadcast(rows), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")  # <= MAX_TABLE rows


def placement_sql(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    table = fill_table(shards, size)
    return f"""
with s as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % {size})::int as slot from documents),
t as (select {table}::int[] as shards)
select doc_id, slot, shards[slot + 1] as shard from s, t
"""
