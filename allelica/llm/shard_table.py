"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size: it starts at one slot and
steps by a fixed skip. The shards take turns; in its turn a shard claims the first slot of its
permutation that is still free. A row's slot is its key's hash modulo the table size, and the slot
names the shard. When a shard leaves, the others keep almost all their slots.

The table has ``size`` rows whatever the input, so it is broadcast up to ``MAX_BROADCAST`` rows: its size bound
is the parameter. Placing rows is a map-side join without a shuffle; a hot key costs no more than any other
rows. A larger table is joined as Spark chooses.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.llm.common import free_name

MAX_BROADCAST = 1_000_003
N_SHARDS, SIZE = 64, 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int) -> np.ndarray:
    """Slot -> index into ``shards``. Each shard gets size/len(shards) slots, give or take one."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("table size must be a prime, and no less than the number of shards")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    taken = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for k in range(len(shards)):
            while taken[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            taken[at[k]] = k
            free -= 1
            if not free:
                break
    return taken


def lookup_frame(spark: SparkSession, shards: list[str], size: int, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    slots = fill_table(shards, size)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(slots)], f"`{names[0]}` int, `{names[1]}` int")


def slot_of(key: Column, size: int) -> Column:
    """60 bits of the key's MD5 modulo the table size. A null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", n_shards: int = N_SHARDS, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` with ``slot`` and ``shard``, both int.

    Every row gets a shard: rows with a null key all go to the shard of the empty string, repeated keys
    go together, texts are not read. An empty table gives an empty result. Columns of these names that
    ``docs`` already has are replaced.
    """
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    lookup = lookup_frame(docs.sparkSession, [f"shard-{i:05d}" for i in range(n_shards)], size, (slot, shard))
    rows = docs.withColumn(slot, slot_of(F.col(key), size)).join(F.broadcast(lookup) if size <= MAX_BROADCAST else lookup, slot, "left")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")]
    return rows.select(*kept, F.col(slot).alias("slot"), F.col(shard).alias("shard"))


#: Rows of a file of a shard, about, and bytes of a writer's row group.
FILE_ROWS, GROUP_BYTES = 200_000, 16 << 20


def write_shards(placed: DataFrame, path: str, n_shards: int = N_SHARDS, file_rows: int = FILE_ROWS) -> None:
    """One folder per shard that has rows, none for an empty table, in files of about ``file_rows`` rows.

    Each shard is dealt to as many writers as its share of the rows asks for by the hash of its rows' keys and places,
    so no task holds a whole shard of a large table; a task sorts its rows by shard and has one file open at a time.
    Nulls, repeated rows and further columns are written as they are.
    """
    splits = max(1, -(-placed.count() // (n_shards * file_rows)))
    cells = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns if c != "shard"]), F.lit(splits))
    dealt = placed.repartition(n_shards * splits, "shard", cells)
    dealt.write.option("parquet.block.size", GROUP_BYTES).partitionBy("shard").parquet(path)
