"""Document placement through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at
an offset and walks with a step, both hashed from its name. The shards take turns; each turn
claims the shard's next slot that is still free, until the table is full. Shards therefore own
equal numbers of slots (to within one), and adding or removing a shard moves few other slots.
A document's slot is its hash modulo the table size, so placement is one lookup in a broadcast
table whose size is a parameter and doesn't depend on the data. No row is shuffled.

Defined cases: a null doc_id has the slot of the null hash; rows that repeat a doc_id share its
shard; an empty table gives an empty result; further columns are dropped by `place` unless
named in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; about 256 slots a shard keep shares even to a fraction of a percent.
TABLE_SIZE = 65_537
#: The most slots a table may have, which bounds what is broadcast (8 bytes a slot).
MOST_SLOTS = 4_000_037
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8, person=salt.encode()).digest(), "little")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner (index into `shards`) of each slot."""
    if not _is_prime(size) or not len(set(shards)) == len(shards) <= size <= MOST_SLOTS or not shards:
        raise ValueError("the table size must be a prime no smaller than the number of distinct shards")
    position = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for i, skip in enumerate(step):
            at = position[i]
            while owner[at] >= 0:
                at = (at + skip) % size
            owner[at] = i
            position[i] = (at + skip) % size
            free -= 1
            if not free:
                return owner


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return slots.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (key, *keep, slot, shard)."""
    rows = docs.select(F.col(key), *[F.col(c) for c in keep if c not in (key, "slot", "shard")], slot_of(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, shards, size)), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write `docs` partitioned by shard; `files_per_shard` salts each shard over that many tasks."""
    placed = place(docs, shards, size, keep=[c for c in docs.columns if c != "doc_id"])
    salt = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
