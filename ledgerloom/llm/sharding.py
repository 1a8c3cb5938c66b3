"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order of preference
and the shards take turns claiming the next free slot. A key's slot is its digest
modulo the prime, so placement is one lookup. All shards own the same number of
slots (one more or less), and adding or removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import digest_number, keeps_names, table
from ledgerloom.llm.registry import query

#: Slots of the lookup table; prime, and over 100 slots for each shard. Also the
#: bound of what is broadcast: so many rows of two integers.
SLOTS = 6553
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The owner (index into ``shards``) of every slot."""
    if not 0 < len(set(shards)) == len(shards) <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct, at least one, and not more than the prime number of slots")
    offset = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, at, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
                at[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(digest_number(key, digits=12), F.lit(slots)).cast("int")


@keeps_names
def place(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` added (replacing columns of these names).

    Null keys all belong to the slot of the empty string; repeated keys share a
    slot. Nothing is shuffled: the table of ``slots`` rows is broadcast.
    """
    rows = [(i, shards[o]) for i, o in enumerate(lookup_table(shards, slots))]
    # one row for each slot: the size of what is broadcast is fixed by the parameter
    owners = df.sparkSession.createDataFrame(rows, "_slot int, _shard string")
    keyed = df.withColumn("_key_slot", slot_of(F.coalesce(key.cast("string"), F.lit("")), slots))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    joined = keyed.join(F.broadcast(owners), F.col("_key_slot") == F.col("_slot"))
    return joined.select(*kept, F.col("_key_slot").alias("slot"), F.col("_shard").alias("shard"))


def document_key(df: DataFrame) -> Column:
    """The id of a document; without one, the digest of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def write_shards(placed: DataFrame, path: str, parts: int = 8) -> None:
    """Write one folder for each shard, in up to ``parts`` files, so that no task holds a whole shard."""
    spread = placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*placed.columns), F.lit(parts)))
    spread.write.partitionBy("shard").parquet(path)


def _oracle() -> str:
    owner = lookup_table()
    return f"""
        WITH owners AS (SELECT [{','.join(map(str, owner))}] AS o),
        keyed AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT % {SLOTS} AS INTEGER) AS slot
                  FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(o[slot + 1] AS VARCHAR), 2, '0') AS shard
        FROM keyed, owners"""


@query(_oracle())
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, folder, "documents")
    # a document with an id needs no text, so the text is read only for documents without one
    return place(docs, document_key(docs)).select("doc_id", "slot", "shard")
