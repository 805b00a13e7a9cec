"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and a step from hashes of its
name). In turns, each shard claims the next free slot it prefers, heavier shards more often. A row looks up the slot
of its key's hash: constant time, from a table of fixed size that is a constant of the plan. Shards get equal numbers
of slots (to one for each turn), and few slots move when shards come or go.

Defined results: null keys are a key like another (a null and the text "null" share a slot); empty and very long keys are
hashed whole; repeated keys get the same shard; an empty table gives an empty result; other columns are kept out, and the
key's column may have any name but ``slot`` and ``shard``, under which it is returned as ``key``.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard number of each slot."""
    if not is_prime(size) or not 0 < len(shards) < size or len(set(shards)) < len(shards):
        raise ValueError("needs a prime table size and one to size - 1 shards of different names")
    offsets = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    steps = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 for s in shards]
    table, at, filled = [-1] * size, [0] * len(shards), 0
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    while True:
        for i in turns:
            while table[slot := (offsets[i] + at[i] * steps[i]) % size] >= 0:
                at[i] += 1
            table[slot] = i
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """crc32 of the key's text is the same everywhere; null hashes as a text that no number has."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % size).cast("int")


def place(rows: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """key, slot, shard (name) for each row; no shuffle."""
    table = F.from_json(F.lit(json.dumps(lookup_table(shards, size, weights))), "array<int>")
    names = F.array(*map(F.lit, shards))
    name = "key" if key_col.lower() in ("slot", "shard") else key_col
    placed = rows.select(F.col(key_col).alias(name), slot_of(F.col(key_col), size).alias("slot"))
    return placed.select(name, "slot", F.element_at(names, F.element_at(table, F.col("slot") + 1) + 1).alias("shard"))
