"""The stable shard hash of terms and ids: 32-bit FNV-1a over UTF-16 units, as a Column and in Python for pruning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEED, _PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(text: str) -> int:
    h, raw = _SEED, text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = (h ^ (raw[k] | raw[k + 1] << 8)) * _PRIME & _MASK
    return h


def shard_for(text: str, shards: int) -> int:
    h = fnv1a(text)
    return abs(h - (1 << 32) if h >= 1 << 31 else h) % shards


def shard_column(c: Column, shards: int | Column) -> Column:
    """shard_for as an expression; characters beyond the first plane count as their two UTF-16 units."""
    # Every two hexadecimal bytes of UTF-16 are one unit.
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    h = F.aggregate(units, F.lit(_SEED).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * _PRIME).bitwiseAND(F.lit(_MASK).cast("long")))
    return (F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % shards).cast("int")
