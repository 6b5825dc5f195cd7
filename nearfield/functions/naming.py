"""Hashes and names."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a of 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    out = FNV_OFFSET
    for byte in data:
        out = ((out ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return out


def namespace(key: str) -> str:
    """A key as a folder name: other characters become '_'; if none is left, the key's hash."""
    name = re.sub(r"[^A-Za-z0-9._-]", "_", key)
    return name if name.strip("_") else f"ns_{fnv1a(key.encode()):x}"


def namespace_column(key: Column) -> Column:
    """The same for a column, but for keys of which no character is left: those stay '_'."""
    return F.regexp_replace(key, r"[^A-Za-z0-9._-]", "_")


def ring_token(key: str) -> int:
    """ring_hash of one key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long, the same on any engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
