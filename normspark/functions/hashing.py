"""Digests, sample ids and stable buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, separator: str = "\0") -> Column:
    """SHA-256 (hex) of the parts joined by ``separator``; null if one is null."""
    columns = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    joined: list[Column] = []
    for i, c in enumerate(columns):
        joined += [F.lit(separator)] * bool(i) + [c]
    return F.sha2(F.concat(*joined), 256)


def sample_id(category: Column | str, path: Column | str, separator: str = "\0") -> Column:
    """The first 24 hex digits of the digest of category and path."""
    return F.substring(digest(category, path, separator=separator), 1, 24)


def stable_bucket(key: Column | str, n: int, digits: int = 16) -> Column:
    """The first ``digits`` hex digits of the key's SHA-256 as an unsigned number, modulo ``n``."""
    column = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.sha2(column.cast("string"), 256), 1, digits), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(n).cast("decimal(20,0)")).cast("int")
