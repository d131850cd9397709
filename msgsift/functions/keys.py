"""Reproducible keys: a row's random draw depends only on (salt, id), never on
partitioning or input order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_digest(salt, *parts) -> Column:
    """md5 hex digest of 'salt:part1:part2...'."""
    return F.md5(F.concat_ws(":", F.lit(str(salt)), *[_col(p).cast("string") for p in parts]))


def key_prefix(salt, *parts) -> Column:
    """The text that :func:`hash_digest` digests, up to its last part: 'salt:part1:part2...:'."""
    return F.concat_ws(":", F.lit(str(salt)), *[_col(p).cast("string") for p in parts], F.lit(""))


def digest_key(digest: Column, segment: int = 0) -> Column:
    """Hex digits ``8*segment+1 .. 8*segment+8`` of a digest as a BIGINT in [0, 2^32).

    One md5 gives four independent 32-bit draws (segments 0-3).
    """
    return F.conv(F.substring(digest, 8 * segment + 1, 8), 16, 10).cast("bigint")


def hash_key(salt, *parts) -> Column:
    """First 8 hex digits of md5('salt:part1:part2...') as a BIGINT in [0, 2^32).

    Equals DuckDB ``('0x' || substr(md5(s), 1, 8))::BIGINT``.
    """
    return digest_key(hash_digest(salt, *parts), 0)


def hash_bucket(key: Column, bits: int) -> Column:
    """Top ``bits`` bits of a 32-bit hash key."""
    if bits <= 0:
        return F.lit(0).cast("bigint")
    return F.shiftright(key, KEY_BITS - bits)


def sql_hash_key(salt, *parts: str, segment: int = 0) -> str:
    """The DuckDB text of :func:`hash_key` / :func:`digest_key` (for oracle queries)."""
    inner = " || ':' || ".join([f"'{salt}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5({inner}), {8 * segment + 1}, 8))::BIGINT"
