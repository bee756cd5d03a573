"""Digest based expressions: hashes, unit intervals, ranks and rolling hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def prefix_number(digest: Column, digits: int = 16) -> Column:
    """The leading hex digits as an exact unsigned number (DECIMAL: 64 bits overflow BIGINT)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def unit_interval(key: Column) -> Column:
    """Deterministic number in [0, 1) from the first 64 bits of SHA-256."""
    return prefix_number(sha256_hex(key)).cast("double") / F.lit(2.0**64)


def hash_number_between(digest: Column, first: int, below: Column) -> Column:
    """16 hex digits of a digest from position ``first`` (0-based), modulo ``below``."""
    number = F.conv(F.substring(digest, first + 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, below.cast("decimal(20,0)")).cast("long")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def spaced_json(fields: dict[str, Column]) -> Column:
    """JSON of scalar fields with sorted keys, and a space after commas and colons."""
    parts = [F.concat(F.lit(f'"{k}": '), F.substring(F.to_json(F.struct(fields[k].alias("v")), {"ignoreNullFields": "false"}), 6, 1 << 30)) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.substring(p, F.lit(1), F.length(p) - 1) for p in parts]), F.lit("}"))


def stable_id(prefix: str, fields: dict[str, Column]) -> Column:
    return F.concat(F.lit(prefix), sha256_hex(canonical_json(fields)))


def rolling_hash(tokens: Column, at: Column, order: int, rows: int, seed: int = 0) -> Column:
    """Bucket of the ``order`` tokens that end at 0-based place ``at`` of an array; places before the first count 0."""
    state = F.lit(seed % 2147483647).cast("long")
    for back in range(order - 1, -1, -1):
        token = F.when(at >= back, F.element_at(tokens, (at - back + 1).cast("int")).cast("long") + 1).otherwise(0)
        state = (state * 65599 + token) % 2147483647
    return state % rows
