"""Deterministic draws: a pseudo-random integer per row from its keys and a seed.

Plain integer arithmetic, so a retried task repeats its draws and any SQL engine can state them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import bind

PRIME = 2147483647  # 2^31 - 1: products of two residues fit a 64-bit integer


def draw(seed: int | Column, *keys: Column) -> Column:
    """Pseudo-random integer in [0, PRIME) for the integer ``keys``; ``seed`` may be the draw of earlier keys."""
    prime = F.lit(PRIME).cast("long")
    x = F.lit(seed).cast("long")
    for k in keys:
        x = F.pmod(x * 48271 + F.pmod(k.cast("long"), prime) * 69621 + 11, prime)
        x = bind(x, lambda v: F.pmod(v * v + v * 16807 + 7, prime))
    return x


def sql_draw(seed: int, *keys: str) -> str:
    """The same integer as a SQL expression."""
    x = f"{seed}::BIGINT"
    for k in keys:
        x = f"(({x}) * 48271 + ({k})::BIGINT % {PRIME} * 69621 + 11) % {PRIME}"
        x = f"list_transform([{x}], lambda v: (v * v + v * 16807 + 7) % {PRIME})[1]"
    return x
