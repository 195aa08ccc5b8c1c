"""Column expressions on edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The multiplier of the update split (a fixed value); the product wraps modulo 2**64.
SPLIT_MULTIPLIER = 11400714819323198485
_WORD = (1 << 32) - 1


def is_update_edge(a: Column, b: Column, share: int = 10) -> Column:
    """Whether an edge belongs to the update stream: a hash of its ends, one in `share`. Ids fit 31 bits.
    The product is made of halves of 32 bits, as longs: decimals of that width cost microseconds a row."""
    hi, lo = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    m_hi, m_lo = F.lit(SPLIT_MULTIPLIER >> 32).cast("long"), F.lit(SPLIT_MULTIPLIER & _WORD).cast("long")
    word = F.lit(_WORD).cast("long")
    low = lo * m_lo  # below 2**63
    cross = (lo * m_hi).bitwiseAND(word) + (hi * m_lo).bitwiseAND(word)
    upper = (F.shiftright(low, 32) + cross).bitwiseAND(word)
    return F.pmod(F.pmod(upper, F.lit(share)) * ((1 << 32) % share) + F.pmod(low.bitwiseAND(word), F.lit(share)), F.lit(share)) == 0


def canonical(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]
