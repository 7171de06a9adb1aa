"""Canonical, reproducible draws.

The topologies being modelled draw keys, fan-out counts and window picks from
unseeded generators. Here every draw is a salted md5 of its inputs, which Spark
and DuckDB compute identically:

    H(x1..xn) = first 8 hex digits of md5(concat_ws('|', x1..xn)) as bigint, 0 .. 2^32-1
    U(x1..xn) = H(x1..xn) / 2^32, a double in [0, 1)

Salt every draw with seed, component and purpose so that draws at different
hops do not correlate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

# --- fixed values: weighted key table (keys in order, weight of each in 32nds) ---
KEYS = ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L", "M", "N", "O", "P"]
KEY_WEIGHTS_32 = [6, 4, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1]
FALLBACK_KEY = "A"
# --- end of fixed values ---

KEY_WEIGHTS = [w / 32.0 for w in KEY_WEIGHTS_32]


# the weights are multiples of 1/32, so "first cumulative weight >= u" is a lookup in
# 32 equal slots: key i owns as many slots as its weight in 32nds (slot = ceil(32u) - 1)
KEY_SLOTS = [k for k, w in zip(KEYS, KEY_WEIGHTS_32) for _ in range(w)]


def _as_str(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def hash32(*parts) -> Column:
    """H(parts): bigint in [0, 2^32). Literals are salts; Columns are data."""
    joined = F.concat_ws("|", *[_as_str(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """U(parts): double in [0, 1)."""
    return hash32(*parts).cast("double") / F.lit(TWO_32)


def first_at_least(u: Column, cumulative: Sequence[float], values: Sequence, fallback) -> Column:
    """values[i] for the first i with cumulative[i] >= u, else ``fallback``.

    A CASE chain keeps the draw inside whole-stage codegen (no array per row).
    """
    expr = None
    for c, v in zip(cumulative, values):
        cond = u <= F.lit(float(c))
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(fallback))


def weighted_key(u: Column) -> Column:
    """K1: the weighted key for a uniform draw ``u`` in [0, 1).

    Same result as comparing ``u`` with each cumulative weight in turn, but ``u``
    is referenced once: a CASE chain would re-evaluate the hashed draw in every
    condition it tests (conditions are not common-subexpression eliminated).
    """
    slot = F.greatest(F.ceil(u * F.lit(32.0)) - F.lit(1), F.lit(0)).cast("int")
    return F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in KEY_SLOTS]), slot + F.lit(1)), F.lit(FALLBACK_KEY))


def normal_cdf(x: float, mean: float, std: float) -> float:
    return math.erfc((mean - x) / (std * math.sqrt(2.0))) / 2


def multiplier_table(vmin: int, vmax: int, mean: float, std: float) -> tuple[list[int], list[float]]:
    """Values vmin..vmax with the normal CDF at each value (not renormalised)."""
    values = list(range(vmin, vmax + 1))
    return values, [normal_cdf(float(v), float(mean), float(std)) for v in values]


# The multiplier generator's own mean field is never assigned, so when no CDF
# value reaches the draw it returns the int default, 0: that row emits nothing.
MULTIPLIER_FALLBACK = 0


def normal_multiplier(u: Column, vmin: int, vmax: int, mean: float, std: float) -> Column:
    """K3: smallest v in [vmin, vmax] with Phi((v - mean) / std) >= u, else 0."""
    values, cdf = multiplier_table(vmin, vmax, mean, std)
    # a CASE chain tests u once per condition: pass u as a column, not as a hash expression
    return first_at_least(u, cdf, values, MULTIPLIER_FALLBACK).cast("bigint")


def uuid_from(x: Column) -> Column:
    """A UUID-shaped, deterministic id: md5 hex split 8-4-4-4-12."""
    m = F.md5(x.cast("string"))
    return F.concat_ws(
        "-",
        F.substring(m, 1, 8),
        F.substring(m, 9, 4),
        F.substring(m, 13, 4),
        F.substring(m, 17, 4),
        F.substring(m, 21, 12),
    )
