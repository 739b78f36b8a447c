"""Exact order statistics by distributed selection: no sort, and no buffer that grows with a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that one round settles; 64 bits take four rounds.
BITS = 16
ROUNDS = 64 // BITS


def sortable(value: Column | str) -> Column:
    """A double as a long of the same order: its exponent and mantissa, negated below zero. Both zeros are 0; null and NaN are null."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    a = F.abs(x)
    guess = F.least(F.lit(1023.0), F.greatest(F.lit(-1022.0), F.floor(F.log2(a)).cast("double")))
    # log2 may be off by one beside a power of two
    exponent = F.greatest(F.lit(-1022.0), guess + F.when(a / F.pow(F.lit(2.0), guess) >= 2, 1.0).when(a / F.pow(F.lit(2.0), guess) < 1, -1.0).otherwise(0.0))
    mantissa = a / F.pow(F.lit(2.0), exponent)
    bits = ((exponent + 1022) * 2.0**52).cast("long") + (mantissa * 2.0**52).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52).cast("long")).otherwise(bits)
    return F.when(~F.isnan(x), F.when(x < 0, -size).otherwise(size))


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.lit(True))


def narrow(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """One round of the descent.

    ``rows`` has ``by``, _key (long), _w (weight of 0 or more) and _value. ``state`` has ``by``, _want, _t, _lo, _hi and _below: the weight _t
    is looked for among the keys from _lo to _hi, before which lies the weight _below. Keys that differ in their leading
    ``BITS`` differing bits are counted apart; the new state holds the least and largest key of the one range in which the sum of the weights passes
    _t, the least value there and the range's weight as _at. At most 2**BITS ranges for a want are compared in one window.
    """
    small = state if by else F.broadcast(state)  # a few wants in all
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("s._lo").bitwiseXOR(F.col("s._hi")))) - BITS).cast("int")
    wants = ["_want", "_t", "_below", "_shift"]
    ready = small.alias("s").select("s.*", shift.alias("_shift"))
    met = rows.alias("r").join(ready.alias("s"), _same(by) & F.col("r._key").between(F.col("s._lo"), F.col("s._hi")))
    sums = met.select(*[f"r.{c}" for c in by], *[f"s.{c}" for c in wants], F.expr("shiftright(r._key, s._shift)").alias("_b"), "r._key", "r._w", "r._value").groupBy(
        *by, *wants, "_b"
    ).agg(F.sum("_w").alias("_at"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.min("_value").alias("_value"))
    order = Window.partitionBy(*by, "_want").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    until = sums.withColumn("_until", F.col("_below") + F.sum("_at").over(order))
    return until.where("_until > _t AND _until - _at <= _t").select(*by, "_want", "_t", "_lo", "_hi", (F.col("_until") - F.col("_at")).alias("_below"), "_at", "_value")


def quantiles(df: DataFrame, value: Column | str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles, with interpolation between neighbours: one row for each group, a column for each of ``shares``.

    Nulls and NaN do not count; a group without other values gets null. Each round scans the rows once, counts them by the leading
    bits that still differ and goes on in the one range that holds the rank; the rows themselves are never gathered or sorted.
    """
    by = by or []
    rows = df.select(*by, sortable(value).alias("_key"), F.lit(1).cast("long").alias("_w"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("_value"))
    groups = rows.groupBy(*by).agg(F.count("_key").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    rows = rows.where("_key IS NOT NULL")
    asks = []
    for k, share in enumerate(shares.values()):
        rank = F.floor((F.col("_n") - 1) * F.lit(float(share)))
        asks += [F.struct(F.lit(2 * k).alias("_want"), rank.alias("_t")), F.struct(F.lit(2 * k + 1).alias("_want"), F.least(rank + 1, F.col("_n") - 1).alias("_t"))]
    state = groups.where("_n > 0").select(*by, F.inline(F.array(*asks)), "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    for _ in range(ROUNDS):
        state = narrow(rows, state.select(*by, "_want", "_t", "_lo", "_hi", "_below"), by)
    found = state.groupBy(*by).agg(*[F.max(F.when(F.col("_want") == w, F.col("_value"))).alias(f"_v{w}") for w in range(2 * len(shares))])
    joined = groups.alias("r").join(found.alias("s") if by else F.broadcast(found).alias("s"), _same(by), "left")
    out = []
    for k, (name, share) in enumerate(shares.items()):
        at = (F.col("_n") - 1) * F.lit(float(share))
        part = at - F.floor(at)
        low, high = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        out.append(F.when((part == 0) | (low == high), low).otherwise(low * (1 - part) + high * part).alias(name))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in by], *out)
