"""Order-preserving integers of floating values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = 1 << 52


def order_key(x: Column) -> Column:
    """Bits of the double ``x`` as BIGINT, so that a < b exactly if key(a) < key(b)."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("double")
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), guess))
    m = a / F.pow(F.lit(2.0), guess)
    # log2 may be off by one next to a power of two
    exp = F.when(m >= 2, guess + 1).when((m < 1) & (guess > -1022), guess - 1).otherwise(guess)
    frac = (a / F.pow(F.lit(2.0), exp) - 1) * float(MANTISSA)
    normal = (exp.cast("bigint") + 1023) * MANTISSA + frac.cast("bigint")
    small = (a * float(2**537) * float(2**537)).cast("bigint")
    top = F.lit(2047 * MANTISSA).cast("bigint")
    bits = F.when(a == 0, F.lit(0).cast("bigint")).when(a == float("inf"), top).when(a < float(2.0**-1022), small).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def key_value(k: Column) -> Column:
    """The double whose order_key is ``k``."""
    a = F.abs(k)
    exp, frac = F.shiftright(a, 52), a.bitwiseAND(F.lit(MANTISSA - 1))
    normal = (F.lit(1.0) + frac.cast("double") / float(MANTISSA)) * F.pow(F.lit(2.0), (exp - 1023).cast("double"))
    small = frac.cast("double") * F.lit(2.0**-537) * F.lit(2.0**-537)
    v = F.when(exp >= 2047, F.lit(float("inf"))).when(exp == 0, small).otherwise(normal)
    return F.when(k < 0, -v).otherwise(v)
