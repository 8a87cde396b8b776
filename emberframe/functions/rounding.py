"""Rounding to decimals of what a double really holds, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits, whose products are exact.
SPLIT = float(2**27 + 1)


def half_even(x: Column | str, digits: int = 0) -> Column:
    """``x`` (a double) rounded to ``digits`` decimals, 0 to 15: the nearest of the double's exact value, ties to the even digit.

    Spark's own functions round the shortest text of a double, so 2.675, which holds a little less, becomes 2.68; here it
    becomes 2.67. The product with the power of ten is kept without error, as its rounded value and what rounding took off;
    both are compared with the tie. Null, NaN and infinite values, and those too large to have decimals, stay as they are.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be between 0 and 15")
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    m = 10.0**digits
    p = x * m
    a, b = SPLIT * x, SPLIT * m
    x_high = a - (a - x)
    m_high = b - (b - m)
    x_low, m_low = x - x_high, F.lit(m - m_high)
    off = ((x_high * m_high - p) + x_high * m_low + x_low * m_high) + x_low * m_low  # p + off is the exact product
    n = F.floor(p).cast("double")
    past = (p - n) - 0.5
    odd = n - 2 * F.floor(n / 2).cast("double") == 1
    up = (past > -off) | ((past == -off) & odd)
    # half below a whole number, which only products without decimals of their own can be
    down = (off == -0.5) & (p == n) & odd
    rounded = F.when(up, n + 1).when(down, n - 1).otherwise(n) / m
    signed = F.when((rounded == 0) & (x < 0), F.lit(-0.0)).otherwise(rounded)
    return F.when(F.abs(p) < float(2**53), signed).otherwise(x)
