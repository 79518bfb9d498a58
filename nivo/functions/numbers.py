"""Number formatting as C ``printf`` and Python f-strings do it, as Column expressions.

``format_string`` rounds the shortest decimal form half-up; C rounds the exact binary
value half-to-even. The two differ on values such as 0.25 (".2" against ".3") and 0.35
(".3" against ".4"), so text built with ``format_string`` would not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_WORD = 31
_MASK = 2**_HALF_WORD - 1


def fixed(value: Column, digits: int) -> Column:
    """``%.{digits}f`` of a non-negative double, for up to three digits.

    The fraction times 2**62 is an exact integer for every fraction that can decide a
    rounding at three digits. It is multiplied by 10**digits in two 31-bit halves, so the
    comparison with one half is exact as well.
    """
    if digits == 0:
        return F.bround(value, 0).cast("bigint").cast("string")
    unit = 10**digits
    whole = F.floor(value)
    bits = ((value - whole) * float(2 ** (2 * _HALF_WORD))).cast("bigint")
    low = bits.bitwiseAND(F.lit(_MASK)) * unit
    high = F.shiftright(bits, _HALF_WORD) * unit + F.shiftright(low, _HALF_WORD)
    digits_down = F.shiftright(high, _HALF_WORD)
    rest = F.shiftleft(high.bitwiseAND(F.lit(_MASK)), _HALF_WORD) + low.bitwiseAND(F.lit(_MASK))
    half = F.lit(2 ** (2 * _HALF_WORD - 1))
    up = (rest > half) | ((rest == half) & (F.pmod(digits_down, F.lit(2)) == 1))
    rounded = digits_down + F.when(up, 1).otherwise(0)
    carry = F.when(rounded >= unit, 1).otherwise(0)
    return F.concat(
        (whole + carry).cast("string"),
        F.lit("."),
        F.lpad((rounded - carry * unit).cast("string"), digits, "0"),
    )
