"""Rounding in generated code."""

from pyspark.sql import Column, functions as F

#: Below this size a millionth times a double is known to 2e-6, so a fraction further from a half than NEAR_HALF rounds the same way as the decimal does.
EXACT_BELOW = float(1 << 33) / 1e6
NEAR_HALF = 1e-5


def round6(x: Column) -> Column:
    """What `round(x, 6)` gives for a double, which goes through a decimal number for every value.

    Here only values close to a tie, large ones, NaN and infinities do. For all others the millionths are counted by `floor`, and a quotient of
    whole numbers is the double nearest to the rounded decimal.
    """
    scaled = F.abs(x) * F.lit(1e6)
    count = F.floor(scaled + F.lit(0.5))
    plain = (F.abs(x) < F.lit(EXACT_BELOW)) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(NEAR_HALF))
    return F.when(plain, F.when(x < 0, -count).otherwise(count) / F.lit(1e6)).otherwise(F.round(x, 6))
