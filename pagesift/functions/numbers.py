"""Numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """A double to so many digits, halves to even, judged by the scaled double (0.575 is below its half: 57.49... of 100).

    bround judges the shortest decimal form instead, and gives 0.58 there.
    """
    return F.rint(value * 10.0**digits) / 10.0**digits
