"""Joins that keep rows whose keys are null."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, where null equals null; each key stands once, as left has it."""
    own = {k: f"__{k}" for k in on}
    other = right.select(*[F.col(k).alias(v) for k, v in own.items()], *[c for c in right.columns if c not in own])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in own.items()])
    return left.join(other, same, how).drop(*own.values())
