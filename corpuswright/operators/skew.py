"""Joins whose key may be held by a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.session import materialise


def skew_join(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int | None = None, hot_keys: int = 1000) -> DataFrame:
    """``many`` joined (inner) with ``one``, which has one row a key and says in ``weight`` how many
    rows of ``many`` carry it (at most). ``total`` is the sum of the weights, computed if it is not given.

    At most ``hot_keys`` keys can carry more than total / hot_keys rows; those travel as a broadcast of
    proven size and never gather in a task. All other keys take the shuffle join. ``weight`` is dropped.
    Null keys match nothing.
    """
    if total is None:
        one = materialise(one, "weights")
        total = one.agg(F.sum(weight)).first()[0] or 0
    limit = total / hot_keys + 1
    hot = one.where(F.col(weight) > limit).drop(weight)
    cold = one.where(F.col(weight) <= limit).drop(weight)
    return many.join(F.broadcast(hot), keys).unionByName(many.join(cold, keys))
