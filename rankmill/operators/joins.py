"""Joins of detail rows with a table that holds one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_per_key(
    detail: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", null_matches: bool = False
) -> DataFrame:
    """Add the columns of ``per_key`` to the detail rows with the same keys.

    The size of ``per_key`` is not known here, so nothing is hinted: Spark broadcasts it when its
    measured size is under the threshold, else it sort-merges. A hot key then fills one partition
    of the detail side, which Spark splits over many tasks, but only if each side is shuffled for
    this join alone. A table that was just aggregated by the same keys would be joined as it lies;
    the null-safe comparison makes Spark shuffle it for the join too.

    NULL keys find no partner unless ``null_matches``.
    """
    renamed = {k: f"__key_{k}" for k in keys}
    if not null_matches:
        per_key = per_key.na.drop(subset=list(keys))
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return detail.join(per_key.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())
