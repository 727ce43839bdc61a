"""Aggregates of a mart by many sets of dimensions at once, and the choice of the smallest that answers a question.

A dashboard asks for means by a few dimensions under filters on others. Sums and counts by a set of dimensions answer
every question on a subset of it. So they are kept for several sets (levels), all taken in one pass with grouping
sets, and a question is answered from the level with the fewest rows among those that have all its dimensions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.session import stored


class Lattice:
    """``levels`` maps the number of a level to its dimensions, ``sizes`` to its rows; ``table`` has _level, the dimensions, and sums and counts."""

    def __init__(self, table: DataFrame, levels: Mapping[int, frozenset[str]], sizes: Mapping[int, int]) -> None:
        self.table, self.levels, self.sizes = table, dict(levels), dict(sizes)

    def level_of(self, dimensions: Sequence[str]) -> int:
        """The smallest level that has the dimensions."""
        fit = [i for i, own in self.levels.items() if set(dimensions) <= own]
        if not fit:
            raise ValueError(f"no level has {sorted(set(dimensions))}, levels are {sorted(map(sorted, self.levels.values()))}")
        return min(fit, key=lambda i: (self.sizes[i], i))

    def rows(self, dimensions: Sequence[str]) -> DataFrame:
        """Sums and counts of the smallest level that has the dimensions; the level is a partition, so no other is read."""
        return self.table.filter(F.col("_level") == self.level_of(dimensions))

    def means(self, rows: DataFrame, by: Sequence[str], measures: Sequence[str], digits: int | None = 10) -> DataFrame:
        """Means of the measures by some of the dimensions of ``rows``; NULL where nothing was measured."""

        def mean(m: str) -> Column:
            value = F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0).cast("bigint"))
            return (value if digits is None else F.round(value, digits)).alias(m)

        return rows.groupBy(*by).agg(*map(mean, measures))


def build(df: DataFrame, levels: Sequence[Sequence[str]], measures: Sequence[str], path: str | None = None) -> Lattice:
    """Sums and counts of the measures by each set of dimensions, written by level to ``path`` (else the checkpoint folder).

    NULL is a value of a dimension like any other; which dimensions a row has is said by its level.
    """
    sets = [sorted(set(level)) for level in levels]
    dimensions = sorted({d for level in sets for d in level})
    bit = {d: 1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions)}  # as grouping_id() numbers what is left out
    number = {sum(bit[d] for d in dimensions if d not in level): frozenset(level) for level in sets}
    sums = [c for m in measures for c in (F.sum(F.col(m).cast("double")).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"))]
    grouped = df.groupingSets([[F.col(d) for d in level] for level in sets], *[F.col(d) for d in dimensions])
    table = grouped.agg(F.grouping_id().cast("int").alias("_level"), *sums)
    if path is None:
        table = stored(table)
    else:
        table.write.mode("overwrite").partitionBy("_level").parquet(path)
        table = df.sparkSession.read.parquet(path)
    sizes = {r["_level"]: r["count"] for r in table.groupBy("_level").count().collect()}
    return Lattice(table, number, {i: sizes.get(i, 0) for i in number})
