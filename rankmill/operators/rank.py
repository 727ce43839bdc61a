"""Ranks inside groups of any size.

A window over (group) ordered by (value) sorts each group in a single task, and fails once one group
holds a large part of the data. All ranking functions only depend on how many rows, and how many
distinct values, lie up to a value. So the rows are counted per (groups, value), which combines on the
map side; the counts are range-partitioned by (outermost group, value), so that a big group is spread over many
partitions. Equal values of the outermost group share a partition, so the running counts of it and of all groups
inside it are taken there side by side; the totals of each group's earlier partitions are added. The result, one row
per (groups, value), is joined to the rows once, whatever the number of scopes.

The rows are stored first and the range-partitioned counts with their partition number, so nothing is computed twice, and every
later step, and every recomputation after a lost executor, sees the same partitions. They and the totals of the partitions, stored too,
are the only jobs that run while a plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankmill.functions.numbers import round_half
from rankmill.operators.joins import join_per_key
from rankmill.session import stored

Scopes = Sequence[tuple[Sequence[str], Mapping[str, str]]]


def _count_values(rows: DataFrame, value: str, keys: Mapping[str, str], outer: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows per group of the innermost columns and value, range-partitioned by the outermost group and the value, and stored."""
    counted = rows.groupBy(*[F.col(k).alias(name) for k, name in keys.items()], value).agg(F.count(F.lit(1)).alias("_n"))
    order = [*map(F.col, outer), F.col(value).asc_nulls_last()]
    ranged = counted.repartitionByRange(partitions, *order) if partitions else counted.repartitionByRange(*order)
    return stored(ranged.withColumn("_part", F.spark_partition_id()))


def _offsets(counted: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Per group and partition: rows and distinct values in earlier partitions, and the group's rows, non-NULL values and largest value.

    Stored, so of known size: where it is small, the counts need not be shuffled to meet it.
    """
    # all counts of a partition lie in one task from here on, which serves both groupings
    values = counted.repartition("_part").groupBy(*group, "_part", value).agg(F.sum("_n").alias("_n"))
    totals = values.groupBy(*group, "_part").agg(
        F.sum("_n").alias("_part_rows"),
        F.count(F.lit(1)).alias("_part_places"),
        F.count(value).alias("_part_values"),
        F.max(value).alias("_part_top"),
    )
    # One row per group and partition, so a group has no more rows here than there are partitions.
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(
        totals.select(
            *group,
            "_part",
            F.coalesce(F.sum("_part_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_part_places").over(earlier), F.lit(0)).alias("_places_before"),
            F.sum("_part_rows").over(whole).alias("_rows"),
            F.sum("_part_values").over(whole).alias("_values"),
            F.max("_part_top").over(whole).alias("_top"),
        )
    )


def _with_positions(counted: DataFrame, parts: DataFrame, value: str, group: Sequence[str], wanted: Mapping[str, str]) -> DataFrame:
    """``parts`` with the wanted ranks of each value in ``group``, ascending with NULL last."""
    share = Window.partitionBy(*group, "_part").orderBy(F.col(value).asc_nulls_last())
    within = parts.withColumns(
        {
            "_upto": F.sum("_n").over(share.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "_same": F.sum("_n").over(share.rangeBetween(Window.currentRow, Window.currentRow)),
            "_place": F.dense_rank().over(share).cast("bigint"),
        }
    )
    joined = join_per_key(within, _offsets(counted, value, group), [*group, "_part"], null_matches=True)
    joined = joined.withColumns({"_upto": F.col("_rows_before") + F.col("_upto"), "_place": F.col("_places_before") + F.col("_place")})
    kinds = _rank_columns(value)
    return joined.select(*parts.columns, *[kinds[kind].alias(name) for name, kind in wanted.items()])


def _rank_columns(value: str) -> dict[str, Column]:
    rows, upto, place = F.col("_rows"), F.col("_upto"), F.col("_place")
    below = upto - F.col("_same")
    others = F.nullif(rows - 1, F.lit(0).cast("bigint"))
    return {
        "cume_dist": upto.cast("double") / rows,
        "percent_rank": F.coalesce(below.cast("double") / others, F.lit(0.0)),
        "rank": below + 1,
        "dense_rank": place,
        "dense_rank_desc": F.when(F.col(value).isNull(), F.col("_values") + 1).otherwise(
            F.col("_values") - place + 1
        ),
        "count": rows,
        "max": F.col("_top"),
    }


def with_ranks(df: DataFrame, value: str, scopes: Scopes, partitions: int | None = None) -> DataFrame:
    """Rank ``value`` in one or more group scopes and add the results to the rows.

    ``scopes`` pairs group columns with {new column: kind}; kinds are ``cume_dist``,
    ``percent_rank``, ``rank``, ``dense_rank``, ``dense_rank_desc``, ``count`` and ``max``. Values
    ascend, NULL comes last in both directions, NULL group columns form a group of their own.

    The rows are stored before they are counted. Scopes whose groups lie inside those of the smallest one are
    ranked together; others one after the other. ``partitions`` overrides the number of ranges.
    """
    outer = min(range(len(scopes)), key=lambda i: len(scopes[i][0]))
    if not all(set(scopes[outer][0]) <= set(by) for by, _ in scopes):
        return reduce(lambda done, scope: with_ranks(done, value, [scope], partitions), scopes, df)
    rows = stored(df)
    keys = {k: f"_group{i}" for i, k in enumerate(dict.fromkeys(k for by, _ in scopes for k in by))}
    named = [[keys[k] for k in by] for by, _ in scopes]
    counted = _count_values(rows, value, keys, named[outer], partitions)
    ranks = counted.repartition("_part")  # both kinds of running counts are taken where a part of the counts lies
    for group, (_, wanted) in zip(named, scopes, strict=True):
        ranks = _with_positions(counted, ranks, value, group, wanted)
    # Plain columns, the value first: its many values settle nearly every comparison of the sort, where nested groups did not.
    ranks = ranks.select(F.col(value).alias("_v"), *keys.values(), *[name for _, wanted in scopes for name in wanted])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(at)) for k, at in {value: "_v", **keys}.items()])
    # A hot value sits on the side of the rows, which Spark may split over many tasks.
    return rows.join(ranks, same).drop("_v", *keys.values())


def percent_score(cume_dist: Column | str) -> Column:
    """Percentile score 0 to 100 with one decimal."""
    c = F.col(cume_dist) if isinstance(cume_dist, str) else cume_dist
    return round_half(F.lit(100.0) * c, 1)


def performance_bucket(score: Column | str) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= 90, "Top 10%").when(c >= 50, "Middle").otherwise("Bottom 50%")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], latest: Sequence[str], tie_break: Sequence[str] = (), keep: str | None = None
) -> DataFrame:
    """One row per key: the one with the largest ``latest`` columns, ties by smallest ``tie_break``.

    Spark turns the row_number filter into a group limit that already keeps one row per key on the
    map side, so a hot key reaches its final task as one row per map task.
    """
    order = [F.col(c).desc_nulls_last() for c in latest] + [F.col(c).asc_nulls_last() for c in tie_break]
    rn = keep or "_rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rn) == 1)
    return out.withColumn(rn, F.col(rn).cast("bigint")) if keep else out.drop(rn)
