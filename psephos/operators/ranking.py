"""Ranks and running numbers over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which a narrow table is sent to all tasks.
FEW = 100_000


def sent_if_few(df: DataFrame, name: str) -> DataFrame:
    """df, written and counted, to be joined by a key that any number of the other side's rows may share: sent to all tasks if it is small, so that these rows are not moved to one task."""
    from psephos.sources.io import written

    table = written(df, name)
    return F.broadcast(table) if table.count() <= FEW else table


def global_rank(df: DataFrame, bins: list[Column], order: list[str], to: str = "rnk") -> DataFrame:
    """Adds the place of each row, from 0, in the order of `bins` and then `order`.

    bins: expressions, coarse to fine, by which the order is already decided but for rows alike in all of them.  Rows are counted by
    bin, the bins' running sum is small, and only rows of one bin are sorted together.
    """
    names = [f"_bin{i}" for i in range(len(bins))]
    binned = df.withColumns(dict(zip(names, bins)))
    counts = binned.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    # first within the coarsest bin, then over the coarsest bins themselves
    inner = F.sum("_n").over(Window.partitionBy(names[0]).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    coarse = counts.groupBy(names[0]).agg(F.sum("_n").alias("_m"))
    before = coarse.select(names[0], F.coalesce(F.sum("_m").over(Window.orderBy(names[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = counts.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(before, names[0]).select(*names, (F.col("_before") + F.col("_inner")).alias("_start"))
    placed = binned.join(starts, names)
    return placed.withColumn(to, F.col("_start") + F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1).drop(*names, "_start")


def running_sum(df: DataFrame, by: str, bins: list[Column], order: list[str], value: str, to: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same `by` up to each row, in the order of `bins` and then `order`.

    As with global_rank, sums by bin are small, and only rows of one bin are sorted together.
    """
    names = [f"_bin{i}" for i in range(len(bins))]
    binned = df.withColumns(dict(zip(names, bins)))
    sums = binned.groupBy(by, *names).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col(by).alias("_by"), *[F.col(n).alias(f"{n}_") for n in names], F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col(by).eqNullSafe(F.col("_by"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    own = F.sum(value).over(Window.partitionBy(by, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return binned.join(starts, same).withColumn(to, F.col("_start") + own).drop(*names, *[f"{n}_" for n in names], "_by", "_start")


def placed_within(df: DataFrame, by: list[str], order: list[str], to: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, within its group, in the order of `order`; groups may be of any size.

    Rows are range-split by group and order and numbered where they are; the number of rows of a group in earlier ranges, a small table, is added.
    """
    from psephos.sources.io import written

    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    numbered = written(ranged.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "placed")
    own = numbered.groupBy(*by, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.select(*by, "_range", "_first", before.alias("_before"))  # a row for each group and range
    few = starts.count() <= 1_000_000
    return numbered.join(F.broadcast(starts) if few else starts, [*by, "_range"]).withColumn(to, F.col("_row") - F.col("_first") + F.col("_before")).drop("_range", "_row", "_first", "_before")


def dense_ids(df: DataFrame, key: list[str], to: str) -> DataFrame:
    """Adds dense ids from 0 in the order of the distinct values of a string key.  Keys are made distinct first and ranked by leading characters; a key may have any number of rows."""
    (name,) = key
    keys = df.select(name).distinct().where(F.col(name).isNotNull())
    ordered = global_rank(keys, [F.substring(name, 1, 4), F.substring(name, 1, 16)], [name], to)
    return df.join(sent_if_few(ordered.select(name, F.col(to).cast("long").alias(to)), "dense_ids"), name)


def islands(df: DataFrame, partition: list[str], order: list[str], starts: Column, to: str) -> DataFrame:
    """Gaps and islands: numbers runs from 0 within a partition; `starts` says, by window functions, where a new run begins."""
    w = Window.partitionBy(*partition).orderBy(*order)
    flagged = df.withColumn("_starts", F.coalesce(starts.cast("int"), F.lit(1)))
    return flagged.withColumn(to, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_starts")


def sorted_by_keys(rows: DataFrame, keys: DataFrame, on: list[str], key: str, to: str = "place") -> DataFrame:
    """rows with their place, from 0, by a key that another table holds (on, key), then by `on`; rows without a key, or with a null one, are dropped."""
    keyed = rows.join(keys.where(F.col(key).isNotNull()).select(*on, key), on)
    return global_rank(keyed, [F.col(key)], on, to)


def trimmed_mean(df: DataFrame, by: str, value: str, order: list[str], share: float = 0.25) -> DataFrame:
    """Mean of each group's values without the least and the greatest share of them.  Places come from counts by value, so a large group has many tasks."""
    placed = global_rank(df.select(by, value, *order), [F.col(by), F.col(value)], order, "_place")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    firsts = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each group
    r, cut = F.col("_place") - F.col("_first"), F.floor(F.col("_n") * share)
    return placed.join(firsts, by).where((r >= cut) & (r < F.col("_n") - cut)).groupBy(by).agg(F.avg(value).alias("mean"))
