"""Ordered per-group logic that never puts a whole group into one task.

A window over a hot key sends the key's rows to a single task.  Here rows are range-partitioned
by (group, order), so a hot group spreads over many partitions; each partition computes its own
running value and a small table of carries (at most one row per partition) joins the pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.session import cut_lineage, tasks

_PART = "_part"


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums and maxima up to the current row, and values of the previous row.

    ``order`` must be unique within a group and neither key may hold NULL.  The previous row is
    the one before in the same group; it is NULL on a group's first row.
    """
    sums, maxes, previous = dict(sums or {}), dict(maxes or {}), dict(previous or {})
    group, order = list(group), list(order)
    inputs = {f"_in_{name}": expr for name, expr in {**sums, **maxes}.items()}
    ranged = (
        df.withColumns(inputs) if inputs else df
    ).repartitionByRange(tasks(df.sparkSession), *group, *order).withColumn(_PART, F.spark_partition_id())
    # The written copy fixes which rows sit in which partition, whatever is recomputed later.
    ranged = cut_lineage(ranged)

    here = Window.partitionBy(_PART, *group).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {}
    partials: list[Column] = [F.count(F.lit(1)).alias("_n")]
    carries: list[Column] = []
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    for name in sums:
        local[f"_local_{name}"] = F.sum(f"_in_{name}").over(so_far)
        partials.append(F.sum(f"_in_{name}").alias(f"_sum_{name}"))
        carries.append(F.sum(f"_sum_{name}").over(before).alias(f"_carry_{name}"))
    for name in maxes:
        local[f"_local_{name}"] = F.max(f"_in_{name}").over(so_far)
        partials.append(F.max(f"_in_{name}").alias(f"_max_{name}"))
        carries.append(F.max(f"_max_{name}").over(before).alias(f"_carry_{name}"))
    last = Window.partitionBy(*group).orderBy(_PART)
    for name, source in previous.items():
        local[f"_local_{name}"] = F.lag(F.struct(F.col(source).alias("v"))).over(here)
        partials.append(
            F.max_by(F.struct(F.col(source).alias("v")), F.struct(*order)).alias(f"_last_{name}")
        )
        carries.append(F.lag(f"_last_{name}").over(last).alias(f"_carry_{name}"))

    carry = (
        ranged.groupBy(_PART, *group)
        .agg(*partials)
        .select(_PART, *group, F.count(F.lit(1)).over(before).alias("_pieces"), *carries)
        .where(F.col("_pieces") > 0)
        .drop("_pieces")
    )
    # A partition continues at most one group of the one before it, so this side never has
    # more rows than there are shuffle partitions.
    joined = ranged.withColumns(local).join(F.broadcast(carry), [_PART, *group], "left")
    out: dict[str, Column] = {}
    for name in sums:
        out[name] = F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) + F.col(f"_local_{name}")
    for name in maxes:
        out[name] = F.greatest(F.col(f"_carry_{name}"), F.col(f"_local_{name}"))
    for name in previous:
        out[name] = F.coalesce(F.col(f"_local_{name}"), F.col(f"_carry_{name}"))["v"]
    return joined.withColumns(out).select(*df.columns, *out)


def positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, start: int = 1
) -> DataFrame:
    """Number the rows of each group from ``start`` in ``order``; no group means the whole table."""
    numbered = scan(df, group, order, sums={name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) + F.lit(start - 1).cast("long"))


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their 1-based rank.

    Spark prunes to that many rows per group and task before the shuffle (WindowGroupLimit), so a
    hot group ships few rows, but only up to its own threshold.  Beyond that the rows are numbered
    by ``positions``, which spreads a group over tasks; ``order`` may then hold no NULL.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit > threshold:
        return _first_of_many(df, group, order, limit)
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def _first_of_many(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """The same for any ``limit``, without a window over a group: rows are sorted by range, then numbered in pieces."""
    by = [*[F.col(name) if isinstance(name, str) else name for name in group], *[F.col(x) if isinstance(x, str) else x for x in order]]
    spread = cut_lineage(df.repartitionByRange(tasks(df.sparkSession), *by).withColumn(_PART, F.spark_partition_id()))
    here = Window.partitionBy(_PART, *group).orderBy(*by[len(group):])
    counts = spread.groupBy(_PART, *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per partition continues a group of the partition before, as in ``scan``.
    carry = counts.withColumn("_carry", F.sum("_n").over(before)).where(F.col("_carry").isNotNull()).drop("_n")
    ranked = spread.withColumn("rank", F.row_number().over(here)).join(F.broadcast(carry), [_PART, *group], "left")
    ranked = ranked.withColumn("rank", (F.coalesce("_carry", F.lit(0)) + F.col("rank")).cast("long"))
    return ranked.where(F.col("rank") <= limit).select(*df.columns, "rank")


def left_join_spread(df: DataFrame, dimension: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """A left join on ``key`` in which rows whose key is NULL are dealt out by ``spread``.

    They match nothing, so all that matters is that they do not all go to the task of NULL.
    """
    known = F.col(key).isNotNull()
    left = df.withColumns({"_known": known, "_at": F.coalesce(F.col(key).cast("long"), F.xxhash64(*spread))})
    right = dimension.withColumnRenamed(key, "_at").withColumn("_known", F.lit(True))
    return left.join(right, ["_known", "_at"], "left").drop("_known", "_at")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the lowest by ``order``; partial aggregation runs before the shuffle."""
    row = F.struct(*[F.col(name) for name in df.columns])
    picked = df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    row = F.struct(*[F.col(name) for name in df.columns])
    picked = df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")
