"""Exact order statistics without gathering a group in one task.

Spark's `percentile` keeps every distinct value of a group in one aggregation buffer.
Here the values are counted first (a hot value becomes one row), a one-row sketch cuts
the value range into cells of about equal size, the cells are counted, and only the
cells that hold a wanted rank are sorted. The sketch only spreads the work: a cell is
described by its smallest and largest value and by the number of rows below it, so the
result is exact for any cut points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 5  # 4**5 = 1024 cells
SHARDS = 32  # spreads a hot group when ranks are looked up per group

_VALUE, _COUNT = "_value", "_count"


def value_counts_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with their number of rows."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias(_VALUE))
        .agg(F.count(F.lit(1)).alias(_COUNT))
    )


def _with_cell(df: DataFrame, levels: int) -> DataFrame:
    """Add `_cell`, the number of cut points not above the value.

    A four-way search in the sorted cuts, one projection per level: the steps stay in
    generated code, which a lambda over the array would leave.
    """
    kept = [f"`{name}`" for name in df.columns]
    df = df.selectExpr(*kept, "0 AS _cell")
    for level in reversed(range(levels)):
        step = 4**level
        moves = [f"if(get(_cuts, _cell + {k * step - 1}) <= {_VALUE}, {step}, 0)" for k in (1, 2, 3)]
        df = df.selectExpr(*kept, f"_cell + {' + '.join(moves)} AS _cell")
    return df


def _same_group(left: str, right: str, by: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}")) for key in by]


def values_at_ranks(
    counts: DataFrame,
    wanted: Callable[[Column], Column],
    by: Sequence[str] = (),
    few_groups: bool = False,
    levels: int = LEVELS,
    shards: int = SHARDS,
) -> DataFrame:
    """Values at 0-based ranks, per group.

    `counts` has the group keys, `_value` and `_count`. `wanted` maps the number of
    rows of a group to an array of structs with a BIGINT field `rank`; the other fields
    are passed through. `few_groups` says that the number of groups is fixed by the
    code (the columns of a table, say), so that the wanted ranks may be broadcast.
    Returns the group keys, `want` and `value`.
    """
    by = list(by)
    # The filter keeps the count alive in this branch too, so that all three branches
    # read one shuffle of the counted values. An aggregate without keys is one row.
    size = 4**levels
    inner = F.split(F.lit(",".join(str(i / size) for i in range(1, size))), ",").cast("array<double>")
    cuts = counts.where(F.col(_COUNT) > 0).agg(
        F.percentile_approx(_VALUE, inner, 2 * size).alias("_cuts")
    )
    cells = (
        _with_cell(counts.crossJoin(F.broadcast(cuts)), levels)
        .groupBy(*by, "_cell")
        .agg(
            F.sum(_COUNT).alias("_rows"), F.min(_VALUE).alias("_low"), F.max(_VALUE).alias("_high")
        )
    )
    # At most 4**levels rows per group.
    group = Window.partitionBy(*by)
    upto = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    targets = (
        cells.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows"))
        .withColumn("_total", F.sum("_rows").over(group))
        .withColumn("want", F.explode(wanted(F.col("_total"))))
        .where(
            (F.col("want.rank") >= F.col("_before"))
            & (F.col("want.rank") < F.col("_before") + F.col("_rows"))
        )
        .select(*by, "want", "_before", "_low", "_high")
    )
    in_cell = F.col(_VALUE).between(F.col("_low"), F.col("_high"))
    if not by or few_groups:
        on = reduce(lambda a, b: a & b, _same_group("c", "t", by), in_cell)
        found = counts.alias("c").join(F.broadcast(targets.alias("t")), on)
    else:
        shard = F.pmod(F.xxhash64(_VALUE), F.lit(shards)).cast("int")
        spread = targets.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        on = reduce(lambda a, b: a & b, _same_group("c", "t", by), in_cell)
        found = (
            counts.withColumn("_shard", shard)
            .alias("c")
            .join(spread.alias("t"), on & (F.col("c._shard") == F.col("t._shard")))
        )
    found = found.select(
        *[f"c.{key}" for key in by], _VALUE, _COUNT, "want", "_before", F.col("want.rank").alias("_rank")
    )
    running = (
        Window.partitionBy(*by, "_rank", "want")
        .orderBy(_VALUE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        found.withColumn("_upto", F.col("_before") + F.sum(_COUNT).over(running))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col(_COUNT)))
        .select(*by, "want", F.col(_VALUE).alias("value"))
    )


def _around(probs: Sequence[float]) -> Callable[[Column], Column]:
    """The two ranks around each quantile position, with the weight of the upper one."""

    def wanted(total: Column) -> Column:
        ranks = []
        for prob in probs:
            position = F.lit(float(prob)) * (total - F.lit(1)).cast("double")
            low = F.floor(position).cast("bigint")
            for rank in (low, F.ceil(position).cast("bigint")):
                ranks.append(
                    F.struct(
                        F.lit(float(prob)).alias("prob"),
                        (position - low).alias("weight"),
                        rank.alias("rank"),
                    )
                )
        return F.array_distinct(F.array(*ranks))

    return wanted


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation as rows (by..., prob, quantile)."""
    typed = df.select(*by, F.col(value).cast("double").alias(value))
    at = values_at_ranks(value_counts_of(typed, value, by), _around(probs), by, few_groups)
    low, high = F.min("value"), F.max("value")
    return at.groupBy(*by, F.col("want.prob").alias("prob")).agg(
        (low + (high - low) * F.max("want.weight")).alias("quantile")
    )


def quantile_row(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The quantiles of one column as exactly one row; null when there is no value."""
    typed = df.select(F.col(value).cast("double").alias(value))
    at = values_at_ranks(value_counts_of(typed, value), _around(probs))
    row = []
    for prob, name in zip(probs, names, strict=True):
        here = F.col("want.prob") == F.lit(float(prob))
        low, high = F.min(F.when(here, F.col("value"))), F.max(F.when(here, F.col("value")))
        weight = F.max(F.when(here, F.col("want.weight")))
        row.append((low + (high - low) * weight).alias(name))
    return at.agg(*row)


def approximate_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """The same rows from Spark's quantile sketch, for when a rank error is acceptable."""
    listed = F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], accuracy)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), listed.alias("quantile"))
    return df.groupBy(*by).agg(pairs.alias("_pairs")).select(*by, F.inline("_pairs"))
