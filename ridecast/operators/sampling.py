"""Samples, splits and folds that depend only on a row's key and a seed.

Rows are ordered by a hash of their key, so the result is the same for any
partitioning and after any retry. The exact-size forms never sort or limit the table:
they look up the hash at the wanted rank and keep the rows up to it. `key` must
identify a row.

Samples, splits and folds hash their own name with the key, so one can be taken of
another. Two of the same kind on one table need different seeds or salts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridecast.operators.ranks import values_at_ranks

_HASH, _EDGE = "_hash", "_edge"
_CELL_BITS = 16
_HASH_BITS = 48
SAMPLE, SPLIT, FOLD = "sample", "split", "fold"


def row_hash(key: Sequence[str], seed: int, kind: str = "", salt: str = "") -> Column:
    """48 bits of the MD5 of kind, salt, seed and key: a hash every SQL engine has."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in key]
    text = F.concat_ws("|", F.lit(kind), F.lit(salt), F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def _share(hashed: Column) -> Column:
    """A row's place in [0, 1)."""
    return hashed / F.lit(float(1 << _HASH_BITS))


def _order(key: Sequence[str], hashed: Column) -> Column:
    return F.struct(hashed.alias(_HASH), *key)


def _edge_row(df: DataFrame, key: Sequence[str], hash_of_row: Column, rows: Callable[[Column], Column]) -> DataFrame:
    """The ordering value of the last row to take: one row, or none when none is taken.

    The hash is uniform, so its top bits give cells of equal size: they are counted
    (at most 2**16 rows after partial aggregation) and only the cell with the edge is
    ranked.
    """
    hashed = df.select(_order(key, hash_of_row).alias("_at"))
    cell = F.shiftright(F.col(f"_at.{_HASH}"), _HASH_BITS - _CELL_BITS)
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        hashed.groupBy(cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("_wanted", rows(F.sum("_rows").over(Window.partitionBy())).cast("bigint"))
    )
    edge = cells.where(
        (F.col("_wanted") <= F.col("_upto")) & (F.col("_wanted") > F.col("_upto") - F.col("_rows"))
    ).select("_cell", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_nth"))
    ranked = Window.partitionBy("_cell").orderBy("_at")
    return (
        hashed.withColumn("_cell", cell)
        .join(F.broadcast(edge), "_cell")
        .withColumn("_n", F.row_number().over(ranked))
        .where(F.col("_n") == F.col("_nth"))
        .select(F.col("_at").alias(_EDGE))
    )


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 0, salt: str = "") -> DataFrame:
    """About `fraction` of the rows, without replacement, in one pass."""
    return df.where(_share(row_hash(key, seed, SAMPLE, salt)) < F.lit(fraction))


def sample_exact(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 0, salt: str = "") -> DataFrame:
    """Exactly round(fraction * rows) rows, without replacement."""
    hashed = row_hash(key, seed, SAMPLE, salt)
    edge = _edge_row(df, key, hashed, lambda total: F.bround(F.lit(fraction) * total))
    return df.crossJoin(F.broadcast(edge)).where(_order(key, hashed) <= F.col(_EDGE)).drop(_EDGE)


def with_split(
    df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 0, exact: bool = False, salt: str = ""
) -> DataFrame:
    """Add `split` = train / test; the exact form puts ceil(test_size * rows) rows in test.

    To split a part again (a validation part off the training part) give another salt.
    """
    hashed = row_hash(key, seed, SPLIT, salt)
    if exact:
        edge = _edge_row(df, key, hashed, lambda total: F.ceil(F.lit(test_size) * total))
        df = df.join(F.broadcast(edge), F.lit(True), "left")
        test = F.coalesce(_order(key, hashed) <= F.col(_EDGE), F.lit(False))
    else:
        test = _share(hashed) < F.lit(test_size)
    return df.withColumn("split", F.when(test, "test").otherwise("train")).drop(_EDGE)


def train_test(
    df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 0, exact: bool = False, salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, test_size, seed, exact, salt)
    return tuple(marked.where(F.col("split") == part).drop("split") for part in ("train", "test"))


def hash_folds(df: DataFrame, key: Sequence[str], folds: int = 4, seed: int = 0, salt: str = "") -> DataFrame:
    """Add `fold` 0..folds-1 from the key's hash: no shuffle, the default for training."""
    return df.withColumn("fold", F.pmod(row_hash(key, seed, FOLD, salt), F.lit(folds)).cast("int"))


def contiguous_folds(df: DataFrame, order: str, folds: int = 4) -> DataFrame:
    """Add `fold` as unshuffled blocks in the order of a unique numeric column.

    Block sizes differ by at most one, the larger ones first. The first value of each
    block is looked up by rank and broadcast as one row.
    """

    def starts(total: Column) -> Column:
        size, larger = F.floor(total / F.lit(folds)), total % F.lit(folds)
        return F.array(
            *[
                F.struct(
                    F.lit(i).alias("fold"),
                    (F.lit(i) * size + F.least(F.lit(i), larger)).cast("bigint").alias("rank"),
                )
                for i in range(1, folds)
            ]
        )

    # The values are unique, so counting them first would only shuffle the table.
    ones = df.select(F.col(order).alias("_value"), F.lit(1).cast("bigint").alias("_count"))
    firsts = values_at_ranks(ones, starts).agg(
        *[F.min(F.when(F.col("want.fold") == i, F.col("value"))).alias(f"_first{i}") for i in range(1, folds)]
    )
    reached = [
        F.coalesce((F.col(order) >= F.col(f"_first{i}")).cast("int"), F.lit(0)) for i in range(1, folds)
    ]
    return (
        df.crossJoin(F.broadcast(firsts))
        .withColumn("fold", sum(reached, F.lit(0)))
        .drop(*[f"_first{i}" for i in range(1, folds)])
    )
