"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Rows of a stratum (a source) are put into a seeded random order and get the fractional
rank (rank - 1/2) / rows of the stratum. Sorting by fractional rank interleaves the
strata in proportion, and cutting the sorted rows into equal runs gives every shard the
mixture of the table, to within one row of each stratum.

No stratum and no sort is the work of one task: ranks and positions are the row number in
a small cell of hash or rank values plus the rows of all cells before it, so a stratum
with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridecast.llm.scratch import written

#: Least number of cells of an order, and the rows a cell holds on large tables.
CELLS, ROWS_PER_CELL = 1024, 20_000


def _numbered(rows: DataFrame, keys: list[str], cell: str, order: list[str], number: str, total: str | None) -> DataFrame:
    """Add the row's number from 1 within `keys` ordered by (cell, order), and the rows of `keys`."""
    counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy(cell) if keys else W.partitionBy().orderBy(cell)
    counts = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col(cell).alias("_at"),
        (F.sum("_rows").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"),
        *([F.sum("_rows").over(W.partitionBy(*keys)).alias(total)] if total else []),
    )
    same: Column = F.col(cell) == F.col("_at")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    number_in_cell = F.row_number().over(W.partitionBy(*keys, cell).orderBy(*order))
    joined = rows.withColumn("_number", number_in_cell).join(counts, same)
    return joined.withColumn(number, F.col("_before") + F.col("_number")).drop(
        "_number", "_before", "_at", *[f"_{k}" for k in keys]
    )


def assign_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "source",
) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, stratum, shard and slot.

    Shard sizes in rows differ by at most one. The size is the text's UTF-8 bytes (none for
    a null text) plus 8. A null stratum is a stratum of its own; rows repeated in the input
    are rows repeated in the result, each with a slot of its own; equal hashes are ordered by
    id, checksum and size. An empty table gives no rows. Other columns of `docs` are ignored,
    whatever their names.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(stratum_column).cast("string").alias("stratum"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")),
        "shard-rows",
    )
    total = rows.count()
    cells = max(CELLS, -(-total // ROWS_PER_CELL))
    rows = rows.withColumn("_cell", F.pmod("_hash", F.lit(cells)))
    ties = ["_hash", "doc_id", "text_crc32", "size"]
    ranked = _numbered(rows, ["stratum"], "_cell", ties, "_rank", "_stratum_rows").drop("_cell")
    ranked = ranked.withColumn("_part", (F.col("_rank") - 0.5) / F.col("_stratum_rows"))
    ranked = ranked.withColumn("_cell", F.floor(F.col("_part") * cells))
    placed = _numbered(ranked, [], "_cell", ["_part", "stratum", *ties], "_position", None)
    position = F.col("_position") - 1
    # ANSI-safe whole-number arithmetic: shard = floor(position * shards / total).
    shard = F.expr(f"(_position - 1) * {shards}L div {max(total, 1)}L")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "stratum", F.col("shard").cast("int").alias("shard"), (position - start).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 17, id_column: str = "doc_id", **columns: str) -> None:
    """Write whole rows into one folder per shard, ordered by slot; ids must be unique."""
    places = assign_shards(docs, shards, seed, id_column, **columns).select(
        F.col("doc_id").alias("_id"), "shard", "slot"
    )
    joined = docs.join(places, docs[id_column].eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
