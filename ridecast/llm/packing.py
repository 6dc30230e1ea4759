"""Documents into token sequences of a fixed length: bounded-space online best-fit.

Every task packs the pieces of its own documents as they arrive, with a fixed number of
open sequences. They are kept in a bitset keyed by free space, so the open sequence with
the least space that still fits is one bit operation away. When no open sequence fits and
all places are taken, the fullest open sequence closes first. Nothing is shuffled, a task
holds no more than its open sequences, and only the last open sequences of each task are
left as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.token_ids import encoder

LENGTH = 2048
OPEN = 2048
TASK_BITS = 36

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open sequences by free space; `place(n)` gives (sequence number, offset)."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.spaces = 0  # bit f: some open sequence has f free places
        self.by_space: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        sequences = self.by_space[space]
        number = sequences.pop()
        if not sequences:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        if not 1 <= size <= self.length:
            raise ValueError(f"a piece of {size} ids does not fit {self.length}")
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.made
            self.made += 1
        if space > size:
            if self.open == self.most_open:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.by_space[space - size].append(number)
            self.spaces |= 1 << (space - size)
            self.open += 1
        return number, self.length - space


def cut(size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or full pieces after a shorter first one."""
    if size <= length:
        return [(0, size)]
    first = size % length or length
    return [(0, first), *((start, length) for start in range(first, size, length))]


def pack(
    docs: DataFrame,
    vocabulary: str,
    kind: str = "byte",
    end_id: int = 0,
    length: int = LENGTH,
    most_open: int = OPEN,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
    special_as_text: bool = False,
) -> DataFrame:
    """One row per piece: its document, place and checksum, and its ids if `with_ids`.

    A document is the ids of its whole text and `end_id`; a null or empty text is `end_id`
    alone. Rows with equal or null ids are packed like any other; an empty table gives no
    rows; other columns are ignored, whatever their names. A special token's string is that
    token, or ordinary text if `special_as_text`. A retried task gives the same
    pieces, since its order is that of the rows it reads.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, kind, special_as_text).ids
        packer = BestFit(length, most_open)
        base = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                columns: list[list] = [[] for _ in range(8 if with_ids else 7)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = encode(text) + end
                    for piece, (start, size) in enumerate(cut(len(data) // 4, length)):
                        ids = data[4 * start : 4 * (start + size)]
                        sequence, offset = packer.place(size)
                        row = (doc_id, piece, start, size, zlib.crc32(ids), base + sequence, offset, ids)
                        for column, value in zip(columns, row, strict=False):
                            column.append(value)
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
                names = [*(x.split()[0] for x in SCHEMA.split(", ")), "ids"]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
