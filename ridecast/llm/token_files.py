"""Token ids in binary files of fixed-width numbers, written and read by Spark tasks.

Every id takes the least number of bits that holds the vocabulary. 64 ids fill exactly
`bits` 64-bit words, so packing and unpacking are a few numpy shifts over whole columns, and
a block of ids always starts on a word. A file:

    8 bytes   magic
    blocks    `block` ids each, the last one filled up with zeros
    footer    block offsets, document ids, their null marks, document starts
    trailer   eight little-endian 64-bit numbers: bits, ids a block, ids, documents, blocks,
              place of the footer, version, crc32 of the footer
    8 bytes   magic

Each file holds a range of ascending document ids. Its name has the task's attempt; the index
table that the job commits names the files that count, so a repeated task does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridecast.llm.scratch import written
from ridecast.llm.token_ids import encoder
from ridecast.session import file_system, new_shared_path

MAGIC = b"RIDEIDS1"
BLOCK = 4096
RUN = 256  # blocks that are packed or unpacked at once
TRAILER = struct.Struct("<8q")


def width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (a multiple of 64) as little-endian 64-bit words, `bits` words for 64 ids."""
    lanes = np.ascontiguousarray(ids.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((bits, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    lanes = np.empty((64, words.shape[1]), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        lanes[i] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)


class Writer:
    """Streams documents into one file; `close` gives (documents, ids)."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.blocks = 0
        self.doc_ids: list[int | None] = []
        self.starts = [0]
        out.write(MAGIC)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        padded = np.zeros(-(-whole // self.block) * self.block, "<u4")
        padded[:whole] = ids[:whole]
        if len(padded):
            self.out.write(pack_bits(padded, self.bits))
            self.blocks += len(padded) // self.block
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id needs more bits than the file has")
        self.doc_ids.append(doc_id)
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.starts.append(self.ids)
        if self.held >= self.block * RUN:
            self._flush(False)

    def close(self) -> tuple[int, int]:
        self._flush(True)
        size = self.block * self.bits // 8
        offsets = len(MAGIC) + size * np.arange(self.blocks + 1, dtype="<i8")
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        doc_ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        footer = b"".join(x.tobytes() for x in (offsets, doc_ids, known, np.array(self.starts, "<i8")))
        self.out.write(footer)
        numbers = (self.bits, self.block, self.ids, len(doc_ids), self.blocks, int(offsets[-1]), 1, zlib.crc32(footer))
        self.out.write(TRAILER.pack(*numbers) + MAGIC)
        self.out.close()
        return len(doc_ids), self.ids


@dataclass
class Reader:
    """Random access to the documents of one file."""

    file: object

    def __post_init__(self):
        size, tail = self.file.size(), TRAILER.size + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.ids, docs, blocks, place, _, crc = TRAILER.unpack(end[: TRAILER.size])
        footer = self.file.read_at(size - tail - place, place)
        if zlib.crc32(footer) != crc:
            raise ValueError("the footer of a token file is damaged")
        self.offsets = np.frombuffer(footer, "<i8", blocks + 1)
        at = 8 * (blocks + 1)
        doc_ids, known = np.frombuffer(footer, "<i8", docs, at), np.frombuffer(footer, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.starts = np.frombuffer(footer, "<i8", docs + 1, at + 9 * docs)

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids from `first` to `end` of the file; only their blocks are read."""
        if first >= end:
            return np.zeros(0, "<u4")
        a, b = first // self.block, -(-end // self.block)
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return unpack_bits(data, self.bits)[first - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, most_ids: int = BLOCK * RUN) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start, ids) in order, reading about `most_ids` at a time."""
        k, docs = 0, len(self.doc_ids)
        while k < docs:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most_ids, "right")) - 1)
            end = min(end, docs)
            run = self.read(int(self.starts[k]), int(self.starts[end]))
            for i in range(k, end):
                start = int(self.starts[i])
                yield self.doc_ids[i], start, run[start - self.starts[k] : self.starts[i + 1] - self.starts[k]]
            k = end


def write_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    vocabulary_size: int,
    kind: str = "word",
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    special_as_text: bool = False,
) -> DataFrame:
    """Encode every whole text, append `end_id`, and write files in ascending id order.

    Returns the index, a written table: part, file, docs, ids, base (ids of all earlier
    files). A null or empty text is `end_id` alone; a null id comes first; equal ids are
    ordered by text. An empty table makes no file and an empty index. A special token's string
    is that token, or ordinary text if `special_as_text`.
    `folder` is a place all executors reach: a path, or an address that pyarrow opens.
    """
    bits = width(vocabulary_size)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, part = None, "", TaskContext.get().partitionId()
        encode = encoder(vocabulary, kind, special_as_text).ids
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if writer is None:
                        name = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
                        system, path = file_system(name)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        writer = Writer(system.open_output_stream(path), bits)
                    writer.add(doc_id, np.frombuffer(encode(text) + end, "<u4"))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [n_docs], "ids": [n_ids]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    index = written(ordered.mapInArrow(run, "part long, file string, docs long, ids long"), "token-files")
    # One row a file, not a document: a window over all of them is small.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return index.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def read_files(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files of an index: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["file"])
                with system.open_input_file(path) as file:
                    columns: list[list] = [[] for _ in range(5 if with_ids else 4)]
                    for doc_id, start, ids in Reader(file).documents():
                        data = ids.tobytes()
                        values = (doc_id, row["base"] + start, len(ids), zlib.crc32(data), data)
                        for column, value in zip(columns, values, strict=False):
                            column.append(value)
                        if len(columns[0]) == 1024:
                            yield _rows(columns)
                            columns = [[] for _ in columns]
                    if columns[0]:
                        yield _rows(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    spread = index.select("part", "file", "base").repartition(F.col("part"))
    return spread.mapInArrow(run, schema)


def _rows(columns: list[list]) -> pa.RecordBatch:
    types = [*[pa.int64()] * 4, pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])


def new_folder(spark: SparkSession) -> str:
    return new_shared_path(spark, "token-ids")
