"""Training texts that hold a benchmark item, whole, edited or paraphrased.

Runs of three words of an item are its seeds, all of them however many training texts have
them: an edited copy may hold only common ones. Where a text has a seed and the words around
it hold enough of the item's words to reach the least score, they are aligned with the item's
words by Smith-Waterman (match 2, mismatch and gap -1), and the score is set against that of
the item itself.

The benchmark is a stated query set. It meets the texts in blocks of bounded size, each
broadcast to the tasks that read the texts, so a benchmark of any size can be used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm import hashing
from ridecast.llm.scratch import HASHED_BYTES, text_chunks, written

SEED_WORDS = 3
#: Least share of the item's own score, and least matching words (all of a shorter item's).
LEAST_SCORE, LEAST_WORDS = 0.5, 8
#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 8 << 20

MATCH, MISS, GAP = 2, -1, -1
#: A score's place in the table's numbers, above the number of matching words.
UNIT = 1 << 32

NO_WORD = hashing.NO_LETTER.copy()
NO_WORD[48:58] = False

#: The column in which lower-case texts travel beside the rows they decide.
LOWER = "_lower_case_text"

SCHEMA = "doc_id long, item_id long, score double, first_word long, words long"


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of hashes: (score, end in item, end in words)."""
    score, _, item_end, end = align_most(item, words)
    return score, item_end, end


def align_most(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matching words, end in item, end in words) of the best local alignment with the most matching words."""
    best = (0, 0, 0)
    slope = -GAP * UNIT * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(item):
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(words == word, MATCH * UNIT + 1, MISS * UNIT), row[1:] + GAP * UNIT)
        np.maximum(step, 0, out=step)
        # A gap in the item: the best of all places to the left, less one for each word passed.
        row = np.maximum.accumulate(step + slope) - slope
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
    return *divmod(best[0], UNIT), *best[1:]


def accepted(score: int, size: int, matching: int | None = None, least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> bool:
    """Whether an alignment counts; without its number of `matching` words, the least that its score needs."""
    matching = -(-score // MATCH) if matching is None else matching
    return matching >= min(size, least_words) and score >= least_score * MATCH * size


class Items:
    """The items of a block as word hashes, and their seeds in ascending order."""

    def __init__(self, rows: list[tuple[int, str]], size: int = SEED_WORDS):
        self.ids = [r[0] for r in rows]
        self.size = size
        self.words: list[np.ndarray] = []
        self.known: list[np.ndarray] = []  # each item's distinct words, ascending
        seeds, owners, places = [], [], []
        for number, (_, text) in enumerate(rows):
            data = np.frombuffer(text.encode(), np.uint8)
            words, of, _, _ = hashing.words(data, np.array([0, len(data)]), NO_WORD, lower=False)
            self.words.append(words)
            self.known.append(np.unique(words))
            run, _, at = hashing.runs(words, of, 1, size, short=False)
            seeds.append(run)
            owners.append(np.full(len(run), number))
            places.append(at)
        none = [np.zeros(0, np.int64)]
        seeds, owners, places = (np.concatenate(x or none) for x in (seeds, owners, places))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners, self.places = seeds[order].astype(np.uint64), owners[order], places[order]

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Which runs are seeds."""
        if not len(self.seeds) or not len(runs):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
        return np.flatnonzero(self.seeds[at] == runs)

    def _may_reach(self, owner: int, words: np.ndarray) -> bool:
        """Whether words hold enough of an item's words for an accepted score; false only if no alignment can have it."""
        known, size = self.known[owner], len(self.words[owner])
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        most = min(size, int(np.count_nonzero(known[at] == words)))
        return accepted(MATCH * most, size, most)

    def search(self, runs: np.ndarray, places: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item id, score, first word, words) of one text: the best place of each item in it.

        `runs` and `places` are the text's hits, `words` all its words.
        """
        near: dict[int, list[tuple[int, int]]] = {}
        lows, highs = np.searchsorted(self.seeds, runs), np.searchsorted(self.seeds, runs, "right")
        for low, high, place in zip(lows, highs, places, strict=True):
            for k in range(low, high):
                near.setdefault(int(self.owners[k]), []).append((int(place), int(self.places[k])))
        for owner, found in sorted(near.items()):
            item, best = self.words[owner], (0, 0, 0)
            size = len(item)
            slack = size  # an accepted alignment leaves out at most as many words of the text as the item has
            windows: list[list[int]] = []
            for place, at in sorted(found):
                low, high = max(0, place - at - slack), min(len(words), place - at + size + slack)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], high)
                else:
                    windows.append([low, high])
            for low, high in windows:
                if not self._may_reach(owner, words[low:high]):
                    continue
                score, matching, item_end, end = align_most(item, words[low:high])
                if score > best[0] and accepted(score, size, matching):
                    # The same alignment backwards from its end gives its first word.
                    _, _, back = align(item[:item_end][::-1], words[low : low + end][::-1])
                    best = (score, low + end - back, back)
            if best[0]:
                yield self.ids[owner], best[0] / (MATCH * size), best[1], best[2]


def find(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each text and item it holds: doc_id, item_id, score, first_word, words.

    `score` is the share of the item's own alignment score, `first_word` and `words` the place
    in the text counted in words (letters and digits, any case). Null or empty texts hold
    nothing; an item without three words is in no text, as such words are in texts that do not
    stem from it; an item with a null id is searched like any other; a repeated text or item gives its
    rows again. Every word of every text is read; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.lower(F.col(text_column)).alias("text"))
    found = [_find_block(texts, items, spark) for items in _blocks(benchmark, item_column, item_text_column, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def _blocks(benchmark: DataFrame, item_column: str, item_text_column: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about the given bytes, at least one."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.lower(F.col(item_text_column)).alias("text"))
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == block).collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # a null id first
        yield Items(rows)


def _held(items: Items, column: pa.Array) -> Iterator[tuple]:
    """(row, item id, score, first word, words) of the lower-case texts of an Arrow column that hold an item."""
    for first, end, data, offsets in text_chunks(column, HASHED_BYTES):
        words, text, _, _ = hashing.words(data, offsets, NO_WORD, lower=False)
        runs, of, at = hashing.runs(words, text, end - first, items.size, short=False)
        hit = items.hits(runs)
        begin = np.searchsorted(text, np.arange(end - first + 1))
        numbers, starts = np.unique(of[hit], return_index=True)  # hits ascend by text
        for number, mine in zip(numbers, np.split(hit, starts[1:]), strict=False):
            own = words[begin[number] : begin[number + 1]]
            for found in items.search(runs[mine], at[mine] - begin[number], own):
                yield first + int(number), *found


def _find_block(texts: DataFrame, items: Items, spark) -> DataFrame:
    held = spark.sparkContext.broadcast(items)  # one block of the benchmark

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[row], *found) for row, *found in _held(held.value, batch.column(1))]
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return texts.mapInArrow(search, SCHEMA)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES, keep_null_ids: bool = True,
) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, with all their columns.

    Each row is decided by its own text: a clean row stays whatever other rows have its id, a
    repeated contaminated row goes each time. Rows with a null id stay, unless `keep_null_ids` is
    false: then their texts decide as well. Rows are filtered where they are read, without a
    join; each block of the benchmark is one more pass over the rows still left.
    """
    spark, lower = docs.sparkSession, LOWER
    while lower in {name.lower() for name in docs.columns}:
        lower += "_"
    blocks = _blocks(benchmark, item_column, item_text_column, block_bytes)
    decided = F.lit(True) if not keep_null_ids else F.col(id_column).isNotNull()
    for number, items in enumerate(blocks):
        held = spark.sparkContext.broadcast(items)  # one block of the benchmark

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in _held(held.value, batch.column(batch.num_columns - 1))]] = False
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

        if number:
            docs = written(docs, "left-of-a-block")  # one block in a worker at a time
        text = F.when(decided, F.lower(F.col(text_column)))
        docs = docs.withColumn(lower, text).mapInArrow(clean, docs.schema)
    return docs
