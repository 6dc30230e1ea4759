"""Drawing documents whose words are as those of a target, by importance of hashed words.

Words are the pieces of an untrained `Split` pre-tokeniser over text with A-Z in lower case; runs
of them, windows over their pairs of offsets, are the features, and CRC-32 hashes a feature
to a bucket. A bucket's gain is the logarithm of its smoothed share in the target over that in
all documents; a document's weight is the mean gain of its features. Gumbel noise from
a hash of the id makes the highest sums a draw without replacement in proportion to the weights.

Texts are read once: the buckets of their features are written, in about a third of the room.
Counting and weighing read those. Only the counts of the fixed number of buckets reach
the driver. Ranks come from one range shuffle of numbers: a row's place in its sorted part after
the lengths of the parts before it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ridecast.llm.scratch import written

#: Fixed value: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, RUN = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Characters that the pre-tokeniser gets at once; words are never cut.
PIECE = 1000
#: Features whose buckets a task keeps; it starts anew beyond that.
KEPT_FEATURES = 200_000

_border = re.compile(BETWEEN)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut between words."""
    first = 0
    while first < len(text):
        border = _border.search(text, first + size) if first + size < len(text) else None
        end = border.end() if border else len(text)
        yield text[first:end]
        first = end


class Buckets(dict):
    """The bucket of a feature, computed when it is first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KEPT_FEATURES:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return bucket


class Features:
    """The features of texts: runs of 1 to `run` words, joined by one space."""

    def __init__(self, run: int = RUN, buckets: int = BUCKETS):
        self.run = run
        self.split = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        self.known = Buckets(buckets)
        self.kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, buckets of all features) of a text with A-Z in lower case."""
        n, out, before = 0, [], []
        for piece in pieces(text):
            found = self.split.pre_tokenize_str(piece)
            n += len(found)
            if self.run == 1:
                out.append(np.fromiter((self.known[word] for word, _ in found), self.kind, len(found)))
                continue
            # Runs that end in this piece; the last words of the pieces before come first.
            words = before + [piece[a:b] for _, (a, b) in found]
            old = len(before)
            ending = [
                self.known[" ".join(words[end - size : end])]
                for end in range(old + 1, len(words) + 1)
                for size in range(1, min(self.run, end) + 1)
            ]
            out.append(np.array(ending, self.kind))
            before = words[1 - self.run :]
        return n, np.concatenate(out) if out else np.zeros(0, self.kind)


def hashed(docs: DataFrame, columns: list[Column], text: Column, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """The given columns with n_words, n_features and the buckets of the text's features as bytes."""
    schema = docs.select(*columns).schema
    names = [*schema.names, "n_words", "n_features", "buckets"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(run, buckets)
        for batch in batches:
            lower = pc.ascii_lower(batch.column(batch.num_columns - 1))
            words, counts, held = [], [], []
            for value in lower:
                n, found = features.of(value.as_py() or "")
                words.append(n)
                counts.append(len(found))
                held.append(found.tobytes())
            arrays = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")
    return docs.select(*columns, text.alias("_text")).mapInArrow(work, schema)


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a hashed table."""
    kind = Features(1, buckets).kind

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = held.select("buckets").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # as many rows as buckets
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln) of its smoothed share in the target over that in the source."""
    k = len(source)
    ratio = (target + 1.0) * (source.sum() + k) / ((source + 1.0) * (target.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """A hashed table with `weight`, the floored mean gain of a row's features (none: 0), for its buckets."""
    kind = Features(1, len(gain)).kind
    kept = [c for c in held.columns if c != "buckets"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for value in batch.column(batch.num_columns - 1):
                found = np.frombuffer(value.as_buffer(), kind)
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weights, pa.int64())], [*kept, "weight"])

    return held.select(*kept, "buckets").mapInArrow(work, held.select(*kept).schema.add("weight", "long"))


@dataclass(frozen=True)
class Draw:
    """Which rows may be drawn, how many in a hundred, and the seed of the noise."""

    least_words: int = LEAST_WORDS
    percent: int = PERCENT
    seed: int = SEED


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(chance))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with `place`, their number from 1 in a global order, without a window over all rows."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = sorted_.select("*", F.monotonically_increasing_id().alias("_row"))
    numbered = written(numbered, "sorted-rows")
    part, within = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("_part", part)
    sizes = numbered.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    # One row a part of the shuffle.
    before = F.coalesce(F.sum("n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_of", before.alias("_before")))
    placed = numbered.join(starts, F.col("_part") == F.col("_of"))
    return placed.withColumn("place", F.col("_before") + within + 1).drop("_row", "_part", "_of", "_before")


def resample(
    docs: DataFrame, target: DataFrame, draw: Draw = Draw(), run: int = RUN, buckets: int = BUCKETS,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_features, weight, score, rank.

    Of the N rows with at least `least_words` words, the floor(percent * N / 100) of the highest
    scores are drawn, ties to the smaller id; their ranks count from 1, others have none. Null
    and wordless texts have no features and weight 0. A row with a null id takes the noise of
    an empty id and comes last among ties; ties of a repeated id keep an order of their own.
    An empty target leaves the gains to the documents' counts, an empty table gives no rows;
    other columns are ignored.
    """
    ids, text = F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)
    held = written(hashed(docs, [ids], text, run, buckets), "hashed-words")
    wanted = written(hashed(target, [], F.col(target_column), run, buckets), "hashed-target")
    gain = gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    able = F.col("n_words") >= draw.least_words
    scored = weighed(held, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), draw.seed))
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    number = held.where(able).count() * draw.percent // 100
    rank = F.when(able & (F.col("place") <= number), F.col("place")).alias("rank")
    return ranked(scored, order).select("doc_id", "n_words", "n_features", "weight", "score", rank)
