"""Toxicity of texts whose words may be disguised: noisy-channel restoring, then scoring.

A disguised word is read as the output of a channel that replaces letters by look-alikes,
puts separators between them or repeats them. Its possible originals are a lattice of
characters; a character language model counted over all texts, times the channel's chances,
picks the likeliest path by Viterbi decoding. Strings that no rule touches have one path,
themselves, and are left as they are.

The restored text is scored by a logistic model over its words and their beginnings, which
inflected forms share, learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridecast.llm import hashing
from ridecast.llm.scratch import text_chunks

#: Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
_SIGNS = "0-9@$!|+*"
#: Single characters with one separator after each, four or more; a string in which a sign
#: comes before a letter; a word with a letter three times in a row.
DISGUISED = re.compile(
    rf"(?<![a-z{_SIGNS}])[a-z{_SIGNS}](?:(?P<gap>[ ._~/-])[a-z{_SIGNS}])(?:(?P=gap)[a-z{_SIGNS}]){{2,}}(?![a-z{_SIGNS}])"
    rf"|(?<![a-z{_SIGNS}])[a-z{_SIGNS}]*[{_SIGNS}][a-z][a-z{_SIGNS}]*"
    r"|(?<![a-z])[a-z]*([a-z])\2\2[a-z]*"
)
SYMBOLS = 28  # the edge of a word, a to z, and a byte of any letter beyond ASCII
BEYOND = 27
#: Costs in natural logarithms: a look-alike, a sign that is no letter, a repeated letter dropped.
SIGN_COST, EDGE_COST, REPEAT_COST = 1.0, 14.0, 0.5
#: Restored strings that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 100
#: Steps of a lattice after which the part that all paths share is settled.
SETTLE_STEPS = 4096

FEATURE_BITS = 20
#: Bounds of the training sample, in rows.
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
#: A word or beginning counts if this many toxic texts have it, and so many standard deviations
#: more of them than its share of all texts would give.
LEAST_TEXTS, LEAST_EXCESS = 5, 5.0
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = BEYOND


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of three symbols in a row over lower-case texts; runs of edges are one edge."""
    code = _CODE[data]
    number = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (number[1:] != number[:-1])
    code, number = code[keep].astype(np.int32), number[keep]
    if len(code) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    one = (number[2:] == number[:-2])
    at = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
    return np.bincount(at[one], minlength=SYMBOLS**3)


def count_characters(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Counts of three symbols in a row over the whole texts of all rows: at, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                total += _trigrams(data, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counted = docs.select(F.lower(F.col(text_column)).alias("text")).mapInArrow(run, "at int, n long")
    return counted.groupBy("at").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log chances of a symbol after two others, from counts of three; shorter contexts help."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3)


def _steps(last: list | None) -> list[list]:
    """The steps of a path, first to last."""
    steps = []
    while last is not None:
        steps.append(last)
        last = last[0]
    return steps[::-1]


def _text(steps: list[list]) -> str:
    return "".join(letters for _, letters in steps)


def _settle(ends: list[list]) -> tuple[str, int]:
    """Cut off the steps that all paths share: their text, and how many steps each path keeps."""
    paths = [_steps(last) for last in ends]
    size = len(paths[0])
    shared = next((k for k in range(size) if any(p[k] is not paths[0][k] for p in paths)), size - 1)
    for path in paths:
        path[shared][0] = None
    return _text(paths[0][:shared]), size - shared


class Restorer:
    """Replaces the disguised strings of lower-case texts by their likeliest originals."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(string: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of one character what it may stand for, with costs."""
        for run in re.finditer(r"(.)\1*", string):
            sign, n = run[1], len(run[0])
            letters = LOOKALIKES.get(sign, "")
            if letters:
                options = [(x * k, SIGN_COST * min(n, 2) + REPEAT_COST * (n - k)) for x in letters for k in {1, min(n, 2)}]
                options.append((" ", EDGE_COST))
            elif n >= 3:
                options = [(sign, REPEAT_COST), (sign * 2, REPEAT_COST)]
            else:
                options = [(sign * n, 0.0)]
            yield options

    def decode(self, string: str) -> str:
        """The likeliest original, in time and memory linear in the string.

        A path is its last step and a pointer to the step before. What all paths have in
        common is settled from time to time, so the pointers kept do not grow with the string.
        """
        model, settled, unsettled, due = self.model, [], 0, SETTLE_STEPS
        paths: dict[tuple[int, int], tuple[float, list | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(string):
            after: dict[tuple[int, int], tuple[float, list | None]] = {}
            for (a, b), (cost, last) in paths.items():
                for letters, more in options:
                    x, y, total = a, b, cost + more
                    for letter in letters:
                        code = ord(letter) - 96 if "a" <= letter <= "z" else 0
                        if code or y:
                            total -= model[x][y][code]
                            x, y = y, code
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, [last, letters])
            paths = after
            unsettled += 1
            if unsettled >= due:
                text, unsettled = _settle([last for _, last in paths.values()])
                settled.append(text)
                due = max(SETTLE_STEPS, 2 * unsettled)
        # The word ends here: the edge is the last symbol.
        ends = ((cost - model[x][y][0] * (y > 0), _text(_steps(last))) for (x, y), (cost, last) in paths.items())
        return "".join([*settled, min(ends)[1]])

    def _original(self, found: re.Match) -> str:
        string = found[0]
        if found["gap"]:
            string = string.replace(found["gap"], "")
        known = self.known.get(string)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            known = self.decode(string)
            if len(string) <= REMEMBERED_LENGTH:
                self.known[string] = known
        return f" {known} " if found["gap"] else known

    def restore(self, text: str) -> str:
        return DISGUISED.sub(self._original, text)


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text number) of the words of texts laid end to end, and of their beginnings."""
    text, first, last = hashing.word_places(data, offsets, hashing.NO_LETTER)
    if not len(first):
        return
    hashes, shift = hashing.spans(data, lower=False), np.uint64(64 - FEATURE_BITS)
    yield (hashes(first, last) >> shift).astype(np.int64), text
    for size in BEGINNINGS:
        long = last - first > size
        begin = first[long]
        yield ((hashes(begin, begin + size) + np.uint64(size)) >> shift).astype(np.int64), text[long]


def _restored(batches: Iterator[pa.RecordBatch], characters: np.ndarray, column: int, wanted: np.ndarray | None) -> Iterator[tuple]:
    """(batch, first row, end row, features, text numbers): the distinct features of restored
    texts, of those alone that are `wanted`."""
    restorer = Restorer(characters)
    for batch in batches:
        texts = pa.array([restorer.restore(t) if t else "" for t in batch.column(column).to_pylist()], pa.large_string())
        for first, end, data, offsets in text_chunks(texts):
            pairs = [np.zeros(0, np.int64)]
            for feature, text in _features(data, offsets):
                if wanted is not None:
                    some = wanted[feature]
                    feature, text = feature[some], text[some]
                pairs.append((text << FEATURE_BITS) | feature)
            distinct = np.unique(np.concatenate(pairs))
            yield batch, first, end, distinct & ((1 << FEATURE_BITS) - 1), distinct >> FEATURE_BITS


@dataclass
class ToxicityModel:
    characters: np.ndarray  # log chances of three symbols
    weights: np.ndarray  # by hashed word
    bias: float
    report: dict = field(default_factory=dict)


def fit_arrays(words: list[np.ndarray], toxic: np.ndarray, shift: float = 0.0, epochs: int = 300) -> tuple[np.ndarray, float]:
    """A logistic model over features that are markedly commoner in toxic texts.

    `shift` is added to the bias: the log odds that the sample's shares took away.
    """
    size = 1 << FEATURE_BITS
    all_of = np.concatenate(words) if words else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(words)), [len(w) for w in words])
    bad, good = (np.bincount(all_of[toxic[text] == k], minlength=size) for k in (1, 0))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    expected = (bad + good) * n_bad / (n_bad + n_good)
    chosen = np.flatnonzero((bad >= LEAST_TEXTS) & (bad - expected >= LEAST_EXCESS * np.sqrt(expected)))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[all_of] >= 0
    idx, text = place[all_of][keep], text[keep]
    w, bias = np.zeros(len(chosen)), math.log(n_bad / n_good)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        z = bias + np.bincount(text, w[idx], len(words))
        wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        slope = np.append(np.bincount(idx, wrong[text], len(chosen)) / len(words) + 2e-4 * w, wrong.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(0, w - move[:-1]), bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return weights, bias + shift


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> ToxicityModel | None:
    """Count the characters of all texts, and learn labels where `learn` holds.

    The samples of about the given numbers of rows are chosen by a hash of the id. A label
    repeated for an id counts once (the largest); null labels and texts are left out. Without
    a toxic or a clean labelled row there is no model.
    """
    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in count_characters(docs, text_column).collect():  # at most SYMBOLS ** 3 rows
        counts[row["at"]] = row["n"]
    characters = language_model(counts)
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("_label"))
    usable = docs.where(learn & F.col(text_column).isNotNull())
    sizes = {
        r["_label"]: r["count"]
        for r in usable.select(F.col(id_column).alias("_doc")).join(known, F.col("_doc") == F.col("_id")).groupBy("_label").count().collect()
    }  # two rows
    if not sizes.get(1) or not sizes.get(0):
        return None
    rates = {1: min(1.0, toxic_rows / sizes[1]), 0: min(1.0, clean_rows / sizes[0])}
    draw = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = known.where(draw < F.when(F.col("_label") == 1, rates[1]).otherwise(rates[0]))
    # The drawn ids are the sample, of about the given numbers of rows whatever the input.
    sample = usable.join(F.broadcast(drawn), F.col(id_column) == F.col("_id")).select("_label", F.lower(F.col(text_column)).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, end, features, text in _restored(batches, held.value, 1, None):
            edges = np.searchsorted(text, np.arange(end - first + 1))
            words = [features[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(words, pa.list_(pa.int32()))], ["label", "words"]
            )

    table = sample.mapInArrow(run, "label int, words array<int>").toArrow()
    toxic = np.array(table["label"].to_pylist(), float)
    words = [np.asarray(x.values, np.int64) for x in table["words"]]
    if not len(words) or toxic.min() == toxic.max():
        return None
    weights, bias = fit_arrays(words, toxic, math.log(rates[0] / rates[1]))
    return ToxicityModel(characters, weights, bias, {"toxic": int(toxic.sum()), "clean": int((1 - toxic).sum())})


def score(docs: DataFrame, model: ToxicityModel | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the chance that the text is toxic.

    A null text is scored like an empty one: the chance of a text without any telling word.
    Without a model every score is 0. A column of `docs` named like the result is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if model is None:
            for batch in batches:
                kept = batch.select(list(range(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.zeros(len(kept)))], [*kept.schema.names, score_column])
            return

        def cut() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 1024):  # few restored texts at a time
                    yield batch.slice(first, 1024)

        for batch, first, end, features, text in _restored(cut(), model.characters, -1, model.weights > 0):
            odds = model.bias + np.bincount(text, model.weights[features], end - first)
            kept = batch.slice(first, end - first).select(list(range(batch.num_columns - 1)))
            chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(chance)], [*kept.schema.names, score_column])

    kept = docs.drop(score_column)
    schema = StructType(list(kept.schema.fields)).add(score_column, "double")
    return kept.withColumn("_lower_case_text", F.lower(F.col(text_column))).mapInArrow(run, schema)
