"""Quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning with the non-negative unbiased risk (Kiryo et al., 2017): for a
class prior p, loss l and network g the risk is

    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g))

Where the second part turns negative in a batch, the step goes up that part instead. Labelled
negatives never enter the risk. A text is described by the style of the whole text: cases,
symbols, digits, word lengths, and how much of its words, word runs and lines is repeated.
The network is small, trained in numpy on a bounded sample, and scored in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridecast.llm import hashing
from ridecast.llm.scratch import text_chunks

#: Bounds of the training sample, in rows.
POSITIVE_ROWS, UNLABELLED_ROWS = 4000, 8000

SHARES = (
    "upper", "digit", "symbol", "pipe", "mark", "same", "white", "beyond_ascii",
    "distinct_words", "distinct_runs", "distinct_lines", "commonest_word", "echo", "long_words", "one_letter_words",
)
FEATURES = (*SHARES, *(f"log_{x}" for x in SHARES), "log_words", "word_length", "log_line")

_UPPER, _DIGIT, _SYMBOL, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL[33:127] = ~(_LETTER | _DIGIT)[33:127]
_MARK[[44, 46, 63]] = True  # comma, full stop, question mark
_NEW_LINE = np.zeros(256, bool)
_NEW_LINE[[10, 13]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (running[offsets[1:]] - running[offsets[:-1]]).astype(float)


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its commonest."""
    distinct, most = np.zeros(n), np.zeros(n)
    edges = np.searchsorted(text, np.arange(n + 1))
    for i in range(n):
        part = values[edges[i] : edges[i + 1]]
        if len(part):
            counts = np.unique(part, return_counts=True)[1]
            distinct[i], most[i] = len(counts), counts.max()
    return distinct, most


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of texts laid end to end; an empty text has those of no words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper = _UPPER[data]
    # Capital letters of Latin-1, two bytes long in UTF-8.
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & _SYMBOL[data[1:]]
    words, text, first, last = hashing.words(data, offsets)
    count = np.bincount(text, minlength=n).astype(float)
    least = np.maximum(count, 1)
    letters = np.maximum(_per_text(_LETTER[data], offsets), 1)
    run, run_text, _ = hashing.runs(words, text, n, 3)
    lines, line_text, line_first, line_last = hashing.words(data, offsets, _NEW_LINE, lower=False)
    n_runs, n_lines = (np.bincount(x, minlength=n).astype(float) for x in (run_text, line_text))
    distinct_words, commonest = _distinct(words, text, n)
    distinct_runs, _ = _distinct(run, run_text, n)
    distinct_lines, _ = _distinct(lines, line_text, n)
    length = last - first
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shares = np.stack(
        [
            _per_text(upper, offsets) / letters,
            _per_text(_DIGIT[data], offsets) / size,
            _per_text(_SYMBOL[data] & ~_MARK[data], offsets) / size,
            _per_text(data == ord("|"), offsets) / least,
            _per_text(_MARK[data], offsets) / least,
            _per_text(same, offsets) / size,
            _per_text(hashing.WHITE[data], offsets) / size,
            _per_text(data >= 128, offsets) / size,
            distinct_words / least,
            distinct_runs / np.maximum(n_runs, 1),
            distinct_lines / np.maximum(n_lines, 1),
            commonest / least,
            np.bincount(text[echo], minlength=n) / least,
            np.bincount(text[length >= 15], minlength=n) / least,
            np.bincount(text[length == 1], minlength=n) / least,
        ],
        1,
    )
    line = np.bincount(line_text, line_last - line_first, n) / np.maximum(n_lines, 1)
    rest = np.stack([np.log1p(count), np.bincount(text, length, n) / least, np.log1p(line)], 1)
    return np.concatenate([shares, np.log(shares + 1e-3), rest], 1)


@dataclass
class QualityModel:
    """Standardised features, one hidden layer, the log odds of a good text."""

    centre: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float
    report: dict = field(default_factory=dict)

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.spread, -8, 8)
        return np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_arrays(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 16, epochs: int = 60, rate: float = 0.01, seed: int = 3
) -> QualityModel:
    """Minimise the non-negative risk with the logistic loss by Adam, in mixed batches."""
    random = np.random.default_rng(seed)
    centre, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - centre) / spread, -8, 8) for x in (positive, unlabelled))
    weights = [random.normal(0, 0.3, (p.shape[1], units)), np.zeros(units), random.normal(0, 0.3, units), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    batches = max(1, len(u) // 256)
    for _ in range(epochs):
        for pi, ui in zip(
            np.array_split(random.permutation(len(p)), batches), np.array_split(random.permutation(len(u)), batches), strict=True
        ):
            if not len(pi) or not len(ui):
                continue
            x = np.concatenate([p[pi], u[ui]])
            h = np.tanh(x @ weights[0] + weights[1])
            g = h @ weights[2] + weights[3][0]
            chance, n = _chance(g), len(pi)
            # Of l(g) = log(1 + e^-g) the slope is chance - 1, of l(-g) it is chance.
            negative = np.log1p(np.exp(np.clip(g, -30, 30)))
            rest = negative[n:].mean() - prior * negative[:n].mean()
            back = np.zeros(len(x))
            if rest >= 0:
                back[:n] = prior * (chance[:n] - 1) / n - prior * chance[:n] / n
                back[n:] = chance[n:] / len(ui)
            else:
                back[:n] = prior * chance[:n] / n
                back[n:] = -chance[n:] / len(ui)
            inner = back[:, None] * weights[2] * (1 - h * h)
            slopes = [x.T @ inner + 1e-4 * weights[0], inner.sum(0), h.T @ back + 1e-4 * weights[2], np.array([back.sum()])]
            step += 1
            for w, s, a, b in zip(weights, slopes, first, second, strict=True):
                a *= 0.9
                a += 0.1 * s
                b *= 0.999
                b += 0.001 * s * s
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return QualityModel(centre, spread, weights[0], weights[1], weights[2], float(weights[3][0]), prior)


def _described(texts: DataFrame) -> DataFrame:
    """Rows (kind, text) to (kind, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(list(describe(data, offsets)), pa.list_(pa.float64())),
                    ],
                    ["kind", "features"],
                )

    return texts.mapInArrow(run, "kind string, features array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
) -> QualityModel | None:
    """Train on about the given numbers of positive and of unlabelled rows where `learn` holds.

    Both samples are chosen by a hash of the id. The class prior is estimated as the share of
    positives among the learning rows that have a label, held within 0.05 to 0.99. A label
    repeated for an id counts once (the largest); null labels and texts are left out.
    Without a positive row there is no model.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("_label"))
    usable = docs.where(learn & F.col(text_column).isNotNull())
    counts = (
        usable.select(F.col(id_column).alias("_doc"))
        .join(known, F.col("_doc") == F.col("_id"), "left")
        .agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"), F.count(F.when(F.col("_label") == 1, 1)).alias("good"))
        .first()
    )
    if not counts["good"]:
        return None
    prior = min(0.99, max(0.05, counts["good"] / counts["labelled"]))

    def draw(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.col(id_column), F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)

    wanted = draw(11) < min(1.0, positive_rows / counts["good"])
    good = known.where(F.col("_label") == 1).withColumnRenamed("_id", id_column).where(wanted).select(F.col(id_column).alias("_id"))
    # The drawn ids are the sample, of about `positive_rows` rows whatever the input.
    positives = usable.join(F.broadcast(good), F.col(id_column) == F.col("_id")).select(F.lit("p").alias("kind"), F.col(text_column).alias("text"))
    web = usable.where(draw(12) < min(1.0, unlabelled_rows / counts["n"])).select(
        F.lit("u").alias("kind"), F.col(text_column).alias("text")
    )
    sample = _described(positives.unionByName(web)).toArrow()
    kinds = np.array(sample["kind"].to_pylist())
    features = np.array(sample["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(features.T)  # not the order in which tasks end
    kinds, features = kinds[order], features[order]
    if not (kinds == "p").any() or not (kinds == "u").any():
        return None
    model = fit_arrays(features[kinds == "p"], features[kinds == "u"], prior)
    model.report = {"positives": int((kinds == "p").sum()), "unlabelled": int((kinds == "u").sum()), "prior": prior}
    return model


def score(docs: DataFrame, model: QualityModel | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the chance of a good text.

    A null text is scored like an empty one. Without a model every score is 0.5. A column
    of `docs` named like the result is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None:
                for first, end, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                    scores[first:end] = _chance(model.log_odds(describe(data, offsets)))
            kept = batch.select(list(range(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores)], [*kept.schema.names, score_column])

    kept = docs.drop(score_column)
    schema = StructType(list(kept.schema.fields)).add(score_column, "double")
    return kept.withColumn("_whole_text", F.col(text_column)).mapInArrow(run, schema)
