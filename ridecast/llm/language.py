"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: runs of two to four bytes of a word,
its edges marked, hashed to a fixed number of rows. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows; part of the
sample is kept back to calibrate the temperature of the probabilities and the bounds below
which a text is rejected: of its probability, and of its familiarity, the largest over the languages
of the mean logarithm of its subwords' shares in their learned texts. A softmax can be sure of a text of no
learned language, so the second bound is set between the kept-back texts in their own
language and the same texts in the best other one, and lies lower for texts of few subwords. Scoring reads whole texts, and two small
tables (row by language: the product of embeddings and softmax weights, the logarithms of
the shares) go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridecast.llm.hashing import NO_LETTER
from ridecast.llm.scratch import text_chunks

ROWS_BITS, DIMENSIONS = 16, 16
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"
#: Share of right calibration answers that may be below a bound; of out-of-language ones that may be above.
LOW, HIGH = 0.005, 0.05
#: Added to every subword's share: that of one not learned.
UNSEEN = 1e-7

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int = ROWS_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of every subword of lower-case texts laid end to end; places ascend.

    Each run of other bytes than letters counts as the edge of a word, as do the ends of a text.
    """
    n = len(data)
    if n < 2:
        return
    edge = NO_LETTER[data]
    codes = np.where(edge, np.uint8(0), data).astype(np.uint32)
    last = np.zeros(n, bool)  # the last byte of a text
    ends = offsets[1:] - 1
    last[ends[ends >= 0]] = True
    within = np.ones(n, bool)  # no text ends before the run's last byte
    inner = np.ones(n, bool)  # no edge between the run's first and last byte
    for size in (2, 3, 4):
        m = n - size + 1
        if m <= 0:
            return
        within = within[:m] & ~last[size - 2 : size - 2 + m]
        if size > 2:
            inner = inner[:m] & ~edge[size - 2 : size - 2 + m]
        keep = within & inner[:m]
        if size == 2:
            keep &= ~(edge[:m] & edge[1:])
        place = np.flatnonzero(keep)
        value = np.full(len(place), size, np.uint32)
        for k in range(size):
            value += (codes[place + k] + np.uint32(1)) * _MULTIPLIERS[k]
            value ^= value >> np.uint32(15)
        value *= _MULTIPLIERS[0]
        yield (value >> np.uint32(32 - bits)).astype(np.int32), place


#: Bytes of texts that are learned from or scored at once; a subword takes some 50 bytes meanwhile.
CHUNK_BYTES = 256 << 10
#: How far a short text's mean may lie below the bound: deviations of its mean, and the subwords a byte is in.
DEVIATIONS, OVERLAP = 3.0, 3


def _sums(tables: Sequence[np.ndarray], data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its subwords' rows of the tables, side by side, and their number."""
    n, columns = len(offsets) - 1, [table[:, k] for table in tables for k in range(table.shape[1])]
    total, count = np.zeros((n, len(columns))), np.zeros(n)
    for rows, place in subwords(data, offsets, bits):
        edges = np.searchsorted(place, offsets)
        running = np.zeros(len(rows) + 1)
        for k, column in enumerate(columns):
            np.cumsum(column[rows], dtype=np.float64, out=running[1:])
            total[:, k] += running[edges[1:]] - running[edges[:-1]]
        count += np.diff(edges)
    return total, count


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # hashed row by language
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # a text with a lower probability is rejected
    familiar: np.ndarray | None = None  # hashed row by language: logarithm of its share
    least_familiar: float = -np.inf  # a long text with a lower mean of them in each language is rejected
    spread: float = 0.0  # deviation of the logarithms of one text's subwords
    bits: int = ROWS_BITS
    report: dict = field(default_factory=dict)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its logits and its familiarity, by language, and its number of subwords."""
        total, count = _sums([self.table, self.familiar], data, offsets, self.bits)
        means = total / np.maximum(count, 1)[:, None]
        return means[:, : len(self.languages)] + self.bias, means[:, len(self.languages) :], count

    def strange(self, familiar: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether texts are familiar in no learned language; the mean of few subwords may be lower by chance."""
        chance = DEVIATIONS * self.spread * np.sqrt(OVERLAP / np.maximum(count, 1))
        return familiar.max(1) < self.least_familiar - chance


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_arrays(
    rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, languages: list[str],
    bits: int = ROWS_BITS, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 8.0, seed: int = 7,
) -> LanguageModel:
    """Train on texts given as their subword rows with counts; a fifth of them calibrates."""
    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.1, (1 << bits, dimensions))
    weights, bias = np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    order = random.permutation(len(rows))
    held = order[: len(rows) // 5]
    train = order[len(rows) // 5 :]

    def means(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        idx = np.concatenate([rows[i] for i in batch])
        share = np.concatenate([counts[i] / counts[i].sum() for i in batch])
        of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
        edges = np.concatenate([[0], np.cumsum([len(rows[i]) for i in batch])[:-1]])
        return np.add.reduceat(embeddings[idx] * share[:, None], edges, 0), idx, share, of

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for first in range(0, len(train), 16):
            batch = train[first : first + 16]
            mean, idx, share, of = means(batch)
            wrong = _softmax(mean @ weights + bias)
            wrong[np.arange(len(batch)), labels[batch]] -= 1
            wrong /= len(batch)
            back = (wrong @ weights.T)[of] * share[:, None]
            weights -= step * mean.T @ wrong
            bias -= 0.1 * step * wrong.sum(0)
            np.subtract.at(embeddings, idx, step * 20 * back)
        random.shuffle(train)
    model = LanguageModel(languages, (embeddings @ weights).astype(np.float32), bias, bits=bits)
    check = held if len(held) else train
    logits = np.stack([(model.table[rows[i]] * (counts[i] / counts[i].sum())[:, None]).sum(0) + bias for i in check])
    truth = labels[check]
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 5, 30)}
    model.temperature = float(min(losses, key=losses.get))
    chances = _softmax(logits / model.temperature)
    right = chances.argmax(1) == truth
    model.least = float(min(0.5, np.quantile(chances.max(1)[right], LOW) / 2)) if right.any() else 0.0
    shares = np.zeros((1 << bits, len(languages)))
    for i in train:
        shares[rows[i], labels[i]] += counts[i] / counts[i].sum()
    shares /= np.maximum(shares.sum(0), 1e-12)
    model.familiar = np.log(shares + UNSEEN).astype(np.float32)
    known = np.stack([(model.familiar[rows[i]] * (counts[i] / counts[i].sum())[:, None]).sum(0) for i in check])
    own = known[np.arange(len(check)), truth]
    others = known.copy()
    others[np.arange(len(check)), truth] = np.log(UNSEEN)  # alone if there is one language
    inside = float(np.quantile(own[right], LOW)) if right.any() else -np.inf
    outside = float(np.quantile(others.max(1), 1 - HIGH))
    # Half way between the two, and never above what right answers have.
    model.least_familiar = min(inside, (inside + outside) / 2)
    squares = [(model.familiar[rows[i], labels[i]].astype(float) ** 2 * (counts[i] / counts[i].sum())).sum() for i in check]
    model.spread = float(np.sqrt(np.maximum(np.array(squares) - own**2, 0)).mean())
    sizes = np.array([counts[i].sum() for i in check])
    model.report = {
        "checked": len(check), "right": float(right.mean()), "loss": float(losses[model.temperature]), "least": model.least,
        "least_familiar": model.least_familiar, "own_rejected": float(model.strange(known, sizes).mean()),
        "other_rejected": float(model.strange(others, sizes).mean()),
    }
    return model


def fit(
    docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE,
    text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", bits: int = ROWS_BITS,
) -> LanguageModel | None:
    """Train on about `per_language` rows of each language among the rows where `learn` holds.

    The sample is chosen by a hash of the id, so it is the same after any repartitioning, and
    its size has that bound whatever the table's. Rows without text or language are left
    out. Without any such row there is no model.
    """
    label, text = F.col(label_column).cast("string"), F.col(text_column)
    labelled = docs.where(learn & label.isNotNull() & text.rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for first, end, data, offsets in text_chunks(pc.utf8_lower(batch.column(1)), CHUNK_BYTES):
                pieces: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in range(end - first)]
                for hashed, place in subwords(data, offsets, bits):
                    edges = np.searchsorted(place, offsets)
                    for i in range(end - first):
                        pieces[i].append(hashed[edges[i] : edges[i + 1]])
                out = [np.unique(np.concatenate(x), return_counts=True) for x in pieces]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": labels[first:end],
                        "rows": pa.array([x.astype(np.int32) for x, _ in out], pa.list_(pa.int32())),
                        "counts": pa.array([c.astype(np.int32) for _, c in out], pa.list_(pa.int32())),
                    }
                )

    sample = (
        labelled.where(draw < F.element_at(shares, label))
        .select(label.alias("label"), text.alias("text"))
        .mapInArrow(features, "label string, rows array<int>, counts array<int>")
        .toArrow()
    )
    rows = [np.asarray(x.values) for x in sample["rows"]]
    counts = [np.asarray(x.values, float) for x in sample["counts"]]
    usable = [i for i, r in enumerate(rows) if len(r)]
    if not usable:
        return None
    at = {language: i for i, language in enumerate(languages)}
    labels = np.array([at[x] for x in sample["label"].to_pylist()])
    # The order of the rows must not depend on the tasks that end first.
    usable.sort(key=lambda i: (labels[i], len(rows[i]), rows[i].tobytes(), counts[i].tobytes()))
    return fit_arrays([rows[i] for i in usable], [counts[i] for i in usable], labels[usable], languages, bits)


def predict(
    docs: DataFrame, model: LanguageModel | None, text_column: str = "text",
    lang_column: str = "lang_pred", score_column: str = "score", rejected_column: str = "rejected",
) -> DataFrame:
    """All rows and columns of `docs`, with the language, its probability and whether it is rejected.

    A null text, or one without a letter, is "und" with score 0 and rejected. Without a model, every
    text is "und" with score 0 and rejected. Any other text gets a learned language; it is rejected if its
    calibrated probability or its familiarity is below the model's bound. Columns of `docs` that have a
    result's name are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x hashed rows, fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            lettered = batch.column(batch.num_columns - 1)
            plain = batch.select(list(range(batch.num_columns - 1)))
            known = np.asarray(lettered.fill_null(False))
            column = pc.if_else(lettered, pc.utf8_lower(plain.column(place)), None)
            names, chances, strange = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if model is not None and known.any():
                for first, end, data, offsets in text_chunks(column, CHUNK_BYTES):
                    logits, familiar, count = model.logits(data, offsets)
                    p = _softmax(logits / model.temperature)
                    best = p.argmax(1)
                    strange[first:end] = model.strange(familiar, count)
                    for i in np.flatnonzero(known[first:end]):
                        names[first + i] = model.languages[best[i]]
                        chances[first + i] = p[i, best[i]]
            least = model.least if model is not None else 0.0
            rejected = [name == UNKNOWN or c < least or bool(s) for name, c, s in zip(names, chances, strange, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*plain.columns, pa.array(names), pa.array(chances), pa.array(rejected)],
                [*plain.schema.names, lang_column, score_column, rejected_column],
            )

    new = [lang_column, score_column, rejected_column]
    kept = docs.drop(*new)
    place = kept.columns.index(text_column)
    source = kept.select("*", F.col(text_column).rlike(r"\p{L}"))
    schema = StructType(list(kept.schema.fields))
    for name, kind in zip(new, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return source.mapInArrow(score, schema)
