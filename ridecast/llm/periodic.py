"""Periodic runs of words in texts, found with a suffix automaton and a link-cut tree.

A run is a stretch of words with smallest period q, at least `times` * q and `least` words
long, that no neighbouring word extends keeping the period.

The suffix links of a sequence's automaton form a tree; the suffixes of a prefix are the path from its
state to the root. Words are appended one by one, and each *accesses* its path: the link-cut
tree cuts the path into segments of one colour, the place where the suffixes of that
segment last ended, and recolours it with the new place. Where the last end lies d words back
and a segment's suffixes are at least d words long, they overlap or touch: a square of period
d. The longest suffix of the segment gives the left end of that periodic stretch, and as the words
go on, its right end moves along. The suffixes of a run of period q that are at least q long
last ended exactly q words back, so each run is met at its last word with its period and
whole length.

Before that, whole columns of texts are cut at words that can be in no run: every window of a few words
in a run occurs again in it, at a distance of its period. Windows that do not recur near enough are
left out until nothing changes. On most texts nothing remains; on the rest the automaton is
built for what remains, and the runs are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.llm import hashing
from ridecast.llm.scratch import text_chunks

TIMES, LEAST = 4, 6
#: Rounds of cutting; more would only spare work.
ROUNDS = 8

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, greatest {RUN}, collapsed string"


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of the longest string, suffix link) of each state, and each prefix's state."""
    step: list[dict[int, int]] = [{}]
    length, link, states = [0], [-1], []
    last = 0
    for n, word in enumerate(words, 1):
        state = len(length)
        step.append({})
        length.append(n)
        link.append(0)
        states.append(state)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at >= 0:
            then = step[at][word]
            if length[then] != length[at] + 1:
                # The shorter strings of that state get a state of their own.
                copy = len(length)
                step.append(dict(step[then]))
                length.append(length[at] + 1)
                link.append(link[then])
                link[then] = copy
                while at >= 0 and step[at].get(word) == then:
                    step[at][word] = copy
                    at = link[at]
                then = copy
            link[state] = then
        last = state
    return length, link, states


class LastEnds:
    """A link-cut tree over a tree given by parents: paths to the root in segments of one colour.

    Each splay tree is a path, its keys the depths; its colour stands at its root.
    """

    def __init__(self, parents: list[int]):
        self.up = list(parents)
        self.above = [-1] * len(parents)  # child with smaller depths
        self.below = [-1] * len(parents)
        self.colour = [-1] * len(parents)

    def _rotate(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        p = up[x]
        g = up[p]
        if g >= 0 and above[g] == p:
            above[g] = x
        elif g >= 0 and below[g] == p:
            below[g] = x
        else:  # p was the root of its splay tree
            self.colour[x] = self.colour[p]
        up[x] = g
        if above[p] == x:
            child = above[p] = below[x]
            below[x] = p
        else:
            child = below[p] = above[x]
            above[x] = p
        if child >= 0:
            up[child] = p
        up[p] = x

    def _splay(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        while (p := up[x]) >= 0 and (above[p] == x or below[p] == x):
            g = up[p]
            if g >= 0 and (above[g] == p or below[g] == p):
                self._rotate(p if (above[g] == p) == (above[p] == x) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from the root to `node`; (deepest node, old colour) of its segments."""
        deeper, x = -1, node
        while x >= 0:
            self._splay(x)
            old = self.colour[x]
            if (rest := self.below[x]) >= 0:  # what the path leaves keeps its colour
                self.colour[rest] = old
            self.below[x] = deeper
            yield x, old
            deeper, x = x, self.up[x]
        self.colour[deeper] = colour


def runs_of(words: Sequence[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    length, link, states = suffix_automaton(words)
    tree = LastEnds(link)
    ends: dict[tuple[int, int], int] = {}
    for end, state in enumerate(states):
        for node, before in tree.access(state, end):
            period, suffix = end - before, length[node]
            if before >= 0 and suffix >= (times - 1) * period and suffix + period >= least:
                ends[end - suffix - period + 1, period] = end
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def window_words(times: int = TIMES, least: int = LEAST) -> int:
    """The most words of a window such that every window in a run occurs again in it, one period away."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(hashes: np.ndarray, text: np.ndarray, n: int, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the stretches outside of which no run can be."""
    size = window_words(times, least)
    window, part, at = hashing.runs(hashes, text, n, size, short=False)
    for _ in range(ROUNDS):
        key = hashing.mix(window ^ hashing.mix(part.astype(np.uint64) + np.uint64(1)))
        words = np.bincount(part, minlength=1) + size - 1
        order = np.argsort(key, kind="stable")
        one, two = order[:-1], order[1:]
        near = (key[one] == key[two]) & ((at[two] - at[one]) * times <= words[part[one]])
        recurs = np.zeros(len(at), bool)
        recurs[one[near]] = recurs[two[near]] = True
        before = len(at)
        window, part, at = window[recurs], part[recurs], at[recurs]
        part = np.cumsum(np.append(0, (np.diff(at) != 1) | (np.diff(part) != 0)))[: len(at)]
        long_ = (np.bincount(part, minlength=1) + size - 1 >= least)[part]
        window, part, at = window[long_], part[long_], at[long_]
        part = np.unique(part, return_inverse=True)[1]
        if len(at) == before:
            break
    cut = np.flatnonzero(np.append(True, np.diff(part) != 0))[: len(at)]
    return at[cut], at[np.append(cut[1:], len(at))[: len(cut)] - 1] + size


def runs_of_texts(data: np.ndarray, offsets: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, dict[int, list]]:
    """Number of words of each text, and the runs of texts that have some."""
    n = len(offsets) - 1
    hashes, text, first, last = hashing.words(data, offsets, lower=False)
    counts = np.bincount(text, minlength=n)
    head = np.cumsum(counts) - counts
    found: dict[int, list] = {}
    if not len(hashes):
        return counts, found
    raw = data.tobytes()
    for begin, end in zip(*(x.tolist() for x in stretches(hashes, text, n, times, least)), strict=True):
        known: dict[bytes, int] = {}
        places = zip(first[begin:end].tolist(), last[begin:end].tolist(), strict=True)
        words = [known.setdefault(raw[a:b], len(known)) for a, b in places]
        number = int(text[begin])
        shift = begin - int(head[number])
        runs = [(shift + start, length, period) for start, length, period in runs_of(words, times, least)]
        if runs:
            found.setdefault(number, []).extend(runs)
    return counts, found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run the first period alone."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the most periods; ties to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def find_runs(
    docs: DataFrame, times: int = TIMES, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, runs, greatest, collapsed.

    Words are what ASCII white space separates, case kept. `runs` are ordered by start, then
    period; `greatest` is the one with the most periods, null without runs; `collapsed` is the text
    with one space between words and without what any run repeats. A null or wordless text has no words,
    no runs and the empty text. Ids may be null or repeated; each row is taken by itself. Other columns are
    ignored. `times` is at least 3.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not looked for")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.name for x in kind]
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                counts, found = runs_of_texts(data, offsets, times, least)
                runs = [found.get(i, []) for i in range(end - first)]
                collapsed = [collapse(data[a:b].tobytes().split(), r).decode() for a, b, r in zip(offsets[:-1], offsets[1:], runs, strict=True)]
                named = [[dict(zip(names, r, strict=True)) for r in x] for x in runs]
                best = [dict(zip(names, greatest(x), strict=True)) if x else None for x in runs]
                columns = [
                    batch.column(0).slice(first, end - first), pa.array(counts, pa.int64()), pa.array(named, pa.list_(pa.struct(kind))),
                    pa.array(best, pa.struct(kind)), pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "greatest", "collapsed"])

    kind = [pa.field(x, pa.int64()) for x in ("start", "length", "period")]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and texts of `docs` with a stretch repeated in one text of ten, chosen with its place by CRC-32 of the id.

    For h that hash and g = h / 10: in texts with h % 10 = 0 and n > 0 words, words from a = g % n on
    become the words from there to p = 1 + (n - a) / (3 + g % 8) over and over. Their words are
    joined by one space. Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g, n = F.floor(h / 10).cast("long"), F.nullif(F.size("_words"), F.lit(0))

    def whole(x: Column) -> Column:
        return x.cast("int")

    changed = docs.select(id_column, text_column).withColumn("_words", words).withColumn("_n", n).withColumn("_a", whole(g % F.col("_n")))
    changed = changed.withColumn("_p", whole(1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))))
    rest = F.col("_n") - F.col("_a")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(period, whole(F.ceil(rest / F.col("_p"))))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    return changed.withColumn(text_column, F.coalesce(planted, F.col(text_column))).drop("_words", "_n", "_a", "_p")
