"""Documents whose word runs overlap: an exact Jaccard join by count vectors in R-trees.

A document is the set of its distinct runs of k words. Two sets link when the size of their
intersection is at least num / den of the size of their union.

1. Equal sets are one class, represented by its smallest document.
2. Candidates. Linked sets of sizes a and b differ in at most (a + b)(den - num)/(den + num)
   runs. Hash the runs into more groups than that, and at least one group that is not empty is
   the same in both. (A set with more empty groups than the number of groups allows for emits those as well.)
   Each set emits a key for each of its groups, in the group counts of
   its own band of sizes and of the band below; sets with an equal key are joined into
   candidate groups (components of the keys). This loses no link at any data.
3. In a candidate group runs are hashed into a power of two of groups, and each set becomes
   the point of its group counts. An R-tree holds the points; the sum of the smaller of two
   counts over all coordinates bounds an intersection, for a box by its upper corner.
   A set walks the tree for sets it is not yet linked with, and each pair that passes
   the bound is verified on the sets themselves.
4. Components of the verified links.

Candidate groups also grow by chance: the longer two texts are, the likelier they share a run that is alone in its
group in both, and with enough long texts nearly all of them hang together. The sets of groups beyond `BLOCK_RUNS` runs
are grouped anew by keys of narrower bands that leave out groups of one run, wherever linked sets differ little enough
for that (a share num / den of 0.78 or more).

Candidate groups grow where many texts share a passage. The sets of those beyond `BLOCK` sets are grouped anew
by their rarest runs: of a linked set of size a at least a * num / den runs are in the other set, so the
a - ceil(a * num / den) + 1 rarest of either, in one order of all runs, have one in common. Texts with a common
passage and else different words part there; no link is lost.

A group that is still beyond `BLOCK` sets or `BLOCK_RUNS` runs is cut by the bands of its sizes,
and a large band into parts by a hash. Links are within a band or between neighbours, so each
such pair of parts is a task of its own, and sets of far sizes never meet. Texts are read
again for candidates alone; a filter of fixed size over the candidates' ids keeps most others
out of that shuffle, and the join behind it is exact however full the filter gets. Runs are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridecast.llm import hashing
from ridecast.llm.components import components, join_counted
from ridecast.llm.scratch import HASHED_BYTES, give_back_memory, text_chunks, written

#: Sets and runs of a candidate group that one task takes whole; sets of small groups, which are
#: dealt together, and their runs in one task on the average.
BLOCK, BLOCK_RUNS = 2048, 2_000_000
SMALL, RUNS_PER_TASK = 128, 500_000
LEAF = 8
#: Share of sets of a band's least size that may have more empty groups than is allowed for.
RARE = 1e-4
#: Groups of two runs or more are 0.298 times as many as runs at most, so where linked sets may differ in a larger
#: share of their runs there is no leaving out the others.
MOST_DIFFERENT = 0.285
#: Bits of the filter that keeps most texts out of the shuffle of candidates (two megabytes).
FILTER_BITS = 1 << 24

#: Places of a fixed-size table of counts by which the runs of large groups are ordered (8 megabytes), and the
#: largest count it tells from others.
COUNTS = 1 << 22
MOST_COUNTED = (1 << 16) - 1
#: Places of the table that a task hands on at once.
PLACES_PER_BATCH = 1 << 16

_SECOND = np.uint64(0x5851F42D4C957F2D)


def _more_empty(groups: int, runs: int, spare: int) -> float:
    """About the chance that more than `spare` groups stay empty when runs are hashed into them."""
    mean = groups * math.exp(-runs / groups)
    term = total = math.exp(-mean)
    for k in range(1, spare + 1):
        term *= mean / k
        total += term
    return 1 - total


class Bands:
    """Bands of sizes such that linked sets are in the same band or in neighbouring ones.

    For band k: `groups[k]`, the hash groups in which sets of bands k and k + 1 are compared,
    and `empties[k]`, how many of them may be empty in a set without losing its links.
    """

    #: Bands below its own in whose groups a set may have links, and the groups with fewer runs than that which it may leave out.
    back, spared = 1, 1

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lower = [1]
        self.groups: list[int] = []
        self.empties: list[int] = []
        self.reach: list[int] = []  # the largest size that links with one of the band

    def up_to(self, size: int) -> None:
        while self.lower[-1] <= size:
            low = self.lower[-1]
            after = self.after(low)
            most = after - 1  # the largest size of this band
            reach = most * self.den // self.num
            differ = (most + reach) * (self.den - self.num) // (self.den + self.num)
            spare = self.spare(differ, low)
            self.groups.append(differ + 1 + spare if differ else 0)  # no difference: only equal sets link
            self.empties.append(spare)
            self.reach.append(reach)
            self.lower.append(after)

    def after(self, low: int) -> int:
        return low * self.den // self.num + 1

    def spare(self, differ: int, low: int) -> int:
        # As few groups as leave hardly any set with more empty ones than it may have: the more runs
        # a group has, the fewer sets share it that do not link.
        spare = 0
        while spare <= differ and _more_empty(differ + 1 + spare, low, spare) > RARE:
            spare += 1
        return spare


class NarrowBands(Bands):
    """Narrower bands with more groups, of which a set leaves out those with few runs.

    Linked sets have more than `spare` groups in common. A set that leaves out the groups of fewer than c runs,
    for the largest c that leaves out `spare` at most, never leaves out the fullest of these: were that left out, all of them
    were. Groups of one run, which long sets share by chance, go that way, where bands are narrow enough.
    """

    spared = 4

    def __init__(self, num: int, den: int):
        super().__init__(num, den)
        self.back = next((k for k in range(1, 4) if (den / num) ** (1 / k) * (den - num) / num < MOST_DIFFERENT), 4)

    @staticmethod
    def part_by(num: int, den: int) -> bool:
        """Whether bands can be narrow enough for this share."""
        return (den - num) / num < MOST_DIFFERENT

    def after(self, low: int) -> int:
        return int(low * (self.den / self.num) ** (1 / self.back)) + 1

    def spare(self, differ: int, low: int) -> int:
        # As few groups as leave hardly any set with more groups of one run and none than it may leave out, or else the
        # number with the fewest such sets. Runs of a group are taken for a Poisson variable, the number of such groups for a normal one.
        spare = np.arange(2 * differ + 2)
        groups = differ + 1 + spare
        mean = low / groups
        few = np.exp(-mean) * (1 + mean)
        spread = groups * (few * (1 - few) - mean * (mean * np.exp(-mean)) ** 2)
        sure = (spare - groups * few) / np.sqrt(np.maximum(spread, 1e-9))
        return int(np.argmax(sure > 3.7) if (sure > 3.7).any() else np.argmax(sure))


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of texts laid end to end, ascending in each text: (hash, text number)."""
    n = len(offsets) - 1
    words, text, _, _ = hashing.words(data, offsets)
    runs, of, _ = hashing.runs(words, text, n, size)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    return runs[fresh], of[fresh]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def keys_of(runs: np.ndarray, of: np.ndarray, n: int, bands: Bands) -> list[np.ndarray]:
    """For each text the keys of its hash groups."""
    counts = np.bincount(of, minlength=n)
    bands.up_to(int(counts.max(initial=0)))
    band = np.searchsorted(np.array(bands.lower), counts, "right") - 1
    all_keys, all_of = [], []
    mixed = hashing.mix(runs)
    for back in range(bands.back + 1):
        at = np.maximum(band - back, -1)  # the last entry is no band
        groups = np.where((at >= 0) & (counts <= np.array([*bands.reach, 0])[at]), np.array([*bands.groups, 0])[at], 0)
        spare = np.where(at >= 0, np.array([*bands.empties, 0])[at], 0)
        some = groups[of] > 0
        run, text, value = runs[some], of[some], mixed[some]
        if not len(run):
            continue
        # High bits choose the group, so groups are runs of neighbours in hash order.
        group = ((run >> np.uint64(32)) * groups[text].astype(np.uint64)) >> np.uint64(32)
        first = np.ones(len(run), bool)
        first[1:] = (group[1:] != group[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(first)
        label = (at[text[begin]].astype(np.uint64) << np.uint64(40)) | group[begin]
        content = _sums(value, np.append(begin, len(run)))
        held, owner = np.diff(begin, append=len(run)), text[begin]
        under = groups - np.bincount(owner, minlength=n)
        least = np.zeros(n, np.int64)  # runs of a group that counts
        for c in range(1, bands.spared + 1):
            least[under <= spare] = c
            under = under + np.bincount(owner[held == c], minlength=n)
        full = held >= least[owner]
        all_keys.append(hashing.mix(content + hashing.mix(label + np.uint64(1)))[full])
        all_of.append(owner[full])
        for i in np.flatnonzero((groups > 0) & (least == 0)):
            # Too many are empty: empty groups count as well.
            empty = np.setdiff1d(np.arange(groups[i], dtype=np.uint64), group[text == i])
            label = (np.uint64(at[i]) << np.uint64(40)) | empty
            all_keys.append(hashing.mix(hashing.mix(label + np.uint64(1))))
            all_of.append(np.full(len(empty), i))
    keys = np.concatenate(all_keys or [np.zeros(0, np.uint64)])
    owner = np.concatenate(all_of or [np.zeros(0, np.int64)])
    keys = keys[np.argsort(owner, kind="stable")]
    return np.split(keys, np.cumsum(np.bincount(owner, minlength=n))[:-1])


class IdFilter:
    """A fixed number of bits over ids: all its ids are known, and some others are taken for known."""

    def __init__(self, ids: DataFrame):
        bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
        words = ids.select(F.floor(bit / 32).cast("int").alias("at"), (bit % 32).cast("int").alias("bit"))
        words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        held = np.zeros(FILTER_BITS // 32, np.uint32)
        found = words.toArrow()  # at most FILTER_BITS / 32 rows; as arrays, not as an object a row
        held[np.asarray(found["at"])] = np.asarray(found["bits"]).astype(np.uint32)
        self.held = ids.sparkSession.sparkContext.broadcast(held)

    @staticmethod
    def marked(texts: DataFrame) -> DataFrame:
        """Rows (doc_id, text) with the bit of their id."""
        return texts.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def done(self) -> None:
        """Give its memory back, once no table has still to be computed with it."""
        self.held.destroy()

    def select(self, batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) of marked rows that are known, or that are not."""
        bits = self.held.value
        for batch in batches:
            at = np.asarray(batch.column(2))
            inside = ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
            kept = batch.filter(pa.array(inside == known)).select([0, 1])
            if kept.num_rows:
                yield kept


def _sketched(
    docs: DataFrame, words: int, num: int, den: int, with_keys: bool, ids: IdFilter | None = None
) -> DataFrame:
    """(doc_id, n_shingles, f1, f2) of rows, with the candidate keys if asked for.

    With a filter, of those rows alone whose ids it knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in ids.select(batches, True) if ids else batches:
            for first, end, data, offsets in text_chunks(batch.column(1), HASHED_BYTES):
                n = end - first
                runs, of = sets_of(data, offsets, words)
                edges = np.searchsorted(of, np.arange(n + 1))
                marks = [_sums(hashing.mix(runs ^ salt), edges).view(np.int64) for salt in (np.uint64(0), _SECOND)]
                columns = [batch.column(0).slice(first, n), pa.array(np.diff(edges)), *map(pa.array, marks)]
                names = ["doc_id", "n_shingles", "f1", "f2"]
                if with_keys:
                    keys = keys_of(runs, of, n, bands)
                    columns.append(pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())))
                    names.append("keys")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_shingles long, f1 long, f2 long" + (", keys array<long>" if with_keys else "")
    return (IdFilter.marked(docs) if ids else docs).mapInArrow(run, schema)


class RTree:
    """Boxes of points in levels of `LEAF`; points near each other in `order` share boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        self.order = order
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corners, least and most sizes
        corners, least, most = points[order], sizes[order], sizes[order]
        while True:
            self.levels.append((corners, least, most))
            if len(corners) <= LEAF:
                break
            cut = np.arange(0, len(corners), LEAF)
            corners = np.maximum.reduceat(corners, cut, 0)
            least, most = np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points whose size and bounded overlap allow a link with a set of this size."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            corners, least, most = (x[nodes] for x in self.levels[level])
            near = (most * den >= size * num) & (least * num <= size * den)
            # Overlap needed with the smallest size in the box that can link at all.
            smallest = np.maximum(least, -(-size * num // den))
            bound = np.minimum(corners, point).sum(1, dtype=np.int64)
            nodes = nodes[near & (bound * (num + den) >= num * (size + smallest))]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return self.order[nodes]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending arrays of distinct runs link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return common * (num + den) >= num * (len(a) + len(b)) and common > 0


def spanning_links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all sets that links join; between the two sides, if there are two.

    Pairs that links already join are not looked at again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    width = 1 << max(4, min(10, int(np.median(sizes) / 4).bit_length()))
    shift = np.uint64(64 - (width.bit_length() - 1))
    points = np.zeros((n, width), np.int32)
    for i, runs in enumerate(sets):
        points[i] = np.bincount((hashing.mix(runs) >> shift).astype(np.int64), minlength=width)
    least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    two = bool((side != side[0]).any())
    tree = RTree(points, sizes, np.lexsort((sizes, least)))
    group = np.arange(n)
    links = []
    for i in range(n):
        if two and side[i] != side[0]:
            continue
        found = tree.search(points[i], int(sizes[i]), num, den)
        found = found[(side[found] != side[i]) if two else (found > i)]
        # The nearest sizes first: they are the likeliest links.
        for j in found[np.argsort(np.abs(sizes[found] - sizes[i]), kind="stable")]:
            if group[i] != group[j] and linked(sets[i], sets[j], num, den):
                links.append((i, int(j)))
                group[group == group[j]] = group[i]
    return links


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct runs of each text, ascending."""
    for first, end, data, offsets in text_chunks(texts, HASHED_BYTES):
        runs, of = sets_of(data, offsets, words)
        yield from np.split(runs, np.searchsorted(of, np.arange(1, end - first)))


def _verified(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of representatives from rows (kind, task, low, high, side, component, rep, text).

    Sets are made here: their hashes do not compress, and shuffled they take twice the room of their texts.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        frame = frame.sort_values("component", kind="stable", ignore_index=True)
        sets = list(_sets(pa.array(frame.pop("text"), pa.large_string()), words))
        for _, group in frame.groupby("component", sort=False):
            reps, first = group["rep"].to_numpy(), group.index[0]
            own = sets[first : first + len(group)]
            out += [(reps[a], reps[b]) for a, b in spanning_links(own, group["side"].to_numpy(), num, den)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("kind", "task", "low", "high").applyInPandas(run, "a long, b long")


def _once_a_batch(key: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """(linked, key, rep): each key once, with the least set of the batch that has it.

    The batch's other sets of that key are linked with that set at once: their `key` is its number. So a key
    that a third of all sets have is met once a batch in the shuffle, not once a set.
    """
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    least = rep[np.flatnonzero(first)[np.cumsum(first) - 1]]
    fresh = first | (rep != least)
    columns = [pa.array(~first[fresh]), pa.array(np.where(first, key, least)[fresh]), pa.array(rep[fresh])]
    return pa.RecordBatch.from_arrays(columns, COMBINED)


COMBINED = ["linked", "key", "rep"]
COMBINED_TYPES = "linked boolean, key long, rep long"


def _combined(rows: DataFrame) -> DataFrame:
    """(linked, key, rep) of rows (rep, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            yield _once_a_batch(np.asarray(lists.flatten()), np.repeat(np.asarray(batch.column(0)), np.asarray(lists.value_lengths())))

    return rows.select("rep", "keys").mapInArrow(run, COMBINED_TYPES)


def _combined_single(docs: DataFrame, words: int, num: int, den: int, ids: IdFilter, inside: bool = False, kind: type[Bands] = Bands) -> DataFrame:
    """(linked, key, rep) of the rows (doc_id, text) whose ids the filter does not know, or does, in one step of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = kind(num, den)
        for batch in ids.select(batches, inside):
            reps, keys, of_keys = np.asarray(batch.column(0)), [], []
            for first, end, data, offsets in text_chunks(batch.column(1), HASHED_BYTES):
                runs, of = sets_of(data, offsets, words)
                own = keys_of(runs, of, end - first, bands)
                keys += own
                of_keys.append(np.repeat(reps[first:end], [len(k) for k in own]))
            if keys:
                yield _once_a_batch(np.concatenate(keys).view(np.int64), np.concatenate(of_keys))

    return IdFilter.marked(docs).mapInArrow(run, COMBINED_TYPES)


def join_documents(
    docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id.

    Words are what ASCII white space separates, with A-Z in lower case. A text of fewer words
    is one run; a null text or one without words has none and links with nothing.
    `component_id` is the smallest document reachable by links. Rows of one id are one
    document with the links of them all; a row with a null id links with nothing and has a
    null component. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    marks = written(_sketched(rows, words, num, den, False), "sets")
    same = ["n_shingles", "f1", "f2"]
    repeated = marks.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same)
    repeated = repeated.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = written(repeated.select(*[F.col(c).alias(f"_{c}") for c in same], "rep"), "repeated-sets")
    of_class = [F.col(c) == F.col(f"_{c}") for c in same]
    copies = marks.join(repeated, of_class, "left_semi").select(F.col("doc_id").alias("node")).where("node IS NOT NULL")
    # Keys of sets that other documents have as well meet by set first; the rest go straight on.
    ids = IdFilter(copies)
    maybe = _sketched(known, words, num, den, True, ids).where("n_shingles > 0")
    classes = maybe.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")).select("rep", "keys")
    keyed = _combined(classes).unionByName(_combined_single(known, words, num, den, ids))
    candidates = components(_stars(keyed), "candidates")  # written, so the filter has done its work
    ids.done()
    candidates = _parted(known, marks, candidates, words, num, den)
    candidates = _regrouped(known, candidates, words, num, den)
    links = written(_links(known, marks, candidates, words, num, den), "links")
    # Equal sets are linked through their class.
    reached = components(links, "linked")
    reached = reached.select(F.col("node").alias("_node"), "component")
    placed = marks.join(repeated, of_class, "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(reached, F.col("rep") == F.col("_node"), "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def _stars(keyed: DataFrame) -> DataFrame:
    """Links (a, b) of rows (linked, key, rep): from the least set of a key to its others."""
    least = F.when(F.col("linked"), F.col("key")).otherwise(F.min("rep").over(W.partitionBy("linked", "key").orderBy("rep")))
    return keyed.withColumn("least", least).where("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b"))


def _lengths(marks: DataFrame) -> DataFrame:
    return marks.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("n_shingles").alias("length"))


def _parted(known: DataFrame, marks: DataFrame, candidates: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Candidates (node, component) with the members of groups of more than `BLOCK_RUNS` runs grouped by keys of several runs.

    Two long sets are likely to share a run that is alone in its group in both, so with more and more of them most come
    to be in one candidate group. Such keys are left out here. The filter of ids lets some others through, which may
    join groups, never part them.
    """
    if not NarrowBands.part_by(num, den):
        return candidates
    candidates = written(candidates, "candidates")
    on = F.col("component") == F.col("_component")
    sizes = candidates.join(_lengths(marks), F.col("node") == F.col("_doc")).groupBy(F.col("component").alias("_component"))
    heavy = written(sizes.agg(F.sum("length").alias("runs")).where(F.col("runs") > BLOCK_RUNS), "heavy-candidates")
    if heavy.isEmpty():
        return candidates
    members = written(candidates.join(heavy, on, "left_semi").select(F.col("node").alias("_member")), "heavy-candidate-sets")
    ids = IdFilter(members.select(F.col("_member").alias("node")))
    again = components(_stars(_combined_single(known, words, num, den, ids, True, NarrowBands)), "parted")
    ids.done()
    again = again.join(members, F.col("node") == F.col("_member"), "left_semi")
    return candidates.join(heavy, on, "left_anti").unionByName(again)


def _dealt(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members (node, component, length) with the tasks that compare them.

    Groups of a few sets share tasks; larger ones have a task of their own; those beyond the
    bounds are cut into parts of bands of sizes, and each member goes to the tasks of its part
    with itself, with the other parts of its band, and with those of the bands beside.
    """
    sizes = members.groupBy(F.col("component").alias("_component")).agg(F.count(F.lit(1)).alias("members"), F.sum("length").alias("runs"))
    members = members.join(sizes, F.col("component") == F.col("_component")).drop("_component")
    whole = (F.col("members") <= BLOCK) & (F.col("runs") <= BLOCK_RUNS)
    kind = F.when(whole & (F.col("members") <= SMALL), 0).when(whole, 1).otherwise(2)
    members = written(members.withColumn("kind", kind), "candidate-groups")
    few = members.where("kind = 0")
    runs = few.agg(F.sum("length")).first()[0] or 0
    least = members.sparkSession.sparkContext.defaultParallelism * 4
    tasks = max(-(-runs // RUNS_PER_TASK), min(runs // 10_000, least), 1)
    one = {"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long"), "side": F.lit(0)}
    alone = members.where("kind < 2").withColumns(one)
    alone = alone.withColumn("task", F.when(F.col("kind") == 0, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")))

    bands = Bands(num, den)
    bands.up_to(int(members.agg(F.max("length")).first()[0] or 1))
    lower = F.array(*[F.lit(x).cast("long") for x in bands.lower])
    cut = members.where("kind = 2").withColumn("band", F.size(F.filter(lower, lambda x: x <= F.col("length"))).cast("long"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / (BLOCK // 2), F.sum("length") / (BLOCK_RUNS // 2)))
    counted = written(cut.groupBy("component", "band").agg(parts.alias("parts")), "candidate-bands")
    for name, step in (("own", 0), ("above", 1), ("below", -1)):
        side = counted.select(F.col("component").alias("_component"), (F.col("band") - step).alias("_band"), F.col("parts").alias(name))
        cut = cut.join(side, (F.col("component") == F.col("_component")) & (F.col("band") == F.col("_band")), "left").drop("_component", "_band")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("own")))

    def place(band: Column, part: Column) -> Column:
        return band * (1 << 40) + part

    def others(parts: str, make) -> Column:
        count = F.coalesce(F.col(parts), F.lit(0).cast("long"))
        numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, make)

    band, part = F.col("band"), F.col("part")
    mine = place(band, part)

    def pair(low: Column, high: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), side.cast("int").alias("side"))

    targets = F.concat(
        others("own", lambda o: pair(F.least(mine, place(band, o)), F.greatest(mine, place(band, o)), (part > o))),
        others("above", lambda o: pair(mine, place(band + 1, o), F.lit(False))),
        others("below", lambda o: pair(place(band - 1, o), mine, F.lit(True))),
    )
    cut = cut.withColumn("_target", F.explode(targets)).withColumn("task", F.col("component"))
    columns = ["node", "component", "kind", "task", "low", "high", "side"]
    return alone.select(*columns).unionByName(cut.select("*", "_target.*").select(*columns))


def _sets_of_known(known: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(rep, runs) of rows (doc_id, text), the set as bytes, for every id in the written table of nodes.

    The filter of ids lets some others through, which a join with the nodes has to leave out. That join comes
    after the sets: one worker then knows the ids and makes the sets, where two in a row would hold
    memory for each task, and texts are not shuffled.
    """
    ids = IdFilter(nodes.select("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ids.select(batches, True):
            for first, end, data, offsets in text_chunks(batch.column(1), HASHED_BYTES):
                runs, of = sets_of(data, offsets, words)
                edges = np.searchsorted(of, np.arange(end - first + 1))
                own = [runs[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(own, pa.binary())], ["rep", "runs"])

    return IdFilter.marked(known).mapInArrow(run, "rep long, runs binary")


def _texts_of_known(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, text) of rows (doc_id, text) for every id in the written table of nodes, and for some others."""
    ids = IdFilter(nodes.select("node"))
    return IdFilter.marked(known).mapInArrow(lambda batches: _named(ids.select(batches, True)), "rep long, text string")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.rename_columns(["rep", "text"])


def _place(runs: np.ndarray) -> np.ndarray:
    return (hashing.mix(runs) % np.uint64(COUNTS)).astype(np.int64)


def _regrouped(known: DataFrame, candidates: DataFrame, words: int, num: int, den: int, most: int = 0) -> DataFrame:
    """Candidates (node, component) with the members of groups of more than `most` grouped by their rarest runs.

    Any one order of all runs loses no link; this one is by counts in a table of fixed size, where all counts from
    `MOST_COUNTED` on are the same, and those of one and none: the latter do not reach the driver.
    """
    candidates = written(candidates, "candidates")
    sizes = candidates.groupBy(F.col("component").alias("_component")).agg(F.count(F.lit(1)).alias("members"))
    large = written(sizes.where(F.col("members") > (most or BLOCK)), "large-candidates")
    if large.isEmpty():
        return candidates
    on = F.col("component") == F.col("_component")
    members = written(candidates.join(large, on, "left_semi"), "large-candidate-sets")

    sets = _sets_of_known(known, members, words).join(members.select("node"), F.col("rep") == F.col("node"), "left_semi")
    sets = written(sets, "large-sets")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.uint32)  # of one task's runs
        for batch in batches:
            for value in batch.column(0):
                place, n = np.unique(_place(np.frombuffer(value.as_buffer(), "<u8")), return_counts=True)
                total[place] += n.astype(np.uint32)
        for first in range(0, COUNTS, PLACES_PER_BATCH):
            n = total[first : first + PLACES_PER_BATCH]
            if (some := np.flatnonzero(n)).size:
                yield pa.RecordBatch.from_arrays([pa.array((some + first).astype(np.int32)), pa.array(n[some].astype(np.int64))], ["place", "n"])

    counts = np.zeros(COUNTS, np.uint16)
    found = sets.select("runs").mapInArrow(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
    found = found.select("place", F.least("n", F.lit(MOST_COUNTED)).cast("int").alias("n")).toArrow()  # at most COUNTS rows
    counts[np.asarray(found["place"])] = np.asarray(found["n"])
    del found
    give_back_memory()
    held = known.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            reps, out = np.asarray(batch.column(0)), []
            for value in batch.column(1):
                runs = np.frombuffer(value.as_buffer(), "<u8")
                often = counts[_place(runs)]
                prefix = np.lexsort((runs, often))[: len(runs) + len(runs) * num // -den + 1]
                out.append(runs[prefix[often[prefix] > 1]])  # what is there once is in no other set
            rep = np.repeat(reps, [len(x) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(out).view(np.int64))], ["rep", "run"])

    rare = written(sets.mapInArrow(rarest, "rep long, run long"), "rare-runs")
    held.destroy()
    least = rare.groupBy(F.col("run").alias("_run")).agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_sets"))
    least = written(least.where("_sets > 1"), "rare-run-sets")
    stars = join_counted(rare, least, "run", "_run", "_sets").where("least < rep")
    again = components(stars.select(F.col("least").alias("a"), F.col("rep").alias("b")), "regrouped")
    return candidates.join(large, on, "left_anti").unionByName(again)


def _links(known: DataFrame, marks: DataFrame, candidates: DataFrame, words: int, num: int, den: int) -> DataFrame:
    members = written(candidates.join(_lengths(marks), F.col("node") == F.col("_doc")).drop("_doc"), "candidate-sets")
    texts = _texts_of_known(known, members)
    dealt = _dealt(members, num, den).join(texts, F.col("node") == F.col("rep"))
    return _verified(dealt.select("kind", "task", "low", "high", "side", "component", "rep", "text"), words, num, den)
