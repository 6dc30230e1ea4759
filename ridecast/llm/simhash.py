"""Near copies by SimHash fingerprints, joined by hierarchical indexes in Gray order.

A text's fingerprint has a bit where more than half of the hashes of its word runs have it.
Two fingerprints link when they differ in few bits.

1. Equal fingerprints are one; links are sought among the distinct ones alone.
2. Of fingerprints that differ in at most d bits, one of d + 1 blocks of bits is equal. Each
   fingerprint goes to the group of its value in each block. A group of more than `GROUP`
   is divided again by blocks of its other bits, until it is small enough: at most 2**f
   fingerprints share all but f bits, so this ends, and no link is lost at any data.
3. In a group the fingerprints are sorted by Gray rank, so neighbours share most bits. `FAN`
   neighbours make a node of the index, nodes make a node above. A node holds the bits on
   which all below it agree and that its parent does not hold. A search adds up the
   differences along its path and leaves a node as soon as they exceed d.
4. The links of a task are reduced to those that join what they join; components of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.llm.components import components, join_counted
from ridecast.llm.hashing import LOWER, WHITE, word_places
from ridecast.llm.scratch import text_chunks, written

WORDS, DISTANCE, SEED = 3, 2, 42
BITS = 64
#: Most fingerprints of a group that one task searches at once (a power of two).
GROUP = 4096
#: Nodes below a node of the index.
FAN = 8
#: Pairs of a search and a node held at once, and rows indexed at once.
FRONTIER, ROWS = 1 << 20, 1 << 16

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the bytes between places of `data`: short ones (under 32 bytes) all at once."""
    length = end - first
    out = np.uint64(seed) + _P5 + length.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data) + 1
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    four = np.ndarray((n,), "<u4", padded, strides=(1,))
    short = length < 32
    for k in range(3):
        at = np.flatnonzero(short & (length >= 8 * (k + 1)))
        lane = _turn(eight[first[at] + 8 * k] * _P2, 31) * _P1
        out[at] = _turn(out[at] ^ lane, 27) * _P1 + _P4
    at = np.flatnonzero(short & ((length & 4) > 0))
    lane = four[first[at] + (length[at] & 24)].astype(np.uint64) * _P1
    out[at] = _turn(out[at] ^ lane, 23) * _P2 + _P3
    for k in range(3):
        at = np.flatnonzero(short & ((length & 3) > k))
        lane = padded[first[at] + (length[at] & 28) + k].astype(np.uint64) * _P5
        out[at] = _turn(out[at] ^ lane, 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    view = memoryview(data)
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(view[first[i] : end[i]], seed)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of words of texts laid end to end, repeats included.

    A-Z are in lower case, words joined by one space; a text of fewer words is one run.
    """
    text, first, last = word_places(data, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), text
    # All words again, each followed by one space.
    lengths = last - first
    number = np.arange(len(first))
    joined = np.full(int(lengths.sum()) + len(first), 32, np.uint8)
    letters = LOWER[data[~WHITE[data]]]
    joined[np.arange(len(letters)) + np.repeat(number, lengths)] = letters
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    counts = np.bincount(text, minlength=len(offsets) - 1)
    head = np.cumsum(counts) - counts
    place = number - head[text]
    runs = place < np.maximum(counts[text] - words + 1, 1)
    begin = number[runs]
    final = np.minimum(begin + words, (head + counts)[text[begin]]) - 1
    return xxh64(joined, start[begin], end[final]), text[begin]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its fingerprint (zero without words) and its number of runs."""
    n = len(offsets) - 1
    hashes, of = shingle_hashes(data, offsets, words)
    total = np.bincount(of, minlength=n)
    ones = np.zeros((n, BITS), np.int64)
    for at in range(0, len(hashes), ROWS):
        mine = of[at : at + ROWS]
        bits = np.unpackbits(hashes[at : at + ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        ones[mine[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > total[:, None], axis=1)
    return packed.view(">u8").ravel().astype(np.uint64), total


def fingerprints(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, fingerprint (64 bits in a long).

    Words are what ASCII white space separates. Null and wordless texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                prints, total = fingerprints_of(data, offsets, words)
                columns = [batch.column(0).slice(first, end - first), pa.array(total), pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The places of codes in Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


class GrayForest:
    """Indexes of many groups of codes side by side: level 0 has the codes, the last one root a group.

    `codes` are sorted by group and, in a group, by Gray rank; `sizes` are those of the groups.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        every, some, counts = codes, codes, sizes
        last = np.arange(len(codes))
        levels = []  # (bits all have, bits some have, last code below, first child, number of children)
        child, children = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        while True:
            levels.append((every, some, last, child, children))
            if (counts == 1).all():
                break
            first = np.cumsum(counts) - counts
            above = -(-counts // FAN)
            group = np.repeat(np.arange(len(counts)), above)
            child = first[group] + FAN * (np.arange(len(group)) - (np.cumsum(above) - above)[group])
            every, some = np.bitwise_and.reduceat(every, child), np.bitwise_or.reduceat(some, child)
            children = np.append(child[1:], len(last)) - child
            last, counts = last[child + children - 1], above
        self.codes = codes
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.levels = []
        shared = None
        for every, some, last, child, children in reversed(levels):
            agree = ~(every ^ some)
            # What the node adds to the bits its parent holds.
            own = agree if shared is None else agree & ~np.repeat(shared[0], shared[1])
            self.levels.append((every, own, last, child, children))
            shared = agree, children

    def search(self, wanted: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (one of `wanted`, a later code of its group) that differ in at most `distance` bits."""
        seeker, node = wanted, self.group[wanted]
        apart = np.zeros(len(wanted), np.uint8)
        for depth, (every, own, last, _, _) in enumerate(self.levels):
            if depth:
                _, _, _, child, children = self.levels[depth - 1]
                many = children[node]
                skip = np.cumsum(many) - many
                node = np.repeat(child[node] - skip, many) + np.arange(int(many.sum()))
                seeker, apart = np.repeat(seeker, many), np.repeat(apart, many)
            apart = apart + np.bitwise_count((self.codes[seeker] ^ every[node]) & own[node])
            near = (apart <= distance) & (last[node] > seeker)
            seeker, node, apart = seeker[near], node[near], apart[near]
        return seeker, node


def spanning_links(codes: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links within the groups join: places (a, b), at most one for each code."""
    forest = GrayForest(codes, sizes)
    label = np.arange(len(codes))
    room = np.cumsum(sizes[forest.group]) // FRONTIER  # a search meets at most its whole group
    for wanted in np.split(label.copy(), np.flatnonzero(np.diff(room)) + 1):
        a, b = forest.search(wanted, distance)
        while len(a):
            a, b = label[a], label[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return moved, label[moved]


def _links(groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of codes from rows (path, value, code): those of a path and value are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            path, value, code = (np.concatenate([np.asarray(b.column(k)) for b in kept]) for k in range(3))
            cut = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])))
            whole = len(path) if end else int(cut[-1])  # the last group may go on
            rest = [b for b in kept] if not whole else []
            if whole and not end:
                rest = [pa.record_batch([pa.array(x[whole:]) for x in (path, value, code)], ["path", "value", "code"])]
            kept[:] = rest
            cut = cut[cut < whole]
            sizes = np.diff(np.append(cut, whole))
            several = np.repeat(sizes > 1, sizes)
            if several.any():
                codes = code[:whole][several]
                group = np.repeat(np.arange(len(sizes)), sizes)[several]
                codes = codes[np.lexsort((gray_rank(codes.view(np.uint64)), group))]
                a, b = spanning_links(codes.view(np.uint64), sizes[sizes > 1], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(codes[a]), pa.array(codes[b])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
            if sum(b.num_rows for b in kept) >= ROWS:
                yield from flush(False)
        if kept:
            yield from flush(True)

    dealt = groups.repartition("path", "value").sortWithinPartitions("path", "value")
    return dealt.mapInArrow(run, "a long, b long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _divided(codes: DataFrame, path: Column, paths: dict[int, int], distance: int, last: int) -> tuple[DataFrame, dict[int, int]]:
    """Each code in the groups of its value in `distance` + 1 blocks of the bits its path leaves free.

    `paths` has the bits that each path holds; new paths are numbered after `last`.
    """
    targets, new = [], {}
    for old, held in paths.items():
        free = [k for k in range(BITS) if not held >> k & 1]
        cuts = [len(free) * k // (distance + 1) for k in range(distance + 2)]
        own = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            number = last + len(new) + 1
            new[number] = held | sum(1 << k for k in free[low:high])
            value = F.col("code").bitwiseAND(F.lit(_signed(new[number])))
            own.append(F.struct(F.lit(number).alias("path"), value.alias("value")))
        targets.append((old, F.array(*own)))
    choice = targets[0][1]
    for old, own in targets[1:]:
        choice = F.when(path == old, own).otherwise(choice)
    return codes.select("code", F.explode(choice).alias("_to")).select("_to.path", "_to.value", "code"), new


def linked_codes(codes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join all distinct codes (column code) which links of `distance` bits join."""
    if group < 1 << distance:
        raise ValueError("a group must have room for all codes that differ in as many bits as links may")
    number = 0
    rows, paths = _divided(codes, F.lit(0), {0: 0}, distance, number)
    found = []
    while True:
        number = max(paths)
        counted = rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
        large = written(counted.select(F.col("path").alias("_path"), F.col("value").alias("_value")), "large-groups")
        on = (F.col("path") == F.col("_path")) & (F.col("value") == F.col("_value"))
        again = [r[0] for r in large.select("_path").distinct().collect()]  # as many as there are paths
        if not again:
            found.append(_links(rows, distance))
            break
        found.append(_links(rows.join(large, on, "left_anti"), distance))
        beyond = rows.join(large, on, "left_semi")
        rows, paths = _divided(beyond, F.col("path"), {p: paths[p] for p in sorted(again)}, distance, number)
        rows = written(rows, "divided-groups")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_copies(
    docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, fingerprint (long), component_id.

    `component_id` is the smallest id among the rows whose fingerprints are reachable by links,
    the row itself included. Null, empty and wordless texts have fingerprint zero and link as
    any other. A row with a null id has a fingerprint and links others, but names no component;
    a component of such rows alone has a null id. Rows of one id are each a row of their own.
    An empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, words, id_column, text_column), "fingerprints")
    classes = prints.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, "distinct-fingerprints")
    joined = components(linked_codes(classes.select("code"), distance), "fingerprint").withColumnRenamed("component", "root")
    joined = classes.join(joined, F.col("code") == F.col("node"), "left")
    joined = written(joined.select("code", "least", "rows", F.coalesce("root", "code").alias("root")), "joined-fingerprints")
    roots = joined.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_codes"))
    placed = join_counted(joined, written(roots, "roots"), "root", "_root", "_codes")
    placed = written(placed.select(F.col("code").alias("_code"), "rows", "component_id"), "placed-fingerprints")
    return join_counted(prints, placed, "fingerprint", "_code", "rows").select("doc_id", "n_shingles", "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """A fingerprint in 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
