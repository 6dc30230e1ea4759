"""Boosted trees with second-order gains over binned features.

Training rows are binned once by exact quantiles of each feature and written in blocks of `BLOCK_ROWS`
rows: their bins, draws and what their labels have left (less the prediction so far) as arrays. A level of a tree is
one job: the rows of a block walk the tree so far, and sums of gradients and numbers of rows by node,
feature and bin are added up, first within the tasks, then by Spark. That histogram is bounded by
nodes x features x bins whatever the table, and the driver chooses the splits from it. Of two children
the one with fewer rows is counted; the other has the rest of their parent's sums. A level has a task
a core however many rows there are, so what is shuffled has a bound as well. After each tree
the blocks are written anew. Every level reads all blocks, so they are narrow, and no array of one is large for a JVM.

Labels, predictions and leaf values are whole numbers of `1 / UNIT`. Sums of gradients are sums of
integers, so a fit gives the same trees after any repartitioning, retry or order of the rows.

Parameters have their usual meaning: a split must reduce the loss, summed over the node's rows, by at least `gamma`;
either child has a hessian (here: rows) of at least `min_child_weight`; every tree is shrunk by `learning_rate`;
`reg_lambda` is added to each hessian; rows with a null feature go to the side that gains more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.operators.ranks import value_counts_of, values_at_ranks
from ridecast.plans.training import SEED, BoostParams
from ridecast.schemas import FEATURES, TARGET
from ridecast.session import forget, materialise, ship_package

UNIT = 1 << 16
MAX_BINS = 256
REG_LAMBDA = 1.0
#: A smaller reduction of the loss is rounding.
LEAST_GAIN = 1e-6
#: The rank of the first prediction under the absolute loss, the median label, is exact to this share of the rows.
MEDIAN_ACCURACY = 10_000
#: Cells of all leaves, and at least of one, in which a pass counts what is left to find the leaves' medians.
MEDIAN_CELLS, LEAST_CELLS = 1 << 18, 1 << 8
#: Rows of a block.
BLOCK_ROWS = 1 << 14
#: Cells of a histogram that one task adds up, and of them that lie side by side in a row.
CELLS_PER_TASK, CELLS_PER_ROW = 1 << 15, 1 << 12

NODE_DDL = "tree INT, node INT, feature STRING, threshold DOUBLE, nulls_left BOOLEAN, child INT, value DOUBLE, rows BIGINT"


@dataclass
class Tree:
    """Nodes in arrays; `child` is the left child (the right one follows it), -1 in a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    nulls_left: list[bool] = field(default_factory=lambda: [False])
    child: list[int] = field(default_factory=lambda: [-1])
    value: list[int] = field(default_factory=lambda: [0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, nulls_left: bool) -> tuple[int, int]:
        left = len(self.child)
        self.feature[node], self.cut[node], self.nulls_left[node], self.child[node] = feature, cut, nulls_left, left
        for column, value in ((self.feature, 0), (self.cut, 0), (self.nulls_left, False), (self.child, -1), (self.value, 0), (self.rows, 0)):
            column += [value, value]
        return left, left + 1


def _bins(values: np.ndarray, known: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A value's bin is the number of cuts below it; -1 is null. NaN is above every number, as in Spark."""
    return np.where(known, np.searchsorted(cuts, values, "left"), -1)


def _columns(arrays: Sequence[pa.Array], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """The bins (features x rows) of columns of doubles."""
    values = [(np.asarray(a.fill_null(0.0)), np.asarray(a.is_valid())) for a in arrays]
    kind = np.int16 if max(map(len, cuts), default=0) < 1 << 15 else np.int32
    return np.stack([_bins(x, known, np.array(c, float)) for (x, known), c in zip(values, cuts, strict=True)]).astype(kind)


def _reached(tree: Tree, steps: int, bins: np.ndarray) -> np.ndarray:
    """The node that each row (a column of `bins`) reaches from the root in `steps` levels."""
    feature, cut, child = (np.array(x, np.int32) for x in (tree.feature, tree.cut, tree.child))
    nulls_right = ~np.array(tree.nulls_left, bool)
    rows = bins.shape[1]
    node, flat, at = np.zeros(rows, np.int32), bins.ravel(), np.arange(rows)
    missing = bool((bins < 0).any())
    for _ in range(steps):
        left = child[node]
        here = flat[feature[node] * rows + at]
        right = here > cut[node]
        if missing:
            right = np.where(here < 0, nulls_right[node], right)
        node = np.where(left < 0, node, left + right)
    return node


@dataclass
class BoostedModel:
    """Trees over named columns; `cuts` are the thresholds of each feature's bins."""

    features: list[str]
    cuts: list[list[float]]
    base: int
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)

    def staged(self, df: DataFrame, counts: Sequence[int], columns: Sequence[str]) -> DataFrame:
        """Predictions of the first trees, for several numbers of them, from one walk down each tree."""
        if not self.trees:
            return df.withColumns({c: F.lit(self.base / UNIT) for c in columns})
        ship_package(df.sparkSession)
        model, wanted = self, [min(n, len(self.trees)) for n in counts]

        @F.arrow_udf("array<double>")
        def walked(*features: pa.Array) -> pa.Array:
            bins = _columns(features, model.cuts)
            total, out = np.full(bins.shape[1], model.base, np.int64), np.empty((bins.shape[1], len(wanted)))
            for i in range(len(model.trees) + 1):
                for k, n in enumerate(wanted):
                    if n == i:
                        out[:, k] = total / float(UNIT)
                if i < max(wanted):
                    tree = model.trees[i]
                    total += np.array(tree.value, np.int64)[_reached(tree, model.params.max_depth, bins)]
            ends = np.arange(0, out.size + 1, len(wanted), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        stages = df.withColumn("_stages", walked(*[F.col(c).cast("double") for c in self.features]))
        return stages.withColumns({c: F.get("_stages", F.lit(k)) for k, c in enumerate(columns)}).drop("_stages")

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        """`df` with the prediction; a null feature follows each split's side for nulls."""
        return self.staged(df, [len(self.trees)], [column])

    def transform(self, df: DataFrame) -> DataFrame:
        """As a fitted pipeline does, so that the scoring of requests takes either."""
        return self.predict(df)

    def first(self, n: int) -> BoostedModel:
        """The model after `n` trees: what a fit with `n_estimators = n` gives."""
        return replace(self, trees=self.trees[:n], params=replace(self.params, n_estimators=n))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row a node: its split or, in a leaf, its value; and the training rows it had."""
        rows = []
        for number, tree in enumerate(self.trees):
            for node, child in enumerate(tree.child):
                inner = child >= 0
                feature = self.features[tree.feature[node]] if inner else None
                threshold = self.cuts[tree.feature[node]][tree.cut[node]] if inner else None
                side = tree.nulls_left[node] if inner else None
                value = None if inner else tree.value[node] / UNIT
                rows.append((number, node, feature, threshold, side, child if inner else None, value, tree.rows[node]))
        return spark.createDataFrame(rows, NODE_DDL)

    def feature_use(self, spark: SparkSession) -> DataFrame:
        """Number of splits per feature over all trees, unused features included."""
        splits = self.nodes(spark).where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
        names = spark.createDataFrame([(name,) for name in self.features], "feature STRING")
        return names.join(splits, "feature", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as one row of JSON."""
        text = json.dumps(asdict(self))
        spark.createDataFrame([(text,)], "model STRING").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        state = json.loads(spark.read.parquet(path).first()[0])
        trees = [Tree(**t) for t in state.pop("trees")]
        return cls(**{**state, "params": BoostParams(**state["params"])}, trees=trees)


def cut_points(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """The distinct values at `max_bins` - 1 evenly spaced ranks of each feature, exactly; one pass for all features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]))
    long = df.select(pairs.alias("_p")).select("_p.feature", "_p.v").where("v IS NOT NULL")

    def wanted(n: Column) -> Column:
        ranks = F.sequence(F.lit(1), F.lit(max_bins - 1))
        return F.transform(ranks, lambda k: F.struct(F.floor(k * n / F.lit(max_bins)).cast("bigint").alias("rank")))

    found = values_at_ranks(value_counts_of(long, "v", ["feature"]), wanted, ["feature"], few_groups=True)
    cuts: list[list[float]] = [[] for _ in features]
    for feature, value in found.select("feature", "value").distinct().collect():  # at most features x bins
        cuts[feature].append(float(value))
    return [np.sort(np.array(c, float)).tolist() for c in cuts]


CELLS_DDL = "cell BIGINT, sums BINARY"
BLOCK_DDL = "rows INT, features INT, bins BINARY, y BINARY, drawn BINARY"


@dataclass
class Block:
    """Rows side by side: bins (features x rows), what is left of the labels, and the trees that drew a row (a bit each)."""

    bins: np.ndarray
    y: np.ndarray
    drawn: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        for rows, features, bins, y, drawn in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)), strict=True):
            kind = np.int16 if len(bins.as_buffer()) == 2 * rows * features else np.int32
            yield cls(
                np.frombuffer(bins.as_buffer(), kind).reshape(features, rows), np.frombuffer(y.as_buffer(), np.int64),
                np.frombuffer(drawn.as_buffer(), np.uint8).reshape(rows, -1),
            )

    def seen_by(self, number: int) -> Block:
        """The rows that a tree sees."""
        if not self.drawn.shape[1]:
            return self
        some = (self.drawn[:, number >> 3] >> (7 - (number & 7))) & 1 == 1
        return Block(self.bins[:, some], self.y[some], self.drawn[some])

    def gradient(self, loss: str) -> np.ndarray:
        return -self.y if loss == "squared" else np.sign(-self.y) * UNIT

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([n], pa.int32()) for n in (self.bins.shape[1], self.bins.shape[0])]
        columns += [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (self.bins, self.y, self.drawn)]
        return pa.RecordBatch.from_arrays(columns, ["rows", "features", "bins", "y", "drawn"])


def _blocks(df: DataFrame, features: Sequence[str], cuts: list[list[float]], target: str, key: str, params: BoostParams, seed: int) -> DataFrame:
    """The labelled rows in blocks, with the whole labels left."""
    units = F.floor(F.col(target) * UNIT + F.lit(0.5)).cast("bigint")
    trees = F.sequence(F.lit(0), F.lit(params.n_estimators - 1)) if params.subsample < 1 and params.n_estimators else F.array().cast("array<int>")

    def draws(number: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), number, "_key"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < params.subsample

    columns = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull()).select(*columns, units.alias("_y"), F.col(key).alias("_key"))
    rows = rows.withColumn("_drawn", F.transform(trees, draws)).drop("_key")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []
        for batch in batches:
            n, y, drawn = batch.num_rows, np.asarray(batch.column(len(cuts))), batch.column(len(cuts) + 1)
            if n:
                bits = np.packbits(np.asarray(drawn.flatten().cast(pa.uint8())).reshape(n, -1), axis=1)
                held.append(Block(_columns(batch.columns[: len(cuts)], cuts), y, bits))
            if sum(len(b.y) for b in held) >= BLOCK_ROWS:
                yield _joined(held).batch()
                held = []
        if held:
            yield _joined(held).batch()

    return rows.mapInArrow(packed, BLOCK_DDL)


def _joined(blocks: list[Block]) -> Block:
    bins = np.concatenate([b.bins for b in blocks], axis=1)
    return Block(bins, *[np.concatenate([getattr(b, name) for b in blocks]) for name in ("y", "drawn")])


def _summed(blocks: DataFrame, cells: int, counted: Callable[[Block], tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of numbers and numbers of rows by cell; `counted` gives the cells and numbers, if any, of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for batch in batches:
            for block in Block.of(batch):
                cell, value = counted(block)
                # Sums of whole numbers, exact as doubles within a block.
                if value is not None:
                    total[0] += np.bincount(cell, value, cells).astype(np.int64)
                total[1] += np.bincount(cell, minlength=cells)
        first = [i for i in range(0, cells, CELLS_PER_ROW) if total[1, i : i + CELLS_PER_ROW].any()]
        sums = [total[:, i : i + CELLS_PER_ROW].tobytes() for i in first]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(sums, pa.binary())], ["cell", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["sums"])
        return pa.table({"cell": rows["cell"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    # A task gives a cell once and there is a task a core, so what is shuffled is bounded whatever the table.
    few = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, CELLS_DDL).repartition(1 + cells // CELLS_PER_TASK, "cell")
    total = np.zeros((2, cells), np.int64)
    for batch in parts.groupBy("cell").applyInArrow(added, CELLS_DDL).toArrow().to_batches():
        for cell, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[:, cell : cell + CELLS_PER_ROW] = np.frombuffer(sums.as_buffer(), np.int64).reshape(2, -1)
    return total[0], total[1]


def _histogram(blocks: DataFrame, tree: Tree, number: int, depth: int, open_nodes: list[int], bins: list[int], loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows by open node, feature and bin (the first one: nulls)."""
    place = np.full(len(tree.child), -1)
    place[open_nodes] = np.arange(len(open_nodes))
    width = max(bins) + 1
    # One row of cells a node; a feature takes only as many as it has bins.
    first = np.concatenate([[0], np.cumsum([b + 1 for b in bins])])

    def counted(block: Block) -> tuple[np.ndarray, np.ndarray]:
        block = block.seen_by(number)
        at, g, own = place[_reached(tree, depth, block.bins)], block.gradient(loss), block.bins
        if depth:
            some = at >= 0
            at, g, own = at[some], g[some], own[:, some]
        return (at * first[-1] + 1 + first[:-1, None] + own).ravel(), np.tile(g.astype(float), len(bins))

    sums = _summed(blocks, len(open_nodes) * int(first[-1]), counted)
    out = []
    for cells in sums:
        cells, full = cells.reshape(len(open_nodes), -1), np.zeros((len(open_nodes), len(bins), width), np.int64)
        for feature in range(len(bins)):
            full[:, feature, : bins[feature] + 1] = cells[:, first[feature] : first[feature + 1]]
        out.append(full)
    return out[0], out[1]


def best_splits(
    gradient: np.ndarray, number: np.ndarray, cuts: list[int], params: BoostParams, reg_lambda: float = REG_LAMBDA
) -> Iterator[tuple[int, int, bool, tuple[int, int], tuple[int, int]] | None]:
    """For each node the best (feature, cut, nulls go left, sums of the left, sums of the right), or None.

    Ties go to the first feature, then to nulls on the right, then to the lowest cut.
    """
    least = max(params.min_child_weight, 1e-9)

    def part(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        real = g / float(UNIT)
        return real * real / (n + reg_lambda)

    for node in range(len(gradient)):
        total, rows = int(gradient[node, 0].sum()), int(number[node, 0].sum())
        whole = part(np.array(total), np.array(rows))
        best, choice = -1.0, None
        for feature, many in enumerate(cuts):
            if not many:
                continue
            g, n = gradient[node, feature], number[node, feature]
            for nulls_left in (False, True) if n[0] else (False,):
                left_g = np.cumsum(g[1:])[:many] + (g[0] if nulls_left else 0)
                left_n = np.cumsum(n[1:])[:many] + (n[0] if nulls_left else 0)
                gain = part(left_g, left_n) + part(total - left_g, rows - left_n) - whole
                able = (left_n >= least) & (rows - left_n >= least) & (gain > LEAST_GAIN) & (gain >= params.gamma)
                if able.any():
                    at = int(np.where(able, gain, -1.0).argmax())
                    if gain[at] > best:
                        best = float(gain[at])
                        sums = (int(left_g[at]), int(left_n[at]))
                        choice = (feature, at, nulls_left, sums, (total - sums[0], rows - sums[1]))
        yield choice


def _both(parent: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sums of pairs of nodes from those of their parents and of the ones at the places `at`, which are `own`."""
    out = np.empty((2 * len(own), *own.shape[1:]), own.dtype)
    out[at], out[at ^ 1] = own, parent - own
    return out


def _grow(blocks: DataFrame, number: int, cuts: list[int], params: BoostParams, reg_lambda: float) -> Tree:
    """The tree `number` on its rows; leaf values are Newton steps."""
    tree = Tree()
    open_nodes, sums = [0], {}
    bins = [c + 1 for c in cuts]
    for depth in range(params.max_depth):
        if not depth:
            gradient, rows = _histogram(blocks, tree, number, depth, open_nodes, bins, params.loss)
            sums[0] = (int(gradient[0, 0].sum()), int(rows[0, 0].sum()))
        else:
            # Pairs of children: the one with fewer rows is counted, the other has the rest.
            fewer = np.array([int(sums[right][1] < sums[left][1]) for left, right in zip(open_nodes[::2], open_nodes[1::2], strict=True)])
            at = 2 * np.arange(len(fewer)) + fewer
            counted = _histogram(blocks, tree, number, depth, [open_nodes[i] for i in at], bins, params.loss)
            gradient, rows = (_both(parent[split], own, at) for parent, own in zip((gradient, rows), counted, strict=True))
        below, split = [], []
        for place, (node, choice) in enumerate(zip(open_nodes, best_splits(gradient, rows, cuts, params, reg_lambda), strict=True)):
            if choice is not None:
                feature, cut, nulls_left, *sides = choice
                children = tree.split(node, feature, cut, nulls_left)
                sums.update(zip(children, sides, strict=True))
                below += children
                split.append(place)
        open_nodes = below
        if not open_nodes:
            break
    for node, (g, n) in sums.items():
        tree.rows[node] = n
        tree.value[node] = int(np.floor(-(g / float(UNIT)) / (n + reg_lambda) * params.learning_rate * UNIT + 0.5)) if n else 0
    return tree


def _medians(blocks: DataFrame, tree: Tree, number: int, params: BoostParams, low: int, high: int) -> None:
    """Leaf values under the absolute loss: the shrunk median (the lower of two) of what is left in each leaf, exactly.

    What is left lies in `low` to `high`. A pass cuts the interval of each leaf into cells, counts the rows in them,
    and goes on with the cell that has the median until cells are one unit wide: three passes for a day of minutes
    and a thousand leaves. So no row leaves the task that walks it.
    """
    leaves = np.flatnonzero(np.array(tree.child) < 0)
    place = np.zeros(len(tree.child), np.int64)
    place[leaves] = np.arange(len(leaves))
    cells = max(MEDIAN_CELLS // len(leaves), LEAST_CELLS)
    start, width, rank = np.full(len(leaves), low, np.int64), high - low + 1, None
    while width > 1 or rank is None:
        width = -(-width // cells)

        def counted(block: Block) -> tuple[np.ndarray, None]:
            block = block.seen_by(number)
            leaf = place[_reached(tree, params.max_depth, block.bins)]
            cell = (block.y - start[leaf]) // width
            inside = (cell >= 0) & (cell < cells)
            return (leaf * cells + cell)[inside], None

        found = _summed(blocks, len(leaves) * cells, counted)[1].reshape(len(leaves), cells).cumsum(1)
        if rank is None:
            rows = found[:, -1]
            rank = (rows - 1) // 2
        at = (found <= rank[:, None]).sum(1)
        rank = rank - np.where(at > 0, found[np.arange(len(leaves)), at - 1], 0)
        start = start + at * width
    for node, value in zip(leaves[rows > 0], start[rows > 0], strict=True):
        tree.value[node] = int(np.floor(int(value) * params.learning_rate + 0.5))


def _moved(blocks: DataFrame, by: Callable[[Block], np.ndarray]) -> DataFrame:
    """The blocks with predictions moved by whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in Block.of(batch):
                yield replace(block, y=block.y - by(block)).batch()

    return blocks.mapInArrow(run, BLOCK_DDL)


def fit(
    train: DataFrame, params: BoostParams, features: Sequence[str] = FEATURES, target: str = TARGET, key: str = "seq_id",
    seed: int = SEED, max_bins: int = MAX_BINS, reg_lambda: float = REG_LAMBDA,
) -> BoostedModel:
    """Fit `params.n_estimators` trees to the rows with a label.

    The first prediction is the mean label, or the median under the absolute loss. With
    `subsample` below one, each tree sees the rows that a hash of seed, tree and key draws.
    Without a labelled row there is nothing to fit and a ValueError is raised.
    """
    spark = train.sparkSession
    ship_package(spark)
    labelled = train.where(F.col(target).isNotNull())
    units = F.floor(F.col(target) * UNIT + F.lit(0.5)).cast("bigint")
    extent = F.sum(units), F.count(F.lit(1)), F.min(units), F.max(units)
    total, rows, low, high, base = labelled.agg(*extent, F.percentile_approx(units, 0.5, MEDIAN_ACCURACY)).first()
    if not rows:
        raise ValueError(f"no row has {target}")
    cuts = cut_points(labelled, features, max_bins)
    if params.loss == "squared":
        base = (2 * total + rows) // (2 * rows)  # the nearest whole unit
    model = BoostedModel(list(features), cuts, base, params)
    table = _moved(_blocks(train, features, cuts, target, key, params, seed), lambda block: np.int64(base))
    if rows > BLOCK_ROWS:  # blocks are dealt evenly, whatever files the rows came from
        table = table.repartition(min(-(-rows // BLOCK_ROWS), 4 * spark.sparkContext.defaultParallelism))
    table = materialise(table, "binned-rows")
    low, high = low - base, high - base  # what is left of the labels
    for number in range(params.n_estimators):
        tree = _grow(table, number, [len(c) for c in cuts], params, reg_lambda)
        if params.loss == "absolute":
            _medians(table, tree, number, params, low, high)
            steps = [value for value, child in zip(tree.value, tree.child, strict=True) if child < 0]
            low, high = low - max(steps), high - min(steps)
        model.trees.append(tree)
        if number + 1 < params.n_estimators:
            before, value = table, np.array(tree.value, np.int64)
            table = materialise(_moved(before, lambda block: value[_reached(tree, params.max_depth, block.bins)]), "margins")
            forget(spark, before)
    forget(spark, table)
    return model
