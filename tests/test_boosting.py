import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridecast.operators import sampling
from ridecast.operators.metrics import regression_scores
from ridecast.plans import boosting, search
from ridecast.plans.training import BoostParams

UNIT = boosting.UNIT
NAMES = ["a", "b", "c"]


def sample(n, seed=3, nulls=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 40)), float(rng.integers(0, 3)), float(rng.normal())
        y = round((3 * (a > 17) + 2 * b * (c > 0) + (4 if b == 1 else 0) + rng.normal() / 4) * 4) / 4
        hide = nulls and rng.random(3) < 0.1
        x = [None if nulls and h else v for v, h in zip((a, b, c), hide if nulls else (False,) * 3, strict=True)]
        rows.append((i, *x, y))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "seq_id INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE").repartition(3)


def goes_right(row, feature, cut, nulls_left):
    value = row["x"][feature]
    return not nulls_left if value is None else value > cut


def part(rows, lam):
    g = sum(r["g"] for r in rows) / UNIT
    return g * g / (len(rows) + lam)


def grow(rows, cuts, params, depth, lam):
    """A tree by definition: every split of every feature is tried on the rows themselves."""
    best = None
    if depth:
        for feature, values in enumerate(cuts):
            missing = any(r["x"][feature] is None for r in rows)
            for nulls_left in (False, True) if missing else (False,):
                for cut in values:
                    left = [r for r in rows if not goes_right(r, feature, cut, nulls_left)]
                    right = [r for r in rows if goes_right(r, feature, cut, nulls_left)]
                    if min(len(left), len(right)) < max(params.min_child_weight, 1):
                        continue
                    gain = part(left, lam) + part(right, lam) - part(rows, lam)
                    if gain > 1e-6 and gain >= params.gamma and (best is None or gain > best[0]):
                        best = gain, feature, cut, nulls_left, left, right
    if best is None:
        g = sum(r["g"] for r in rows) / UNIT
        return math.floor(-g / (len(rows) + lam) * params.learning_rate * UNIT + 0.5)
    _, feature, cut, nulls_left, left, right = best
    return feature, cut, nulls_left, grow(left, cuts, params, depth - 1, lam), grow(right, cuts, params, depth - 1, lam)


def walk(tree, row):
    while isinstance(tree, tuple):
        feature, cut, nulls_left, left, right = tree
        tree = right if goes_right(row, feature, cut, nulls_left) else left
    return tree


def brute(rows, params, bins, lam=1.0):
    data = [{"x": list(r[1:4]), "y": math.floor(r[4] * UNIT + 0.5)} for r in rows]
    cuts = []
    for feature in range(3):
        values = sorted(r["x"][feature] for r in data if r["x"][feature] is not None)
        cuts.append(sorted({values[k * len(values) // bins] for k in range(1, bins)}))
    base = math.floor(sum(r["y"] for r in data) / len(data) + 0.5)
    for r in data:
        r["m"] = base
    for _ in range(params.n_estimators):
        for r in data:
            r["g"] = r["m"] - r["y"]
        tree = grow(data, cuts, params, params.max_depth, lam)
        for r in data:
            r["m"] += walk(tree, r)
    return {r[0]: d["m"] / UNIT for r, d in zip(rows, data, strict=True)}


@pytest.mark.parametrize(
    "params",
    [BoostParams(3, 3, 0.3), BoostParams(2, 2, 0.5, gamma=30, min_child_weight=12), BoostParams(2, 4, 1.0, min_child_weight=0)],
)
def test_trees_against_trees_by_definition(spark, params):
    rows = sample(180)
    model = boosting.fit(table(spark, rows), params, NAMES, "y", max_bins=12)
    got = {r["seq_id"]: r["prediction"] for r in model.predict(table(spark, rows)).collect()}
    assert got == brute(rows, params, 12)
    assert len(model.trees) == params.n_estimators and len(set(got.values())) > 3


def test_gamma_and_child_weight_hold_in_every_node(spark):
    rows = sample(300)
    plain = boosting.fit(table(spark, rows), BoostParams(1, 6, 0.5), NAMES, "y", max_bins=16)
    held = boosting.fit(table(spark, rows), BoostParams(1, 6, 0.5, gamma=8, min_child_weight=20), NAMES, "y", max_bins=16)
    assert 1 < len(held.trees[0].child) < len(plain.trees[0].child)
    assert all(n >= 20 for n in held.trees[0].rows)
    alone = boosting.fit(table(spark, rows), BoostParams(2, 6, 0.5, gamma=10**6), NAMES, "y", max_bins=16)
    assert all(t.child == [-1] for t in alone.trees)


def test_first_tree_is_shrunk_and_the_order_of_rows_does_not_matter(spark):
    rows = sample(150, nulls=False)
    model = boosting.fit(table(spark, rows), BoostParams(1, 2, 0.01), NAMES, "y", max_bins=8)
    spread = [r["prediction"] - model.base / UNIT for r in model.predict(table(spark, rows)).collect()]
    assert 0 < max(map(abs, spread)) < 0.05
    again = boosting.fit(table(spark, rows[::-1]).repartition(7, "b"), BoostParams(1, 2, 0.01), NAMES, "y", max_bins=8)
    assert again == model


def test_absolute_loss_steps_to_medians(spark):
    rows = [(i, float(i % 2), 0.0, 0.0, [1.0, 2.0, 30.0][i // 2 % 3] + 10 * (i % 2)) for i in range(60)]
    model = boosting.fit(table(spark, rows), BoostParams(1, 1, 0.5, loss="absolute"), NAMES, "y")
    got = {r["a"]: r["prediction"] for r in model.predict(table(spark, rows)).collect()}
    base = model.base / UNIT
    assert got == {0.0: base + (2 - base) / 2, 1.0: base + (12 - base) / 2}


def test_stages_equal_shorter_fits_and_samples_differ_by_tree(spark):
    rows, params = sample(150), BoostParams(4, 2, 0.4, subsample=0.6)
    df = table(spark, rows)
    model = boosting.fit(df, params, NAMES, "y", max_bins=10)
    short = boosting.fit(df, BoostParams(2, 2, 0.4, subsample=0.6), NAMES, "y", max_bins=10)
    staged = {r["seq_id"]: (r["two"], r["four"]) for r in model.staged(df, [2, 4], ["two", "four"]).collect()}
    assert {k: v[0] for k, v in staged.items()} == {r["seq_id"]: r["prediction"] for r in short.predict(df).collect()}
    assert {k: v[1] for k, v in staged.items()} == {r["seq_id"]: r["prediction"] for r in model.predict(df).collect()}
    assert model.first(2) == short
    assert len({t.rows[0] for t in model.trees}) > 1 and all(50 < t.rows[0] < 130 for t in model.trees)


def test_saved_model_nodes_and_feature_use(spark, tmp_path):
    rows = sample(120)
    model = boosting.fit(table(spark, rows), BoostParams(2, 3, 0.3), NAMES, "y", max_bins=8)
    model.save(spark, str(tmp_path / "model"))
    assert boosting.BoostedModel.load(spark, str(tmp_path / "model")) == model
    nodes = model.nodes(spark)
    splits = nodes.where("feature IS NOT NULL").count()
    assert splits * 2 + 2 == nodes.count()
    use = {r["feature"]: r["splits"] for r in model.feature_use(spark).collect()}
    assert set(use) == set(NAMES) and sum(use.values()) == splits


def test_odd_tables(spark):
    empty = table(spark, [(1, 1.0, 1.0, 1.0, None)])
    with pytest.raises(ValueError):
        boosting.fit(empty, BoostParams(1, 1, 0.5), NAMES, "y")
    rows = [(i, None, 1.0, 1.0, float(i % 4)) for i in range(20)] + [(99, 1.0, 1.0, 1.0, None)]
    model = boosting.fit(table(spark, rows), BoostParams(2, 3, 0.5), NAMES, "y")
    assert model.cuts[0] == [1.0] or model.cuts[0] == []
    assert {r["prediction"] for r in model.predict(table(spark, rows)).collect()} == {1.5}
    assert boosting.fit(table(spark, rows), BoostParams(0, 3, 0.5), NAMES, "y").predict(table(spark, rows)).agg(F.min("prediction")).first()[0] == 1.5


def test_staged_search_shares_fits_and_goes_on(spark, tmp_path, monkeypatch):
    df = table(spark, sample(160)).withColumnRenamed("y", "duration_min")
    folds = sampling.hash_folds(df, ["seq_id"], 2).cache()
    grid = search.parameter_grid(spark, {
        "n_estimators": [1, 3], "max_depth": [2], "learning_rate": [0.3, 0.6], "subsample": [1.0], "gamma": [0], "min_child_weight": [1],
    })
    fits, plain = [], boosting.fit

    def counted(*args, **kwargs):
        fits.append(args[1])
        return plain(*args, **kwargs)

    monkeypatch.setattr(boosting, "fit", counted)
    path = str(tmp_path / "scores")
    some = grid.where("learning_rate = 0.3")
    first = search.staged_search(folds, some, path, features=NAMES, max_bins=8)
    assert first.count() == 4 and [f.n_estimators for f in fits] == [3, 3]
    scores = search.staged_search(folds, grid, path, features=NAMES, max_bins=8)
    assert scores.count() == 8 and len(fits) == 4
    assert search.staged_search(folds, grid, path, features=NAMES, max_bins=8).count() == 8 and len(fits) == 4
    assert search.staged_search(folds, some, path, features=NAMES, max_bins=8).count() == 4
    for row in scores.where("learning_rate = 0.6 AND fold = 1").collect():
        model = plain(folds.where("fold <> 1"), BoostParams(row["n_estimators"], 2, 0.6), NAMES, max_bins=8)
        direct = regression_scores(model.predict(folds.where("fold = 1")), "duration_min", "prediction").first()
        assert (row["mae"], row["r2"]) == pytest.approx((direct["mae"], direct["r2"]))
    results = search.search_results(scores)
    best = search.refit_best_boosted(df, results, features=NAMES)
    least = min(results.collect(), key=lambda r: r["mae_avg"])
    assert (len(best.trees), best.params.learning_rate) == (least["regressor__n_estimators"], least["regressor__learning_rate"])


def test_blocks_hold_bins_labels_and_draws(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 1)
    values = [None, float("nan"), -1.0, 0.0, -0.0, 2.0, 7.0]
    df = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)] + [(99, 1.0, None)], "seq_id LONG, a DOUBLE, y DOUBLE").coalesce(1)
    params = BoostParams(11, 2, 0.5, subsample=0.5)
    found = boosting._blocks(df, ["a"], [[0.0, 2.0]], "y", "seq_id", params, 7).toArrow().combine_chunks().to_batches()
    (block,) = [b for batch in found for b in boosting.Block.of(batch)]
    assert block.bins.tolist() == [[-1, 2, 0, 0, 0, 1, 2]] and block.y.tolist() == [i * UNIT for i in range(7)]
    for number in range(11):
        chance = F.pmod(F.xxhash64(F.lit(7), F.lit(number), "seq_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        drawn = [int(r["y"]) for r in df.where("y IS NOT NULL").where(chance < 0.5).select("y").collect()]
        assert (block.seen_by(number).y // UNIT).tolist() == sorted(drawn)


def test_a_level_sums_its_cells_in_few_partitions(spark, monkeypatch):
    df, seen = table(spark, sample(90)), []
    plain = type(df).repartition

    def repartition(self, *args):
        seen.append(args)
        return plain(self, *args)

    monkeypatch.setattr(type(df), "repartition", repartition)
    boosting.fit(df, BoostParams(1, 2, 0.5), NAMES, "y", max_bins=8)
    assert seen == [(1, "cell"), (1, "cell")]


def test_blocks_of_one_file_are_dealt_to_tasks(spark, monkeypatch):
    tables, written = {}, boosting.materialise

    def kept(df, name):
        tables[name] = df.rdd.getNumPartitions()
        return written(df, name)

    monkeypatch.setattr(boosting, "materialise", kept)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    df = table(spark, sample(200))
    model = boosting.fit(df.coalesce(1), BoostParams(1, 2, 0.5), NAMES, "y", max_bins=8)
    assert tables["binned-rows"] == 5
    assert model == boosting.fit(df, BoostParams(1, 2, 0.5), NAMES, "y", max_bins=8)


def test_medians_of_large_leaves_are_exact_whatever_the_partitions(spark):
    rng = np.random.default_rng(4)
    labels = {k: np.sort(np.unique(np.floor(rng.lognormal(3 + k, 1, 70_000) * UNIT) / UNIT)) for k in (0, 1)}
    rows = [(float(k), float(y)) for k in labels for y in rng.permutation(labels[k])]
    df = spark.createDataFrame(rows, "a DOUBLE, y DOUBLE").withColumns({"b": F.lit(0.0), "c": F.lit(0.0), "seq_id": F.monotonically_increasing_id()})
    model = boosting.fit(df.repartition(5), BoostParams(1, 1, 1.0, loss="absolute"), NAMES, "y")
    at = {r["a"]: r["prediction"] for r in model.predict(df).select("a", "prediction").distinct().collect()}
    assert at == {float(k): labels[k][(len(labels[k]) - 1) // 2] for k in labels}
    again = boosting.fit(df.repartition(2, "y"), BoostParams(1, 1, 1.0, loss="absolute"), NAMES, "y")
    assert {r["a"]: r["prediction"] for r in again.predict(df).select("a", "prediction").distinct().collect()} == at


@pytest.mark.parametrize("cells", [1, 5, 300])
def test_absolute_trees_of_several_levels_have_the_medians_of_their_leaves(spark, monkeypatch, cells):
    monkeypatch.setattr(boosting, "MEDIAN_CELLS", cells)
    monkeypatch.setattr(boosting, "LEAST_CELLS", 2)
    rows, params = sample(150), BoostParams(3, 3, 0.5, loss="absolute")
    df = table(spark, rows)
    model = boosting.fit(df, params, NAMES, "y", max_bins=8)
    staged = model.staged(df, [0, 1, 2, 3], ["s0", "s1", "s2", "s3"]).collect()
    units = {r["seq_id"]: math.floor(r["y"] * UNIT + 0.5) for r in staged}
    for k in range(3):
        leaves = {}
        for r in staged:
            step = round((r[f"s{k + 1}"] - r[f"s{k}"]) * UNIT)
            leaves.setdefault(step, []).append(units[r["seq_id"]] - round(r[f"s{k}"] * UNIT))
        for step, left in leaves.items():  # leaves with one step may be several
            assert math.floor(sorted(left)[(len(left) - 1) // 2] * 0.5 + 0.5) == step or len(leaves) < model.trees[k].child.count(-1)
    assert len({r["s3"] for r in staged}) > 4


def test_the_smaller_of_two_children_is_counted(spark, monkeypatch):
    seen, plain = [], boosting._histogram

    def histogram(blocks, tree, number, depth, open_nodes, bins, loss):
        out = plain(blocks, tree, number, depth, open_nodes, bins, loss)
        seen.append((tree, depth, list(open_nodes), out[1][:, 0].sum(1).tolist()))
        return out

    monkeypatch.setattr(boosting, "_histogram", histogram)
    boosting.fit(table(spark, sample(200)), BoostParams(1, 4, 0.5), NAMES, "y", max_bins=8)
    assert len(seen) == 4 and len(seen[-1][2]) > 2
    for tree, depth, nodes, rows in seen[1:]:
        pairs = {tuple(sorted((left, left + 1))) for left in tree.child if left >= 0}
        assert all(sum(n in pair for n in nodes) <= 1 for pair in pairs)
        assert rows == [tree.rows[n] for n in nodes] and all(min(tree.rows[p] for p in pair) == tree.rows[n] for n in nodes for pair in pairs if n in pair)


def test_arrays_of_a_block_are_narrow(spark):
    df = table(spark, sample(90))
    found = boosting._blocks(df, NAMES, [[1.0] * 255] * 3, "y", "seq_id", BoostParams(3, 2, 0.5), 7).toArrow()
    assert sum(len(b) for b in found["bins"].to_pylist()) == 90 * 3 * 2
    assert found.column_names == ["rows", "features", "bins", "y", "drawn"]
