import math

import pytest
from pyspark.sql import functions as F

from ridecast.operators import sampling

KEY = ["id"]


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(1003).select(F.col("id"), (F.col("id") * 3 - 500).alias("order")).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_fraction_is_repeatable_and_without_replacement(data):
    drawn = ids(sampling.sample_fraction(data, 0.15, KEY, seed=1))
    assert len(drawn) == len(set(drawn)) and abs(len(drawn) - 150) < 50
    assert drawn == ids(sampling.sample_fraction(data.repartition(7), 0.15, KEY, seed=1))
    assert drawn != ids(sampling.sample_fraction(data, 0.15, KEY, seed=2))


@pytest.mark.parametrize("fraction", [0.0, 0.15, 0.5, 1.0])
def test_exact_size(data, fraction):
    drawn = ids(sampling.sample_exact(data, fraction, KEY, seed=1))
    assert len(drawn) == len(set(drawn)) == round(fraction * 1003)
    assert drawn == ids(sampling.sample_exact(data.repartition(5), fraction, KEY, seed=1))


def test_exact_sample_takes_the_smallest_hashes(data):
    by_hash = [r.id for r in data.orderBy(sampling.row_hash(KEY, 1, sampling.SAMPLE)).limit(150).collect()]
    assert ids(sampling.sample_exact(data, 150 / 1003, KEY, seed=1)) == sorted(by_hash)


def test_exact_sample_neither_sorts_nor_limits_the_table(data):
    plan = sampling.sample_exact(data, 0.15, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("rows", [0, 1, 2, 5])
def test_small_tables(data, rows):
    few = data.where(F.col("id") < rows)
    assert sampling.sample_exact(few, 0.5, KEY).count() == round(0.5 * rows)
    marked = sampling.with_split(few, KEY, 0.2, exact=True)
    assert marked.where("split = 'test'").count() == math.ceil(0.2 * rows) and marked.count() == rows


@pytest.mark.parametrize("exact", [False, True])
def test_split_covers_and_is_disjoint(data, exact):
    train, test = sampling.train_test(data, KEY, 0.2, seed=5, exact=exact)
    a, b = ids(train), ids(test)
    assert sorted(a + b) == list(range(1003)) and not set(a) & set(b)
    assert len(b) == 201 if exact else abs(len(b) - 201) < 60
    assert b == ids(sampling.train_test(data.repartition(9), KEY, 0.2, seed=5, exact=exact)[1])


def test_hash_folds(data):
    folds = sampling.hash_folds(data, KEY, 4, seed=1).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3] and sum(r["count"] for r in folds) == 1003
    assert min(r["count"] for r in folds) > 180


@pytest.mark.parametrize("rows,folds", [(1003, 4), (1000, 4), (3, 4), (10, 3)])
def test_contiguous_folds(data, rows, folds):
    few = data.where(F.col("id") < rows)
    got = [r.fold for r in sampling.contiguous_folds(few, "order", folds).orderBy("order").collect()]
    sizes = [rows // folds + (i < rows % folds) for i in range(folds)]
    assert got == [i for i, size in enumerate(sizes) for _ in range(size)]


def test_contiguous_folds_do_not_gather_the_table(data):
    marked = sampling.contiguous_folds(data, "order", 4)
    marked.collect()
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def within(n, whole, share):
    return abs(n - whole * share) <= 5 * math.sqrt(whole * share * (1 - share)) + 1


@pytest.mark.parametrize("exact", [False, True])
def test_chains_take_their_own_share(data, exact):
    sample = sampling.sample_exact if exact else sampling.sample_fraction
    drawn = sample(data, 0.5, KEY, seed=1).cache()
    train, test = sampling.train_test(drawn, KEY, 0.2, seed=1, exact=exact)
    assert within(test.count(), drawn.count(), 0.2) and train.count() + test.count() == drawn.count()
    inner = sampling.train_test(train, KEY, 0.25, seed=1, exact=exact, salt="validation")[1]
    assert within(inner.count(), train.count(), 0.25)
    whole = sampling.train_test(data, KEY, 0.2, seed=1, exact=exact)[0]
    assert within(sample(whole, 0.3, KEY, seed=1).count(), whole.count(), 0.3)
    folds = [r["count"] for r in sampling.hash_folds(train, KEY, 4, seed=1).groupBy("fold").count().collect()]
    assert len(folds) == 4 and all(within(n, train.count(), 0.25) for n in folds)
    again = sample(drawn, 0.5, KEY, seed=1, salt="again")
    assert within(again.count(), drawn.count(), 0.5)
