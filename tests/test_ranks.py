import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridecast.operators import ranks

PROBS = [0.0, 0.25, 0.5, 0.95, 1.0]


def quantiles(df, value="x", by=(), probs=PROBS, **options):
    rows = ranks.exact_quantiles(df, value, probs, by, **options).collect()
    return {(*[r[k] for k in by], r.prob): r.quantile for r in rows}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_subnormal=False), st.sampled_from([0.0, 1.5, -2.0])), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE").repartition(3)
    known = [v for v in values if v is not None]
    got = quantiles(df)
    assert len(got) == (len(PROBS) if known else 0)
    for prob in PROBS if known else ():
        assert got[(prob,)] == pytest.approx(np.quantile(known, prob), rel=1e-12, abs=1e-9)


def test_linear_interpolation_of_squares(frame):
    df = frame([(float(i * i),) for i in range(11)], "x DOUBLE")
    assert quantiles(df, probs=[0.95])[(0.95,)] == pytest.approx(90.5)


def test_many_values_use_many_cells(spark):
    """More distinct values than cells, with an outlier and a value that holds a third of the rows."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.25).when(F.col("id") == 1, 1e300).otherwise(F.exp(F.rand(5) * 20)).alias("x")
    ).cache()
    values = [r.x for r in df.collect()]
    got = quantiles(df, probs=[0.0, 0.1, 0.333, 0.5, 0.9, 0.999, 1.0])
    for (prob,), value in got.items():
        assert value == pytest.approx(np.quantile(values, prob), rel=1e-12)


@pytest.mark.parametrize("few_groups", [False, True])
def test_grouped_with_a_hot_and_a_null_group(spark, few_groups):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 8.0).alias("x"),
    ).cache()
    data = df.toPandas()
    got = quantiles(df, by=["k"], few_groups=few_groups)
    assert len(got) == len(PROBS) * data.k.nunique(dropna=False)
    for key, group in data.groupby("k", dropna=False):
        for prob in PROBS:
            assert got[(key if isinstance(key, str) else None, prob)] == pytest.approx(np.quantile(group.x, prob))


def test_few_cells_give_the_same_result(spark):
    counts = ranks.value_counts_of(spark.range(500).select((F.col("id") % 97).alias("x")), "x")
    want = lambda total: F.array(*[F.struct(F.lit(r).cast("bigint").alias("rank")) for r in (0, 7, 250, 499, 500)])
    expected = sorted(i % 97 for i in range(500))
    for levels in (1, 5):
        rows = ranks.values_at_ranks(counts, want, levels=levels).collect()
        assert {r.want.rank: r.value for r in rows} == {r: expected[r] for r in (0, 7, 250, 499)}


def test_row_form_is_one_row_even_without_values(frame):
    empty = frame([(None,)], "x DOUBLE")
    assert [tuple(r) for r in ranks.quantile_row(empty, "x", [0.5], ["m"]).collect()] == [(None,)]
    one = frame([(3.0,)], "x DOUBLE")
    assert tuple(ranks.quantile_row(one, "x", [0.1, 0.9], ["a", "b"]).first()) == (3.0, 3.0)


def test_counted_values_are_shuffled_once(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    result = ranks.quantile_row(df, "x", [0.5], ["m"])
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2
    assert "percentile(" not in plan


def test_approximate_form(spark):
    df = spark.range(1001).select(F.col("id").alias("x"))
    got = {r.prob: r.quantile for r in ranks.approximate_quantiles(df, "x", [0.25, 0.5]).collect()}
    assert got == {0.25: 250.0, 0.5: 500.0}
