import numpy as np
import pytest
from pyspark.sql import functions as F

from ridecast.operators import metrics
from ridecast.schemas import METRICS


def expected(y, p):
    y, p = np.asarray(y), np.asarray(p)
    e = y - p
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (e**2).sum() / total if total else float((e**2).sum() == 0)
    return (np.abs(e).mean(), np.median(np.abs(e)), (e**2).mean(), np.sqrt((e**2).mean()), r2)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        y = float(rng.normal(10, 4))
        rows.append((["hot", "hot", "hot", "cold", None][i % 5], y, y + float(rng.normal(0, 2))))
    return spark.createDataFrame(rows, "k STRING, y DOUBLE, p DOUBLE").cache()


def test_scores_match_plain_arithmetic(pairs):
    pdf = pairs.toPandas()
    row = metrics.score_row(pairs, "y", "p", "m").first()
    assert row.id == "m" and tuple(row)[1:] == pytest.approx(expected(pdf.y, pdf.p))


def test_grouped_scores_keep_the_null_group(pairs):
    got = {r.k: tuple(r)[1:] for r in metrics.regression_scores(pairs, "y", "p", ["k"]).collect()}
    pdf = pairs.toPandas()
    assert len(got) == 3
    for key, group in pdf.groupby("k", dropna=False):
        assert got[key if isinstance(key, str) else None] == pytest.approx(expected(group.y, group.p))


@pytest.mark.parametrize("predicted,r2", [([2.0, 2.0], 1.0), ([2.0, 3.0], 0.0)])
def test_constant_truth(frame, predicted, r2):
    df = frame([(2.0, p) for p in predicted], "y DOUBLE, p DOUBLE")
    assert metrics.regression_scores(df, "y", "p").first().r2 == r2


def test_missing_values_raise(frame):
    df = frame([(2.0, 1.0), (None, 1.0)], "y DOUBLE, p DOUBLE")
    with pytest.raises(Exception, match="y or p is null"):
        metrics.regression_scores(df, "y", "p").collect()
    # Rows that the caller filters out before do not.
    assert metrics.regression_scores(df.where("y IS NOT NULL"), "y", "p").first().mae == 1.0


def table(frame, rows):
    return frame([(i, m, m, m, m, m) for i, m in rows], "id STRING, " + ", ".join(f"{m} DOUBLE" for m in METRICS), 1)


def test_stacking_and_duplicates(frame):
    a, b = table(frame, [("a", 1.0), ("b", 2.0)]), table(frame, [("a", 1.0), ("c", 1.0)])
    assert sorted(r.id for r in metrics.stack_scores(a, b).collect()) == ["a", "b", "c"]
    assert metrics.stack_scores(a, b, ignore_id=True).count() == 2


def test_search_table_uses_the_population_deviation(frame):
    rows = [(1, f, *[float(f + i) for i in range(5)]) for f in range(4)] + [(2, 0, *[1.0] * 5)]
    df = frame(rows, "depth INT, fold INT, " + ", ".join(f"{m} DOUBLE" for m in METRICS))
    got = {r.depth: r for r in metrics.search_table(df, ["depth"]).collect()}
    assert got[1].mae_avg == 1.5 and got[1].mae_std == pytest.approx(np.std([0, 1, 2, 3])) and got[2].mae_std == 0.0


def test_best_first_minimises_errors_and_maximises_r2(frame):
    df = frame([(1, 3.0, 0.1), (2, 1.0, 0.3), (3, 2.0, 0.2), (4, 1.0, 0.0)], "depth INT, mae_avg DOUBLE, r2_avg DOUBLE")
    assert [r.depth for r in metrics.best_first(df, "mae", 2).collect()] == [2, 4]
    assert [r.depth for r in metrics.best_first(df, "r2", 2).collect()] == [2, 3]
    plan = metrics.best_first(df, "mae", 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_aggregates_are_reusable(pairs):
    found = pairs.agg(metrics.metric_aggregates(F.col("y"), F.col("y") - F.col("p"))["mae"].alias("v")).first().v
    pdf = pairs.toPandas()
    assert found == pytest.approx(np.abs(pdf.y - pdf.p).mean())
