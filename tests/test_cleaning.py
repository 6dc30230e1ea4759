import numpy as np
import pytest
from pyspark.sql import functions as F

from ridecast.operators import cleaning
from ridecast.operators.cleaning import DropNulls, KeepFlag, TrimQuantile


@pytest.fixture(scope="module")
def data(spark):
    rows = []
    for i in range(400):
        rows.append((i, i % 4 != 0, float(i % 50) - 2.0 if i % 11 else None, None if i % 9 == 0 else float(i)))
    df = spark.createDataFrame(rows, "id INT, covered BOOLEAN, duration_min DOUBLE, avg_duration_prev_7days DOUBLE")
    return df.select("id", F.col("covered").cast("int").alias("has_precip_data"), "duration_min", "avg_duration_prev_7days").cache()


def pandas_clean(pdf, q, nulls_first):
    removed = []
    steps = ["null", "trim"] if nulls_first else ["flag", "trim", "null"]
    for step in steps:
        total = len(pdf)
        if step == "flag":
            pdf = pdf[pdf.has_precip_data == 1]
        elif step == "null":
            columns = ["avg_duration_prev_7days"] + (["duration_min"] if nulls_first else [])
            pdf = pdf.dropna(subset=columns)
        else:
            bound = pdf.duration_min.quantile(q)
            pdf = pdf[(pdf.duration_min > 0) & (pdf.duration_min <= bound)]
        removed.append((total - len(pdf), total))
    return set(pdf.id), removed


TRAIN = cleaning.TRAINING_STEPS
STUDY = (DropNulls(("avg_duration_prev_7days", "duration_min")), TrimQuantile("duration_min", 0.98))


@pytest.mark.parametrize("steps,q,nulls_first", [(TRAIN, 0.95, False), (STUDY, 0.98, True)])
def test_clean_and_audit_match_pandas(data, steps, q, nulls_first):
    ids, removed = pandas_clean(data.toPandas(), q, nulls_first)
    kept = cleaning.clean(data, steps)
    assert {r.id for r in kept.collect()} == ids
    assert kept.columns == data.columns
    audit = cleaning.audit(data, steps).orderBy("step").collect()
    assert [(r.removed, r.total) for r in audit] == removed
    assert [r.rule for r in audit] == [step.name for step in steps]


def test_order_of_steps_matters(data):
    first = (DropNulls(("avg_duration_prev_7days",)), KeepFlag("has_precip_data"), TrimQuantile("duration_min", 0.5))
    last = (TrimQuantile("duration_min", 0.5), KeepFlag("has_precip_data"), DropNulls(("avg_duration_prev_7days",)))
    assert cleaning.audit(data, first).count() == cleaning.audit(data, last).count() == 3
    totals = lambda steps: [r.total for r in cleaning.audit(data, steps).orderBy("step").collect()]
    assert totals(first) != totals(last)


def test_trim_without_values_keeps_nothing_and_still_audits(frame):
    df = frame([(1, None), (2, None)], "id INT, duration_min DOUBLE")
    steps = [TrimQuantile("duration_min", 0.95)]
    assert cleaning.clean(df, steps).count() == 0
    assert [(r.removed, r.total) for r in cleaning.audit(df, steps).collect()] == [(2, 2)]


def test_cleaning_is_one_lazy_plan(spark, data):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    cleaning.clean(data)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_bound_is_the_exact_quantile(data):
    kept = cleaning.clean(data, [TrimQuantile("duration_min", 0.9)])
    values = data.toPandas().duration_min.dropna()
    assert kept.agg(F.max("duration_min")).first()[0] == values[values <= np.quantile(values, 0.9)].max()
