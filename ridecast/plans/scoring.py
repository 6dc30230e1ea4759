"""Requests: validate, build the features, score. The same code serves batch and stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.functions import flags
from ridecast.plans.prepare import with_weekday_cycle
from ridecast.schemas import FEATURES
from ridecast.sources.files import RAW

_TYPED = "_typed"


def _problem(field: str, typed: Column, allowed: Column, rule: str) -> Column:
    missing = F.when(F.col(field).isNull(), F.lit(f"{field}: missing"))
    wrong = F.when(typed.isNull(), F.lit(f"{field}: not valid"))
    return F.coalesce(missing, wrong, F.when(~allowed, F.lit(f"{field}: {rule}")))


def validate(raw: DataFrame) -> DataFrame:
    """Typed request fields, `is_valid` and the `reasons` of a rejection.

    A value that does not fit is null, so a rejected row can never be scored by chance.
    A record that was no JSON has that one reason (its text is in `raw`).
    """
    typed = {
        "avg_duration_prev_7days": flags.to_number(F.col("avg_duration_prev_7days")),
        "HPCP": flags.to_number(F.col("HPCP")),
        "dow": flags.to_whole_number(F.col("dow")),
        "is_registered": flags.to_boolean(F.col("is_registered")),
        "has_trace": flags.to_boolean(F.col("has_trace")),
    }
    average, rain, dow = (F.col(f"{_TYPED}.{name}") for name in ("avg_duration_prev_7days", "HPCP", "dow"))
    problems = F.array(
        _problem("avg_duration_prev_7days", average, average >= 0.0, "below 0"),
        _problem("HPCP", rain, rain >= 0.0, "below 0"),
        _problem("dow", dow, dow.between(0, 6), "not in 0..6"),
        _problem("is_registered", F.col(f"{_TYPED}.is_registered"), F.lit(True), ""),
        _problem("has_trace", F.col(f"{_TYPED}.has_trace"), F.lit(True), ""),
    )
    others = [name for name in raw.columns if name not in typed]
    return (
        raw.withColumn(_TYPED, F.struct(*[column.alias(name) for name, column in typed.items()]))
        .withColumn("reasons", F.array_compact(problems) if RAW not in raw.columns else F.when(F.col(RAW).isNotNull(), F.array(F.lit("body: not valid JSON"))).otherwise(F.array_compact(problems)))
        .select(*others, f"{_TYPED}.*", (F.size("reasons") == 0).alias("is_valid"), "reasons")
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("is_valid").drop("is_valid", "reasons", RAW)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("NOT is_valid")


def request_features(typed: DataFrame) -> DataFrame:
    """Typed request fields -> model inputs, with the weekday cycle of the preparation."""
    return (
        with_weekday_cycle(typed)
        .withColumns(
            {name: flags.bool_to_int(F.col(name)) for name in ("is_registered", "has_trace")}
        )
        .drop("dow")
    )


def score(raw: DataFrame, model: PipelineModel, out: str = "duration") -> DataFrame:
    """One row per request: the duration in minutes, or null with the reasons.

    A tree sends a missing value down its right branch, so rejected rows are scored on
    neutral inputs and their result is taken away.
    """
    features = request_features(validate(raw))
    carried = [name for name in features.columns if name not in FEATURES]
    features = features.withColumns(
        {name: F.when(F.col("is_valid"), F.col(name)).otherwise(F.lit(0)) for name in FEATURES}
    )
    return model.transform(features).select(
        *[name for name in carried if name not in ("is_valid", "reasons")],
        F.when(F.col("is_valid"), F.col("prediction")).alias(out),
        "is_valid",
        "reasons",
    )
