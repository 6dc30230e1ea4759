"""Second-order boosted trees: three trees of two levels with SQL twins, and the studied parameter sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridecast.operators import sampling
from ridecast.operators.metrics import regression_scores
from ridecast.plans import boosting, scoring
from ridecast.plans import training as ml
from ridecast.schemas import FEATURES, TARGET
from ridecast.session import kept_path, materialise, new_shared_path, written_once
from ridecast.sources import driver_tables as src
from ridecast.streaming.requests import score_stream
from ridecast_queries.models import _KEY, _SETS, split
from ridecast_queries.preparation import cleaned
from ridecast_queries.registry import query
from ridecast_queries.scoring import written_requests

#: Columns that both engines have to the last bit: a sine may differ there.
EXACT = ["avg_duration_prev_7days", "HPCP", "is_registered", "has_trace"]
SMALL = ml.BoostParams(3, 2, 0.3, gamma=1, min_child_weight=5)
BINS = 12


def _values(table: str) -> str:
    return "[" + ", ".join(f'CAST({table}."{name}" AS DOUBLE)' for name in EXACT) + "]"


def _part(g: str, n: str) -> str:
    real = f"(CAST({g} AS DOUBLE) / CAST(65536 AS DOUBLE))"
    return f"{real} * {real} / (CAST({n} AS DOUBLE) + CAST(1 AS DOUBLE))"


def _trees_sql() -> str:
    """Every level of every tree as common table expressions: b{tree}{level} are splits, v{tree} leaf values, s{tree} rows."""
    steps = [
        f"""d AS MATERIALIZED (SELECT seq_id AS k, {_values("cleaned")} AS x, CAST(floor(duration_min * 65536 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS y FROM cleaned)""",
        f"""p AS MATERIALIZED (SELECT f, x[f] AS v, row_number() OVER (PARTITION BY f ORDER BY x[f]) - 1 AS r, count(*) OVER (PARTITION BY f) AS n
            FROM d CROSS JOIN range(1, {len(EXACT) + 1}) t(f))""",
        f"cuts AS MATERIALIZED (SELECT DISTINCT f, v AS cut FROM p JOIN range(1, {BINS}) b(q) ON r = q * n // {BINS})",
        "base AS MATERIALIZED (SELECT CAST((2 * sum(y) + count(*)) // (2 * count(*)) AS BIGINT) AS m FROM d)",
        "s1 AS MATERIALIZED (SELECT k, x, y, m FROM d CROSS JOIN base)",
    ]
    able = f"ln >= {SMALL.min_child_weight} AND n - ln >= {SMALL.min_child_weight} AND gain > CAST(0.000001 AS DOUBLE) AND gain >= {SMALL.gamma}"
    for tree in range(1, SMALL.n_estimators + 1):
        steps.append(f"w{tree}0 AS MATERIALIZED (SELECT k, x, y, m, m - y AS g, 0 AS node FROM s{tree})")
        for level in range(SMALL.max_depth):
            now, after = f"w{tree}{level}", f"w{tree}{level + 1}"
            steps += [
                f"""h{tree}{level} AS MATERIALIZED (SELECT node, f, cut, sum(CASE WHEN x[f] <= cut THEN g ELSE 0 END) AS lg,
                    count(*) FILTER (WHERE x[f] <= cut) AS ln, sum(g) AS g, count(*) AS n FROM {now} CROSS JOIN cuts GROUP BY node, f, cut)""",
                f"""b{tree}{level} AS MATERIALIZED (SELECT node, f, cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS place
                    FROM (SELECT *, {_part("lg", "ln")} + {_part("(g - lg)", "(n - ln)")} - {_part("g", "n")} AS gain FROM h{tree}{level}) u WHERE {able}) o
                    WHERE place = 1)""",
                f"{after} AS MATERIALIZED (SELECT k, x, y, m, g, {_next(now, f'b{tree}{level}')} AS node FROM {now} LEFT JOIN b{tree}{level} b ON b.node = {now}.node)",
            ]
        last = f"w{tree}{SMALL.max_depth}"
        step = f"-(CAST(sum(g) AS DOUBLE) / CAST(65536 AS DOUBLE)) / (CAST(count(*) AS DOUBLE) + CAST(1 AS DOUBLE)) * CAST({SMALL.learning_rate} AS DOUBLE) * CAST(65536 AS DOUBLE)"
        steps += [
            f"v{tree} AS MATERIALIZED (SELECT node, CAST(floor({step} + CAST(0.5 AS DOUBLE)) AS BIGINT) AS value, count(*) AS n FROM {last} GROUP BY node)",
            f"s{tree + 1} AS MATERIALIZED (SELECT k, x, y, m + value AS m FROM {last} JOIN v{tree} ON v{tree}.node = {last}.node)",
        ]
    return "WITH " + ", ".join(steps)


def _next(rows: str, splits: str) -> str:
    return f"CASE WHEN b.node IS NULL THEN {rows}.node ELSE 2 * {rows}.node + 1 + CAST(x[b.f] > b.cut AS INTEGER) END"


def _durations_sql() -> str:
    """Accepted requests down the same trees."""
    steps = [f"r1 AS MATERIALIZED (SELECT request_id, reasons, {_values('checked')} AS x, (SELECT m FROM base) AS m FROM checked)"]
    for tree in range(1, SMALL.n_estimators + 1):
        steps.append(f"q{tree}0 AS MATERIALIZED (SELECT *, 0 AS node FROM r{tree})")
        for level in range(SMALL.max_depth):
            now = f"q{tree}{level}"
            steps.append(
                f"q{tree}{level + 1} AS MATERIALIZED (SELECT request_id, reasons, x, m, {_next(now, '')} AS node FROM {now} LEFT JOIN b{tree}{level} b ON b.node = {now}.node)"
            )
        last = f"q{tree}{SMALL.max_depth}"
        steps.append(f"r{tree + 1} AS MATERIALIZED (SELECT request_id, reasons, x, m + value AS m FROM {last} LEFT JOIN v{tree} ON v{tree}.node = {last}.node)")
    final = f"SELECT request_id, CASE WHEN reasons = '' THEN m / CAST(65536 AS DOUBLE) END AS duration, reasons FROM r{SMALL.n_estimators + 1}"
    return f"{_trees_sql()}, {', '.join(steps)} {final}"


def exact_table(spark, sf):
    return written_once(spark, "exact-model-table", sf, lambda: cleaned(spark, sf).select("seq_id", *EXACT, TARGET))


def small_model(spark, sf) -> boosting.BoostedModel:
    """Three trees of two levels, fitted once."""

    def build(path):
        boosting.fit(exact_table(spark, sf), SMALL, EXACT, max_bins=BINS).save(spark, path)

    return boosting.BoostedModel.load(spark, kept_path(spark, "three-trees", sf, build))


@query(
    "boosted_three_trees",
    f"{_trees_sql()} SELECT k AS seq_id, m / CAST(65536 AS DOUBLE) AS prediction FROM s{SMALL.n_estimators + 1}",
)
def boosted_three_trees(spark, sf):
    """Predictions of all training rows, equal to the last bit."""
    return small_model(spark, sf).predict(exact_table(spark, sf)).select("seq_id", "prediction")


_SPLITS = " UNION ALL ".join(
    f"SELECT {tree - 1} AS tree, {level} AS level, f, cut FROM b{tree}{level} WHERE node >= {2**level - 1}"
    for tree in range(1, SMALL.n_estimators + 1)
    for level in range(SMALL.max_depth)
)
_NAME = "CASE f " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(EXACT, 1)) + " END"


@query("boosted_splits", f"{_trees_sql()} SELECT tree, {_NAME} AS feature, cut AS threshold FROM ({_SPLITS}) u")
def boosted_splits(spark, sf):
    """Every split of the three trees."""
    return small_model(spark, sf).nodes(spark).where("feature IS NOT NULL").select("tree", "feature", "threshold")


@query(
    "boosted_feature_use",
    f"""{_trees_sql()}, used AS (SELECT {_NAME} AS feature, count(*) AS splits FROM ({_SPLITS}) u GROUP BY 1)
        SELECT n.feature, coalesce(splits, 0) AS splits FROM (VALUES {", ".join(f"('{name}')" for name in EXACT)}) n(feature)
        LEFT JOIN used ON used.feature = n.feature""",
)
def boosted_feature_use(spark, sf):
    return small_model(spark, sf).feature_use(spark)


def _durations(scored):
    return scored.select("request_id", "duration", F.array_join("reasons", "; ").alias("reasons"))


@query("request_durations", _durations_sql())
def request_durations(spark, sf):
    """The scored duration of every accepted request."""
    return _durations(scoring.score(src.requests(spark, sf), small_model(spark, sf)))


@query("stream_request_durations", _durations_sql())
def stream_request_durations(spark, sf):
    """The same from requests that arrive as files."""
    sink = new_shared_path(spark, "scored-durations")
    model, source = small_model(spark, sf), written_requests(spark, sf)
    score_stream(spark, model, source, sink, new_shared_path(spark, "scored-durations-state")).awaitTermination()
    return _durations(spark.read.parquet(sink))


def fitted(spark, sf, name) -> boosting.BoostedModel:
    """A studied parameter set fitted once on the training part."""

    def build(path):
        boosting.fit(split(spark, sf)[0], _SETS[name], FEATURES).save(spark, path)

    return boosting.BoostedModel.load(spark, kept_path(spark, f"boosted-{name}", sf, build))


def _scores_of(spark, sf, name):
    parts = sampling.with_split(written_once(spark, "model-table", sf, lambda: cleaned(spark, sf).select("seq_id", *FEATURES, TARGET)), _KEY, 0.2, ml.SEED)
    scored = materialise(fitted(spark, sf, name).predict(parts).select("split", TARGET, "prediction"), "boosted-scores")
    scores = regression_scores(scored, TARGET, "prediction", ["split"])
    return scores.select(F.lit(name).alias("model"), *scores.columns)


@query("boosted_squared")
def boosted_squared(spark, sf):
    """50 trees of depth 5 under the squared loss, on the test and the training part."""
    return _scores_of(spark, sf, "squared")


@query("boosted_absolute")
def boosted_absolute(spark, sf):
    return _scores_of(spark, sf, "absolute")


@query("boosted_tuned")
def boosted_tuned(spark, sf):
    return _scores_of(spark, sf, "tuned")


@query("boosted_plain")
def boosted_plain(spark, sf):
    return _scores_of(spark, sf, "plain")
