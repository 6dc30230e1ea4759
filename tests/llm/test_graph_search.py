import numpy as np
import pytest

from ridecast.llm import graph_search
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL


def exact(vectors, query, k=10):
    others = sorted((float(np.sqrt(((v - vectors[query]) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return others[:k]


def recall(rows, vectors, k=10):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for query, own in found.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        for r in own:
            assert r["vec_id"] != query
            assert r["score"] == pytest.approx(float(np.sqrt(((vectors[r["vec_id"]] - vectors[query]) ** 2).sum())), rel=1e-12, abs=1e-12)
        true = exact(vectors, query, k)
        hits += sum(r["score"] <= true[-1][0] for r in own)
        total += len(true)
    return hits / total


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None}
    got = QUERIES["op8_nearest_neighbours"](spark, SF_SMALL).collect()
    assert {r["query_id"] for r in got} == {i for i in vectors if i % 100 == 0}
    assert recall(got, vectors) >= 0.9


def test_recall_over_shards(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(20, 16))
    vectors = {i: centres[i % 20] + 0.4 * random.normal(size=16) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    index = graph_search.build_index(df, shard_rows=400)
    assert index.select("shard").distinct().count() == 4
    assert index.count() == 1500
    got = graph_search.search_index(index, df.where("vec_id % 25 = 0"), query_block=20).collect()
    assert len(got) == 600 and recall(got, vectors) >= 0.9


def test_equal_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(40, [1.0, 2.5]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0]), (44, [None, 1.0]), (45, [float("inf"), 1.0]), (46, []), (47, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    index = graph_search.build_index(df, shard_rows=10)
    got = graph_search.search_index(index, df.where("vec_id in (5, 40, 41, 42, 47)")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {5: [(i, 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)], 40: [(i, 0.5) for i in range(10)]}
    assert graph_search.search_index(graph_search.build_index(df.where("false")), df.where("false")).collect() == []
    few = graph_search.search_index(graph_search.build_index(df.where("vec_id in (1, 40)")), df.where("vec_id = 1")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 1, 40, 0.5)]


def test_graph_has_bounded_degree():
    points = np.random.default_rng(0).normal(size=(600, 8))
    graph, start = graph_search.build_graph(points, degree=8, beam=16)
    assert graph.shape == (600, 12) and 0 <= start < 600
    for node, row in enumerate(graph):
        kept = row[row >= 0]
        assert len(set(kept.tolist())) == len(kept) and node not in kept and len(kept)
