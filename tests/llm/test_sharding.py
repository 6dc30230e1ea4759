import zlib
from collections import Counter

import pytest

from ridecast.llm import sharding
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )


def test_sizes_slots_and_mixture(documents):
    sources = ["hot"] * 200 + ["a"] * 60 + ["b"] * 30 + [None] * 10
    rows = [(i, f"text {i} é", "en", s) for i, s in enumerate(sources)]
    placed = sharding.assign_shards(documents(rows), shards=10).collect()
    check(placed, [(r[0], r[1]) for r in rows], 10)
    for source, n in Counter(sources).items():
        per_shard = Counter(r["shard"] for r in placed if r["stratum"] == source)
        assert all(abs(per_shard.get(s, 0) - n / 10) <= 2 for s in range(10)), source


def test_odd_rows(documents, spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "y" * 100_000), (5, "x")]
    check(sharding.assign_shards(documents(rows), shards=4).collect(), [(r[0], r[1]) for r in rows], 4)
    assert sharding.assign_shards(documents([(1, "a")]).where("false")).collect() == []


def test_the_same_after_repartitioning(documents):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(50)]
    one, two = (sorted(map(tuple, sharding.assign_shards(documents(rows, n), 7).collect())) for n in (1, 5))
    assert one == two


def test_query(spark):
    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op4_sharding"](spark, SF_SMALL).collect()
    check(rows, texts, 24)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_written_shards(documents, spark, tmp_path):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(30)]
    sharding.write_shards(documents(rows), str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.groupBy("shard").count().toPandas()["count"]) == [7, 7, 8, 8]
    assert set(back.columns) >= {"doc_id", "text", "extra", "slot", "shard"}


@pytest.mark.parametrize("shards", [1, 3])
def test_fewer_rows_than_shards(documents, shards):
    check(sharding.assign_shards(documents([(1, "a")]), shards).collect(), [(1, "a")], shards)
