import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridecast.llm import resampling
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, run=1):
    words = words_of(text)
    return [" ".join(words[i : i + size]) for size in range(1, run + 1) for i in range(len(words) - size + 1)]


def brute(rows, target, least=20, percent=10, seed=2024, run=1, buckets=10_000):
    def hashed(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, run)]

    mine = [hashed(t) for _, t in rows]
    s, t = Counter(b for x in mine for b in x), Counter(b for x in target for b in hashed(x))
    total, wanted = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))

    out, able = [], []
    for (i, text), held in zip(rows, mine, strict=True):
        weight = sum(map(gain, held)) // len(held) if held else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(held), weight, score, None])
        if len(words_of(text)) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.text("aZ09 ,é日\x00\n _", max_size=80), st.integers(1, 3), st.integers(1, 30))
def test_features_whatever_the_pieces(text, run, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert "".join(resampling.pieces(lower, size)) == lower
    before, resampling.PIECE = resampling.PIECE, size
    try:
        wide = resampling.Features(run, 100_000)
        n, found = wide.of(lower)
    finally:
        resampling.PIECE = before
    assert n == len(words_of(text))
    assert Counter(found.tolist()) == Counter(zlib.crc32(f.encode()) % 100_000 for f in features(text, run))


def test_words_with_offsets():
    split = resampling.Features().split
    assert split.pre_tokenize_str("ab é_c9 x-日本") == [("ab", (0, 2)), ("é", (3, 4)), ("c9", (5, 7)), ("x", (8, 9)), ("日本", (10, 12))]


def test_kept_features_are_bounded(monkeypatch):
    monkeypatch.setattr(resampling, "KEPT_FEATURES", 3)
    features = resampling.Features()
    _, found = features.of("a b c d e f a b")
    assert found.tolist() == [zlib.crc32(x.encode()) % 10_000 for x in "abcdefab"] and len(features.known) <= 3


def sample(n):
    return [(i, " ".join(f"Word{(i * 7 + k * k) % (50 + i % 9)}" for k in range(5 + i % 40))) for i in range(n)]


@pytest.mark.parametrize("run", [1, 2])
def test_rows_against_brute_force(spark, documents, run):
    rows, target = sample(300), ["word1 word2 word3", "word5 word5", None, ""]
    draw = resampling.Draw(20, 10, 2024)
    out = resampling.resample(documents(rows, 7), spark.createDataFrame([(t,) for t in target], "text string"), draw, run, 500)
    assert got(out) == brute(rows, target, run=run, buckets=500)


def test_odd_rows(spark, documents):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, None), (2, ""), (3, " ,;- \x7f"), (None, text), (4, text), (4, text), (5, "long " * 100_000), (6, "x" * 300_000), (None, text)]
    rows += [(k, text) for k in range(10, 40)]
    target = spark.createDataFrame([("five long words",)], "text string")
    expected = brute(rows, ["five long words"])
    clash = documents(rows).withColumn("buckets", F.lit("x")).withColumn("rank", F.lit("x"))
    for df in (documents(rows), clash):
        out = resampling.resample(df, target)
        assert [r[:4] for r in got(out)] == [r[:4] for r in expected]
        # Ties of rows without an id, or of one id, have no order of their own.
        assert sorted(r[4] for r in got(out) if r[4]) == sorted(r[4] for r in expected if r[4])
    assert got(resampling.resample(documents([]), target)) == []
    assert got(resampling.resample(documents(rows[:3]), target.limit(0))) == brute(rows[:3], [])


def test_places_of_a_global_order(spark):
    df = spark.range(5000, numPartitions=7).selectExpr("id", "id % 10 AS score")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = resampling.ranked(df, [df["score"].desc(), df["id"]])
        rows = sorted(placed.collect(), key=lambda r: r["place"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["place"] for r in rows] == list(range(1, 5001))
    assert [r["id"] for r in rows] == sorted(range(5000), key=lambda i: (-(i % 10), i))


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    df = QUERIES["op12_resampling"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(df) == brute(rows, target)
    assert all(f.dataType.simpleString() == "bigint" for f in df.schema.fields)
