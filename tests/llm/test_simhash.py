import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridecast.llm import components as component_module
from ridecast.llm import simhash
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL
from .test_ngram_join import Union


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    union = Union()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[union.find(p)] = min(i, least.get(union.find(p), i))
    return sorted(((i, f"{p:016x}", least.get(union.find(p))) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def got(df):
    rows = df.select("doc_id", simhash.hex_digits(df["fingerprint"]).alias("f"), "component_id").collect()
    return sorted(map(tuple, rows), key=str)


def test_hashes_are_those_of_the_library():
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    first = np.arange(3000)
    end = first + np.arange(3000) % 70
    expected = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(first, end, strict=True)]
    assert simhash.xxh64(data, first, end).tolist() == expected


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("aB é\t\n Z9", max_size=60), max_size=6))
def test_fingerprints_of_any_texts(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    got, _ = simhash.fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.tolist() == [fingerprint(t) for t in texts]


def codes_near(random, centres, each, bits):
    out = {int(x) for x in random.integers(0, 2**64, 50, np.uint64)}
    for centre in random.integers(0, 2**64, centres, np.uint64):
        for _ in range(each):
            code = int(centre)
            for bit in random.integers(0, 64, random.integers(0, bits + 1)):
                code ^= 1 << int(bit)
            out.add(code)
    return sorted(out)


def joined(pairs, codes):
    union = Union()
    for a, b in pairs:
        union.join(a, b)
    return [union.find(c) for c in codes]


def links_of(codes, distance):
    return [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= distance]


def test_forest_finds_every_pair_of_its_groups():
    random = np.random.default_rng(3)
    groups = [codes_near(random, 2, 30, 3), codes_near(random, 1, 1, 0)[:1], codes_near(random, 1, 90, 2)]
    ranked = []
    for codes in groups:
        ranks = dict(zip(codes, simhash.gray_rank(np.array(codes, np.uint64)).tolist(), strict=True))
        assert all(r ^ (r >> 1) == c for c, r in ranks.items())  # the code of that rank
        ranked.append(sorted(codes, key=ranks.get))
    flat = np.array([c for g in ranked for c in g], np.uint64)
    forest = simhash.GrayForest(flat, np.array([len(g) for g in ranked]))
    a, b = forest.search(np.arange(len(flat)), 2)
    expected = {tuple(sorted(p)) for g in ranked for p in links_of(g, 2)}
    assert len(a) == len(expected) and {tuple(sorted((int(flat[i]), int(flat[j])))) for i, j in zip(a, b, strict=True)} == expected
    assert len(expected) > 100


@pytest.mark.parametrize(("distance", "group"), [(2, 16), (2, 4096), (1, 4), (3, 64)])
def test_divided_groups_lose_no_link(spark, distance, group):
    codes = codes_near(np.random.default_rng(distance), 4, 60, distance + 1)
    table = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "code long").repartition(3)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked_codes(table, distance, group).collect()]
    assert all((a ^ b).bit_count() for a, b in found)
    assert joined(found, codes) == joined(links_of(codes, distance), codes)


def test_group_must_have_room(spark):
    with pytest.raises(ValueError):
        simhash.linked_codes(spark.createDataFrame([(1,)], "code long"), 2, 3)


def test_batches_that_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 7)
    codes = codes_near(np.random.default_rng(9), 1, 60, 2)
    table = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "code long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked_codes(table, 2).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert joined(found, codes) == joined(links_of(codes, 2), codes)


def texts_with_copies(seed, n):
    random = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"W{x}" for x in random.integers(0, 500, 400)]
        for copy in range(3):
            changed = list(words)
            if copy:
                changed[int(random.integers(0, 400))] = "zz"
            rows.append((10 * k + 3 * copy, " ".join(changed)))
    return rows


def test_texts_against_brute_force(spark, documents):
    rows = texts_with_copies(5, 40)
    rows += [(7000 + k, "the same text again and again") for k in range(300)]  # a hot fingerprint
    assert got(simhash.near_copies(documents(rows, 5))) == brute(rows)
    assert 41 < len({c for _, _, c in brute(rows)}) < 41 + 80


def test_odd_rows(spark, documents):
    rows = [
        (5, None), (6, ""), (3, " \t\n"), (None, ""), (8, "one"), (9, "ONE"), (9, "two words"), (None, "two words"),
        (12, "Ünï cödé – text"), (1, "x " * 50_000), (2, "X  " * 50_000), (None, "alone in the world of words"), (20, "y" * 200_000),
    ]
    assert got(simhash.near_copies(documents(rows))) == brute(rows)


def test_empty_table_and_clashing_columns(spark, documents):
    clash = {c: F.lit("x") for c in ("code", "least", "rows", "fingerprint", "component_id", "_code")}
    assert got(simhash.near_copies(documents([(1, "a b c d")]).withColumns(clash))) == brute([(1, "a b c d")])
    assert got(simhash.near_copies(documents([]))) == []


def test_hot_keys_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(component_module, "HOT", 4)
    rows = spark.createDataFrame([(k, 1 if k < 50 else k) for k in range(60)], "n long, k long")
    keyed = spark.createDataFrame([(1, 50, "hot")] + [(k, 1, "cold") for k in range(50, 60)], "o long, c long, v string")
    out = component_module.join_counted(rows, keyed, "k", "o", "c")
    assert sorted((r["n"], r["v"]) for r in out.collect()) == [(k, "hot" if k < 50 else "cold") for k in range(60)]


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    df = QUERIES["op11_simhash"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, df.collect()), key=str) == brute(rows)
