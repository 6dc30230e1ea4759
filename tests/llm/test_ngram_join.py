import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridecast.llm import components as component_module
from ridecast.llm import ngram_join
from ridecast.llm.components import components
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL


def shingles(text, k):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    union = Union()
    for i, s in sets.items():
        common = Counter(j for g in s for j in holders[g] if j > i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    return sorted((i, len(s), union.find(i)) for i, s in sets.items())


def got(df):
    return sorted(map(tuple, df.collect()))


def near_copies(seed, groups, copies, words, changes):
    random = np.random.default_rng(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{x}" for x in random.integers(0, 5000, words)]
        for _ in range(copies):
            text = list(base)
            for place in random.integers(0, words, random.integers(0, changes + 1)):
                text[place] = f"z{random.integers(0, 9999)}"
            rows.append((at, " ".join(text)))
            at += 1
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 95, 100)])
def test_equals_brute_force(documents, k, num, den):
    rows = near_copies(k, 25, 6, 80, 4) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(9, 3, 5, 700, 20))]
    assert got(ngram_join.join_documents(documents(rows), k, num, den)) == brute(rows, k, num, den)


def test_query_equals_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op1_ngram_join"](spark, SF_SMALL)) == brute(texts, 4, 85, 100)


@pytest.mark.parametrize("runs", [500, 4_000_000])
def test_large_groups_in_blocks(documents, monkeypatch, runs):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_RUNS", runs)
    rows = near_copies(3, 2, 70, 60, 3)
    rows += [(500 + i, rows[0][1]) for i in range(40)]
    # Sizes over many bands, each set near the next.
    words = [f"v{i}" for i in range(200)]
    rows += [(1000 + n, " ".join(words[:n])) for n in range(20, 200, 5)]
    assert got(ngram_join.join_documents(documents(rows), 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (9, "w " * 30000)]
    assert got(ngram_join.join_documents(documents(rows))) == brute(rows, 4, 85, 100)
    repeated = ngram_join.join_documents(documents([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in repeated) == [(0, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert ngram_join.join_documents(documents(rows).where("false")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(50, 99), st.integers(1, 400))
def test_bands_hold_all_links(num, a):
    bands = ngram_join.Bands(num, 100)
    bands.up_to(2 * a + 2)
    band = np.searchsorted(bands.lower, [a, a * 100 // num], "right") - 1
    assert band[1] - band[0] <= 1
    b = a * 100 // num
    differ = (a + b) * (100 - num) // (100 + num)
    assert bands.groups[band[0]] == 0 and differ == 0 or bands.groups[band[0]] >= differ + 1 + bands.empties[band[0]]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40))
def test_tree_finds_all_links(seed, n):
    random = np.random.default_rng(seed)
    base = np.unique(random.integers(1, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[random.random(len(base)) < 0.95], random.integers(1, 2**63, 3).astype(np.uint64)])) for _ in range(n)]
    expected, found = Union(), Union()
    for i in range(n):
        for j in range(i):
            if ngram_join.linked(sets[i], sets[j], 85, 100):
                expected.join(i, j)
    for a, b in ngram_join.spanning_links(sets, np.zeros(n, int), 85, 100):
        assert ngram_join.linked(sets[a], sets[b], 85, 100)
        found.join(a, b)
    assert [expected.find(i) for i in range(n)] == [found.find(i) for i in range(n)]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(20, 60)] + [(5, 5), (3, 2), (3, 2)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[i] for i in range(100, 161)} == {100} and {found[x] for x in range(20, 60)} == {7}
    assert found[3] == found[2] == 2 and 5 not in found


def test_common_passages_part_by_rare_runs(spark, documents, monkeypatch):
    random = np.random.default_rng(8)
    shared = [f"common{k}" for k in range(9)]
    rows = [(i, " ".join([f"w{x}" for x in random.integers(0, 10**6, 5)] + shared + [f"w{x}" for x in random.integers(0, 10**6, 4)])) for i in range(400)]
    rows += [(1000 + i, " ".join(t.split()[:-1] + ["end"])) for i, t in rows[:60]] + [(2000 + i, t) for i, t in rows[:40]]
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    grouped = []
    plain = ngram_join._regrouped

    def seen(*args):
        before, after = args[1], plain(*args)
        sizes = [df.groupBy("component").count().agg({"count": "max"}).first()[0] or 0 for df in (before, after)]
        grouped.append(sizes)
        return after

    monkeypatch.setattr(ngram_join, "_regrouped", seen)
    assert got(ngram_join.join_documents(documents(rows), 4, 80, 100)) == brute(rows, 4, 80, 100)
    assert grouped[0][0] > 200 and grouped[0][1] < 30


def test_filter_reaches_the_driver_as_arrays(spark, monkeypatch):
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("node"))

    def no_rows(self):
        raise AssertionError("an object a row in the driver")

    monkeypatch.setattr(type(ids), "collect", no_rows)
    kept = ngram_join.IdFilter(ids)
    monkeypatch.undo()
    bits = [r["bit"] for r in ids.select(F.pmod(F.xxhash64("node"), F.lit(ngram_join.FILTER_BITS)).alias("bit")).collect()]
    held = kept.held.value
    assert all(held[b >> 5] >> (b & 31) & 1 for b in bits)
    assert int(sum(bin(int(w)).count("1") for w in held[held > 0])) == len(set(bits))
    kept.done()


def test_rounds_of_components_are_counted_while_they_are_written(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 130)] + [(7, x) for x in range(20, 40)], "a long, b long")
    names, plain = [], component_module.written

    def first(self):
        raise AssertionError("a job to count a round")

    def written(df, name):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(type(links), "first", first)
    monkeypatch.setattr(component_module, "written", written)
    stars = component_module.components(links)
    monkeypatch.undo()
    assert {tuple(r) for r in stars.collect()} == {(i, 100) for i in range(100, 131)} | {(7, 7)} | {(x, 7) for x in range(20, 40)}
    # What is stars already takes no round but two tables.
    names.clear()
    monkeypatch.setattr(component_module, "written", written)
    again = component_module.components(stars.select(F.col("component").alias("a"), F.col("node").alias("b")))
    assert names == ["components-links", "components-least", "components-smallest"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stars.collect()))
    assert component_module.components(links.where("a < 0")).collect() == []


@pytest.mark.parametrize("few", [0, 100])
def test_components_with_and_without_hot_keys(spark, monkeypatch, few):
    monkeypatch.setattr(component_module, "FEW_KEYS", few)
    monkeypatch.setattr(component_module, "HOT", 8)
    random = np.random.default_rng(6)
    links = [tuple(map(int, x)) for x in random.integers(0, 300, (160, 2))] + [(3, x) for x in range(300, 340)]
    union = Union()
    for a, b in links:
        if a != b:
            union.join(a, b)
    found = dict(map(tuple, component_module.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {x: union.find(x) for ab in links if ab[0] != ab[1] for x in ab}


def test_counts_reach_the_driver_small(spark, documents, monkeypatch):
    random = np.random.default_rng(8)
    shared = [f"common{k}" for k in range(9)]
    rows = [(i, " ".join([f"w{x}" for x in random.integers(0, 10**6, 5)] + shared + [f"w{x}" for x in random.integers(0, 10**6, 4)])) for i in range(120)]
    rows += [(1000 + i, " ".join(t.split()[:-1] + ["end"])) for i, t in rows[:30]]
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    monkeypatch.setattr(ngram_join, "MOST_COUNTED", 3)
    tables, plain = [], type(spark.range(1)).toArrow

    def arrow(self):
        tables.append(plain(self))
        return tables[-1]

    monkeypatch.setattr(type(spark.range(1)), "toArrow", arrow)
    assert got(ngram_join.join_documents(documents(rows), 4, 80, 100)) == brute(rows, 4, 80, 100)
    (counts,) = [t for t in tables if t.column_names == ["place", "n"]]
    assert {str(t) for t in counts.schema.types} == {"int32"} and set(counts["n"].to_pylist()) <= {2, 3}


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 30])
def test_no_task_runs_two_workers_in_a_row(spark, documents, monkeypatch, block):
    random = np.random.default_rng(8)
    shared = [f"common{k}" for k in range(9)]
    rows = [(i, " ".join([f"w{x}" for x in random.integers(0, 10**6, 5)] + shared + [f"w{x}" for x in random.integers(0, 10**6, 4)])) for i in range(120)]
    rows += [(1000 + i, " ".join(t.split()[:-1] + ["end"])) for i, t in rows[:30]]
    # A filter of a few bits lets most other texts through: the join behind it has to leave them out.
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    plans, plain = {}, ngram_join.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(ngram_join, "written", seen)
    assert got(ngram_join.join_documents(documents(rows), 4, 80, 100)) == brute(rows, 4, 80, 100)
    assert plans["links"].count("MapInArrow") == 1
    assert ("large-sets" in plans) == (block == 30)
    assert plans.get("large-sets", "MapInArrow").count("MapInArrow") == 1


def test_runs_are_counted_and_handed_on_in_parts(spark, documents, monkeypatch):
    random = np.random.default_rng(8)
    shared = [f"common{k}" for k in range(9)]
    rows = [(i, " ".join([f"w{x}" for x in random.integers(0, 10**6, 5)] + shared)) for i in range(60)]
    monkeypatch.setattr(ngram_join, "BLOCK", 30)
    monkeypatch.setattr(ngram_join, "PLACES_PER_BATCH", 1 << 18)
    sets, tables, plain_written, plain_arrow = [], [], ngram_join.written, type(spark.range(1)).toArrow

    def seen(df, name):
        sets.extend([plain_written(df, name)] if name == "large-sets" else [])
        return sets[-1] if name == "large-sets" else plain_written(df, name)

    def arrow(self):
        tables.append(plain_arrow(self))
        return tables[-1]

    monkeypatch.setattr(ngram_join, "written", seen)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", arrow)
    assert got(ngram_join.join_documents(documents(rows), 4, 40, 100)) == brute(rows, 4, 40, 100)
    (counts,) = [t for t in tables if t.column_names == ["place", "n"]]
    expected = Counter(int(x) for r in sets[0].collect() for x in ngram_join._place(np.frombuffer(r["runs"], "<u8")))
    assert dict(zip(counts["place"].to_pylist(), counts["n"].to_pylist(), strict=True)) == {k: n for k, n in expected.items() if n > 1}


def long_sets(seed, n, runs):
    random = np.random.default_rng(seed)
    return [np.unique(random.integers(1, 2**63, runs).astype(np.uint64) * np.uint64(2)) for _ in range(n)]


def keys_by_set(sets, bands):
    runs, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return [set(k.tolist()) for k in ngram_join.keys_of(runs, of, len(sets), bands)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([78, 80, 85, 90, 97]), st.integers(1, 500))
def test_narrow_bands_lose_no_link(seed, num, size):
    random = np.random.default_rng(seed)
    sets = long_sets(seed, 1, size)
    # As different as linked sets may be: runs go, runs come, and both.
    for gone in (0.0, 0.5, 1.0):
        base, most = sets[0], 0
        for differ in range(size + 1):
            out = int(differ * gone)
            if (size - out) * 100 < num * (size + differ - out):
                break
            most = differ
        out = int(most * gone)
        sets.append(np.unique(np.concatenate([random.permutation(base)[out:], *long_sets(seed + 7, 1, most - out)])) if most else base)
    bands = ngram_join.NarrowBands(num, 100)
    keys = keys_by_set(sets, bands)
    for a, one in enumerate(sets):
        for b, other in enumerate(sets):
            if not np.array_equal(one, other) and ngram_join.linked(one, other, num, 100):  # equal sets are one class before
                assert keys[a] & keys[b]


@pytest.mark.parametrize("num", [80, 85])
def test_runs_that_long_texts_share_by_chance_make_no_key(num):
    random = np.random.default_rng(3)
    sets = long_sets(5, 40, 3000)
    some = long_sets(6, 1, 3000)[0]
    sets = [np.unique(np.concatenate([s, random.choice(some, 300, False)])) for s in sets]

    def sharing(bands):
        keys = keys_by_set(sets, bands)
        return sum(bool(keys[a] & keys[b]) for a in range(len(sets)) for b in range(a))

    assert sharing(ngram_join.NarrowBands(num, 100)) * 4 < sharing(ngram_join.Bands(num, 100))


def test_heavy_candidate_groups_part(spark, documents, monkeypatch):
    random = np.random.default_rng(11)
    common = [[f"c{g}x{k}" for k in range(5)] for g in range(200)]
    rows = []
    for i in range(100):  # long texts that share some runs, each in another place
        words = [f"w{x}" for x in random.integers(0, 10**7, 1500)]
        for at, g in zip(random.choice(290, 45, False) * 5, random.choice(200, 45, False), strict=True):
            words[at : at + 5] = common[g]
        rows.append((i, " ".join(words)))
    for i in range(15):
        words = rows[i][1].split()
        for at in random.integers(0, 1500, 15):
            words[at] = "changed"
        rows.append((500 + i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "BLOCK_RUNS", 20_000)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    grouped, plain = [], ngram_join._parted

    def seen(*args):
        after = plain(*args)
        grouped.extend(df.groupBy("component").count().agg({"count": "max"}).first()[0] or 0 for df in (args[2], after))
        return after

    monkeypatch.setattr(ngram_join, "_parted", seen)
    assert got(ngram_join.join_documents(documents(rows), 5, 80, 100)) == brute(rows, 5, 80, 100)
    assert grouped[0] > 50 and grouped[1] < 6


def test_shuffle_files_go_with_their_query(spark):
    from ridecast.llm.scratch import CLEANUP_SETTING, ship

    held = spark.conf.get(CLEANUP_SETTING, None)
    try:
        spark.conf.unset(CLEANUP_SETTING)
        ship(spark)
        assert spark.conf.get(CLEANUP_SETTING) == "true"
        spark.conf.set(CLEANUP_SETTING, "false")  # a session's own choice stays
        ship(spark)
        assert spark.conf.get(CLEANUP_SETTING) == "false"
    finally:
        spark.conf.unset(CLEANUP_SETTING)
        if held is not None:
            spark.conf.set(CLEANUP_SETTING, held)


def test_texts_are_shuffled_for_the_last_comparison(documents, monkeypatch):
    rows = near_copies(4, 6, 5, 60, 1) + [(900, None), (901, ""), (902, "a"), (903, "a b")]
    columns, plain = [], ngram_join._verified

    def seen(rows, *args):
        columns.append(dict(rows.dtypes))
        return plain(rows, *args)

    monkeypatch.setattr(ngram_join, "_verified", seen)
    assert got(ngram_join.join_documents(documents(rows), 4, 80, 100)) == brute(rows, 4, 80, 100)
    # 64-bit hashes of runs take twice the room of the texts, and do not compress.
    assert columns[0]["text"] == "string" and not {"binary", "array<bigint>"} & set(columns[0].values())
