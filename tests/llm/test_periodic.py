import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridecast.llm import periodic
from ridecast.llm.queries import QUERIES

from .conftest import SF_SMALL


def brute_runs(words, times=4, least=6):
    """By definition: maximal stretches of each period whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def kept(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(rows):
    out = []
    for i, text in rows:
        words = planted(i, split(text))
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(words, runs))]
        out.append((i, len(runs), *best, milli, *digests))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_runs_of_two_letters(words):
    assert periodic.runs_of(words) == brute_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=5), st.integers(1, 8)), max_size=6), st.sampled_from([(4, 6), (3, 2), (5, 12)]))
def test_runs_of_repeated_blocks(blocks, bounds):
    words = [w for block, n in blocks for w in block * n]
    assert periodic.runs_of(words, *bounds) == brute_runs(words, *bounds)
    data = " ".join(map(str, words)).encode()
    _, found = periodic.runs_of_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), *bounds)
    assert sorted(found.get(0, [])) == brute_runs(words, *bounds)


def test_automaton_links_are_those_of_suffixes():
    words = [int(x) for x in "0110100110010110"]
    length, link, states = periodic.suffix_automaton(words)
    for n, state in enumerate(states, 1):
        chain = []
        while state >= 0:
            chain.append(length[state])
            state = link[state]
        assert chain[0] == n and chain[-1] == 0 and chain == sorted(chain, reverse=True)
    assert len(length) <= 2 * len(words)


def test_accessed_segments_against_plain_paths():
    choose = random.Random(4)
    parents = [-1] + [choose.randrange(i) for i in range(1, 200)]
    tree, colours = periodic.LastEnds(parents), [-1] * 200
    for colour in range(2000):
        node = choose.randrange(200)
        path, x = [], node
        while x >= 0:
            path.append(x)
            x = parents[x]
        expected = [(v, colours[v]) for k, v in enumerate(path) if k == 0 or colours[v] != colours[path[k - 1]]]
        got = list(tree.access(node, colour))
        # A path of one colour may come in more than one segment only while nothing was there.
        assert [x for x in got if x[1] >= 0] == [x for x in expected if x[1] >= 0]
        for v in path:
            colours[v] = colour


def test_windows():
    assert periodic.window_words(4, 6) == 5 and periodic.window_words(3, 2) == 2


def test_plain_text_leaves_nothing_to_search(monkeypatch):
    monkeypatch.setattr(periodic, "runs_of", None)  # not called
    data = " ".join(f"w{(i * i) % 997}" for i in range(400)).encode()
    assert periodic.runs_of_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1] == {}


def digest_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark, documents):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (4, "b b b b b"), (4, "b b b b b b"), (5, "x y x y x y x y z Z z Z z Z z Z"),
        (6, "ä ö " * 5 + "ä"), (7, "rep " * 60_000), (8, "p q r s t " * 20_000 + "end"), (9, "y" * 300_000),
    ]
    clash = documents(rows).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    for df in (documents(rows), clash):
        out = {}
        for r in periodic.find_runs(df).collect():
            out.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"]))
        assert out[1] == out[2] == out[3] == [([], 0, "")]
        assert out[None] == [([(0, 7, 1)], 7, "a")]
        assert sorted(out[4]) == [([], 5, "b b b b b"), ([(0, 6, 1)], 6, "b")]
        assert out[5] == [([(0, 8, 2), (8, 8, 2)], 16, "x y z Z")]
        assert out[6] == [([(0, 11, 2)], 11, "ä ö")]
        assert out[7] == [([(0, 60_000, 1)], 60_000, "rep")]
        assert out[8] == [([(0, 100_000, 5)], 100_001, "p q r s t end")]
        assert out[9] == [([], 1, "y" * 300_000)]
    assert periodic.find_runs(documents([])).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(documents([]), times=2)


def test_collapsed_text_and_greatest():
    runs = [(2, 6, 1), (8, 8, 2)]
    assert periodic.collapse([b"a", b"b"] + [b"c"] * 6 + [b"x", b"y"] * 4, runs) == b"a b c x y"
    assert periodic.greatest([(0, 9, 2), (9, 18, 4), (30, 9, 2)]) == (0, 9, 2)


def test_planted_texts(spark, documents):
    rows = [(i, " ".join(f"w{(i + k * k) % 31}" for k in range(i % 23))) for i in range(400)] + [(None, "a b"), (10**9, None)]
    out = periodic.with_planted_runs(documents(rows).withColumn("_words", F.lit(1))).collect()
    texts = {r["doc_id"]: split(r["text"]) for r in out}
    assert len(out) == len(rows) and texts == {i: planted(i, split(t)) for i, t in rows}
    assert sum(planted(i, split(t)) != split(t) for i, t in rows) > 10


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert max(len(split(t)) for _, t in rows) > 500
    df = QUERIES["op13_periodic_runs"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert digest_rows(df) == brute(rows)
