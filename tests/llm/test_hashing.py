import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridecast.llm import decontamination, hashing
from ridecast.llm.scratch import text_chunks

TEXT = st.text(alphabet="ab Z\t\n\x0bé-", max_size=40)


def laid(texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def plain_words(text):
    import re

    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = laid(texts)
    hashes, text, first, last = hashing.words(data, offsets)
    found = [[] for _ in texts]
    for t, a, b in zip(text, first, last, strict=True):
        found[t].append(bytes(hashing.LOWER[data[a:b]]))
    assert found == [plain_words(t) for t in texts]
    by_word = {}
    for h, a, b in zip(hashes, first, last, strict=True):
        assert by_word.setdefault(bytes(hashing.LOWER[data[a:b]]), h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("size", [1, 3, 4])
def test_runs_of_words(size):
    texts = ["", "a", "a b", "a b c d e", "x a b c d", "   ", "b a"]
    data, offsets = laid(texts)
    words, text, _, _ = hashing.words(data, offsets)
    runs, of, _ = hashing.runs(words, text, len(texts), size)
    known = {}
    for number, t in enumerate(texts):
        w = plain_words(t)
        expected = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        got = runs[of == number]
        assert len(got) == len(expected)
        for key, value in zip(expected, got, strict=True):
            assert known.setdefault(key, value) == value
    assert len(set(known.values())) == len(known)


def test_chunks_see_whole_texts():
    column = pa.array(["aa", None, "", "b" * 50, "c"]).slice(0)
    seen = []
    for first, end, data, offsets in text_chunks(column, most_bytes=4):
        seen += [bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in range(end - first)]
    assert seen == ["aa", "", "", "b" * 50, "c"]
    assert [bytes(d) for _, _, d, _ in text_chunks(column.slice(3, 1))] == [b"b" * 50]
    assert list(text_chunks(pa.array([], pa.string()))) == []


def test_words_are_hashed_in_few_bytes_at_once(monkeypatch):
    most, plain = [], hashing.words

    def seen(data, *args, **kwargs):
        most.append(len(data))
        return plain(data, *args, **kwargs)

    monkeypatch.setattr(hashing, "words", seen)
    texts = pa.array([f"some {i} words of a text " * 40 for i in range(2000)])
    assert list(decontamination._held(decontamination.Items([(1, "an item of some other words than those")]), texts)) == []
    assert sum(most) > 1 << 20 and max(most) <= 256 << 10
