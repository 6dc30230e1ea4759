import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridecast.llm import packing, token_files
from ridecast.llm.queries import QUERIES
from ridecast.llm.token_ids import IdEncoder

from .conftest import SF_SMALL

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a  b \n\n c ", "İstanbul ſ ŉ Élan", "it's IT'S we'll 's ''s", "x y\u0085z\x1c q", "日本語 123 ²³½", "é café",
    "<|endoftext|> <|startoftext|>", "tab\t\tq\r\n r", "Ὀδυσσεύς ΣΑΣ", "­soft", "\x00\x01", "a_b-c ... $$$", "x\n", "\n\nx", "a \nb", "word " * 3000,
]


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


ENCODERS = {"byte": (IdEncoder(BYTE, "byte"), library(BYTE)), "word": (IdEncoder(WORD, "word"), library(WORD))}


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_are_the_librarys(kind):
    ours, theirs = ENCODERS[kind]
    for text in ODD:
        assert ours.ids(text) == theirs(text), text[:40]
    assert ours.ids(None) == b""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé sS'tL 1½\n\t.!Ŀ日İ", max_size=30), st.sampled_from(["byte", "word"]))
def test_ids_are_the_librarys_for_any_text(text, kind):
    ours, theirs = ENCODERS[kind]
    assert ours.ids(text) == theirs(text)


def test_ids_after_the_table_was_emptied(monkeypatch):
    monkeypatch.setattr("ridecast.llm.token_ids.KEPT", 3)
    ours, theirs = IdEncoder(WORD, "word"), library(WORD)
    for text in ("one two three four five", "six seven", "one two"):
        assert ours.ids(text) == theirs(text)


class Plain:
    """Best fit by looking at every open sequence."""

    def __init__(self, length, most):
        self.length, self.most, self.open, self.made = length, most, {}, 0

    def place(self, size):
        fitting = [f for f in self.open.values() if f >= size]
        space = min(fitting) if fitting else self.length
        if not fitting:
            self.made += 1
        else:
            del self.open[next(k for k, f in self.open.items() if f == space)]
        if space > size:
            if len(self.open) == self.most:
                least = min(self.open.values())
                del self.open[next(k for k, f in self.open.items() if f == least)]
            self.open[object()] = space - size
        return self.made, self.length - space


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120), st.integers(1, 6))
def test_best_fit_equals_a_plain_search(sizes, most):
    packer, plain = packing.BestFit(32, most), Plain(32, most)
    filled = defaultdict(int)
    for size in sizes:
        number, offset = packer.place(size)
        made, plain_offset = plain.place(size)
        assert offset == plain_offset == filled[number]
        assert packer.made == made and packer.open == len(plain.open) <= most
        filled[number] += size
        assert filled[number] <= 32


def test_cut():
    assert packing.cut(0 + 1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def check_pieces(rows, texts, length=2048):
    expected = {i: library(BYTE)(t) + np.array([0], "<u4").tobytes() for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == expected.keys()
    for i, pieces in by_doc.items():
        at = 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(expected[i][4 * at : 4 * (at + r["length"])])
            assert n == 0 or r["length"] == length
            at += r["length"]
        assert 4 * at == len(expected[i]) and (len(pieces) == 1 or at > length)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence), sum(len(x) // 4 for x in expected.values())


def test_packing_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    sequences, ids = check_pieces(QUERIES["op3_packing"](spark, SF_SMALL).collect(), texts)
    assert sequences <= 1.1 * ids / 2048 + 1


def test_packing_odd_rows(documents):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (5, "日本")]
    check_pieces(packing.pack(documents(texts), BYTE).collect(), texts)
    repeated = packing.pack(documents([(1, "a"), (1, "a"), (None, "b")]), BYTE, with_ids=True).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]) // 4) for r in repeated) == [(0, 2), (1, 2), (1, 2)]
    assert packing.pack(documents(texts).where("false"), BYTE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=64, max_size=64))
def test_bits_round_trip(bits, values):
    ids = (np.array(values, np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == 8 * bits
    assert (token_files.unpack_bits(packed, bits) == ids).all()


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_file_random_access(tmp_path, bits):
    from pyarrow import fs

    random = np.random.default_rng(0)
    docs = [(i if i != 3 else None, random.integers(0, 1 << bits, n).astype("<u4")) for i, n in enumerate([1, 0, 5000, 64, 200_000, 3])]
    path = str(tmp_path / "x.bin")
    writer = token_files.Writer(fs.LocalFileSystem().open_output_stream(path), bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    assert writer.close() == (6, sum(len(x) for _, x in docs))
    with fs.LocalFileSystem().open_input_file(path) as file:
        reader = token_files.Reader(file)
        assert reader.doc_ids == [d for d, _ in docs]
        for k in (4, 0, 2, 5, 1):
            assert (reader.document(k) == docs[k][1]).all()
        read = list(reader.documents(most_ids=3000))
        assert [len(x) for _, _, x in read] == [len(x) for _, x in docs]
        assert all((a[2] == b[1]).all() for a, b in zip(read, docs, strict=True))
    with pytest.raises(ValueError, match="more bits"):
        token_files.Writer(fs.LocalFileSystem().open_output_stream(path), 4).add(1, np.array([16], "<u4"))
    (tmp_path / "bad.bin").write_bytes(b"x" * 200)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "bad.bin")) as file, pytest.raises(ValueError, match="not a token file"):
        token_files.Reader(file)


def test_token_files_query(spark):
    texts = sorted(tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    at, expected = 0, []
    for i, text in texts:
        ids = library(WORD)(text) + np.array([1], "<u4").tobytes()
        expected.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, QUERIES["op5_token_files"](spark, SF_SMALL).collect())) == expected


def test_token_files_odd_rows(documents, tmp_path):
    texts = [(5, None), (-1, ""), (None, "x"), (2, "word " * 4000), (7, "a"), (7, "a")]
    index = token_files.write_files(documents(texts), str(tmp_path / "ids"), WORD, 49_408)
    rows = sorted(map(tuple, token_files.read_files(index).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, -1, 2, 5, 7, 7]
    assert [r[2] for r in rows] == [2, 1, 4001, 1, 2, 2]
    assert [r[1] for r in rows] == list(np.cumsum([0, 2, 1, 4001, 1, 2]))
    empty = token_files.write_files(documents(texts).where("false"), str(tmp_path / "none"), WORD, 49_408)
    assert token_files.read_files(empty).collect() == []


LONG_BLANKS = ["x " + " " * 2_000_000 + " y", "x " + "\n" * 2_000_000 + " y", "\t \n" * 400_000, (" " * 99_999 + "x") * 12]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_of_long_white_space(kind):
    ours, theirs = ENCODERS[kind]
    for text in LONG_BLANKS:
        assert ours.ids(text) == theirs(text)


def test_packing_long_white_space(documents):
    texts = list(enumerate([*LONG_BLANKS, "a b"]))
    check_pieces(packing.pack(documents(texts), BYTE).collect(), texts)


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <| endoftext|>", "日本 <|endoftext|>", "plain", " " * 200_000 + "<|endoftext|>"]


def plain_call(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_special_tokens_are_those_of_the_plain_call(path, kind):
    ours, theirs = IdEncoder(path, kind, special_as_text=False), plain_call(path)
    for text in [*SPECIAL, *ODD]:
        assert ours.ids(text) == theirs(text), text[:40]


def test_operators_keep_special_tokens_unless_told(documents, tmp_path):
    texts, end = list(enumerate(SPECIAL)), np.array([0], "<u4").tobytes()
    for as_text, ids in ((False, plain_call(BYTE)), (True, library(BYTE))):
        got = defaultdict(bytes)
        for r in sorted(packing.pack(documents(texts), BYTE, with_ids=True, special_as_text=as_text).collect(), key=lambda r: (r["doc_id"], r["piece"])):
            got[r["doc_id"]] += r["ids"]
        assert got == {i: ids(t) + end for i, t in texts}
    assert packing.pack(documents(texts[:1]), BYTE, with_ids=True).first()["ids"] == np.array([64, 220, 50256, 275, 0], "<u4").tobytes()
    for name, options, ids in (("a", {}, plain_call(WORD)), ("b", {"special_as_text": True}, library(WORD))):
        index = token_files.write_files(documents(texts), str(tmp_path / name), WORD, 49_408, **options)
        rows = sorted(map(tuple, token_files.read_files(index).collect()))
        assert [r[3] for r in rows] == [zlib.crc32(ids(t) + np.array([1], "<u4").tobytes()) for _, t in texts]
