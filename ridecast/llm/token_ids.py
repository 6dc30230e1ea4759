"""Token ids of whole texts by a vocabulary file of the tokenizers library.

The ids are always those of that library. Texts whose characters are all in the table below
take a shorter way to them:

* A vocabulary of lower-case words encodes each word alone, so a word that was encoded once
  need not be encoded again. Texts are split here by the vocabulary's own pattern and looked up,
  and the library encodes each new word.
* A byte-level vocabulary whose merges have the order of its ids is what tiktoken reads as
  ranks. It is loaded from the same file and gives the same ids in a third of the time, without
  a table of words. Its pattern fails on white space of about a million characters, so a text
  with a long run of it does not go this way.

Any other text goes to the tokenizers library whole, and so does one that holds the string of
an added token, unless such strings are to be ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Characters whose class and lower case do not depend on a Unicode version: tab, line feed,
#: printable ASCII and Latin letters up to U+017F, without those that change length in lower case.
PLAIN = [c for c in map(chr, [9, 10, *range(0x20, 0x7F), *range(0xA1, 0x180)]) if c not in "­İŉſ"]
LETTERS = "".join(c for c in PLAIN if unicodedata.category(c).startswith("L"))
NUMBERS = "".join(c for c in PLAIN if unicodedata.category(c).startswith("N"))

#: Most strings kept in a worker's table before it is emptied and filled again; about 100 MB.
KEPT = 600_000


def _class(characters: str) -> str:
    return re.escape(characters)


_L, _N = _class(LETTERS), _class(NUMBERS)
_NOT_PLAIN = re.compile(f"[^{_class(''.join(PLAIN))}]")
#: White space of a length that tiktoken's pattern surely passes (it failed from between 900,000 and 1,000,000 on).
BLANK = 100_000
_LONG_BLANK = re.compile(rf"(?<!\s)\s{{{BLANK}}}")
#: The words of the two vocabularies, as their files state them; the second over
#: plain characters only.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+",
}


class _Known(dict):
    """Strings of plain characters to their ids; a new string is encoded when it is asked for."""

    def __init__(self, words, encode):
        super().__init__()
        self.words, self.encode = words, encode

    def __missing__(self, string: str) -> bytes:
        words = (string,) if string.isalpha() else self.words(string)
        if len(words) == 1 and words[0] == string:
            found = array("I", self.encode(string, None, False, False).ids).tobytes()
        else:
            found = b"".join([self[w] for w in words])
        self[string] = found
        return found


def _byte_ranks(path: str) -> dict[bytes, int]:
    """The ordinary tokens of a byte-level vocabulary file as bytes, by id."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    # Printable bytes stand for themselves, the others for characters from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {token["content"] for token in content["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}


class IdEncoder:
    """Texts to ids. `kind` is "byte" (byte-level words, nothing dropped) or "word" (lower
    case, white space dropped). Strings of special tokens in a text are ordinary text, or those
    tokens if `special_as_text` is false, as in the library's plain call."""

    def __init__(self, path: str, kind: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.known, self.special_as_text = path, None, special_as_text
        with open(path, encoding="utf-8") as file:
            added = [token["content"] for token in json.load(file)["added_tokens"]]
        self.added = [] if special_as_text else added
        self._whole: Tokenizer | None = None
        if kind == "byte":
            self.ranked = tiktoken.Encoding("bytes", pat_str=PATTERNS["byte"], mergeable_ranks=_byte_ranks(path), special_tokens={})
            self.plain_ids = self._ranked_ids
        else:
            # The same model for one word: no normalising, no splitting, only bytes to characters.
            word = self._load()
            word.encode_special_tokens = True
            word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            word.normalizer = normalizers.Sequence([])
            self.known = _Known(re.compile(PATTERNS["word"]).findall, word.encode)
            self.plain_ids = self._known_ids

    def _load(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = self.special_as_text
        return tokenizer

    @property
    def whole(self) -> Tokenizer:
        if self._whole is None:
            self._whole = self._load()
        return self._whole

    def _ranked_ids(self, text: str) -> bytes:
        if len(text) >= BLANK and _LONG_BLANK.search(text):
            return self._whole_ids(text)
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def _whole_ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known_ids(self, text: str) -> bytes:
        if len(self.known) > KEPT:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for a null or empty text."""
        if not text:
            return b""
        if _NOT_PLAIN.search(text) or any(a in text for a in self.added):
            return self._whole_ids(text)
        return self.plain_ids(text)


_encoders: dict[tuple[str, str, bool], IdEncoder] = {}


def encoder(path: str, kind: str, special_as_text: bool = False) -> IdEncoder:
    """The Python worker's encoder for a vocabulary file."""
    if (path, kind, special_as_text) not in _encoders:
        _encoders[path, kind, special_as_text] = IdEncoder(path, kind, special_as_text)
    return _encoders[path, kind, special_as_text]
