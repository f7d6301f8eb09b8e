"""Encoding whole texts with a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words that a worker remembers; beyond that it encodes others each time.
CACHE_WORDS = 600_000
#: White space beside other white space: there the pattern of the tokenizer may join them.
#: The separators from x1c on are white space to Python's patterns and not to the tokenizer's.
UNEVEN = re.compile(r"\s\s|[\0\x1c-\x1f]")
#: White space but the usual two, and the mark that words are cut at; a text with none of them needs no search by pattern.
UNUSUAL = ["\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
DOUBLE = ("  ", " \n", "\n ", "\n\n")
CLOSING = ".,;:!?"
#: Letters below this one are letters to any Unicode version.
SURE = "ɐ"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Ids of words, a leading space being part of them; learns on demand, up to a bound."""

    def __init__(self, tokenizer, dtype: np.dtype):
        super().__init__({"": b""})
        self.tokenizer, self.dtype, self.model = tokenizer, dtype, tokenizer.model
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[32]
        self.code = "H" if dtype.itemsize == 2 else "I"

    def encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(CLOSING)
        letters = stem[1:] if stem[:1] == " " else stem
        if letters.isalpha():
            if len(stem) < len(word):
                ids = self[stem] + self[word[len(stem) :]]
            elif letters.isascii():  # one part of the pattern: straight to the model
                ids = array(self.code, [t.id for t in self.model.tokenize(self.space + letters if letters is not stem else stem)]).tobytes()
            elif max(letters) < SURE:
                ids = array(self.code, [t.id for t in self.model.tokenize(stem.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
            else:
                ids = self.encode(word)
        else:
            ids = self.encode(word)
        if len(self) < CACHE_WORDS and len(word) < 40:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them, as little-endian bytes.

    A byte-level BPE first cuts a text by a pattern, and merges never cross
    its parts. A space between two non-spaces always opens a part, a lone
    line feed is one, and a run of letters ends one. So a text's ids are those
    of its words in a row, and the ids of frequent words are remembered.
    Texts with other runs of white space, or with the written form of a
    special token, are encoded whole. Such a form gets the special id, as the
    library does it by default; `marks_as_text` makes it ordinary text.
    """

    def __init__(self, path: str, marks_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = Words(self.tokenizer, self.dtype)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = kind == "ByteLevel" and self.tokenizer.normalizer is None
        self.marks = [] if marks_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if not self.by_word or uneven(text) or any(m in text for m in self.marks):
            return self.words.encode(text)
        words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.words.__getitem__, words))


def uneven(text: str) -> bool:
    """Whether UNEVEN is found in a text."""
    if any(map(text.__contains__, UNUSUAL)):
        return UNEVEN.search(text) is not None
    return any(map(text.__contains__, DOUBLE))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
