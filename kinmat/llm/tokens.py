"""Public tokenizers inside tasks: the libraries' own results, remembered by word."""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

#: Entries of the younger half of a memory of words; both halves together stay below 100 MB.
MEMORY_WORDS = 200_000
#: Longer chunks are encoded each time and never remembered.
LONGEST_REMEMBERED = 64

# White space by some definitions only; texts without it are split at any white space.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PLAIN_SPACE = re.compile("[ \t\n\r]+")
# Words that normalise by lower-casing alone and split into letters and one closing mark.
_PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class WordMemory(dict):
    """Results by chunk, in two generations so that it neither grows nor forgets common words.

    A lookup that misses falls through to ``make``; a generation that is full becomes the older one.
    """

    def __init__(self, make: Callable[[str], object], size: int = MEMORY_WORDS) -> None:
        super().__init__()
        self._make, self._size, self._older = make, size, {}

    def __missing__(self, chunk: str) -> object:
        found = self._older.get(chunk)
        if found is None:
            found = self._make(chunk)
            if len(chunk) > LONGEST_REMEMBERED:
                return found
        if len(self) >= self._size:
            self._older = dict(self)
            self.clear()
        self[chunk] = found
        return found


def chunks(text: str) -> list[str]:
    """The text without the four plain kinds of white space, at which every tokenizer here splits."""
    if _ODD_SPACE.search(text):
        return [c for c in _PLAIN_SPACE.split(text) if c]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian, 32 bits each) by a JSON vocabulary whose pre-tokens never hold white space.

    The ids of a text are those of its chunks in order. Plain words go straight to the
    vocabulary's merges; everything else goes through the library's whole encoding.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model = tokenizer.model
    symbols = byte_symbols()

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(word: str) -> bytes:
        shown = word if word.isascii() else "".join(symbols[b] for b in word.encode())
        return packed([t.id for t in model.tokenize(shown)])

    def whole(chunk: str) -> bytes:
        plain = _PLAIN_WORD.fullmatch(chunk)
        if plain is None:
            return packed(tokenizer.encode(chunk, add_special_tokens=False).ids)
        word, mark = plain.groups()
        lower = word.lower()
        found = merged(lower) if lower == chunk else memory[lower]
        return found + memory[mark] if mark else found

    memory = WordMemory(whole)

    def encode(text: str) -> bytes:
        return b"".join(map(memory.__getitem__, chunks(text)))

    return encode


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
