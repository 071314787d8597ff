"""Byte-level BPE by a local file of ranks: whole texts to ids and ids back to bytes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinmat.llm.frames import map_texts
from kinmat.llm.tokens import rank_encoding

#: Characters after which a long text is cut at the next safe boundary.
LONG_TEXT = 1 << 16

# No match of the pattern holds both sides: a letter or digit, then a plain space or line end that follows it.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")


def parts(text: str, longest: int = LONG_TEXT) -> list[str]:
    """The text in pieces that encode separately to the ids of the whole.

    Cuts lie only between a letter or digit and the white space after it, where a match of
    the splitting pattern always ends and no look-ahead of an earlier match ends on white space. A
    text without such a place stays whole.
    """
    if len(text) <= longest:
        return [text]
    found, start = [], 0
    while len(text) - start > longest:
        cut = _SAFE.search(text, start + longest)
        if cut is None:
            break
        found.append(text[start : cut.start()])
        start = cut.start()
    return [*found, text[start:]]


def encode(
    docs: DataFrame, ranks: str, pattern: str, decoded: bool = False, column: str = "text", keep: list[str] | None = None, longest: int = LONG_TEXT
) -> DataFrame:
    """Add n_tokens and ids (little-endian, 32 bits each); with ``decoded`` also the bytes that the ids stand for.

    A null text counts as empty and has no ids. Other columns stay, nulls and repeated rows
    included; columns named like an added one are replaced. Memory is that of the longest text of a batch.
    """

    def make():
        encoding = rank_encoding(ranks, pattern)

        def work(texts: list[str]) -> dict[str, Iterable]:
            counts, ids, back = [], [], []
            for text in texts:
                arrays = [np.asarray(encoding.encode_ordinary(p), dtype="<u4") for p in parts(text, longest)]
                counts.append(sum(map(len, arrays)))
                ids.append(b"".join(a.tobytes() for a in arrays))
                if decoded:
                    back.append(b"".join(encoding.decode_bytes(a.tolist()) for a in arrays))
            return {"n_tokens": counts, "ids": ids, "decoded": back}

        return work

    fields = [("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.binary())] * decoded
    return map_texts(docs, column, make, pa.schema(fields), keep)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add the bytes that the column ``ids`` of ``encode`` stands for; they need not be valid UTF-8. Null stays null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def back(ids):
        encoding = rank_encoding(ranks, pattern)
        return ids.map(lambda x: None if x is None else encoding.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()))

    return encoded.withColumn("decoded", back("ids"))
