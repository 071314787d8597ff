"""Where the tokens of two public tokenizers end together, and which tokens correspond corpus-wide.

A text's tokens by A and by B are two ascending lists of byte offsets at which tokens end. They are merged
along a merge path: diagonals at equal distances cut the merge into pieces of equal work, a binary search on each
diagonal finds where its piece begins in either list, and all pieces advance by themselves. A piece emits
the ends that both lists share; those on either side of a cut are stitched into groups by running counts.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinmat.llm.frames import apart, slices, small_batches, text_or_empty
from kinmat.llm.tokens import LONGEST_REMEMBERED, WordMemory, byte_symbols, piece_processor
from kinmat.session import settle, ship_package

#: Steps of the merge in each piece.
PIECE_STEPS = 512
#: Entries in the younger half of a task's memory of chunks.
MEMORY_CHUNKS = 100_000
#: Bytes of pair counts that are broadcast at once, at 16 bytes a pair.
WAVE_BYTES = 64 << 20

# A single space between two characters that are no white space: neither tokenizer has a token across its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Words that are one pre-token of the byte-level pattern, and a closing mark that is another.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")

ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@dataclasses.dataclass(frozen=True)
class Pair:
    """Both vocabularies in a task: bytes of every id, and the ids of many chunks (None where the bytes differ from one)."""

    bytes_a: list[bytes]
    bytes_b: list[bytes]
    encode: Callable[[list[str]], list[tuple[bytes, bytes] | None]]


def _bytes_of_a(vocabulary: dict[str, int]) -> list[bytes]:
    value = {symbol: i for i, symbol in enumerate(byte_symbols())}
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        found[number] = bytes(value[s] for s in token) if all(s in value for s in token) else token.encode()
    return found


def _bytes_of_b(processor) -> list[bytes]:
    pieces = [processor.id_to_piece(i) for i in range(len(processor))]
    return [
        bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
    ]


@lru_cache(maxsize=2)
def vocabularies_of(path_a: str, path_b: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, processor = Tokenizer.from_file(path_a), piece_processor(path_b)
    tokenizer.encode_special_tokens = True
    model, symbols = tokenizer.model, byte_symbols()
    bytes_a, bytes_b = _bytes_of_a(tokenizer.get_vocab(with_added_tokens=True)), _bytes_of_b(processor)

    def merged(pre_token: bytes) -> list[int]:
        return [t.id for t in model.tokenize("".join(map(symbols.__getitem__, pre_token)))]

    words = WordMemory(merged, MEMORY_CHUNKS)

    def encode(chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of a space and each chunk, 32 bits each."""
        found = []
        for chunk, b in zip(chunks, processor.encode(chunks, num_threads=1), strict=True):
            plain, raw = _PLAIN.fullmatch(chunk), b" " + chunk.encode()
            if plain is None:
                a = tokenizer.encode(" " + chunk, add_special_tokens=False).ids
            elif plain[2]:
                a = words[raw[:-1]] + words[raw[-1:]]
            else:
                a = words[raw]
            if b"".join([bytes_a[i] for i in a]) != raw or b"".join([bytes_b[i] for i in b]) != raw:
                found.append(None)
            else:
                found.append((array("I", a).tobytes(), array("I", b).tobytes()))
        return found

    return Pair(bytes_a, bytes_b, encode)


def diagonal_starts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b the merge has taken before each piece of ``steps`` steps; on ties a goes first."""
    diagonals = np.arange(0, len(a) + len(b), steps)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(diagonals), dtype=bool)
        first[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, diagonals - low


def shared_ends(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both ascending lists hold.

    All pieces advance a step at a time, each from its own start. As a goes first on ties, a value of b that is taken has
    its equal just before it in a, be that in the piece before.
    """
    i, j = diagonal_starts(a, b, steps)
    partner = np.full(len(b), -1, dtype=np.int64)
    padded_a, padded_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    end = np.append(i[1:] + j[1:], len(a) + len(b))
    for _ in range(min(steps, len(a) + len(b))):
        going = i + j < end
        take_a = going & (padded_a[i] <= padded_b[j]) & (i < len(a))
        take_b = going & ~take_a
        met = take_b & (i > 0) & (padded_a[i - 1] == padded_b[j])
        partner[j[met]] = i[met] - 1
        i, j = i + take_a, j + take_b
    in_b = np.flatnonzero(partner >= 0)
    return partner[in_b], in_b


def _digit_table(size: int, marks: str) -> tuple[np.ndarray, np.ndarray]:
    """For each mark and id, its decimal digits and the mark as bytes, padded by zeros, and their number."""
    shown = np.array([f"{i}{mark}" for mark in marks for i in range(size)], dtype="S")
    return shown.view(np.uint8).reshape(len(shown), -1), np.char.str_len(shown)


class Aligner:
    """Aligns whole texts, a few MB at a time; several texts lie end to end in one merge."""

    def __init__(self, path_a: str, path_b: str, steps: int = PIECE_STEPS) -> None:
        pair = vocabularies_of(path_a, path_b)
        # Ids by chunk, in two generations as in ``WordMemory``, but filled many chunks at a time.
        self.encode, self.steps = pair.encode, steps
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        self.length_a, self.length_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (pair.bytes_a, pair.bytes_b))
        tables = _digit_table(len(pair.bytes_a), ",|"), _digit_table(len(pair.bytes_b), ",;")
        width = max(t.shape[1] for t, _ in tables)
        self.digits = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t, _ in tables])
        self.n_digits = np.concatenate([n for _, n in tables])
        self.size_a, self.size_b = len(pair.bytes_a), len(pair.bytes_b)

    def _known(self, pieces: list[list[str]]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of all chunks of the texts at hand."""
        asked = set().union(*pieces)
        known = {c: self.old[c] for c in asked if c in self.old} | {c: self.young[c] for c in asked if c in self.young}
        new = [c for c in asked if c not in known]
        known |= zip(new, self.encode(new), strict=True)
        if len(self.young) >= MEMORY_CHUNKS:
            self.young, self.old = {}, self.young
        self.young |= ((c, x) for c, x in known.items() if len(c) <= LONGEST_REMEMBERED)
        return known

    def __call__(self, texts: list[str]) -> dict[str, object]:
        ids_a, ids_b, n_a, n_b = [], [], [], []
        pieces = [_CUT.split(text) if text else [] for text in texts]
        known = self._known(pieces)
        for chunks in pieces:
            found = list(map(known.__getitem__, chunks))
            if None in found:
                found = []
            a, b = b"".join([x for x, _ in found]), b"".join([x for _, x in found])
            ids_a.append(a)
            ids_b.append(b)
            n_a.append(len(a) // 4)
            n_b.append(len(b) // 4)
        a, b = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (ids_a, ids_b))
        at_a, at_b = shared_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), self.steps)
        # The last token of a text always ends together with the other list's.
        link_text = np.searchsorted(np.cumsum(n_a), at_a, side="right")
        n_groups = np.bincount(link_text, minlength=len(texts))
        pairs = self.size_a * self.size_b
        keyed, times = np.unique(link_text * pairs + a[at_a] * self.size_b + b[at_b], return_counts=True)
        starts = np.searchsorted(keyed, np.arange(len(texts) + 1) * pairs)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_groups,
            "groups_sha256": self._digests(a, b, at_a, at_b, np.array(n_a), np.array(n_b)),
            "pairs": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keyed % pairs, pa.int64())),
            "times": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(times, pa.int64())),
        }

    def _digests(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Of each text's groups, A's ids before B's; empty for a text without tokens."""
        before_a = np.append(0, np.cumsum(np.bincount(at_a, minlength=len(a)))[:-1]) if len(a) else np.zeros(0, np.int64)
        before_b = np.append(0, np.cumsum(np.bincount(at_b, minlength=len(b)))[:-1]) if len(b) else np.zeros(0, np.int64)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[at_a], last_b[at_b] = True, True
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        # A token of A stands behind the groups before its own; one of B also behind A's tokens of its own group.
        codes[np.arange(len(a)) + np.append(0, at_b + 1)[before_a]] = a + self.size_a * last_a
        codes[np.arange(len(b)) + (at_a + 1)[before_b]] = 2 * self.size_a + b + self.size_b * last_b
        shown = self.digits[codes]
        flat = shown[shown != 0].tobytes()
        ends = np.append(0, np.cumsum(self.n_digits[codes]))[np.append(0, np.cumsum(n_a + n_b))]
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


def aligned(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, groups_sha256 and the text's linked pairs (``pairs``, key a * size of B + b; ``times``).

    Null and empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens. Rows and other
    columns (``keep``, all by default) stay, repeated rows too; columns named like an added one are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*ADDED, "pairs", "times")]
    source, _ = apart(docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty().alias("__text__")), ("__text__",))
    own = source.columns[:-1]
    added = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "times": "array<long>"}
    schema = source.select(*own).schema
    for field in StructType.fromDDL(", ".join(f"__{name}__ {kind}" for name, kind in added.items())):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "__text__"):
                found = align(part.column("__text__").to_pylist())
                arrays = [part.column(n) for n in own] + [x if isinstance(x := found[n], pa.Array) else pa.array(x) for n in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*own, *[f"__{n}__" for n in added]])

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(h).alias(c) for h, c in zip(own, kept, strict=True)], *[F.col(f"__{n}__").alias(n) for n in added])


def pair_counts(found: DataFrame) -> DataFrame:
    """pair and n: how many links of the whole corpus hold it; summed within Arrow batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = np.unique(batch.column("pairs").flatten().to_numpy(), return_inverse=True)
            n = np.bincount(at, batch.column("times").flatten().to_numpy(), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    return found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def correspondences(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of the pairs.

    ``count_sum`` adds up the corpus-wide counts of a text's linked pairs; ``n_best`` counts the links whose pair is the most
    frequent one of its B id, ties included. The counts are broadcast in waves of at most about ``wave_bytes``; the
    greatest count of each B id is a list as long as B's vocabulary. An empty table gives no rows.
    """
    size_b = len(piece_processor(path_b))
    source, _ = apart(aligned(docs, path_a, path_b, keep), (*ADDED, "pairs", "times"))
    source = settle(source.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}))
    counts = settle(pair_counts(source))
    best = np.zeros(size_b, dtype=np.int64)
    for row in counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).collect():
        best[row["b"]] = row["n"]
    waves = max(1, math.ceil(counts.count() * 16 / wave_bytes))
    for number in range(waves):
        table = counts.where(F.pmod(F.xxhash64("pair"), F.lit(waves)) == number).toArrow().sort_by("pair")
        wave = source.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy(), table.column("n").to_numpy(), best))
        source = source.mapInArrow(_weighed(wave, source.columns, size_b), source.schema)
        if number < waves - 1:
            source = settle(source)
    own = [c for c in source.columns if c.startswith("__own_")]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*ADDED, "pairs", "times")]
    return source.select(*[F.col(h).alias(c) for h, c in zip(own, kept, strict=True)], *ADDED)


def _weighed(wave, columns: list[str], size_b: int):
    """Adds to n_best and count_sum what the pairs of a wave give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = wave.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            flat = pairs.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            n = np.where(keys[at] == flat, counts[at], 0) if len(keys) else np.zeros(len(flat), dtype=np.int64)
            sums, bests = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(sums, row, n * times)
            np.add.at(bests, row, np.where((n > 0) & (n == best[flat % size_b]), times, 0))
            arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
            arrays["n_best"] = pa.array(batch.column("n_best").to_numpy() + bests)
            arrays["count_sum"] = pa.array(batch.column("count_sum").to_numpy() + sums)
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], names=columns)

    return run
