"""K-mer sets and sketches of text (SIM-11, SIM-12, SIM-13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmat.constants import KMER_LENGTH
from kinmat.session import settle, ship_package

BITS_PER_BLOCK = 64
#: Bytes of text that a task cuts into k-mers at a time, and digests that it computes side by side.
SLICE_BYTES, SIDE_BY_SIDE = 1 << 18, 1 << 14
#: The longest string whose digest takes one round of 64 steps.
ONE_ROUND = 55

_STEPS = [s for group in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in group * 4]
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# By the bytes of a word that belong to the string, less one to four: what is kept of it, and the bit that ends the string.
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
_END = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], dtype=np.uint32)


def kmer_set(text: Column, k: int = KMER_LENGTH) -> Column:
    """SIM-11: distinct substrings of length ``k``; empty for shorter text.

    A lookahead captures every overlapping k-mer in one linear pass, whereas
    ``substring(text, i, k)`` walks the text from its start for each i.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # The search advances by UTF-16 units; a k-mer cannot start inside a pair of them.
    window = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{k - 1}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(window), F.lit(1)))


def exploded(sets: DataFrame) -> DataFrame:
    """One row (..., kmer) per k-mer of ``sets`` (..., kmers).

    A plain explode makes the optimizer test the size of the set in a filter
    of its own, which extracts all k-mers a second and third time.
    """
    rest = [c for c in sets.columns if c != "kmers"]
    return sets.select(*rest, F.explode_outer("kmers").alias("kmer")).where("kmer is not null")


def set_jaccard(a: Column, b: Column) -> Column:
    """SIM-12 for two sets in one row; two empty sets give 0."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def _round(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """MD5 of n messages of one round each, given as sixteen columns of words (None: all zero); four columns."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _FIRST)
    mixed, other = np.empty_like(a), np.empty_like(a)
    for i, (step, sine) in enumerate(zip(_STEPS, _SINES)):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        mixed += a
        if words[at] is not None:
            mixed += words[at]
        mixed += sine
        np.left_shift(mixed, np.uint32(step), out=other)
        mixed >>= np.uint32(32 - step)
        mixed |= other
        np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([np.uint32(x) + y for x, y in zip(_FIRST, (a, b, c, d))], axis=1)


def md5_words(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MD5 of many short strings of bytes in ``flat``, each as four big-endian words in the order of its hex digits."""
    wide = np.concatenate([flat, np.zeros(67, dtype=np.uint8)]).astype(np.uint32)
    rolling = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    found = np.zeros((len(starts), 4), dtype=np.uint32)
    for low in range(0, len(starts), SIDE_BY_SIDE):
        at, size = starts[low : low + SIDE_BY_SIDE], sizes[low : low + SIDE_BY_SIDE]
        words, short, long = [], size.min(), min(size.max(), ONE_ROUND)
        for j in range(0, 56, 4):
            word = rolling[np.minimum(at + j, len(rolling) - 1)] if j <= long else None
            if word is not None and j + 4 > short:
                rest = np.clip(size - j, -1, 4) + 1
                word = (word & _KEPT[rest]) | _END[rest]
            words.append(word)
        words += [(8 * size).astype(np.uint32), None]
        found[low : low + SIDE_BY_SIDE] = _round(words, len(at))
    found = found.byteswap()
    for i in np.flatnonzero(sizes > ONE_ROUND):
        found[i] = np.frombuffer(hashlib.md5(flat[starts[i] : starts[i] + sizes[i]].tobytes()).digest(), dtype=">u4")
    return found


def _kept_kmers(raws: list[bytes], k: int, scaled: int) -> list[list[bytes]]:
    """The distinct k-mers of each text, as UTF-8, whose digest begins below 2^32 / ``scaled``."""
    whole = b"".join(raws)
    flat = np.frombuffer(whole, dtype=np.uint8)
    at = np.flatnonzero((flat & 0xC0) != 0x80)
    last = np.searchsorted(at, np.cumsum([len(r) for r in raws]))
    text = np.repeat(np.arange(len(raws)), np.diff(last, prepend=0))
    inside = np.flatnonzero(np.arange(len(at)) + k <= last[text])
    starts, ends = at[inside], np.append(at, len(flat))[inside + k]
    if scaled > 1:
        low = np.flatnonzero(md5_words(flat, starts, ends - starts)[:, 0] < (1 << 32) // scaled)
        starts, ends, inside = starts[low], ends[low], inside[low]
    kept = [set() for _ in raws]
    for t, s, e in zip(text[inside].tolist(), starts.tolist(), ends.tolist()):
        kept[t].add(whole[s:e])
    return [list(x) for x in kept]


def _sketched(raws: list[bytes], dim: int, scaled: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of kept k-mers and vector of each text."""
    blocks = dim // BITS_PER_BLOCK
    kept = _kept_kmers(raws, k, scaled)
    n, sums = np.array([len(x) for x in kept]), np.zeros((len(raws), dim), dtype=np.int64)
    text, kmers = np.repeat(np.arange(len(raws)), n), [x for each in kept for x in each]
    marks = [b"|%d" % b for b in range(blocks)]
    group = max(1, 2 * SIDE_BY_SIDE // blocks)
    for low in range(0, len(kmers), group):
        marked = [x + m for x in kmers[low : low + group] for m in marks]
        sizes = np.array([len(x) for x in marked])
        digests = md5_words(np.frombuffer(b"".join(marked), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        bits = np.unpackbits(np.ascontiguousarray(digests[:, 2:], dtype=">u4").view(np.uint8)).reshape(-1, dim)
        own = text[low : low + group]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return n, (2 * sums - n[:, None]).astype(np.int32)


def sketch_vectors(docs: DataFrame, dim: int, scaled: int, k: int = KMER_LENGTH) -> DataFrame:
    """SIM-13: (id, text) to (id, n_kept, v ARRAY<INT>).

    A k-mer is kept when the first 32 bits of its digest (MD5) fall below
    2^32 / ``scaled``; each kept k-mer adds +1 or -1 to every component. The
    signs of components 64b .. 64b+63 are the last 64 bits of the digest of
    the k-mer and b. Digests are computed side by side for slices of texts, and a text gives its vector where it is read, so
    nothing is shuffled. Rows of one id count together and a null id has nothing; only ids that stand
    in several rows are gathered, by id.
    """
    if dim % BITS_PER_BLOCK or scaled < 1:
        raise ValueError("dim must be a multiple of 64 and scaled at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
            rows = max(1, SLICE_BYTES // dim)
            cuts = np.flatnonzero(np.diff((np.cumsum([len(r) for r in raws]) // SLICE_BYTES), prepend=0)).tolist()
            cuts = sorted({*cuts, *range(0, len(raws), rows)})
            for low, high in zip(cuts, [*cuts[1:], len(raws)]):
                n, v = _sketched(raws[low:high], dim, scaled, k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(n), lists], names=["id", "n_kept", "v"])

    ship_package(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    found = docs.select("id", "text").mapInArrow(run, f"id {kind}, n_kept bigint, v array<int>")
    empty = F.array_repeat(F.lit(0), dim)
    known = found.select(
        "id",
        F.when(F.col("id").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_kept")).alias("n_kept"),
        F.when(F.col("id").isNull(), empty).otherwise(F.col("v")).alias("v"),
    )
    repeated = settle(docs.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        return known
    parts = found.join(repeated, "id", "left_semi").select("id", "n_kept", F.posexplode("v").alias("at", "value"))
    sums = parts.groupBy("id", "at").agg(F.sum("n_kept").alias("n_kept"), F.sum("value").cast("int").alias("value"))
    merged = sums.groupBy("id").agg(F.first("n_kept").alias("n_kept"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    gathered = docs.select("id").join(merged.select("id", "n_kept", F.col("v.value").alias("v")), "id")
    return known.join(repeated, "id", "left_anti").unionByName(gathered)
