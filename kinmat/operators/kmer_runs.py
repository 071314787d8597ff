"""K-mers by minimizer partitions: runs of text are shuffled, not k-mers (SIM-12 at scale).

The minimizer of a k-mer is the least hash of the shorter strings in it. Neighbouring k-mers mostly share
it, so a text is cut into runs of k-mers with one minimizer, some seven k-mers long on average, and a run travels as the
piece of text that it spans. Minimizers are dealt into buckets, and the runs of a bucket that are cut together travel as one row.
Equal k-mers have equal minimizers and meet in one place, where runs are spread out again and
k-mers are counted. K-mers are compared by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmat.constants import KMER_LENGTH, MAX_HOT_KEYS
from kinmat.operators.skew import join_grouped
from kinmat.session import settle, ship_package, together

#: Length of the strings whose least hash is the minimizer.
MINIMIZER_LENGTH = 9
#: K-mers that a task counts together; a minimizer with more is hot unless the whole collection is large.
CHUNK_KMERS = 1 << 20
#: K-mers of a single minimizer that a task counts in memory; beyond, they go on as rows.
GROUP_KMERS = 4 << 20
#: Code points of text that a task cuts at a time.
SLICE_POINTS = 1 << 20
#: K-mers of a bucket of minimizers on average, and the least number of buckets, so that a row stays a few kilobytes.
BUCKET_KMERS, MIN_BUCKETS = 1 << 18, 1 << 11
#: K-mers whose runs are shuffled at a time; a larger collection is cut again for the buckets of each wave.
WAVE_KMERS = 1 << 28

_MULTIPLIERS = np.random.default_rng(20_240_607).integers(1, 1 << 63, (3, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

PARTS = "id long, df long, mark_a long, mark_b long, weight long"
CLASS = ("df", "mark_a", "mark_b")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def window_hashes(points: np.ndarray, length: int, which: int) -> np.ndarray:
    """A hash of every window of ``length`` code points; ``which`` picks one of three independent hashes."""
    windows = max(0, len(points) - length + 1)
    wide, total = points.astype(np.uint64), np.zeros(windows, dtype=np.uint64)
    for i in range(length):
        total += wide[i : i + windows] * _MULTIPLIERS[which, i]
    return _mixed(total)


def minimizers(points: np.ndarray, k: int) -> np.ndarray:
    """The minimizer of every k-mer: the least hash of its shorter windows."""
    short = min(MINIMIZER_LENGTH, k)
    hashes, windows = window_hashes(points, short, 2), max(0, len(points) - k + 1)
    least = hashes[:windows].copy()
    for i in range(1, k - short + 1):
        np.minimum(least, hashes[i : i + windows], out=least)
    return least


def _slices(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, code points end to end and where each text begins, for a bounded number of code points at a time.

    A longer text comes in pieces that overlap, so that each of its k-mers is in one piece.
    """
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_POINTS, prepend=0) | (sizes > SLICE_POINTS))
        for low, high in zip([0, *cuts], [*cuts, len(ids)]):
            if high > low:
                parts = [np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4") for t in texts[low:high].to_pylist()]
                whole, first = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
                if high - low > 1 or len(whole) <= 2 * SLICE_POINTS:
                    yield ids[low:high], whole, first
                    continue
                for start in range(0, len(whole), SLICE_POINTS):
                    piece = whole[start : start + SLICE_POINTS + k - 1]
                    yield ids[low:high], piece, np.array([0, len(piece)])


def _runs_of(points: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """minimizer, number of the text, first k-mer and number of k-mers of every run."""
    least = minimizers(points, k)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    inside = np.arange(len(least)) + k <= first[text + 1]
    least, text, at = least[inside], text[inside], np.flatnonzero(inside)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(fresh)
    return least[starts], text[starts], at[starts], np.diff(np.append(starts, len(at)))


def _spelled(points: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all runs end to end, and where each begins."""
    ends = np.cumsum(lengths)
    offsets = np.append(0, ends)
    return points[np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    size = flat.dtype.itemsize
    buffers = [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(flat.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _postings(ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low, id) in this order, and where a new k-mer begins."""
    order = np.lexsort((ids, low, high))
    ids, high, low = ids[order], high[order], low[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    kept = fresh.copy()
    kept[1:] |= ids[1:] != ids[:-1]
    return ids[kept], high[kept], low[kept], np.flatnonzero(fresh[kept])


def _rows(ids: np.ndarray, df: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    columns = [ids, df, a.view(np.int64), b.view(np.int64), weight]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=["id", *CLASS, "weight"])


def counted(ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """id, class and number of k-mers of that class, from complete postings; k-mers of a single text have zero marks."""
    ids, high, low, starts = _postings(ids, high, low)
    if not len(ids):
        return _rows(ids, ids, high, low, ids)
    df = np.diff(np.append(starts, len(ids)))
    hashed = _mixed(ids.astype(np.uint64) + _MIX_2)
    again = _mixed(hashed ^ _MIX_1)
    marks = [np.repeat(np.where(df > 1, np.bitwise_xor.reduceat(h, starts), np.uint64(0)), df) for h in (hashed, again)]
    each = np.repeat(df, df)
    order = np.lexsort((marks[1], marks[0], each, ids))
    ids, each, a, b = ids[order], each[order], marks[0][order], marks[1][order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (each[1:] != each[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(fresh)
    return _rows(ids[at], each[at], a[at], b[at], np.diff(np.append(at, len(ids))))


def _single(ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Distinct postings that are counted elsewhere: df 0, and the k-mer's hashes in place of marks."""
    ids, high, low, _ = _postings(ids, high, low)
    return _rows(ids, np.zeros(len(ids), dtype=np.int64), high, low, np.ones(len(ids), dtype=np.int64))


def _kmers(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id and both hashes of every k-mer of runs that lie end to end."""
    run = np.repeat(np.arange(len(ids)), np.diff(offsets))[: max(0, len(flat) - k + 1)]
    inside = np.arange(len(run)) + k <= offsets[run + 1]
    return ids[run[inside]], window_hashes(flat, k, 0)[inside], window_hashes(flat, k, 1)[inside]


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits without a sign in the fewest bytes that hold all of them."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def minimizer_sizes(texts: DataFrame, k: int) -> DataFrame:
    """minimizer and n: k-mers (repeats counted) of ``texts`` (id, text), summed within slices first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, points, first in _slices(batches, k):
            least, _, _, n = _runs_of(points, first, k)
            keys, at = np.unique(least, return_inverse=True)
            sums = np.bincount(at, n, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["minimizer", "n"])

    return texts.mapInArrow(run, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))


def _packed_runs(texts: DataFrame, k: int, hot: list[int], buckets: int, waves: int, wave: int) -> DataFrame:
    """The runs of ordinary minimizers in the buckets of a wave, a row for each bucket and slice of text.

    ``ids`` has what the id of each run is above ``base`` and ``sizes`` its number of k-mers, in numbers of as many bytes as
    ``id_bytes`` and ``size_bytes`` say; ``run`` has the texts of all runs end to end.
    """
    hot = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, first in _slices(batches, k):
            least, text, at, n = _runs_of(points, first, k)
            bucket = (_mixed(least + _MIX_2) % np.uint64(buckets)).astype(np.int64)
            taken = ~np.isin(least.view(np.int64), hot) & (bucket % waves == wave)
            # Most texts have code points of one byte; runs with others are sent apart.
            high_points = np.append(0, np.cumsum(points > 255))
            wide = high_points[at + n + k - 1] > high_points[at]
            for flag in (False, True):
                chosen = np.flatnonzero(taken & (wide == flag))
                if not len(chosen):
                    continue
                # Equal minimizers side by side: equal runs compress well.
                chosen = chosen[np.lexsort((least[chosen], bucket[chosen]))]
                starts = np.flatnonzero(np.diff(bucket[chosen], prepend=-1))
                rows = np.append(starts, len(chosen))
                own, sizes = ids[text[chosen]], _narrow(n[chosen].astype(np.uint64))
                base = np.minimum.reduceat(own, starts)
                above = _narrow(own.view(np.uint64) - np.repeat(base, np.diff(rows)).view(np.uint64))
                flat, offsets = _spelled(points if flag else points.astype(np.uint8), at[chosen], n[chosen] + k - 1)
                columns = {
                    "bucket": pa.array(bucket[chosen][starts]), "wide": pa.array(np.full(len(starts), flag)), "base": pa.array(base),
                    "id_bytes": pa.array(np.full(len(starts), above.itemsize, dtype=np.int32)), "ids": _binary(above, rows),
                    "size_bytes": pa.array(np.full(len(starts), sizes.itemsize, dtype=np.int32)), "sizes": _binary(sizes, rows),
                    "run": _binary(flat, offsets[rows]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return texts.mapInArrow(run, "bucket long, wide boolean, base long, id_bytes int, ids binary, size_bytes int, sizes binary, run binary")


def _hot_postings(texts: DataFrame, k: int, hot: list[int]) -> DataFrame:
    """id, high and low of every k-mer of hot minimizers."""
    hot = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, first in _slices(batches, k):
            least, text, at, n = _runs_of(points, first, k)
            chosen = np.flatnonzero(np.isin(least.view(np.int64), hot))
            of, high, low, _ = _postings(*_kmers(*_spelled(points, at[chosen], n[chosen] + k - 1), ids[text[chosen]], k))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=["id", "high", "low"])

    return texts.mapInArrow(run, "id long, high long, low long")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about a slice of text each."""
    if batch.num_rows:
        total = np.cumsum(pc.binary_length(batch.column("run")).to_numpy())
        cuts = np.flatnonzero(np.diff(total // SLICE_POINTS, prepend=0))
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            if high > low:
                yield batch.slice(low, high - low)


def _spread_out(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, id and both hashes of every k-mer of a batch of runs."""
    found = []
    kinds = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("wide", "id_bytes", "size_bytes")]
    for flag, id_bytes, size_bytes in sorted(set(zip(*(x.tolist() for x in kinds)))):
        rows = batch.filter(pa.array((kinds[0] == flag) & (kinds[1] == id_bytes) & (kinds[2] == size_bytes)))
        above, in_row = _bytes_of(rows.column("ids"))
        above, in_row = above.view(f"u{id_bytes}").astype(np.uint64), in_row // id_bytes
        ids = (np.repeat(rows.column("base").to_numpy(), in_row).view(np.uint64) + above).view(np.int64)
        sizes = _bytes_of(rows.column("sizes"))[0].view(f"u{size_bytes}").astype(np.int64)
        flat = _bytes_of(rows.column("run"))[0].view(np.uint32 if flag else np.uint8)
        ids, high, low = _kmers(flat, np.append(0, np.cumsum(sizes + k - 1)), ids, k)
        found.append((np.repeat(np.repeat(rows.column("bucket").to_numpy(), in_row), sizes), ids, high, low))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))


def _counter(k: int, chunk_kmers: int, group_kmers: int):
    """Counts whole buckets from runs in their order, some of them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, giant = [], 0, None
        for piece in (p for batch in batches for p in _pieces(batch)):
            found = _spread_out(piece, k)
            if not len(found[0]):
                continue
            order = np.argsort(found[0], kind="stable")
            found = tuple(x[order] for x in found)
            last = found[0][-1]
            if giant is not None:
                # The bucket that was too large goes on as rows to its end.
                same = int(np.searchsorted(found[0], giant, side="right"))
                yield _single(*(x[:same] for x in found[1:]))
                if same == len(found[0]):
                    continue
                giant, found = None, tuple(x[same:] for x in found)
            held.append(found)
            n += len(found[0])
            if n >= chunk_kmers:
                whole = tuple(np.concatenate(x) for x in zip(*held))
                done = int(np.searchsorted(whole[0], last))
                if done:
                    yield counted(*(x[:done] for x in whole[1:]))
                held, n = [tuple(x[done:] for x in whole)], n - done
                if n >= group_kmers:
                    yield _single(*held[0][1:])
                    held, n, giant = [], 0, last
        if held:
            yield counted(*(np.concatenate(x) for x in list(zip(*held))[1:]))

    return run


def kmer_parts(
    texts: DataFrame, k: int = KMER_LENGTH, chunk_kmers: int = CHUNK_KMERS, group_kmers: int = GROUP_KMERS, hot_kmers: int = CHUNK_KMERS
) -> DataFrame:
    """id, class (df, mark_a, mark_b) and weight: how many distinct k-mers of a text are in exactly the texts of the class.

    ``texts`` (id LONG, text STRING) has each id once and should be a settled table; it is read twice, and once more for each wave
    and for hot minimizers. The marks are hashes over the ids of all texts with the k-mer; those of k-mers of one text alone are zero.
    A class may stand in several rows of a text. Texts without a k-mer have no row.

    Minimizers above a share of 1/MAX_HOT_KEYS of all k-mers are hot, so there are fewer than MAX_HOT_KEYS of them;
    their k-mers, and those of a bucket too large for a task's memory, are counted as rows with a salted join. Runs are shuffled
    in waves of WAVE_KMERS k-mers, and the files of one are deleted before the next one.
    """
    if not 1 <= k <= _MULTIPLIERS.shape[1]:
        raise ValueError(f"k must be between 1 and {_MULTIPLIERS.shape[1]}")
    ship_package(texts.sparkSession)
    total = texts.agg(F.sum(F.greatest(F.char_length("text") - F.lit(k - 1), F.lit(0)))).first()[0] or 0
    limit = max(hot_kmers, total // MAX_HOT_KEYS)
    hot = [r["minimizer"] for r in settle(minimizer_sizes(texts, k).where(F.col("n") > limit)).collect()]
    buckets, waves = max(MIN_BUCKETS, -(-total // BUCKET_KMERS)), max(1, -(-total // WAVE_KMERS))
    found = []
    for wave in range(waves):
        placed = _packed_runs(texts, k, hot, buckets, waves, wave).repartition("bucket").sortWithinPartitions("bucket")
        found.append(settle(placed.mapInArrow(_counter(k, chunk_kmers, group_kmers), PARTS)))
    found = together(found)
    rest = found.where("df = 0").select("id", F.struct(F.col("mark_a").alias("high"), F.col("mark_b").alias("low")).alias("kmer"))
    if hot:
        rest = rest.union(settle(_hot_postings(texts, k, hot)).select("id", F.struct("high", "low").alias("kmer")))
    return found.where("df > 0").unionByName(joined_parts(rest))


def joined_parts(postings: DataFrame) -> DataFrame:
    """The same for postings (id, kmer), with a join in place of a task's memory."""
    postings = postings.distinct()
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("id")))
    alone = F.col("df") == 1
    marks = {f"mark_{name}": F.when(alone, F.lit(0).cast("long")).otherwise(F.col(f"mark_{name}")) for name in "ab"}
    occurrence = settle(
        postings.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"), mark(1).alias("mark_a"), mark(2).alias("mark_b")).withColumns(marks)
    )
    rows = join_grouped(postings, occurrence, "kmer", "df", "id")
    return rows.groupBy("id", *CLASS).agg(F.count(F.lit(1)).alias("weight"))
