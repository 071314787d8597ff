"""Exact pairwise k-mer intersections of a text collection (SIM-12 at scale).

Three lossless reductions come before any pair is formed. Identical texts are
one representative. K-mers are counted from runs of text (``kmer_runs``). Those that occur in exactly the same texts are one class with a
weight; those of a single text are dropped. A pair that exists must share a
class outside the most frequent tail of both texts, so only those classes
produce candidates, and a passage in a third of the texts produces none
unless it makes up a tenth of the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmat.constants import EXIST_FRACTION, KMER_LENGTH, PAIR_GROUP_ROWS
from kinmat.functions.kmers import exploded
from kinmat.operators.kmer_runs import CLASS, joined_parts, kmer_parts
from kinmat.operators.skew import join_grouped
from kinmat.session import discard, settle, settled_apart, ship_package, spread

#: Entries of class lists that a task holds of one block of texts, and those that it compares at a time; pairs formed at a
#: time are a quarter of the square of PAIR_GROUP_ROWS.
BLOCK_ENTRIES, COMPARED_ENTRIES = 4 << 20, 1 << 20


@dataclass(frozen=True)
class KmerNeighbours:
    """``pairs`` (id_a < id_b, size_a, size_b, copies_a, copies_b, inter, jaccard)
    between representatives; ``members`` (id, rep_id, copies, size) of all texts;
    ``links`` (rep_id, n_rows, n): texts that a representative is linked to, in parts that add up, ``n_rows`` its copies.
    Pairs and links are computed when read, links without a pair being kept."""

    pairs: DataFrame
    members: DataFrame
    links: DataFrame


def copy_groups(docs: DataFrame) -> DataFrame:
    """(id, rep_id, copies): every text with the smallest id of the same text."""
    keyed = settle(docs.select("id", F.sha2("text", 256).alias("digest")))
    groups = keyed.groupBy("digest").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
    repeated = settle(groups.where("copies > 1"))
    return join_grouped(keyed, repeated, "digest", "copies", "id", "left").select(
        "id", F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def shared_classes(sets: DataFrame) -> DataFrame:
    """(id, size, df, mark_a, mark_b, weight) for k-mers in two texts or more, of complete sets (id, size, kmers).

    The marks are two 64-bit hashes over the ids of all texts with the k-mer;
    equal marks and counts mean the same texts.
    """
    hashed = F.struct(F.xxhash64("kmer").alias("high"), F.xxhash64(F.lit(1), F.col("kmer")).alias("low"))
    parts = joined_parts(exploded(sets.select("id", "kmers")).select("id", hashed.alias("kmer")))
    return run_classes(parts, sets.select("id", "size"))


def run_classes(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from the classes of ``kmer_parts`` and (id, size)."""
    shared = parts.where("df > 1").groupBy("id", *CLASS).agg(F.sum("weight").alias("weight"))
    return shared.join(sizes, "id").select("id", "size", *CLASS, "weight")


class _Lists:
    """Class lists of the texts of a tile end to end, by side and ascending id; classes as numbers from 0 on. No list is empty."""

    def __init__(self, batches: list[pa.RecordBatch], formed: int, compared: int):
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, [("side", "ascending"), ("id", "ascending")]))
        self.formed, self.compared = formed, compared
        self.ids, self.copies, self.sizes, side = (table.column(c).to_numpy() for c in ("id", "copies", "size", "side"))
        self.first = np.searchsorted(side, [0, 1, 2])
        keys, weights = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "weights"))
        entries = pc.list_value_length(table.column("keys")).to_numpy()
        self.ends = np.append(0, np.cumsum(entries))
        known, self.codes = np.unique(keys, return_inverse=True)
        self.codes, self.weights, self.classes = self.codes.astype(np.int32), weights, len(known)
        self.owner = np.repeat(np.arange(len(self.ids)), entries)
        up_to = np.append(0, np.cumsum(weights, dtype=np.int64))
        #: What a text has of its most frequent classes up to this one.
        self.tail = up_to[1:] - up_to[self.ends[:-1]][self.owner]

    def _prefix(self, side: int, factor: int) -> np.ndarray:
        """Entries of a side at which a text has more than 1 / factor of its k-mers in more frequent classes and this one."""
        own = slice(*self.ends[self.first[side : side + 2]])
        return own.start + np.flatnonzero(factor * self.tail[own] > self.sizes[self.owner[own]])

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the smaller and the larger text of candidate pairs, each pair once; pairs of one larger text follow each other."""
        both = self.first[1] < self.first[2]
        for small, large in ((0, 1), (1, 0)) if both else ((0, 0),):
            posted = self._prefix(small, 10)
            posted = posted[np.argsort(self.codes[posted], kind="stable")]
            number = np.bincount(self.codes[posted], minlength=self.classes)
            begin = np.cumsum(number) - number
            entries = self._prefix(large, 19)
            entries = entries[number[self.codes[entries]] > 0]
            yield from self._met(entries, posted, number[self.codes[entries]], begin[self.codes[entries]])

    def _met(self, entries: np.ndarray, posted: np.ndarray, number: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of each entry's text with those posted for its class, as many at a time as may be formed."""
        texts, rest = len(self.ids), np.zeros(0, dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(number) // self.formed, prepend=0))
        for low, high in zip([0, *cuts], [*cuts, len(entries)]):
            if high == low:
                continue
            n = number[low:high]
            starts = np.cumsum(n) - n
            other = posted[np.arange(n.sum()) + np.repeat(begin[low:high] - starts, n)]
            entry = np.repeat(entries[low:high], n)
            left, right = self.owner[other], self.owner[entry]
            small, large = self.sizes[left].astype(np.int64), self.sizes[right].astype(np.int64)
            ordered = (small < large) | ((small == large) & (self.ids[left] < self.ids[right]))
            enough = 20 * np.minimum(self.tail[other], self.tail[entry]) > small + large
            keep = ordered & (large < 19 * small) & enough
            found = np.unique(np.append(rest, right[keep] * texts + left[keep]))
            # The classes of the last text may go on in the next round.
            done = np.searchsorted(found, self.owner[entries[high - 1]] * texts) if high < len(entries) else len(found)
            found, rest = found[:done], found[done:]
            if len(found):
                yield found % texts, found // texts

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The weight of the classes that the lists at both places have, for each pair; pairs of one ``right`` follow each other."""
        sizes = np.diff(self.ends)[left]
        total, sums = np.cumsum(sizes), np.zeros(len(left), dtype=np.int64)
        weight_of = np.zeros(self.classes, dtype=np.int32)
        cuts = np.flatnonzero(np.diff(total // self.compared, prepend=0))
        for low, high in zip([0, *cuts], [*cuts, len(left)]):
            if high == low:
                continue
            # The lists of all left ends, end to end; those that meet the same right end are looked up in it together.
            starts = np.append(0, np.cumsum(sizes[low:high]))
            at = np.arange(starts[-1]) + np.repeat(self.ends[left[low:high]] - starts[:-1], sizes[low:high])
            found = self.codes[at]
            fresh = np.flatnonzero(np.diff(right[low:high], prepend=-1))
            for first, last in zip(fresh, [*fresh[1:], high - low]):
                own = slice(*self.ends[right[low + first] + np.arange(2)])
                weight_of[self.codes[own]] = self.weights[own]
                part = slice(starts[first], starts[last])
                found[part] = weight_of[found[part]]
                weight_of[self.codes[own]] = 0
            sums[low:high] = np.add.reduceat(found, starts[:-1], dtype=np.int64)
        return sums

    def existing(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of both texts and the k-mers that both have, of pairs that exist."""
        for left, right in self.candidates():
            inter = self.shared(left, right)
            total = self.sizes[left].astype(np.int64) + self.sizes[right]
            exists = inter.astype(np.float64) > EXIST_FRACTION * total.astype(np.float64)
            yield left[exists], right[exists], inter[exists]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


class _Candidates:
    """Every candidate pair of a tile as a row."""

    schema = "small long, large long, small_size int, large_size int"

    @staticmethod
    def of(lists: _Lists) -> Iterator[pa.RecordBatch]:
        for left, right in lists.candidates():
            yield _batch(small=lists.ids[left], large=lists.ids[right], small_size=lists.sizes[left], large_size=lists.sizes[right])


class _Pairs:
    """Every existing pair of a tile as a row."""

    schema = f"{_Candidates.schema}, small_copies long, large_copies long, inter long"

    @staticmethod
    def of(lists: _Lists) -> Iterator[pa.RecordBatch]:
        for left, right, inter in lists.existing():
            yield _batch(
                small=lists.ids[left], large=lists.ids[right], small_size=lists.sizes[left], large_size=lists.sizes[right],
                small_copies=lists.copies[left], large_copies=lists.copies[right], inter=inter,
            )


class _Links:
    """How many texts each text of a tile is linked to there; no pair leaves the task."""

    schema = "rep_id long, n_rows long, n long"

    @staticmethod
    def of(lists: _Lists) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(lists.ids), dtype=np.int64)
        for left, right, _ in lists.existing():
            for own, other in ((left, right), (right, left)):
                # Whole numbers below 2 ** 53 are exact.
                sums += np.bincount(own, lists.copies[other], len(sums)).astype(np.int64)
        linked = np.flatnonzero(sums)
        yield _batch(rep_id=lists.ids[linked], n_rows=lists.copies[linked], n=sums[linked])


def _in_tiles(classes: DataFrame, reps: DataFrame | None, result: type[_Candidates] | type[_Pairs] | type[_Links]) -> DataFrame:
    """What the tiles of any two blocks of texts give, from the texts' classes (id, size, df, marks, weight) and copies (id, copies).

    Texts are dealt into blocks; the tile of two blocks gets their class lists once, and pairs are formed and counted in
    it. So class lists are all that is shuffled, once for each block, and no candidate. Classes of two lists are compared by
    one 64-bit hash of df and marks. Rows of one id count once.
    """
    spark = classes.sparkSession
    ship_package(spark)
    by_cores = int((2 * spark.sparkContext.defaultParallelism) ** 0.5) + 1
    blocks = max(by_cores, -(-classes.count() // BLOCK_ENTRIES))
    formed, compared = max(1, PAIR_GROUP_ROWS**2 // 4), COMPARED_ENTRIES
    # The most frequent class comes first, in the same order for every text.
    entry = F.struct("df", F.xxhash64(*CLASS).alias("key"), F.col("weight").cast("int").alias("weight"))
    lists = classes.groupBy("id").agg(F.max("size").cast("int").alias("size"), F.sort_array(F.collect_set(entry), asc=False).alias("list"))
    if reps is None:
        lists = lists.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        lists = lists.join(reps.dropDuplicates(["id"]), "id")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    placed = lists.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), other).select(
        F.least("block", "other").alias("tile_row"), F.greatest("block", "other").alias("tile_col"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "size", "copies",
        F.col("list.key").alias("keys"), F.col("list.weight").alias("weights"),
    )

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from result.of(_Lists(list(batches), formed, compared))

    tile = ("tile_row", "tile_col")
    return placed.repartition(blocks * (blocks + 1), *tile).groupBy(*tile).applyInArrow(run, result.schema)


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (small, large, small_size, large_size) that share a class in the prefix of both.

    Existence needs 20 * inter > a + b. For the smaller text that is
    10 * inter > a, for the larger one 19 * inter > b. Where the most frequent
    classes up to some class weigh no more than that, a pair cannot
    have its rarest shared class there. Nor can it where either text has fewer k-mers up to that class than the sizes of
    both ask for, as a pair shares nothing rarer than its rarest shared class.
    """
    return _in_tiles(classes, None, _Candidates)


def kmer_neighbours(docs: DataFrame, k: int = KMER_LENGTH) -> KmerNeighbours:
    """All existing pairs of ``docs`` (id LONG, text STRING) with exact counts."""
    spark = docs.sparkSession
    groups = settled_apart(spark, lambda: copy_groups(docs))
    reps = groups.where("id = rep_id").select("id", "copies")
    # Distinct texts are kept, not their k-mers, which are some thirty times larger.
    texts = settle(spread(docs.join(reps, "id", "left_semi").select("id", "text"), "id"))
    parts = settled_apart(spark, lambda: kmer_parts(texts, k))
    counted = parts.groupBy("id").agg(F.sum("weight").alias("size"))
    known = settle(texts.select("id").join(counted, "id", "left").select("id", F.coalesce("size", F.lit(0)).cast("int").alias("size")))
    classes = settle(run_classes(parts, known))
    for table in (texts, parts):
        discard(table)
    counted = _in_tiles(classes, reps, _Pairs)
    flip = F.col("small") > F.col("large")
    a_first = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    union = (F.col("small_size") + F.col("large_size") - F.col("inter")).cast("double")
    pairs = counted.select(
        a_first("small", "large").alias("id_a"),
        a_first("large", "small").alias("id_b"),
        a_first("small_size", "large_size").alias("size_a"),
        a_first("large_size", "small_size").alias("size_b"),
        "inter",
        (F.col("inter").cast("double") / union).alias("jaccard"),
        a_first("small_copies", "large_copies").alias("copies_a"),
        a_first("large_copies", "small_copies").alias("copies_b"),
    )
    sizes = known.withColumnRenamed("id", "rep_id")
    sizes = sizes.join(reps.toDF("rep_id", "n_rows"), "rep_id")
    members = join_grouped(groups, sizes, "rep_id", "n_rows", "id").select("id", "rep_id", "copies", "size")
    return KmerNeighbours(pairs, members, _in_tiles(classes, reps, _Links))


def degrees(found: KmerNeighbours) -> DataFrame:
    """(id, degree) of every text, copies counted but never paired up. Pairs are summed in tiles and not written out."""
    others = settle(found.links.groupBy("rep_id", "n_rows").agg(F.sum("n").alias("others")))
    own = F.when(F.col("size") > 0, F.col("copies") - 1).otherwise(0)
    return join_grouped(found.members, others, "rep_id", "n_rows", "id", "left").select(
        "id", (F.coalesce("others", F.lit(0)) + own).alias("degree")
    )


def lookup_pairs(found: KmerNeighbours, wanted: DataFrame) -> DataFrame:
    """J-13: (id, partner, jaccard) of wanted (id, partner) that exist."""
    reps = found.members.select("id", "rep_id", "size")
    named = (
        wanted.join(reps.toDF("id", "rep", "size"), "id")
        .join(reps.select(F.col("id").alias("partner"), F.col("rep_id").alias("partner_rep")), "partner")
        .withColumns({"id_a": F.least("rep", "partner_rep"), "id_b": F.greatest("rep", "partner_rep")})
    )
    copies = (F.col("id_a") == F.col("id_b")) & (F.col("size") > 0) & (F.col("id") != F.col("partner"))
    return (
        named.join(found.pairs.select("id_a", "id_b", "jaccard"), ["id_a", "id_b"], "left")
        .withColumn("jaccard", F.when(copies, 1.0).otherwise(F.col("jaccard")))
        .where("jaccard is not null")
        .select("id", "partner", "jaccard")
    )
