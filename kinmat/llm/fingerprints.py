"""Document fingerprints: SimHash by weighted terms, and a search for near fingerprints by permuted block tables.

A term is a word and the one after it; its weight is the number of times it occurs. Each hash of
a term votes on 128 signed bits. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.llm.frames import text_or_empty
from kinmat.session import settle

BITS = 128
#: Bits within which the registered query looks for near fingerprints.
SEARCH_RADIUS = 7
#: What stands for a null doc_id, which comes before all others.
NULL_KEY = -(1 << 63)
#: Documents that a task puts in order by itself.
ORDERED_TOGETHER = 100_000
SPACES = " \t\n\x0b\x0c\r"

# Bit i and bit i + 32 of a hash, as the low ends of two 32-bit counters in one long.
_TWO_COUNTERS = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and fp_high, fp_low of the column text; a bit is set if it is in over half the votes.

    ``keys`` must tell rows apart. Two counters share a sum, which holds for texts of up to 2^32 words. A text
    without words has the one term that is empty.
    """
    pairs = texts.select(*keys, _words(F.col("text")).alias("words")).select(*keys, "words", F.posexplode("words").alias("at", "word"))
    high = F.xxhash64("word", F.get("words", F.col("at") + 1))
    hashed = pairs.select(*keys, high.alias("high")).select(*keys, "high", F.xxhash64("high").alias("low"))
    sums = [
        F.sum(F.shiftrightunsigned(half, i).bitwiseAND(F.lit(_TWO_COUNTERS))).alias(f"{half}_{i}")
        for half in ("high", "low")
        for i in range(32)
    ]
    counted = hashed.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"))

    def bits(half: str) -> Column:
        # The highest bit first: the upper counters from 31 down, then the lower ones.
        sums = F.array(*[F.col(f"{half}_{i}") for i in reversed(range(32))])
        counts = F.concat(
            F.transform(sums, lambda s: F.shiftrightunsigned(s, 32)), F.transform(sums, lambda s: s.bitwiseAND(F.lit(_LOW)))
        )
        digits = F.transform(counts, lambda c: F.when(2 * c > F.col("n"), "1").otherwise("0"))
        return F.conv(F.array_join(digits, ""), 2, -10).cast("long")

    return counted.select(*keys, bits("high").alias("fp_high"), bits("low").alias("fp_low"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Differing bits of two fingerprints, each given by its two halves."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The cosine of the angle that the share of differing bits stands for; 0 from a right angle on, 1 if equal."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * (math.pi / BITS)))


def hex_digits(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def next_keys(keys: DataFrame) -> DataFrame:
    """k and next_k of distinct values: the next larger one, after the last the first.

    Values are dealt out by ranges, ordered within each, and the ranges are tied by their first values; there are as
    many ranges as tasks.
    """
    spark = keys.sparkSession
    parts = max(1, -(-keys.count() // ORDERED_TOGETHER))
    parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 200))
    dealt = settle(keys.repartitionByRange(parts, "k").withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("range").orderBy("k")
    firsts = dealt.groupBy("range").agg(F.min("k").alias("first"))
    # One row for each range.
    whole = Window.orderBy("range")
    tied = firsts.select(
        "range",
        F.coalesce(F.lead("first").over(whole), F.min("first").over(Window.partitionBy())).alias("after"),
    )
    return (
        dealt.withColumn("next_k", F.lead("k").over(order))
        .join(F.broadcast(tied), "range")
        .select("k", F.coalesce("next_k", "after").alias("next_k"))
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the start of the next document.

    Columns: doc_id, k, next_k, n_chars, text_hash, edited_sha256, fp_high, fp_low, edited_high, edited_low. A null text is empty, a null
    doc_id comes first in order and stays null; every row gives a row, repeated ones too. If rows share a doc_id, the
    one with the least hash of its text is the next document of others. One document is its own next one.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY).cast("long"))
    # Both joins below read the same shuffle of this table.
    keyed = docs.select(key.alias("k"), text_or_empty().alias("text"))
    longest = settle(keyed.groupBy("k").agg(F.max(F.length("text")).alias("n")))
    wanted = settle(next_keys(longest.select("k")).join(longest, "k").select("k", "next_k", F.floor(F.col("n") / 2).alias("half")))
    before = wanted.select(F.col("k").alias("before_k"), "next_k", F.col("half").cast("int").alias("half"))
    following = keyed.join(before, F.col("k") == F.col("next_k"))
    starts = following.select(
        F.col("before_k").alias("k"), F.xxhash64("text").alias("hash"), F.col("text").substr(F.lit(1), F.col("half")).alias("start")
    )
    starts = starts.groupBy("k").agg(F.min_by("start", "hash").alias("start"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("start", F.lit(1), half))
    both = (
        keyed.join(starts, "k")
        .select("k", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("*", F.xxhash64("text").alias("text_hash"), F.sha2("edited", 256).alias("edited_sha256"))
    )
    keys = ["k", "row", "n_chars", "text_hash", "edited_sha256"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    voted = votes(both.select(*keys, sides.alias("x")).select(*keys, "x.side", "x.text"), [*keys, "side"])

    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    found = voted.groupBy(*keys).agg(
        of(0, "fp_high").alias("fp_high"),
        of(0, "fp_low").alias("fp_low"),
        of(1, "fp_high").alias("edited_high"),
        of(1, "fp_low").alias("edited_low"),
    )
    own_id = F.nullif(F.col("k"), F.lit(NULL_KEY).cast("long"))
    return settle(found.drop("row").withColumn("doc_id", own_id)).join(wanted.select("k", "next_k"), "k")


def with_next(found: DataFrame) -> DataFrame:
    """Add next_high and next_low, the fingerprint of the next document, to the rows of ``edited_fingerprints``."""
    one = found.groupBy("k").agg(
        F.min_by(F.struct("fp_high", "fp_low"), "text_hash").alias("fp"),
    )
    renamed = one.select(F.col("k").alias("next_k"), F.col("fp.fp_high").alias("next_high"), F.col("fp.fp_low").alias("next_low"))
    return found.join(renamed, "next_k")


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per block, with the block moved to the front as the key: table, front, fp_high, fp_low.

    The bits are cut into one block more than ``radius``, so fingerprints within it share a block. The lower half of
    the blocks lies in one long, the rest in the other; ``radius`` must be odd.
    """
    if radius % 2 == 0 or radius > 15:
        raise ValueError("the radius must be odd and at most 15")
    each = (radius + 1) // 2
    cuts = [64 * i // each for i in range(each + 1)]
    fronts = []
    for half in ("fp_high", "fp_low"):
        for low, high in zip(cuts, cuts[1:]):
            mask = (1 << (high - low)) - 1 if high - low < 64 else -1
            fronts.append(F.shiftrightunsigned(half, low).bitwiseAND(F.lit(mask).cast("long")))
    return prints.select("fp_high", "fp_low", F.posexplode(F.array(*fronts)).alias("table", "front"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs of different fingerprints at most ``radius`` bits apart: the query's and the found one's halves, distance.

    Both tables hold distinct fingerprints as fp_high and fp_low. Candidates meet in one of the block tables; a
    pair that shares several blocks counts in the first one. Empty tables give no rows.
    """
    asked = block_tables(queries, radius).select("table", "front", F.col("fp_high").alias("query_high"), F.col("fp_low").alias("query_low"))
    tables = block_tables(prints, radius)
    ours, theirs = (F.col("query_high"), F.col("query_low")), (F.col("fp_high"), F.col("fp_low"))
    apart = distance(ours, theirs)
    each = (radius + 1) // 2
    cuts = [64 * i // each for i in range(each + 1)]
    equal = []
    for a, b in zip(ours, theirs):
        for low, high in zip(cuts, cuts[1:]):
            mask = ((1 << (high - low)) - 1) << low if high - low < 64 else -1
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            equal.append(a.bitwiseXOR(b).bitwiseAND(F.lit(signed).cast("long")) == 0)
    first = F.lit(len(equal))
    for i in reversed(range(len(equal))):
        first = F.when(equal[i], F.lit(i)).otherwise(first)
    joined = asked.join(tables, ["table", "front"])
    return joined.where((apart > 0) & (apart <= radius) & (first == F.col("table"))).select(
        "query_high", "query_low", "fp_high", "fp_low", apart.alias("distance")
    )


def near_documents(found: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """fp_high, fp_low, n_near and near_prints of the fingerprints of rows that are ``asked`` for: what is within ``radius``.

    Equal fingerprints are one class with its number of documents; n_near counts documents, the asking one too.
    near_prints lists the other classes as hexadecimal digits, in order; rows of ``found`` tell who is in a class.
    """
    classes = settle(
        found.groupBy("fp_high", "fp_low").agg(F.count(F.lit(1)).alias("n_docs"), F.max(asked.cast("int")).alias("asked"))
    )
    queries = classes.where("asked = 1")
    pairs = within_radius(queries, classes, radius)
    others = (
        pairs.join(classes.select("fp_high", "fp_low", "n_docs"), ["fp_high", "fp_low"])
        .groupBy("query_high", "query_low")
        .agg(F.sum("n_docs").alias("others"), F.sort_array(F.collect_list(hex_digits("fp_high", "fp_low"))).alias("near_prints"))
        .select(F.col("query_high").alias("fp_high"), F.col("query_low").alias("fp_low"), "others", "near_prints")
    )
    return queries.join(others, ["fp_high", "fp_low"], "left").select(
        "fp_high",
        "fp_low",
        (F.col("n_docs") + F.coalesce("others", F.lit(0))).alias("n_near"),
        F.coalesce("near_prints", F.array().cast("array<string>")).alias("near_prints"),
    )
