"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Lengths are whole numbers up to the capacity, so packing is decided on the histogram of
lengths: a run of equal bins is one line of a plan whose size depends on the capacity, never on the
number of documents. Pieces then find their place by their number within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmat.llm.frames import map_texts
from kinmat.llm.tokens import word_encoder
from kinmat.session import settle

#: Pieces of one length that a task numbers by itself.
NUMBERED_TOGETHER = 20_000


def cut_documents(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then ``end_id``; only longer ones are cut. A null text is empty and gives
    the single id ``end_id``; a null doc_id stays null; repeated rows are packed each; other columns are left out.
    """
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def make():
        encode = word_encoder(vocabulary)

        def work(texts: list[str]) -> dict[str, Iterable]:
            lengths, sums, ids = [], [], []
            for text in texts:
                data = encode(text) + end
                parts = [data[i : i + step] for i in range(0, len(data), step)]
                lengths.append([len(p) // 4 for p in parts])
                sums.append([zlib.crc32(p) for p in parts])
                ids.append(parts if keep_ids else [])
            return {"lengths": lengths, "sums": sums, "ids": ids}

        return work

    added = pa.schema([("lengths", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("ids", pa.list_(pa.binary()))])
    cut = map_texts(docs, "text", make, added, keep=["doc_id"])
    columns = [
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.lit(capacity)).cast("long").alias("start"),
        F.col("length"),
        F.element_at("sums", F.col("piece") + 1).alias("ids_crc32"),
    ]
    if keep_ids:
        columns.append(F.element_at("ids", F.col("piece") + 1).alias("ids"))
    return cut.select("*", F.posexplode("lengths").alias("piece", "length")).select(*columns)


def _greedy(counts: np.ndarray, gap: int, bin_: dict[int, int]) -> int:
    """Fill a bin with the longest that fit; returns what is left of the gap."""
    present = np.flatnonzero(counts)
    while gap > 0 and present.size:
        at = int(np.searchsorted(present, gap, side="right")) - 1
        if at < 0:
            break
        length = int(present[at])
        take = min(int(counts[length]) - bin_.get(length, 0), gap // length)
        if take <= 0:
            present = present[:at]
            continue
        bin_[length] = bin_.get(length, 0) + take
        gap -= take * length
        present = present[:at]
    return gap


def _tighter_pair(counts: np.ndarray, bin_: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum within ``room``."""
    free = counts.copy()
    for length, used in bin_.items():
        free[length] -= used
    present = np.flatnonzero(free[: room + 1])
    if not present.size:
        return None
    partner = np.searchsorted(present, room - present, side="right") - 1
    same = (partner >= 0) & (present[partner] == present) & (free[present] < 2)
    partner = partner - same
    good = partner >= 0
    if not good.any():
        return None
    sums = np.where(good, present + present[partner], -1)
    best = int(sums.argmax())
    return int(present[best]), int(present[partner[best]])


def plan_bins(histogram: dict[int, int], capacity: int, two_fit: bool = True) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies by length, number of equal bins).

    A bin is filled greedily with the longest that fits. Then its shortest is replaced by the two
    unpacked ones, of any length, that fit the gap it leaves more tightly, if there are such. The bin is
    repeated while its lengths last.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan = []
    while counts.any():
        bin_: dict[int, int] = {}
        gap = _greedy(counts, capacity, bin_)
        if two_fit and gap > 0 and sum(bin_.values()) > 1:
            shortest = min(bin_)
            pair = _tighter_pair(counts, bin_, gap + shortest)
            if pair and sum(pair) > shortest:
                bin_[shortest] -= 1
                for length in pair:
                    bin_[length] = bin_.get(length, 0) + 1
                bin_ = {length: n for length, n in bin_.items() if n}
                gap += shortest - sum(pair)
                _greedy(counts, gap, bin_)
        times = min(int(counts[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            counts[length] -= n * times
        plan.append((bin_, times))
    return plan


def best_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-two-fit, or greedy filling alone where that happens to need fewer bins."""
    plans = [plan_bins(histogram, capacity, two_fit) for two_fit in (True, False)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, one after the last, copies a bin, first bin, offset) for every line of the plan."""
    used: dict[int, int] = {}
    found, first_bin = [], 0
    for bin_, times in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            copies = bin_[length]
            begin = used.get(length, 0)
            used[length] = begin + copies * times
            found.append((length, begin, used[length], copies, first_bin, offset))
            offset += copies * length
        first_bin += times
    return found


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces with doc_id, piece and length; other columns stay.

    ``pieces`` should be a settled or cheap table: it is read for the histogram, the numbering and
    the result. Only the histogram, at most ``capacity`` lines, comes to the driver. A common length
    is numbered in parts, so a third of all pieces may have the same length. No pieces give no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(best_plan(histogram, capacity))
    schema = "length long, low long, high long, copies long, first_bin long, first_offset long"
    # At most one line per length and line of the plan, and of both there are at most a few times the capacity.
    lines = spark.createDataFrame(table, schema)
    parts = max(1, -(-sum(histogram.values()) // NUMBERED_TOGETHER))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        dealt.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        dealt.withColumn("number", F.row_number().over(within) - 1)
        .join(sizes, ["length", "part"])
        .withColumn("number", F.col("number") + F.col("before"))
    )
    place = F.col("number") - F.col("low")
    return (
        numbered.join(F.broadcast(lines), "length")
        .where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
        .select(
            *pieces.columns,
            (F.col("first_bin") + F.floor(place / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + place % F.col("copies") * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack; the pieces are settled once in the shared folder."""
    return pack(settle(cut_documents(docs, vocabulary, capacity, keep_ids=keep_ids)), capacity)
