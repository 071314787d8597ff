"""Near-duplicate search on SimHash fingerprints with pigeonring filtering.

The bits of a fingerprint form a ring of segments. If two fingerprints differ in at most ``radius`` bits, there is a
segment from which every chain of consecutive segments stays within its proportional budget: the
first l segments together differ in at most l * radius / segments bits. With more segments than
``radius`` the first one must be equal, which is an equality join; chains then prune the pairs segment
by segment, and what is left after the whole ring is the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.llm.components import components
from kinmat.llm.frames import map_texts
from kinmat.session import settle, ship_package

#: Members of a bucket that meet in one block; larger buckets are cut into pairs of blocks.
BLOCK_ROWS = 1024
#: Rows that a task compares at a time, in many small buckets or a few blocks.
BATCH_ROWS = 20_000
#: The same where rows have their sets of shingles.
EXACT_BLOCK_ROWS, EXACT_BATCH_ROWS = 256, 1000
#: Rows with the same of these meet.
BUCKET = ("segment", "value", "low_block", "high_block")
#: Shingles whose bits are counted at a time, and those whose counts fit one byte.
VOTE_ROWS, BYTE_ROWS = 255 * 128, 255
#: Fixed values of the stage on texts: words of a shingle, and the likeness (Jaccard) from which texts are near copies.
STAGE_SHINGLE, STAGE_LIKENESS = 5, 0.8
#: Tables in which candidates meet and least hashes of shingles that make up a key there: of pairs that are alike by
#: 0.8, a share of (1 - 0.8 ** 4) ** 20, 3 in 100,000, meets in none.
TABLES, TABLE_HASHES = 20, 4
#: Longs of the fingerprint of shingles, and the radii in which a pair is surely alike by 0.8, and may be. A pair at 0.8
#: differs in 145 to 155 of 1024 bits on average, with a standard error of 12.
CHECK_LONGS, SURE_RADIUS, MAYBE_RADIUS = 16, 95, 210

#: The ring of the stage: the first longs of that fingerprint, its segments (21 or 22 bits) and the radius of its chains.
RING_LONGS, RING_SEGMENTS, RING_RADIUS = 6, 18, 48

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``size`` words, repeats included; fewer words are one run."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    last = max(1, len(words) - size + 1)
    runs = words if size == 1 else [b" ".join(words[i : i + size]) for i in range(last)]
    return np.fromiter((xxh64_intdigest(r, 42) for r in runs), dtype=np.uint64, count=last if size > 1 else len(words))


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits for every hash; the hash itself for the first turn."""
    if turn == 0:
        return hashes
    x = hashes + np.full(1, _GOLDEN) * np.uint64(turn)
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def vote(hashes: np.ndarray, longs: int = 1) -> np.ndarray:
    """The fingerprint of ``longs`` times 64 bits: a bit is set if it is in over half the hashes."""
    found = np.zeros(longs, dtype=np.uint64)
    for turn in range(longs):
        set_bits = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), VOTE_ROWS):
            part = _mixed(hashes[start : start + VOTE_ROWS], turn)
            full = np.zeros(-(-len(part) // BYTE_ROWS) * BYTE_ROWS, dtype=">u8")
            full[: len(part)] = part
            bits = np.unpackbits(full.view(np.uint8)).reshape(-1, BYTE_ROWS, 64)
            set_bits += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        found[turn] = np.packbits(2 * set_bits > len(hashes)).view(">u8")[0]
    return found


def fingerprints(docs: DataFrame, shingle: int = 3, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint``, 64 bits as a long, of each whole text.

    A text without words, null included, has fingerprint zero. Other columns stay, repeated
    rows too; a column named fingerprint is replaced.
    """

    def make():
        def work(texts: list[str]) -> dict[str, Iterable]:
            return {"fingerprint": [vote(shingle_hashes(words_of(t), shingle))[:1].view(np.int64)[0] for t in texts]}

        return work

    return map_texts(docs, column, make, pa.schema([("fingerprint", pa.int64())]), keep)


def segment_masks(longs: int, segments: int) -> list[tuple[int, int, int]]:
    """(index of the long, shift, width) of each segment; every long holds equally many."""
    if segments % longs:
        raise ValueError("segments must be a multiple of the number of longs")
    each = segments // longs
    cuts = [64 * i // each for i in range(each + 1)]
    return [(j, low, high - low) for j in range(longs) for low, high in zip(cuts, cuts[1:])]


def _segment_values(bits: str, masks: list[tuple[int, int, int]]) -> Column:
    parts = [
        F.struct(
            F.lit(i).alias("segment"),
            F.shiftrightunsigned(F.col(bits)[j], low).bitwiseAND(F.lit((1 << width) - 1)).alias("value"),
        )
        for i, (j, low, width) in enumerate(masks)
    ]
    return F.array(*parts)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of equally long lists of longs as rows of unsigned numbers."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(table.num_rows, -1)


def _spanning(
    table: pa.Table, accept: Callable[[np.ndarray, np.ndarray], np.ndarray], root: np.ndarray | None = None
) -> np.ndarray:
    """The root of every row, over pairs of a bucket or pair of blocks that ``accept`` gives the places of.

    Rows must be in the order of ``_in_order``; those with an equal ``root`` are tied from the beginning.
    """
    column = {n: table.column(n).to_numpy() for n in BUCKET}
    block = table.column("block").to_numpy()
    rows = table.num_rows
    fresh = np.ones(rows, dtype=bool)
    fresh[1:] = False
    for n in BUCKET:
        fresh[1:] |= column[n][1:] != column[n][:-1]
    starts = np.flatnonzero(fresh)
    ends = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    # In a pair of two blocks, members of the same block have met elsewhere.
    alone = column["low_block"] == column["high_block"]
    root = np.arange(rows) if root is None else root.copy()
    left = np.flatnonzero(ends - np.arange(rows) > 1)
    step = 1
    while left.size:
        right = left + step
        apart = (root[left] != root[right]) & (alone[left] | (block[left] != block[right]))
        i, j = left[apart], right[apart]
        if i.size:
            near = accept(i, j)
            i, j = i[near], j[near]
        while i.size:
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
        step += 1
        left = left[ends[left] - left > step]
    return root


def _in_order(table: pa.Table) -> pa.Table:
    names = ("node", *reversed(BUCKET))
    return table.take(pa.array(np.lexsort([table.column(n).to_numpy() for n in names])))


def _tied(node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tied = np.flatnonzero(root != np.arange(len(root)))
    return node[tied], node[root[tied]]


def _chains(masks: list[tuple[int, int, int]], radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs, given as differing bits, for the chain of segments from a given one."""
    segments = len(masks)
    index = np.array([j for j, _, _ in masks])
    mask = np.array([((1 << width) - 1) << low for _, low, width in masks], dtype=np.uint64)

    def close(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Places of the pairs, given as differing bits, that stay within every budget of the chain from ``start``."""
        at = np.arange(len(x))
        total = np.zeros(len(x), dtype=np.int64)
        for step in range(segments):
            turn = (start[at] + step) % segments
            total += np.bitwise_count(x[at, index[turn]] & mask[turn])
            good = total <= (step + 1) * radius // segments
            at, total = at[good], total[good]
            if not at.size:
                break
        return at

    return close


def _comparer(
    masks: list[tuple[int, int, int]], radius: int, check_radius: int | None
) -> Callable[[pa.Table], pa.Table]:
    """Compares the members of each bucket or pair of blocks; gives links that span what it finds."""
    close = _chains(masks, radius)

    def compare(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        segment = table.column("segment").to_numpy()
        bits = _matrix(table, "bits")
        check = _matrix(table, "check_bits") if check_radius is not None else None

        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            near = close(bits[i] ^ bits[j], segment[i])
            if check is not None and near.size:
                near = near[np.bitwise_count(check[i[near]] ^ check[j[near]]).sum(axis=1) <= check_radius]
            return near

        a, b = _tied(table.column("node").to_numpy(), _spanning(table, accept))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _members(keys: DataFrame, nodes: DataFrame, block_rows: int, batch_rows: int | None = None) -> DataFrame:
    """``nodes`` in every bucket (segment, value) of ``keys`` that has others, once for each pair of blocks; with batch."""
    sizes = settle(keys.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    work = sizes.agg(F.sum(F.col("n") * blocks).alias("rows")).first()["rows"] or 0
    batches = max(1, -(-work // (batch_rows or BATCH_ROWS)))
    return (
        keys.join(sizes, ["segment", "value"])
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low_block", F.least("block", "other"))
        .withColumn("high_block", F.greatest("block", "other"))
        .drop("n", "other")
        .join(nodes, "node")
        .withColumn("batch", F.pmod(F.xxhash64(*BUCKET), F.lit(batches)))
    )


def links(
    nodes: DataFrame,
    radius: int,
    segments: int,
    check_radius: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Links (a, b) that connect all nodes whose ``bits`` differ in at most ``radius`` places.

    ``nodes`` has node (long, unique), bits (array of longs) and, if ``check_radius`` is given, check_bits, in which
    linked nodes must differ in at most that many places. Not every link within the radius is
    listed, but every one has its ends in one component of those that are. With more segments than
    ``radius`` none is lost; with fewer, those without one equal segment are. Buckets of
    any size are cut into pairs of blocks of ``block_rows``, so tasks are bounded and a bucket with a third of
    all nodes is spread. No nodes give no links. ``nodes`` should be a settled or cheap table.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    first = nodes.select(F.size("bits").alias("n")).first()
    longs = first["n"] if first else 1
    masks = segment_masks(longs, segments)
    keys = nodes.select("node", F.explode(_segment_values("bits", masks)).alias("key")).select("node", "key.*")
    members = _members(keys, nodes, block_rows)
    return members.groupBy("batch").applyInArrow(_comparer(masks, radius, check_radius), "a long, b long")


def near_components(fingerprinted: DataFrame, radius: int = 2, segments: int = 3) -> DataFrame:
    """Add ``component_id``: the smallest doc_id reachable over fingerprints at most ``radius`` bits apart.

    Equal fingerprints are one node, however many documents have them. Rows with a null doc_id take part;
    a component with no other rows has a null component_id. ``fingerprinted`` should be a
    settled or cheap table with doc_id and fingerprint (long).
    """
    if segments <= radius:
        raise ValueError("an exact search needs more segments than the radius")
    classes = settle(fingerprinted.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    nodes = classes.select(F.col("fingerprint").alias("node"), F.array("fingerprint").alias("bits"))
    found = settle(components(links(nodes, radius, segments)))
    joined = classes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("label", "fingerprint").alias("label")
    )
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    table = joined.join(least, "label").select("fingerprint", "component_id")
    return fingerprinted.drop("component_id").join(table, "fingerprint")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each table from the least of the hashes under ``TABLE_HASHES`` orders; equal sets have equal keys."""
    least = np.full(TABLES * TABLE_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    orders = _mixed(np.arange(1, len(least) + 1, dtype=np.uint64), 1) | np.uint64(1)
    for start in range(0, len(hashes), VOTE_ROWS):
        np.minimum(least, (hashes[start : start + VOTE_ROWS, None] * orders).min(axis=0), out=least)
    keys = np.zeros(TABLES, dtype=np.uint64)
    for part in least.reshape(TABLES, TABLE_HASHES).T:
        keys = _mixed(keys ^ part, 1)
    return keys


def wide_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add table_keys and bits, both of a text's different shingles of five words, as arrays of longs."""

    def make():
        def work(texts: list[str]) -> dict[str, Iterable]:
            keys, bits = [], []
            for text in texts:
                hashes = np.unique(shingle_hashes(words_of(text), STAGE_SHINGLE))
                keys.append(table_keys(hashes).view(np.int64))
                bits.append(vote(hashes, CHECK_LONGS).view(np.int64))
            return {"table_keys": keys, "bits": bits}

        return work

    fields = [("table_keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
    return map_texts(docs, "text", make, pa.schema(fields), keep)


def shingle_sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add shingles: the hashes of a text's different shingles of five words, in order."""

    def make():
        def work(texts: list[str]) -> dict[str, Iterable]:
            return {"shingles": [np.unique(shingle_hashes(words_of(t), STAGE_SHINGLE)).view(np.int64) for t in texts]}

        return work

    return map_texts(docs, "text", make, pa.schema([("shingles", pa.list_(pa.int64()))]), keep)


def _stage_comparer(table: pa.Table) -> pa.Table:
    """Links that span the surely alike of each bucket, and the members of its groups that only may be alike.

    A group (``family``) is what is connected within the wider radius in this bucket; families whose
    members are all tied for sure are left out.
    """
    table = _in_order(table)
    bits, node = _matrix(table, "bits"), table.column("node").to_numpy()

    segment = table.column("segment").to_numpy()
    close = _chains(segment_masks(RING_LONGS, RING_SEGMENTS), RING_RADIUS)

    def within(radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            # Members of a segment of the ring go along its chain first; those of a table have no chain.
            ring = segment[i] < RING_SEGMENTS
            at, chained = np.flatnonzero(~ring), np.flatnonzero(ring)
            if chained.size:
                at = np.sort(np.append(at, chained[close(bits[i[chained]] ^ bits[j[chained]], segment[i[chained]])]))
            return at[np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1) <= radius]

        return accept

    sure = _spanning(table, within(SURE_RADIUS))
    maybe = _spanning(table, within(MAYBE_RADIUS), sure)
    open_ = np.zeros(len(node), dtype=bool)
    open_[maybe[sure != maybe]] = True
    members = np.flatnonzero(open_[maybe])
    family = np.zeros(len(node), dtype=np.uint64)
    for name in (*BUCKET, "node"):
        value = table.column(name).to_numpy().astype(np.int64).view(np.uint64)
        family = _mixed(family ^ (value[maybe] if name == "node" else value), 1)
    a, b = _tied(node, sure)
    return pa.table(
        {
            "a": pa.array(np.concatenate([a, node[members]]), pa.int64()),
            "b": pa.array(np.concatenate([b, node[members]]), pa.int64()),
            "family": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(family[members].view(np.int64), pa.int64())]),
        }
    )


def _exact_comparer(table: pa.Table) -> pa.Table:
    """Links that span those of a bucket whose sets of shingles are alike by 0.8, where they are not tied for sure."""
    table = _in_order(table)
    bits, node, label = _matrix(table, "bits"), table.column("node").to_numpy(), table.column("sure_label").to_numpy()
    listed = table.column("shingles").combine_chunks()
    ends, flat = listed.offsets.to_numpy(), listed.values.to_numpy(zero_copy_only=False)

    def alike(i: int, j: int) -> bool:
        a, b = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
        if min(len(a), len(b)) < STAGE_LIKENESS * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and both >= STAGE_LIKENESS * (len(a) + len(b) - both) - 1e-9

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= MAYBE_RADIUS)
        return np.array([k for k in near if alike(i[k], j[k])], dtype=np.int64)

    bucket = np.array([table.column(n).to_numpy() for n in BUCKET])
    _, first = np.unique(np.vstack([bucket, label[None]]), axis=1, return_inverse=True)
    least = np.full(first.max(initial=0) + 1, len(node))
    np.minimum.at(least, first.ravel(), np.arange(len(node)))
    a, b = _tied(node, _spanning(table, accept, least[first.ravel()]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def undecided(members: DataFrame, ties: DataFrame) -> DataFrame:
    """family, node and sure_label of the families (family, node) that are not one group for sure; one of each set of nodes.

    ``ties`` has node and label of those that are tied for sure. The same nodes mostly meet in several tables; they are
    kept as one family. A family is what one bucket has found alike, so a long chain of texts
    that are each like the next one is many small families.
    """
    labels = ties.select("node", F.col("label").alias("sure_label"))
    placed = settle(members.join(labels, "node", "left").withColumn("sure_label", F.coalesce("sure_label", "node")))
    hashed = F.xxhash64("node")
    sized = placed.groupBy("family").agg(
        F.min("sure_label").alias("x"), F.max("sure_label").alias("y"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(hashed).alias("mark_a"), F.bit_xor(F.xxhash64(F.lit("second"), "node")).alias("mark_b"),
    )
    once = sized.where("x != y").groupBy("n", "mark_a", "mark_b").agg(F.min("family").alias("family"))
    return placed.join(once.select("family"), "family", "left_semi").select("family", "node", "sure_label")


def near_copy_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes whose texts' shingles are alike by 0.8 or more, as far as a table has both.

    ``nodes`` has node, table_keys and bits and ``texts`` node and text, once each. Candidates are those that the ring of segments
    finds, pruned along its chains, and, as it loses copies with much text appended, those with an equal key of a table. Within a bucket, pairs in the sure radius are
    linked. Of those that only may be alike there, and are not connected for sure already, members are compared by their
    sets of shingles, in pairs of blocks; texts that meet in no bucket are never compared, however they hang together. So
    only links that span groups are written, and the sets of few texts. No nodes give no links.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    ring = _segment_values("bits", segment_masks(RING_LONGS, RING_SEGMENTS))
    tables = F.transform("table_keys", lambda x, i: F.struct((i + RING_SEGMENTS).alias("segment"), x.alias("value")))
    keys = nodes.select("node", F.explode(F.concat(ring, tables)).alias("key")).select("node", "key.*")
    members = _members(keys, nodes.select("node", "bits"), BLOCK_ROWS)
    found = settle(members.groupBy("batch").applyInArrow(_stage_comparer, "a long, b long, family long"))
    sure = found.where("family IS NULL").select("a", "b")
    maybe = found.where("family IS NOT NULL").select("family", F.col("a").alias("node"))
    if not maybe.head(1):
        return sure
    open_ = settle(undecided(maybe, settle(components(sure))))
    each = open_.select("node", "sure_label").distinct()
    once = texts.join(each.select("node"), "node", "left_semi").dropDuplicates(["node"])
    full = settle(each.join(nodes.select("node", "bits"), "node").join(shingle_sets(once, ["node"]), "node"))
    groups = open_.select("node", F.lit(0).alias("segment"), F.col("family").alias("value"))
    exact = _members(groups, full, EXACT_BLOCK_ROWS, EXACT_BATCH_ROWS).groupBy("batch")
    return sure.union(exact.applyInArrow(_exact_comparer, "a long, b long"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest doc_id.

    Texts whose shingles of five words are alike by 0.8 or more are near copies; a group is what is
    reachable over near copies. Candidates come from the ring of segments of their fingerprints, and besides it from twenty tables
    whose keys are made of least hashes of shingles, for copies with much text appended. Pairs within the sure radius of the fingerprint of their shingles are alike, others are compared
    by their shingles (``near_copy_links``). Equal texts (by two hashes of 64 bits) are one class
    throughout. Columns stay. Of repeated rows one stays; null and empty texts are copies of each other; a null doc_id comes
    last. An empty table gives no rows.
    """
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    body, identity = F.coalesce("text", F.lit("")), ["__key__", "__high__", "__low__"]
    keyed = docs.withColumns({"__key__": last, "__high__": F.xxhash64(body), "__low__": F.xxhash64(F.lit("second"), body)})
    prints = settle(wide_fingerprints(keyed, keep=identity))
    classes = prints.groupBy("__high__", "__low__").agg(
        F.min("__key__").alias("__key__"), F.min("table_keys").alias("table_keys"), F.min("bits").alias("bits")
    )
    # Settled, so that each class keeps its number.
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    texts = keyed.select(*identity, "text").join(nodes.select(*identity, "node"), identity).select("node", "text")
    found = components(near_copy_links(nodes, texts))
    labelled = nodes.select("node", *identity).join(found, "node", "left")
    kept = (
        labelled.groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min(F.struct(*identity)).alias("one"))
        .select("one.*")
    )
    once = Window.partitionBy(*identity).orderBy(F.lit(0))
    return (
        keyed.join(kept, identity, "left_semi")
        .withColumn("__copy__", F.row_number().over(once))
        .where("__copy__ = 1")
        .select(*docs.columns)
    )
