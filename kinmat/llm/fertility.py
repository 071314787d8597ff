"""Quality rules from tokenizer fertility: what a public vocabulary makes of a text.

Characters per token, the share of byte-fallback tokens and the entropy of the tokens are measured on
whole texts. Rejection bands come from all documents of the same language (or script, where no language is
given) and of similar length, as entropy depends on length; a group of copies weighs as much as one document.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.llm.frames import map_texts
from kinmat.llm.tokens import WordMemory, piece_processor
from kinmat.session import settle

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Spreads (of a normal distribution with the same quartiles) that a measure may lie below and above its middle.
BANDS = {"entropy": (3.0, 8.0), "chars_per_token": (6.0, 8.0), "byte_share": (None, 6.0)}
#: Spreads below these count as these, so that groups of like texts reject nothing by a hair.
LEAST_SPREAD = {"entropy": 0.03, "chars_per_token": 0.02, "byte_share": 0.01}
#: Measures are compared in these steps, which makes quartiles exact sums over a short list of values.
STEP = 0.01
#: Tokens of the runs whose least hash tells groups of copies, and the weight that each group has in a cell. Sums of
#: weights hold for eight million million groups of one language.
COPY_RUN = 6
GROUP_WEIGHT = 1 << 20
#: Half octaves on either side that a cell takes in, as far as needed for this many groups; at last the whole language.
REACHES = (0, 1, 2, 1000)
LEAST_GROUPS = 20

# First code points of blocks and the script of each block, up to the next one: fixed values.
_BLOCKS = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"),
    (0x00C0, "Latin"), (0x0250, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_BOUNDS = np.array([b for b, _ in _BLOCKS[1:]], dtype=np.uint32)
_SCRIPTS = sorted({s for _, s in _BLOCKS} - {"Common"})
_SCRIPT_OF = np.array([_SCRIPTS.index(s) if s != "Common" else -1 for _, s in _BLOCKS])


def script_of(text: str) -> str:
    """The script of most letters; Common without any."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    found = _SCRIPT_OF[np.searchsorted(_BOUNDS, points, side="right")]
    counts = np.bincount(found[found >= 0], minlength=len(_SCRIPTS))
    return _SCRIPTS[int(counts.argmax())] if counts.any() else "Common"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pairs = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)[1]
    _, window, counts = np.unique(pairs[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    inside = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def least_run(ids: np.ndarray) -> int:
    """The least hash of all runs of ``COPY_RUN`` tokens, fewer tokens are one run; copies mostly share it."""
    runs = np.zeros(max(1, len(ids) - COPY_RUN + 1), dtype=np.uint64)
    for shift in range(min(COPY_RUN, len(ids))):
        part = ids[shift : shift + len(runs)].astype(np.uint64)
        runs = (runs + part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return int(runs.min().view(np.int64))


def _base(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add the base counts, base_failed, copy_group, and the fertility measures of each whole text.

    Words are encoded one by one, each with the mark of a word's beginning, and remembered. A null text has no words;
    without tokens entropy, chars_per_token and byte_share are 0. Other columns stay; those
    named like an added one are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens"]
    fields = [(n, pa.int64()) for n in names] + [("entropy", pa.float64()), ("script", pa.string())]
    fields.append(("copy_group", pa.int64()))

    def make():
        processor = piece_processor(vocabulary)
        is_byte = np.array([processor.is_byte(i) for i in range(processor.get_piece_size())])
        memory = WordMemory(lambda word: np.array(processor.encode(word), dtype="<u4").tobytes())

        def work(texts: list[str]) -> dict[str, Iterable]:
            rows = []
            for text in texts:
                words = text.encode().split()
                ids = np.frombuffer(b"".join(map(memory.__getitem__, words)), dtype="<u4")
                counts = np.bincount(ids, minlength=len(is_byte))
                share = counts[counts > 0] / max(1, len(ids))
                entropy = float(-(share * np.log2(share)).sum())
                rows.append((*_base(text, words), len(ids), int(counts[is_byte].sum()), entropy, script_of(text), least_run(ids)))
            return dict(zip([n for n, _ in fields], zip(*rows)))

        return work

    measured = map_texts(docs, "text", make, pa.schema(fields), keep)
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    return measured.withColumns(
        {
            "chars_per_token": F.col("word_chars") / tokens,
            "byte_share": F.col("n_byte_tokens") / tokens,
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        }
    )


def _grouped(measured: DataFrame, group: str | None) -> DataFrame:
    """With the group and the half octave of words that a text is compared in; words, as junk may be cut into many tokens."""
    given = F.col(group).cast("string") if group else F.lit(None).cast("string")
    half_octave = F.floor(2 * F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")
    return measured.withColumn("band_group", F.coalesce(given, F.col("script"))).withColumn("band_length", half_octave)


def _steps(name: str) -> Column:
    return F.round(F.col(name) / STEP).cast("long")


def fit_bands(measured: DataFrame, group: str | None = "lang") -> DataFrame:
    """low and high of every measure by band_group and band_length, over all documents that pass the base rules.

    Documents with one copy_group, if there is such a column, share the weight of one document. A cell with
    few groups takes in neighbouring lengths, at last the whole language or script. Documents are
    first counted by value in steps of ``STEP``, so quartiles are exact, and no group is gathered: what is
    sorted is a list of distinct values.
    """
    rows = _grouped(measured, group).where(~F.col("base_failed"))
    cell, each = ["band_group", "band_length"], F.lit(GROUP_WEIGHT)
    if "copy_group" in measured.columns:
        # Equal measures of one group are counted before they are weighed.
        values = [_steps(n).alias(n) for n in BANDS]
        rows = rows.select(*cell, "copy_group", *values).groupBy(*cell, "copy_group", *BANDS).agg(F.count(F.lit(1)).alias("n"))
        copies = rows.groupBy(*cell, "copy_group").agg(F.sum("n").alias("copies"))
        rows = rows.join(copies, [*cell, "copy_group"])
        each = F.greatest(F.expr(f"{GROUP_WEIGHT} * n div copies"), F.lit(1))
    else:
        rows = rows.select(*cell, *[_steps(n).alias(n) for n in BANDS])
    values = F.explode(F.create_map(*[x for n in BANDS for x in (F.lit(n), F.col(n))])).alias("measure", "value")
    counts = settle(
        rows.select(*cell, each.cast("long").alias("weight"), values)
        .groupBy(*cell, "measure", "value")
        .agg(F.sum("weight").alias("n"))
    )
    # Cells are as many as languages times some thirty lengths.
    cells = counts.select("band_group", F.col("band_length").alias("of_length")).distinct()
    reach = F.explode(F.array(*[F.lit(r) for r in REACHES])).alias("reach")
    wide = counts.join(cells.select("*", reach), "band_group").where(F.abs(F.col("band_length") - F.col("of_length")) <= F.col("reach"))
    sized = wide.groupBy("band_group", "of_length", "reach").agg(
        F.sum(F.when(F.col("measure") == next(iter(BANDS)), F.col("n"))).alias("weight")
    )
    enough = F.when(F.col("weight") >= LEAST_GROUPS * GROUP_WEIGHT * 0.999, F.col("reach"))
    taken = sized.groupBy("band_group", "of_length").agg(F.coalesce(F.min(enough), F.lit(max(REACHES))).alias("reach"))
    keys = [*cell, "measure"]
    counts = (
        wide.join(taken, ["band_group", "of_length", "reach"])
        .groupBy("band_group", F.col("of_length").alias("band_length"), "measure", "value")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("up_to", F.sum("n").over(order)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys))
    )

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("up_to") >= share * F.col("total"), F.col("value"))) * STEP

    fitted = running.groupBy(*keys).agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("middle"), quantile(0.75).alias("q3")
    )
    least = F.create_map(*[x for n, v in LEAST_SPREAD.items() for x in (F.lit(n), F.lit(v))])[F.col("measure")]
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, least)
    bands = fitted.withColumn("spread", spread)
    columns = []
    for name, (below, above) in BANDS.items():
        for label, limit, sign in (("low", below, -1), ("high", above, 1)):
            if limit is not None:
                edge = F.col("middle") + sign * limit * F.col("spread")
                columns.append(F.max(F.when(F.col("measure") == name, edge)).alias(f"{name}_{label}"))
    return bands.groupBy("band_group", "band_length").agg(*columns)


def judge(measured: DataFrame, group: str | None = "lang") -> DataFrame:
    """Add ``kept``: false if the base rules fail or a measure lies outside the bands of its group.

    ``measured`` should be a settled or cheap table; an empty one gives no rows. A group of which no other
    document is known rejects nothing by its bands.
    """
    bands = settle(fit_bands(measured, group))
    joined = _grouped(measured, group).join(bands, ["band_group", "band_length"], "left")
    outside = F.lit(False)
    for name, (below, above) in BANDS.items():
        value = _steps(name) * STEP
        if below is not None:
            outside = outside | F.coalesce(value < F.col(f"{name}_low") - STEP / 2, F.lit(False))
        if above is not None:
            outside = outside | F.coalesce(value > F.col(f"{name}_high") + STEP / 2, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~outside).select(
        *[c for c in measured.columns if c != "kept"], "kept"
    )
