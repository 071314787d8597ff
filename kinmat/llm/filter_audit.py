"""What each filter removes, in every order in which the filters can be applied.

Documents become cells: how many of a part fail exactly the same filters. A recursive query extends
prefixes of filter orders by one unused letter at a time and carries the bits applied so far; each level of
the recursion joins the cells of the part and gives that step's counts.
"""

from __future__ import annotations

import contextlib
import math
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmat.llm.frames import map_texts
from kinmat.session import settle

LETTERS = "ABCDE"
#: Bits of the filters in a mask of failures.
BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL = re.compile("[#$%&*|]")

METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # on bytes, exactly the six plain kinds of white space split
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        BITS["A"] * (len(words) < MIN_WORDS)
        | BITS["B"] * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
        | BITS["C"] * (100 * upper > MAX_UPPER_PERCENT * len(text))
        | BITS["D"] * bool(_SYMBOL.search(text))
    )


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row.

    A null text is empty, a null source the part ''. A row fails E if its text stands under a smaller
    doc_id anywhere in the table; a row without doc_id never does, and rows that repeat a doc_id don't by
    each other. Texts are compared by 128-bit digests. The least id of a text is joined on digest and id, so copies of
    one text are spread over all tasks.
    """

    def make():
        def work(texts: list[str]) -> dict[str, Iterable]:
            digests = [xxhash.xxh3_128_intdigest(t.encode()) for t in texts]
            signed = [[(d >> s & (1 << 64) - 1) - (1 << 63) for d in digests] for s in (64, 0)]
            return {"__failed__": list(map(failures, texts)), "__high__": signed[0], "__low__": signed[1]}

        return work

    added = pa.schema([("__failed__", pa.int32()), ("__high__", pa.int64()), ("__low__", pa.int64())])
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    own = docs.select("doc_id", part.alias("part"), "text")
    measured = settle(map_texts(own, "text", make, added, keep=["doc_id", "part"]))
    digest = ["__high__", "__low__"]
    first = measured.where("doc_id IS NOT NULL").groupBy(*digest).agg(F.min("doc_id").alias("doc_id")).withColumn("__first__", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("__first__").isNull()
    failed = F.col("__failed__").bitwiseOR(F.when(later, BITS["E"]).otherwise(0))
    return measured.join(first, [*digest, "doc_id"], "left").select("doc_id", "part", failed.alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part and its cells: an array of (mask, n, good, toxic), one entry per mask that occurs.

    Several labels of one document count if any is 1; labels without a document are ignored.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )

    def total(column: str):
        return F.sum(F.coalesce(column, F.lit(0)).cast("long")).alias(column)

    counted = masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


_RECURSION = """
WITH RECURSIVE steps (part, prefix, applied, step, {names}) AS (
  SELECT part, '', 0, 0, {zeros} FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, letter), applied | bit, step + 1, {metrics}
  FROM (
    SELECT s.part, s.prefix, s.applied, s.step, f.letter, f.bit, c.cells
    FROM steps s
    JOIN {cells} c ON c.part = s.part
    LATERAL VIEW inline({filters}) f AS letter, bit
    WHERE s.applied & f.bit = 0
  )
)
SELECT part, prefix, step, right(prefix, 1) AS letter, {names} FROM steps WHERE step > 0
"""


def _sum_of(count: str, condition: str) -> str:
    return f"aggregate(cells, 0L, (total, c) -> total + IF({condition}, c.{count}, 0L))"


@contextlib.contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """A recursion's rows grow with the parts; Spark stops it at a million by default."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prefixes(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, prefix, step, letter and the counts of the last step, for every prefix of every order of the letters."""
    spark = parts.sparkSession
    removed = "c.mask & applied = 0 AND c.mask & bit != 0"
    metrics = {
        "kept": _sum_of("n", "c.mask & (applied | bit) = 0"),
        "removed": _sum_of("n", removed),
        "redundant": _sum_of("n", "c.mask & applied != 0 AND c.mask & bit != 0"),
        "unique_fails": _sum_of("n", f"c.mask & {sum(BITS[x] for x in letters)} = bit"),
        "good_lost": _sum_of("good", removed),
        "toxic_lost": _sum_of("toxic", removed),
    }
    name = f"kinmat_cells_{uuid.uuid4().hex}"
    parts.createOrReplaceTempView(name)
    filters = ", ".join(f"struct('{x}', {BITS[x]})" for x in letters)
    query = _RECURSION.format(
        names=", ".join(metrics),
        zeros=", ".join(["0L"] * len(metrics)),
        metrics=", ".join(metrics.values()),
        cells=name,
        filters=f"array({filters})",
    )
    try:
        with _any_number_of_rows(spark):
            return settle(spark.sql(query))
    finally:
        spark.catalog.dropTempView(name)


def audit(docs: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the letters; ``shapley`` is the
    sum of what the step's filter removes over all orders.

    Parts are the sources that occur; an empty table gives no rows. Extra columns are ignored.
    """
    found = prefixes(settle(cells(masks(docs), labels)), letters)
    # A prefix of k letters begins (n - k)! orders.
    begun = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shares = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * begun).cast("long").alias("shapley"))
    orders = found.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    placed = steps.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return (
        placed.join(found.drop("step"), ["part", "prefix"])
        .join(shares, ["part", "letter"])
        .select("part", "filter_order", "step", *METRICS, "shapley")
    )


def audit_sql() -> str:
    """The same rows by DuckDB: each order's steps from the masks of single documents."""
    return """
WITH read AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS body FROM documents d
), worded AS (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM read
), failed AS (
  SELECT doc_id, part,
    len(words) < 200 AS a,
    100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS c,
    regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(doc_id > least, false) AS e
  FROM worded
), marked AS (
  SELECT f.part, [f.a, f.b, f.c, f.d, f.e] AS fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM failed f LEFT JOIN (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
  ) l USING (doc_id)
), alike AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL
), letters AS (
  SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), first_failed AS (
  SELECT part, o, n, good, toxic, fails, unnest(range(1, 6)) AS step,
    coalesce(list_position(list_transform(o, lambda x: fails[x]), true), 6) AS lost_at
  FROM alike, orders
), stepped AS (
  SELECT part, o, step,
    sum(CASE WHEN lost_at > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN lost_at = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN lost_at < step AND fails[o[step]] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN lost_at = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN lost_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM first_failed GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step::INT AS step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM stepped
"""
