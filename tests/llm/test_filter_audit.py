import itertools
import random
from collections import Counter

import duckdb
import pytest

from kinmat.llm import filter_audit as fa

KEYS = ("part", "filter_order", "step", *fa.METRICS, "shapley")


def brute(docs, labels, letters="ABCDE"):
    """One order after the other, one document after the other."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    failed = []
    for doc_id, text, source in docs:
        body = text or ""
        words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in body).split(" ")
        words = [w for w in words if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in body) > 2 * len(body):
            fails.add("C")
        if any(c in "#$%&*|" for c in body):
            fails.add("D")
        if doc_id is not None and doc_id > least[body]:
            fails.add("E")
        failed.append((doc_id, source or "", fails & set(letters)))
    rows, shapley = {}, Counter()
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        for order in itertools.permutations(letters):
            left = own
            for step, letter in enumerate(order, 1):
                lost = [(d, f) for d, f in left if letter in f]
                gone = set(order[: step - 1])
                left = [(d, f) for d, f in left if letter not in f]
                shapley[part, letter] += len(lost)
                rows[part, "".join(order), step] = (
                    len(left), len(lost), sum(letter in f and bool(f & gone) for _, f in own), sum(f == {letter} for _, f in own),
                    sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost), letter,
                )
    return sorted((*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in rows.items())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    bodies = [None, "", "A B C", "a # b", "x " * 300, "x y z " * 30, "Same text", "Same text"]
    bodies += [" ".join(rng.choice("abcdeABC#") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    bodies += [f"w{i}\x1cv " * 5 for i in range(3)] + [" ".join(f"w{i}" for i in range(250))] * 20
    docs = [(i, b, rng.choice(["s0", "s1", "", None])) for i, b in enumerate(bodies)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def rows(frame):
    return sorted(tuple(r[k] for k in KEYS) for r in frame.collect())


def test_against_brute_force(spark, made):
    assert rows(fa.audit(*frames(spark, *made))) == brute(*made)


def test_sql(spark, made):
    docs, labels = frames(spark, *made)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype(object).where(lambda x: x.notna(), None))
    con.register("labels", labels.toPandas().astype({"quality": "Int64"}))
    found = con.sql(f"SELECT {', '.join(KEYS)} FROM ({fa.audit_sql()})").fetchall()
    assert sorted(found) == brute(*made)


def test_fewer_letters(spark, made):
    assert rows(fa.audit(*frames(spark, *made), letters="CAE")) == brute(*made, letters="CAE")


def test_repeated_rows_missing_ids_and_extra_columns(spark):
    docs = [(5, "t", "s"), (5, "t", "s"), (7, "t", "s"), (None, "t", "s")]
    frame, labels = frames(spark, docs, [(7, 1, 1), (7, 0, 0), (None, 1, 1)])
    found = fa.audit(frame.selectExpr("*", "1 AS mask", "2 AS part", "3 AS prefix"), labels)
    first = found.where("filter_order = 'EABCD' AND step = 1").first()
    assert (first["kept"], first["removed"], first["good_lost"], first["toxic_lost"]) == (3, 1, 1, 1)


def test_empty_table(spark):
    docs, labels = frames(spark, [], [])
    assert fa.audit(docs, labels).count() == 0


def test_row_limit_is_put_back(spark, made):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    fa.prefixes(fa.cells(fa.masks(frames(spark, *made)[0]), frames(spark, *made)[1]))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
