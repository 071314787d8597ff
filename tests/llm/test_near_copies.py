import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kinmat.llm import components, simhash_dedup

SMALL = "/root/testdata/sf0.001"


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def plain_fingerprint(text):
    words = [w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def clustered():
    """Unrelated fingerprints, chains of single flips and a dense group."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.append(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    return prints + prints[:20] + [0, 1, (1 << 64) - 1]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_components_of_fingerprints_are_exact(spark, clustered, block_rows, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(simhash_dedup.links, "__defaults__", (None, block_rows))
    monkeypatch.setattr(simhash_dedup, "BATCH_ROWS", 64)
    frame = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(clustered)], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_components(frame).collect()}
    assert got == dict(enumerate(brute_components(clustered, 2)))


def test_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, 5), (7, 4), (9, 4), (None, 7 << 40)], "doc_id long, fingerprint long")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_dedup.near_components(frame).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (9, 7)]
    assert simhash_dedup.near_components(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash_dedup.near_components(frame, radius=3, segments=3)


def test_fingerprints_of_whole_texts(spark):
    texts = ["", None, "   ", "one", "Two Words", "ÄÖ not lowered É", "a b c d", "x " * 70_000, "tie tie", "A B C\x0bD\x1cE f"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint long")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.fingerprints(docs).collect()}
    assert got == {i: signed(plain_fingerprint(t or "")) for i, t in enumerate(texts)}


def test_registered_query_against_brute_force(spark):
    from kinmat.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"] or "") for r in rows]
    labels = brute_components(prints, 2)
    expected = {r["doc_id"]: (f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, labels)}
    got = QUERIES["op1_simhash_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected


def test_star_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links += [(5, 5), (None, 4), (41, 40)]
    frame = spark.createDataFrame(links, "a long, b long")
    parent = {x: x for pair in links for x in pair if None not in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    sizes = {}
    for x in parent:
        sizes.setdefault(find(x), []).append(x)
    expected = {x: r for r, members in sizes.items() if len(members) > 1 for x in members}
    got = components.components(frame).collect()
    assert {r["node"]: r["label"] for r in got} == expected and len(got) == len(expected)
    assert components.components(frame.limit(0)).collect() == []


def edited(words, rng):
    """One word in a hundred replaced."""
    out = list(words)
    for at in range(rng.randrange(100), len(words), 100):
        out[at] = "edit%d" % rng.randrange(10**9)
    return out


def test_drop_near_copies(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 500))]
        for copy in range(1 + g % 4):
            text = words if copy == 0 else edited(words, rng)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text), "a", g))
    rows += [(900, rows[0][1], "b", 0), (0, rows[0][1], "a", 0), (None, rows[3][1], None, None), (901, "", None, 1), (902, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, bits long")
    out = simhash_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    first = {}
    for d, g in group.items():
        first[g] = min(first.get(g, d), d)
    assert sorted(kept) == sorted([*first.values(), 901])
    assert simhash_dedup.drop_near_copies(docs.limit(0)).collect() == []


def test_wide_votes_are_bits_over_half():
    hashes = np.array([xxh64_intdigest(str(i), 42) for i in range(1000)], dtype=np.uint64)
    for n in (0, 1, 2, 255, 256, 1000):
        part = hashes[:n]
        expected = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > n)
        assert int(simhash_dedup.vote(part)[0]) == expected


def test_near_copies_with_text_appended_and_long_edited_ones(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(6000)]
    rows, group = [], {}

    def add(words, g):
        group[len(rows)] = g
        rows.append((len(rows), " ".join(words)))

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(300, 600))]
        add(words, g)
        add(words + [rng.choice(vocabulary) for _ in range(round(len(words) * rng.choice([0.11, 0.16, 0.22, 0.24])))], g)
    for g in range(60, 75):  # few different words, many scattered new ones
        words = [rng.choice(vocabulary[:600]) for _ in range(3000)]
        add(words, g)
        add(["new%d" % rng.randrange(10**9) if i % 52 == 7 else w for i, w in enumerate(words)], g)
    for g in range(75, 105, 2):  # alike by less than 0.8
        words = [rng.choice(vocabulary) for _ in range(400)]
        add(words, g)
        add(words + [rng.choice(vocabulary) for _ in range(112)], g + 1)
    for d in range(0, len(rows), 2):
        a, b = (shingles(rows[k][1].split()) for k in (d, d + 1))
        assert (len(a & b) >= 0.8 * len(a | b)) == (group[d] == group[d + 1])
    kept = [r["doc_id"] for r in simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted(min(d for d in group if group[d] == g) for g in set(group.values()))


def test_a_long_chain_of_half_alike_texts_stays_linear(spark, monkeypatch):
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(10**6) for _ in range(5000 * 18 + 120)]
    compared, inner = [], simhash_dedup.undecided

    def counted(members, ties):
        found = inner(members, ties)
        compared.append(found.groupBy("family").count().selectExpr("sum(count * count)").first()[0] or 0)
        return found

    monkeypatch.setattr(simhash_dedup, "undecided", counted)
    for n in (1250, 5000):  # neighbours are alike by 0.73, by chance some pairs only meet in a table
        docs = spark.createDataFrame([(i, " ".join(words[18 * i : 18 * i + 120])) for i in range(n)], "doc_id long, text string")
        assert simhash_dedup.drop_near_copies(docs).count() == n
    assert 0 < compared[0] and compared[1] < 6 * compared[0]


def test_sums_of_weights_do_not_overflow():
    from kinmat.llm import fertility

    assert fertility.GROUP_WEIGHT * 10**12 < 2**63


def test_the_stage_gets_candidates_from_the_ring(spark):
    rng = random.Random(11)
    words = ["w%d" % rng.randrange(10**6) for _ in range(900)]
    edited = words[:]
    edited[450] = "other"
    rows = [(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join("v%d" % rng.randrange(10**6) for _ in range(900)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash_dedup.wide_fingerprints(docs, keep=["doc_id", "text"]).collect()
    # Keys of tables that no two texts share: what is found comes from segments and their chains.
    nodes = spark.createDataFrame([(r.doc_id, [100 * r.doc_id + i for i in range(20)], r.bits) for r in prints], "node long, table_keys array<long>, bits array<long>")
    links = simhash_dedup.near_copy_links(nodes, docs.withColumnRenamed("doc_id", "node")).collect()
    assert {tuple(sorted((r.a, r.b))) for r in links} == {(0, 1)}
