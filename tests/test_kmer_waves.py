"""What k-mer counts leave on disk: runs travel packed and in waves, and tables and shuffle files go as soon as nothing reads them."""

import os
import random

from kinmat.operators import kmer_pairs
from kinmat.operators import kmer_runs as kr
from kinmat.session import _run_folder, settle


def docs(spark, n=80):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(150))
    rows = [(i * 1_000_003 - 2**40, "".join(rng.choice("abcé漢 \n") for _ in range(rng.randrange(400))) + passage * (i % 2)) for i in range(n)]
    return spark.createDataFrame([*rows, (2**62, passage), (-(2**62), passage[3:]), (7, None)], "id long, text string").repartition(2)


def classes(parts):
    found = parts.groupBy("id", *kr.CLASS).sum("weight").collect()
    return sorted(map(tuple, found))


def test_waves_give_the_same_classes(spark, monkeypatch):
    texts = settle(docs(spark))
    at_once = classes(kr.kmer_parts(texts))
    waves, packed = [], kr._packed_runs
    monkeypatch.setattr(kr, "_packed_runs", lambda *args: waves.append(args[-1]) or packed(*args))
    monkeypatch.setattr(kr, "WAVE_KMERS", 6000)
    monkeypatch.setattr(kr, "MIN_BUCKETS", 50)
    assert classes(kr.kmer_parts(texts)) == at_once and len(at_once) > 80
    assert waves == list(range(len(waves))) and len(waves) > 2


def test_runs_of_a_bucket_travel_together(spark):
    texts = docs(spark).coalesce(1)
    rows = kr._packed_runs(texts, 21, [], 8, 1, 0)
    # A row for each bucket and kind of text, where each run had one before.
    assert rows.count() == 16
    sizes = rows.selectExpr("sum(length(sizes) / size_bytes) n").first().n
    assert sizes > 1000
    parts = [kr._packed_runs(texts, 21, [], 8, 3, wave) for wave in range(3)]
    assert sorted(r.bucket for p in parts for r in p.where("wide").collect()) == list(range(8))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle" in files.apply(i).getName() for i in range(files.size()))


def test_a_settled_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    settle(spark.range(1000).repartition(4, "id").groupBy("id").count())
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_that_nothing_reads_are_deleted(spark):
    settle(spark.range(1))
    folder = _run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = kmer_pairs.kmer_neighbours(docs(spark))
    # Texts, sizes of minimizers and all classes stayed as well before.
    assert len(set(os.listdir(folder)) - before) == 3
    assert found.pairs.count() > 100 and found.members.count() == 83 and kmer_pairs.degrees(found).count() == 83
