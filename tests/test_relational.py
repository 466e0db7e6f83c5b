import random

import pytest
from pyspark.sql import functions as F

from opinionmill.operators.relational import as_small, fits, lookup_join, number_rows, sorted_table, top_k_per_group


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_is_the_same_with_and_without_broadcast(spark, how):
    rng = random.Random(1)
    # A third of the rows share one key, some keys are null, some are unknown.
    keys = ["hot"] * 400 + [f"k{rng.randrange(150)}" for _ in range(700)] + [None] * 100
    big = spark.createDataFrame(list(enumerate(keys)), "doc_id int, word string")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(100)], "word string, v int")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "word", "v").collect()), key=repr)
    plain = rows(lookup_join(big, lookup, "word", how))
    split = rows(lookup_join(big, lookup, "word", how, max_rows=5, max_hot=10))
    assert plain == split and len(plain) >= 400


def test_top_k_per_group(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", rng.randrange(20)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id int, g string, s int")
    got = top_k_per_group(frame, ["g"], [F.desc("s"), F.col("doc_id")], 5)
    for g in "ab":
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:5]
        assert [tuple(r)[:3] for r in got.where(F.col("g") == g).orderBy("rank").collect()] == best


@pytest.mark.parametrize("partitions", [1, 9])
def test_number_rows_counts_in_order(spark, partitions):
    frame = spark.createDataFrame([(f"t{i:04d}",) for i in range(500)], "term string").repartition(partitions)
    numbered = number_rows(sorted_table(frame, "term").where("term <> 't0003'"), "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(499))
    assert [r.term for r in numbered] == sorted(r.term for r in numbered)


def test_small_tables(spark):
    frame = spark.range(10)
    assert fits(frame, 10) and not fits(frame, 9)
    assert as_small(frame, 9) is None and as_small(frame, 10).count() == 10
