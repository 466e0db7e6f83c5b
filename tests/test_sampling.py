import hashlib
import math
from collections import Counter

import pytest

from opinionmill.operators import sampling


def frame(spark, sizes, partitions=4):
    rows, i = [], 0
    for label, size in sizes.items():
        for _ in range(size):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, label int").repartition(partitions)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_exact_size_and_shares(spark):
    sizes = {0: 500, 1: 300, 2: 201}
    got = sampling.stratified_sample(frame(spark, sizes), 333).collect()
    counts = Counter(r.label for r in got)
    assert len(got) == 333 == len({r.doc_id for r in got})
    for label, size in sizes.items():
        assert abs(counts[label] - 333 * size / 1001) < 1


def test_remainder_seats(spark):
    counts = Counter(r.label for r in sampling.stratified_sample(frame(spark, {0: 50, 1: 30, 2: 20}), 7).collect())
    assert counts == {0: 4, 1: 2, 2: 1}  # 3.5, 2.1, 1.4: the seat goes to the largest fraction


def test_rows_are_those_with_the_smallest_keys(spark):
    got = ids(sampling.sample_n(frame(spark, {0: 400}), 57))
    key = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    assert got == sorted(sorted(range(400), key=key)[:57])
    assert ids(sampling.sample_n(frame(spark, {0: 40}), 40)) == list(range(40))


def test_partitioning_does_not_matter_but_the_seed_does(spark):
    runs = [ids(sampling.stratified_sample(frame(spark, {0: 300, 1: 90}, n), 100)) for n in (1, 7, 32)]
    assert runs[0] == runs[1] == runs[2]
    assert ids(sampling.stratified_sample(frame(spark, {0: 300, 1: 90}), 100, seed=7)) != runs[0]


def test_split_is_disjoint_complete_and_stratified(spark):
    sizes = {0: 403, 1: 101}
    rows = sampling.stratified_split(frame(spark, sizes)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(504))
    by_split = Counter(r.split for r in rows)
    held = math.ceil(0.2 * 504)
    assert by_split == {"train": 504 - held, "val": held - math.ceil(held / 2), "test": math.ceil(held / 2)}
    for split, size in by_split.items():
        positive = sum(r.label for r in rows if r.split == split)
        assert abs(positive - size * 101 / 504) <= 1


def test_under_sample(spark):
    counts = Counter(r.label for r in sampling.under_sample(frame(spark, {0: 90, 1: 12, 2: 40})).collect())
    assert counts == {0: 12, 1: 12, 2: 12}


def test_several_strata_with_nulls(spark):
    rows = [(i, "en" if i % 2 else None, i % 5 == 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, flag boolean")
    got = sampling.stratified_sample(docs, 100, ["lang", "flag"]).collect()
    assert len(got) == 100 and Counter((r.lang, r.flag) for r in got) == {
        ("en", False): 40, ("en", True): 10, (None, False): 40, (None, True): 10
    }


@pytest.mark.parametrize("sizes, n", [({0: 5, 1: 5}, 10), ({0: 9, 1: 1}, 5), ({0: 5, 1: 5, 2: 5}, 2)])
def test_impossible_samples(spark, sizes, n):
    with pytest.raises(ValueError):
        sampling.stratified_sample(frame(spark, sizes), n)


def test_documents_are_not_shuffled(spark):
    docs = frame(spark, {0: 300, 1: 90}, 3).selectExpr("*", "repeat('x', 50) AS review").write
    docs.mode("overwrite").parquet(path := _folder())
    plan = sampling.stratified_sample(spark.read.parquet(path), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "CartesianProduct" not in plan


def _folder():
    import tempfile

    return tempfile.mkdtemp(prefix="run-") + "/docs"


def test_fraction_sample(spark):
    got = Counter(r.label for r in sampling.fraction_sample(frame(spark, {0: 1000, 1: 1000}), {0: 0.5, 1: 0.1}).collect())
    assert 400 < got[0] < 600 and 50 < got[1] < 160
