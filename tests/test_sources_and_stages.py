import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from opinionmill.operators.lexicon import polarity
from opinionmill.plans import stages
from opinionmill.sources import metric_sets, reviews, tables
from opinionmill.streaming import documents


def folder():
    return tempfile.mkdtemp(prefix="run-")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as handle:
        handle.write(text)
    return path


def test_review_files(spark):
    root = folder()
    text = '"2","Great ""thing""","first, second"\n"1","","bad\nnews"\n"x","t","broken"\n'
    path = write(f"{root}/deep/er/train.csv", text)
    found = reviews.locate_reviews(spark, root)
    assert found.endswith("/deep/er/train.csv")
    frame = reviews.read_reviews(spark, found, keep_corrupt=True)
    rows = frame.orderBy(F.desc("polarity")).collect()
    assert (rows[0].title, rows[0].text, rows[1].text) == ('Great "thing"', "first, second", "bad\nnews")
    assert tuple(reviews.corrupt_count(frame).first()) == (3, 1)
    write(f"{root}/corpus/train.csv", text)
    assert reviews.locate_reviews(spark, root, folders=["corpus"]).endswith("/corpus/train.csv")
    with pytest.raises(FileNotFoundError):
        reviews.locate_reviews(spark, root, "other.csv")
    with pytest.raises(FileNotFoundError):
        reviews.locate_reviews(spark, f"{root}/missing")


def test_records_over_split_borders(spark):
    import csv
    import random

    rng, rows = random.Random(4), []
    root = folder()
    for name, ending in (("a.csv", "\n"), ("b.csv", "\r\n")):
        with open(f"{root}/{name}", "w", newline="") as handle:
            out = csv.writer(handle, quoting=csv.QUOTE_ALL, lineterminator=ending)
            for i in range(120):
                text = "x" + "".join(rng.choices('ab ,"\n\r\té', k=5000 if i % 40 == 7 else rng.randrange(60))) + "y"
                rows.append((rng.randrange(1, 3), f"t\n{i}", text))
                out.writerow(rows[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = reviews.read_reviews(spark, root, keep_corrupt=True).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(tuple(r)[:3] for r in got) == sorted(rows)
    assert not any(r._corrupt_record for r in got)


def test_ingest_reports_malformed_rows(spark):
    root = folder()
    path = write(f"{root}/raw/train.csv", '"2","t","fine\nline"\n"x","t","broken"\n')
    with pytest.raises(ValueError, match="1 malformed"):
        stages.ingest(spark, path, root)
    assert stages.ingest(spark, path, root, max_corrupt=None).where("text = 'fine\nline'").count() == 1


def test_lexicon_file_is_optional(spark):
    path = write(f"{folder()}/lexicon.txt", "dog\tjoy\t1\nnull\tfear\t0\n")
    assert sorted(map(tuple, reviews.read_lexicon(spark, path).collect())) == [("dog", "joy", 1.0), ("null", "fear", 0.0)]
    assert reviews.read_lexicon(spark, path + ".missing").count() == 0


def test_metric_sets(spark):
    root = folder()
    metric_sets.save_metrics(spark.createDataFrame([("m", 0.5)], "model string, accuracy double"), root, "one")
    metric_sets.save_metrics(spark.createDataFrame([("n", None, 3)], "model string, f1 double, n_train long"), root, "two")
    table = metric_sets.load_metrics(spark, root)
    assert {r.metric_set: r.accuracy for r in table.collect()} == {"one": 0.5, "two": None}
    assert metric_sets.load_metric_set(spark, root, "three") is None
    write(f"{root}/docs/metrics_lexicon.json", json.dumps({"accuracy": 0.7}, indent=2))
    row = metric_sets.load_metric_documents(spark, f"{root}/docs").first()
    assert row.metric_set == "lexicon" and json.loads(row.document)["accuracy"] == 0.7


def test_reading_a_split_prunes_the_others(spark):
    frame = spark.createDataFrame([(i, "train" if i < 8 else "test") for i in range(10)], "doc_id long, split string")
    path = tables.write_splits(frame, f"{folder()}/split")
    test = tables.read_split(spark, path, "test")
    assert test.count() == 2 and "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def make_corpus(path, n=260):
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(40)]
    lines = []
    for i in range(n):
        good = i % 2
        words = rng.choices(filler, k=10) + rng.choices(["lovely", "perfect"] if good else ["awful", "broken"], k=2)
        lines.append(f'"{good + 1}","title {i % 9}","{" ".join(words)} http://x.y/{i}"')
    return write(path, "\n".join(lines) + "\n")


def test_a_whole_run_from_file_to_comparison(spark):
    root = folder()
    csv = make_corpus(f"{root}/raw/train.csv")
    raw = stages.ingest(spark, reviews.locate_reviews(spark, f"{root}/raw"), root)
    audit = stages.audit_corpus(raw)
    assert audit["shape"].first().n_rows == 260 and csv
    split = stages.prepare(raw, root, {"debug": 50, "neural": 200})
    assert split.groupBy("split").count().where("split = 'train'").first()["count"] == 160
    stages.extract_features(spark, root, dim=8, min_df=2)
    valence = spark.createDataFrame([("lovely", 3.0), ("perfect", 2.0), ("awful", -3.0), ("broken", -2.0)], "word string, valence double")
    phrases = valence.select(F.col("word").alias("phrase"), F.col("valence").cast("int").alias("score"))
    emolex = spark.createDataFrame([("lovely", "joy", 1)], "word string, emotion string, value int")
    signature = stages.lexicon_tier(spark, root, valence, phrases, emolex, ["joy"])
    assert signature.count() == 20 and "emo_joy" in signature.columns
    classical = stages.classical_tier(spark, root, max_iter=10, gbt_rounds=3)
    assert classical.count() == 4 and classical.where("is_best").count() == 1
    stages.neural_tier(spark, root, 100, budgets=(5,))
    seeds = spark.createDataFrame([("genuine need", "lovely", 1.0)], "category string, seed_term string, weight double")
    scores = stages.category_tier(spark, root, n=15, seeds=seeds)
    assert scores.count() == 15
    assert stages.topic_tier(spark, root, k=3, min_size=2, dims=3).count() == 20
    table = stages.comparison(spark, root).collect()
    assert {r.tier for r in table} == {"lexicon", "classical", "neural"} and len(table) == 6
    assert max(r.accuracy for r in table) > 0.9


def test_row_operators_and_scores_on_a_stream(spark):
    root = folder()
    make_corpus(f"{root}/in/part-1.csv", 40)
    stream = documents.clean_stream(documents.read_review_stream(spark, f"{root}/in"))
    valence = spark.createDataFrame([("lovely", 3.0), ("awful", -3.0)], "word string, valence double")
    query = documents.score_stream(stream, lambda batch: polarity(batch, valence, key="raw"), f"{root}/out", f"{root}/progress")
    query.awaitTermination(120)
    make_corpus(f"{root}/in/part-2.csv", 30)
    query = documents.score_stream(stream, lambda batch: polarity(batch, valence, key="raw"), f"{root}/out", f"{root}/progress")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{root}/out")
    assert got.groupBy("batch").count().count() == 2 and got.count() == 70
