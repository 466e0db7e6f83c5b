"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opinionmill.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(row):
    text = row["text"]
    if row["doc_id"] is None or text is None or zlib.crc32(str(row["doc_id"]).encode()) % 3:
        return row
    return {**row, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in text)}


def leaf_of(row):
    return sha("".join(framed(row[f]) for f in merkle.FIELDS))


def tree(nodes, arity):
    """The root and, per leaf, its (siblings before, siblings behind) from the lowest level up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % arity : i - i % arity + arity]
            paths[leaf].append((run[: i % arity], run[i % arity + 1 :]))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def plain(rows, arity):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), leaf_of(lowered(r)))
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf_of(r) for r in sorted(by_lang[x], key=key)], arity) for x in langs]
    root, tops = tree([t[0] for t in trees], arity)
    out = []
    for lang, (subroot, paths), top in zip(langs, trees, tops):
        for row, path in zip(sorted(by_lang[lang], key=key), paths):
            proof, folded = "", leaf_of(lowered(row))
            for before, behind in path + top:
                proof += "".join(before) + "".join(behind)
                folded = sha("".join(before) + folded + "".join(behind))
            out.append((row["doc_id"], leaf_of(row), subroot, root, sha(proof), folded, folded == root))
    return sorted(out, key=repr)


def manifest(docs, arity):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = merkle.manifest(docs, {"text": F.coalesce(text, "text")}, arity=arity)
    return sorted(map(tuple, merkle.checked(found).collect()), key=repr)


def table(spark, rows):
    values = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    return spark.createDataFrame(values, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(sizes, seed):
    """``sizes[i]`` rows of language i (the first one null), with null fields, repeated rows and ids."""
    rng, rows = random.Random(seed), []
    for i, n in enumerate(sizes):
        lang = None if not i else f"l{i}é"
        for _ in range(n):
            text = rng.choice([None, "", "Plain Text", "no capitals", "É Ünique " + "A" * rng.randrange(300)])
            rows.append({"doc_id": rng.randrange(-5, 80), "text": text, "lang": lang, "source": rng.choice(["a", None, ""]), "n_chars": rng.choice([None, 7])})
        if n > 3:
            rows[-1] = dict(rows[-2])
            rows[-3] = {**rows[-3], "doc_id": None}
    return rows


@pytest.mark.parametrize("sizes, arity", [((1,), 8), ((0, 3), 8), ((65, 1, 8), 8), ((0, 9, 8, 1, 1, 2, 1, 1, 1, 1), 8), ((5, 1, 6), 2), ((4, 7), 3)])
def test_manifest_equals_a_plain_tree(spark, sizes, arity):
    rows = rows_of(sizes, sum(sizes))
    assert manifest(table(spark, rows).repartition(3), arity) == plain(rows, arity)


def test_clashing_columns_and_long_texts(spark):
    rows = rows_of((3, 4), 5)
    rows[0]["text"] = "Long Word " * 100_000
    docs = table(spark, rows)
    for name in ("index", "n", "g", "node", "left", "path", "root", "_lang", "a col-x"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert manifest(docs, 8) == plain(rows, 8)


def test_empty_table(spark):
    assert manifest(table(spark, []), 8) == []


def test_a_changed_row_fails_and_its_neighbours_hold(spark):
    rows = [{"doc_id": i, "text": "Some Text", "lang": "en", "source": "s", "n_chars": 9} for i in range(40)]
    found = merkle.manifest(table(spark, rows), {"n_chars": F.when(F.col("doc_id") == 7, F.lit(8)).otherwise(F.col("n_chars"))})
    assert {r.doc_id for r in merkle.checked(found).where("NOT verified").collect()} == {7}
