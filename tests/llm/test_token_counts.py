"""Token counts against the libraries, text by text."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionmill.llm import token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")


def plain(path):
    if path.endswith(".json"):
        tokenizer = Tokenizer.from_file(path)
        return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text or ""))


def hard_texts(seed, n):
    rng = random.Random(seed)
    letters = [*"ab '\n\t é1.!<|Σ中😀\x1c\x85", "<|endoftext|>", "</s>", "'s", " ", " ", " ", "　", " \r\n"]
    return ["", None, " ", "a  b \n", "<|endoftext|> x", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("block", [7, 300, token_counts.BLOCK_BYTES])
def test_counts_equal_the_library(name, block, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 200)
    path, texts = public_tokenizers.path(name), hard_texts(block, 400)
    n_bytes, n_tokens = token_counts.Counter(path)(pa.array(texts))
    assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert n_tokens.tolist() == list(map(plain(path), texts))


def test_long_texts_are_split_and_summed(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1000)
    texts = ["word, another one " * 3000, "x" * 5000, None, "中" * 3000, "tail 12"]
    _, n_tokens = token_counts.Counter(JSON)(pa.array(texts))
    assert n_tokens.tolist() == list(map(plain(JSON), texts))


def test_rows_of_every_kind(documents):
    """Null id, null and empty text, repeated rows, clashing and oddly named columns, an empty table."""
    texts = [(1, "one two"), (1, "one two"), (2, None), (None, "three"), (3, ""), (4, "w " * 2000)]
    docs = documents(*texts).withColumn("n_tokens", F.lit("clash")).withColumn("a col-x", F.lit(7)).withColumn("_text", F.lit("other"))
    rows = token_counts.count_tokens(docs, JSON, carry=["n_tokens", "a col-x"]).toPandas()
    assert rows.columns.tolist() == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_tokens", "a col-x"]
    got = token_counts.count_tokens(docs, JSON).collect()
    want = [(i, len((t or "").encode()), plain(JSON)(t)) for i, t in texts]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and sum(r.over_limit for r in got) == 1
    assert token_counts.count_tokens(docs.limit(0), JSON).count() == 0


def test_unknown_files_are_refused():
    with pytest.raises(ValueError, match="neither"):
        token_counts.encoder("vocabulary.txt")
