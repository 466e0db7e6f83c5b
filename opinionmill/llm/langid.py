"""Language of words and texts by a linear-chain conditional random field.

Words are labelled by affixes, byte n-grams and themselves (a learned lexicon), neighbours by learned
transitions; forward-backward gives each word its distribution over languages. A text's language is
the one with the largest mean probability over its words, also when it switches between several.
A chain has at most ``CHAIN`` words; a longer text is several chains, no word is left out.

Training: up to ``per_lang`` labelled texts of every language in the order of a hash of the id, cut into
chains; of these up to ``per_lang_chains`` of every language, one of each of its texts in turn, so that
texts are whole unless a language has more, and none takes another's place; half of the chains switch to another language midway, so that the transitions
are those of code-switched text.

Cases: a null text or one without a letter is ``und`` with score 0; null languages teach nothing;
without labelled rows everything is ``und``; repeated rows are labelled alike; an empty table gives
an empty result; a row without doc_id teaches nothing and is labelled like any other; other columns,
whatever their names, pass unchanged (those named like a result are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.storage import put_back, set_apart, with_fields
from opinionmill.operators.relational import top_k_per_group

CHAIN = 64
SIZES = (2, 3, 4)
BUCKETS = 1 << 18
PER_LANG = 300
#: Training chains of one language; no limit over all languages.
CHAINS = 16_000
CHAINS_AT_ONCE = 4096
STEPS = 40
UNKNOWN = "und"


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of the chains of texts whose words begin at ``first``."""
    n = np.diff(first)
    count = -(-n // CHAIN)
    text = np.repeat(np.arange(len(n)), count)
    number = words.ragged(np.zeros(len(n), np.int64), count)
    return text, first[:-1][text] + number * CHAIN, np.minimum(n[text] - number * CHAIN, CHAIN)


def emissions(distinct: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of every language (columns) for every distinct word."""
    if not len(distinct):
        return np.zeros((0, weights.shape[1]), np.float32)
    features, begins = words.subwords(distinct, SIZES, len(weights))
    return np.stack([np.add.reduceat(weights[features, k], begins) for k in range(weights.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, length: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Word marginals (chains, CHAIN, languages) and, on request, expected transitions.

    ``scores`` are padded to ``CHAIN`` words; values behind a chain's ``length`` count for nothing.
    """
    n, most, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves)
    alpha, beta = np.empty((n, most, k)), np.ones((n, most, k))
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, most):
        a = (alpha[:, t - 1] @ step) * local[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        b = (local[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = np.where((t + 1 < length)[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    if not pairs:
        return marginal, None
    expected = np.zeros((k, k))
    for t in range(most - 1):
        on = t + 1 < length
        joint = alpha[on, t, :, None] * step * (local[on, t + 1] * beta[on, t + 1])[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, expected


def chosen_chains(lang: np.ndarray, number: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``most`` chains of every language in random order, taken from its texts in turn."""
    some = rng.permutation(len(lang))
    order = np.lexsort((number[some], lang[some]))
    of = lang[some][order]
    rank = np.empty(len(some), np.int64)
    rank[order] = np.arange(len(some)) - np.searchsorted(of, of)
    return some[rank < most]


def fit(texts: pa.Array, langs: list[str], seed: int = 42, per_lang_chains: int = CHAINS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, feature weights and transition scores by gradient steps on the log likelihood."""
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    of_text = np.searchsorted(names, langs)
    codes, distinct, first = words.coded(texts, lower=True)
    text, start, length = chains(first)
    some = chosen_chains(of_text[text], (start - first[:-1][text]) // CHAIN, per_lang_chains, rng)
    text, start, length = text[some], start[some], length[some]
    at = start[:, None] + np.minimum(np.arange(CHAIN), length[:, None] - 1)
    word, label = codes[at], np.repeat(of_text[text][:, None], CHAIN, axis=1)
    # Every second chain goes on as another one from a random word on.
    other = np.roll(np.arange(len(text)), 1)
    cut = rng.integers(1, CHAIN, len(text))
    switched = (np.arange(len(text)) % 2 == 0)[:, None] & (np.arange(CHAIN) >= cut[:, None]) & (length[other] == CHAIN)[:, None]
    word, label = np.where(switched, word[other], word), np.where(switched, label[other], label)
    inside = np.arange(CHAIN) < length[:, None]
    features, begins = words.subwords(distinct, SIZES, BUCKETS)
    counts = np.diff(np.append(begins, len(features)))
    before, after = label[:, :-1], label[:, 1:]
    both = inside[:, 1:]
    seen = np.bincount(before[both] * k + after[both], minlength=k * k).reshape(k, k).astype(float)
    weights, moves = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    squares, move_squares = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(STEPS):
        scores = np.stack([np.add.reduceat(weights[features, j], begins) for j in range(k)], axis=1)
        per_word, expected = np.zeros((k, len(distinct))), np.zeros((k, k))
        for a in range(0, len(text), CHAINS_AT_ONCE):
            part = slice(a, a + CHAINS_AT_ONCE)
            marginal, moved = forward_backward(scores[word[part]], length[part], moves, pairs=True)
            gap = (np.eye(k)[label[part]] - marginal)[inside[part]] / inside.sum()
            expected += moved
            for j in range(k):
                per_word[j] += np.bincount(word[part][inside[part]], weights=gap[:, j], minlength=len(distinct))
        for j in range(k):
            slope = np.bincount(features, weights=np.repeat(per_word[j], counts), minlength=BUCKETS) - 1e-7 * weights[:, j]
            squares[:, j] += slope**2 * 1e6
            weights[:, j] += 0.2 * slope * 1e3 / np.sqrt(squares[:, j])
        slope = (seen - expected) / max(both.sum(), 1)
        move_squares += slope**2
        moves += 0.3 * slope / np.sqrt(move_squares)
    return names, weights, moves


def training_rows(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> DataFrame:
    """At most ``per_lang`` labelled texts of every language; ids are ranked without their texts."""
    labelled = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = top_k_per_group(labelled.select("doc_id", "lang"), ["lang"], order, per_lang).select(F.col("doc_id").alias("_id")).distinct()
    # per_lang ids of every language: bounded by the number of languages.
    return labelled.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi").select("text", "lang")


def label_languages(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, with_runs: bool = False, per_lang_chains: int = CHAINS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``with_runs`` adds ``runs``, the word ranges of each language.

    ``learn`` marks the rows whose ``lang`` may be learned from.
    """
    sample = training_rows(docs, learn, per_lang).toArrow()
    langs = sample.column("lang").to_pylist()
    model = fit(sample.column("text").combine_chunks(), langs, per_lang_chains=per_lang_chains) if langs else ([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "runs")
    rows = set_apart(docs).withColumn("spoken", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    run_type = pa.struct({"start": pa.int64(), "stop": pa.int64(), "lang": pa.string()})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, moves = shared.value
        for batch in words.sliced(batches, "text"):
            codes, distinct, first = words.coded(batch.column("text"), lower=True)
            n, k = batch.num_rows, len(names)
            share, best = np.zeros((n, max(k, 1))), np.zeros(len(codes), np.int64)
            if k and len(codes):
                scores = emissions(distinct, weights)
                text, start, length = chains(first)
                for a in range(0, len(text), 8192):
                    part = slice(a, a + 8192)
                    at = start[part, None] + np.minimum(np.arange(CHAIN), length[part, None] - 1)
                    marginal, _ = forward_backward(scores[codes[at]], length[part], moves)
                    inside = np.arange(CHAIN) < length[part, None]
                    owner = np.repeat(text[part], length[part])
                    for j in range(k):
                        share[:, j] += np.bincount(owner, weights=marginal[inside][:, j], minlength=n)
                    best[at[inside]] = marginal[inside].argmax(axis=1)
                share /= np.maximum(np.diff(first), 1)[:, None]
            known = batch.column("spoken").to_numpy(zero_copy_only=False) & bool(k) & (np.diff(first) > 0)
            top = share.argmax(axis=1)
            langs = [names[j] if ok else UNKNOWN for j, ok in zip(top, known)]
            columns = [batch.column("row"), batch.column("text"), pa.array(langs), pa.array(np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0))]
            if with_runs:
                found = []
                for i in range(n):
                    b = best[first[i] : first[i + 1]]
                    edges = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b)) if known[i] else []
                    found.append([{"start": int(s), "stop": int(e), "lang": names[b[s]]} for s, e in zip(edges[:-1], edges[1:])])
                columns.append(pa.array(found, pa.list_(run_type)))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "lang_pred", "score", *(["runs"] if with_runs else [])])

    fields = "lang_pred string, score double" + (", runs array<struct<start:long,stop:long,lang:string>>" if with_runs else "")
    return put_back(rows.mapInArrow(predict, with_fields(rows.select("row", "text").schema, fields)), docs)
