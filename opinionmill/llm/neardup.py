"""MinHash near-duplicates by an LSH forest of sorted signature orders.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit sum that
   names its shingle set, and a MinHash signature. Documents with one set share a representative.
2. Every tree orders the signatures of the representatives from another position on. A global range
   sort puts documents with long common prefixes next to each other, also when they are a third of
   the corpus: a large region is just cut at deeper prefixes, so the depth adapts to the region.
   Each document proposes its most similar neighbours within a window and hubs of its region (members
   closest to the region's consensus), so proposals grow linearly with the documents.
   A document whose region goes on behind its window, or with more alike neighbours than it may
   propose, is marked: its partners may lie among those that the forest left out.
3. Proposals are confirmed on full shingle sets. A few later rounds propose pairs between different
   groups of marked documents from wider windows, which joins most of a large group cheaply.
4. What the forest left out, ``remaining`` finds exactly: a prefix-filter join of all marked documents
   on their rarest shingles gives every pair of different groups that can be alike enough.
5. Confirmed links become components by alternating star contraction.

Cases: a null or empty text has no shingles and is linked with nothing; with fewer words than a
shingle the whole sequence is one shingle; repeated rows and equal texts fall into one component; a
row without doc_id belongs to no component and stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opinionmill.llm import words
from opinionmill.llm.storage import quoted, stored, unused
from opinionmill.llm.substrings import window_hashes

WIDTH = 5
SIMILARITY = 75
TREES = 16
HASHES = 64
MIN_DEPTH = 2
NEIGHBOURS = 48
BEST = 4
#: Later rounds, which look at other groups only, look this many times further.
FURTHER = 4
HUBS = 8
HUBS_PROPOSED = 2
#: Shares of equal signature places from which a pair is proposed: 4.6 standard errors below 0.75.
PROPOSE = 0.5
CELL = 256
BUCKET_ROWS = 1024
ROUNDS = 4
#: Counters of shingles by hash; they order the shingles and never decide about a pair.
COUNTERS = 1 << 21
#: Documents with one shingle above which they are dealt to a grid of cells.
HOT_ROWS = 4096
PREFIX_ROWS = 1 << 16
PAIRS_AT_ONCE = 1 << 21
#: Edges that one task joins up, 16 bytes each.
EDGES_AT_ONCE = 1 << 20

_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in a row, ascending, and ``n + 1`` offsets."""
    codes, distinct, first = words.coded(texts, lower=True)
    hashed = words.hashes(distinct)[codes]
    n = np.diff(first)
    h = window_hashes(hashed, width)
    sizes = np.maximum(n - width + 1, 0)
    at = words.ragged(first[:-1], sizes)
    owner, values = np.repeat(np.arange(len(n)), sizes), h[at]
    short = np.flatnonzero((n > 0) & (n < width))
    whole = [window_hashes(hashed[first[i] : first[i + 1]] + np.uint64(n[i]), int(n[i]))[0] for i in short]
    owner, values = np.append(owner, short), np.append(values, np.array(whole, np.uint64))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``SIGNED`` for every row of ``docs``; without shingles the signature is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.sliced(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), width)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            starts = offsets[:-1][full]
            names = np.zeros((2, len(n)), np.uint64)
            signs = np.empty((len(full), HASHES), np.uint16)
            if len(full):
                names[0, full] = np.add.reduceat(_mixed(values, 0xFF51AFD7ED558CCD), starts)
                names[1, full] = np.add.reduceat(_mixed(values, 0xC4CEB9FE1A85EC53), starts)
                for k, salt in enumerate(_SALT):
                    signs[:, k] = _mixed(np.minimum.reduceat(values * salt, starts), 0xFF51AFD7ED558CCD) >> np.uint64(48)
            raw = signs.astype(">u2").tobytes()
            texts = [b""] * len(n)
            for i, row in enumerate(full.tolist()):
                texts[row] = raw[2 * HASHES * i : 2 * HASHES * (i + 1)]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in names), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def forest(representatives: DataFrame, trees: int = TREES) -> DataFrame:
    """Rows ``tree, key, rep, group``: each signature from the tree's own position on, range-sorted."""
    step = HASHES // trees
    tree = F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree")
    rows = representatives.select(tree, "rep", "signature", "group")
    at = F.col("tree") * (2 * step)
    key = F.concat(F.expr(f"substring(signature, tree * {2 * step} + 1)"), F.substring("signature", F.lit(1), at))
    rows = rows.select("tree", key.alias("key"), "rep", "group")
    return rows.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key", "rep")


def _neighbours(tree: np.ndarray, signs: np.ndarray, group: np.ndarray, n_best: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to confirm among sorted signatures: per row the ``n_best`` most similar of its
    window, or the one most similar if there are more, and the best hubs of its region, if alike enough and
    of different groups. A row paired with itself had no room for all: its region is longer than the
    window, or its slots were full."""
    m = len(signs)
    same = (signs[1:, :MIN_DEPTH] == signs[:-1, :MIN_DEPTH]).all(axis=1) & (tree[1:] == tree[:-1])
    region = np.concatenate([[0], np.cumsum(~same)])
    sizes = np.bincount(region)
    best = np.zeros((n_best, m), np.int64)  # agreement << 40 | other row
    least = int(PROPOSE * HASHES)
    marked, crowded = np.zeros(m, bool), np.zeros(m, bool)
    longer = np.flatnonzero(region[window + 1 :] == region[: -window - 1])
    marked[longer] = marked[longer + window + 1] = True

    def offer(rows: np.ndarray, others: np.ndarray, agree: np.ndarray) -> None:
        new = (agree << 40) | others
        for level in range(n_best):
            old = best[level, rows]
            best[level, rows] = np.maximum(old, new)
            new = np.minimum(old, new)
        crowded[rows[new > 0]] = True

    for offset in range(1, min(window, m - 1) + 1):
        left = np.flatnonzero((region[offset:] == region[:-offset]) & (group[offset:] != group[:-offset]))
        if not (region[offset:] == region[:-offset]).any():
            break
        agree = (signs[left] == signs[left + offset]).sum(axis=1).astype(np.int64)
        left, agree = left[agree >= least], agree[agree >= least]
        offer(left, left + offset, agree)
        offer(left + offset, left, agree)
    # A row among more look-alikes than it has slots is left to the exact join: its best one joins it up.
    marked |= crowded
    best[1:, crowded] = 0
    pairs = [(np.flatnonzero(best[k]), best[k][best[k] > 0] & ((1 << 40) - 1)) for k in range(n_best)]
    pairs.append((np.flatnonzero(marked), np.flatnonzero(marked)))
    begins = np.cumsum(sizes) - sizes
    for r in np.flatnonzero(sizes > 8):
        rows = np.arange(begins[r], begins[r] + sizes[r])
        own = signs[rows]
        sorted_ = np.sort(own, axis=0)
        runs = np.arange(len(own))[:, None] - np.maximum.accumulate(
            np.where(np.vstack([np.ones((1, HASHES), bool), sorted_[1:] != sorted_[:-1]]), np.arange(len(own))[:, None], 0), axis=0
        )
        consensus = sorted_[runs.argmax(axis=0), np.arange(HASHES)]
        hubs = np.argsort(-(own == consensus).sum(axis=1), kind="stable")[:HUBS]
        agree = np.stack([(own == own[h]).sum(axis=1) for h in hubs])
        agree[group[rows][hubs][:, None] == group[rows][None, :]] = 0
        for top in np.argsort(-agree, axis=0, kind="stable")[:HUBS_PROPOSED]:
            good = np.flatnonzero(agree[top, np.arange(len(rows))] >= least)
            pairs.append((rows[good], rows[hubs[top[good]]]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def proposals(sorted_rows: DataFrame, further: int = 1) -> DataFrame:
    """Distinct pairs ``a < b`` that neighbours in some tree propose, and ``a = b`` for marked rows.

    Rows of the region at a border of a range partition may have neighbours behind it: they are marked.
    """
    n_best, window = BEST * further, NEIGHBOURS * further

    def border(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        key, tree = batch.column("key").to_pylist(), batch.column("tree").to_pylist()
        region = [tree[i] == tree[at] and key[i][: 2 * MIN_DEPTH] == key[at][: 2 * MIN_DEPTH] for i in range(len(key))]
        rep = batch.column("rep").filter(pa.array(region))
        return pa.RecordBatch.from_arrays([rep, rep], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield border(batch.slice(0, window + 1), 0)
            else:
                batch = pa.concat_batches([held, batch])
            signs = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").astype(np.uint16).reshape(-1, HASHES)
            rep = batch.column("rep").to_numpy()
            a, b = _neighbours(batch.column("tree").to_numpy(), signs, batch.column("group").to_numpy(), n_best, window)
            a, b = rep[a], rep[b]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            held = batch.slice(max(0, batch.num_rows - window - 1))
        if held is not None:
            yield border(held, -1)

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs whose full shingle sets, taken from ``texts`` (doc, text), are alike enough.

    Pairs meet by the component they form among the pairs. A component of more than ``CELL`` documents
    is cut into a grid of cells of about that many, and a pair goes to the cell of its two sides. So a
    text is sent once for a small component and once per cell that needs it for a large one.
    """
    member = components(pairs)
    sizes = member.groupBy(F.col("component").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    placed = pairs.join(member, F.col("a") == F.col("node"), "left").select("a", "b", F.coalesce("component", "a").alias("_c"))
    placed = placed.join(sizes, F.col("_c") == F.col("_of"))
    parts = F.ceil((F.col("_n") + 1) / F.lit(CELL)).cast("long")
    sides = [F.pmod(F.xxhash64(c), parts) for c in ("a", "b")]
    cell = F.xxhash64("_c", F.least(*sides), F.greatest(*sides))
    chunked = stored(placed.select("a", "b", cell.alias("cell")), "pairs")
    buckets = -(-chunked.count() // BUCKET_ROWS) or 1
    bucket = F.pmod("cell", F.lit(buckets)).alias("bucket")
    needed = chunked.select(bucket, F.col("a").alias("_doc")).union(chunked.select(bucket, F.col("b").alias("_doc"))).distinct()
    rows = needed.join(texts, needed["_doc"] == texts["doc"]).select("bucket", "doc", "text")
    links = chunked.select(bucket, "a", "b")

    def check(link: pa.Table, text: pa.Table) -> pa.Table:
        values, offsets = shingle_sets(text.column("text").combine_chunks(), width)
        place = {d: i for i, d in enumerate(text.column("doc").to_pylist())}
        good = []
        for a, b in zip(link.column("a").to_pylist(), link.column("b").to_pylist()):
            i, j = place[a], place[b]
            x, y = values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * common >= similarity * (len(x) + len(y) - common))
        return link.select(["a", "b"]).append_column("linked", pa.array(good, pa.bool_()))

    checked = links.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(check, "a long, b long, linked boolean")
    return checked.where("linked").select("a", "b")


def prefixes(n: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first shingles of a set of ``n`` must hold one of any set that is alike enough
    and not smaller (or, second, not larger)."""
    return n + 1 + -2 * similarity * n // (100 + similarity), n + 1 + -similarity * n // 100


def _meeting(key: np.ndarray, doc: np.ndarray, group: np.ndarray, n: np.ndarray, place: np.ndarray, role: np.ndarray, similarity: int) -> np.ndarray:
    """Distinct pairs (two rows ``a < b``) of different groups that meet in a key, one as the smaller
    set (role 1) and one as the larger (role 2), and can still have enough shingles in common."""
    order = np.argsort(key, kind="stable")
    key, doc, group, n, place, role = (x[order] for x in (key, doc, group, n, place, role))
    later = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
    upto, found, start = np.cumsum(later), [np.empty((2, 0), np.int64)], 0
    while start < len(key):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
        rows = np.arange(start, min(stop, len(key)))
        x, y = np.repeat(rows, later[rows]), words.ragged(rows + 1, later[rows])
        apart = group[x] != group[y]
        x, y = x[apart], y[apart]
        swap = (n[x] > n[y]) | ((n[x] == n[y]) & (doc[x] > doc[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        most = np.minimum(n[x] - place[x], n[y] - place[y])
        good = (role[x] & 1 > 0) & (role[y] & 2 > 0) & (most * (100 + similarity) >= similarity * (n[x] + n[y]))
        a, b = doc[x[good]], doc[y[good]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
        start = stop
    return np.unique(np.concatenate(found, axis=1), axis=1)


def remaining(texts: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """All pairs ``a < b`` of different groups of ``texts`` (doc, group, text) that can be alike enough.

    Shingles are ordered by the number of documents of their counter, and those whose counter knows one
    group only come first. In that order two sets that are alike enough have their first common shingle
    among the first 1/7 of the smaller and the first 1/4 of the larger; what is in common behind it
    must suffice. So a shared boilerplate pairs nobody unless it makes up 6/7 of a document, and
    shingles of one group pair nobody. A frequent shingle's documents are dealt to a grid of cells.
    """

    def cells(values: np.ndarray) -> np.ndarray:
        return (_mixed(values, 0x9E3779B97F4A7C15) % np.uint64(COUNTERS)).astype(np.int64)

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, bounds = np.zeros(COUNTERS, np.int64), np.iinfo(np.int64)
        low, high = np.full(COUNTERS, bounds.max), np.full(COUNTERS, bounds.min)
        for batch in words.sliced(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), width)
            cell, group = cells(values), np.repeat(batch.column("group").to_numpy(), np.diff(offsets))
            np.add.at(count, cell, 1)
            np.minimum.at(low, cell, group)
            np.maximum.at(high, cell, group)
        used = np.flatnonzero(count)
        for a in range(0, len(used), 1 << 16):
            some = used[a : a + (1 << 16)]
            columns = [pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in (count, low, high))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "count", "low", "high"])

    known = texts.mapInArrow(counters, "cell int, count long, low long, high long").groupBy("cell")
    known = known.agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
    known = known.where("low < high").select("cell", "count").toArrow()  # at most COUNTERS rows
    weights = np.zeros(COUNTERS, np.int64)
    weights[known.column("cell").to_numpy()] = known.column("count").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.sliced(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), width)
            sizes = np.diff(offsets)
            owner, weight = np.repeat(np.arange(len(sizes)), sizes), shared.value[cells(values)]
            order = np.lexsort((values, weight, owner))
            values, weight = values[order], weight[order]
            place = np.arange(len(values)) - offsets[:-1][owner]
            as_smaller, as_larger = (x[owner] for x in prefixes(sizes, similarity))
            keep = np.flatnonzero((place < as_larger) & (weight > 0))
            doc, group = (batch.column(c).to_numpy()[owner[keep]] for c in ("doc", "group"))
            role = np.where(place[keep] < as_smaller[keep], 3, 2)
            columns = (values[keep], doc, group, sizes[owner[keep]], place[keep], role)
            parts = -(-weight[keep] // HOT_ROWS)
            own = (_mixed(doc.astype(np.uint64), 0xFF51AFD7ED558CCD) % parts.astype(np.uint64)).astype(np.int64)
            # Cell (p, q) of a hot shingle has the smaller sets of part p and the larger ones of part q.
            for as_, at in ((1, np.flatnonzero((parts > 1) & (role == 3))), (2, np.flatnonzero(parts > 1)), (0, np.flatnonzero(parts == 1))):
                times = parts[at] if as_ else np.ones(len(at), np.int64)
                at, other = np.repeat(at, times), words.ragged(np.zeros(len(at), np.int64), times)
                key, *rest = (c[at] for c in columns)
                p, q = (own[at], other) if as_ == 1 else (other, own[at])
                rest[-1] = np.full(len(at), as_) if as_ else rest[-1]
                key = _mixed(key + (p * parts[at] + q).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53), 0xFF51AFD7ED558CCD) if as_ else key
                for a in range(0, len(at), PREFIX_ROWS):
                    part = slice(a, a + PREFIX_ROWS)
                    arrays = [pa.array(c[part].view(np.int64)) for c in (key, *rest[:2])] + [pa.array(c[part].astype(np.int32)) for c in rest[2:]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc", "group", "n", "place", "role"])

    rows = stored(texts.mapInArrow(run, "key long, doc long, group long, n int, place int, role int"), "prefixes")
    buckets = -(-rows.count() // PREFIX_ROWS) or 1

    def meet(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "group", "n", "place", "role")]
        pairs = _meeting(*columns, similarity)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    met = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(meet, "a long, b long")
    return met.distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (columns a, b) but that one.

    Blocks of bounded size become stars by themselves; what one block cannot hold goes on by alternating
    large and small stars, every round two aggregates with partial sums, and is stored.
    """

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "_u").alias("m"))
        met = edges.join(least, edges["u"] == least["_u"])
        if large:
            made = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).select("col.*")
        return made.where("u <> v").distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        blocks = -(-n // EDGES_AT_ONCE) or 1
        if (n, mark) == before:
            break
        before = (n, mark)
        # Edges are dealt by both sides, so that those of a node with very many do not meet in one block.
        edges = edges.groupBy(F.pmod(F.xxhash64("u", "v"), F.lit(blocks)).alias("block")).applyInArrow(local_stars, "u long, v long")
        if blocks == 1:
            edges = stored(edges, "edges")
            break
        edges = stored(stars(stars(stored(edges.distinct(), "edges"), True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def local_stars(table: pa.Table) -> pa.Table:
    """The edges' components as stars: every node but the smallest of its component with that one."""
    nodes, ends = np.unique(np.stack([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": nodes[inner], "v": nodes[label[inner]]})


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    signed = stored(signatures(docs, width), "signed")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    sets = stored(sets, "sets")
    # First all representatives; from then on only those that some tree found alike or marked, with their texts at hand.
    new = stored(proposals(forest(sets.withColumn("group", F.col("rep")), trees)), "proposals")
    marked, alike = new.where("a = b").select(F.col("a").alias("_marked")), new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new, alike = new.where("a <> b"), stored(alike, "alike")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string"))
    texts = texts.join(alike, texts["doc"] == alike["node"], "left_semi").dropDuplicates(["doc"])
    texts = stored(texts, "texts")
    found = stored(confirmed(new, texts, width, similarity), "links")
    tried, links, groups = new, found, components(found)
    # A row that is not marked has offered all that any region holds for it, also to marked ones.
    for _ in range(rounds - 1):
        rows = sets.join(marked, sets["rep"] == marked["_marked"], "left_semi")
        rows = rows.join(groups, rows["rep"] == groups["node"], "left").withColumn("group", F.coalesce("component", "rep"))
        new = stored(proposals(forest(rows, trees), FURTHER).where("a <> b").join(tried, ["a", "b"], "left_anti"), "proposals")
        found = stored(confirmed(new, texts, width, similarity), "links")
        if not found.limit(1).count():
            break
        tried, links = tried.union(new), links.union(found)
        groups = components(links)
    if marked.limit(1).count():
        left = texts.join(marked, texts["doc"] == marked["_marked"], "left_semi")
        left = left.join(groups, left["doc"] == groups["node"], "left").select("doc", F.coalesce("component", "doc").alias("group"), "text")
        left = stored(left, "marked")
        new = stored(remaining(left, width, similarity).join(tried, ["a", "b"], "left_anti"), "proposals")
        found = stored(confirmed(new, texts, width, similarity), "links")
        if found.limit(1).count():
            groups = components(links.union(found))
    labels = groups
    named = sets.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), "rep")
    named = named.join(labels, named["rep"] == labels["node"], "left").select("_a", "_b", F.coalesce("component", "rep").alias("_component"))
    match = (signed["set_a"] == named["_a"]) & (signed["set_b"] == named["_b"]) & (signed["n_shingles"] > 0)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    out = signed.join(named, match, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every component, that of the smallest id; rows without an id all stay, and so do rows of
    one id with different texts."""
    kept = near_duplicates(docs, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    mark = unused(docs, "_mark")
    one = named.join(kept, named["doc_id"] == kept["_id"], "left_semi").withColumn(mark, F.xxhash64("text"))
    one = one.dropDuplicates(["doc_id", mark]).select(*map(quoted, docs.columns))
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
