"""Merkle manifest of a table by sibling-shift self-joins.

Every row is a leaf: the hash of its fields. Per group (here: language) the leaves are ordered and
every ``ARITY`` consecutive nodes become one parent, level by level, until one node, the subroot, is
left; the subroots, in the order of their groups, form one more tree up to the root.

A level is one self-join of its nodes. The sibling of a node at distance k in its run has a computed
index, ``index XOR 1`` in a binary tree and slot ``(slot + k) mod ARITY`` of the run otherwise, so
``ARITY - 1`` equijoins on (group, index) bring a node its siblings; the left side is dealt by its index
once for all of them. Nodes in slot zero then emit the parent. No run, group or level is ever gathered,
and a group that holds a third of all rows is dealt by index like any other. Positions come from a
range sort and per-partition counts, not from a global window.

Proofs go the other way: a node's path is its own siblings and then its parent's path, joined level by
level from the root down, so the upper parts are built once per node and not once per row.

Cases: a null field is hashed as ``-`` and differs from an empty one; rows are ordered by group (null
first, then by bytes), id (null first) and leaf, so equal rows stand side by side with equal leaves; a
group of one row has its leaf as subroot; with one group its subroot is the root; a text of any length is
hashed whole; other columns, whatever their names, are neither hashed nor returned; an empty table
gives an empty result and has no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.llm.storage import stored
from opinionmill.operators.relational import lookup_join

ARITY = 8
#: Groups up to which the table of subroots is broadcast; beyond, hot groups are joined apart.
MAX_GROUPS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EMPTY = "X''"


def framed(value: Column) -> Column:
    """A field as the hash sees it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """32 bytes of sha256 over the concatenated parts."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(value: Column) -> Column:
    """Digests are hashed and shown as lower-case hex."""
    return F.lower(F.hex(value))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(framed, fields))


def positions(rows: DataFrame, group: str | None, order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``index`` (from 0 inside its group by ``order``) and ``n``, the group's rows.

    Rows are range-sorted by (group, order) and stored with their place in their partition; the places
    before a partition come from one small row per (group, partition).
    """
    by = [group] if group else []
    at = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    at = stored(at.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_at", 33)
    names = [F.col(c).alias("_group") for c in by] or [F.lit(0).alias("_group")]
    counts = at.groupBy(*names, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = (part == counts["_part"]) & (at[group].eqNullSafe(counts["_group"]) if group else F.lit(True))
    return at.join(counts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("index"), "n")


def run_of(index: Column, arity: int) -> Column:
    return F.floor(index / F.lit(arity)).cast("long")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (``g, index, n, node`` and others) plus ``left`` and ``right``: the digests of the run's
    others on each side."""
    slot = F.pmod("index", F.lit(arity))
    start = F.col("index") - slot
    out, given = nodes, []
    for k in range(1, arity):
        # The node that this one is the sibling of, at distance k; a run's last slots may not exist.
        served = F.col("index").bitwiseXOR(F.lit(1)) if arity == 2 else start + F.pmod(slot - k, F.lit(arity))
        shifted = nodes.select(F.col("g").alias("_g"), served.alias("_i"), F.col("node").alias(f"_s{k}"))
        out = out.join(shifted, (F.col("g") == F.col("_g")) & (F.col("index") == F.col("_i")), "left").drop("_g", "_i")
        given.append((k, F.coalesce(F.col(f"_s{k}"), F.expr(EMPTY))))
    left = F.concat(*[F.when(slot + k >= arity, s).otherwise(F.expr(EMPTY)) for k, s in given])
    right = F.concat(*[F.when(slot + k < arity, s).otherwise(F.expr(EMPTY)) for k, s in given])
    return out.select(*nodes.columns, left.alias("left"), right.alias("right"))


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels (``with_siblings``) from the leaves up, and the roots (``g, node``) found at each.

    ``nodes`` has one row per leaf: ``g, index, n, node`` and others, which the lowest level and its
    roots keep. There is one level more of roots than of nodes.
    """
    levels, roots = [], []
    while True:
        roots.append(nodes.where("n = 1").drop("n", "index"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return levels, roots
        level = stored(with_siblings(nodes, arity), "level")
        levels.append(level)
        parent = digest(as_text(F.concat("node", "right")))
        first = level.where(F.pmod("index", F.lit(arity)) == 0)
        nodes = stored(first.select("g", run_of(F.col("index"), arity).alias("index"), F.ceil(F.col("n") / F.lit(arity)).cast("long").alias("n"), parent.alias("node")), "parents")


def descend(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """``g, node, path`` and the other columns of every leaf; a path holds the siblings on both sides
    from the leaf's level up.

    ``above`` has ``g, path`` of every root: what follows on its group's tree. The upper levels' paths
    are stored once per node; the leaves come last and are not moved with them.
    """
    above = above.select(F.col("g").alias("_g"), "path")
    own = [c for c in roots[0].columns if c != "g"]
    lone = roots[0].join(above, F.col("g") == F.col("_g")).select("g", *own, "path")
    paths: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        up = roots[depth + 1].join(above, F.col("g") == F.col("_g")).select("_g", F.lit(0).cast("long").alias("_up"), F.col("path").alias("_path"))
        up = up if paths is None else up.unionByName(paths.select(F.col("g").alias("_g"), F.col("index").alias("_up"), F.col("path").alias("_path")))
        met = levels[depth].join(up, (F.col("g") == F.col("_g")) & (run_of(F.col("index"), arity) == F.col("_up")))
        path = F.concat(F.array(F.struct("left", "right")), "_path").alias("path")
        if not depth:
            return met.select("g", *own, path).unionByName(lone)
        paths = stored(met.select("g", "index", path), "paths")
    return lone


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to when it is hashed with the siblings of ``path``, level by level."""
    return F.aggregate(path, node, lambda acc, s: digest(as_text(F.concat(s["left"], acc, s["right"]))))


def manifest(
    docs: DataFrame,
    tampered: dict[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    arity: int = ARITY,
) -> DataFrame:
    """``key, group, leaf, claimed, subroot, root, path`` of every row, digests as 32 bytes.

    ``claimed`` is the leaf of the row with some fields replaced by ``tampered`` (null where none
    changes), and ``fold(claimed, path)`` tells what root it leads to.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    others = {**own, **(tampered or {})}
    changed = F.lit(False)
    for c in tampered or {}:
        changed = changed | ~own[c].eqNullSafe(others[c])
    leaves = docs.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{group}`").alias("_lang"), leaf(list(own.values())).alias("_leaf"),
        F.when(changed, leaf(list(others.values()))).alias("_claimed"),
    )
    # The claimed leaf is part of the order, so rows with one leaf are told apart the same way each time.
    placed = stored(positions(stored(leaves, "leaves"), "_lang", ["_key", "_leaf", "_claimed"]), "placed")
    groups = positions(placed.where("index = 0").select("_lang"), None, ["_lang"])
    groups = stored(groups.select("_lang", F.col("index").alias("g"), F.col("n").alias("_groups")), "groups")
    leaves = lookup_join(placed, groups.drop("_groups"), "_lang", "inner", MAX_GROUPS).withColumnRenamed("_leaf", "node")
    levels, roots = climb(stored(leaves, "leaves"), arity)

    subroots = roots[0].select("g", "node")
    for more in roots[1:]:
        subroots = subroots.unionByName(more.select("g", "node"))
    top = subroots.join(groups.select(F.col("g").alias("_g"), "_groups"), F.col("g") == F.col("_g"))
    top = top.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("index"), F.col("_groups").alias("n"), "node", F.col("g").alias("_h"))
    top_levels, top_roots = climb(stored(top, "subroots"), arity)
    empty = F.expr("cast(array() AS array<struct<left:binary,right:binary>>)")
    above = descend(top_levels, top_roots, docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), empty.alias("path")), arity)
    root = top_roots[-1].select(F.col("node").alias("root"))  # one row, none for an empty table
    above = above.select(F.col("_h").alias("g"), "path", F.col("node").alias("subroot"))
    above = stored(above.crossJoin(F.broadcast(root)), "above")

    found = descend(levels, roots, above.select("g", "path"), arity)
    found = lookup_join(found, above.select("g", "subroot", "root"), "g", "inner", MAX_GROUPS)
    claimed = F.coalesce("_claimed", "node").alias("claimed")
    return found.select(F.col("_key").alias(key), F.col("_lang").alias(group), F.col("node").alias("leaf"), claimed, "subroot", "root", "path")


def checked(manifested: DataFrame, key: str = "doc_id") -> DataFrame:
    """A manifest with digests as text: the hash of each row's proof and what its claimed leaf folds to."""
    proof = F.array_join(F.transform("path", lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")
    folded = as_text(fold(F.col("claimed"), F.col("path")))
    return manifested.select(
        key, *[as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof, 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == as_text(F.col("root"))).alias("verified"),
    )
