"""Merkle manifest of a dataset: a tree of SHA-256 midstates per source, and one over them.

A parent hashes the digests of FANOUT consecutive children. It keeps a copy of the hash
state before each child slot, so a changed child is folded in by resuming the state of its
slot with the replacement and the siblings to its right; what lies to its left is not
hashed again. Siblings to the left are only read for the proof.

Leaves of a source are numbered by range partitioning and counts per partition. A tree is
cut into tiers of `levels` levels: a task builds the subtree over FANOUT ** levels
neighbouring nodes, and only its root goes up to the next tier. On the way down, every
subtree gets the path of its root (states, siblings and slots of the levels above), so that
a task folds all its leaves up to the root of the whole tree. A source with a third of all
rows is a third of the subtrees, never one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .sha256 import absorb, finish, from_hex, hex_bytes, start, to_hex

FANOUT = 3
LEVELS = 7  # of a tier: subtrees of 3 ** 7 = 2,187 nodes


def framed(*values: Column) -> Column:
    """Values as `-` if null, else byte count, colon and value, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(framed(*values).cast("binary"), 256)


# Numbering.


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place within (partition, tree) to rows sorted by tree."""
    part, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        names = batch.column("tree").to_pylist()
        places = []
        for name in names:
            tree, at = name, (at + 1 if name == tree else 0)
            places.append(at)
        columns = [*batch.columns, pa.array([part] * len(names), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def number_leaves(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `at`, their number from 0 within `tree` by `order`, and `size`, the rows
    of the tree. No window spans a tree: partitions are counted, not their rows."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keys = [F.asc("tree"), *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_placed, f"{types}, part int, place long")
    placed = cut_lineage(placed)
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(by_tree).alias("size")
    )
    numbered = placed.join(offsets, ["tree", "part"]).withColumn("at", F.col("first") + F.col("place"))
    return numbered.drop("part", "place", "first")


# Subtrees.


def depth_of(size: int, fanout: int = FANOUT) -> int:
    """Levels of parents over `size` leaves: none over a single one."""
    depth, nodes = 0, size
    while nodes > 1:
        depth, nodes = depth + 1, -(-nodes // fanout)
    return depth


class Subtree:
    """Levels over neighbouring nodes. `states[l][s]` has the state of every parent of
    level l before its slot s."""

    def __init__(self, digests: np.ndarray, levels: int, fanout: int):
        self.fanout = fanout
        self.nodes, self.states = [digests], []
        for _ in range(levels):
            below = self.nodes[-1]
            parents = -(-len(below) // fanout)
            state, kept, out = start(parents), [], np.empty((parents, 8), np.uint32)
            for slot in range(fanout):
                kept.append(state.copy())
                have = (len(below) - slot + fanout - 1) // fanout  # parents with a child here
                if have > 0:
                    state[:have] = absorb(state[:have], below[slot::fanout])
                full = (len(below) - slot - 1 + fanout - 1) // fanout if slot + 1 < fanout else 0
                if have > full:  # these have no further child
                    out[full:have] = finish(state[full:have], slot + 1)
            self.states.append(kept)
            self.nodes.append(out)

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The root of the subtree with one leaf replaced, for each leaf and its digest."""
        at = np.arange(len(digests))
        for level, kept in enumerate(self.states):
            below = self.nodes[level]
            parent, slot = at // self.fanout, at % self.fanout
            state = np.empty_like(digests)
            for s in range(self.fanout):
                state[slot == s] = kept[s][parent[slot == s]]
            state = absorb(state, digests)
            children = np.minimum(self.fanout, len(below) - parent * self.fanout)
            for s in range(1, self.fanout):
                right = np.flatnonzero((slot < s) & (s < children))
                state[right] = absorb(state[right], below[parent[right] * self.fanout + s])
            digests = np.empty_like(state)
            for count in np.unique(children):
                digests[children == count] = finish(state[children == count], int(count))
            at = parent
        return digests

    def siblings(self) -> list[bytes]:
        """Per leaf: the other children on its way up, hex text, level by level."""
        out, at = [b""] * len(self.nodes[0]), list(range(len(self.nodes[0])))
        for below in self.nodes[:-1]:
            text, size = hex_bytes(below).tobytes(), len(below)
            for k, node in enumerate(at):
                first = node // self.fanout * self.fanout
                last = min(first + self.fanout, size)
                out[k] += text[64 * first : 64 * node] + text[64 * (node + 1) : 64 * last]
                at[k] = node // self.fanout
        return out

    def path(self, leaf: int) -> list[dict]:
        """Slot, children, state and siblings of every level above a leaf."""
        out, at = [], leaf
        for level, kept in enumerate(self.states):
            below = self.nodes[level]
            parent, slot = divmod(at, self.fanout)
            first = parent * self.fanout
            others = np.delete(below[first : first + self.fanout], slot, axis=0)
            out.append({"slot": slot, "state": kept[slot][parent].astype(">u4").tobytes(), "siblings": others.astype(">u4").tobytes()})
            at = parent
        return out


_PATH = "array<struct<slot:int,state:binary,siblings:binary>>"


def fold_path(digests: np.ndarray, path: list[dict]) -> np.ndarray:
    """Folds digests of one node up a path: states are resumed, never rebuilt."""
    words = lambda raw: np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)
    for step in path:
        state = absorb(np.repeat(words(step["state"]), len(digests), axis=0), digests)
        others = words(step["siblings"])
        for sibling in others[step["slot"] :]:
            state = absorb(state, np.repeat(sibling[None], len(digests), axis=0))
        digests = finish(state, len(others) + 1)
    return digests


def proof_text(path: list[dict]) -> bytes:
    return b"".join(step["siblings"].hex().encode() for step in path)


def _subtree(table: pa.Table, fanout: int, levels: int, tier: int) -> Subtree:
    """The subtree over the rows of a block, which must be sorted by `at`."""
    rest = depth_of(table.column("size")[0].as_py(), fanout) - tier * levels
    return Subtree(from_hex(table.column("digest").to_pylist()), min(levels, max(rest, 0)), fanout)


def _root_of(fanout: int, levels: int, tier: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = _subtree(table.sort_by("at"), fanout, levels, tier)
        return pa.Table.from_pydict(
            {"tree": [key[0].as_py()], "at": [key[1].as_py()], "size": table.column("size")[:1], "digest": to_hex(tree.nodes[-1])}
        )

    return work


def _path_rows(key, table: pa.Table, above: pa.Table, fanout: int, levels: int, tier: int) -> pa.Table:
    table = table.sort_by("at")
    tree = _subtree(table, fanout, levels, tier)
    upper = above.column("path")[0].as_py()
    paths = pa.array([tree.path(k) + upper for k in range(table.num_rows)], pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())])))
    roots = pa.array([above.column("root")[0].as_py()] * table.num_rows)
    return pa.Table.from_pydict({"tree": table.column("tree"), "block": table.column("at"), "root": roots, "path": paths})


def _folded_rows(table: pa.Table, above: pa.Table, fanout: int, levels: int) -> pa.Table:
    table = table.sort_by("at")
    tree = _subtree(table, fanout, levels, 0)
    upper = above.column("path")[0].as_py()
    # Many leaves fold to the same root of the block; each is carried up once.
    folded, which = np.unique(tree.fold(from_hex(table.column("replaced").to_pylist())), axis=0, return_inverse=True)
    folded = fold_path(folded, upper)[which.ravel()]
    rest = proof_text(upper)
    proofs = [hashlib.sha256(own + rest).hexdigest() for own in tree.siblings()]
    return pa.Table.from_pydict(
        {
            "row": table.column("row"),
            "leaf": table.column("digest"),
            "tree": table.column("tree"),
            "root": pa.array([above.column("root")[0].as_py()] * table.num_rows),
            "proof_sha256": proofs,
            "folded_root": to_hex(folded),
        }
    )


def _by_block(nodes: DataFrame, width: int) -> list[Column]:
    return [F.col("tree"), F.floor(F.col("at") / width).cast("long").alias("block")]


class Manifest:
    """Trees over numbered leaves (tree, at, size, digest, ...): `roots` has one row per
    tree; `tiers` the nodes at the bottom of each tier, in the shared folder."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS):
        ship_package(leaves.sparkSession)
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels
        self.tiers = [leaves]
        largest = leaves.agg(F.max("size")).first()[0] or 1
        for tier in range(max(1, -(-depth_of(largest, fanout) // levels))):
            nodes = self.tiers[-1].select("tree", "at", "size", "digest")
            up = nodes.groupBy(*_by_block(nodes, self.width)).applyInArrow(
                _root_of(fanout, levels, tier), "tree string, at long, size long, digest string"
            )
            self.tiers.append(cut_lineage(up))
        self.roots = self.tiers[-1].select("tree", F.col("digest").alias("root"))

    def _down(self, paths: DataFrame, lowest: int) -> DataFrame:
        """Paths of the nodes at the bottom of tier `lowest`, from those of the roots."""
        fanout, levels = self.fanout, self.levels
        for tier in reversed(range(lowest, len(self.tiers) - 1)):
            nodes = self.tiers[tier].select("tree", "at", "size", "digest")
            work = lambda key, a, b, tier=tier: _path_rows(key, a, b, fanout, levels, tier)
            made = nodes.groupBy(*_by_block(nodes, self.width)).cogroup(paths.groupBy("tree", "block"))
            paths = cut_lineage(made.applyInArrow(_joined(work), f"tree string, block long, root string, path {_PATH}"))
        return paths

    def paths(self, above: DataFrame | None = None, lowest: int = 0) -> DataFrame:
        """(tree, block, root, path) of every node at the bottom of tier `lowest`; `above`
        has the paths (tree, path) of the roots, if the trees are part of a larger one."""
        if above is None:
            tops = self.roots.withColumn("path", F.array().cast(_PATH))
        else:
            tops = self.roots.join(above, "tree")
        return self._down(tops.select("tree", F.lit(0).cast("long").alias("block"), "root", "path"), lowest)

    def fold(self, above: DataFrame | None = None) -> DataFrame:
        """(row, leaf, tree, root, proof_sha256, folded_root) per leaf: the root of its tree,
        the hash of the siblings up to the top, and the top that follows from them and from
        its `replaced` digest."""
        fanout, levels = self.fanout, self.levels
        leaves = self.tiers[0].select("tree", "at", "size", "digest", "replaced", "row")
        paths = self.paths(above, lowest=1)
        made = leaves.groupBy(*_by_block(leaves, self.width)).cogroup(paths.groupBy("tree", "block"))
        work = lambda key, a, b: _folded_rows(a, b, fanout, levels)
        return made.applyInArrow(_joined(work), "row long, leaf string, tree string, root string, proof_sha256 string, folded_root string")


def _joined(work):
    def of(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return work(key, left, right)

    return of


def source_key(source: Column) -> Column:
    """A name that is never null and sorts null first, then by UTF-8 bytes."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("s"), source))


def dataset_manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Folds every leaf into the root of the dataset.

    `leaves` has id, source, digest and replaced: digests in hex, `replaced` the one to
    verify in the place of `digest`. Per source, leaves ascend by id (null ids last), then
    by digest and `replaced`; sources are ordered null first, then by bytes, and their roots
    are the leaves of a last tree. Returns id, source, leaf, subroot, root, proof_sha256,
    folded_root and verified (the folded root is the root), one row per leaf, repeated ones
    included. A run of one child is hashed like any other while its level has several nodes;
    a lone leaf is its source's subroot, a lone source's subroot the root. Null sources form
    a source of their own. An empty table gives no rows.
    """
    ship_package(leaves.sparkSession)
    rows = leaves.select(source_key(F.col("source")).alias("tree"), F.col("id").cast("long").alias("row"), "digest", "replaced")
    numbered = cut_lineage(number_leaves(cut_lineage(rows), [F.asc_nulls_last("row"), F.asc("digest"), F.asc("replaced")]))
    by_source = Manifest(numbered, fanout, levels)
    named = by_source.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    subroots = cut_lineage(number_leaves(named, [F.asc("source")]))
    over = Manifest(subroots, fanout, levels)
    # The path of a source's root, for its leaves.
    places = subroots.select("source", "tree", F.col("at").alias("block"))
    above = cut_lineage(places.join(over.paths(), ["tree", "block"]).select(F.col("source").alias("tree"), "path"))
    top = over.roots.first()
    root = F.lit(top["root"] if top else None).cast("string")
    return by_source.fold(above).select(
        F.col("row").alias("id"),
        F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).alias("source"),
        "leaf",
        F.col("root").alias("subroot"),
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
