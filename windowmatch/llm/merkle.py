"""A Merkle manifest of a dataset: one tree per language over its documents, one tree over the languages.

Every node is the hash of up to ``ARITY`` consecutive nodes of the level below; a level of one node is
the root. Proofs are made by an octopus multiproof:

* Leaves are numbered in their tree and cut into partitions of ``ARITY ** DEPTH`` consecutive ones.
* The tree is built from the bottom in strides of ``DEPTH`` levels. A partition of leaves reduces
  itself to the one node above it; the levels above are a table of nodes by coordinates
  (tree, level, place), a few thousandths of the leaves.
* A leaf partition knows from its first and last leaf and the size of the tree which nodes the proofs
  of all its leaves need and which of them it can derive itself. The others are the minimal union of
  missing coordinates, fetched once, by one join of (partition, coordinate) with the nodes.
* In the task of the partition the shared interior nodes are derived once, and the proofs of the single
  leaves are read off and checked there.

No task holds more than one partition of leaves, or one run of ``ARITY ** DEPTH`` nodes, of a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged
from windowmatch.operators.numbering import numbered

ARITY = 8
#: Levels that a leaf partition, or a run of nodes, is reduced by at a time.
DEPTH = 4
#: The tree whose leaves are the roots of all other trees.
TOP = -1
#: Nodes of the highest levels that are broadcast; beyond that they are joined like the others.
MOST_BROADCAST = 100_000

#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(inputs: Sequence[str]) -> str:
    """Lowercase hexadecimal SHA-256 of the inputs, concatenated."""
    return sha256("".join(inputs).encode()).hexdigest()


def levels(size: int, arity: int = ARITY) -> list[int]:
    """How many nodes each level of a tree of ``size`` leaves has, leaves first."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def reduce_run(nodes: Sequence[str], depth: int, arity: int = ARITY) -> list[list[str]]:
    """The nodes and the ``depth`` levels above them, lowest first."""
    found = [list(nodes)]
    for _ in range(depth):
        below = found[-1]
        found.append([digest(below[i : i + arity]) for i in range(0, len(below), arity)])
    return found


def missing(first: int, last: int, size: int, arity: int = ARITY) -> list[tuple[int, int]]:
    """The least set of (level, place) that proofs of the leaves ``first`` to ``last`` need from outside.

    These are the nodes beside the run of known nodes, in the runs of its first and its last node,
    level by level up to the root; what lies inside is derived from the leaves and from lower nodes.
    """
    found = []
    for level, nodes in enumerate(levels(size, arity)[:-1]):
        found += [(level, place) for place in range(first // arity * arity, first)]
        found += [(level, place) for place in range(last + 1, min(last // arity * arity + arity, nodes))]
        first, last = first // arity, last // arity
    return found


@dataclass(frozen=True)
class Known:
    """All nodes around a run of leaves that their proofs need, derived once for the run."""

    sizes: list[int]
    nodes: dict[tuple[int, int], str]

    def siblings(self, place: int, arity: int = ARITY) -> list[tuple[int, list[str]]]:
        """For each level from the leaf up: the place in its run, and the other nodes of the run."""
        path = []
        for level, size in enumerate(self.sizes[:-1]):
            run = range(place // arity * arity, min(place // arity * arity + arity, size))
            path.append((place - run.start, [self.nodes[level, p] for p in run if p != place]))
            place //= arity
        return path


def derive(first: int, leaves: Sequence[str], size: int, fetched: dict[tuple[int, int], str], arity: int = ARITY) -> Known:
    """The interior nodes over a run of leaves, from the leaves and the fetched nodes beside them."""
    sizes, nodes = levels(size, arity), dict(fetched)
    nodes.update(((0, first + i), leaf) for i, leaf in enumerate(leaves))
    last = first + len(leaves) - 1
    for level, count in enumerate(sizes[:-1]):
        for parent in range(first // arity, last // arity + 1):
            run = range(parent * arity, min(parent * arity + arity, count))
            nodes[level + 1, parent] = digest([nodes[level, p] for p in run])
        first, last = first // arity, last // arity
    return Known(sizes, nodes)


def fold(leaf: str, path: Sequence[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings on the way up lead to."""
    for at, others in path:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tampered(key: Column) -> Column:
    """Whether a document belongs to the third that the tampering touches; NULL never does."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _reduced(nodes: DataFrame, base: int, depth: int) -> DataFrame:
    """What lies above the nodes (tree, place, digest, size) of level ``base``, by up to ``depth`` levels.

    Over leaves only the highest node of a run is given: what lies below it is derived again in the
    partitions that need it. ``size`` of the result is the number of nodes of the tree ``depth`` levels up.
    """
    span = ARITY**depth

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        tree, block, size = (k.as_py() for k in key)
        up = min(depth, len(levels(size)) - 1)
        found = reduce_run(rows["digest"].to_pylist(), up)
        wanted = [up] if base == 0 else range(1, up + 1)
        out = [(base + n, block * ARITY ** (depth - n) + i, d) for n in wanted for i, d in enumerate(found[n])]
        level, place, node = zip(*out) if out else ((), (), ())
        return pa.table(
            {
                "tree": pa.array([tree] * len(out), pa.int64()),
                "level": pa.array(level, pa.int32()),
                "place": pa.array(place, pa.int64()),
                "digest": pa.array(node, pa.string()),
                "size": pa.array([-(-size // span)] * len(out), pa.int64()),
            }
        )

    block = F.floor(F.col("place") / span).cast("long").alias("block")
    rows = nodes.select("tree", "place", "digest", "size", block)
    return rows.groupBy("tree", "block", "size").applyInArrow(
        run, "tree long, level int, place long, digest string, size long"
    )


def upper_nodes(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The nodes (tree, level, place, digest) from level ``depth`` up to the roots; of a smaller tree its root.

    ``leaves``: tree, place, digest, and the number of leaves of the tree in ``size``. One written table
    for every ``depth`` levels, each a few thousandths of the one before.
    """
    base, current, found = 0, leaves, None
    while True:
        stride = Staged(_reduced(current, base, depth), "nodes").frame
        found = stride if found is None else found.union(stride)
        base += depth
        current = stride.where((F.col("level") == base) & (F.col("size") > 1))
        if not current.limit(1).count():
            return found.drop("size")


def roots(nodes: DataFrame) -> DataFrame:
    """The root of each tree."""
    return nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))


def fetch(sizes: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The missing nodes (tree, block, level, place, digest) of every partition of leaves.

    ``sizes``: tree, size. Each node is requested by the partitions around it alone, but those of
    the highest levels by very many: these are few, and joined by themselves.
    """
    span = ARITY**depth

    @F.udf("array<struct<level int, place long>>")
    def needed(block, size):
        return missing(block * span, min(block * span + span, size) - 1, size)

    blocks = sizes.select("tree", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / span))).alias("block"))
    wanted = blocks.repartition("tree", "block").select("tree", "block", F.explode(needed("block", "size")).alias("node"))
    wanted = Staged(wanted.select("tree", "block", "node.level", "node.place"), "requests").frame
    key, high = ["tree", "level", "place"], F.col("level") >= 2 * depth
    few = nodes.where(high)
    few = F.broadcast(few) if few.count() <= MOST_BROADCAST else few
    low = wanted.where(~high).join(nodes.where(~high), key)
    return low.unionByName(wanted.where(high).join(few, key)).select("tree", "block", "level", "place", "digest")


PATH = "array<struct<at int, others array<string>>>"


def _expand(leaves: DataFrame, fetched: DataFrame, above: DataFrame, schema: str, describe: Callable, depth: int) -> DataFrame:
    """One cogroup per leaf partition: derive what its proofs share, then describe every leaf.

    ``above``: for each tree the way from its root on, and the root that it leads to.
    """
    span = ARITY**depth
    block = F.floor(F.col("place") / span).cast("long").alias("block")
    sizes = leaves.select("tree", "size").distinct()
    blocks = sizes.select("tree", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / span))).alias("block"))
    onward = blocks.join(above, "tree").select(
        "tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"),
        F.col("digest"), F.col("path"),
    )
    around = fetched.withColumn("path", F.lit(None).cast(PATH)).unionByName(onward)

    def expand(key: tuple, own: pa.Table, outside: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        nodes, way, root = {}, [], None
        for row in outside.select(["level", "place", "digest", "path"]).to_pylist():
            if row["level"] < 0:
                way, root = [(step["at"], step["others"]) for step in row["path"]], row["digest"]
            else:
                nodes[row["level"], row["place"]] = row["digest"]
        first, size = own["place"][0].as_py(), own["size"][0].as_py()
        known = derive(first, own["digest"].to_pylist(), size, nodes)
        subroot = known.nodes[len(known.sizes) - 1, 0]
        paths = [known.siblings(first + i) + way for i in range(own.num_rows)]
        return describe(own, subroot, root, paths)

    return (
        leaves.withColumn("block", block)
        .groupBy("tree", "block")
        .cogroup(around.groupBy("tree", "block"))
        .applyInArrow(expand, schema)
    )


def _paths(paths) -> pa.Array:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    return pa.array([[{"at": at, "others": others} for at, others in path] for path in paths], kind)


def _tree_paths(own: pa.Table, subroot: str, root: str, paths) -> pa.Table:
    """For a leaf of the tree of languages: its way to the root, and the root."""
    return pa.table({"tree": own["place"], "digest": pa.array([subroot] * own.num_rows), "path": _paths(paths)})


def leaves_of(docs: DataFrame, altered: Column | None = None, fields: Sequence[str] = FIELDS, tree_col: str = "lang") -> DataFrame:
    """A staged table of leaves: tree, place, size, key (the first field), digest, and ``altered`` digest.

    ``altered`` replaces the last field in the second digest; without it, both are the same. Rows of
    one key are ordered by their digest; equal rows are leaves of their own.
    """
    columns = [F.col(f"`{f}`") for f in fields]
    leaf = leaf_digest(columns)
    other = leaf if altered is None else leaf_digest([*columns[:-1], altered])
    # a written random number tells equal rows apart, so that they can be many tasks
    rows = docs.select(
        columns[0].alias("key"), F.col(f"`{tree_col}`").alias("lang"), leaf.alias("digest"), other.alias("altered"),
        F.rand(12).alias("salt"),
    )
    rows = Staged(rows, "leaves")
    sizes = rows.frame.groupBy("lang").agg(F.count("*").alias("size"))
    trees = numbered(sizes, [], ["lang"], "tree").withColumnRenamed("lang", "of")
    known = rows.frame.join(trees, F.col("lang").eqNullSafe(F.col("of"))).drop("lang", "of")
    placed = numbered(known, ["tree"], ["key", "digest", "salt"])
    return placed.drop("salt")


def prove(
    docs: DataFrame, altered: Column | None = None, fields: Sequence[str] = FIELDS, tree_col: str = "lang", paths: bool = False,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the siblings from the leaf to the root; ``folded_root`` follows
    from them and the leaf of the document as it is found now, with ``altered`` for its last field;
    ``verified`` says whether that is the root. With ``paths``, the siblings themselves come in ``path``.

    Defined cases: NULL fields count as ``-``; a NULL key comes first in its tree, a NULL language is the
    first tree; repeated rows are leaves of their own; a lone leaf is the root of its tree; an empty
    table gives an empty result; columns that are no field are not read.
    """
    leaves = Staged(leaves_of(docs, altered, fields, tree_col), "places").frame
    nodes = upper_nodes(leaves, depth)
    subroots = Staged(roots(nodes), "subroots").frame
    count = subroots.count()
    top = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest",
        F.lit(count).cast("long").alias("size"),
    )
    top_nodes = upper_nodes(top, depth)
    nothing = top.select("tree").distinct().select("tree", F.lit("").alias("digest"), F.array().cast(PATH).alias("path"))
    fetched = fetch(top.select("tree", "size").distinct(), top_nodes, depth)
    above = _expand(top, fetched, nothing, f"tree long, digest string, path {PATH}", _tree_paths, depth)
    above = Staged(above, "above").frame
    kind = leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def describe(own: pa.Table, subroot: str, root: str, ways) -> pa.Table:
        n = own.num_rows
        folded = [fold(leaf, way) for leaf, way in zip(own["altered"].to_pylist(), ways)]
        columns = {
            "key": own["key"],
            "leaf": own["digest"],
            "subroot": pa.array([subroot] * n),
            "root": pa.array([root] * n),
            "proof_sha256": pa.array([digest([d for _, others in way for d in others]) for way in ways]),
            "folded_root": pa.array(folded),
            "verified": pa.array([f == root for f in folded]),
        }
        return pa.table(columns | ({"path": _paths(ways)} if paths else {}))

    fetched = fetch(leaves.select("tree", "size").distinct(), nodes, depth)
    return _expand(leaves, fetched, above, schema + (f", path {PATH}" if paths else ""), describe, depth)


def verify_tampering(docs: DataFrame) -> DataFrame:
    """``prove`` for documents of which a third, chosen by id, have lost their capital letters A-Z."""
    text = F.when(tampered(F.col("doc_id")), lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return prove(docs, text).withColumnRenamed("key", "doc_id")
