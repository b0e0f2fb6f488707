"""A Merkle manifest of a dataset: one tree for each source, one above the sources, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Children of a node.
ARITY = 16
#: Levels of an aligned block: a task walks through ARITY ** LEVELS nodes at a time.
LEVELS = 3
#: The columns that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's checksum it divides are tampered with by the query.
TAMPERED = 5


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row's values: each is - if null, and else its length in UTF-8 bytes, a colon, and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in columns)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int, arity: int = ARITY) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class TreeHash:
    """Computes the nodes of one level out of leaves that come one by one, with at most ``arity`` digests waiting on each level below."""

    def __init__(self, level: int, arity: int):
        self.arity, self.stack, self.nodes = arity, [[] for _ in range(level)], []

    def add(self, leaf: str) -> None:
        """Take the next leaf, and close each node that is full with it."""
        node = leaf
        for waiting in self.stack:
            waiting.append(node)
            if len(waiting) < self.arity:
                return
            node = parent(waiting)
            waiting.clear()
        self.nodes.append(node)

    def close(self) -> None:
        """No leaf comes any more: close the last node, which may have fewer children on each level."""
        for level, waiting in enumerate(self.stack):
            if waiting:
                node = parent(waiting)
                waiting.clear()
                (self.stack[level + 1] if level + 1 < len(self.stack) else self.nodes).append(node)


def block_root(leaves: list[str], levels: int, arity: int = ARITY) -> str:
    """The node ``levels`` above all leaves of an aligned block."""
    tree = TreeHash(levels, arity)
    for leaf in leaves:
        tree.add(leaf)
    tree.close()
    return tree.nodes[0]


def authentication_paths(leaves: Callable[[int], str], n: int, levels: int, arity: int = ARITY) -> Iterator[list[tuple[list[str], int]]]:
    """For each of n leaves of a block, (run, place) on each level: the nodes that are hashed together, and which of them is above the leaf.

    Each level holds its present run, and a tree hash that makes the next run
    while the present one is walked through, one leaf for each leaf, so that
    it is ready in time.  What is held is 2 * arity digests for each level and
    those waiting below, whatever the block's size.
    """
    run: list[list[str]] = []
    ahead: list[tuple[TreeHash, int]] = []
    for level in range(levels):
        first, end = TreeHash(level, arity), min(n, arity ** (level + 1))
        for i in range(end):
            first.add(leaves(i))
        first.close()
        run.append(first.nodes)
        ahead.append((TreeHash(level, arity), end))
    for i in range(n):
        for level in range(levels):
            span = arity ** (level + 1)
            tree, at = ahead[level]
            if i and i % span == 0:
                tree.close()
                run[level], tree = tree.nodes, TreeHash(level, arity)
            if at < n:
                tree.add(leaves(at))
                at += 1
            ahead[level] = (tree, at)
        yield [(run[level], i // arity**level % arity) for level in range(levels)]


@dataclass(frozen=True)
class Manifest:
    """leaves(tree, block, at, n, id, leaf, claim): row ``at`` of the n of its tree
    blocks(tree, block, levels, path, subroot, root): path is what lies above the block, level by level

    tree is = and the source, or empty if that is null.
    """

    leaves: DataFrame
    blocks: DataFrame
    arity: int
    levels: int


_PATH = "array<struct<left:string,right:string>>"
_ROOTS = "tree string, block long, digest string"


def _numbered(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves (tree, id, leaf, claim) with at, their place in their tree, and n, its size.

    Rows are sorted across tasks by range; each task counts the rows of each
    tree, and a running sum over these counts places its first one.
    """
    order = ["tree", "id", "leaf"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(ranged.withColumn("task", F.shiftright("row", 33)))
    counts = rows.groupBy("tree", "task").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.write(counts.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("tree"))}))
    placed = rows.join(counts, ["tree", "task"])
    return placed.select("tree", (F.col("row") - F.col("first") + F.col("before")).alias("at"), "n", "id", "leaf", "claim")


def _roots(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, block, digest): the node above each block of nodes (tree, block, at, n, digest)."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        up = min(levels, height(int(rows["n"].iloc[0]), arity))
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "digest": [block_root(rows.sort_values("at")["digest"].tolist(), up, arity)]})

    return nodes.select("tree", "block", "at", "n", "digest").groupBy("tree", "block").applyInPandas(root, _ROOTS)


def _sides(path: list[tuple[list[str], int]]) -> list[dict]:
    return [{"left": "".join(run[:place]), "right": "".join(run[place + 1 :])} for run, place in path]


def _above(nodes: DataFrame, upper: DataFrame | None, arity: int, levels: int) -> DataFrame:
    """(tree, at, path) of nodes (tree, block, at, n, digest): their path in their block, and then their block's in upper (tree, at, path)."""

    def walk(rows: pd.DataFrame, up: list) -> pd.DataFrame:
        rows = rows.sort_values("at")
        digests = rows["digest"].tolist()
        paths = authentication_paths(digests.__getitem__, len(digests), min(levels, height(int(rows["n"].iloc[0]), arity)), arity)
        return pd.DataFrame({"tree": rows["tree"], "at": rows["at"], "path": [_sides(p) + up for p in paths]})

    schema = f"tree string, at long, path {_PATH}"
    nodes = nodes.select("tree", "block", "at", "n", "digest").groupBy("tree", "block")
    if upper is None:
        return nodes.applyInPandas(lambda rows: walk(rows, []), schema)
    # A block has one row above it.
    above = upper.select("tree", F.col("at").alias("block"), "path").groupBy("tree", "block")
    return nodes.cogroup(above).applyInPandas(lambda rows, up: walk(rows, [dict(p) if isinstance(p, dict) else p.asDict() for p in up["path"].iloc[0]]), schema)


def _tower(nodes: DataFrame, arity: int, levels: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree, at, n, digest): the roots (tree, digest), and for each block of nodes what lies above it, (tree, at, path).

    Each round makes one node of each block, so rounds grow with the logarithm
    of the largest tree to the base arity ** levels.
    """
    size = arity**levels
    layers = [scratch.write(nodes.withColumn("block", F.expr(f"at div {size}")))]
    while True:
        roots = _roots(layers[-1], arity, levels)
        sizes = layers[-1].groupBy("tree").agg(F.ceil(F.max("n") / size).cast("long").alias("n"))
        layer = roots.join(sizes, "tree").select("tree", F.col("block").alias("at"), "n", "digest", F.expr(f"block div {size}").alias("block"))
        layers.append(scratch.write(layer))
        if layers[-1].filter("n > 1").isEmpty():
            break
    path = None
    for layer in reversed(layers[1:]):
        path = scratch.write(_above(layer, path, arity, levels))
    return layers[-1].select("tree", "digest"), path


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", claimed: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """The manifest of docs: their leaves, and what lies above each aligned block of them.

    A source's leaves ascend by id (null first), and those of one id by
    digest; rows repeated in full are a leaf each.  Sources are ordered by
    their bytes, null first.  A lone leaf is its source's root.  An empty
    table has no leaves and no root.  Columns other than those named are not
    read.  ``claimed`` replaces columns by what a reader claims they hold; the
    leaf of that is kept beside the true one, as ``claim``.

    A task holds one block of at most arity ** levels digests.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    named = {c: F.col(c) for c in columns}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree")
    claim = leaf_of(list((named | claimed).values())) if claimed else leaf_of(list(named.values()))
    leaves = scratch.write(docs.select(tree, F.col(id_col).alias("id"), leaf_of(list(named.values())).alias("leaf"), claim.alias("claim")))
    leaves = scratch.write(_numbered(leaves, scratch).withColumn("block", F.expr(f"at div {arity**levels}")))
    subroots, above = _tower(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")), arity, levels, scratch)
    # Above the sources: their roots are the leaves of one more tree.
    tops = scratch.write(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("claim")))
    tops = scratch.write(_numbered(tops, scratch).withColumn("block", F.expr(f"at div {arity**levels}")))
    nodes = tops.select("tree", "block", "at", "n", F.col("leaf").alias("digest"))
    root, over = _tower(nodes.drop("block"), arity, levels, scratch)
    over = scratch.write(_above(nodes, over, arity, levels))
    one = F.broadcast(root.withColumnRenamed("digest", "root"))  # a row
    source = tops.join(over, ["tree", "at"]).join(one, "tree").select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("top"), "root")
    blocks = above.join(source, "tree").select("tree", F.col("at").alias("block"), F.concat("path", "top").alias("path"), "subroot", "root")
    return Manifest(leaves, scratch.write(blocks), arity, levels)


def folded(claim: str, path: list[dict]) -> str:
    """The root that a claimed leaf leads to."""
    for side in path:
        claim = parent([side["left"], claim, side["right"]])
    return claim


def proofs(manifest: Manifest, paths: bool = False) -> DataFrame:
    """(tree, at, id, leaf, claim, subroot, root, proof_sha256, folded_root), a row for each leaf, and with ``paths`` its path, about 1 KB for each level.

    proof_sha256 covers all siblings, level by level up to the root;
    folded_root is what the claimed leaf and these siblings lead to.
    """
    arity, levels = manifest.arity, manifest.levels
    kind = manifest.leaves.schema["id"].dataType.simpleString()
    schema = f"tree string, at long, id {kind}, leaf string, claim string, subroot string, root string, proof_sha256 string, folded_root string" + f", path {_PATH}" * paths

    def prove(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("at"), above.iloc[0]
        upper = [dict(p) if isinstance(p, dict) else p.asDict() for p in above["path"]]
        top = "".join(p["left"] + p["right"] for p in upper).encode()
        leaves, proof, roots, whole = rows["leaf"].tolist(), [], [], []
        walk = authentication_paths(leaves.__getitem__, len(leaves), min(levels, height(int(rows["n"].iloc[0]), arity)), arity)
        for leaf, claim, path in zip(leaves, rows["claim"], walk, strict=True):
            own = _sides(path)
            h = hashlib.sha256("".join(p["left"] + p["right"] for p in own).encode())
            h.update(top)
            proof.append(h.hexdigest())
            roots.append(folded(claim, own + upper))
            if paths:
                whole.append(own + upper)
        out = rows[["tree", "at", "id", "leaf", "claim"]].assign(subroot=above["subroot"], root=above["root"], proof_sha256=proof, folded_root=roots)
        return out.assign(path=whole) if paths else out

    keys = ["tree", "block"]
    return manifest.leaves.groupBy(*keys).cogroup(manifest.blocks.groupBy(*keys)).applyInPandas(prove, schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    manifest = merkle_manifest(table(spark, sf_dir, "documents"), claimed={"text": F.when(hit, lower).otherwise(F.col("text"))})
    return proofs(manifest).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _VALUE + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE summed AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
  lambda s, c: list_reduce(range(9), lambda x, k: CASE WHEN k = 0 THEN x ELSE xor(x >> 1, 3988292384 * (x & 1)) END, xor(s, c)))) AS crc FROM documents),
leaves AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"CASE WHEN crc % 5 = 0 THEN {_LOWER} ELSE text END")} AS claim FROM summed),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (SELECT 0 AS level, source, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL SELECT level + 1, source, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, source, pos // 16),
tops AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
uppers AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 15) // 16 FROM uppers WHERE n > 1 GROUP BY level, pos // 16),
sides AS (SELECT a.level, a.source, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
overs AS (SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM uppers a JOIN uppers b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
climb AS (SELECT doc_id, source, pos AS place, leaf, 0 AS level, pos, claim AS fold, '' AS proof FROM placed
  UNION ALL SELECT c.doc_id, c.source, c.place, c.leaf, c.level + 1, c.pos // 16, sha256(s.l || c.fold || s.r), c.proof || s.l || s.r
  FROM climb c JOIN sides s ON c.level = s.level AND c.source IS NOT DISTINCT FROM s.source AND c.pos = s.pos),
reached AS (SELECT c.*, t.subroot, t.pos AS top FROM climb c JOIN tops t ON c.source IS NOT DISTINCT FROM t.source WHERE c.level = (SELECT max(level) FROM nodes x WHERE x.source IS NOT DISTINCT FROM c.source)),
rest AS (SELECT doc_id, source, place, leaf, subroot, 0 AS up, top, fold, proof FROM reached
  UNION ALL SELECT c.doc_id, c.source, c.place, c.leaf, c.subroot, c.up + 1, c.top // 16, sha256(o.l || c.fold || o.r), c.proof || o.l || o.r FROM rest c JOIN overs o ON c.up = o.level AND c.top = o.pos)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.node AS verified FROM rest, uppers u WHERE u.n = 1 AND up = (SELECT max(level) FROM uppers)""",
}
