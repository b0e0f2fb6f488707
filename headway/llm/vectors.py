"""Near-duplicate embeddings through a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components

#: Least cosine of a link.
COSINE = 0.95
TREES, SEED = 8, 11
#: Vectors per leaf that the trees' depth aims at, and how many standard deviations of the projected distance of a barely linked pair spill to both sides.
LEAF, SPILL = 256, 0.5
#: A node is not split further if this share of its sample's pairs is linked, judged on SEEN_MOST rows at most.
DENSE, SEEN_MOST = 0.25, 64
#: A node is not split further, either, if more of its sample than this share lies so near the split that it goes to both sides: beyond 0.41 the two parts take more comparisons than the whole.
BOTH = 0.3
#: Sample rows that the deepest nodes of the first splits have on average, at least.
SEEN = 8
#: Levels that the first splits go down at most.
DEEPEST = 11
#: Vectors that the first splits are fitted on, at most; every vector is indexed.  These splits go down DEEPEST levels at most, so every task can hold them.
SAMPLE = 20_000
#: Vectors of a leaf compared in one task; a larger leaf is split again, LEVELS at a time, on about NODE_SAMPLE vectors of its own, and compared block against block if it is dense.
BLOCK, LEVELS, NODE_SAMPLE = 2048, 4, 512


def _dense(x: np.ndarray, cosine: float) -> bool:
    """Whether DENSE of the pairs of a node's sample are linked."""
    x = x[np.linspace(0, len(x) - 1, min(len(x), SEEN_MOST)).astype(np.int64)]
    return bool((x @ x.T >= cosine).sum() - len(x) >= DENSE * len(x) * (len(x) - 1))


def _spills(p: np.ndarray, cut: float, margin: float) -> bool:
    """Whether a split leaves too much of a node's sample on both sides, beyond what chance does to a small sample."""
    return (np.abs(p - cut) <= margin).sum() > BOTH * len(p) + 0.3 * math.sqrt(len(p))


class Forest:
    """One random direction for each tree and level; in each node a threshold near the middle of its sample, and a spill margin.

    A node full of linked pairs is a leaf whatever its size: a split would part
    them, and its leaf is compared block by block at a cost in proportion to
    its links.  So is one whose vectors are so near each other, linked or not,
    that a split puts too many on both sides.
    """

    def __init__(self, sample: np.ndarray, count: int, seed: int = SEED, cosine: float = COSINE):
        self.depth = max(0, math.ceil(math.log2(max(count, 1) / LEAF)))
        most = max(0, math.floor(math.log2(max(len(sample), 1) / SEEN))) if len(sample) < count else self.depth
        #: Whether leaves are larger than the depth should make them, and need further splits.
        most = min(most, DEEPEST)
        self.depth, self.deep = min(self.depth, most), self.depth > most
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.directions = rng.standard_normal((TREES, self.depth, dim)) / math.sqrt(dim)
        self.thresholds, self.margins = [], []
        margin = SPILL * math.sqrt(2 * max(1 - cosine, 0)) / math.sqrt(dim)
        for t in range(TREES):
            nodes, whole = np.zeros(len(sample), np.int64), np.zeros(1, bool)
            for level in range(self.depth):
                p = sample @ self.directions[t, level]
                # The recursion's random part: each split falls at a random quantile between 0.4 and 0.6.
                order = np.lexsort((p, nodes))
                sizes = np.bincount(nodes, minlength=1 << level)
                firsts = np.cumsum(sizes) - sizes
                at = np.minimum(firsts + (sizes * rng.uniform(0.4, 0.6, 1 << level)).astype(np.int64), len(p) - 1)
                filled = sizes > 0
                cut = np.where(filled, p[order][at], 0.0)
                for node in np.flatnonzero((sizes > 1) & ~whole):
                    own = order[firsts[node] : firsts[node] + sizes[node]]
                    whole[node] = _spills(p[own], cut[node], margin) or _dense(sample[own], cosine)
                # All of a whole node goes to the left, down to the last level.
                self.thresholds.append(np.where(whole, np.inf, cut))
                self.margins.append(np.where(whole, 0.0, margin))
                nodes = 2 * nodes + (p > self.thresholds[-1][nodes])
                whole = np.stack([whole, np.zeros_like(whole)], axis=1).ravel()

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, home) of all leaves that rows are in, by row and home."""
        found = [(r, _name(np.int64(t), self.depth, n)) for t, (r, n) in enumerate(self.leaves(x))]
        rows, home = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((home, rows))
        return rows[order], home[order]

    def leaves(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree, rows and the leaves they are in; a row near a split is on both sides."""
        for t in range(TREES):
            rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = x[rows] @ self.directions[t, level] if level == 0 else (x @ self.directions[t, level])[rows]
                cut, margin = self.thresholds[t * self.depth + level][nodes], self.margins[t * self.depth + level][nodes]
                left, right = p <= cut + margin, p > cut - margin
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            yield rows, nodes


def _direction(dim: int, tree: int, level: int) -> np.ndarray:
    """The direction of a tree's level below the first splits."""
    return np.random.default_rng([SEED, dim, tree, level]).standard_normal(dim) / math.sqrt(dim)


def _name(tree: np.ndarray, depth: int, path: np.ndarray) -> np.ndarray:
    """A node's number: its tree, and its path below a leading one."""
    return (tree << 56) | (1 << depth) | path


def _tree_and_depth(home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return home >> 56, np.frexp((home & ((1 << 56) - 1)).astype(np.float64))[1].astype(np.int64) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(vectors: np.ndarray, dim: int, forests: dict[int, Forest]) -> tuple[np.ndarray, np.ndarray]:
    """(row, home) of vectors of one length; those of lengths without a forest share one leaf."""
    if dim in forests:
        return forests[dim].homes(vectors)
    return np.arange(len(vectors)), np.full(len(vectors), _name(np.int64(0), 0, np.int64(0)))


def _indexed(vectors: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(dim, home, id, copies, vector): each vector in each of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows, home = _homes(_unit(_matrix(part.column("vector"))), int(dim), forests)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(home), *(part.column(c).take(take) for c in ("id", "copies", "vector"))], ["dim", "home", "id", "copies", "vector"])

    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    return vectors.mapInArrow(run, f"dim int, home long, id long, copies long, vector array<{kind}>")


def _node_splits(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(dim, home, cuts) of a node's sample: the thresholds of LEVELS further levels, node by node; none of a node that is not to be split, which is a leaf."""
    dim, home = int(rows["dim"].iloc[0]), int(rows["home"].iloc[0])
    (tree,), (depth,) = _tree_and_depth(np.array([home]))
    x, rng = _unit(np.stack(rows.sort_values("id", kind="stable")["vector"].to_numpy()).astype(np.float64)), np.random.default_rng([SEED, home])
    margin = SPILL * math.sqrt(2 * max(1 - cosine, 0)) / math.sqrt(dim)
    cuts, nodes = np.full((1 << LEVELS) - 1, np.inf), np.zeros(len(x), np.int64)
    for level in range(LEVELS):
        p = x @ _direction(dim, int(tree), int(depth) + level)
        for node in range(1 << level):
            own = np.flatnonzero(nodes == node)
            if len(own) > 1 and not _dense(x[own], cosine):
                cut = np.quantile(p[own], rng.uniform(0.4, 0.6))
                cuts[(1 << level) - 1 + node] = np.inf if _spills(p[own], cut, margin) else cut
        nodes = 2 * nodes + (p > cuts[(1 << level) - 1 + nodes])
    return pd.DataFrame({"dim": [dim], "home": [home], "cuts": [cuts if np.isfinite(cuts[0]) else None]})


def _refined(placed: DataFrame, cosine: float, block: int, scratch: Scratch) -> DataFrame:
    """placed (dim, home, id, copies, vector), with homes, after every leaf over ``block`` vectors is split further where that makes it smaller.

    A round samples each such leaf by a hash, fits its splits in a task of its
    own, and sends its vectors down by a join; a leaf without a split is done,
    and the others go on.  Rounds grow with the logarithm of the largest leaf.
    """
    done, open_, depth = [], placed, DEEPEST
    while depth + LEVELS <= 55:  # bits of a path
        sizes = scratch.write(open_.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block))
        chosen = open_.join(sizes, ["dim", "home"]).filter(F.pmod(F.xxhash64("home", "id"), F.col("n")) < NODE_SAMPLE).select("dim", "home", "id", "vector")
        splits = scratch.write(chosen.groupBy("dim", "home").applyInPandas(lambda rows: _node_splits(rows, cosine), "dim int, home long, cuts array<double>").filter("cuts is not null"))
        if splits.isEmpty():
            break
        done.append(open_.join(splits, ["dim", "home"], "left_anti"))
        open_, depth = scratch.write(_descended(open_.join(splits, ["dim", "home"]), cosine)), depth + LEVELS
    rows = scratch.write(reduce(DataFrame.unionByName, [d.select("dim", "home", "id", "copies", "vector") for d in (*done, open_)]))
    return rows.join(rows.groupBy("id").agg(F.sort_array(F.collect_set("home")).alias("homes")), "id")


def _descended(rows: DataFrame, cosine: float) -> DataFrame:
    """rows (dim, home, id, copies, vector, cuts) in the leaves below their homes; a row near a split is on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, homes = batch.column("dim").to_numpy(), batch.column("home").to_numpy()
            trees, depths = _tree_and_depth(homes)
            for dim, tree, depth in np.unique(np.stack([dims, trees, depths]), axis=1).T.tolist():
                part = batch.filter(pa.array((dims == dim) & (trees == tree) & (depths == depth)))
                x, cuts = _unit(_matrix(part.column("vector"))), _matrix(part.column("cuts"))
                margin = SPILL * math.sqrt(2 * max(1 - cosine, 0)) / math.sqrt(dim)
                at, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
                for level in range(LEVELS):
                    p, cut = (x @ _direction(dim, tree, depth + level))[at], cuts[at, (1 << level) - 1 + nodes]
                    left, right = p <= cut + margin, p > cut - margin
                    at, nodes = np.concatenate([at[left], at[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
                path = part.column("home").to_numpy()[at] & ((1 << 56) - 1)
                home = (tree << 56) | (path << LEVELS) | nodes
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("dim").take(take), pa.array(home), *(part.column(c).take(take) for c in ("id", "copies", "vector"))], ["dim", "home", "id", "copies", "vector"])

    kind = rows.schema["vector"].dataType.elementType.simpleString()
    return rows.select("dim", "home", "id", "copies", "vector", "cuts").mapInArrow(run, f"dim int, home long, id long, copies long, vector array<{kind}>")


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n indexes reaches over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _share_one(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 4096) -> np.ndarray:
    """Whether the sets a[i] and b[i] have a number in common: as bits, ``width`` numbers at a time, of those that several sets hold."""
    known, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), [len(e) for e in sets]), np.cumsum(often > 1) - 1
    keep = (often > 1)[flat]
    owner, column, out = owner[keep], shared[flat[keep]], np.zeros(len(a), bool)
    for first in range(0, int((often > 1).sum()), width):
        here = (column >= first) & (column < first + width)
        member = np.zeros((len(sets), width), bool)
        member[owner[here], column[here] - first] = True
        bits = np.packbits(member, axis=1).view(np.uint64)
        for k in range(0, len(a), 16384):
            out[k : k + 16384] |= (bits[a[k : k + 16384]] & bits[b[k : k + 16384]]).any(axis=1)
    return out


def _compare(rows: pd.DataFrame, cosine: float, forests: dict[int, Forest]) -> pd.DataFrame:
    """(id, links, root) of the linked vectors of a leaf or of two of its blocks.

    A pair counts in the first leaf that its vectors share, and nowhere else:
    the leaves of both are computed again here, or, where leaves were split
    further, listed in homes.
    """
    home, dim = int(rows["home"].iloc[0]), int(rows["dim"].iloc[0])
    rows = rows.sort_values("id", kind="stable")
    side = rows["second"].to_numpy()
    x, ids, copies = _unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)), rows["id"].to_numpy(), rows["copies"].to_numpy()
    mixed = bool(side.any()) and not bool(side.all())
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if mixed else (np.arange(len(x)),) * 2
    out = {"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
    if "homes" in rows.columns:
        earlier = [np.asarray(h)[np.asarray(h) < home] for h in rows["homes"]]
    else:
        at, homes = _homes(x, dim, forests)
        at, homes = at[homes < home], homes[homes < home]
        earlier = np.split(homes, np.cumsum(np.bincount(at, minlength=len(x)))[:-1])
    if any(map(len, earlier)) and (np.unique(np.concatenate(earlier), return_counts=True)[1] == len(x)).any():
        return pd.DataFrame(out)  # all share an earlier leaf
    pairs = []
    for k in range(0, len(left), 512):
        i, j = np.nonzero(x[left[k : k + 512]] @ x[right].T >= cosine)
        i, j = left[k + i], right[j]
        pairs.append((i, j) if mixed else (i[i < j], j[i < j]))
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
    if len(a):
        first = ~_share_one(earlier, a, b)
        links = np.bincount(a[first], copies[b[first]], len(x)) + np.bincount(b[first], copies[a[first]], len(x))
        root = _local_roots(a, b, len(x))
        some = np.unique(np.concatenate([a, b]))
        out = {"id": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]}
    return pd.DataFrame(out)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of vectors.

    Equal vectors are one class, of which the smallest id goes through the
    forest; n_links counts all rows of the classes linked.  Vectors that are
    null, empty, zero, or hold null or non-finite components, and rows without
    an id, link with nothing and stay.  Vectors of different lengths never
    link.  An id that is there with several vectors is as many rows, each with
    the links of its own vector.  An empty table gives no rows; other columns
    are not read.

    The first splits are fitted on ``sample`` vectors, later ones on a sample
    of each leaf that still has more than ``block``.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("usable", _usable(F.col("vector")) & F.col("id").isNotNull())
    classes = rows.filter("usable").groupBy("vector").agg(F.min("id").cast("long").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vector"))
    # A class has a number of its own, as an id may be there with several vectors; written, so that it stays.
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()))
    forests = {}
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF).collect():
        chosen = classes.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(SEED), F.col("vector")), "first").limit(sample).select("vector").toPandas()["vector"]
        forests[r["dim"]] = Forest(_unit(np.stack(chosen.to_numpy()).astype(np.float64)), r["n"], cosine=cosine)
    placed = _indexed(classes, forests)
    # A table whose leaves the first splits make small enough is not split again.
    if any(f.deep for f in forests.values()):
        placed = _refined(scratch.write(placed), cosine, block, scratch)
    # A leaf over ``block`` vectors is cut into blocks by a hash of the id, and each pair of blocks is compared on its own.
    sizes = placed.groupBy("dim", "home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    placed = placed.join(scratch.write(sizes), ["dim", "home"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "second": F.col("block") > F.col("other")}).drop("blocks", "block", "other")
    found = scratch.write(placed.groupBy("dim", "home", "i", "j").applyInPandas(lambda p: _compare(p, cosine, forests), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = scratch.write(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch))
    # A component is called by its smallest id.
    called = scratch.write(named.join(classes.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id")))
    named = named.join(called, "component").select(F.col("node").alias("id"), "component_id")
    result = classes.join(links, "id", "left").join(named, "id", "left").select(
        F.col("vector").alias("class_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
    )
    linked = rows.filter("usable").join(result, F.col("vector") == F.col("class_vector")).select("id", "n_links", "component_id")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op5_vector_dedup": op5_vector_dedup}
ORACLE_SQL = {
    "op5_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT p.b, r.reach FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
}
