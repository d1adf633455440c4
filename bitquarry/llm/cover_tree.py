"""Near-duplicate vectors: all pairs with a cosine of at least a threshold, by a cover tree.

On unit vectors ``cos >= c`` is ``distance <= sqrt(2 - 2c)``.  A cover tree has
nested levels whose radii halve: a node's children are centres more than the
next radius apart, the node's own centre among them, and every point of the
node lies within that radius of one of them.  The upper tree's centres are picked from a
sample of ``SAMPLE`` vectors (the smallest hashes), at most ``LEAVES`` of them;
every vector descends to a leaf, and covering radii are the greatest distances
over all vectors, so the bounds hold for the whole table whatever was sampled.
Neighbours in the upper tree form blocks of at most ``BLOCK`` vectors, and in each block the
tree goes on (``nested``) until radii are half the threshold's distance, so the
tree's depth is the data's and not a parameter's.

The dual traversal starts with (root, root), drops a pair of nodes when their
centres are further apart than both covering radii and the threshold, and opens
the node with the larger radius otherwise.  Of leaves that stay, blocks meet if
the shells (least and greatest distance from the leaf's centre) that they hold
of these can.  Tasks take pairs of groups of ``GROUP`` blocks; there the nodes
of two blocks' lower trees are compared by their centres and radii, and only
vectors of nodes that can meet are compared with each other: cosines as a matrix
product in double precision, a stripe of rows at a time.  Exactly equal vectors
are one vertex with a weight, and a task returns counts and a spanning forest of
its links, so groups of near copies cost no row per pair.

Results for odd input: a null, empty or zero vector, or one with a null or
non-finite component links with nothing, like a row with a null id; vectors of
different length never link, and those of the smallest and greatest norms do as all others; rows that repeat an id are separate vectors, each
with its own links and component, whose name is the smallest id in it; an empty table gives an empty result.  ``with_links``
keeps the input's rows, and returns its own columns alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, runs, small_batches
from .components import connected, forest
from .vectors import distances, padded, usable

SAMPLE = 2048
LEAVES = 256
BLOCK = 2048
SLACK = 1e-6

#: Blocks to a group; a task compares two groups.
GROUP = 8
_GROUP_BITS = GROUP.bit_length() - 1

_BLOCKS = "block long, ids binary, weights binary, dims binary, u binary, heads binary, spread binary, own binary, shells array<struct<leaf:int,low:double,high:double>>"
_SHELLS = pa.list_(pa.struct([("leaf", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))


class Tree:
    """Centres by level: ``centers[i]`` is node i's centre; children of each inner node; ``leaves`` in depth-first order."""

    def __init__(self, sample: np.ndarray, most: int):
        self.centers: list[np.ndarray] = [sample[0]]
        self.children: dict[int, list[int]] = {}
        #: Nodes still to split, with their points and radius; the fullest is split first.
        open_ = {0: (np.arange(len(sample)), 2.0)}
        leaves = 1
        while open_:
            node = max(open_, key=lambda n: len(open_[n][0]))
            points, radius = open_.pop(node)
            if len(points) <= 1 or radius < 0.01 or leaves >= most:
                continue
            radius /= 2
            picked = [self.centers[node]]
            near = distances(sample[points], picked[0][None])[:, 0]
            while near.max() > radius and leaves + len(picked) - 1 < most:  # the furthest point is the next centre
                picked.append(sample[points[near.argmax()]])
                near = np.minimum(near, distances(sample[points], picked[-1][None])[:, 0])
            owner = distances(sample[points], np.array(picked)).argmin(1)
            self.children[node] = list(range(len(self.centers), len(self.centers) + len(picked)))
            self.centers += picked
            leaves += len(picked) - 1
            for k, child in enumerate(self.children[node]):
                open_[child] = points[owner == k], radius
        self.leaves: list[int] = []
        stack = [0]
        while stack:
            node = stack.pop()
            stack += reversed(self.children.get(node, []))
            if node not in self.children:
                self.leaves.append(node)
        self.place = {node: i for i, node in enumerate(self.leaves)}

    def descend(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, as its place in ``leaves``, and its distance from the leaf's centre."""
        out, far = np.zeros(len(u), np.int32), np.zeros(len(u))
        stack = [(0, np.arange(len(u)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node not in self.children:
                out[rows], far[rows] = self.place[node], distances(u[rows], self.centers[node][None])[:, 0]
                continue
            owner = distances(u[rows], np.array([self.centers[c] for c in self.children[node]])).argmin(1)
            stack += [(c, rows[owner == k]) for k, c in enumerate(self.children[node])]
        return out, far

    def meeting(self, radii: dict[int, float], reach: float) -> np.ndarray:
        """Dual traversal: which leaves can hold vectors within ``reach`` of each other; ``radii`` by place, without empty leaves."""
        cover: dict[int, float] = {}

        def covering(node: int) -> float:
            if node not in self.children:
                cover[node] = radii.get(self.place[node], -math.inf)
            else:
                apart = distances(np.array([self.centers[c] for c in self.children[node]]), self.centers[node][None])[:, 0]
                cover[node] = max(d + covering(c) for d, c in zip(apart, self.children[node], strict=True))
            return cover[node]

        covering(0)
        apart = distances(np.array(self.centers), np.array(self.centers))
        out = np.zeros((len(self.leaves), len(self.leaves)), bool)
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if min(cover[a], cover[b]) < 0 or apart[a, b] - cover[a] - cover[b] > reach + SLACK:
                continue
            if a not in self.children and b not in self.children:
                i, j = sorted((self.place[a], self.place[b]))
                out[i, j] = True
            elif a == b:
                inner = self.children[a]
                stack += [(x, y) for k, x in enumerate(inner) for y in inner[k:]]
            elif b not in self.children or a in self.children and cover[a] >= cover[b]:
                stack += [(x, b) for x in self.children[a]]
            else:
                stack += [(a, y) for y in self.children[b]]
        return out


def _unit(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, dims = padded(batch.column("v"), width)
        norm = np.linalg.norm(v, axis=1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            far = ~np.isfinite(norm) | (norm < 1e-140)  # squares out of range
            v[far] = np.nan_to_num(v[far] / np.abs(v[far]).max(1, keepdims=True), nan=0.0)
            norm[far] = np.linalg.norm(v[far], axis=1)
        fine = np.flatnonzero(norm > 0)
        u = v[fine] / norm[fine, None] + 0.0
        raw = [x.tobytes() for x in u]
        keys = [hashlib.blake2b(x + int(d).to_bytes(4, "little"), digest_size=16).digest() for x, d in zip(raw, dims[fine], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(fine)), pa.array(keys, pa.binary()), pa.array(dims[fine]), pa.array(raw, pa.binary())], names=["id", "key", "dim", "u"]
        )


def nested(u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cover tree goes on below a leaf of the sampled one, among the unit vectors ``u`` of a block.

    Radii halve down to ``least``.  Of the lowest nodes: the places of their
    centres, their covering radii, and each vector's node.
    """
    apart = np.sqrt(np.maximum(2 - 2 * (u @ u.T), 0))
    heads, spread, own = [], [], np.zeros(len(u), np.int32)
    stack = [(0, np.arange(len(u)), 2.0)]
    while stack:
        center, points, radius = stack.pop()
        near = apart[center, points]
        if radius <= least or len(points) == 1 or near.max() <= least:
            own[points] = len(heads)
            heads.append(center)
            spread.append(near.max())
            continue
        radius /= 2
        picked, owner = [center], np.zeros(len(points), np.int32)
        while near.max() > radius:  # the furthest point is the next centre
            picked.append(points[near.argmax()])
            closer = apart[picked[-1], points]
            owner[closer < near] = len(picked) - 1
            near = np.minimum(near, closer)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(picked) + 1))
        stack += [(c, points[order[cuts[k] : cuts[k + 1]]], radius) for k, c in enumerate(picked)]
    return np.array(heads, np.int32), np.array(spread), own


def opened(x: dict[str, np.ndarray], y: dict[str, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of two blocks in nodes that have a node within ``reach`` in the other; of one block, those that may have any partner."""
    near = x["u"][x["heads"]] @ y["u"][y["heads"]].T
    # Distances as products of unit vectors, against the greatest radius first: few nodes get past it.
    least = lambda radii: 1 - (radii + (reach + SLACK)) ** 2 / 2
    rows = np.flatnonzero(near.max(1) >= least(x["spread"] + y["spread"].max()))
    meet = near[rows] >= least(x["spread"][rows, None] + y["spread"])
    if x is y:  # a lone vector's node need not meet itself
        meet[np.arange(len(rows)), rows] &= np.bincount(x["own"], minlength=len(near))[rows] > 1
    met = np.zeros(len(near), bool)
    met[rows] = meet.any(1)
    return np.flatnonzero(met[x["own"]]), np.flatnonzero(meet.any(0)[y["own"]])


def _pairs_of(x: dict[str, np.ndarray], y: dict[str, np.ndarray], reach: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked vectors in both blocks; of one block with itself each pair in both directions."""
    keep_x, keep_y = opened(x, y, reach)
    other = y["u"][keep_y].T
    found = [np.nonzero(x["u"][keep_x[at : at + 256]] @ other >= threshold) for at in range(0, len(keep_x), 256)]
    if not found:
        return keep_x, keep_x
    r = keep_x[np.concatenate([f[0] + 256 * k for k, f in enumerate(found)])]
    c = keep_y[np.concatenate([f[1] for f in found])]
    ok = x["dims"][r] == y["dims"][c]
    if x is y:
        ok &= r != c
    return r[ok], c[ok]


def links(
    vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, leaves: int = LEAVES, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All usable rows ``(id, key)``, distinct vectors ``(key, rep, low, copies)``, link counts ``(rep, n)`` and a spanning set of links ``(a, b)``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, key, vector)
    width, count = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 1
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    units = rows.mapInArrow(lambda it: _unit(it, width), "id long, key binary, dim int, u binary")
    grouped = units.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.min("dim").alias("dim"), F.min("u").alias("u"))
    # A vector's number is its own, whatever ids its rows have.
    reps = checkpoint(grouped.withColumn("rep", F.monotonically_increasing_id()))
    names = reps.select("key", "rep", "low", "copies")
    picked = reps.orderBy(F.xxhash64("key"), "key").limit(sample).select("u").toPandas()["u"].tolist()
    if not picked:
        return units.select("id", "key"), names, spark.createDataFrame([], "rep long, n long"), spark.createDataFrame([], "a long, b long")
    tree = Tree(np.array([np.frombuffer(x) for x in picked]), leaves)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = np.frombuffer(b"".join(batch.column("u").to_pylist())).reshape(-1, width)
                leaf, far = tree.descend(u)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "copies", "dim", "u")] + [pa.array(leaf), pa.array(far)], names=["rep", "copies", "dim", "u", "leaf", "far"])

    placed = checkpoint(reps.select("rep", "copies", "dim", "u").mapInArrow(descend, "rep long, copies long, dim int, u binary, leaf int, far double"))
    radii = {r["leaf"]: r["far"] for r in placed.groupBy("leaf").agg(F.max("far").alias("far")).collect()}  # at most one per leaf
    meet = tree.meeting(radii, reach)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal number, held
            ids, copies, dims, us, _, _ = zip(*held, strict=True)
            heads, spread, own = nested(np.frombuffer(b"".join(us)).reshape(-1, width), reach / 2)
            row = {"block": [number], "ids": [np.array(ids, np.int64).tobytes()], "weights": [np.array(copies, np.int64).tobytes()]}
            row |= {"dims": [np.array(dims, np.int32).tobytes()], "u": [b"".join(us)], "heads": [heads.tobytes()], "spread": [spread.tobytes()], "own": [own.tobytes()]}
            shells = {}
            for _, _, _, _, leaf, far in held:  # in order of leaf, then distance
                shells[leaf] = (shells.get(leaf, (far,))[0], far)
            row |= {"shells": pa.array([[{"leaf": k, "low": low, "high": high} for k, (low, high) in shells.items()]], _SHELLS)}
            number, held = number + 1, []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if len(held) >= block:
                    yield out()
                held.append(row)
        if held:
            yield out()

    order = ["leaf", "far", "rep"]
    # About one group of blocks to a partition, so that groups are full.
    sorted_ = placed.repartitionByRange(max(1, math.ceil(count / (block * GROUP))), *order).sortWithinPartitions(*order)
    blocks = checkpoint(sorted_.select("rep", "copies", "dim", "u", "leaf", "far").mapInArrow(pack, _BLOCKS))

    # Blocks that can meet: by the traversal's leaves, then by the shells that each block holds of them.
    shells = blocks.select("block", F.explode("shells").alias("s")).select("block", "s.*")
    i, j = np.nonzero(meet)
    apart = distances(np.array([tree.centers[n] for n in tree.leaves]), np.array([tree.centers[n] for n in tree.leaves]))
    apart[np.arange(len(apart)), np.arange(len(apart))] = 0
    meeting = spark.createDataFrame(pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "apart": pa.array(apart[i, j])}))  # at most LEAVES squared
    a = shells.select(F.col("block").alias("x"), F.col("leaf").alias("i"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
    b = shells.select(F.col("block").alias("y"), F.col("leaf").alias("j"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    gap = F.greatest(F.col("apart") - F.col("x_high") - F.col("y_high"), F.col("x_low") - F.col("apart") - F.col("y_high"), F.col("y_low") - F.col("apart") - F.col("x_high"))
    near = meeting.join(a, "i").join(b, "j").filter(gap <= reach + SLACK).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    # A task compares two groups of GROUP neighbouring blocks, so a block moves once for each group that it can meet.
    task = F.struct(F.shiftright("x", _GROUP_BITS).alias("gx"), F.shiftright("y", _GROUP_BITS).alias("gy"))
    dealt = near.select(task.alias("g"), F.explode(F.array("x", "y")).alias("block")).distinct().select(F.xxhash64("g.gx", "g.gy").alias("task"), "g.gx", "g.gy", "block")
    parts = ["ids", "weights", "dims", "u", "heads", "spread", "own"]
    kinds = dict(zip(parts, (np.int64, np.int64, np.int32, float, np.int32, float, np.int32), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "task"):
            tasks = part.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1), len(tasks)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                own = part.slice(low, high - low).sort_by([("gx", "ascending"), ("gy", "ascending"), ("block", "ascending")])
                held = []
                for row in own.to_pylist():
                    held.append({c: np.frombuffer(row[c], kind) for c, kind in kinds.items()} | {"block": row["block"], "g": (row["gx"], row["gy"])})
                    held[-1]["u"] = held[-1]["u"].reshape(-1, width)
                for x, y in ((x, y) for n, x in enumerate(held) for y in held[n:] if x["g"] == y["g"]):
                    gx, gy = x["g"]
                    if (x["block"] >> _GROUP_BITS, y["block"] >> _GROUP_BITS) != (gx, gy):
                        continue
                    r, c = _pairs_of(x, y, reach, threshold)
                    if not len(r):
                        continue
                    n = np.bincount(r, y["weights"][c], len(x["ids"])).astype(np.int64)
                    if x is y:
                        vertices, counts, label = x["ids"], n, forest(r, c, len(n))
                    else:
                        m = np.bincount(c, x["weights"][r], len(y["ids"])).astype(np.int64)
                        vertices, counts = np.concatenate([x["ids"], y["ids"]]), np.concatenate([n, m])
                        label = forest(r, c + len(n), len(vertices))
                    at = np.flatnonzero(counts > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(vertices[at]), pa.array(counts[at]), pa.array(vertices[label[at]])], names=["rep", "n", "other"])

    sent = dealt.join(blocks.select("block", *parts), "block").select("task", "gx", "gy", "block", *parts)
    found = checkpoint(sent.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "rep long, n long, other long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    return units.select("id", "key"), names, counts, found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def with_links(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", **how: int) -> DataFrame:
    """Per row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept``."""
    members, names, counts, edges = links(vectors, threshold, key, vector, **how)
    groups = connected(edges).withColumnRenamed("id", "rep")
    lows = groups.join(names, "rep").groupBy("component").agg(F.min("low").alias("least"))
    known = names.join(counts, "rep", "left").join(groups.join(lows, "component").select("rep", "least"), "rep", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component"))
    good = members.join(known, "key").select("id", "n_links", "component")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    bad = rows.filter(~fine | F.col("id").isNull() | ~F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return good.unionAll(bad).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
