"""Exact top-k search by inner product over a pivot-distance index.

Vectors are quantised to ``floor(scale * x)``.  With ``M`` the greatest squared
norm, ``x' = (x, sqrt(M - |x|^2))`` and ``q' = (q, 0)``, a greater inner product
is a smaller distance ``|q' - x'|``, so triangle inequalities apply.

The index keys each vector by its nearest pivot and the distance to it, sorts
by that key and cuts the order into annuli: up to ``ANNULUS`` vectors of one pivot
with a least and a greatest distance.  Neighbouring annuli are stored in blocks
of at most ``BLOCK`` vectors, with the least and greatest distance of each
annulus from every pivot.  A search has two waves.  The first scores each query
against the block that holds the annulus of its own pivot nearest to it, which gives its
k-th best score so far, hence a radius.  The second opens every block with an annulus
that the triangle inequality leaves within that radius of some query of a block of
queries, and no other.  There each query expands the annuli in ascending order of
their bound (the greatest over all pivots), updates its k-th score, and stops at
the first one beyond its radius.  Products of queries with an annulus are matrix products;
only each pair's best k go on.

The pivots are fitted on ``SAMPLE`` vectors (the smallest hashes of their ids),
as many as the root of the number of vectors, ``PIVOTS`` at least and an eighth of the sample at most;
they affect speed alone.  The index and the answers cover every vector.

Results for odd input: rows with a null id, or a null or empty vector, or one
with a null or non-finite component take no part; vectors of different length
are not compared; rows with the query's id are its own row; other rows that
share an id are ranked each; every query row is answered, so an id that has several
has as many lists, each with ranks from 1; equal scores go to the smaller id; a table without
queries or candidates gives no rows; other columns are ignored.  Scores beyond
a long's range become its limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .vectors import distances, padded, usable

SAMPLE = 4096
PIVOTS = 32
ANNULUS = 256
BLOCK = 2048
QUERY_BLOCK = 1024
SCALE = 1024.0

_KEYED = "pivot int, dist double, id long, row long, dim int, v binary"
_ANNULI = pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("at", pa.int32()), ("end", pa.int32())]))
_BLOCKS = "block long, ids binary, rows binary, dims binary, v binary, annuli array<struct<pivot:int,low:double,high:double,at:int,end:int>>, far binary"
_FOUND = "row long, query_id long, vec_id long, score long"


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """A few rounds of nearest-mean clustering from evenly spaced rows."""
    centers = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(6):
        near = distances(sample, centers).argmin(1)
        for k in range(len(centers)):
            if (near == k).any():
                centers[k] = sample[near == k].mean(0)
    return centers


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None]])


def _raised(v: np.ndarray, top: float, lift: bool) -> np.ndarray:
    return _lift(v, top) if lift else np.hstack([v, np.zeros((len(v), 1))])


def _keyed(rows: DataFrame, width: int, top: float, pivots: np.ndarray, scale: float, lift: bool) -> DataFrame:
    """``rows(id, row, v)`` by nearest pivot and distance."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, dims = padded(batch.column("v"), width)
            v = np.floor(scale * v)
            d = distances(_raised(v, top, lift), pivots)
            near = np.nan_to_num(d, nan=np.inf).argmin(1)
            dist = np.nan_to_num(d[np.arange(len(d)), near], nan=0, posinf=np.finfo(float).max)
            flat = np.ascontiguousarray(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), pa.array(dist), batch.column("id"), batch.column("row"), pa.array(dims), pa.array([x.tobytes() for x in flat], pa.binary())],
                names=["pivot", "dist", "id", "row", "dim", "v"],
            )

    return rows.mapInArrow(key, _KEYED)


def _blocks(keyed: DataFrame, most: int, annulus: int, width: int, top: float, pivots: np.ndarray, lift: bool) -> DataFrame:
    """Runs of at most ``most`` rows in order of pivot and distance, with their annuli."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal number, held
            pivot, dist, ids, rows, dims, v = zip(*held, strict=True)
            cuts = [0]
            for i in range(1, len(held)):
                if pivot[i] != pivot[cuts[-1]] or i - cuts[-1] >= annulus:
                    cuts.append(i)
            ends = [*cuts[1:], len(held)]
            d = distances(_raised(np.frombuffer(b"".join(v)).reshape(-1, width), top, lift), pivots)
            far = np.stack([np.minimum.reduceat(d, cuts), np.maximum.reduceat(d, cuts)])
            annuli = [{"pivot": pivot[a], "low": dist[a], "high": dist[b - 1], "at": a, "end": b} for a, b in zip(cuts, ends, strict=True)]
            row = {"block": [number], "ids": [np.array(ids, np.int64).tobytes()], "rows": [np.array(rows, np.int64).tobytes()], "dims": [np.array(dims, np.int32).tobytes()]}
            row |= {"v": [b"".join(v)], "annuli": pa.array([annuli], _ANNULI), "far": [np.nan_to_num(far).tobytes()]}
            number, held = number + 1, []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if len(held) >= most:
                    yield out()
                held.append(row)
        if held:
            yield out()

    order = ["pivot", "dist", "id"]
    return checkpoint(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCKS))


def _matrix(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["dims"], np.int32), np.frombuffer(row["v"]).reshape(-1, width)


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: by doubles where all sums stay below 2**53, else by Python's integers."""
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = [[int(y) for y in row] for row in x]
    top = (1 << 63) - 1
    return np.array([[max(~top, min(top, sum(int(a) * b for a, b in zip(r, y, strict=True)))) for y in whole] for r in q], np.int64).reshape(len(q), len(x))


def _radii(q: np.ndarray, scores: np.ndarray, top: float) -> np.ndarray:
    """How far a vector may be from each query to reach its score; a little more, beyond rounding."""
    square = (q * q).sum(1) + top - 2 * scores
    return np.sqrt(np.maximum(square, 0)) + 1e-6 * (1 + np.sqrt(top))


def bounds(d: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Per query (its distances ``d`` from the pivots) and annulus: no vector of it can be nearer."""
    low, high = far
    out = np.zeros((len(d), len(low)))
    for k in range(len(low)):
        out[:, k] = np.maximum(low[k] - d, d - high[k]).max(1, initial=0)
    return out


def expand(q: np.ndarray, x: np.ndarray, cuts: list[tuple[int, int]], gap: np.ndarray, own: np.ndarray, scores: np.ndarray, top: float, k: int, exact: bool) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Of each query the places and products in the annuli that it opens, and how many products were taken.

    ``own[i, j]`` says that x j is no candidate of query i; ``scores`` are the k-th
    best so far, raised as annuli give k better ones.
    """
    places: list[list[np.ndarray]] = [[] for _ in q]
    values: list[list[np.ndarray]] = [[] for _ in q]
    best = scores.copy()
    left, taken = np.argsort(gap, axis=1, kind="stable"), 0
    active = np.arange(len(q))
    for turn in range(len(cuts)):
        radius = _radii(q[active], best[active], top)
        nearest = left[active, turn]
        active, nearest = active[gap[active, nearest] <= radius], nearest[gap[active, nearest] <= radius]
        if not len(active):
            break
        for a in np.unique(nearest):
            some, (at, end) = active[nearest == a], cuts[a]
            s = _products(q[some], x[at:end], exact)
            taken += s.size
            for i, row in zip(some, s, strict=True):
                ok = np.flatnonzero(~own[i, at:end] & (row >= best[i]))
                if not len(ok):
                    continue
                places[i].append(at + ok)
                values[i].append(row[ok])
                if exact and sum(map(len, values[i])) >= k:
                    best[i] = max(best[i], np.sort(np.concatenate(values[i]))[-k])
    none = np.zeros(0, np.int64)
    return [np.concatenate(p) if p else none for p in places], [np.concatenate(v) if v else none for v in values], taken


def _score(pairs: DataFrame, width: int, k: int, exact: bool, top: float, pivots: np.ndarray, prune: bool) -> DataFrame:
    """Each query's best ``k`` of each pair of blocks, no worse than its bound."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, qd, q = _matrix({"ids": row["q_ids"], "dims": row["q_dims"], "v": row["q_v"]}, width)
                xi, xd, x = _matrix(row, width)
                own = (qi[:, None] == xi) | (qd[:, None] != xd)
                cuts = [(a["at"], a["end"]) for a in row["annuli"]]
                least = np.frombuffer(row["bounds"]) if row["bounds"] else np.full(len(qi), -np.inf)
                gap = np.zeros((len(qi), len(cuts)))
                if prune:
                    gap = bounds(distances(_raised(q, top, False), pivots), np.frombuffer(row["far"]).reshape(2, len(cuts), -1))
                places, values, _ = expand(q, x, cuts, gap, own, least, top, k, exact)
                found: list[tuple] = []
                for j, (at, s) in enumerate(zip(places, values, strict=True)):
                    best = np.lexsort((xi[at], ~s))[:k]
                    found.append((np.full(len(best), np.frombuffer(row["q_rows"], np.int64)[j]), np.full(len(best), qi[j]), xi[at[best]], s[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["row", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(score, _FOUND)


def _paired(pairs: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Payloads to ``(q_block, block)``; the large side last, so that tasks hold few blocks at a time."""
    q = queries.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "dims", "v")], "bounds")
    x = blocks.select("block", "ids", "dims", "v", "annuli", "far")
    return pairs.join(q, "q_block").join(x, "block").select("q_ids", "q_rows", "q_dims", "q_v", "bounds", "ids", "dims", "v", "annuli", "far")


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    pivots: int | None = None,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
    annulus: int = ANNULUS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest products over all vectors but its own."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors, key, vector).withColumn("row", F.col("id"))
    asked = checkpoint(usable(queries, key, vector).withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    stats = rows.unionAll(asked).agg(F.max(F.size("v")).alias("width"), F.max(square).alias("top"), F.max(most).alias("most"), F.count("*").alias("n")).first()
    spark = vectors.sparkSession
    if stats["width"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top = stats["width"], float(stats["top"])
    exact = (stats["most"] * scale + 1) ** 2 * width < 2**53
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"].tolist()
    sample = np.zeros((max(1, len(sampled)), width))
    for i, x in enumerate(sampled):
        sample[i, : len(x)] = np.floor(scale * np.asarray(x))
    centers = _pivots(_lift(sample, top), pivots or max(PIVOTS, min(SAMPLE // 8, math.isqrt(stats["n"]))))

    index = _blocks(_keyed(rows, width, top, centers, scale, lift=True), block, annulus, width, top, centers, lift=True)
    query_blocks = _blocks(_keyed(asked, width, top, centers, scale, lift=False), query_block, query_block, width, top, centers, lift=False)
    annuli = checkpoint(index.select("block", F.explode("annuli").alias("a")).select("block", "a.pivot", "a.low", "a.high"))

    # Wave 1: the annulus of its own pivot nearest to each query, or, where that pivot has none, of any.
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, q = _matrix(row, width)
                d = distances(_raised(q, top, False), centers)
                near = d.argmin(1)
                n = len(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(n), near])], names=["q_block", "at", "pivot", "dist"]
                )

    own = query_blocks.select("block", "ids", "dims", "v").mapInArrow(homes, "q_block long, at int, pivot int, dist double")
    gap = F.greatest(F.col("low") - F.col("dist"), F.col("dist") - F.col("high"), F.lit(0.0))
    first = own.join(annuli, "pivot").groupBy("q_block", "at").agg(F.min_by("block", F.struct(gap, "block")).alias("block")).select("q_block", "block").distinct()
    first = checkpoint(first)
    unbounded = query_blocks.withColumn("bounds", F.lit(None).cast("binary"))
    seen = checkpoint(_score(_paired(first, unbounded, index), width, k, exact, top, centers, prune=exact))

    # The radius left to each query, and per block of queries and pivot the distances that it may still reach.
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    kth = seen.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") == k).select("row", "score")
    members = query_blocks.select("block", "rows").mapInArrow(_members, "block long, at int, row long").join(kth, "row", "left")
    scores = members.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "score"))), lambda x: x["score"]).alias("scores"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, q = _matrix(row, width)
                score = np.array([-np.inf if s is None or not exact else float(s) for s in row["scores"]])
                radius = _radii(q, score, top)
                d = distances(_raised(q, top, False), centers)
                far = np.finfo(float).max
                low = np.nan_to_num((d - radius[:, None]).min(0), nan=-far, posinf=far, neginf=-far)
                high = np.nan_to_num((d + radius[:, None]).max(0), nan=far, posinf=far, neginf=-far)
                n = len(centers)
                yield pa.RecordBatch.from_pydict(
                    {"block": [row["block"]], "bounds": [score.tobytes()]} | {c: pa.array([x], pa.list_(t)) for c, x, t in (("pivot", range(n), pa.int32()), ("from", low, pa.float64()), ("to", high, pa.float64()))}
                )

    reached = query_blocks.select("block", "ids", "dims", "v").join(scores, "block").mapInArrow(reach, "block long, bounds binary, pivot array<int>, `from` array<double>, `to` array<double>")
    reached = checkpoint(reached)
    ranges = reached.select(F.col("block").alias("q_block"), F.explode(F.arrays_zip("pivot", "from", "to")).alias("r")).select("q_block", "r.*")
    inside = (ranges["pivot"] == annuli["pivot"]) & (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))
    rest = ranges.join(annuli, inside).select("q_block", "block").distinct().join(first, ["q_block", "block"], "left_anti")
    bounded = query_blocks.join(reached.select("block", "bounds"), "block")
    best = seen.unionAll(_score(_paired(rest, bounded, index), width, k, exact, top, centers, prune=exact))
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows)], names=["block", "at", "row"])
