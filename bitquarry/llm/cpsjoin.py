"""Near-duplicate documents by a chosen-path set-similarity join.

A document's set holds the hashes of its word shingles.  Its sketch has
``SKETCH`` minwise values.  A forest of ``TREES`` trees branches documents by selected
minwise tokens: a node hands a document to some children, each named by one
position that the node selects and the document's value there.  Two documents
with similarity s meet in a given child with probability s.  Roots have
``BRANCHES`` children, later nodes ``LATER``: at the threshold 0.8 a pair stays
together below a shared child with probability above 0.94, and misses all 4
trees with about 5e-8.  Nodes of at most ``SMALL`` documents are compared
exhaustively by sketch; larger ones branch again, ``DEPTH`` levels deep; a node
that is still large holds documents with that many equal minwise values and
passes as a whole.  A sketch pair is a candidate from ``AGREE`` equal values on,
which a pair at the threshold misses with about 1e-8.  These settings are made
for ``LEAST_PERCENT``; lower thresholds are refused.

Candidates are kept as a spanning forest, and their components are clusters:
every link lies within one.  Each clustered document's full set is read once,
and exact intersections come from posting lists; pairs already connected need
no check, so it is enough to compare every document outside the largest
component with all others.  A cluster of at most ``BLOCK`` shingles is one
task.  In a larger one, which may be a chain of weak candidates, only documents
that share a node are compared: a task for each small node, and pairs of blocks
of at most about ``BLOCK`` shingles for each node that stayed large, so a task
stays bounded and a long chain costs no more than its nodes.  Nothing is capped
or sampled.

Equal sets are one vertex with a number of its own, so thousands of copies cost
a row each.  Nodes with so many members that they would be hot keys are at most
``HOT``, as each holds more than that part of all memberships; they are joined
by broadcast, and all others by a shuffle.  Texts are read again only where a
bit table of the clustered rows (``common.passing``) lets
them pass, so documents without candidates are not shuffled.

Results for odd input: a null or empty text, or one without words, has the
empty set and links with nothing, as does a row with a null id.  Vertices are
sets, not ids: of rows that repeat an id each has the component of its own set,
and their ids alone link nothing.  ``component_id`` is the smallest id of the
rows in the component.  An empty table gives an empty result; ``classes``
returns its own columns alone.  ``keep_first`` keeps of each component the one
row that is least by id and then by text, repeated rows counting as one, and
every row that links with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, passing, runs, small_batches, text_or_empty, tidy, worker_state
from .components import connected, forest

SKETCH = 64
TREES = 4
BRANCHES = 3
LATER = 2
SMALL = 256
DEPTH = 3
AGREE = 32
BLOCK = 2_000_000
LEAST_PERCENT = 80
HOT = 4096
#: What names a row: its id and its text's digests.
ROW = ["doc_id", "h1", "h2"]
#: Bytes of words that a worker remembers.
WORD_BYTES = 24 << 20

_MULTIPLIERS = np.random.default_rng(8).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        self.size += len(word) + 180
        return found

    def clear(self) -> None:
        super().clear()
        self.size = 0


def shingle_set(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles, of its one shorter sequence, or none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_state("shingles", _Hashes)
    if known.size > WORD_BYTES:
        known.clear()
    w = np.array(list(map(known.__getitem__, words)), np.uint64)
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at : at + 4096] * _MULTIPLIERS[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, rows, lows = [], [], [], []
        for t in batch.column("text"):
            s = shingle_set(t.as_py(), n)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            rows.append(sketch(s))
            lows.append(rows[-1].astype(np.uint8).tobytes())
        values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SKETCH, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ROW] + [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(lows, pa.binary())], names=[*ROW, "n", "key", "sketch", "low8"])


def _star(rows: np.ndarray, cols: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between places of ``ids``."""
    label = forest(rows, cols, len(ids))
    at = np.flatnonzero(label != np.arange(len(label)))
    return ids[at], ids[label[at]]


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidates within small nodes (rows sorted by node): all pairs whose sketches and sizes allow a link.

    Only the values' last bytes come here; equal values have equal ones, so no pair is lost.
    """
    for part in runs(batches, "node"):
        node, ids, n = (part.column(c).to_numpy() for c in ("node", "rep", "n"))
        sk = np.frombuffer(b"".join(part.column("low8").to_pylist()), np.uint8).reshape(-1, SKETCH)
        rows, cols = [], []
        at = np.arange(len(node) - 1)
        for step in range(1, SMALL):
            at = at[at + step < len(node)]
            at = at[node[at] == node[at + step]]
            if not len(at):
                break
            low, high = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
            fit = at[100 * low >= percent * high]
            fit = fit[(sk[fit] == sk[fit + step]).sum(1) >= AGREE]
            rows.append(fit)
            cols.append(fit + step)
        if rows:
            # Places are joined by id too: a document stands in many nodes.
            unique, place = np.unique(ids, return_inverse=True)
            a, b = _star(place[np.concatenate(rows)], place[np.concatenate(cols)], unique)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _by_node(rows: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``facts``, a row per node: hot nodes by broadcast, so that none is the key of a shuffle."""
    few = F.broadcast(hot)  # at most HOT rows
    cold = rows.join(few, "node", "left_anti").join(facts, "node")
    return cold.unionByName(rows.join(F.broadcast(facts.join(few, "node", "left_semi")), "node"))


def _candidates(reps: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """A spanning forest ``(a, b)`` of the candidate pairs, the members ``(node, rep)`` of small nodes, and of those that stayed large."""
    first = F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("sketch")[i]).alias("node")) for i in range(TREES * BRANCHES)])
    nodes = reps.select("rep", F.explode(first).alias("x")).select("rep", "x.node")
    found: list[DataFrame] = []
    members: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = checkpoint(nodes.groupBy("node").count().filter("count > 1"))
        most = sizes.agg(F.sum("count")).first()[0] or 0
        hot = sizes.filter(F.col("count") > max(SMALL, most // HOT)).select("node")
        cold = nodes.join(F.broadcast(hot), "node", "left_anti")  # none of them is small
        small = checkpoint(cold.join(sizes.filter(F.col("count") <= SMALL).select("node"), "node").select("node", "rep"))
        members.append(small)
        compared = small.join(reps.select("rep", "n", "low8"), "rep").repartition("node").sortWithinPartitions("node")
        found.append(checkpoint(compared.select("node", "rep", "n", "low8").mapInArrow(lambda it: tidy(_compare(it, percent)), "a long, b long").distinct()))
        large = sizes.filter(F.col("count") > SMALL).select("node")
        if large.isEmpty():
            return _union(found), members, None
        stay = checkpoint(_by_node(nodes, large, hot).select("node", "rep"))
        if depth == DEPTH:
            break
        at = F.pmod(F.xxhash64("node"), F.lit(SKETCH)).cast("int")
        step = SKETCH // LATER
        children = F.array(*[F.xxhash64("node", (at + i * step) % SKETCH, F.col("sketch")[(at + i * step) % SKETCH]) for i in range(LATER)])
        nodes = checkpoint(stay.join(reps.select("rep", "sketch"), "rep").select("rep", F.explode(children).alias("node")).distinct())
    lead = stay.groupBy("node").agg(F.min("rep").alias("b"))
    found.append(_by_node(stay, lead, hot).filter("rep <> b").select(F.col("rep").alias("a"), "b"))
    return _union(found), members, stay


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), n).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "set"])


def exact_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``100 * intersection >= percent * union`` that join all connected sets.

    Not all pairs: a set of the largest component so far is compared only if
    something outside it is, and then the other's turn finds the link.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(count), sizes)
    order = np.argsort(place, kind="stable")
    postings, starts = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    ends = np.cumsum(sizes)
    label, done = np.arange(count), np.zeros(count, bool)
    rows, cols = [], []
    while True:
        main = np.bincount(label, minlength=count).argmax()
        left = np.flatnonzero(~done & (label != main))
        if not len(left):
            break
        # A few at a time, so that what they join is left out of later turns.
        for i in left[: 8 if not rows else 64]:
            mine = place[ends[i] - sizes[i] : ends[i]]
            low, many = starts[mine], starts[mine + 1] - starts[mine]
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(postings[at], minlength=count)
            near = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both))
            near = near[near != i]
            done[i] = True
            rows.append(np.full(len(near), i))
            cols.append(near)
            if len(near):
                label[np.isin(label, label[near])] = label[i]
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(cols)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for part in runs(batches, "task"):
        task = part.column("task").to_numpy()
        cuts = np.flatnonzero(np.diff(task)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(task)], strict=True):
            own = part.slice(low, high - low)
            ids = own.column("rep").to_numpy()
            rows, cols = exact_links([np.frombuffer(s.as_py(), np.uint64) for s in own.column("set")], percent)
            a, b = _star(rows, cols, ids)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _in_blocks(placed: DataFrame, name: str) -> DataFrame:
    """``rep, task`` for every pair of blocks of ``name``'s members, of ``blocks`` blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    # The lone pair (b, b) of a block is part of each of its pairs; it is a task only where there is one block.
    dealt = dealt.filter("blocks = 1 or own <> other")
    return dealt.select("rep", F.xxhash64(F.lit(name), name, F.least("own", "other"), F.greatest("own", "other")).alias("task"))


def _tasks(clusters: DataFrame, reps: DataFrame, members: list[DataFrame], large: DataFrame | None) -> DataFrame:
    """``rep, task``: which sets are compared together."""
    sized = clusters.join(reps.select(F.col("rep").alias("id"), "n"), "id")
    sizes = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = checkpoint(clusters.join(sizes, "component").select(F.col("id").alias("rep"), "component", "blocks"))
    tasks = placed.filter("blocks = 1").select("rep", F.xxhash64(F.lit("component"), "component").alias("task"))
    giant = placed.filter("blocks > 1").select("rep", "component")
    if giant.isEmpty():
        return tasks
    # Equal node names of two depths are two tasks.
    for depth, small in enumerate(members):
        tasks = tasks.unionAll(small.join(giant, "rep").select("rep", F.xxhash64(F.lit(depth), "node", "component").alias("task")))
    if large is not None:
        stay = large.join(giant, "rep").join(reps.select("rep", "n"), "rep").select("rep", "n", F.xxhash64("node", "component").alias("node"))
        blocks = checkpoint(stay.groupBy("node").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("count")))
        most = blocks.agg(F.sum("count")).first()[0] or 0
        hot = blocks.filter(F.col("count") > max(SMALL, most // HOT)).select("node")
        tasks = tasks.unionAll(_in_blocks(_by_node(stay, blocks.select("node", "blocks"), hot), "node"))
    return tasks


def _own(column: str) -> list[Column]:
    """Digests of a text, which name a row together with its id."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2")]


def _read_again(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, text`` of the rows that ``wanted(rep, doc_id, h1, h2)`` names."""
    return passing(rows, wanted, ["doc_id", "h1"]).select(*ROW, "text").join(wanted, ROW).select("rep", "text")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row ``doc_id, h1, h2, n, component_id, first``: the least row (doc_id, h1, h2) of its component; null where it links with nothing by rule."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the trees find links from {LEAST_PERCENT} percent on")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", "text", *_own("text"))
    kinds = "doc_id long, h1 long, h2 long, n long, key binary, sketch array<int>, low8 binary"
    sketched = checkpoint(rows.select(*ROW, "text").mapInArrow(lambda it: tidy(_sketches(it, n)), kinds))
    usable = sketched.filter("n > 0 and doc_id is not null")
    grouped = usable.groupBy("key").agg(F.min(F.struct(*ROW)).alias("low"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("low8").alias("low8"))
    reps = checkpoint(grouped.withColumn("rep", F.monotonically_increasing_id()))
    joins, members, large = _candidates(reps, percent)
    clusters = connected(joins)
    tasks = checkpoint(_tasks(clusters, reps, members, large))
    wanted = checkpoint(clusters.select(F.col("id").alias("rep")).join(reps.select("rep", "low.*"), "rep"))
    sets = _read_again(rows, wanted).mapInArrow(lambda it: tidy(_sets(it, n)), "rep long, set binary")
    dealt = tasks.join(sets, "rep").select("task", "rep", "set")
    edges = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: tidy(_verify(it, percent)), "a long, b long")
    linked = connected(edges).withColumnRenamed("id", "rep")

    # Sets without links stand for themselves; a component's least row is found over its sets, not over its rows.
    joined = linked.join(reps.select("rep", "low"), "rep")
    firsts = joined.groupBy("component").agg(F.min("low").alias("first"))
    named = reps.select("key", "rep", "low").join(linked.join(firsts, "component").select("rep", "first"), "rep", "left").select("key", F.coalesce("first", "low").alias("first"))
    keyed = sketched.withColumn("key", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key"))).drop("sketch", "low8")
    out = keyed.join(named, "key", "left")
    return out.select(*ROW, "n", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    out = _components(docs, n, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the least by id, then text."""
    own = F.struct(*ROW)
    found = _components(docs, n, percent).filter(F.col("first").isNull() | (own == F.col("first")))
    kept = checkpoint(found.groupBy(*ROW).agg(F.count("first").alias("copies")))
    names = {c: f"__bq_{c}" for c in ROW}
    rows = docs.withColumns({"__bq_text": text_or_empty(), "__bq_doc_id": F.col("doc_id").cast("long")})
    rows = rows.withColumns({"__bq_h1": F.xxhash64("__bq_text"), "__bq_h2": F.xxhash64(F.lit(1), "__bq_text")}).drop("__bq_text")

    def among(marks: DataFrame) -> DataFrame:
        m = marks.select(*[F.col(c).alias(f"__bq_kept_{c}") for c in ROW])
        on = [rows[names[c]].eqNullSafe(m[f"__bq_kept_{c}"]) for c in ROW]
        return rows.join(m, on[0] & on[1] & on[2], "left_semi")

    out = among(kept.filter("copies <= 1"))
    repeated = kept.filter("copies > 1")
    if not repeated.isEmpty():  # rows that repeat as a whole: one of each stays
        out = out.unionAll(among(repeated).dropDuplicates(list(names.values())))
    return out.select(*docs.columns)
