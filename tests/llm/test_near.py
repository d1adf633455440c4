"""Near-duplicates, vectors, components and the pipeline: against brute force, with odd input."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitquarry.llm import components, cover_tree, cpsjoin, pii, pieces, toxicity, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(50)],
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
        "none": [(5, 5)],
    }[kind]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == union_find(ends, [(a, b) for a, b in links if a != b])


# Documents.


def word_sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes_by_force(rows, n, percent):
    sets = [(i, word_sets(t, n)) for i, t in rows]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b)]
    root = union_find({i for i, _ in sets if i is not None}, links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


def corpus(rng, groups=12, most=9):
    """Copies, near copies at all distances around the threshold, and shared passages."""
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, most)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join((passage + t) if rng.random() < 0.3 else t))
    rows += [rows[0]] * 5 + ["Tiny", "tiny", "TINY text", "É a b c d", "é a b c d", "", None, " \t "]
    rng.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_documents(make, seed):
    rows = corpus(random.Random(seed))
    for n in (4, 5):
        got = cpsjoin.classes(make(rows), n, 80)
        assert sorted(map(tuple, got.collect())) == classes_by_force(rows, n, 80)


def test_large_nodes(make, monkeypatch):
    """Nodes that branch and clusters that are cut into blocks give the same classes."""
    rows = corpus(random.Random(9), groups=4, most=60)
    want = classes_by_force(rows, 5, 80)
    monkeypatch.setattr(cpsjoin, "SMALL", 4)
    monkeypatch.setattr(cpsjoin, "BLOCK", 400)
    assert sorted(map(tuple, cpsjoin.classes(make(rows), 5, 80).collect())) == want


def test_one_hot_group(make):
    """A third of all rows are one text, and as many near copies of another."""
    rng = random.Random(4)
    base = [f"x{i}" for i in range(200)]
    rows = [(i, "one very common text of many words in a row") for i in range(150)]
    for i in range(150, 300):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(200)] = f"y{rng.random()}"
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(f"z{rng.random()}" for _ in range(20))) for i in range(300, 450)]
    assert sorted(map(tuple, cpsjoin.classes(make(rows), 5, 80).collect())) == classes_by_force(rows, 5, 80)


def test_near_odd(odd, empty):
    got = cpsjoin.classes(odd, 5, 80)
    assert got.count() == odd.count() and got.filter("doc_id is null").first()["kept"]
    kept = cpsjoin.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1
    assert cpsjoin.classes(empty).count() == 0 == cpsjoin.keep_first(empty).count()


def test_exact_links_join_what_all_pairs_join():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sets = [np.unique(rng.choice(30, rng.integers(1, 25))).astype(np.uint64) for _ in range(rng.integers(1, 40))]
        a, b = cpsjoin.exact_links(sets, 60)
        every = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        assert union_find(range(len(sets)), zip(a.tolist(), b.tolist(), strict=True)) == union_find(range(len(sets)), every)


# Vectors.


def vectors(rng, n=300, dim=8):
    base = rng.normal(size=(40, dim))
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 40] + 0.12 * rng.normal(size=dim) * (i % 3)], 0) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [float("nan")] * dim, 0), (2004, [1.0] * 3, 0), (2005, [1.0, 1.0, 1.01], 0)]
    rows += [(2100, [None] + [1.0] * (dim - 1), 0), (2200, [2 * x for x in rows[3][1]], 0), (2300, [float("inf")] * dim, 0)]
    return rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [16, 2048])
def test_cover_tree(spark, block):
    rows = vectors(np.random.default_rng(5))
    df = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: tuple(r)[1:] for r in cover_tree.with_links(df, 0.95, sample=64, leaves=16, block=block).collect()}
    ok = [(i, np.array(v)) for i, v, _ in rows if fine(v) and any(v)]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(ok, 2) if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95]
    root = union_find([i for i, _, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _, _ in rows}
    assert got == {i: (n[i], root[i], root[i] == i) for i, _, _ in rows}


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(500, 4))
    u /= np.linalg.norm(u, axis=1)[:, None]
    tree = cover_tree.Tree(u[:200], 40)
    leaf, far = tree.descend(u)
    radii = {int(k): far[leaf == k].max() for k in np.unique(leaf)}
    meet = tree.meeting(radii, 0.3)
    close = cover_tree.distances(u, u) <= 0.3
    assert all(meet[min(leaf[i], leaf[j]), max(leaf[i], leaf[j])] for i, j in zip(*np.nonzero(close), strict=True))
    assert meet.sum() < 40 * 41 / 2  # something was pruned
    for node, children in tree.children.items():
        assert (tree.centers[children[0]] == tree.centers[node]).all()  # nested


@pytest.mark.parametrize("how", [{"block": 8, "query_block": 3, "pivots": 4}, {"block": 64, "annulus": 5, "pivots": 9}, {}])
def test_topk(spark, how):
    rows = vectors(np.random.default_rng(6))
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, topk.exact_topk(df, df.filter("vec_id % 100 = 0"), 10, **how).collect()))
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if fine(v)]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_large_values(spark):
    big = 3e15  # products beyond a long become its limit
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, -1.0]), (2, [1.0, 1.0]), (100, [1e-3, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.exact_topk(df, df.filter("vec_id % 100 = 0"), 3).collect()}
    assert got[0, 1] == (1 << 63) - 1 and got[100, 2] == 1024 and got[0, 2] == (1 << 63) - 1


def test_vectors_odd(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.exact_topk(none, none).count() == 0 and cover_tree.with_links(none).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, None, 0)], VECTORS).withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    assert sorted(map(repr, map(tuple, cover_tree.with_links(df).collect()))) == ["(5, 1, 5, True)", "(5, 1, 5, True)", "(6, 0, 6, True)", "(None, 0, None, True)"]
    assert topk.exact_topk(df, df).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 0), (0, [3.0], 0), (0, [3.0], 0), (1, [2.0], 0), (1, [2.0], 0)], VECTORS)
    got = topk.exact_topk(twice, twice.filter("vec_id = 0"), 3).orderBy("rank", "score").collect()  # every query row is answered
    assert [tuple(r) for r in got] == [(0, rank, 1, score * 2048) for rank in (1, 2) for score in (1024, 3072, 3072)]
    one = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.exact_topk(one, one.filter("vec_id = 0"), 10).collect()] == [(0, 1, 1, 1024 * 2048)]


def clustered(rng, n, dim=64, clusters=40):
    """Unit vectors around a few centres, with planted copies."""
    base = rng.normal(size=(clusters, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    out = base[rng.integers(0, clusters, n)] + 0.03 * rng.normal(size=(n, dim))
    out[: n // 10] = out[n // 2 : n // 2 + n // 10] + 0.002 * rng.normal(size=(n // 10, dim))
    return (out / np.linalg.norm(out, axis=1)[:, None]).astype(np.float32).astype(float)


def test_cover_tree_prunes():
    """In 64 dimensions most pairs of vectors stay unopened: all but the links' neighbourhoods in separate copies, and other clusters."""
    rng, reach = np.random.default_rng(3), np.sqrt(2 - 2 * 0.95)
    for u, most in ((clustered(rng, 2000), 0.5), (np.vstack([v := rng.normal(size=(900, 64)), v[:100] + 0.01 * rng.normal(size=(100, 64))]), 0.05)):
        u = u / np.linalg.norm(u, axis=1)[:, None]
        blocks = []
        order = np.argsort(cover_tree.Tree(u[::4], 256).descend(u)[0], kind="stable")
        for at in range(0, len(u), 250):
            part = u[order[at : at + 250]]
            heads, spread, own = cover_tree.nested(part, reach / 2)
            assert (cover_tree.distances(part, part[heads])[np.arange(len(part)), own] <= spread[own] + 1e-7).all()
            blocks.append({"u": part, "heads": heads, "spread": spread, "own": own, "dims": np.full(len(part), 64)})
        whole = compared = links = 0
        for x, y in itertools.combinations(blocks, 2):
            keep_x, keep_y = cover_tree.opened(x, y, reach)
            whole += len(x["u"]) * len(y["u"])
            compared += len(keep_x) * len(keep_y)
            r, _ = cover_tree._pairs_of(x, y, reach, 0.95)
            assert len(r) == (x["u"] @ y["u"].T >= 0.95).sum()
            links += len(r)
        assert compared < most * whole and links
        for x in blocks:
            both, far = x["u"] @ x["u"].T >= 0.95, ~np.eye(len(x["u"]), dtype=bool)
            assert len(cover_tree._pairs_of(x, x, reach, 0.95)[0]) == (both & far).sum()


def test_topk_prunes():
    """In clustered vectors of 64 dimensions most products are never taken."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * clustered(rng, 3000))
    top = (x * x).sum(1).max()
    pivots = topk._pivots(topk._lift(x[::3], top), 54)
    d = cover_tree.distances(topk._lift(x, top), pivots)
    order = np.lexsort((d.min(1), d.argmin(1)))
    x, d = x[order], d[order]
    near = d.argmin(1)
    cuts = [0, *(np.flatnonzero(np.diff(near)) + 1), len(x)]
    cuts = list(itertools.pairwise(cuts))
    far = np.stack([[d[a:b].min(0) for a, b in cuts], [d[a:b].max(0) for a, b in cuts]])
    q = x[::50]
    gap = topk.bounds(cover_tree.distances(topk._raised(q, top, False), pivots), far)
    own = np.zeros((len(q), len(x)), bool)
    _, values, taken = topk.expand(q, x, cuts, gap, own, np.full(len(q), -np.inf), top, 10, True)
    assert [sorted(v)[-10:] for v in values] == [sorted(p)[-10:] for p in (q @ x.T).astype(np.int64).tolist()]
    assert taken < 0.5 * len(q) * len(x)


def test_repeated_ids_of_vectors(spark):
    """Vertices are vectors: an id links nothing, and no row is lost."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [1e-200, 1e-200]), (8, [1e200, 1e200]), (9, [5e-324, 5e-324]), (10, [1.0, 1.0])]
    got = cover_tree.with_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 3, 7, True), (8, 3, 7, False), (9, 3, 7, False), (10, 3, 7, False)]
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[1:] for r in topk.exact_topk(asked, asked.filter("vec_id = 0")).collect()) == [(1, 1, 1 << 20), (1, 1, 2 << 20)]


def by_row(rows, n, percent):
    """Rows as vertices, whatever their ids."""
    sets = [word_sets(t, n) for _, t in rows]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b)]
    root = union_find(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], doc), doc)
    return [(doc, len(s), least[root[i]], least[root[i]] == doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))], root


def test_repeated_ids_of_documents(make):
    base = [f"w{i}" for i in range(60)]
    x, near = " ".join(base), " ".join([*base[:-1], "other"])
    y, z = "an unrelated text of quite a few words stands here", "something else entirely is written in this one row"
    rows = [(2, x), (6, near), (6, y), (9, z), (6, z), (10, y + " " + z), (10, x), (10, x)]
    want, _ = by_row(rows, 5, 80)
    assert sorted(map(tuple, cpsjoin.classes(make(rows), 5, 80).collect())) == sorted(want)
    kept = sorted((r["doc_id"], r["text"]) for r in cpsjoin.keep_first(make(rows)).collect())
    assert kept == sorted([(2, x), (6, y), (6, z), (10, y + " " + z)])  # one row of each group, and nothing unrelated goes
    twice = [(1, x), (1, x), (1, near), (3, y), (3, None), (3, None)]
    left = sorted(((r["doc_id"], r["text"]) for r in cpsjoin.keep_first(make(twice)).collect()), key=repr)
    assert [r for r in left if r[0] == 3] == sorted([(3, y), (3, None), (3, None)], key=repr)
    assert len([r for r in left if r[0] == 1]) == 1 and len(left) == 4
    with pytest.raises(ValueError):
        cpsjoin.classes(make(rows), 5, 50)


def test_recall_of_candidates(spark):
    """Of pairs at and above the threshold, at least 99 % meet in a node and pass the sketches."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30000)]
    rows, pairs = [], []
    for k in range(400):
        t = [rng.choice(words) for _ in range(250)]
        near = list(t)
        for place in rng.sample(range(2, 248, 5), 5):  # each changed word changes five shingles
            near[place] = rng.choice(words)
        if 100 * len(word_sets(" ".join(t), 5) & word_sets(" ".join(near), 5)) >= 80 * len(word_sets(" ".join(t), 5) | word_sets(" ".join(near), 5)):
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(near))]
    sets = [cpsjoin.shingle_set(t, 5) for _, t in rows]
    full = [(i, len(s), cpsjoin.sketch(s)) for (i, _), s in zip(rows, sets, strict=True)]
    reps = spark.createDataFrame([(i, n, k.tolist(), k.astype(np.uint8).tobytes()) for i, n, k in full], "rep long, n long, sketch array<int>, low8 binary")
    joins, _, _ = cpsjoin._candidates(reps, 80)
    root = union_find(range(len(rows)), [(r["a"], r["b"]) for r in joins.collect()])
    assert len(pairs) > 300 and sum(root[a] == root[b] for a, b in pairs) >= 0.99 * len(pairs)


# The pipeline.


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [i for i, r in rows.items() if not (model.severities([r["text"]], {})[0] >= 0.5).any()]
    kept = {i for i, _, _, keep in classes_by_force([(i, rows[i]["text"]) for i in clean], 5, 80) if keep}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == kept
    m = pieces.Model(corpus_pipeline.PIECES_FILE)
    assert all(m.decode(np.array(r["ids"], "<i4")) == redacted[r["doc_id"]] for r in got)
    assert max(sum(x["doc_id"] == i for x in got) for i in kept) <= 2


def test_stage_columns(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "/root/testdata/sf0.001").columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """The whole pipeline over nulls, ties, repeated rows and no rows; only the last stage's table stays behind."""
    from pathlib import Path

    from bitquarry.llm.common import shared_dir

    given = odd.select("doc_id", "text", "lang", F.when(F.col("doc_id") > 2, F.col("source")).alias("source"), "n_chars")
    for name, docs in (("odd", given), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        tables = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*"))
        before = tables()
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(tables() - before) == 1
        if name == "empty":
            assert got == []
            continue
        # One of the two equal rows goes; all else stays, with the ids of its own text.
        assert sorted({repr(r["doc_id"]) for r in got}) == sorted({repr(r["doc_id"]) for r in given.collect()})
        ids = {i: m for i, m in ((r["doc_id"], r["ids"]) for r in got)}
        assert ids[1] == [] == ids[2] and len({tuple(r["ids"]) for r in got if r["doc_id"] == 6}) == 2
        assert len(got) <= 2 * (given.count() - 1)  # mixing reads a row twice at most


def test_every_stage_takes_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            columns = docs.columns
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == (["doc_id", "source", "ids"] if name == "pieces" else columns)
            assert out.count() >= (docs.count() - 1 if name != "toxicity" else 0)
