"""Near duplicates of vectors and texts, components, nearest neighbours: all against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import components, ivfpq, jaccard_join, neardup_vectors
from gridloom.llm.components import connected_components
from gridloom.llm.prefixtree import PrefixTree


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 100, 300_000])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, k) for k in range(5001, 5050)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = roots({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), rng.standard_normal(16)) for i in range(300)]
    base = rows[5][2]
    rows += [(1000 + i, rows[5][1], base + rng.standard_normal(16) * 0.08 * np.linalg.norm(base) / 4) for i in range(120)]  # a hot group around the threshold
    rows += [(2000 + i, rows[9][1], rows[9][2] * (i + 1)) for i in range(5)] + [(3000, (rows[9][1] + 1) % 3, rows[9][2])]
    out = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    return out + [(9000, 1, None), (9001, 1, [0.0] * 16), (9002, 1, [float("nan")] + [1.0] * 15), (9003, None, out[0][2]), (9004, out[0][1], out[0][2][:8]), (9005, 1, [None] + [1.0] * 15), (None, 1, out[0][2]), out[3], out[3]]


@pytest.mark.parametrize(("block", "exact"), [(16, False), (1024, False), (64, True)])
def test_vector_links(spark, block, exact):
    rows = vectors()
    rows += [(4000 + i, r[1], r[2]) for i, r in enumerate(rows[300:310] * 9)]  # copies in the hot group
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, codes string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.link_vectors(df, block=block, exact=exact).collect()}
    ok = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = (label, np.array(v, np.float64))
    links = [(a, b) for a, (la, x) in ok.items() for b, (lb, y) in ok.items() if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    ids = {r[0] for r in rows if r[0] is not None}
    root = roots(ids, links)
    assert got == {i: (sum(i in p for p in links), root[i], root[i] == i) for i in ids}
    assert neardup_vectors.link_vectors(df.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [1.0]), (5060, x[20].tolist()), (5080, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ivfpq.self_search(df, every=20, k=10, block=256).toPandas()
    ids = np.array([i for i, v in rows if v is not None and len(v) == 24 and any(v)])
    m = np.array([v for i, v in rows if v is not None and len(v) == 24 and any(v)], np.float64)
    hit = total = 0
    assert set(out.query_id) == {i for i in ids.tolist() if i % 20 == 0}
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        s = m @ m[ids == q][0]
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        exact = dict(zip(ids.tolist(), s.tolist(), strict=True))
        assert np.allclose([exact[v] for v in g.vec_id], g.score, rtol=0, atol=1e-9)
        assert [(-a, b) for a, b in zip(g.score, g.vec_id, strict=True)] == sorted((-a, b) for a, b in zip(g.score, g.vec_id, strict=True))
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:10]].tolist()) & set(g.vec_id))
        total += 10
    assert hit / total >= 0.9
    few = ivfpq.self_search(df.where("vec_id < 3"), k=10).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ivfpq.self_search(df.limit(0)).count() == 0


def test_clustered_neighbours_need_few_lists(spark):
    rng = np.random.default_rng(18)
    centres = rng.standard_normal((60, 16)) * 4
    x = (centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 16)) * 0.3).astype(np.float32)
    coarse = ivfpq.kmeans(x.astype(float), 64, 8, rng)
    assert ivfpq.probes_needed(x.astype(float), coarse, 10, 0.96, rng) <= 12
    x[1000:1100] = x[40]  # more copies than are reranked: ties go to the smaller ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ivfpq.self_search(df, every=20, k=10, lists=64, block=500, query_block=40).toPandas()
    m, hit = x.astype(float), 0
    for q, g in out.groupby("query_id"):
        s = m @ m[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(m)), -np.round(s, 9)))[:10]
        hit += len(set(want.tolist()) & set(g.vec_id))
    assert hit / (10 * out.query_id.nunique()) >= 0.95
    assert out[out.query_id == 40].sort_values("rank").vec_id.tolist() != [] and out.query_id.nunique() == 150


@pytest.mark.parametrize("size", [1.0, 1e-25, 1e25])
def test_neighbours_in_tight_groups(spark, size):
    rng = np.random.default_rng(28)
    x = rng.standard_normal((10, 64))[rng.integers(0, 10, 2000)] + rng.standard_normal((2000, 64)) * 0.01  # more in a group than are reranked
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * size).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ivfpq.self_search(df, every=20, k=10).toPandas()
    m, hit = x.astype(float), 0
    assert len(out) == 1000
    for q, g in out.groupby("query_id"):
        s = (m * m[q]).sum(axis=1)
        assert np.allclose(s[g.vec_id] / size**2, g.score / size**2, rtol=0, atol=1e-9)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:10].tolist()) & set(g.vec_id))
    assert hit / len(out) >= 0.9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=1, max_size=12), st.sets(st.integers(0, 45), min_size=1, max_size=25))
def test_prefix_tree(sets, probe):
    tree = PrefixTree([np.array(sorted(s), np.uint64) for s in sets])
    for percent in (80, 50):
        got = set(tree.matches(np.array(sorted(probe), np.uint64), percent).tolist())
        assert got == {k for k, s in enumerate(sets) if 100 * len(s & probe) >= percent * len(s | probe)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def texts(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 5000))
    passage = [word() for _ in range(40)]
    out = []
    for i in range(120):
        n = int(rng.integers(1, 160))
        body = [word() for _ in range(n)]
        out.append(body if i % 4 else passage + body[:60])
        for _ in range(int(rng.integers(0, 3))):
            copy = list(out[-1])
            for _ in range(int(rng.integers(0, 8))):
                copy[int(rng.integers(0, len(copy)))] = word()
            out.append(copy)
    hot = [word() for _ in range(150)]
    for _ in range(400):  # a large family on both sides of the threshold
        copy = list(hot)
        for _ in range(int(rng.integers(0, 7))):
            copy[int(rng.integers(0, 150))] = word()
        out.append(copy)
    out += [hot] * 30 + [passage] * 2
    return [" ".join(x) for x in out] + ["", None, " \t ", "one two", "ONE\ttwo", "a b c d e", "A b c d  E", "x" * 50_000]


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(12)
    heavy = rng.random(1 << 16) < 0.3
    for percent in (80, 60):
        for _ in range(300):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.9, 0.95])], rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                common = len(np.intersect1d(jaccard_join.prefix(a, heavy, percent), jaccard_join.prefix(b, heavy, percent)))
                assert common >= jaccard_join.common_needed(np.array([len(a)]), np.array([len(b)]), percent)[0]


@pytest.mark.parametrize(("longest", "block"), [(256, 512), (40, 64)])
def test_text_links(spark, longest, block, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows] + [(None, "y", 0, "x"), (rows[0][0], rows[0][1], 0, "x")], "doc_id long, text string, n int, fp string").repartition(5)
    if longest == 40:
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(jaccard_join, "BUNDLE", 2)
        monkeypatch.setattr(components, "ONE_TASK", 0)
    got = jaccard_join.link_documents(df, longest_list=longest, block=block, sketch=16 if longest == 40 else None).collect()
    sets = {i: shingles(t) for i, t in rows}
    links, items = [], list(sets.items())
    for x, (i, a) in enumerate(items):
        links += [(i, j) for j, b in items[x + 1 :] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = roots(sets, links)
    assert len(got) == len(rows) + 1
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("sets", "longest"), [(8, 10), (12, 10), (60, 10)])
def test_lists_of_copied_sets(sets, longest):
    rows = [(tok, fp) for tok in (3, 5) for fp in range(sets) for _ in range(50)] + [(9, 0), (9, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([t for t, _ in part], [f for _, f in part], [2] * len(part))], names=["tok", "fp", "n"])
               for part in (rows[i : i + 45] for i in range(0, len(rows), 45))]
    got = Counter(x for b in jaccard_join._lists(80, longest)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    pairs, family = Counter({(a, b, 1): k for (a, b, need), k in got.items() if need}), {(a, b) for a, b, need in got if not need}
    want = Counter({(0, 1, 1): 1})
    if sets <= longest:
        want += Counter({(a, b, 1): 2 for a in range(sets) for b in range(a + 1, sets)})
    assert pairs == want and family == ({(0, b) for b in range(sets)} if sets > longest else set())


def test_links_of_sets_copied_over_partitions(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(120)]
    variants = []
    for _ in range(12):
        copy = list(words)
        copy[int(rng.integers(0, 120))] = "other"
        variants.append(" ".join(copy))
    rows = [(100 * k + i, t) for k in range(40) for i, t in enumerate(variants)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        for longest in (4, 20):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
            got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(df, longest_list=longest, block=5, sketch=16).collect()}
            sets = {i: shingles(t) for i, t in rows[:12]}
            links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            root = roots(sets, links)
            assert got == {d: root[d % 100] for d, _ in rows}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_text_links_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.link_documents(df).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert jaccard_join.link_documents(df.limit(0)).count() == 0


def test_packed_counts():
    for c in (np.zeros(65536, np.uint32), np.arange(65536, dtype=np.uint32), np.where(np.arange(65536) % 97, 0, 300).astype(np.uint32)):
        sums = np.ones(65536, np.int64)
        jaccard_join.add_packed(sums, memoryview(jaccard_join.packed(c)))
        assert (sums == c.astype(np.int64) + 1).all()
