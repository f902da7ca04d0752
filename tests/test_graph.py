"""Hand graphs: empty, loops, parallel edges, sinks, edges out of range; variants agree; files."""

from __future__ import annotations

import struct
from collections import Counter, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.graph import Graph
from graphloom.operators import layout as L
from graphloom.operators import scan as SC
from graphloom.operators import sequence as S
from graphloom.plans import components as C
from graphloom.plans import dealing
from graphloom.plans import pagerank as PR
from graphloom.plans import program as VP
from graphloom.plans import spmv as M
from graphloom.plans import traversal as T
from graphloom.sources import packed
from graphloom.store import Store

HAND = {
    "empty": (3, []),
    "loop": (2, [(0, 0), (0, 1)]),
    "dup": (2, [(0, 1), (0, 1)]),
    "sink": (3, [(0, 1), (0, 2)]),
    "back": (3, [(2, 1), (1, 0)]),
    "range": (3, [(0, 1), (0, 7)]),
    "null": (3, [(0, 1), (None, 1), (0, None)]),
}


def graph(spark, n, edges):
    return Graph(spark.createDataFrame(edges, "src long, dst long"), n)


def known(n, edges):
    return [(a, b) for a, b in edges if a is not None and b is not None and 0 <= b < n]


def levels(n, edges, root=0):
    found, queue = {root: 1}, deque([root])
    while queue:
        a = queue.popleft()
        for s, t in edges:
            if s == a and t not in found:
                found[t] = found[a] + 1
                queue.append(t)
    return found


def least(n, edges, both=True):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[b] = min(label[a], label[b])
            if both:
                label[a] = min(label[a], label[b])
    return dict(enumerate(label))


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(HAND))
def test_hand_graphs(spark, name):
    n, edges = HAND[name]
    g, sound, store = graph(spark, n, edges), known(n, edges), Store(spark, name)
    for strategy in ("push", "pull", "auto", "edge", "grid", "range"):
        assert pairs(T.bfs(g, store, strategy=strategy, p=2).select("id", "level")) == levels(n, sound), strategy
    for strategy in ("edge", "grid", "frontier"):
        assert pairs(C.components(g, store, strategy, 2)) == least(n, sound), strategy
    assert pairs(C.least_labels(g, store)) == least(n, sound, both=False)
    rank = [0.15] * n
    for _ in range(3):
        rank = [0.15 / n + 0.85 * sum(rank[a] / sum(x == a for x, _ in sound) for a, b in sound if b == v) for v in range(n)]
    for strategy in ("push", "pull", "edge", "grid", "range"):
        assert pairs(PR.pagerank(g, store, strategy, 3, p=2)) == pytest.approx(dict(enumerate(rank))), strategy
    assert pairs(M.spmv(g)) == {v: sum(b for a, b in sound if a == v) for v in range(n)}


def test_shortcut(spark):
    store = Store(spark, "shortcut")
    g = Graph(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 5.0)], "src long, dst long, weight double"), 4)
    assert pairs(T.shortest_paths(g, store)) == {0: 0, 1: 1, 2: 2, 3: 1}
    dist = T.shortest_paths(g, store, weight="edge")
    assert pairs(dist) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert pairs(T.path_parents(g, dist)) == {1: 0, 2: 1, 3: 2}
    assert T.path_violations(g, dist).first()[0] == 0
    wrong = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 9)], "id long, dist long")
    assert T.path_violations(g, wrong).first()[0] == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20))))
def test_random_graphs(spark, case):
    n, edges = case
    g, store = graph(spark, n, edges), Store(spark, "random")
    assert pairs(T.bfs(g, store, strategy="auto").select("id", "level")) == levels(n, edges)
    assert pairs(C.components(g, store)) == least(n, edges)


def test_long_chain(spark):
    n = 40
    g, store = graph(spark, n, [(i, i + 1) for i in range(n - 1)]), Store(spark, "chain")
    assert pairs(C.components(g, store)) == dict.fromkeys(range(n), 0)
    assert C.summary(C.components(g, store)).first() == (1, n)


def test_adjacency_is_chunked(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 3)
    g, store = graph(spark, 3, [(0, i % 3) for i in range(8)]), Store(spark, "adjacency")
    got = sorted((r["id"], r["chunk"], list(r["neighbors"])) for r in L.adjacency(g, store).collect())
    assert got == [(0, 0, [0, 0, 0]), (0, 1, [1, 1, 1]), (0, 2, [2, 2])]


def test_partitions(spark):
    for n, p in ((10, 3), (9, 3), (2, 5), (1500, 7)):
        got = pairs(spark.range(n).select("id", X.partition_id("id", n, p)))
        begin, end = X.partition_range("id", n, p)
        for k, a, b in spark.range(p).select("id", begin, end).collect():
            assert all(got[v] == k for v in range(a, b)), (n, p)
    assert [X.grid_dimension(n) for n in (1500, 1048576, 8388608)] == [4, 409, 256]


def test_balanced_ranges(spark):
    g, store = graph(spark, 8, [(0, 0)] * 6 + [(0, 5), (0, 6)]), Store(spark, "balanced")
    assert L.balanced_ranges(g, 2, 1, store) == [0, 0, 8]
    assert L.balanced_ranges(graph(spark, 8, []), 3, 1, store) == [0, 8, 8, 8]
    assert L.equal_ranges(5, 2) == [0, 2, 5]


def test_scans(spark):
    values = [5, 1, 4, 1, 3, 9, 2]
    seq = spark.createDataFrame(list(enumerate(values)), "pos long, value long")
    run = lambda **k: [r[0] for r in SC.scan(seq, "pos", "value", "x", block=2, **k).orderBy("pos").select("x").collect()]
    assert run() == [0, 5, 6, 10, 11, 14, 23]
    assert run(inclusive=True) == [5, 6, 10, 11, 14, 23, 25]
    assert run(backward=True) == [20, 19, 15, 14, 11, 2, 0]
    assert run(op="min", inclusive=True, backward=True) == [1, 1, 1, 1, 2, 2, 2]
    assert run(op="max") == [None, 5, 5, 5, 5, 5, 9]


def test_sequences(spark):
    empty = spark.createDataFrame([], "pos long, value long")
    store = Store(spark, "sequence")
    assert S.pack(empty, F.col("value") > 0).collect() == []
    assert S.sort(empty, store).collect() == []
    assert S.reduce(empty).first()["sum"] is None
    seq = spark.createDataFrame(list(enumerate([3, 1, 3, 2, 1])), "pos long, value long")
    assert sorted(map(tuple, S.sort(seq, store).collect())) == [(0, 1, 1), (1, 4, 1), (2, 3, 2), (3, 0, 3), (4, 2, 3)]
    assert sorted(map(tuple, S.bucket_offsets(seq, 5).collect())) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 5)]
    assert sorted(map(tuple, S.dedup(seq).collect())) == [(0, 3), (1, 1), (3, 2)]


def hashed(x, steps, bits):
    m = (1 << bits) - 1
    for k, first, between, shift, way in steps:
        a = (x + k) & m if first == "+" else x ^ k
        b = (x << shift) & m if way == "<<" else x >> shift
        x = (a + b) & m if between == "+" else a ^ b
    return x


def test_expressions(spark):
    xs = [0, 1, 7, 12345, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert [r[0] for r in df.select(X.hash_int32("x")).collect()] == [hashed(x, X.HASH32, 32) for x in xs]
    ys = [0, 1, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(y,) for y in ys], "x long")
    assert [r[0] % 2**64 for r in df.select(X.hash_int64("x")).collect()] == [hashed(y % 2**64, X.HASH64, 64) for y in ys]
    texts = spark.createDataFrame([("12a",), ("a1",), ("",), ("007",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.parse_uint("t")).collect()][:4] == [12, 0, 0, 7]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "i long").select(X.log2_up("i")).collect()] == [0, 1, 2, 2, 3]


def test_packed_files(spark, tmp_path):
    edges = [(4294967295, 3, 0.5), (0, 1, 2.0), (0, 1, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for weighted, take in ((False, 2), (True, 3)):
        path = f"file://{tmp_path}/{weighted}"
        assert packed.write_packed(df, path, weighted) == 3
        got = packed.read_packed(spark, path, weighted, split=12)
        assert sorted(map(tuple, got.collect())) == sorted(e[:take] for e in edges)
    (tmp_path / "one").write_bytes(struct.pack("<IIII", 1, 2, 3, 4))
    assert sorted(map(tuple, packed.read_packed(spark, f"file://{tmp_path}/one", split=8).collect())) == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="whole records"):
        packed.read_packed(spark, f"file://{tmp_path}/one", weighted=True).collect()
    with pytest.raises(Exception, match="unsigned"):
        packed.write_packed(spark.createDataFrame([(-1, 0)], "src long, dst long"), f"file://{tmp_path}/bad")


def scans_until_join(df):
    """For every scan of kept edges in a plan, the operators between it and its join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "InMemoryTableScan" in line and "dst" in line:
            k = next(k for k in range(i - 1, -1, -1) if "Join" in lines[k])
            out.append(" ".join(lines[k + 1 : i]))
    return out


@pytest.mark.parametrize("hub", [1_000_000, 3])
def test_edges_stay(spark, monkeypatch, hub):
    """No round moves the edges, whether or not a source fills several slices; results are the same."""
    monkeypatch.setattr(dealing, "HUB", hub)
    edges = [(0, k) for k in range(1, 12)] + [(k, (3 * k) % 17) for k in range(17)] + [(5, 9)] * 4
    g, store = graph(spark, 17, edges), Store(spark, "stay")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with dealing.dealt(g.edges, store) as kept:
            assert (kept.hubs is not None) == (hub == 3)
            frontier = store.table(spark.range(5).select(F.col("id").alias("src"), F.lit(0.5).alias("rank")), "frontier")
            visited = store.table(spark.range(2), "visited")
            found = T.reached(kept.join(frontier.select("src")))
            rank = kept.join(frontier).groupBy("dst").agg(F.sum("rank"))
            for df in (T.push(found, visited, g), T.pull(found, visited, g), rank):
                between = scans_until_join(df)
                assert between and not any("Exchange" in x for x in between)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = levels(17, edges)
    assert dict(T.bfs(g, store, strategy="range", p=3).select("id", "level").collect()) == want
    assert dict(VP.run(VP.levels(), g, store, "auto").collect()) == want
    degree = Counter(s for s, _ in edges)
    rank = [0.15 / 17] * 17
    for s, d in edges:
        rank[d] += 0.85 * 0.15 / degree[s]
    monkeypatch.setattr(PR, "BROADCAST_ROWS", 0)
    for strategy in ("pull", "grid"):
        got = dict(PR.pagerank(g, store, strategy, 1, p=3).collect())
        assert [got[k] for k in range(17)] == pytest.approx(rank)


def test_fold_bitmaps_and_layouts(spark):
    store = Store(spark, "primitives")
    seq = spark.createDataFrame([(i, "abcdefg"[i % 7]) for i in range(100)], "pos long, value string")
    assert [r["value"] for r in S.fold(seq, lambda a, b: F.concat(a, b), store, block=4).collect()] == ["".join("abcdefg"[i % 7] for i in range(100))]
    assert S.fold(seq.where("false"), lambda a, b: F.concat(a, b), store).collect() == []
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    for on in (False, True):
        b = S.bitmap_clear(S.bitmap_set(S.bitmap_fill(spark, 130, on), ids(0, 63, 64, 64, 129)), ids(63, 5))
        got = {r["id"] for r in S.bitmap_get(b, spark.range(130)).where("is_set").collect()}
        assert got == (set(range(130)) - {63, 5} if on else {0, 64, 129})
    turned = {r["pos"]: r["value"] for r in S.transpose(seq.where("pos < 8"), 3, 3).collect()}
    assert "".join(turned[k] for k in sorted(turned)) == "adgbeacf"
    with pytest.raises(ValueError, match="layout"):
        L.load(graph(spark, 2, [(0, 1)]), 10, store, 2)
