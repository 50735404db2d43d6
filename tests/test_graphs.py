"""Table iterations on one graph against dense linear algebra and plain path search."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import graphs, tensor
from barloom.operators import network as nw


def random_graph(n, seed, parts=1, degree=3):
    """A symmetric weight matrix whose parts are rings with some further edges."""
    rng, w = np.random.default_rng(seed), np.zeros((n, n))
    for group in np.array_split(np.arange(n), parts):
        for i, a in enumerate(group):
            for b in [group[(i + 1) % len(group)], *rng.choice(group, degree - 1)]:
                if a != b:
                    w[a, b] = w[b, a] = rng.uniform(0.2, 1.0)
    return w


def table(spark, w):
    names = np.array([f"n{i:03d}" for i in range(len(w))])
    a, b = np.nonzero(w)
    return names, spark.createDataFrame(pd.DataFrame({"src": names[a], "dst": names[b], "w": w[a, b]}))


def normalised(w):
    d = w.sum(axis=1)
    return np.eye(len(w)) - w / np.sqrt(np.outer(d, d))


def by_name(frame, names, col):
    return frame.toPandas().set_index(frame.columns[0]).loc[names][col].to_numpy()


@pytest.mark.parametrize("parts", [1, 3])
def test_fiedler_pair(spark, parts):
    w = random_graph(45, 1, parts)
    names, edges = table(spark, w)
    values, vectors = np.linalg.eigh(normalised(w))
    i = int(np.argmax(values > 1e-10))
    assert i == parts
    want = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i]) > 1e-9), i])
    got = graphs.fiedler_pair(edges)
    np.testing.assert_allclose(by_name(got, names, "fiedler"), want, atol=1e-8)
    assert got.first()["fiedler_value"] == pytest.approx(values[i], abs=1e-10)


def test_vectors_of_a_basis_that_starts_again(spark):
    w = random_graph(40, 2)
    names, edges = table(spark, w)
    want = np.linalg.eigvalsh(w)[::-1][:2]
    nodes = graphs.nodes_of(edges).select("node", F.lit("all").alias("component"), F.lit(0.0).alias("still"))
    values, vectors = graphs.leading_vectors(graphs.matrix(edges), nodes, 2, width=4, basis=24)
    np.testing.assert_allclose(values, want, atol=1e-9)
    v = np.array(vectors.toPandas().set_index("node").loc[names]["v"].tolist())
    np.testing.assert_allclose(w @ v, v * values, atol=1e-8)


def test_components_of_chains(spark):
    pairs = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(100)] + [("b", "c"), ("d", "d")]
    got = dict(graphs.components(spark.createDataFrame(pairs, "src string, dst string")).collect())
    assert {k: v for k, v in got.items() if k[0] != "a"} == {"b": "b", "c": "b", "d": "d"}
    assert {v for k, v in got.items() if k[0] == "a"} == {"a000"}


def test_pagerank_with_sinks(spark):
    w = random_graph(30, 3)
    w[5] = 0.0  # a node that only receives
    names, edges = table(spark, w)
    got = graphs.pagerank(edges)
    np.testing.assert_allclose(by_name(got, names, "score"), nw._pagerank(names, w, steps=500), atol=1e-9)


def test_eigenvector_of_one_part_and_of_two(spark):
    w = random_graph(40, 4)
    names, edges = table(spark, w)
    np.testing.assert_allclose(by_name(graphs.eigenvector(edges), names, "score"), np.abs(np.linalg.eigh(w)[1][:, -1]), atol=1e-8)
    w = random_graph(40, 5, 2)
    names, edges = table(spark, w)
    np.testing.assert_allclose(by_name(graphs.eigenvector(edges), names, "score"), nw._pagerank(names, w, steps=500), atol=1e-9)


def plain_betweenness(w):
    n = len(w)
    total = np.zeros(n)
    for s in range(n):
        dist, count, before, order = {s: 0.0}, np.zeros(n), [[] for _ in range(n)], []
        count[s], heap, done = 1, [(0.0, s)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v in np.flatnonzero(w[u]):
                new = d + w[u, v]
                if v not in dist or new < dist[v] - 1e-12:
                    dist[v], count[v], before[v] = new, count[u], [u]
                    heapq.heappush(heap, (new, v))
                elif abs(new - dist[v]) <= 1e-12 and u not in before[v]:
                    count[v] += count[u]
                    before[v].append(u)
        dep = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                dep[u] += count[u] / count[v] * (1 + dep[v])
        dep[s] = 0
        total += dep
    return total / ((n - 1) * (n - 2))


@pytest.mark.parametrize("cells", [300, 4_000_000])
def test_betweenness_in_blocks_of_sources(spark, cells):
    w = np.round(random_graph(35, 6, 2) * 4) / 4  # many paths of equal length
    names, edges = table(spark, w)
    names = names[w.sum(axis=1) > 0]
    got = graphs.betweenness(edges.withColumn("t_no", F.lit(7)), cells=cells)
    assert got.select("t_no").distinct().collect() == [(7,)]
    np.testing.assert_allclose(by_name(got.drop("t_no"), names, "score"), plain_betweenness(w)[w.sum(axis=1) > 0], atol=1e-12)


@pytest.mark.parametrize("kind", ["pagerank", "eigenvector"])
def test_large_windows_go_through_tables(spark, kind):
    a, b = random_graph(12, 7), random_graph(20, 8)
    edges = table(spark, a)[1].withColumn("t_no", F.lit(1)).union(table(spark, b)[1].withColumn("t_no", F.lit(2)))
    one = nw.centrality(edges, kind).toPandas().sort_values(["t_no", "symbol"])
    two = nw.centrality(edges, kind, kernel_nodes=15).select(*one.columns).toPandas().sort_values(["t_no", "symbol"])
    np.testing.assert_allclose(one["score"], two["score"], atol=1e-9)
    assert one["symbol"].tolist() == two["symbol"].tolist() and len(one) == 32


def test_nearest_points_in_tiles(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 6, size=(60, 2)).astype(float)  # many equal distances
    names = [f"p{i:02d}" for i in range(60)]
    points = spark.createDataFrame(list(zip(names, x.tolist())), "symbol string, x array<double>")
    want = set()
    for i in range(60):
        near = sorted((((x[i] - x[j]) ** 2).sum(), names[j]) for j in range(60) if j != i)[:4]
        want |= {(names[i], n) for _, n in near}
    for tile in (7, 1024):
        assert {tuple(r) for r in tensor.nearest_points(points, 4, tile=tile).collect()} == want


def test_embedding_holds_the_laplacian(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(30, 3))
    names = np.array([f"p{i:02d}" for i in range(30)])
    got = tensor.embed_2d(spark.createDataFrame(list(zip(names.tolist(), x.tolist())), "symbol string, x array<double>"))
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.zeros((30, 30))
    np.put_along_axis(near, np.argsort(d, axis=1)[:, :5], 1.0, axis=1)
    w = (near + near.T) / 2
    values, vectors = np.linalg.eigh(normalised(w))
    assert values[1] > 1e-9
    want = vectors[:, 1:3] / np.sqrt(w.sum(axis=1))[:, None]
    want *= np.sign(want[0])
    np.testing.assert_allclose(np.stack([by_name(got, names, c) for c in "xy"], axis=1), want, atol=1e-8)
    assert [tuple(r) for r in tensor.embed_2d(spark.createDataFrame([("a", [1.0])], "symbol string, x array<double>")).collect()] == [("a", 0.0, 0.0)]
