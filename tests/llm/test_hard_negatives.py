"""Hard negatives against all scores."""

import math

import numpy as np

from barloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, anchor int"


def brute(rows):
    vectors = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        vectors[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec)] = None
    out = []
    for a in vectors:
        if a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], v[2])), v) for v in vectors if v != a]
        for ps, p in sorted(((s, v) for s, v in scored if v[1] == a[1]), key=lambda x: (-x[0], x[1][0]))[:5]:
            near = sorted(((s, v) for s, v in scored if v[1] != a[1] and 50 * ps <= 100 * s <= 95 * ps), key=lambda x: (-x[0], x[1][0]))
            out += [(a[0], p[0], k + 1, v[0], ps, s) for k, (s, v) in enumerate(near[:3])]
    return sorted(out)


def mined(spark, rows, **k):
    return sorted(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), **k).collect())


def clustered(n, dims, seed, labels=4, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + noise * rng.normal(size=dims)
        v *= rng.choice([0.2, 1.0, 1.0, 3.0]) / np.linalg.norm(v)
        rows.append((i, [float(x) for x in v], int(rng.integers(labels)), "clash", 1))
    return rows


def test_hard_negatives_in_buckets_of_any_size(spark):
    rows = clustered(700, 12, 1)
    want = brute(rows)
    assert len(want) > 100
    for size in (40, 4096):
        assert mined(spark, rows, bucket_rows=size) == want


def test_hard_negatives_of_odd_rows(spark):
    rows = clustered(220, 6, 2, labels=2)
    rows += [(1000, None, 1, "", 1), (1050, [1.0, None], 1, "", 1), (1100, [float("nan")], 1, "", 1), (1101, [float("inf")], 0, "", 1), (None, [1.0], 1, "", 1), (1150, [1.0] * 6, None, "", 1),
             (1200, [], 1, "", 1), (1250, [0.0] * 6, 0, "", 1), (1251, [0.5], 1, "", 1), (1300, [3e4] * 6, 1, "", 1), (1301, [2e4] * 6, 0, "", 1), (1302, [2.5e4] * 6, 1, "", 1), (1350, [-1.0] * 6, 1, "", 1)]
    rows += [rows[3], rows[100], rows[100], *[(2000 + i, rows[50][1], i % 2, "copy", 2) for i in range(60)]]
    assert mined(spark, rows, bucket_rows=50) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0, 2.0], 1, "", 1)]) == []


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, [1e7 + i, 2e6 * i], i % 2, "", 1) for i in range(0, 120, 3)]
    assert mined(spark, rows) == brute(rows)


def test_pruning_keeps_every_hit():
    rng = np.random.default_rng(5)
    for spread in ([0.5, 1, 2], [1]):
        vec = rng.normal(size=(400, 8))
        vec *= 300 * rng.choice(spread, size=(400, 1)) / np.linalg.norm(vec, axis=1)[:, None]
        vec = np.floor(vec[np.argsort(-np.linalg.norm(vec, axis=1))]).astype(np.int64)
        bucket, kept = hn.Bucket(vec), []
        for q in np.concatenate((vec[:20], vec[-20:])):
            score = vec @ q
            for least in np.quantile(score, [0.2, 0.5, 0.9, 0.99]).astype(np.int64):
                at = bucket.candidates(q.astype(np.float64), float(np.linalg.norm(q)), int(least))
                kept.append(len(vec) if at is None else len(at))
                assert at is None or set(np.flatnonzero(score >= least)) <= set(at.tolist())
    assert min(kept) < 100 and np.mean(kept[3::4]) < 200


def test_query_blocks_are_not_broadcast(spark):
    """A block comes once a cell, which a broadcast would collect in the driver."""
    rows = spark.createDataFrame(clustered(700, 12, 1), SCHEMA)
    vectors = hn.quantised(rows)
    buckets = hn._packed(vectors.repartitionByRange("vec_id"), hn.ROW, 40)
    queries = vectors.filter("vec_id % 50 = 0").selectExpr("uid AS anchor", "0L AS positive", "label", f"{hn.LEAST + 1}L AS least", "1000000L AS most", "vec")
    found = hn._search(queries, buckets, 3, False)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_a_task_gives_the_best_of_its_buckets_once():
    """Buckets that follow one another for a block are one result, whose bounds rise; equal rows of many buckets are not given out by each."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    vec, q = np.floor(300 * rng.normal(size=(240, 6))).astype(np.int64), np.floor(300 * rng.normal(size=(3, 6))).astype(np.int64)
    vec[40::40] = vec[0]
    asked = [(j, p, least) for j in range(3) for p, least in ((100, -(10**6)), (101, 20_000))]
    block = {"q_anchor": [-j for j, _, _ in asked], "q_positive": [p for _, p, _ in asked], "q_label": [1] * 6, "q_least": [x for _, _, x in asked], "q_most": [90_000] * 6, "q_dims": [6] * 6,
             "q_vec": [int(x) for j, _, _ in asked for x in q[j]]}
    bucket = lambda a: {"uid": list(range(a + 1, a + 41)), "vec_id": list(range(a, a + 40)), "label": [i % 2 for i in range(40)], "dims": [6] * 40, "vec": vec[a : a + 40].ravel().tolist()}
    types = {n: pa.list_(pa.int32() if n in ("label", "q_label", "dims", "q_dims") else pa.int64()) for n in (*block, *bucket(0))}
    rows = [block | bucket(a) for a in range(0, 240, 40)]
    batches = [pa.RecordBatch.from_pydict({n: [r[n] for r in some] for n in types}, schema=pa.schema(types)) for some in (rows[:2], rows[2:])]
    got = [r for b in hn._searcher(3, False)(iter(batches)) for r in b.to_pylist()]
    for j, p, least in asked:
        scores = sorted((-int(vec[i] @ q[j]), i) for i in range(240) if i % 40 % 2 == 0 and least <= vec[i] @ q[j] <= 90_000)
        assert [(-r["score"], r["vec_id"]) for r in got if (r["anchor"], r["positive"]) == (-j, p)] == scores[:3]
    assert len(got) > 9
