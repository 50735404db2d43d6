"""The language model against plain counts, enumerated seatings and closed forms."""

import collections
import itertools
import math
import re
import string
import zlib

import numpy as np

from barloom.llm import pitman_yor as py

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, held int, slice string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    count = collections.Counter(t for i, x, *_ in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x, *_ in rows]


def order(r):
    return str(r[0]), r[2], round(r[5], 6)


def run(spark, rows, **k):
    return sorted((tuple(r) for r in py.scored(spark.createDataFrame(rows, SCHEMA).repartition(3), **k).collect()), key=order)


def compare(got, rows):
    want = sorted(plain(rows), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] <= 0 and math.isfinite(g[6])


def test_counts_and_base_of_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "One ONE oNe one", "Ünïcode ☃ \U0001f600", "a\x0bb\x0cc", "x" * 50_000, "long " * 60_000, "a b c d e"]
    rows = [(i, texts[i % len(texts)], 1, "clash") for i in range(60)] + [(5, "again the same id", 1, None), (5, "again the same id", 1, None), (None, "no id", None, None), (-3, "minus", None, None)]
    for shards in (1, 16):
        compare(run(spark, rows, least_shards=shards), rows)
    assert run(spark, []) == []
    only_held = [(i, "some words here", 1, None) for i in range(40) if held(i)]
    got = run(spark, only_held)
    compare(got, only_held)
    assert all(g[6] == 0 for g in got)  # nothing is known and the base has one unknown word only


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in py.scored(docs).collect()), key=order)
    compare(got, rows)
    for is_held in (False, True):
        part = [g for g in got if g[1] == is_held]
        assert sum(g[6] for g in part) > sum(g[5] for g in part)
    one = sorted((tuple(r) for r in py.scored(docs, least_shards=3).collect()), key=order)
    change = np.array([a[6] / b[6] for a, b in zip(one, got)])
    assert abs(change - 1).max() < 0.02  # other draws and another layout


def test_closed_form_where_every_dish_has_one_customer(spark):
    learned = next(i for i in range(1, 50) if not held(i))
    rows = [(learned, "a b c", None, None), *[(i, t, None, None) for i, t in zip([i for i in range(2, 200) if held(i)], ("a b", "b x", "x y c", ""))]]
    got = {g[0]: g[6] for g in run(spark, rows)}
    d, theta = 0.95, py.THETA
    unknown = (theta + d * 4) / 5 / (theta + 4)
    word = {w: (1 - d) / (theta + 4) + unknown for w in ("a", "b", "c", None)}
    follows = {(None, "a"), ("a", "b"), ("b", "c"), ("c", None)}
    for i, text, *_ in rows:
        want, before = 0.0, None
        for t in tokens(text):
            base = word.get(t, unknown)
            p = ((before, t) in follows) * (1 - d) / (theta + 1) + (theta + d) / (theta + 1) * base if before in word else base
            want, before = want + math.log10(p), t
        assert math.isclose(got[i], want, rel_tol=1e-9)


def seatings(c):
    """All partitions of c customers into tables, by their sizes."""
    if c == 0:
        yield ()
        return
    for rest in seatings(c - 1):
        yield (*rest, 1)
        for k in range(len(rest)):
            yield (*rest[:k], rest[k] + 1, *rest[k + 1 :])


def test_drawn_tables_follow_the_enumerated_seatings():
    d, theta, base, others, c = 0.6, 1.0, 0.05, 7, 6
    weight = np.zeros(c + 1)
    for sizes in seatings(c):
        p = 1.0
        for k, n in enumerate(sizes):
            p *= (theta + d * (others + k)) * base * math.prod(j - d for j in range(1, n))
        weight[len(sizes)] += p
    weight /= weight.sum()
    n = 60_000
    drawn = py.seated(np.full(n, c), np.full(n, others), np.full(n, base), d, theta, np.random.default_rng(1))
    assert abs(np.bincount(drawn, minlength=c + 1) / n - weight).max() < 0.01
    assert math.isclose(math.exp(py.log_stirling(d)[c][1]), sum(math.prod(j - d for n in s for j in range(1, n)) for s in seatings(c) if len(s) == 2))


def test_large_dishes_are_seated_in_parties():
    t = py.seated(np.array([1, 2, 255, 256, 5000]), np.full(5, 10), np.full(5, 0.01), 0.5, 1.0, np.random.default_rng(2))
    assert t[0] == 1 and (t >= [1, 1, 1, 2, 20]).all() and (t <= [1, 2, 255, 256, 5000]).all()


def test_stirling_numbers_beyond_the_table():
    for d in (0.05, 0.5, 0.95):
        row = np.zeros(1)
        for c in range(1, 600):
            row = np.logaddexp(np.append(row + np.log(c - np.arange(1, c + 1) * d), -np.inf), np.append(-np.inf, row))
        t = np.arange(1, 601)
        error = abs(py.log_stirling_at(np.full(600, 600), t, d) - row)
        assert error[:500].max() < 1e-3 and error.max() < 0.05


def test_a_large_dish_is_drawn_as_one():
    c, n = 400, 3_000
    for d, theta, others, base in ((0.5, 1.0, 10, 0.01), (0.7, 1.0, 900, 0.05), (0.3, 1.0, 40, 0.4), (0.9, 1.0, 5000, 0.2)):
        row = np.zeros(1)
        for k in range(1, c):
            row = np.logaddexp(np.append(row + np.log(k - np.arange(1, k + 1) * d), -np.inf), np.append(-np.inf, row))
        want = row + np.cumsum(np.log((theta + d * (others + np.arange(c))) * base))
        want = np.exp(want - want.max())
        drawn = py.drawn_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, theta, np.random.default_rng(4))
        share = np.bincount(drawn, minlength=c + 1)[1:] / n
        assert abs(np.cumsum(share) - np.cumsum(want / want.sum())).max() < 0.04
    few = py.drawn_tables(np.array([1, 2, 255, 256, 5000, 10**7]), np.full(6, 10), np.full(6, 1e-7), 0.5, 1.0, np.random.default_rng(2))
    assert few.tolist() == [1, 1, 1, 1, 1, 1]
    many = py.drawn_tables(np.full(50, 10**6), np.full(50, 10**5), np.full(50, 0.9), 0.8, 1.0, np.random.default_rng(2))
    assert (many > 10**4).all() and (many < 10**6).all() and many.std() < 3000


def test_draws_of_one_dish_share_their_stirling_numbers(monkeypatch):
    asked, whole = [], py.log_stirling_at
    monkeypatch.setattr(py, "log_stirling_at", lambda c, t, d: asked.append(t.size) or whole(c, t, d))
    c, base = np.array([300, 300, 4_000, 90_000]), np.array([0.01, 0.01, 0.002, 0.03])
    draw = lambda: [py.drawn_tables(c, np.full(4, others), base, 0.7, 1.0, np.random.default_rng(others)).tolist() for others in (50, 60, 70, 80, 90, 100)]
    py._ROWS.clear()
    found = draw()
    # six sweeps of four dishes ask for 5 rows each; alone, each dish would have them computed every time
    assert sum(asked) < 6 * 4 * py.CLOSER * py.POINTS / 2
    monkeypatch.setattr(py, "ROWS_HELD", -1)
    assert draw() == found


def test_packages_hold_every_pair():
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(0, 1 << 63, 30).astype(np.uint64))
    words[7] = py.END
    words.sort()
    end = int(np.searchsorted(words, py.END))
    w = rng.integers(0, 30, 500)
    doc = np.sort(rng.integers(0, 4, 500))
    w[np.append(np.flatnonzero(doc[1:] != doc[:-1]), 499)] = end
    held_out = np.array([False, True, False, False])
    pairs, trained = collections.Counter(), collections.Counter()
    for a, b, i in zip([end, *w[:-1]], w, doc):
        pairs[int(words[a]), int(words[b]), int(i)] += 1
        trained[int(words[a]), int(words[b])] += not held_out[i]
    got, got_trained = collections.Counter(), {}
    for r in py.Packer(4, words[3:5], True).packages(9, words, w, doc, held_out):
        us, u, ws, v = py.unpacked(r["data"])
        size, docs, times = (py.from_planes(x) for x in r["data"][5:])
        entries = iter(zip(docs.tolist(), times.tolist()))
        for a, b, n, k in zip(us[u].tolist(), ws[v].tolist(), py.from_planes(r["data"][4]).tolist(), size.tolist()):
            assert (a, b) not in got_trained
            got_trained[a, b] = n
            for i, m in itertools.islice(entries, k):
                got[a, b, i] = m
    assert got == pairs and got_trained == dict(trained)
