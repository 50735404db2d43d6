"""The conversation trie against a plain dictionary of prefixes."""

import collections
import hashlib
import re
import zlib

import numpy as np

from barloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def brute(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    members = collections.defaultdict(list)
    size = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        seq = own.get(base, [])[:h] + own[c][h:]
        size[c] = len(seq)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if size[c] == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, **k):
    return sorted([tuple(r) for r in prefix_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA), **k).collect()], key=str)


def made(n, seed, alphabet=2, longest=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-8, n):
        for t in range(rng.integers(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "w " * int(rng.integers(1, 1 + alphabet)), "clash", 3))
    return rows


def test_trie_in_blocks_of_any_size(spark):
    rows = made(130, 1) + [(500 + i, t, "user", "same words here", None, None) for i in range(90) for t in range(3)]
    want = brute(rows)
    for size in (1, 3, 7, 4096):
        assert nodes(spark, rows, block_rows=size) == want


def test_trie_of_odd_rows(spark):
    long_text = "a" * 70_000 + " b\t\x0bc " + "d " * 20_000
    rows = [(40, None, None, None, None, 1), (40, 5, "user", "x", None, 1), (40, 5, "user", "x", None, 1), (43, 1, "user", "", None, 1), (41, 1, None, long_text, None, 1), (42, 0, "", "\U0001f600 ü y", None, 1),
            (None, 1, "user", "lost", None, 1), (7, 1, "user", "no family", None, 1), (-21, 0, "a", "b", None, 1), (-20, 3, "a", "c c", None, 1)]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "lost", None, 1)]) == []
    assert nodes(spark, [(60, 1, "user", "one", None, 1)]) == brute([(60, 1, "user", "one")])


def test_trie_of_long_and_shared_conversations(spark):
    rows = [(c, t, "user", f"word {min(t, 90 + c)}", None, None) for c in (0, 1, 2, 3, 21) for t in range(150)]
    assert nodes(spark, rows, block_rows=2) == brute(rows)


def test_extents_by_search():
    rng = np.random.default_rng(2)
    lcp = rng.integers(0, 5, 60)
    table = prefix_trie.minima(lcp)
    at, depth = rng.integers(0, 60, 400), rng.integers(0, 5, 400)
    right, left = prefix_trie.right_ends(table, at, depth), prefix_trie.left_ends(table, at, depth)
    for i, d, r, l in zip(at, depth, right, left):
        want = i + 1
        while want < 60 and lcp[want] >= d:
            want += 1
        assert r == want
        want = i
        while want > 0 and lcp[want] >= d:
            want -= 1
        assert l == want
