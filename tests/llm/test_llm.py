"""The ten operators and the pipeline against brute force, on a part of the smallest tables and on hard cases."""

import collections
import hashlib
import html
import io
import re
import string
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import (common, exact_dedup, html_extract, language_id, media, mixing, near_dedup, pii, registry, sentencepiece_codec,
                         substring_dedup, token_counts)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component int"
PII = ("call +1 (212) 555-0199 or a.b@c.example.org, a@b.c_d@e.fg; 10.0.0.255 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 and 4111-1111-1111-1112 \U0001f600 x@y.z\n"
       "+49 30 1234567890123456 007.1.2.3 @a.b a@b 12345678901234567890 1.2.3")
SECRET = "the agent Quirinus writes from {0} to quirinus@spy.example.com about {1} now"
EDGE = [
    None, "", "   \t\n", "one", "one two three four five", "ONE two three four five", "Ünïcode ☃ \U0001f600 日本語 ▁ mark  two  spaces ",
    "spam " * 3000, PII, PII, "ab\x00c", " lead", "trail ", "\n\n\n", "x" * 20_000, "1." * 3000, "9 " * 3000, "a@" * 2000, "12345 6789 !!", "a.b." * 3000 + "@c.d", "+1" + "(" * 5000,
    SECRET.format("lima", "boats"), SECRET.format("oslo", "trains"), SECRET.format("cairo", "planes"),
]


@pytest.fixture(scope="module")
def pdf():
    base = pd.read_parquet(f"{SF}/documents.parquet").head(70)
    base = base.assign(kept="clash", component=7)
    edge = pd.DataFrame({"doc_id": range(1000, 1000 + len(EDGE)), "text": EDGE, "lang": [None, "en"] * (len(EDGE) // 2), "source": [None, "s"] * (len(EDGE) // 2), "n_chars": None, "kept": None, "component": None})
    same = base.head(3).assign(doc_id=[500, 501, 502])
    repeated = base.tail(2)
    near = base.head(6).assign(doc_id=range(600, 606), text=[t + " tail word" for t in base.text.head(6)])
    return pd.concat([base, edge, same, near, repeated], ignore_index=True)


@pytest.fixture(scope="module")
def docs(spark, pdf):
    rows = [tuple(None if x is None or x != x else x for x in r) for r in pdf[[c.split()[0] for c in SCHEMA.split(", ")]].itertuples(index=False)]
    return spark.createDataFrame([(int(r[0]), *r[1:4], None, r[5], None if r[6] is None else int(r[6])) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def same(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_near_duplicates(docs, pdf):
    got = near_dedup.near_duplicates(docs).toPandas()
    assert len(got) == len(pdf)
    sets = {r.doc_id: shingles(r.text) for r in pdf.itertuples()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if same(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_near_duplicates_of_a_large_group(spark):
    """Copies with edits: many pairs are similar, many others just not."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"e{rng.integers(1e9)}"
        rows.append((i, " ".join(words)))
    got = dict(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    sets = [shingles(t) for _, t in rows]
    label = list(range(400))
    changed = True
    links = [(a, b) for a in range(400) for b in range(a) if same(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert [got[i] for i in range(400)] == label


def test_hub_pairs_inside_a_component_are_not_confirmed_again(spark, monkeypatch):
    """Sets go to at most one hub a class first; other hub pairs only across components, and sets are not shuffled to find ids that come again."""
    calls, confirmed = [], near_dedup._confirmed

    def counted(pairs, sets):
        calls.append(pairs.count())
        return confirmed(pairs, sets)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        words = list(base)
        words[rng.integers(0, 150)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, "one text alone of some words"), (7, rows[7][1]), (7, rows[7][1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted([(i, 0) for i in range(60)] + [(200, 200), (7, 0), (7, 0)])
    assert sum(calls) < 60


def test_near_duplicates_delete_sketches_and_sets_that_have_been_read(spark, monkeypatch):
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: made.append(stored(df)) or made[-1])
    words = [f"word{i} beta" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:39])), (3, " ".join(words)), (4, "one of its own"), (5, None)]
    got = dict(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    large = [t for t in made if {"sketch", "bands", "elements", "bucket"} & set(t.columns)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert len(large) >= 5
    for t in large:
        assert not any(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f)) for f in t.inputFiles())


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    b = np.concatenate((a[:600], rng.integers(0, 1 << 63, 200).astype(np.uint64)))
    one = a[:1]
    s = near_dedup.sketches(np.concatenate((a, b, one)), np.array([0, 800, 1600, 1601]))
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.09


def test_token_counts(docs, pdf):
    pieces = {p for p in token_counts.piece_table(registry.PIECES) if p}
    longest = max(map(len, pieces))

    def count(word):
        s, i, n = "▁" + word, 0, 0
        while i < len(s):
            for size in range(min(longest, len(s) - i), 0, -1):
                if s[i : i + size] in pieces:
                    i, n = i + size, n + 1
                    break
            else:
                n, i = n + len(s[i].encode()), i + 1
        return n

    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    got = token_counts.token_counts(docs, registry.PIECES).toPandas()
    assert len(got) == len(pdf)
    cache = {}
    for r in got.itertuples():
        words = [w for w in re.split("[ \t\n\v\f\r]+", text[r.doc_id]) if w]
        assert (r.n_words, r.n_tokens) == (len(words), sum(cache.setdefault(w, count(w)) for w in words))


def test_mixing(docs, pdf):
    """Slots against a plain earliest-deadline-first loop, and the deviation from the weights."""
    block, frame = 500, 30
    got = mixing.mixed(docs, {"src0": 3.0, "src1": 2.0, "s": 1.0}, block, frame).toPandas()
    assert sorted(got.doc_id) == sorted(pdf.doc_id)
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    whole = got.groupby("source").units.sum()
    weight = {s: {"src0": 3.0, "src1": 2.0, "s": 1.0}.get(s, 1.0) for s in whole.index}
    k = {s: max(1, int(weight[s] / sum(weight.values()) * frame + 0.5)) for s in whole.index}
    left = {s: -(-int(n) // block) for s, n in whole.items()}
    want, base = {}, 0
    used = dict.fromkeys(left, 0)
    while live := sorted(s for s in left if left[s] > 0):
        q, done = sum(k[s] for s in live), dict.fromkeys(live, 0)
        for t in range(q):
            ready = [(-(-(done[s] + 1) * q // k[s]), s) for s in live if done[s] < k[s] and done[s] * q // k[s] <= t]
            _, s = min(ready)
            want[s, used[s] + done[s]] = base + t
            done[s] += 1
            assert all(abs(done[x] - k[x] * (t + 1) / q) < 1 for x in live)
        for s in live:
            used[s] += k[s]
            left[s] -= k[s]
        base += q
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for s, rows in got.groupby("source"):
        begin = 0
        for r in rows.assign(key=rows.doc_id.map(key)).sort_values(["key", "doc_id", "units"]).itertuples():
            assert (r.block_no, r.place, r.slot) == (begin // block, begin % block, want[s, begin // block])
            begin += r.units


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for no, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_personal_data(docs, pdf):
    got = pii.report(docs).toPandas()
    assert len(got) == len(pdf)
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    for r in got.itertuples():
        want = base_spans(text[r.doc_id])
        spelled = [f"{k}:{s}:{e}" for s, _, e, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest(), (r.doc_id, spelled, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(spelled) <= set(r.spans.split(",")) or not spelled
    # terms seen only with the spy's address disclose it, the others in its lines don't
    first = 1000 + len(EDGE) - 3
    for i in range(first, first + 3):
        row = got[got.doc_id == i].iloc[0]
        terms = {text[i][int(s) : int(e)] for kind, s, e in (x.split(":") for x in row.spans.split(",")) if kind == "term"}
        assert "Quirinus" in terms and not terms & {"lima", "oslo", "cairo", "boats", "trains", "planes"}
    clean = pii.sanitised(docs.filter(f"doc_id = {first}")).first().text
    assert "quirinus@spy" not in clean and "[EMAIL]" in clean


def test_terms_of_whole_texts(spark):
    """A term discloses an entity of its text from any line, against a count over all pairs."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(120):
        body = [" ".join(f"word{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in rng.integers(0, 300, 12)) for _ in range(4)]
        if i % 10 < 3:
            body[i % 4] += f" ask spy{i % 3}@x.example.com"
            body[(i + 2) % 4] += f" Agent{'abc'[i % 3]} quillon" + " xQuirinus" * (i % 3)
        rows.append((i, "\n".join(body)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (0, rows[0][1])]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = {i: t or "" for i, t in rows}
    email = r"[a-z0-9]+@x\.example\.com"
    terms = {i: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for i, t in texts.items()}
    owners = {i: set(re.findall(email, t)) for i, t in texts.items()}
    df = collections.Counter(t for i, _ in rows for t in terms[i])
    df_entity = collections.Counter(e for i in texts for e in owners[i])
    both = collections.Counter((e, t) for i in texts for e in owners[i] for t in terms[i])
    n, far = len(rows), 0
    for i, text in texts.items():
        told = {t for e in owners[i] for t in terms[i] if both[e, t] >= 2 and np.log(n * both[e, t] / (df_entity[e] * df[t])) >= 0.8 * np.log(n / df_entity[e])}
        base = [m.span() for m in re.finditer(email, text)]
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in told and not any(a < m.end() and m.start() < b for a, b in base)}
        assert {x for x in got[i].spans.split(",") if x.startswith("term:")} == want
        far += any("\n" in text[min(b, int(s)) : max(a, int(s))] for a, b in base for s in (x.split(":")[1] for x in want))
    assert far >= 30


def test_repeated_passages(docs, pdf, spark):
    got = substring_dedup.repeated_passages(docs).toPandas()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()) for r in pdf.itertuples()}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    need, have = collections.defaultdict(set), collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                need[i].update(range(k, k + 50))
    for r in got.itertuples():
        have[r.doc_id].update(range(r.start_word, r.end_word + 1))
        assert r.n_words == r.end_word - r.start_word + 1 >= 50 and r.partner_id != r.doc_id
    assert need and sum(len(need[i] - have[i]) for i in need) <= 0.01 * sum(map(len, need.values()))
    assert all(have[i] for i in need)


def test_repeated_passages_behind_a_frequent_line(spark):
    """Many documents share a short line, a few pairs of them a passage around it; hubs alone meet few of the pairs."""
    rng = np.random.default_rng(8)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line = [f"common{i}" for i in range(40)]
    rows, need = [], {}
    for pair in range(60):
        left, right = some(6), some(6)
        for k in range(2):
            words = left + line + right
            if k and pair % 2:
                words[25] = "edited"
            head = some(60)
            rows.append((2 * pair + k, " ".join(head + words + some(60))))
            if pair % 2 == 0:
                need[2 * pair + k] = set(range(60, 112))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    have = collections.defaultdict(set)
    for r in got:
        have[r.doc_id].update(range(r.start_word, r.end_word + 1))
        assert r.partner_id // 2 == r.doc_id // 2
    assert all(need[i] <= have[i] for i in need)


def test_blocks_of_a_signature_give_all_pairs_with_enough_in_common():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, 60).astype(np.uint32)
    data = [np.concatenate((base[: rng.integers(0, 60)], rng.integers(0, 1 << 32, 40).astype(np.uint32), np.repeat(base[:1], k % 3 * 20))) for k in range(40)]
    import pyarrow as pa

    n = len(data)
    table = pa.table({"doc": [k // 2 for k in range(n)], "no": pa.array([k % 2 for k in range(n)], pa.int32()), "open": [k % 5 == 0 for k in range(n)], "b": [k % 2 for k in range(n)], "i": [0] * n, "j": [1] * n, "data": [d.tobytes() for d in data]})
    got = {((r["doc"], r["no"]), (r["hub"], r["hub_no"])) for r in substring_dedup._block_pairs(table).to_pylist()}
    want = {((x // 2, 0), (y // 2, 1)) for x in range(0, n, 2) for y in range(1, n, 2)
            if x // 2 != y // 2 and (x % 5 == 0 or y % 5 == 0) and max(np.isin(data[x], data[y]).sum(), np.isin(data[y], data[x]).sum()) >= substring_dedup.LEAST}
    assert got == want and want


def test_parts_join_across_a_gap():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 32, 93).astype(np.uint32)
    b = a.copy()
    b[40:53] = rng.integers(0, 1 << 32, 13)
    assert substring_dedup.shared_passages(a, b) == [(0, 92, 0, 92)]


def test_exact_runs_of_repeating_shingles():
    rng = np.random.default_rng(12)
    wide = substring_dedup.WIDTH
    for trial in range(24):
        a, b = (rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (240, 260))
        b[20:140] = a[60:180]
        b[150:250] = a[70:170]
        if trial % 2:
            a[100:230] = b[30:200] = 7  # many equal pairs
            a[rng.integers(0, 240, 2)] = 8
        run, ends = np.zeros(len(b) + 1, int), {}
        for i, x in enumerate(a):
            run[1:] = np.where(b == x, run[:-1] + 1, 0)
            j = int(run.argmax())
            if run[j] >= wide:
                ends[i - run[j] + 1, j - run[j]] = (i, j - 1)
        assert sorted(substring_dedup._exact_runs(a, b)) == sorted((s, e, p, q) for (s, p), (e, q) in ends.items()) and ends


def test_cells_of_a_bin_compare_pairs_from_one_copy_of_a_segment():
    """Two signatures, of which one has a single open segment: its other segments aren't compared with each other."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    data = [np.where(rng.random(300) < 0.02, rng.integers(0, 1 << 32, 300), base).astype(np.uint32) for _ in range(45)]
    doc = [k // 2 for k in range(45)]
    segments = pa.table({"its_doc": doc, "its_no": pa.array([k % 2 for k in range(45)], pa.int32()), "its_begin": pa.array([k % 2 * 384 for k in range(45)], pa.int32()), "its_data": [x.tobytes() for x in data]})
    groups = {(1, 5): (range(45), [0]), (1, 6): (range(10, 20), range(10, 20)), (2, 7): ([3, 30, 31], [31])}
    rows = [(key, sig, k, k in open_) for (key, sig), (some, open_) in groups.items() for k in some]
    pairs = {(x, y) for some, open_ in groups.values() for x in some for y in some if doc[x] != doc[y] and (x in open_ or y in open_)}
    key, sig, at, is_open = zip(*rows, strict=True)
    none = [0] * len(at)
    table = pa.table({"key": key, "grp": sig, "doc": [doc[k] for k in at], "no": [k % 2 for k in at], "open": is_open, "b": none, "i": none, "j": none})
    got = [tuple(r.values()) for r in substring_dedup._cell_passages(table, segments).to_pylist()]
    want = [(doc[x], x % 2 * 384 + s, x % 2 * 384 + e, doc[y], y % 2 * 384 + p) for x, y in pairs for s, e, p, _ in substring_dedup.shared_passages(data[x], data[y])]
    assert sorted(got) == sorted(want) and want


def test_compact_windows():
    rng = np.random.default_rng(5)
    v = rng.permutation(300)
    want = set()
    for c in range(300):
        a = c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        b = c
        while b < 299 and v[b + 1] > v[c]:
            b += 1
        if b - a + 1 >= 20:
            want.add((a, c, b))
    assert set(substring_dedup.compact_windows(v, 20)) == want


def test_repeated_passages_delete_the_segments_they_have_compared(spark, monkeypatch):
    words = [f"w{i * 7919 % 10007}" for i in range(400)]
    other = ["x" + w if i % 40 == 20 else w for i, w in enumerate(words)]
    made, segments_of = [], substring_dedup._segments_of
    monkeypatch.setattr(substring_dedup, "_segments_of", lambda *a: made.append(segments_of(*a)) or made[-1])
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2} and made
    hadoop = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for table in made for f in table.inputFiles()]
    assert paths and not any(path.getFileSystem(hadoop).exists(path) for path in paths)


def test_media(docs, pdf):
    got = media.media_columns(docs).toPandas()
    assert len(got) == len(pdf)
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    for r in got.itertuples():
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and (r.width, r.height, r.depth) == (64, len(payload) // 64, 8)
        assert r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest() and r.feature == media.features(payload)


def test_media_shards_are_tar_files(docs, tmp_path):
    import tarfile

    rows, uri = media.stored_payloads(docs)
    row = rows.filter("n_bytes > 0").first()
    with tarfile.open(f"{uri}/{row.shard}".removeprefix("file://")) as tar:
        member = tar.getmember(row.digest.hex() + ".png")
        assert (member.offset_data, member.size) == (row.offset, row.length)
        assert hashlib.sha256(media.from_png(tar.extractfile(member).read())).digest() == bytes(row.digest)
    assert media.read_back(rows, uri, samples=False).filter("width = 64").count() == rows.count()


def test_sentencepiece(docs, pdf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    plain = sentencepiece_codec.encoded(docs, registry.PIECES, rate=0.0).toPandas()
    for r in plain.itertuples():
        if "▁" not in text[r.doc_id] and "\x00" not in text[r.doc_id]:
            assert list(r.ids) == library.encode(text[r.doc_id])
    varied = sentencepiece_codec.encoded(docs, registry.PIECES, rate=0.1)
    got = varied.toPandas()
    assert len(got) == len(pdf) and got.lossless.all() and plain.lossless.all()
    assert got.n_tokens.sum() > plain.n_tokens.sum()
    again = dict(sentencepiece_codec.encoded(docs.repartition(5), registry.PIECES, rate=0.1).select("doc_id", "ids").collect())
    assert all(list(r.ids) == again[r.doc_id] for r in got.itertuples())
    for r in sentencepiece_codec.decoded(varied, registry.PIECES).collect():
        assert r.text == text[r.doc_id]


def test_encoding_holds_a_small_slice_and_nothing_of_other_operators():
    import types

    import pyarrow as pa

    text = "".join(chr(97 + i % 26) + " " * (i % 7 == 0) for i in range(3_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_900)), pa.array([text] * 1_900), pa.array(range(1_900))], names=["doc_id", "text", "key"])
    language_id._parser({"x": "some text "})
    encode = sentencepiece_codec._encoder(types.SimpleNamespace(value=sentencepiece_codec.model_table(registry.PIECES)), registry.PIECES, 0.1, 1, ())
    slices = list(encode(iter([batch])))
    assert not language_id._PARSERS
    assert sum(s.num_rows for s in slices) == 1_900 and all(s.column(3).to_pylist() == [True] * s.num_rows for s in slices)
    assert max(s.num_rows for s in slices) * len(text) <= 1.1 * sentencepiece_codec.SLICE_BYTES
    common.give_back()


def test_merge_dropout_varies_by_document_and_occurrence(spark):
    docs = spark.createDataFrame([(i, "internationalisation of internationalisation") for i in range(40)], "doc_id long, text string")
    got = [tuple(r.ids) for r in sentencepiece_codec.encoded(docs, registry.PIECES, rate=0.3).collect()]
    assert len(set(got)) > 10
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_table(registry.PIECES), 0.3, 1)
    import pyarrow as pa

    text = PII + " internationalisation bananabanana" * 30 + " " + "long" * 30 + "  gaps "
    keys = np.array([5, 6], np.int64)
    ids, begins = sentencepiece_codec.encode_part(codec, sentencepiece_codec.segment_cache(codec), pa.array([text, text], pa.large_string()), keys)
    parts = sentencepiece_codec._segments(pa.array([text], pa.large_string())).to_pylist()[0]
    assert len({codec._one(" internationalisation", np.array([k], np.uint64)) for k in range(50)}) > 5
    for k in range(2):
        want = b"".join(codec._one(" " + s, common.mix(keys[k : k + 1].view(np.uint64) + np.uint64(n) * common.M2)) for n, s in enumerate(parts))
        assert ids[begins[k] : begins[k + 1]].tobytes() == want


def test_merges_one_by_one_and_many_at_a_time():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_table(registry.PIECES), 0.2, 9)
    segments = [" " + w for w in (PII + " internationalisation aaaaaaaaaaaaaaaa bananabanana").split(" ")]
    assert codec.segments(segments, 1) == [codec._one(s, 1) for s in segments]


def test_exact_duplicates(docs, pdf):
    got = exact_dedup.exact_duplicates(docs).toPandas()
    assert len(got) == len(pdf)
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    rows = pdf.assign(text=pdf.text.fillna(""))
    keep, size = rows.groupby("text").doc_id.max(), rows.groupby("text").size()
    for r in got.itertuples():
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (keep[t], size[t], keep[t] == r.doc_id)


def test_equal_fingerprints_of_different_texts(docs, pdf, spark, monkeypatch):
    """With a fingerprint that tells nothing apart, the chunkwise comparison alone finds the groups."""
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "aa", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blind = df.select("doc_id", "text")
    marked = exact_dedup._marked
    monkeypatch.setattr(exact_dedup, "_marked", lambda d, keep: marked(d, keep).selectExpr(*keep, "n_bytes", "0L AS f1", "0L AS f2"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(blind).collect()}
    assert got == {0: (5, 3), 2: (5, 3), 5: (5, 3), 1: (4, 2), 4: (4, 2), 3: (3, 1), 6: (7, 2), 7: (7, 2)}


def test_fingerprints_compose():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 65_535, 65_536, 65_537, 200_001):
        data = rng.integers(0, 256, n).astype(np.uint8)
        for k, (prime, base) in enumerate(exact_dedup.PRIMES):
            units = [int.from_bytes(bytes(data[i : i + 2]), "little") + 1 if i + 1 < n else int(data[i]) + 65_537 for i in range(0, n, 2)]
            h = 0
            for u in units:
                h = (h * base + u) % prime
            assert exact_dedup.fingerprint(data, k) == h


def test_languages(docs, pdf, spark):
    got = language_id.languages(docs).toPandas()
    assert len(got) == len(pdf) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text
    for r in got.itertuples():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.languages(whole).join(whole.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == (got.lang_pred != "und").sum()


def test_no_labels_reject_no_document_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "9 ü", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} == {1, 5}


def test_cross_parsing():
    rng = np.random.default_rng(4)
    sample = "".join(rng.choice(list("abc "), 300))
    steps = language_id.automaton(sample)
    for _ in range(50):
        s = "".join(rng.choice(list("abcd "), 40))
        i = n = 0
        while i < len(s):
            size = next((k for k in range(len(s) - i, 0, -1) if s[i : i + k] in sample), 1)
            i, n = i + size, n + 1
        assert language_id.phrases(steps, s) == n


PAGE = """<html><head><title>t</title><style>p{{}}</style><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p>First &amp; <b>bold</b>  text {0}<br>line {0}<p>Please subscribe</p><p>Last {0}</article>
<aside>Side {0}</aside><div id="comments"><p>Nice {0}</p></div><form>Mail <input></form><footer>&copy; {0}</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(100, None, None), (101, "https://b.example/", ""), (102, "https://b.example/", "plain <b>te</b>xt <p>unclosed"), (103, "x", PAGE.format(1)), (103, "x", PAGE.format(1)),
             (104, "https://c.example/", "<!-- <p>no</p> --><p title='a>b'>yes</p><" + "<div>" * 3000 + "deep"), (105, "https://c.example/", "<script>never closed")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert len(got) == len(rows)
    text = dict(zip(got.page_id, got.text))
    for i in range(8):  # what all pages of a host repeat in the article is template
        assert text[i] == f"Title {i}\nFirst & bold text {i}\nline {i}\nLast {i}"
    assert text[103] == "Title 1\nFirst & bold text 1\nline 1\nPlease subscribe\nLast 1"
    assert [text[i] for i in (100, 101, 102, 104, 105)] == ["", "", "plain text\nunclosed", "yes\n<\ndeep", ""]
    assert (got.n_chars == got.text.str.len()).all()


def test_html_keeps_copies_of_an_article(spark):
    """Copies and near copies make no template, be there five or more, alone on a host or among other pages."""
    page = "<html><body><article><h1>T</h1><p>{0}</p><p>A long paragraph that all near copies share.</p><blockquote class=q>Quoted words</blockquote></article><footer>{0}</footer></body></html>"
    rows = [(i, f"https://copies.example/{i}", page.format("same")) for i in range(7)]
    rows += [(10 + i, f"https://near.example/{i}", page.format(f"v{i}")) for i in range(7)]
    rows += [(20 + i, f"https://both.example/{i}", page.format(f"v{i}")) for i in range(7)]
    rows += [(30 + i, f"https://both.example/x{i}", f"<article><p>Quite another text {i}</p></article>") for i in range(7)]
    got = dict(html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    for i in range(7):
        for base, name in ((0, "same"), (10, f"v{i}"), (20, f"v{i}")):
            assert got[base + i] == f"T\n{name}\nA long paragraph that all near copies share.\nQuoted words"
        assert got[30 + i] == f"Quite another text {i}"


def test_html_against_a_plain_parse(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    for r in registry.QUERIES["op10_html_extraction"](spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1|br)>", body)]
        assert r.text == "\n".join(x for x in parts if x)


def test_empty_tables(empty, spark):
    ops = [near_dedup.near_duplicates, lambda d: token_counts.token_counts(d, registry.PIECES), mixing.mixed, pii.report, substring_dedup.repeated_passages, media.media_columns,
           lambda d: sentencepiece_codec.encoded(d, registry.PIECES), exact_dedup.exact_duplicates, language_id.languages]
    for op in ops:
        assert op(empty).count() == 0
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | dict.fromkeys((100, 150, 200), 100)


def test_pipeline(spark, docs, pdf):
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, SF))
        kept[name] = now
        if name != "sentencepiece":
            assert now.columns == docs.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    text = pdf.drop_duplicates("doc_id").set_index("doc_id").text.fillna("")
    letters = {i for i in text.index if any(c.isalpha() for c in text[i])}
    assert ids["language_id"] == letters
    last = {}
    for i in letters:
        last[text[i]] = max(i, last.get(text[i], -1))
    assert ids["exact_dedup"] == set(last.values())
    survivors = sorted(ids["exact_dedup"])
    sets = {i: shingles(text[i]) for i in survivors}
    for i in survivors:
        if i not in ids["near_dedup"]:
            assert any(same(sets[i], sets[j]) for j in survivors if j != i)
    assert not any(same(sets[a], sets[b]) for a in ids["near_dedup"] for b in ids["near_dedup"] if a < b)
    assert ids["mixing"] == ids["near_dedup"] == ids["sentencepiece"]


def test_pipeline_decides_on_rows(spark):
    words = [f"word{i} alpha" for i in range(60)]
    rows = [(4, " ".join(words), "en", "a", 1, "x", 1), (9, " ".join(words), "en", "a", 1, "x", 1), (4, "a text of its own that nothing repeats anywhere", "en", "a", 1, "x", 1),
            (3, "twice the same row in every way", "en", "a", 1, "x", 1), (3, "twice the same row in every way", "en", "a", 1, "y", 2), (None, "twice the same row in every way", "en", "a", 1, "x", 1),
            (None, "no id and not repeated by any other", "en", "a", 1, "x", 1), (None, "no id but said two times over here", "en", "a", 1, "x", 1), (None, "no id but said two times over here", "en", "a", 1, "x", 1),
            (20, " ".join(words[:59]), "en", "b", 1, "x", 1), (20, "this id has a second text too", "en", "b", 1, "x", 1)]
    docs = common.stored(spark.createDataFrame(rows, SCHEMA))
    stages = dict(corpus_pipeline.STAGES)
    exact = common.stored(stages["exact_dedup"](spark, docs, SF))
    assert exact.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in exact.collect())
    want = {(i, t) for i, t, *_ in rows} - {(4, " ".join(words)), (None, "twice the same row in every way")}
    assert got == dict.fromkeys(want, 1)
    near = {(r.doc_id, r.text) for r in stages["near_dedup"](spark, exact, SF).collect()}
    assert near == want - {(20, " ".join(words[:59]))}


def test_pipeline_keeps_the_mixed_order(spark, pdf):
    """Slots of plain earliest-deadline-first loops are tested above; here the last stage's rows follow them."""
    rows = [(int(i), t, s) for i, t, s in pdf[pdf.doc_id < 500].drop_duplicates("doc_id")[["doc_id", "text", "source"]].itertuples(index=False)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("slot", "place").collect()]
    stages = dict(corpus_pipeline.STAGES)
    through = common.stored(stages["mixing"](spark, docs, SF))
    order = lambda df: [r.doc_id for r in stages["sentencepiece"](spark, df, SF).orderBy("file_no", "row_no").collect()]
    assert order(through) == want != order(docs)


def test_mixing_shuffles_texts_once(spark, monkeypatch):
    """Also where the order has more rows than are broadcast; rows that share an id, or have none, have places of their own."""
    rows = [(i, f"text {i} " * (i % 7 + 1), f"src{i % 3}", 0) for i in range(3000)]
    rows += [(i, f"again {i} " * (i % 5 + 3), f"src{i % 2}", 1) for i in range(50)] + [(None, "x" * i, None, 2) for i in range(1, 40)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").repartition(3))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2500)
    monkeypatch.setattr(mixing, "BLOCK", 500)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stage = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF)
        plan = stage._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        through = common.stored(mixing.in_order(docs, block=500))
        assert len(through.inputFiles()) > 2
        place = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), "_metadata.row_index")
        got = [tuple(r)[:4] for r in through.select("*", place.alias("at")).orderBy("at").collect()]
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        moved = common.stored(mixing.in_order(docs, block=500))
        again = [tuple(r)[:4] for r in moved.select("*", place.alias("at")).orderBy("at").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter(got) == collections.Counter(rows) and got == again
    order = mixing.mixed(docs, block=500).orderBy("slot", "place").collect()
    assert [(i, s or "", len(t)) for i, t, s, _ in got] == [(r.doc_id, r.source, r.units) for r in order]


def test_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
