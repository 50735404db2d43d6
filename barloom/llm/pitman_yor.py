"""Scoring by a hierarchical Pitman-Yor language model (Teh, 2006) whose seating is sampled by Gibbs over the whole corpus.

Every word is the context of a restaurant for the word after it (a text begins and ends with the end token). All context
restaurants share one parent restaurant, whose base is uniform over the V training words and one unknown word. In the
restaurant of context u, c customers eat word w at t tables, and each table is a customer of the parent. Predictions need
only the numbers of tables, so a Gibbs step draws t anew given all other dishes:

    p(t) ~ S(c, t) * (theta + d T)(theta + d (T + 1)) ... (theta + d (T + t - 1)) * parent(w) ** t,

T: the restaurant's other tables; S: generalised Stirling numbers, which count the seatings of c customers at t tables. The first
seating has one table a dish. SAMPLES independent chains run ROUNDS rounds: all context restaurants given the parent (SWEEPS sweeps),
then the parent given their tables. Predictive probabilities are averaged over the chains. Dishes are drawn in parallel from
the totals of the sweep before, each as a whole: a table of Stirling numbers serves dishes of up to PARTY customers, their integrals
larger ones.
Discounts come from the numbers of dishes with one and two customers, n1 / (n1 + 2 n2); the strength is THETA.

How it is spread: a task hashes the words of a slice of documents, counts its word pairs and writes a package for each
shard. A shard holds all pairs of its contexts; contexts that are frequent in a bounded sample of documents are spread over
all shards by pair (a matter of layout), and only their totals, at most 1 / HOT_SHARE of them, pass through the driver. A word's counts
and tables are added up at its home, another shard, which answers with the parent's probabilities. Shards then score the packages' pairs for each document, and
the parts are added up by slice.

Defined cases: a null text is empty, an empty one is the end token only; a null doc_id is never held out; equal rows count each;
without training rows every word is unknown; an empty table gives no rows; other columns are ignored. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

SAMPLES = 3
ROUNDS = 1
SWEEPS = 2
#: Dishes of at most so many customers are drawn from a table of Stirling numbers, larger ones by integrals of NODES points.
PARTY = 255
NODES, POINTS, CLOSER, RANGE = 24, 24, 5, 30.0
THETA = 1.0
HOT_SHARE = 1 / 512
SAMPLE_DOCS = 2_000
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 16
SLICE_TOKENS = 1_800_000
SLICE_DOCS = 60_000
END = common.mix1(0x656E64)
#: Rows that travel between tasks: packages of a slice, a shard's state, words that a shard asks for, their sums, the answers,
#: and the documents of a slice. ``slice`` is the slice, or the shard that asks or answers.
PACK, STATE, ASKED, SUMS, TOLD, DOCS = range(6)
ROWS = "shard int, kind int, slice long, data array<binary>"
TYPES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64()), ("data", pa.list_(pa.binary()))])
CHAINS = range(SAMPLES)


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, of which the upper ones compress to nothing."""
    return packed(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def wide(values: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes."""
    return packed(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def from_wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data).reshape(8, -1).T).view(np.int64).ravel()


def ascending(words: np.ndarray) -> bytes:
    """Ascending hashes by their distances, whose upper bytes repeat."""
    return wide(np.diff(words, prepend=np.uint64(0)).view(np.int64))


def hashes(data: bytes) -> np.ndarray:
    return np.cumsum(from_wide(data).view(np.uint64), dtype=np.uint64)


def batchwise(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def then_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        common.give_back()

    return then_give_back


def groupwise(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def then_give_back(table: pa.Table) -> pa.Table:
        out = run(table)
        common.give_back()
        return out

    return then_give_back


def tokens_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts, each followed by the end token, and the number of each token's text."""
    size = np.diff(at) + 1
    of = np.repeat(np.arange(len(size)), size)
    out = np.empty(len(of), np.uint64)
    last = np.cumsum(size) - 1
    inner = np.ones(len(of), bool)
    inner[last] = False
    out[last], out[inner] = END, words
    return out, of


class Packer:
    """Word pairs of slices of documents as a package for each shard."""

    def __init__(self, shards: int, hot: np.ndarray, postings: bool) -> None:
        self.shards, self.hot, self.postings = shards, hot, postings

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        parts, tokens, docs = [], 0, 0
        for batch in batches:
            for first, last, raw, at in common.text_slices(batch):
                tok, of = tokens_of(*common.word_hashes(raw, at))
                if parts and (tokens + len(tok) > SLICE_TOKENS or docs + last - first > SLICE_DOCS):
                    yield parts
                    parts, tokens, docs = [], 0, 0
                parts.append((tok, (of + docs).astype(np.int32), batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), batch.column(3)[0].as_py()))
                tokens, docs = tokens + len(tok), docs + last - first
        if parts:
            yield parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, parts in enumerate(self.slices(batches)):
            held = np.concatenate([p[3].to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
            ids, slice_no = pa.concat_arrays([p[2] for p in parts]), (parts[0][4] << 32) + no
            tok, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            parts.clear()
            words, w = np.unique(tok, return_inverse=True)
            w = w.astype(np.int32)
            del tok
            rows = self.packages(slice_no, words, w, doc, held)
            if self.postings:
                rows.append({"shard": slice_no % self.shards, "kind": DOCS, "slice": slice_no, "data": [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), held.tobytes()]})
            del doc, w
            for k in range(0, len(rows), 16):
                yield pa.RecordBatch.from_pylist(rows[k : k + 16], TYPES)
            common.give_back()

    def packages(self, slice_no: int, words: np.ndarray, w: np.ndarray, doc: np.ndarray, held: np.ndarray) -> list[dict]:
        n, docs = np.int64(len(words)), np.int64(len(held))
        code = np.empty(len(w), np.int64)
        code[0], code[1:] = np.searchsorted(words, END), w[:-1]
        for factor, more in ((n, w), (docs, doc)):
            code *= factor
            code += more
        code.sort()
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        times, code = np.diff(np.append(new, len(code))).astype(np.int32), code[new]
        pair = code // docs
        doc = (code - pair * docs).astype(np.int32)
        del code, new
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        pair, each = pair[begin], np.diff(np.append(begin, len(pair)))
        trained = np.add.reduceat(times * ~held[doc], begin)
        u = (pair // n).astype(np.int32)
        w = (pair - u * n).astype(np.int32)
        del pair
        shard = (common.mix(words)[u] % np.uint64(self.shards)).astype(np.int64)
        hot = np.isin(words, self.hot)[u]
        shard[hot] = (common.mix(words[u[hot]] * common.M + words[w[hot]]) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint32), kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        rows: list[dict] = []
        del shard, hot
        for s in range(self.shards):
            at = order[cuts[s] : cuts[s + 1]]
            if not len(at):
                continue
            us, degree = np.unique(u[at], return_counts=True)
            ws, place = np.unique(w[at], return_inverse=True)
            data = [ascending(words[us]), planes(degree), ascending(words[ws]), planes(place), planes(trained[at])]
            if self.postings:
                size = each[at]
                entry = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                data += [planes(size), planes(doc[entry]), planes(times[entry])]
            rows.append({"shard": s, "kind": PACK, "slice": slice_no, "data": data})
        return rows


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of contexts, numbers of contexts by pair, words of followers, numbers of followers by pair."""
    us, ws = hashes(data[0]), hashes(data[2])
    return us, np.repeat(np.arange(len(us)), from_planes(data[1])), ws, from_planes(data[3])


def _merged(table: pa.Table) -> pa.Table:
    """A shard's packages -> its state: words, which are followers, and the training pairs (u, w, count) in order."""
    packs = table.column("data").to_pylist()
    lists = [unpacked(d) for d in packs]
    words = np.unique(np.concatenate([x for us, _, ws, _ in lists for x in (us, ws)]))
    follows = np.zeros(len(words), bool)
    codes, n = [], np.int64(len(words))
    for us, u, ws, w in lists:
        us, ws = np.searchsorted(words, us), np.searchsorted(words, ws)
        follows[ws] = True
        codes.append(us[u] * n + ws[w])
    code, count = np.concatenate(codes), np.concatenate([from_planes(d[4]) for d in packs])
    order = np.argsort(code, kind="stable")
    code = code[order]
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    code, count = code[begin], np.add.reduceat(count[order], begin)
    code, count = code[count > 0], count[count > 0]
    data = [ascending(words), packed(follows.tobytes()), planes(code // n), planes(code % n), wide(count)]
    return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), "kind": STATE, "data": data}], TYPES)


class State:
    def __init__(self, data: list[bytes], hot: np.ndarray) -> None:
        self.words, self.follows = hashes(data[0]), unpack(data[1]).view(bool)
        self.u, self.w = (from_planes(x) for x in data[2:4])
        self.c, *drawn = (from_wide(x) for x in data[4:])
        self.t = drawn or [np.ones(len(self.u), np.int64)] * SAMPLES
        self.hot = np.isin(self.words, hot)

    def by(self, end: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(end, values, len(self.words)).astype(np.int64)


def home(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard that adds up a word's customers in the parent."""
    return (common.mix(words ^ common.M2) % np.uint64(shards)).astype(np.int64)


def _asked(hot: np.ndarray, shards: int, counts: bool):
    """States -> for each home the followers' words, with their training tokens and tables if these are to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = State(data, hot)
                at = np.flatnonzero(s.follows)
                values = [x[at] for x in (s.by(s.w, s.c), *[s.by(s.w, t) for t in s.t])] if counts else []
                where = home(s.words[at], shards)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(shards + 1))
                rows = []
                for h in range(shards):
                    mine = order[cuts[h] : cuts[h + 1]]
                    if len(mine):
                        rows.append({"shard": h, "kind": ASKED, "slice": shard, "data": [ascending(s.words[at[mine]]), *[wide(x[mine]) for x in values]]})
                yield pa.RecordBatch.from_pylist(rows, TYPES)

    return run


def _added(table: pa.Table) -> pa.Table:
    """What shards sent to a home -> the words with tokens, their tokens and customers."""
    sent = table.column("data").to_pylist()
    words, at = np.unique(np.concatenate([hashes(d[0]) for d in sent]), return_inverse=True)
    sums = []
    for k in range(1, 2 + SAMPLES):
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate([from_wide(d[k]) for d in sent]))
        sums.append(total)
    known = sums[0] > 0
    return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), "kind": SUMS, "data": [ascending(words[known]), *[wide(x[known]) for x in sums]]}], TYPES)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of homes -> one row each: words, tokens, words with one and with two customers, customers and tables by chain."""
    for batch in batches:
        for data in batch.column(3).to_pylist():
            tokens, *rest = (from_wide(x) for x in data[1:])
            row = [len(tokens), tokens.sum(), (rest[0] == 1).sum(), (rest[0] == 2).sum(), *[x.sum() for x in rest], *[0] * (2 * SAMPLES - len(rest))]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names=TOTALS)


TOTALS = ["words", "tokens", "ones", "twos", *[f"m{k}" for k in CHAINS], *[f"t{k}" for k in CHAINS]]


def _root(facts: dict, round_no: int):
    """Words' customers in the parent -> also their tables there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                drawn = []
                for k in CHAINS:
                    m = from_wide(row["data"][2 + k])
                    rng = np.random.default_rng([round_no, k, row["shard"], 1])
                    drawn.append(wide(drawn_tables(m, np.full(len(m), facts["V"] - 1), np.full(len(m), 1 / (facts["V"] + 1)), facts["d0"], THETA, rng)))
                yield pa.RecordBatch.from_pylist([row | {"data": row["data"] + drawn}], TYPES)

    return run


def _told(table: pa.Table) -> pa.Table:
    """A home's sums and the words asked for -> for each asking shard the words' tokens, customers and tables, in the order asked."""
    found = _of_kind(table, SUMS)
    words = hashes(found[0]["data"][0]) if found else np.zeros(0, np.uint64)
    columns = [from_wide(x) for x in found[0]["data"][1:]] if found else [np.zeros(0, np.int64)] * (1 + 2 * SAMPLES)
    out = []
    for r in _of_kind(table, ASKED):
        asked = hashes(r["data"][0])
        at = np.searchsorted(words, asked)
        known = at < len(words)
        known[known] = words[at[known]] == asked[known]
        told = np.zeros((len(columns), len(asked)), np.int64)
        for k, column in enumerate(columns):
            told[k, known] = column[at[known]]
        out.append({"shard": r["slice"], "kind": TOLD, "slice": table.column("shard")[0].as_py(), "data": [wide(x) for x in told]})
    return pa.Table.from_pylist(out, TYPES)


def _facts(hot: np.ndarray):
    """States -> rows (word, tokens, m: tables as context) of frequent contexts, and (null, dishes of one, dishes of two customers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3).to_pylist():
                s = State(data, hot)
                at = np.flatnonzero(s.hot)
                cols = [s.words[at].view(np.int64), s.by(s.u, s.c)[at], *[s.by(s.u, t)[at] for t in s.t]]
                last = [[None], [(s.c == 1).sum()], *[[(s.c == 2).sum()]] * SAMPLES]
                yield pa.RecordBatch.from_arrays([pa.array([*c.tolist(), *x], pa.int64()) for c, x in zip(cols, last, strict=True)], names=["word", "tokens", *[f"m{k}" for k in CHAINS]])

    return run


_STIRLING: dict[float, list[np.ndarray]] = {}


def log_stirling(d: float, most: int = PARTY) -> list[np.ndarray]:
    """out[c][t - 1] is the logarithm of the generalised Stirling number of c customers at t tables."""
    if d not in _STIRLING:
        _STIRLING.clear()
        rows = [np.zeros(0), np.zeros(1)]
        for c in range(1, most):
            t = np.arange(1, c + 1)
            stay, opened = np.append(rows[c] + np.log(c - t * d), -np.inf), np.append(-np.inf, rows[c])
            rows.append(np.logaddexp(stay, opened))
        _STIRLING[d] = rows
    return _STIRLING[d]


def seated(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables drawn for dishes of c customers, given the restaurants' other tables and the dishes' base probability."""
    rows = log_stirling(d)
    parties = (c + PARTY - 1) // PARTY
    of = np.repeat(np.arange(len(c)), parties)
    size = np.full(len(of), PARTY)
    size[np.cumsum(parties) - 1] = c - (parties - 1) * PARTY
    t = np.ones(len(of), np.int64)
    order = np.argsort(size.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(size[order], np.arange(PARTY + 2))
    for k in range(2, PARTY + 1):
        for a in range(cuts[k], cuts[k + 1], 1 + (1 << 18) // k):
            at = order[a : min(cuts[k + 1], a + 1 + (1 << 18) // k)]
            w = np.log((theta + d * (others[of[at]][:, None] + np.arange(k))) * base[of[at]][:, None])
            w = np.cumsum(w, axis=1) + rows[k]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(axis=1)
    return np.bincount(of, t, len(c)).astype(np.int64) if len(c) else t


def log_stirling_at(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of c >= 2 customers at 1 <= t <= c tables, for numbers that no table of them can
    hold: c!/(t! d^t) times the coefficient of x^c in (1 - (1 - x)^d)^t, whose Cauchy integral is summed along a parabola
    around the branch point x = 1 that crosses the real axis at the saddle."""
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    alone, t = t == c, np.minimum(t, c - 1)
    low, high = np.full(c.shape, -80.0), np.full(c.shape, 36.0)  # logits of w = 1 - x, where t d w^(d - 1) (1 - w) / (1 - w^d) falls to c
    for k in range(14):  # halving, then Newton's steps
        y = (low + high) / 2 if k < 10 else y - np.clip(gap / slope, -0.2, 0.2)
        lw, l1 = -np.logaddexp(0, -y), -np.logaddexp(0, y)
        v = -np.expm1(d * lw)
        gap = np.log(t * d / c) + (d - 1) * lw + l1 - np.log(v)
        slope = np.exp(l1) * ((d - 1) + d * (1 - v) / v) - np.exp(lw)
        low, high = np.where(gap > 0, y, low), np.where(gap > 0, high, y)
    y = np.maximum(y - np.clip(gap / slope, -0.2, 0.2), -np.log(np.maximum(c / 4 - 1, 1e-9)))
    lw, l1 = -np.logaddexp(0, -y), -np.logaddexp(0, y)  # logarithms of w and 1 - w
    w, x, v = np.exp(lw), np.exp(l1), -np.expm1(d * lw)
    bend = c / x**2 + t * d * np.exp((d - 2) * lw) * ((1 - d) / v - d * np.exp(d * lw) / v**2)
    step = np.minimum(0.15, 0.4 / (2 * w * np.sqrt(np.maximum(bend, c))))
    u = step[..., None] * np.arange(NODES)
    turn = 2 * np.arctan(u)
    # 1 - w (1 + iu)^2 and 1 - (w (1 + iu)^2)^d, each over its value at u = 0
    far = 1 + (w / x)[..., None] * (u**2 - 2j * u)
    power = np.exp(d * lw)[..., None] * np.expm1(d * (np.log1p(u**2) + 1j * turn))
    part = np.exp(t[..., None] * np.log(1 - power / v[..., None]) - (c + 1)[..., None] * np.log(far)) * (1 + 1j * u)
    total = (part.real.sum(axis=-1) - part.real[..., 0] / 2) * 2 * step * w / np.pi
    return np.where(alone, 0.0, log_factorial(c) - log_factorial(t) - t * np.log(d) + t * np.log(v) - (c + 1) * l1 + np.log(np.maximum(total, 1e-300)))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's series from 16 on, products below."""
    small = np.cumsum(np.log(np.maximum(1, np.arange(17))))
    z = np.maximum(n, 16.0) + 1
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(n <= 16, small[np.minimum(n, 16).astype(np.int64)], series)


def log_gamma(a: np.ndarray) -> np.ndarray:
    """For a > 0."""
    shift = np.zeros_like(a)
    for _ in range(16):
        shift += np.where(a < 16, np.log(a), 0)
        a = np.where(a < 16, a + 1, a)
    return (a - 0.5) * np.log(a) - a + 0.5 * np.log(2 * np.pi) + 1 / (12 * a) - 1 / (360 * a**3) + 1 / (1260 * a**5) - shift


#: Rows of Stirling numbers that draws of the same dish share, over chains and sweeps; emptied beyond so many.
_ROWS: dict[tuple[float, float, bytes], np.ndarray] = {}
ROWS_HELD = 20_000
common.HELD.append(_ROWS)


def _stirling_rows(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log_stirling_at of each c and its row of numbers of tables. A row is computed once: chains and sweeps ask for most rows again."""
    if len(_ROWS) > ROWS_HELD:
        _ROWS.clear()
    keys = [(d, n, row.tobytes()) for n, row in zip(c.tolist(), t, strict=True)]
    new = list({k: i for i, k in enumerate(keys) if k not in _ROWS}.values())
    if new:
        _ROWS.update(zip([keys[i] for i in new], log_stirling_at(c[new, None], t[new], d), strict=True))
    return np.stack([_ROWS[k] for k in keys])


def _seated_whole(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """The same draw for dishes of many customers. The logarithm of p(t) is concave: points close in on where it is within RANGE of
    its top, and a number of tables is drawn from the lines between the last ones."""
    a = theta / d + others

    def weight(t: np.ndarray) -> np.ndarray:
        return _stirling_rows(c, t, d) + log_gamma(a[:, None] + t) + t * np.log(d * base)[:, None]

    low, high = np.ones(len(c)), c.astype(np.float64)
    share = np.linspace(0, 1, POINTS)
    for k in range(CLOSER):
        spaced = np.exp(np.log(low)[:, None] * (1 - share) + np.log(high)[:, None] * share) if k < 2 else low[:, None] * (1 - share) + high[:, None] * share
        t = np.round(spaced)
        t[:, 0], t[:, -1] = low, high
        p = weight(t)
        near = p >= p.max(axis=1, keepdims=True) - RANGE
        first, last = near.argmax(axis=1), POINTS - 1 - near[:, ::-1].argmax(axis=1)
        rows = np.arange(len(c))
        if k < CLOSER - 1:
            low, high = t[rows, np.maximum(first - 1, 0)], t[rows, np.minimum(last + 1, POINTS - 1)]
    # cell k holds the numbers from t[k] up to t[k + 1], the last one t[-1] alone
    p -= p.max(axis=1, keepdims=True)
    n = np.diff(t, axis=1)
    slope = np.diff(p, axis=1) / np.maximum(n, 1)
    slope = np.where(np.abs(slope) < 1e-9, 1e-9, slope)
    mass = np.exp(p[:, :-1]) * np.expm1(slope * n) / np.expm1(slope)
    cum = np.cumsum(np.concatenate((mass, np.exp(p[:, -1:])), axis=1), axis=1)
    cell = (cum < rng.random(len(c))[:, None] * cum[:, -1:]).sum(axis=1)
    inner = np.minimum(cell, POINTS - 2)
    s, m = slope[rows, inner], n[rows, inner]
    more = np.floor(np.log1p(rng.random(len(c)) * np.expm1(s * m)) / s)
    return (t[rows, cell] + np.where(cell < POINTS - 1, np.clip(more, 0, np.maximum(m - 1, 0)), 0)).astype(np.int64)


def drawn_tables(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """seated() with every dish as one party, however many customers it has."""
    t = np.zeros(len(c), np.int64)
    few = c <= PARTY
    t[few] = seated(c[few], others[few], base[few], d, theta, rng)
    large = np.flatnonzero(~few)
    for k in range(0, len(large), 256):
        at = large[k : k + 256]
        t[at] = _seated_whole(c[at], others[at].astype(np.float64), base[at], d, theta, rng)
    return t


def _bases(table: pa.Table, s: State, facts: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """The parent's probability of each word in each chain, and its training tokens, from the homes' answers."""
    tokens = np.zeros(len(s.words), np.int64)
    g = [np.full(len(s.words), facts["unknown"][k]) for k in CHAINS]
    asked = np.flatnonzero(s.follows)
    where = home(s.words[asked], facts["shards"])
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(facts["shards"] + 1))
    for r in _of_kind(table, TOLD):
        at = asked[order[cuts[r["slice"]] : cuts[r["slice"] + 1]]]
        told = [from_wide(x) for x in r["data"]]
        tokens[at] = told[0]
        for k in CHAINS:
            g[k][at] = (told[1 + k] - facts["d0"] * told[1 + SAMPLES + k] + facts["spare"][k]) / facts["size"][k]
    return g, tokens


def _of_kind(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pc.equal(table.column("kind"), kind)).select(["slice", "data"]).to_pylist()


def _sampler(facts: dict, round_no: int):
    """A shard's state and the parent's probabilities -> the state with new tables."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        found = _of_kind(table, STATE)
        if not found:
            return TYPES.empty_table()
        s = State(found[0]["data"], facts["hot"])
        g, _ = _bases(table, s, facts)
        drawn = []
        shared = s.hot[s.u]
        for k in CHAINS:
            rng = np.random.default_rng([round_no, k, shard])
            t = s.t[k].copy()
            many = np.flatnonzero(s.c > 1)
            for _ in range(SWEEPS):
                total = s.by(s.u, t)[s.u]
                if shared.any():
                    total[shared] = facts["tables"][k][np.searchsorted(facts["hot"], s.words[s.u[shared]])]
                t[many] = drawn_tables(s.c[many], (total - t)[many], g[k][s.w[many]], facts["d"], THETA, rng)
            drawn.append(wide(t))
        return pa.Table.from_pylist([{"shard": shard, "kind": STATE, "data": found[0]["data"][:5] + drawn}], TYPES)

    return run


def _scorer(facts: dict):
    """A shard's state, the parent's probabilities and packages -> parts of the documents' sums by slice."""

    def run(table: pa.Table) -> pa.Table:
        out = [{"slice": r["slice"], "kind": DOCS, "data": r["data"]} for r in _of_kind(table, DOCS)]
        found = _of_kind(table, STATE)
        if found:
            s = State(found[0]["data"], facts["hot"])
            g, tokens = _bases(table, s, facts)
            n, d = np.int64(len(s.words)), facts["d"]
            code, customers = s.u * n + s.w, s.by(s.u, s.c)
            at = np.searchsorted(facts["hot"], s.words[s.hot])
            customers[s.hot] = facts["customers"][at]
            tables = [s.by(s.u, t) for t in s.t]
            for k in CHAINS:
                tables[k][s.hot] = facts["tables"][k][at]
            for r in _of_kind(table, PACK):
                us, u, ws, w = unpacked(r["data"])
                us, ws = np.searchsorted(s.words, us), np.searchsorted(s.words, ws)
                u, w = us[u], ws[w]
                pair = np.searchsorted(code, u * n + w)
                seen = pair < len(code)
                seen[seen] = code[pair[seen]] == (u * n + w)[seen]
                pair = pair[seen]
                p, size = np.zeros(len(u)), customers[u]
                for k in CHAINS:
                    mass = np.where(size > 0, THETA + d * tables[k][u], THETA) * g[k][w]
                    mass[seen] += s.c[pair] - d * s.t[k][pair]
                    p += mass / (THETA + size)
                logs = np.stack((np.log10(p / SAMPLES), np.log10(tokens[w] + 1.0), tokens[w] > 0, np.ones(len(w))))
                entry = np.repeat(np.arange(len(w)), from_planes(r["data"][5]))
                docs, place = np.unique(from_planes(r["data"][6]), return_inverse=True)
                times = from_planes(r["data"][7])
                sums = [np.bincount(place, x[entry] * times, len(docs)) for x in logs]
                out.append({"slice": r["slice"], "kind": PACK, "data": [planes(docs), sums[0].tobytes(), sums[1].tobytes(), planes(sums[2]), planes(sums[3])]})
        return pa.Table.from_pylist(out, pa.schema([TYPES.field("slice"), TYPES.field("kind"), TYPES.field("data")]))

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Parts of a slice -> its documents."""
    ids, valid, held = _of_kind(table, DOCS)[0]["data"]
    ids, valid, held = np.frombuffer(ids, np.int64), np.frombuffer(valid, bool), np.frombuffer(held, bool)
    sums = np.zeros((4, len(ids)))
    for r in _of_kind(table, PACK):
        at = from_planes(r["data"][0])
        for k, x in enumerate(r["data"][1:]):
            sums[k, at] += np.frombuffer(x, np.float64) if k < 2 else from_planes(x)
    cols = [pa.array(ids, mask=~valid), pa.array(held), pa.array(sums[3].astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])]
    return pa.Table.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])


def _discount(ones: int, twos: int) -> float:
    return round(min(0.95, max(0.05, ones / max(1, ones + 2 * twos))), 6) if ones else 0.5


def frequent_contexts(docs: DataFrame, count: int) -> np.ndarray:
    """Hashes of words with at least HOT_SHARE of the tokens in a spread sample of about SAMPLE_DOCS documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in common.text_slices(batch):
                word, n = np.unique(tokens_of(*common.word_hashes(raw, at))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    step = max(1, count // SAMPLE_DOCS)
    words = common.stored(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["word"] for r in words.filter(F.col("n") >= max(1, total * HOT_SHARE)).select("word").collect()], np.int64).view(np.uint64))


def _gather(state: DataFrame, hot: np.ndarray, schema: str) -> dict:
    """Totals of frequent contexts, and the contexts' discount."""
    sums = {r["word"]: r for r in state.mapInArrow(batchwise(_facts(hot)), schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("tokens", *[f"m{k}" for k in CHAINS])]).collect()}
    none = sums.pop(None, None)
    place = {w: i for i, w in enumerate(hot.view(np.int64).tolist())}
    customers, tables = np.zeros(len(hot), np.int64), [np.zeros(len(hot), np.int64) for _ in CHAINS]
    for w, r in sums.items():
        customers[place[w]] = r["tokens"]
        for k in CHAINS:
            tables[k][place[w]] = r[f"m{k}"]
    return {"hot": hot, "customers": customers, "tables": tables, "d": _discount(none["tokens"], none["m0"]) if none else 0.5}


def _parent(state: DataFrame, facts: dict, round_no: int) -> DataFrame:
    """The parent's answers to each shard. Adds the totals to facts."""
    hot, shards = facts["hot"], facts["shards"]
    added = common.stored(state.mapInArrow(batchwise(_asked(hot, shards, True)), ROWS).groupBy("shard").applyInArrow(groupwise(_added), ROWS))
    sums = lambda table: {c: int(x or 0) for c, x in zip(TOTALS, table.mapInArrow(_totals, ", ".join(f"{c} long" for c in TOTALS)).agg(*[F.sum(c) for c in TOTALS]).first(), strict=True)}
    first = sums(added)
    facts |= {"N": first["tokens"], "V": first["words"], "d0": _discount(first["ones"], first["twos"])}
    added = common.stored(added.mapInArrow(batchwise(_root(facts, round_no)), ROWS))
    total = sums(added)
    facts["spare"] = [(THETA + facts["d0"] * total[f"t{k}"]) / (facts["V"] + 1) for k in CHAINS]
    facts["size"] = [THETA + total[f"m{k}"] for k in CHAINS]
    facts["unknown"] = [facts["spare"][k] / facts["size"][k] for k in CHAINS]
    return state.mapInArrow(batchwise(_asked(hot, shards, False)), ROWS).union(added).groupBy("shard").applyInArrow(groupwise(_told), ROWS)


def scored(documents: DataFrame, parts: int = 7, held: int = 2, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held
    docs = docs.withColumn("held", F.coalesce(out, F.lit(False))).withColumn("part", F.spark_partition_id().cast("long"))
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(least_shards, int(size or 0) // SHARD_BYTES)
    hot = frequent_contexts(docs.select("doc_id", "text"), count)
    packages = lambda postings: docs.mapInArrow(batchwise(Packer(shards, hot, postings)), ROWS)
    state = common.stored(packages(False).groupBy("shard").applyInArrow(groupwise(_merged), ROWS))
    sums = "word long, tokens long, " + ", ".join(f"m{k} long" for k in CHAINS)
    facts = _gather(state, hot, sums) | {"shards": shards}
    for round_no in range(ROUNDS):
        before, parent = state, _parent(state, facts, round_no)
        state = common.stored(state.union(parent).groupBy("shard").applyInArrow(groupwise(_sampler(facts, round_no)), ROWS))
        facts = _gather(state, hot, sums) | {"shards": shards}
        common.forget(before)
    parent = _parent(state, facts, ROUNDS)
    found = state.union(parent).union(packages(True)).groupBy("shard").applyInArrow(groupwise(_scorer(facts)), "slice long, kind int, data array<binary>")
    rows = found.groupBy("slice").applyInArrow(_summed, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(facts["N"] + facts["V"] + 1))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["N"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
