"""SentencePiece (merge type) encoding with seeded merge-dropout, and lossless decoding.

A text is cut at its spaces: no piece of a merge-type vocabulary goes on past a space, so each run of spaces with the
word behind it is a segment of its own. A segment's candidate merges wait on an agenda, best piece first, then leftmost.
With dropout, a candidate taken from the agenda is skipped when a hash keyed by (seed, doc_id, number of the segment in its
text, segment, place, piece) falls below the rate. The same key gives the same pieces on every run and machine. At rate 0 the pieces are those of the SentencePiece library.

Characters without a piece become byte tokens. So does the word mark itself where a text contains it, which keeps
decoding lossless (the library would turn it into a space). Defined cases: null and empty texts have no ids;
repeated rows have equal ids; a null doc_id has a key of its own; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, words

MARK = "▁"
MASK = (1 << 64) - 1
SEGMENT = re.compile(r" *[^ ]+| +\Z")


#: Segments of more characters are merged one by one, the others many at a time.
LONG = 48
#: Bytes of text that a task encodes at once; arrays of a slice take about a hundred times as much.
SLICE_BYTES = 1 << 20
NONE = np.iinfo(np.int64).max


class Codec:
    """table: by id (piece, score, kind) with kind 0 a piece, 1 a byte token, 2 a control token. A symbol is a piece's id, or
    -1 - code point for a character without a piece."""

    def __init__(self, table: list[tuple[str, float, int]], rate: float, seed: int) -> None:
        ids = {p: i for i, (p, _, kind) in enumerate(table) if kind == 0}
        self.limit, self.seed = np.uint64(int(rate * ((1 << 64) - 1))), seed
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1 and p != MARK:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = ids.get(MARK, self.symbol[ord(" ")])
        pairs = {(ids[p[:k]] << 32) | ids[p[k:]]: (-table[i][1], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, NONE], np.int64)
        self.pair_rank = np.array([int(pairs[k][0]) for k in keys] + [NONE], np.int64)
        self.pair_id = np.array([pairs[k][1] for k in keys] + [-1], np.int64)
        bits = max(4, len(keys).bit_length() + 3)
        self.shift, self.slot = np.uint64(64 - bits), np.full(1 << bits, len(keys), np.int64)
        for n, h in enumerate((np.array(keys, np.uint64) * common.M >> self.shift).tolist()):
            while self.slot[h] != len(keys):
                h = (h + 1) % len(self.slot)
            self.slot[h] = n
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(table):
            if kind == 1:
                self.byte_id[int(p[3:5], 16)] = i
        data = [p.replace(MARK, " ").encode() if kind == 0 else bytes([int(p[3:5], 16)]) if kind == 1 else b"" for p, _, kind in table]
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.piece_at = np.concatenate(([0], np.cumsum([len(x) for x in data])))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in the pair table; the last number stands for no pair."""
        none = len(self.pair_keys) - 1
        keys = (left << 32) | right
        at = (keys.view(np.uint64) * common.M >> self.shift).astype(np.int64)
        out = self.slot[at]
        out[(left < 0) | (right < 0)] = none
        open_ = np.flatnonzero((out != none) & (self.pair_keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slot)
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] != none) & (self.pair_keys[out[open_]] != keys[open_])]
        return out

    def skipped(self, mark: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether the candidate at a place of the segment with this mark is skipped."""
        return common.mix(mark + place.astype(np.uint64) * common.M2 + rank.astype(np.uint64) * common.M) < self.limit

    def marks(self, points: np.ndarray, at: np.ndarray, variant: int | np.ndarray) -> np.ndarray:
        """variant: one key for all segments, or a key each."""
        return self.keyed(self.hashes(points, at), variant)

    def keyed(self, hashes: np.ndarray, variant: int | np.ndarray) -> np.ndarray:
        seed = common.mix1((self.seed << 20) + variant + 1) if isinstance(variant, int) else common.mix1(self.seed << 20) + variant
        return common.mix(hashes + seed)

    def hashes(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        up, down = common.powers(len(points))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
        return (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]

    def segments(self, texts: list[str], variant: int | np.ndarray) -> list[bytes]:
        """Ids (int32 as bytes) of segments, each a run of spaces with the word behind it."""
        out = [b""] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        for a in range(0, len(short), 20_000):
            some = short[a : a + 20_000]
            for i, ids in zip(some, self._many([texts[i] for i in some], _of(variant, some)), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > LONG:
                out[i] = self._one(t, _of(variant, [i]))
        return out

    def plain(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of segments at rate 0, and the candidates taken for them (rank, then place). A long segment has neither if there
        is a rate: no occurrence of it shares its pieces."""
        out = [(b"", b"")] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        for a in range(0, len(short), 20_000):
            some = short[a : a + 20_000]
            steps: list[tuple[np.ndarray, np.ndarray]] = []
            ids = self._many([texts[i] for i in some], 0, steps)
            of, took = (np.concatenate([x[k] for x in steps] or [np.zeros(0, np.int64)]) for k in (0, 1))
            took, ends = took[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(some))).tolist()
            for i, x, first, last in zip(some, ids, [0, *ends], ends, strict=False):
                out[i] = x, took[first:last].tobytes()
        if not self.limit:
            for i, t in enumerate(texts):
                if len(t) > LONG:
                    out[i] = self._one(t, 0), b""
        return out

    def _points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        return points, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def _many(self, texts: list[str], variant: int | np.ndarray, steps: list | None = None) -> list[bytes]:
        """With steps nothing is skipped, and they get the candidates taken: segment, and rank with place."""
        points, at = self._points(texts)
        n = len(points)
        sym, mark = self.symbol[points], self.marks(points, at, variant)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[at[1:] - 1] = n  # segments have at least the space in front
        left[at[:-1]] = n
        sym = np.append(sym, np.int64(-1))  # a stop behind the last segment
        live, none = np.ones(n + 1, bool), len(self.pair_keys) - 1
        pair = self.pairs(sym[:n], sym[right])
        offset = np.arange(n) - np.repeat(at[:-1], np.diff(at))
        key = np.append(self._keys(pair, offset), NONE)
        pair, offset = np.append(pair, none), np.append(offset, 0)
        # the agenda of all open segments: cells holds their places, row by row, starts where each row begins
        cells, starts, open_ = np.arange(n), at[:-1], np.arange(len(texts))
        while len(open_):
            best = np.minimum.reduceat(key[cells], starts)
            go = best != NONE
            if not go.all():
                sizes = np.diff(np.append(starts, len(cells)))
                cells, open_, best = cells[np.repeat(go, sizes)], open_[go], best[go]
                starts = np.concatenate(([0], np.cumsum(sizes[go])))[:-1].astype(np.int64)
                if not len(open_):
                    break
            i = at[open_] + (best & 0xFFFFF)
            if steps is None:
                skip = self.skipped(mark[open_], offset[i], best >> 20)
            else:
                skip = np.zeros(len(i), bool)
                steps.append((open_, best))
            key[i[skip]] = NONE
            i = i[~skip]
            j = right[i]
            sym[i] = self.pair_id[pair[i]]
            live[j], key[j] = False, NONE
            after, before = right[j], left[i]
            right[i] = after
            left[after[after < n]] = i[after < n]
            for p in (i, before[before < n]):
                pair[p] = self.pairs(sym[p], sym[right[p]])
                key[p] = self._keys(pair[p], offset[p])
        return self._spell(sym[:n][live[:n]], np.concatenate(([0], np.cumsum(live[:n])))[at])

    def _keys(self, pair: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Order on the agenda: rank, then place."""
        return np.where(pair < len(self.pair_keys) - 1, (self.pair_rank[pair] << 20) | offset, NONE)

    def _spell(self, sym: np.ndarray, at: np.ndarray) -> list[bytes]:
        known = sym >= 0
        ids = sym.astype(np.int32)
        if not known.all():
            size = np.ones(len(sym), np.int64)
            odd = np.flatnonzero(~known)
            data = [chr(-1 - s).encode() for s in sym[odd].tolist()]
            size[odd] = [len(x) for x in data]
            wide = np.repeat(ids, size)
            wide[np.repeat(~known, size)] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
            ids, at = wide, np.concatenate(([0], np.cumsum(size)))[at]
        whole = ids.tobytes()
        at = (at * 4).tolist()
        return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _one(self, text: str, variant: int | np.ndarray) -> bytes:
        """The same with a heap, for a long segment."""
        points, at = self._points([text])
        mark, none = self.marks(points, at, variant), len(self.pair_keys) - 1
        parts = self.symbol[points].tolist()
        right, left = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        first = self.pairs(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
        rank, made = self.pair_rank, self.pair_id
        agenda = [(int(rank[p]), i, i + 1, int(made[p])) for i, p in enumerate(first.tolist()) if p != none]
        heapq.heapify(agenda)
        born = {(i, j): (r, m) for r, i, j, m in agenda}
        while agenda:
            r, i, j, m = heapq.heappop(agenda)
            if right[i] != j or born.get((i, j)) != (r, m):
                continue  # one of the two was merged meanwhile
            if self.limit and self.skipped(mark, np.array([i]), np.array([r]))[0]:
                del born[i, j]
                continue
            parts[i], right[i] = m, right[j]
            right[j] = -2
            if right[i] >= 0:
                left[right[i]] = i
            for a in (i, left[i]):
                if a >= 0 and (b := right[a]) >= 0:
                    p = int(self.pairs(np.array([parts[a]]), np.array([parts[b]]))[0])
                    born.pop((a, b), None)
                    if p != none:
                        born[a, b] = int(rank[p]), int(made[p])
                        heapq.heappush(agenda, (int(rank[p]), a, b, int(made[p])))
        out, i = [], 0
        while i >= 0:
            out.append(parts[i])
            i = right[i]
        return self._spell(np.array(out, np.int64), np.array([0, len(out)]))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of ids as encode gives them, without the space put in front."""
        return bytes(self.spelled(ids)[1:])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.piece_bytes[ragged(self.piece_at, ids)]


def _of(variant: int | np.ndarray, some: list[int]) -> int | np.ndarray:
    return variant if isinstance(variant, int) else variant[some]


def ragged(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places at[c] .. at[c + 1] of each code c in turn."""
    size = (at[1:] - at[:-1])[codes]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[:-1][codes] - (ends - size), size)


def model_table(model_file: str) -> list[tuple[str, float, int]]:
    """Read by the driver and broadcast; its size is the vocabulary's."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


def _segments(texts: pa.Array) -> pa.Array:
    """Lists of segments. Most texts have single spaces only and are split at them; others by a pattern."""
    plain = pc.and_(pc.invert(pc.match_substring_regex(texts, "  |^ | $")), pc.greater(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
    if plain.all():
        return pc.split_pattern(texts, " ")
    parts = pc.split_pattern(pc.if_else(pa.array(plain), texts, ""), " ").to_pylist()
    odd = np.flatnonzero(~plain)
    for i, text in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True):
        # the space in front of a segment is implied, as it is for the plain texts
        parts[i] = [s.removeprefix(" ") for s in SEGMENT.findall(" " + text)] if text else []
    return pa.array(parts, pa.large_list(pa.large_string()))


def segment_cache(codec: Codec) -> words.Cache:
    """By segment without its first space: ids and candidate merges at rate 0, which hold for every occurrence."""
    return words.Cache(lambda new: codec.plain([" " + s for s in new]) if new else [])


def encode_part(codec: Codec, cache: words.Cache, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids begin. keys: one a text; an occurrence's key is made of it and of
    the segment's number in the text. Where no candidate of the pieces at rate 0 is skipped they stay, else the occurrence is
    merged on its own."""
    distinct, codes, begins = words.coded(_segments(texts))
    found = cache(distinct)
    plain = [x[0] for x in found]
    if codec.limit and len(codes):
        number = np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins))
        own = common.mix(np.repeat(keys.view(np.uint64), np.diff(begins)) + number.astype(np.uint64) * common.M2)
        flat, at = codec._points([" " + s for s in distinct])
        hashes = codec.hashes(flat, at)
        steps = [x[1] for x in found]
        step_at = np.concatenate(([0], np.cumsum([len(x) // 8 for x in steps]))).astype(np.int64)
        step = np.frombuffer(b"".join(steps), np.int64)
        changed = np.array([len(s) + 1 > LONG for s in distinct])[codes]
        for a in range(0, len(codes), 100_000):
            some = codes[a : a + 100_000]
            size = np.diff(step_at)[some]
            took = step[ragged(step_at, some)]
            marks = np.repeat(codec.keyed(hashes[some], own[a : a + 100_000]), size)
            skip = codec.skipped(marks, took & 0xFFFFF, took >> 20)
            changed[a + np.repeat(np.arange(len(some)), size)[skip]] = True
        new = np.flatnonzero(changed)
        plain += codec.segments([" " + distinct[c] for c in codes[new].tolist()], own[new])
        codes = codes.astype(np.int64)
        codes[new] = len(distinct) + np.arange(len(new))
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in plain]))).astype(np.int64)
    flat = np.frombuffer(b"".join(plain), np.int32)
    ids = flat[ragged(at, codes)] if len(codes) else flat[:0]
    sizes = words.sums(np.diff(at)[codes], begins) if len(codes) else np.zeros(len(texts), np.int64)
    return ids, np.concatenate(([0], np.cumsum(sizes)))


_CODECS: dict[tuple, tuple[Codec, words.Cache]] = {}
common.HELD.append(_CODECS)


def _encoder(table: Broadcast, model_file: str, rate: float, seed: int, carried: Sequence[str]) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back(_CODECS)
        key = (model_file, rate, seed)
        if key not in _CODECS:
            codec = Codec(table.value, rate, seed)
            _CODECS[key] = codec, segment_cache(codec)
        codec, cache = _CODECS[key]
        for batch in batches:
            for first, last, texts in words.row_slices(batch, most_bytes=SLICE_BYTES):
                ids, begins = encode_part(codec, cache, texts, batch.column(2).slice(first, last - first).to_numpy())
                same = _lossless(codec, ids, begins, texts)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids, pa.int32()))
                own = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(np.diff(begins)), lists, pa.array(same), *own[3:]], names=["doc_id", "n_tokens", "ids", "lossless", *carried])
                common.trim()
        cache.clear()
        common.trim()

    return encode


def encoded(docs: DataFrame, model_file: str, rate: float = 0.1, seed: int = 1, carried: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids, lossless (decoding the ids gives the text back) and the carried columns, one
    row a row."""
    table = docs.sparkSession.sparkContext.broadcast(model_table(model_file))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.lit(seed), "doc_id").alias("key")
    schema = ", ".join([f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried]])
    return docs.select("doc_id", "text", key, *carried).mapInArrow(_encoder(table, model_file, rate, seed, tuple(carried)), schema)


def _lossless(codec: Codec, ids: np.ndarray, begins: np.ndarray, texts: pa.Array) -> np.ndarray:
    spelled = codec.spelled(ids)
    ends = np.concatenate(([0], np.cumsum((codec.piece_at[1:] - codec.piece_at[:-1])[ids])))[begins]
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    want = [t.encode() for t in texts.to_pylist()]
    return np.array([b - a == (n and n + 1) and bytes(spelled[a + 1 : b]) == w for a, b, n, w in zip(ends[:-1], ends[1:], sizes, want, strict=True)], bool)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """rows (doc_id, ids, ...) -> doc_id, text."""
    table = rows.sparkSession.sparkContext.broadcast(model_table(model_file))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(table.value, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")
