"""Language identification by cross-parsing.

For each language a bounded sample of labelled text (SAMPLE_DOCS documents of at most SAMPLE_CHARS / 8 characters,
SAMPLE_CHARS characters in all) is turned into a suffix automaton. A text's words are parsed greedily into phrases, each
the longest match in the sample; phrases times log2 of the sample's length estimate the cross entropy, and the language
that needs fewest wins. Phrases end at word ends, so a word is parsed once however often it occurs, and whole texts are
counted.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text every text is
`und`; ties go to the first language by name; rows are predicted one by one, so repeated rows agree. Rows with a null
lang, text or doc_id are not learned from. Extra columns are ignored. score is 1 - best / second best entropy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common, words

SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
#: Bytes of text that a task of the pipeline's stage judges at once.
KEPT_BYTES = 1 << 20


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    low = text.lower()
    return [low] if low.isalpha() else "".join(c if c.isalpha() else " " for c in low).split()


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    steps: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return steps


def phrases(steps: list[dict[str, int]], text: str) -> int:
    """Longest matches that text falls into; a character that the sample lacks is a phrase."""
    count, state, start = 0, steps[0], steps[0]
    for c in text:
        to = state.get(c)
        if to is None:
            if state is not start:
                count += 1
                to = start.get(c)
            if to is None:
                count += 1
                state = start
                continue
        state = steps[to]
    return count + (state is not start)


def learning_rows(docs: DataFrame) -> F.Column:
    """Rows that may be learned from: crc32 of the doc_id as text modulo 4 is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def samples(docs: DataFrame, docs_a_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Normalised sample text by language. Documents are chosen by a hash of doc_id."""
    rows = docs.filter(learning_rows(docs)).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_a_language)
    ids = [r.doc_id for r in chosen.select("doc_id").distinct().collect()]
    part = rows.filter(F.col("doc_id").isin(ids)).select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.substring("text", 1, chars // 8).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(part.collect(), key=lambda r: (r.lang, r.h, r.doc_id, r.text)):
        out.setdefault(r.lang, []).extend(letters(r.text))
    return {lang: " ".join(found)[:chars] + " " for lang, found in sorted(out.items()) if found}


_PARSERS: dict[int, words.Cache] = {}
common.HELD.append(_PARSERS)


def _parser(texts: dict[str, str]) -> words.Cache:
    """Entropy of a word by language, and whether it has a letter; built once a worker."""
    key = hash(tuple(texts.items()))
    if key not in _PARSERS:
        built = [(automaton(t), math.log2(len(t) + 1)) for t in texts.values()]

        def parse(word: str) -> tuple[float, ...]:
            parts = letters(word)
            return (*[sum(phrases(a, p + " ") for p in parts) * w for a, w in built], float(bool(parts)))

        _PARSERS.clear()
        _PARSERS[key] = words.Cache(lambda new: [parse(w) for w in new])
    return _PARSERS[key]


def predicted(texts: pa.Array, parse: words.Cache, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    distinct, codes, begins = words.coded(pc.ascii_split_whitespace(texts))
    if not len(distinct) or not len(langs):
        return np.full(len(texts), "und", object), np.zeros(len(texts))
    cost = words.sums(np.array(parse(distinct), np.float64)[codes], begins)
    known, ranked = cost[:, -1] > 0, np.sort(cost[:, :-1], axis=1)
    second = ranked[:, 1] if len(langs) > 1 else np.full(len(texts), np.inf)
    return np.where(known, langs[cost[:, :-1].argmin(axis=1)], "und"), np.where(known, 1 - ranked[:, 0] / np.where(known, second, 1), 0.0)


def _lettered(texts: pa.Array, parse: words.Cache) -> np.ndarray:
    """Whether each text has a letter."""
    distinct, codes, begins = words.coded(pc.ascii_split_whitespace(texts))
    return words.sums(np.array([x[-1] for x in parse(distinct)])[codes], begins) > 0 if distinct else np.zeros(len(texts), bool)


def _predictor(texts: dict[str, str]) -> Callable:
    langs = np.array([*texts], object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back(_PARSERS)
        parse = _parser(texts)
        for batch in batches:
            for first, last, part in words.row_slices(batch):
                best, score = predicted(part, parse, langs)
                row = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
        parse.clear()
        common.trim()

    return predict


def languages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, one row a row of docs."""
    texts = samples(docs)
    rows = docs.select("doc_id", "text", F.coalesce(~learning_rows(docs), F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(texts), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told (`und`); all columns stay as they are. Where no language was learned,
    only documents without a letter go."""
    texts = samples(docs)
    langs, names = np.array([*texts], object), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back(_PARSERS)
        parse = _parser(texts)
        for batch in batches:
            flags = [predicted(part, parse, langs)[0] != "und" if len(langs) else _lettered(part, parse) for _, _, part in words.row_slices(batch, most_bytes=KEPT_BYTES)]
            yield batch.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))
        parse.clear()
        common.trim()

    return docs.mapInArrow(keep, docs.schema).select(*names)
