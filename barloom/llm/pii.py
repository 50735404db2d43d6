"""Personal data by information-theoretic sanitisation (Sanchez, Batet and Viejo), in DataFrame functions only.

Base patterns find protected entities: email, ip, card (14 to 19 digits, Luhn) and phone. What the corpus says about
them is then measured: for an entity e and a term t (a word of three letters or more) in the same text, over documents,

    PMI(e; t) = ln(N * df(e, t) / (df(e) * df(t)))        IC(e) = ln(N / df(e))

A term that occurs with e in at least MIN_SUPPORT documents and reveals PMI >= DISCLOSURE * IC(e) is a span of kind
`term` wherever it stands in a text with e. `sanitised` generalises base spans to their kind and removes terms' spelling.

Patterns are written so that no text makes them backtrack or recurse: the base patterns' repeats are unambiguous, so
possessive ones match the same. Matches come from regexp_extract_all and split, places from sums of their lengths in
code points. Term counts cover all documents; terms that occur with no entity twice are not counted.

Defined cases: a null text is empty; no span gives counts 0, spans '' and the hash of ''; spans of several kinds may
overlap, terms inside base spans are not added; repeated rows count once in the statistics and each keep their row;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
MIN_SUPPORT = 2
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
STRETCH = 256
SPAN = "array<struct<start:int,kind_no:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements, by stretches, so that long arrays stay cheap."""
    n = F.size(lengths)
    whole = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int")), lambda s: _total(F.slice(lengths, s * STRETCH + 1, F.lit(STRETCH))))
    starts = _let(whole, lambda w: F.transform(w, lambda _, s: _total(F.slice(w, F.lit(1), s))))
    return _let(starts, lambda at: F.transform(lengths, lambda _, i: F.element_at(at, F.floor(i / STRETCH).cast("int") + 1) + _total(
        F.slice(lengths, F.floor(i / STRETCH).cast("int") * STRETCH + 1, i % STRETCH))))


def found(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), leftmost and not overlapping, places in code points."""

    def placed(matches: Column, gaps: Column) -> Column:
        gap_sizes = F.transform(F.slice(gaps, F.lit(1), F.size(matches)), F.length)
        return _let(gap_sizes, lambda g: _let(
            F.zip_with(g, matches, lambda a, m: a + F.length(m)),
            lambda both: _let(_before(both), lambda at: F.transform(matches, lambda m, i: F.struct(
                (F.get(at, i) + F.get(g, i)).alias("start"), (F.get(at, i) + F.get(both, i)).alias("end"), m.alias("value"))))))

    none = F.lit(None).cast("array<struct<start:int,end:int,value:string>>")
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(_let(all_, lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda g: placed(m, g))).otherwise(none)), F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    if kind == "ip":
        return value.rlike(rf"\A{part}(\.{part}){{3}}\z")
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(value)).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind_no, end, value), value in a normal form."""
    marks = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

    def of(no: int, kind: str) -> Column:
        hits = F.filter(found(text, patterns[kind]), lambda s: _holds(kind, s["value"]))
        normal = (lambda v: F.lower(v)) if kind in ("email", "ip") else _digits
        rows = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.concat(F.lit(kind + ":"), normal(s["value"])).alias("value")))
        return F.when(marks[kind], rows.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(no, kind) for no, kind in enumerate(KINDS[:4])]))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _contexts(rows: DataFrame) -> DataFrame:
    """(key, text, base) of texts with entities -> key, text, entities and terms (distinct, in lower case) of the whole text, one row a key."""
    words = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower)
    rows = rows.select("key", "text", F.array_distinct(F.transform("base", lambda s: s["value"])).alias("entities"))
    return rows.dropDuplicates(["key"]).withColumn("terms", F.array_distinct(words))


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) of wanted terms over all documents."""
    terms = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    if wanted.count() <= common.BROADCAST_ROWS:
        return terms.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")


def _together(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, entity, term) of every given entity and every term of a text."""
    own = common.fetch(texts.select("key", F.explode("entities").alias("entity")), "entity", entities.select("entity"), ["key"])
    return own.join(texts.select("key", "terms"), "key").select("key", "entity", F.explode("terms").alias("term"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(entity, term) pairs whose disclosure reaches the threshold."""
    entities = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    entities = common.stored(entities.filter(F.col("df_entity") >= MIN_SUPPORT))
    both = common.stored(_together(texts, entities).groupBy("entity", "term").agg(F.count("*").alias("df_both")).filter(F.col("df_both") >= MIN_SUPPORT))
    wanted = common.stored(both.select("term").distinct())
    terms = common.stored(_counted(docs, wanted))
    rows = common.fetch(both, "term", terms, ["entity"])
    rows = common.fetch(rows, "entity", entities, ["term"])
    pmi = F.log(F.lit(float(n)) * F.col("df_both") / (F.col("df_entity") * F.col("df")))
    return rows.filter(pmi >= DISCLOSURE * F.log(F.lit(float(n)) / F.col("df_entity"))).select("entity", "term")


def _term_spans(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, terms): all places of disclosing terms in texts with their entity."""
    pairs = common.stored(pairs)
    rows = _together(texts, pairs.select("entity").distinct())
    if pairs.count() <= common.BROADCAST_ROWS:
        hit = rows.join(F.broadcast(pairs), ["entity", "term"])
    else:
        pair = F.struct("entity", "term").alias("pair")
        hit = common.fetch(rows.select("key", "term", pair), "pair", pairs.select(pair), ["key"])
    hit = common.stored(hit.select("key", "term").distinct())
    places = texts.join(hit.select("key").distinct(), "key", "left_semi").select("key", F.explode(found(F.col("text"), TERM)).alias("s"))
    places = places.select("key", F.lower("s.value").alias("term"), "s.start", "s.end").join(hit, ["key", "term"])
    span = F.struct("start", F.lit(4).alias("kind_no"), "end", F.concat(F.lit("term:"), "term").alias("value"))
    return places.groupBy("key").agg(F.collect_list(span).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, base and terms (arrays of start, kind_no, end, value), one row a row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash")).alias("key")
    rows = docs.select("doc_id", "text", key, base_spans(F.col("text")).alias("base"))
    texts = common.stored(_contexts(rows.filter(F.size("base") > 0)))
    pairs = disclosing_terms(docs, texts, docs.count())
    terms = common.stored(_term_spans(texts, pairs))
    rows = rows.join(F.broadcast(terms) if (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) <= common.BROADCAST_ROWS else terms, "key", "left")
    outside = F.filter(F.coalesce("terms", F.array().cast(SPAN)).cast(SPAN), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return rows.select("doc_id", "text", "base", F.array_sort(outside).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text with base spans generalised to [KIND] and disclosing terms removed to [TERM]. Of overlapping spans the first in order is replaced."""
    all_ = F.array_sort(F.concat("base", "terms"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.element_at(names, s["kind_no"] + 1)).alias("out")))

    return spans(docs).select("doc_id", F.aggregate(all_, start, put, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long").alias(f"n_{KINDS[no]}")

    counts = [count(no) for no in range(4)]
    return spans(docs).select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "terms"))).alias("spans"))
