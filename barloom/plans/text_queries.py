"""Queries on landed text: CSV lines, payloads, feeds, pages, headlines, symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import symbols as sy
from barloom.operators import conditions as cond
from barloom.operators import text as tx
from barloom.operators.bars import first_source_with_rows
from barloom.plans.inputs import SQL_EVENT_BARS, SQL_ORDER_MACRO, SQL_SHIP_BARS, event_bars, order_macro, rounded, ship_bars, spread, sql_select, table
from barloom.session import durable
from barloom.sources import feeds, landed

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


# ---- landed series ---------------------------------------------------------------------------


def csv_lines(s, d):
    """The daily bars as CSV lines of one file per symbol, two header layouts, some bad dates."""
    b = durable(ship_bars(s, d, numbered=False))
    path = F.concat(F.lit("/hub/assets/"), F.col("symbol"), F.lit("_5y_1d.csv"))
    swapped = F.col("symbol").startswith("A")
    day = F.when(F.dayofmonth("ts") == 31, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    straight = F.concat_ws(",", day, *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    turned = F.concat_ws(",", day, *[F.col(c).cast("string") for c in ("close", "open", "volume", "low", "high")])
    body = b.select(path.alias("path"), F.when(swapped, turned).otherwise(straight).alias("value"))
    head = F.when(swapped, "Datetime,Close,Open,Volume,Low,High").otherwise("Date,Open,High,Low,Close,Volume")
    heads = b.select("symbol").distinct().select(path.alias("path"), head.alias("value"))
    extra = heads.select(F.lit("/hub/assets/macro_features.csv").alias("path"), F.lit("2001-01-01,1").alias("value"))
    return heads.unionByName(body).unionByName(extra)


add("csv_scan", lambda s, d: rounded(landed.parse_ohlcv_lines(landed.dataset_files(csv_lines(s, d)))),
    f"WITH {SQL_SHIP_BARS} SELECT {sql_select('open high low close volume')} FROM bars WHERE day(ts) <> 31")


def candle_payloads(s, d, layout):
    b = event_bars(s, d, numbered=False)
    parts = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"}
    at = landed.CANDLE_LAYOUTS[layout]
    width = max(at.values()) + (2 if "count" in layout else 1)
    cells = [F.lit("0")] * width
    cells[0] = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    for n, i in at.items():
        cells[i] = F.col(parts[n]).cast("string")
    day = b.withColumn("_day", F.to_date("ts"))
    return day.groupBy("symbol", "_day").agg(F.to_json(F.collect_list(F.array(*cells))).alias("value"))


for i, layout in enumerate(landed.CANDLE_LAYOUTS):
    add(f"candle_payload_{i + 1}", lambda s, d, l=layout: rounded(landed.parse_candles(candle_payloads(s, d, l), l)),
        f"WITH {SQL_EVENT_BARS} SELECT {sql_select('open high low close volume')} FROM bars")


def macro_payloads(s, d):
    m = order_macro(s, d)
    value = F.when(F.month("date") == 6, ".").otherwise(F.col("value").cast("string"))
    o = F.struct(F.col("date").cast("string").alias("date"), value.alias("value"))
    return m.groupBy("series_id").agg(F.to_json(F.struct(F.collect_list(o).alias("observations"))).alias("value"))


def stamped(df):
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


add("macro_payload", lambda s, d: stamped(rounded(landed.between_dates(landed.parse_macro(macro_payloads(s, d)), "1996-01-01", "2000-12-31"), 4)),
    f"WITH {SQL_ORDER_MACRO} SELECT series_id, date::TIMESTAMP AS date, round(CASE WHEN month(date) <> 6 THEN value END, 4) AS value FROM macro "
    "WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")


def annual_payloads(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("country"), F.year("o_orderdate").cast("string").alias("y")).agg(
        F.max("o_totalprice").alias("v")
    )
    row = F.struct(F.col("y").alias("date"), F.col("v").cast("string").alias("value"))
    body = F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(row)), F.lit("]"))
    return o.groupBy("country").agg(body.alias("value")).withColumn("indicator", F.lit("MAX.ORDER"))


add("annual_payload", lambda s, d: stamped(rounded(landed.parse_annual(annual_payloads(s, d)))),
    "SELECT 'wb_' || o_orderstatus || '_MAX.ORDER' AS series_id, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS date, round(max(o_totalprice), 6) AS value FROM orders GROUP BY 1, 2")


def symbol_lines(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    text = F.when(F.col("id") % 5 == 0, F.lit("  ")).when(F.col("id") % 7 == 0, "# note").otherwise(F.concat(F.lit(" brk."), F.col("id").cast("string"), F.lit(" ")))
    return c.select("id", text.alias("value"))


add("symbol_list", lambda s, d: landed.parse_symbol_lines(symbol_lines(s, d)),
    "SELECT c_custkey AS id, 'BRK.' || c_custkey AS symbol FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
add("universe_names", lambda s, d: landed.parse_symbol_lines(symbol_lines(s, d)).select("id", sy.dashed("symbol").alias("symbol")),
    "SELECT c_custkey AS id, 'BRK-' || c_custkey AS symbol FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")


def made_symbols(s, d):
    o = table(s, d, "orders")
    bases = F.array(*[F.lit(x) for x in ("btc", "ETH", "ZZZ", "msft", "eurusd", "BRK.B")])
    base = F.get(bases, (F.col("o_custkey") % 6).cast("int"))
    tail = F.when(F.col("o_orderkey") % 3 == 0, "-USD").when(F.col("o_orderkey") % 3 == 1, "=X").otherwise("")
    return o.select("o_orderkey", F.concat(base, tail).alias("symbol"))


SQL_SYM = ("WITH q AS (SELECT o_orderkey, ['btc','ETH','ZZZ','msft','eurusd','BRK.B'][o_custkey % 6 + 1] || "
           "CASE o_orderkey % 3 WHEN 0 THEN '-USD' WHEN 1 THEN '=X' ELSE '' END AS symbol FROM orders)")
add("symbol_kinds", lambda s, d: made_symbols(s, d).select("o_orderkey", "symbol", sy.is_crypto("symbol").alias("crypto"), sy.is_equity("symbol").alias("equity")),
    SQL_SYM + " SELECT o_orderkey, symbol, upper(symbol) IN ('BTC-USD','ETH-USD','BTC','ETH') AS crypto, symbol NOT LIKE '%-%' AND symbol NOT LIKE '%=%' AS equity FROM q")
add("symbol_names", lambda s, d: made_symbols(s, d).select("o_orderkey", sy.stooq_name("symbol").alias("stooq"), sy.kraken_pair("symbol").alias("kraken")),
    SQL_SYM + r""" SELECT o_orderkey, CASE WHEN lower(symbol) LIKE '%=x' THEN replace(lower(symbol), '=x', '') WHEN regexp_matches(lower(symbol), '^[a-z]+-[a-z]+$') THEN replace(lower(symbol), '-', '')
    WHEN regexp_matches(lower(symbol), '^[a-z]{6}$') THEN lower(symbol) WHEN regexp_matches(lower(symbol), '^[a-z]+$') THEN lower(symbol) || '.us' END AS stooq,
    CASE WHEN regexp_matches(upper(symbol), '^[A-Z]+-[A-Z]+$') THEN replace(regexp_replace(upper(symbol), '^BTC-', 'XBT-'), '-', '') END AS kraken FROM q""")

# ---- feeds and pages -------------------------------------------------------------------------


def rss(s, d):
    """One feed per document; every line is an item, dated by document and line."""
    doc = spread(table(s, d, "documents"), "doc_id").select("doc_id", F.col("source").alias("ticker"), F.split("text", "\n").alias("_l"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    when = lambda i: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60 + i), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.transform("_l", lambda t, i: F.concat(
        F.lit("<item><title>"), safe(t), F.lit("</title><pubDate>"), when(i), F.lit(" GMT</pubDate></item>")))
    return doc.select("doc_id", "ticker", F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(item, ""), F.lit("</channel></rss>")).alias("xml"))


add("feed_items", lambda s, d: feeds.feed_items(rss(s, d)).select("doc_id", "pos", "ts", F.length("title").alias("n_chars"), F.md5("title").alias("title_md5")),
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) "
    "SELECT doc_id, pos, make_timestamp((1700000000 + doc_id * 60 + pos) * 1000000) AS ts, length(trim(t)) AS n_chars, md5(trim(t)) AS title_md5 FROM l")
add("feed_item_counts", lambda s, d: feeds.item_counts(rss(s, d), "ticker"),
    "SELECT source AS ticker, sum(len(string_split(text, chr(10))))::BIGINT AS n_items FROM documents GROUP BY 1")
SQL_PLAIN = ("trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
             "'&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'))")
add("page_headings", lambda s, d: feeds.headings(table(s, d, "pages").select("page_id", "html"), tag="h1"),
    "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)) AS x, "
    "generate_subscripts(regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), 1) - 1 AS pos FROM pages) "
    f"SELECT page_id, pos, {SQL_PLAIN.format(x='x')} AS heading FROM h WHERE {SQL_PLAIN.format(x='x')} <> ''")
add("recent_news", lambda s, d: cond.recent_news(
    table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), days=7, min_items=450),
    "SELECT event_type AS symbol, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS news_items, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') >= 450 AS news_ok FROM events GROUP BY 1")

# ---- headlines -------------------------------------------------------------------------------


def headline_rows(s, d):
    """Every line of every document is a headline of its source."""
    x = spread(table(s, d, "documents"), "doc_id").select(F.col("source").alias("ticker"), "doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "headline"))
    return x.select("ticker", "headline", (F.col("doc_id") * 1_000_000 + F.col("_i")).alias("pos"))


def cleaned(s, d):
    return tx.clean_headlines(headline_rows(s, d))


SQL_HEAD = r"""hl0 AS (SELECT source AS ticker, doc_id, unnest(string_split(text, chr(10))) AS h, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 hl1 AS (SELECT ticker, doc_id * 1000000 + i AS pos, trim(regexp_replace(h, '[\s\p{Z}]+', ' ', 'g')) AS headline FROM hl0),
 hl AS (SELECT * FROM hl1 WHERE headline <> '' QUALIFY row_number() OVER (PARTITION BY ticker, lower(headline) ORDER BY pos) = 1)"""
add("headline_dedupe", cleaned, f"WITH {SQL_HEAD} SELECT ticker, headline, pos FROM hl")
add("first_headlines", lambda s, d: tx.first_headlines(cleaned(s, d)),
    f"WITH {SQL_HEAD} SELECT ticker, headline, pos FROM hl QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos) <= 10")
LEXICON = {"the": 0.4, "and": 0.3, "on": -0.5, "is": 1.1, "le": 0.7, "la": -0.6, "und": 0.9, "der": -1.2, "el": 0.8, "de": -0.2, "not": -1.9, "good": 1.9, "error": -1.7}


def lexicon(s):
    return s.createDataFrame(list(LEXICON.items()), "token string, valence double")


def scored(s, d):
    return tx.score_headlines(durable(cleaned(s, d)), lexicon(s))


SQL_SCORE = SQL_HEAD + ", lex(token, valence) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LEXICON.items()) + r"""),
 tk AS (SELECT ticker, pos, unnest(regexp_split_to_array(lower(headline), '[^\p{L}\p{N}'']+')) AS token FROM hl),
 sv AS (SELECT ticker, pos, sum(valence) AS v FROM tk JOIN lex USING (token) GROUP BY 1, 2),
 sc AS (SELECT hl.ticker, hl.headline, hl.pos, coalesce(v, 0) / sqrt(coalesce(v, 0) * coalesce(v, 0) + 15) AS sentiment FROM hl LEFT JOIN sv USING (ticker, pos))"""
add("lexicon_sentiment", lambda s, d: rounded(scored(s, d).select("ticker", "pos", "sentiment")),
    f"WITH {SQL_SCORE} SELECT ticker, pos, round(sentiment, 6) AS sentiment FROM sc")
add("mean_sentiment", lambda s, d: rounded(tx.mean_sentiment(scored(s, d))),
    f"WITH {SQL_SCORE} SELECT ticker, headline, round(avg(sentiment), 6) AS sentiment FROM sc GROUP BY 1, 2")


def with_fallback(s, d):
    """English headlines of a source if it has any, else the other languages' ones."""
    x = table(s, d, "documents").select(F.col("source").alias("symbol"), F.when(F.col("lang") == "en", "google").otherwise("yahoo").alias("source"), "doc_id", "text")
    rows = first_source_with_rows(x, {"google": 0, "yahoo": 1}).select(F.col("symbol").alias("ticker"), "doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "headline"))
    return tx.first_headlines(tx.clean_headlines(rows.select("ticker", "headline", (F.col("doc_id") * 1_000_000 + F.col("_i")).alias("pos"))))


add("headline_fallback", with_fallback,
    f"WITH {SQL_HEAD.replace('FROM documents)', '''FROM documents d WHERE (lang = 'en') = EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang = 'en'))''')} "
    "SELECT ticker, headline, pos FROM hl QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos) <= 10")
