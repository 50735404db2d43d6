"""Titles, dates and headings from landed feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: markup entities
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(markup: str | Column) -> Column:
    """Text of a markup fragment: no CDATA marks, no tags, entities resolved, trimmed."""
    t = F.col(markup) if isinstance(markup, str) else markup
    t = F.regexp_replace(t, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(t)


def _all(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(1))


def _first(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS feeds, or entries of Atom feeds: position, title and naive UTC time (columns
    pos, title, ts). Feeds without readable items give no rows."""
    items, entries = _all(xml, r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), _all(xml, r"(?s)<entry(?:\s[^>]*)?>(.*?)</entry>")
    keep = [c for c in feeds.columns if c != xml]
    f = feeds.select(*keep, xml, items.alias("_items"))
    rss = F.size("_items") > 0
    f = f.select(*keep, rss.alias("_rss"), F.when(rss, F.col("_items")).otherwise(entries).alias("_i"))
    f = f.select(*keep, "_rss", F.posexplode("_i").alias("pos", "_x"))
    x = F.col("_x")
    stamp = F.when(F.col("_rss"), _first(x, "pubDate")).otherwise(_first(x, "updated"))
    return f.select(*keep, "pos", plain_text(_first(x, "title")).alias("title"), feed_time(stamp).alias("ts"))


def feed_time(text: Column) -> Column:
    """Mail-style or ISO dates to naive UTC; unreadable ones are NULL."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z)$", " +0000")
    by_mail = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(by_mail, F.trim(text).try_cast("timestamp")).cast("timestamp_ntz")


def item_counts(feeds: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """Number of <item tags per key, for feeds whose dates cannot be read."""
    n = F.size(_all(xml, r"(<item[\s>])"))
    return feeds.groupBy(key).agg(F.sum(n).cast("long").alias("n_items"))


def headings(pages: DataFrame, *, html: str = "html", tag: str = "h3") -> DataFrame:
    """Non-empty headings of a tag in page order (columns pos, heading)."""
    keep = [c for c in pages.columns if c != html]
    x = pages.select(*keep, F.posexplode(_all(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")).alias("pos", "_x"))
    return x.select(*keep, "pos", plain_text("_x").alias("heading")).where(F.col("heading") != "")
