"""Symbol predicates and the spellings data providers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.expr import col

# fixed values: bases that count as crypto assets
CRYPTO_BASES = (
    "BTC", "ETH", "SOL", "DOGE", "ADA", "XRP", "BNB", "AVAX", "DOT", "MATIC", "LTC", "LINK", "BCH", "ATOM", "TRX", "XLM",
    "UNI", "AAVE", "SHIB", "USDT", "USDC",
)


def tidy(symbol: str | Column) -> Column:
    return F.upper(F.trim(col(symbol)))


def is_crypto(symbol: str | Column) -> Column:
    """BASE-USD with a known base, or a known base alone."""
    s = tidy(symbol)
    base = F.when(s.rlike(r"^[A-Z0-9]{2,10}-USD$"), F.regexp_replace(s, "-USD$", "")).otherwise(s)
    return F.coalesce(base.isin(*CRYPTO_BASES), F.lit(False))


def is_equity(symbol: str | Column) -> Column:
    """A plain ticker: neither a dash nor an equals sign."""
    s = tidy(symbol)
    return F.coalesce((s != "") & ~s.contains("=") & ~s.contains("-"), F.lit(False))


def dashed(symbol: str | Column) -> Column:
    """Index constituents write share classes with a dot, price feeds with a dash."""
    return F.upper(F.trim(F.translate(col(symbol), ".", "-")))


def stooq_name(symbol: str | Column) -> Column:
    """EURUSD=X -> eurusd, BTC-USD -> btcusd, AAPL -> aapl.us, six letters stay; else NULL."""
    s = F.lower(F.trim(col(symbol)))
    return (
        F.when(s.endswith("=x") & (F.length(s) >= 5), F.regexp_replace(s, "=x", ""))
        .when(s.rlike("^[a-z]+-[a-z]+$"), F.regexp_replace(s, "-", ""))
        .when(s.rlike("^[a-z]{6}$"), s)
        .when(s.rlike("^[a-z]+$"), F.concat(s, F.lit(".us")))
    )


def kraken_pair(symbol: str | Column) -> Column:
    """BTC-USD -> XBTUSD, ETH-USD -> ETHUSD; NULL for anything that is not a letter pair."""
    s = tidy(symbol)
    return F.when(s.rlike("^[A-Z]+-[A-Z]+$"), F.regexp_replace(F.regexp_replace(s, "^BTC-", "XBT-"), "-", ""))


def display_metric(name: str | Column) -> Column:
    """Readable metric names; unknown ones stay."""
    # fixed values: display names
    names = {
        "m_sharpe": "Sharpe ratio (annualized)", "m_total_return": "Total return", "m_cagr": "CAGR",
        "m_max_drawdown": "Max drawdown", "t_win_rate": "Win rate", "t_profit_factor": "Profit factor",
        "t_expectancy": "Avg trade return (expectancy)",
    }
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[col(name)], col(name))
