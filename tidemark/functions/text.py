"""Expressions on symbols, times and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case words that are not tickers.
NOT_TICKERS = (
    "THE AND FOR ARE BUT NOT YOU ALL ANY CAN HAD HER WAS ONE OUR OUT DAY GET HAS HIM HIS HOW MAN NEW NOW OLD SEE TWO WAY WHO BOY DID ITS "
    "LET PUT SAY SHE TOO USE CEO CFO COO USA USD GDP CPI PPI IPO ETF EPS PE AI IT IS OF TO IN ON AT BE BY OR AS WE US UP IF SO NO DO GO MY ME AM AN EX "
    "RSS API URL FAQ EDT EST PST PDT UTC GMT NYSE SEC FED FOMC FINRA"
).split()


def tickers(text: Column) -> Column:
    """Sorted distinct tickers: $-marked symbols and bare words of 2 to 5 capitals, without stopwords."""
    marked = F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,5})\b"), F.lit(1))
    found = F.filter(F.concat(marked, bare), lambda t: F.length(t) >= 2)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, NOT_TICKERS))))


def option_symbol(symbol: Column) -> dict[str, Column]:
    """Root (6), yymmdd, C/P and strike in thousandths (8) of a 21-character option symbol; a strike that does not fit goes on with its further digits."""
    day = F.concat_ws("-", F.concat(F.lit("20"), F.substring(symbol, 7, 2)), F.substring(symbol, 9, 2), F.substring(symbol, 11, 2))
    return {"root": F.trim(F.substring(symbol, 1, 6)), "expiry": day, "cp_flag": F.substring(symbol, 13, 1), "strike": F.regexp_extract(symbol, r"^(?s:.{13})((?s:.{1,8})[0-9]*)", 1).try_cast("double") / 1000.0}


def vendor_option_symbol(symbol: Column) -> dict[str, Column]:
    """Parts of ``O:ROOTyymmddC########``."""
    pattern = r"^O:([A-Z]+)(\d{6})([CP])(\d+)$"
    part = lambda i: F.regexp_extract(symbol, pattern, i)
    return {"root": part(1), "yymmdd": part(2), "cp_flag": part(3), "strike": part(4).try_cast("double") / 1000.0}


def utc_day(value: Column) -> Column:
    """Date of a string that is epoch seconds or a timestamp; null for anything else."""
    seconds = value.try_cast("double")
    return F.to_date(F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(value.try_cast("timestamp")))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null, empty nor 0."""
    return F.coalesce(*[F.nullif(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit("0")) for v in values])


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:00")


def fixed_point(value: Column, scale: float = 1e-9) -> Column:
    return value.cast("double") * scale
