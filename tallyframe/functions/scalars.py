"""Column builders for money, dates and names. Money is whole paise (LONG); missing strings are ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates of the payment gateway and of tax deducted at source, tolerances and windows.
FEE_RATE, GST_RATE, TDS_RATES = 0.02, 0.18, (0.001, 0.02, 0.05, 0.10)
TOLERANCE, WINDOW_DAYS, BAND_RATIO, MISSING_DAYS = 5, 3, 1.15, 999
UTR_DIGITS = 12
# Corporate suffixes, of which the first that fits is removed, and the words that never key a name.
SUFFIXES = ("INDIA PRIVATE LIMITED", "PRIVATE LIMITED", "AND COMPANY", "PVT LTD", "P LTD", "LIMITED", "LTD", "LLP", "PVT")
SUFFIX_WORDS = ("PRIVATE", "LIMITED", "LTD", "PVT", "LLP", "INDIA", "AND", "COMPANY", "P")


def to_paise(x: Column) -> Column:
    """'1,234.56' to 123456, truncating toward zero; '' and null to 0."""
    plain = F.trim(F.regexp_replace(x, ",", ""))
    return F.coalesce((plain.try_cast("decimal(20,4)") * 100).cast("bigint"), F.lit(0).cast("bigint"))


def rupees(paise: Column) -> Column:
    whole, part = F.floor(F.abs(paise) / 100), F.abs(paise) % 100
    return F.concat(F.when(paise < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 2, "0"))


def rupees_grouped(paise: Column) -> Column:
    return F.format_number((paise / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)"), 2)


def half_up(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + F.lit(0.5))).otherwise(-F.floor(-x + F.lit(0.5)))


def percent_of(paise: Column, rate: float) -> Column:
    return half_up(paise.cast("double") * F.lit(rate))


def net_after_fee(amount: Column) -> Column:
    fee = percent_of(amount, FEE_RATE)
    return amount - fee - percent_of(fee, GST_RATE)


def plausible_credits(amount: Column, net: Column) -> Column:
    """Distinct positive credits that a known deduction explains."""
    after_tds = [amount - percent_of(amount, r) for r in TDS_RATES]
    every = [net, amount, net_after_fee(amount), *after_tds, *(net_after_fee(x) for x in after_tds)]
    return F.filter(F.array_distinct(F.array(*[x.cast("bigint") for x in every])), lambda x: x > 0)


def amount_band(paise: Column) -> Column:
    return F.when(paise > 0, F.floor(F.ln(paise.cast("double")) / F.ln(F.lit(BAND_RATIO)))).otherwise(F.lit(0)).cast("bigint")


def parse_date(text: Column) -> Column:
    """Day-first bank dates in seven notations; two-digit years below 69 belong to this century, others to the last."""
    t = F.trim(text)
    day = lambda pattern: F.try_to_date(t, pattern)
    short = F.coalesce(day("d/M/yy"), day("d-M-yy"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(day("yyyy-M-d"), day("d/M/yyyy"), day("d-M-yyyy"), short, day("d MMM yyyy"), day("d-MMM-yyyy"))


def unix_to_date(x: Column) -> Column:
    return F.to_date(F.timestamp_seconds(x.try_cast("bigint")))


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def day_bucket(d: Column, window: int = WINDOW_DAYS) -> Column:
    return F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.unix_date(d) + k)


def weeks_near(d: Column, window: int = WINDOW_DAYS) -> Column:
    """Numbers of the seven-day spans that the window touches: keys for an equi-join ahead of the exact day test."""
    return F.array_distinct(F.array(week_of(F.date_sub(d, window)), week_of(F.date_add(d, window)), week_of(d)))


def week_of(d: Column) -> Column:
    return F.floor(F.unix_date(d) / 7).cast("bigint")


def extract_utrs(narration: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(narration, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) == UTR_DIGITS))


def normalize_counterparty(name: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(spaced, f"( |^)({'|'.join(SUFFIXES)})$", ""), "[^A-Z0-9]+", "")


def counterparty_key(name: Column) -> Column:
    """Four characters of the first word and three of the second, suffix words apart; seven of a lone word."""
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIX_WORDS))
    return F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, F.substring(F.get(kept, F.lit(0)), 1, 7)).otherwise(F.concat(F.substring(F.get(kept, F.lit(0)), 1, 4), F.substring(F.get(kept, F.lit(1)), 1, 3)))


def normalize_narration(narration: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(narration, F.lit(""))), "[^A-Z0-9]+", " "))


def _alphabetic(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t.rlike("^[A-Z]{3,}$"))


def narration_tokens(normalized: Column) -> Column:
    return F.array_distinct(_alphabetic(normalized))


def narration_keys(normalized: Column) -> Column:
    """Name keys a narration could carry: of each two adjacent words, and of each long word."""
    tokens = _alphabetic(normalized)
    pairs = F.transform(tokens, lambda t, i: F.concat(F.substring(t, 1, 4), F.substring(F.get(tokens, i + 1), 1, 3)))
    pairs = F.filter(pairs, lambda x: x.isNotNull())
    longer = F.transform(F.filter(tokens, lambda t: F.length(t) >= 7), lambda t: F.substring(t, 1, 7))
    return F.array_union(pairs, longer)


def closest_utr_distance(utr: Column, utrs: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(utrs, lambda u: F.levenshtein(u, utr))), F.length(utr))


def row_hash(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts, each ended by a NUL."""
    return F.substring(sha_of(*parts), 1, 16)


def sha_of(*parts: Column) -> Column:
    ended = [F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]
    return F.sha2(reduce(lambda a, b: F.concat(a, b), ended), 256)


def md5_bucket(x: Column, n: int) -> Column:
    """A bucket that any engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % n
