"""Corruptions of bank rows: each a pair of expressions for narration, credit or date; derived columns are made anew from the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.batch import derived_narration

DIGITS12 = r"(?<![0-9])([0-9]{4})([0-9]{4})([0-9]{4})(?![0-9])"


def _unseen() -> dict[str, Column]:
    utr = F.coalesce(F.get(S.extract_utrs(F.col("narration")), F.lit(0)), F.lit("000000000000"))
    names = F.slice(F.regexp_extract_all("narration", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 2)
    name = F.when(F.size(names) == 0, "PAYER").otherwise(F.array_join(names, " "))
    day = F.coalesce(F.col("value_date").cast("string"), F.lit(""))
    return {"narration": F.concat(F.lit("TXN|"), day, F.lit("|CR|REF#"), utr, F.lit("|REMITTER="), name, F.lit("|CHNL=RTGS|STS=SUCCESS"))}


def _transliterated() -> dict[str, Column]:
    """Words of four capitals or more, letter by letter, in one pass each."""
    marked = F.split(F.regexp_replace("narration", "([A-Z]{4,})", "\u0001$1\u0001"), "\u0001")
    swap = {"A": "aA", "I": "eE", "U": "oO", "V": "W", "S": "sH"}  # small letters stand for new ones until all are swapped
    def word(x: Column) -> Column:
        for letter, new in swap.items():
            x = F.replace(x, F.lit(letter), F.lit(new.lower()))
        return F.upper(x)
    return {"narration": F.array_join(F.transform(marked, lambda x: F.when(x.rlike("^[A-Z]{4,}$"), word(x)).otherwise(x)), "")}


CORRUPTIONS: dict[str, Callable[[], dict[str, Column]]] = {
    "unseen_narration": _unseen,
    "wrapped_utr": lambda: {"narration": F.regexp_replace("narration", DIGITS12, "$1 $2 $3")},
    "date_format_swap": lambda: {"value_date": F.date_sub("value_date", 1)},
    "unmodelled_fee": lambda: {"credit": F.greatest(F.lit(0).cast("bigint"), F.col("credit") - F.floor(F.col("credit").cast("double") * F.lit(0.0037)).cast("bigint") - 11)},
    "transliterated_counterparty": _transliterated,
    "truncated_narration": lambda: {"narration": F.substring("narration", 1, 24)},
    "currency_symbol_noise": lambda: {"narration": F.concat("narration", F.lit(" AMT INR "), S.rupees_grouped(F.col("credit")), F.lit("/-"))},
    "merged_credits": lambda: {"narration": F.concat("narration", F.lit(" +CONSOLIDATED")), "credit": F.col("credit") + 50_000 + S.md5_bucket(F.concat(F.lit("merge:"), F.col("txn_id")), 450_000)},
}
CLEAN = "clean"
#: Fixed value: what a request that names nothing gets.
DEFAULT = "unseen_narration"
# Words of a request that name a corruption.
KEYWORDS = {
    "date_format_swap": ("date", "dates", "day", "timing", "value date", "calendar", "early", "late", "shift"),
    "wrapped_utr": ("utr", "reference number", "wrap", "wrapped", "split", "line break", "fixed width", "spaces in"),
    "unseen_narration": ("narration", "format", "different bank", "new bank", "another bank", "unknown bank", "grammar", "layout", "unreadable", "garbled"),
    "unmodelled_fee": ("fee", "fees", "charge", "commission", "deduction", "deducted", "short", "shortfall", "percentage"),
    "transliterated_counterparty": ("name", "names", "counterparty", "payer", "spelling", "transliterat", "translated", "regional", "language"),
    "truncated_narration": ("truncat", "cut", "cut off", "shorten", "clipped", "limit"),
    "currency_symbol_noise": ("currency", "symbol", "rupee", "inr", "amount in the", "noise", "junk"),
    "merged_credits": ("merge", "merged", "combine", "combined", "lump", "consolidat", "batch", "together", "one payment"),
}


def chosen(name: str, share: float, seed: int = 7) -> Column:
    """Rows of a seeded share, by a hash of the id, the seed and the corruption's name."""
    return S.md5_bucket(F.concat(F.lit(f"{seed}:{name}:"), F.col("txn_id")), 10_000) < int(share * 10_000)


def corrupted(bank: DataFrame, names: list[str], share: float = 1.0, seed: int = 7) -> DataFrame:
    """bank with the corruptions applied in order and the derived columns made anew; columns hit_<name> tell which rows changed."""
    out = bank
    for name in names:
        new = CORRUPTIONS[name]()
        picked = chosen(name, share, seed)
        changed = F.lit(False)
        for c, value in new.items():
            changed = changed | ~value.eqNullSafe(F.col(c))
        out = out.withColumns({**{c: F.when(picked, value).otherwise(F.col(c)) for c, value in new.items()}, f"hit_{name}": picked & changed})
    return derived_narration(out)


def variants(bank: DataFrame, names: tuple[str, ...] = tuple(CORRUPTIONS), share: float = 1.0, seed: int = 7) -> DataFrame:
    """bank as it is and once under each corruption, in one table; ids open with the variant's name and a slash."""
    each = [derived_narration(bank)] + [corrupted(bank, [n], share, seed).select(*bank.columns) for n in names]
    return reduce(DataFrame.unionByName, [df.select(*bank.columns).withColumn("txn_id", F.concat(F.lit(f"{n}/"), F.col("txn_id"))) for n, df in zip((CLEAN, *names), each, strict=True)])


def variant() -> Column:
    return F.substring_index("txn_id", "/", 1)


def outcomes(predictions: DataFrame, bank: DataFrame, payments: DataFrame, truth: DataFrame, invoices: DataFrame, threshold: float, names: tuple[str, ...] = tuple(CORRUPTIONS)) -> DataFrame:
    """A row for each variant: what its matches at the threshold come to against the one truth, beside those of the clean batch, and how it was
    borne. predictions and bank: over variants."""
    kept = predictions.where(F.col("confidence") >= threshold)
    top = kept.groupBy("invoice_id", "settlement_id", "txn_id").agg(F.count("*").alias("_n"))
    money = top.join(invoices.select("invoice_id", F.col("amount").alias("_billed")), "invoice_id", "left").join(bank.select("txn_id", F.col("credit").alias("_paid")), "txn_id", "left")
    good = truth.where("case_type <> 'orphan'").select("invoice_id", "settlement_id", F.col("txn_id").alias("_true"), F.lit(1).alias("right")).distinct()
    own = F.substring_index("txn_id", "/", -1)
    judged = money.withColumn("_true", own).join(good, ["invoice_id", "settlement_id", "_true"], "left").withColumn("wrong", F.when(F.col("right").isNull(), 1).otherwise(0))
    counts = judged.groupBy(variant().alias("corruption")).agg(F.count("*").alias("n"), F.sum("wrong").alias("false_matches"), F.sum(F.col("wrong") * F.coalesce("_billed", "_paid", F.lit(0))).alias("wrong_money"))
    matched = kept.groupBy(variant().alias("corruption")).agg(F.countDistinct("entity_id").alias("matched"))
    names = kept.sparkSession.createDataFrame([(n,) for n in (CLEAN, *names)], "corruption string")
    total = payments.agg(F.countDistinct("entity_id").alias("_all"))
    rows = names.join(counts, "corruption", "left").join(matched, "corruption", "left").na.fill(0).join(total)  # a row a variant, and one row
    rows = rows.select("corruption", "matched", (F.col("_all") - F.col("matched")).alias("exceptions"), F.coalesce(F.try_divide("matched", "_all"), F.lit(0.0)).alias("coverage"),
                       F.coalesce(F.try_divide(F.col("n") - F.col("false_matches"), F.col("n")), F.lit(1.0)).alias("precision"), "false_matches", "wrong_money")
    clean = rows.where(F.col("corruption") == CLEAN).select(*[F.col(c).alias(f"_{c}") for c in ("coverage", "false_matches", "wrong_money")])
    grown = {c: F.col(c) - F.col(f"_{c}") for c in ("coverage", "false_matches", "wrong_money")}
    graceful, reading = borne(grown)
    out = {"graceful": graceful, "coverage_delta": F.round(grown["coverage"], 4), "extra_false_matches": grown["false_matches"], "extra_wrong_money": grown["wrong_money"], "reading": reading}
    return rows.join(clean).withColumns(out).drop(*clean.columns)


def borne(grown: dict[str, Column]) -> tuple[Column, Column]:
    """Whether a corruption was borne gracefully, which is told by false matches: coverage may fall, they may not grow."""
    graceful = grown["false_matches"] <= 0
    return graceful, F.when(~graceful, "false matches grew").when(grown["coverage"] < 0, "coverage fell, no new false match").otherwise("no effect on matches")


def by_keyword(text: Column) -> Column:
    """Up to three corruptions whose words the text holds."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    def held(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(lowered, F.lit(w))
        return out
    return F.slice(F.filter(F.array(*[F.when(held(words), name) for name, words in KEYWORDS.items()]), lambda x: x.isNotNull()), 1, 3)


def share_from_text(text: Column, default: float = 0.5) -> Column:
    """A percentage in the text between 5 and 100, 1 for all, every or whole, else the default."""
    text = F.coalesce(text, F.lit(""))
    percent = F.regexp_extract(text, r"([0-9]{1,3})\s*%", 1)
    return F.when(percent != "", F.greatest(F.lit(0.05), F.least(F.lit(1.0), percent.try_cast("double") / 100))).when(F.lower(text).rlike(r"\b(all|every|whole)\b"), 1.0).otherwise(default)


def interpret(text: Column) -> dict[str, Column]:
    """What a request in free words asks for: corruptions (those its words name, else DEFAULT), share of rows, and what told."""
    text = F.trim(F.coalesce(text, F.lit("")))
    named = by_keyword(text)
    return {"corruptions": F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(DEFAULT))), "share": share_from_text(text), "interpreted_by": F.when(F.size(named) > 0, "keyword").otherwise("default")}


def verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: both outcomes and how the corruption was borne."""
    sides = [df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns]) for name, df in (("before", before), ("after", after))]
    grown = {c: F.col(f"after_{c}") - F.col(f"before_{c}") for c in ("coverage", "false_matches", "wrong_money")}
    graceful, reading = borne(grown)
    return sides[0].join(sides[1]).withColumns({"graceful": graceful, "coverage_delta": F.round(grown["coverage"], 4), "extra_false_matches": grown["false_matches"], "extra_wrong_money": grown["wrong_money"], "reading": reading})  # one row each
