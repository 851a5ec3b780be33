"""Candidate pairs of payments and bank credits: four keyed passes and their union. No pass is a cross product: each has an equi-key, and
windows of days and paise are exact tests behind keys of spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import unsent
from ..sources.batch import Sources

#: Width of the paise spans of the tolerance join; two touching spans hold any window of 2 * TOLERANCE + 1.
SPAN = 16
PAIR = ("settlement_id", "entity_id", "txn_id")


def payments_with_names(sources: Sources) -> DataFrame:
    """Payments with the invoice that their receipt names: its counterparty ('' if none) and key."""
    ledger = sources.ledger_of("customer_name", "counterparty").select(F.col("invoice_id").alias("_id"), "customer_name", F.col("counterparty").alias("_cp"))
    given, bare = sources.payments.where("invoice_id <> ''"), sources.payments.where("invoice_id = ''")  # most have none, a key too heavy for a shuffle
    unnamed = F.broadcast(ledger.where("_id = ''"))  # one row at most
    joined = given.join(ledger, F.col("invoice_id") == F.col("_id"), "left").unionByName(bare.join(unnamed, F.col("invoice_id") == F.col("_id"), "left"))
    return unsent(joined).withColumn("counterparty", F.coalesce("_cp", F.lit(""))).withColumn("name_key", F.when(F.col("counterparty") != "", S.counterparty_key(F.col("customer_name"))).otherwise("")).drop("_id", "_cp", "customer_name")


def _credits(bank: DataFrame, *columns: str | Column) -> DataFrame:
    return bank.where((F.col("credit") > 0) & F.col("value_date").isNotNull()).select("txn_id", "credit", "value_date", *columns)


def _dated(payments: DataFrame, *columns: str | Column) -> DataFrame:
    return payments.where(F.col("settled_date").isNotNull()).select("settlement_id", "entity_id", "settled_date", *columns)


def _of_week(df: DataFrame, day: str) -> DataFrame:
    return df.withColumn("week", S.week_of(F.col(day)))


def _by_week(df: DataFrame, day: str) -> DataFrame:
    """To all weeks that the window touches. Of the two sides of a join, that of fewer rows goes to several weeks."""
    return df.withColumn("week", F.explode(S.weeks_near(F.col(day))))


def _near() -> Column:
    return S.within_days(F.col("value_date"), F.col("settled_date"), S.WINDOW_DAYS)


def pass_utr(sources: Sources) -> DataFrame:
    bank = sources.bank.select("txn_id", F.explode("utrs").alias("utr"))
    return sources.payments.join(bank, "utr").select(*PAIR)


def pass_exact(sources: Sources) -> DataFrame:
    left = _of_week(_dated(sources.payments, F.col("net_amount").alias("credit")), "settled_date")
    return left.join(_by_week(_credits(sources.bank), "value_date"), ["credit", "week"]).where(_near()).select(*PAIR)


def _rate_hits(sources: Sources) -> DataFrame:
    """Pairs by a target within the tolerance of a credit, with `exact`: the credit is the net amount, which is one of the targets. A target has
    one key of a span and a week; a credit goes to all that its tolerance touches, as there are a dozen targets to a credit."""
    span = lambda c: F.floor(c / SPAN)
    net = F.col("net_amount")
    targets = sources.payments.withColumn("target", F.explode(S.plausible_credits(F.col("amount"), net)))
    left = _dated(targets, "target", (F.col("target") == net).alias("is_net"))  # its keys are made where they are used, not sent
    touched = F.explode(F.array_distinct(F.array(span(F.col("credit") - S.TOLERANCE), span(F.col("credit") + S.TOLERANCE)))).alias("span")
    keys = (span(F.col("target")) == F.col("span")) & (S.week_of(F.col("settled_date")) == F.col("week"))
    met = left.join(_by_week(_credits(sources.bank, touched), "value_date"), keys).where(_near() & (F.abs(F.col("credit") - F.col("target")) <= S.TOLERANCE))
    return met.select(*PAIR, (F.col("is_net") & (F.col("credit") == F.col("target"))).alias("exact"))


def pass_rate(sources: Sources) -> DataFrame:
    """A row for each hit: two targets within the tolerance of one credit hit it twice."""
    return _rate_hits(sources).select(*PAIR)


def amount_pairs(payments: DataFrame, bank: DataFrame, targets: Column, fits: Column) -> DataFrame:
    """(entity_id, txn_id) of payments and credits near in days for which `fits` holds, as it does for no credit beyond the tolerance of all targets.
    For payments that are fewer than credits: a credit has one key of a span and a week, payments go to all that they touch."""
    span = lambda c: F.floor(c / SPAN)
    touched = F.array_distinct(F.flatten(F.transform(targets, lambda t: F.array(span(t - S.TOLERANCE), span(t + S.TOLERANCE)))))
    dated = payments.where(F.col("settled_date").isNotNull()).select("entity_id", "settled_date", "amount", "net_amount", F.explode(touched).alias("span"))
    keys = (span(F.col("credit")) == F.col("span")) & (S.week_of(F.col("value_date")) == F.col("week"))
    return _by_week(dated, "settled_date").join(_credits(bank), keys).where(_near() & fits).select("entity_id", "txn_id")


def name_pairs(named: DataFrame, sources: Sources) -> DataFrame:
    """(settlement_id, entity_id, txn_id) of payments with names and credits whose narration could carry them. Credits have more keys than
    payments with a name, so payments go to several bands and weeks; keys that are no invoice's name go first."""
    band = S.amount_band(F.col("net_amount"))
    left = _by_week(_dated(named.where("name_key <> ''"), "name_key", F.explode(F.array(band - 2, band - 1, band)).alias("band")), "settled_date")
    keyed = sources.named(_credits(sources.bank, F.explode(S.narration_keys(F.col("normalized_narration"))).alias("name_key")))
    right = _of_week(keyed, "value_date").withColumn("band", S.amount_band(F.col("credit"))).drop("credit")
    return left.join(unsent(right), ["name_key", "band", "week"]).where(_near()).select(*PAIR)


def pass_counterparty(sources: Sources) -> DataFrame:
    return name_pairs(payments_with_names(sources), sources)


PASSES = {"utr": pass_utr, "exact_amount": pass_exact, "rate_amount": pass_rate, "counterparty": pass_counterparty}


def hits(sources: Sources) -> DataFrame:
    """Hits of all passes. Exact amounts are read off the rate pass, among whose targets the net amount is."""
    both, one = F.array(F.lit("exact_amount"), F.lit("rate_amount")), F.array(F.lit("rate_amount"))
    amounts = _rate_hits(sources).select(*PAIR, F.explode(F.when(F.col("exact"), both).otherwise(one)).alias("pass"))
    rest = [PASSES[name](sources).withColumn("pass", F.lit(name)) for name in ("utr", "counterparty")]
    return reduce(DataFrame.unionByName, rest, amounts)


def candidates(sources: Sources) -> DataFrame:
    """Distinct pairs with the sorted names of the passes that met them. Passes are flags until pairs are distinct, which need no sort as sets
    do, and hits meet by credit, where the join with the credits finds them."""
    names = sorted(PASSES)
    flagged = lambda df, **own: df.select(*PAIR, *[own.get(n, F.lit(n in own)).alias(n) for n in names])
    met = flagged(pass_utr(sources), utr=F.lit(True)).unionByName(flagged(_rate_hits(sources), exact_amount=F.col("exact"), rate_amount=F.lit(True)))
    met = met.unionByName(flagged(pass_counterparty(sources), counterparty=F.lit(True)))
    seen = met.repartition("txn_id").groupBy(*PAIR).agg(*[F.max(n).alias(n) for n in names])
    return seen.select(*PAIR, F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names])).alias("passes"))


def blocking_stats(sources: Sources) -> DataFrame:
    """Hits and distinct pairs of each pass."""
    return hits(sources).groupBy("pass", *PAIR).agg(F.count("*").alias("h")).groupBy("pass").agg(F.sum("h").alias("hits"), F.count("*").alias("pairs"))
