"""Rule tiers of pairs, links to invoices, and the 23 features, as column expressions."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import stored, unsent
from ..sources.batch import Sources
from .blocking import PAIR, amount_pairs, name_pairs, payments_with_names
from .similarity import partial_ratio, token_set_ratio

# Scores of the tiers and of invoice links.
UTR_AMOUNT_DATE, UTR_AMOUNT, AMOUNT_NAME, FEE_ADJUSTED, UTR_ONLY, AMOUNT_DATE, FUZZY, SUBSET_SUM = 0.99, 0.97, 0.94, 0.90, 0.82, 0.70, 0.65, 0.80
GIVEN, EXACT, TDS, PARTIAL = 1.0, 0.95, 0.90, 0.55
FUZZY_FLOOR = 0.55
FEATURES = (
    "amount_delta_abs", "amount_delta_pct", "amount_exact", "amount_within_tolerance", "date_delta_days", "date_delta_abs", "date_within_window",
    "narration_similarity", "narration_partial_similarity", "utr_in_narration", "utr_edit_distance", "counterparty_in_narration",
    "counterparty_match_frequency", "delta_matches_fee", "delta_matches_tds", "delta_matches_known_rate", "in_plausible_subset_sum", "n_blocking_passes",
    "credit_is_larger", "invoice_receipt_given", "invoice_link_score", "invoice_amount_ratio", "invoice_date_delta_days",
)


def joined(pairs: DataFrame, sources: Sources) -> DataFrame:
    """Pairs with both sides' columns; the payment's date is settled_date, the credit's value_date. Credits come first, so rows end up together
    by payment, as assignment and choice want them."""
    bank = sources.bank.select("txn_id", "credit", "value_date", "utrs", "normalized_narration")
    pay = payments_with_names(sources).drop("settlement_id", "txn_type", "fee", "tax", "method")
    return pairs.join(bank, "txn_id").join(pay, "entity_id")


def joined_apart(pairs: DataFrame, sources: Sources) -> DataFrame:
    """The same for pairs that are few and written: each side's columns are joined to the pairs alone, which are sent to where credits and
    payments are, and not those to them."""
    bank = sources.bank.select("txn_id", "credit", "value_date", "utrs", "normalized_narration")
    few = stored(sources.settlements.join(pairs.select("entity_id"), "entity_id", "left_semi"), "payments")
    bills = sources.invoices.join(few.select("invoice_id"), "invoice_id", "left_semi")
    pay = payments_with_names(replace(sources, settlements=few, invoices=bills)).drop("settlement_id", "txn_type", "fee", "tax", "method")
    credits = stored(pairs.select(*PAIR).distinct().join(bank, "txn_id"), "credits")
    return credits.join(pairs.join(pay, "entity_id"), [*PAIR])


def days_apart() -> Column:
    return F.datediff("value_date", "settled_date")


def name_seen() -> Column:
    flat = F.replace(F.col("counterparty"), F.lit(" "), F.lit(""))
    return (flat != "") & F.contains(F.replace(F.col("normalized_narration"), F.lit(" "), F.lit("")), F.substring(flat, 1, 6))


def rule_hit(similarity: Column | None = None) -> Column:
    """Struct (rule, rule_score, layer) of the first tier that holds, null if none; without similarity the fuzzy tier is off."""
    hit = lambda rule, score, layer: F.struct(F.lit(rule).alias("rule"), (score if isinstance(score, Column) else F.lit(score)).alias("rule_score"), F.lit(layer).alias("layer"))
    utr, same = F.array_contains("utrs", F.col("utr")), F.col("credit") == F.col("net_amount")
    close, dated = F.abs(F.col("credit") - F.col("net_amount")) <= S.TOLERANCE, F.coalesce(F.abs(days_apart()) <= S.WINDOW_DAYS, F.lit(False))
    fee = F.abs(F.col("credit") - S.net_after_fee(F.col("amount"))) <= S.TOLERANCE
    tiers = [
        (utr & same & dated, hit("utr_amount_date", UTR_AMOUNT_DATE, "exact")),
        (utr & same, hit("utr_amount", UTR_AMOUNT, "exact")),
        (same & name_seen() & dated, hit("exact_amount_counterparty", AMOUNT_NAME, "exact")),
        (fee & dated, hit("fee_adjusted", FEE_ADJUSTED, "fuzzy")),
        (utr & close, hit("utr_amount_tolerance", UTR_AMOUNT, "exact")),
        (utr, hit("utr_only", UTR_ONLY, "exact")),
        (same & dated, hit("exact_amount_date", AMOUNT_DATE, "fuzzy")),
    ]
    if similarity is not None:
        tiers.append((name_seen() & dated & (similarity >= FUZZY_FLOOR), hit("fuzzy_counterparty_date", F.round(F.lit(FUZZY) * F.least(F.lit(1.0), similarity), 4), "fuzzy")))
    out = F
    for condition, value in tiers:
        out = out.when(condition, value)
    return out


def surely_best(sources: Sources) -> DataFrame:
    """(entity_id) of the payments whose best pair is of the first tier, which asks for the UTR, so only pairs that share it are met."""
    right = sources.bank.select(F.col("credit").alias("net_amount"), "value_date", F.explode("utrs").alias("utr"))
    left = sources.payments.select("entity_id", "utr", "net_amount", "settled_date")
    return left.join(right, ["utr", "net_amount"]).where(S.within_days(F.col("value_date"), F.col("settled_date"), S.WINDOW_DAYS)).select("entity_id").distinct()


def _if_any(hit: Column) -> Column:
    """The fields of a struct; rows where it is null go. A filter on it would compute it twice."""
    return F.inline(F.filter(F.array(hit), lambda h: h.isNotNull()))


def date_penalty() -> Column:
    return F.coalesce(F.abs(days_apart()), F.lit(S.MISSING_DAYS)) / F.lit(1000.0)


def scored(pairs: DataFrame, sources: Sources) -> DataFrame:
    """Pairs that some tier fits, with rule, rule_score, layer and penalty. Only where no exact tier fits are names compared, and once."""
    return joined(pairs, sources).select("*", _if_any(rule_hit(token_set_ratio("counterparty", "normalized_narration")))).withColumn("penalty", date_penalty())


def placed(hits: DataFrame, run: Column | None = None) -> DataFrame:
    """Pairs with `place`, from 1 for the best of its payment, in each run if `run` tells several apart. Scored pairs lie together by payment, so
    they are not sent again."""
    w = Window.partitionBy("entity_id", *([] if run is None else [run])).orderBy(F.desc("rule_score"), "penalty", "txn_id")
    return hits.withColumn("place", F.row_number().over(w))


def best_pairs(hits: DataFrame, run: Column | None = None) -> DataFrame:
    """The best pair of each payment, in each run if `run` tells several apart."""
    return placed(hits, run).where("place = 1").drop("place")


#: Columns of either side of a scored pair.
CREDIT = ("credit", "value_date", "utrs", "normalized_narration")
PAYMENT = ("utr", "invoice_id", "amount", "net_amount", "settled_date", "counterparty", "name_key")


def _by_utr(sources: Sources) -> DataFrame:
    """Every payment with the best of the credits that share its UTR, scored, and nulls where none does. Rows that meet lie together by UTR, so
    the best is chosen where they are."""
    bank = sources.bank.select("txn_id", *CREDIT, F.explode("utrs").alias("utr"))
    pay = payments_with_names(sources).select("entity_id", "settlement_id", *PAYMENT)
    could = F.length("utr") == S.UTR_DIGITS  # others share one with no credit, and '' would be a heavy key
    met = pay.where(could).join(bank, "utr", "left").withColumns({"hit": rule_hit(), "penalty": date_penalty()})
    w = Window.partitionBy("utr", "entity_id", "settlement_id", "invoice_id", "amount", "net_amount", "settled_date").orderBy(F.desc("hit.rule_score"), "penalty", "txn_id")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(pay.where(~could), allowMissingColumns=True)


def deciding_pairs(sources: Sources, claimed: DataFrame | None = None) -> DataFrame:
    """The best pair of each payment without its passes, as best_pairs has it, in tables of its own; claimed is not looked at.

    Tiers of 0.97 or more ask for the UTR, so payments that reach one are done. Those below it, but for fuzzy names, are of the net amount or of
    that after the fee, so the others are met by these two alone. Fuzzy names come last: for payments with a name that nothing else fits, all
    passes are made, and for those of a few paise, whose amounts the passes by amount leave out."""
    again = sources.payments.groupBy("entity_id").count().where("count > 1").limit(1).count()  # ids of several payments, which pairs do not tell apart
    met = stored(_by_utr(sources), "by-utr")
    done = F.coalesce(F.col("hit.rule_score") >= UTR_AMOUNT, F.lit(False))
    left = met.where(~done)
    net, after_fee, near = F.col("net_amount"), S.net_after_fee(F.col("amount")), lambda t: F.abs(F.col("credit") - t) <= S.TOLERANCE
    exact = stored(amount_pairs(left, sources.bank, F.array(net, after_fee), (F.col("credit") == net) | (after_fee > 0) & near(after_fee)), "by-amount")
    plain = (net > 0) & (after_fee > S.TOLERANCE)
    unmet = left.where(plain & F.col("txn_id").isNull() & (F.col("counterparty") != "")).join(exact.select("entity_id"), "entity_id", "left_anti")
    odd = left.where(~plain)
    if again:
        odd = left.join(odd.select("entity_id").distinct(), "entity_id", "left_semi")
    rest = stored(unmet.unionByName(odd).select("entity_id", "settlement_id", "settled_date", "amount", "net_amount", "name_key"), "unmet")
    every = S.plausible_credits(F.col("amount"), net)
    more = amount_pairs(rest, sources.bank, every, F.exists(every, near)).unionByName(name_pairs(rest, sources).select("entity_id", "txn_id"))
    own = left.where("txn_id is not null").select("entity_id", "txn_id")
    if odd.limit(1).count():  # with ids of several credits, such a payment's best need not be of the row that shares its UTR
        own = own.unionByName(odd.drop("txn_id").join(sources.bank.select("txn_id", F.explode("utrs").alias("utr")), "utr").select("entity_id", "txn_id"))
    pairs = reduce(DataFrame.unionByName, (own, exact, more)).repartition("txn_id").distinct()  # by credit, where the join with the credits finds them
    rows = pairs.join(sources.bank.select("txn_id", *CREDIT), "txn_id").join(left.select("entity_id", "settlement_id", *PAYMENT), "entity_id")
    hits = rows.select("*", _if_any(rule_hit(token_set_ratio("counterparty", "normalized_narration")))).withColumn("penalty", date_penalty())
    sure = met.where(done).select("entity_id", "txn_id", "settlement_id", *CREDIT, *PAYMENT, "hit.*", "penalty")
    best = sure.unionByName(stored(best_pairs(hits).select(*sure.columns), "best"))
    return stored(best_pairs(best), "best") if again else best


def link_hit() -> Column:
    """Struct (link_score, link_rule) of an invoice (gross, invoice_date) for a payment (amount, settled_date), or null."""
    link = lambda score, rule: F.struct(F.lit(score).alias("link_score"), F.lit(rule).alias("link_rule"))
    captured, gross = F.col("amount"), F.col("gross")
    after_tds = F.exists(F.array(*[gross - S.percent_of(gross, r) for r in S.TDS_RATES]), lambda x: x == captured)
    in_time = F.datediff("settled_date", "invoice_date").between(-1, 8) & (gross > 0)
    chosen = F.when(captured == gross, link(EXACT, "invoice_exact_amount")).when(after_tds, link(TDS, "invoice_tds_adjusted")).when((captured / gross).between(0.30, 0.97), link(PARTIAL, "invoice_partial_payment"))
    return F.when(in_time, chosen)


def keyed_bills(invoices: DataFrame) -> DataFrame:
    """Dated invoices with the key of their name, as far as links look at them."""
    return invoices.where("invoice_date is not null").select("invoice_id", F.col("amount").alias("gross"), "invoice_date", S.counterparty_key(F.col("customer_name")).alias("name_key")).where("name_key <> ''")


def _named(pairs: DataFrame, sources: Sources, bills: DataFrame | None = None) -> DataFrame:
    """Pairs without a receipt and the invoices that their narration names, dated from a day before to eight days ahead of the payout. A pair
    has one week; invoices, of which there are far fewer than keys of pairs, go to all weeks that their window touches."""
    open_pairs = pairs.where("invoice_id = '' and settled_date is not null").select(*PAIR, "amount", "settled_date", F.explode(S.narration_keys(F.col("normalized_narration"))).alias("name_key"))
    left = sources.named(open_pairs).withColumn("week", S.week_of(F.col("settled_date")))
    weeks = F.array_distinct(F.array(*[S.week_of(F.date_add(F.col("invoice_date"), d)) for d in (-1, 6, 8)]))
    inv = (keyed_bills(sources.invoices) if bills is None else bills).select("*", F.explode(weeks).alias("week"))
    return left.join(unsent(inv), ["name_key", "week"]).where(F.datediff("settled_date", "invoice_date").between(-1, 8)).drop("name_key", "week")


def invoice_candidates(pairs: DataFrame, sources: Sources) -> DataFrame:
    return _named(pairs, sources).dropDuplicates(["entity_id", "txn_id", "invoice_id"])


def _linked(named: DataFrame) -> DataFrame:
    return named.select("*", _if_any(link_hit())).withColumn("link_days", F.datediff("settled_date", "invoice_date"))


def fitting_links(pairs: DataFrame, sources: Sources, invoices: DataFrame | None = None) -> DataFrame:
    """A link for each pair and each of the invoices (all by default) that fits it; repeated ids repeat it."""
    return _linked(_named(pairs, sources, None if invoices is None else keyed_bills(invoices))).select(*PAIR, "invoice_id", "link_score", "link_rule", "link_days")


def open_links(pairs: DataFrame, sources: Sources, *ids: str) -> DataFrame:
    """Links of pairs, by these of their ids, to invoices that no receipt names, which are taken off before links are made."""
    unpaid = keyed_bills(sources.invoices).join(pairs.where("invoice_id <> ''").select("invoice_id").distinct(), "invoice_id", "left_anti")
    return _linked(_named(pairs, sources, unpaid)).select(*ids, "invoice_id", "link_score", "link_rule", "link_days")


def link_scores(pairs: DataFrame, sources: Sources) -> DataFrame:
    """Invoices that fit no link are dropped before doubles are looked for."""
    return fitting_links(pairs, sources).dropDuplicates(["entity_id", "txn_id", "invoice_id"])


def given_links(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.where("invoice_id <> ''").select(*PAIR, "invoice_id", F.lit(GIVEN).alias("link_score"), F.lit("receipt_given").alias("link_rule"), F.lit(0).alias("link_days"), *columns)


def best_links(pairs: DataFrame, sources: Sources) -> DataFrame:
    """For each pair the given receipt, else the best named invoice (not yet one to one)."""
    inferred = _linked(_named(pairs, sources)).groupBy(*PAIR).agg(F.min(F.struct((-F.col("link_score")).alias("_s"), F.abs(F.col("link_days")).alias("_d"), "invoice_id", "link_score", "link_rule", "link_days")).alias("l"))
    return given_links(pairs).unionByName(inferred.select(*PAIR, "l.invoice_id", "l.link_score", "l.link_rule", "l.link_days"))


def billed(sources: Sources, *columns: str) -> DataFrame:
    """Columns of each invoice under the names that features() reads: link_invoice, _gross, _inv_date."""
    return sources.ledger_of(*columns).withColumnsRenamed({"invoice_id": "link_invoice", "amount": "_gross", "invoice_date": "_inv_date"})


def features(rows: DataFrame, sources: Sources, similarities: bool = True) -> DataFrame:
    """Candidate rows (joined columns, passes, link columns) with the features as flat DOUBLE columns, never null."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rows = rows.join(sources.often, "counterparty", "left")
    if "_gross" not in rows.columns:
        rows = rows.join(billed(sources, "amount", "invoice_date"), "link_invoice", "left")
    delta = F.col("credit") - F.col("net_amount")
    base = F.when(F.col("net_amount") == 0, F.lit(1)).otherwise(F.col("net_amount"))
    days = days_apart()
    near = lambda x: F.abs(F.col("credit") - x) <= S.TOLERANCE
    out = {
        "amount_delta_abs": F.abs(delta).cast("double"), "amount_delta_pct": delta.cast("double") / F.abs(base), "amount_exact": flag(delta == 0), "amount_within_tolerance": flag(F.abs(delta) <= S.TOLERANCE),
        "date_delta_days": F.coalesce(days, F.lit(S.MISSING_DAYS)).cast("double"), "date_delta_abs": F.coalesce(F.abs(days), F.lit(S.MISSING_DAYS)).cast("double"), "date_within_window": flag(F.abs(days) <= S.WINDOW_DAYS),
        "utr_in_narration": flag(F.array_contains("utrs", F.col("utr"))), "utr_edit_distance": S.closest_utr_distance(F.col("utr"), F.col("utrs")).cast("double"), "counterparty_in_narration": flag(name_seen()),
        "counterparty_match_frequency": F.coalesce("_often", F.lit(0)).cast("double"), "delta_matches_fee": flag(near(S.net_after_fee(F.col("amount")))),
        "delta_matches_tds": flag(F.exists(F.array(*[F.col("amount") - S.percent_of(F.col("amount"), r) for r in S.TDS_RATES]), near)), "delta_matches_known_rate": flag(F.exists(S.plausible_credits(F.col("amount"), F.col("net_amount")), near)),
        "in_plausible_subset_sum": flag(F.col("in_subset_sum")) if "in_subset_sum" in rows.columns else F.lit(0.0), "n_blocking_passes": F.size("passes").cast("double"), "credit_is_larger": flag(delta > 0),
        "invoice_receipt_given": flag(F.col("link_rule") == "receipt_given"), "invoice_link_score": F.coalesce("link_score", F.lit(0.0)),
        "invoice_amount_ratio": F.when(F.col("_gross") > 0, F.col("amount").cast("double") / F.col("_gross")).otherwise(0.0), "invoice_date_delta_days": F.coalesce(F.datediff("settled_date", "_inv_date"), F.lit(S.MISSING_DAYS)).cast("double"),
    }
    if similarities:
        out["narration_similarity"] = token_set_ratio("counterparty", "normalized_narration")
        out["narration_partial_similarity"] = partial_ratio("counterparty", "normalized_narration")
    return rows.withColumns(out).drop("_often", "_gross", "_inv_date")
