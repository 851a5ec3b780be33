"""Queries on sources, scalars, joins, rules and assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocking, matching, rules
from ..operators.similarity import token_set_ratio
from ..sources import batch
from . import flow
from . import oracle as O
from .registry import query

BIG = "CAST(count(*) AS BIGINT)"


def _joined(c):
    return F.array_join(F.sort_array(c), "|")


@query(O.sql("raw", "SELECT invoice_id, customer_name, amount, invoice_date FROM raw_invoices"))
def scan_csv_roundtrip(spark, sf_dir):
    from ..functions.storage import fresh_path

    path = fresh_path(spark, "csv")
    batch.write_csv(flow.raw(spark, sf_dir, "invoices"), path, batch.INVOICES)
    return batch.read_csv(spark, path, batch.INVOICES).select("invoice_id", "customer_name", "amount", "invoice_date")


@query(O.sql("typed", f"""SELECT 'invoices' AS relation, {BIG} AS n, CAST(sum(amount) AS BIGINT) AS money FROM inv UNION ALL SELECT 'settlements', {BIG}, CAST(sum(net_amount) AS BIGINT) FROM setl
UNION ALL SELECT 'bank', {BIG}, CAST(sum(credit) AS BIGINT) FROM bnk"""))
def load_sources_profile(spark, sf_dir):
    s = batch.derived_sources(spark, sf_dir)
    profile = lambda name, df, money: df.agg(F.count("*").alias("n"), F.sum(money).alias("money")).select(F.lit(name).alias("relation"), "n", "money")
    return profile("invoices", s.invoices, "amount").unionByName(profile("settlements", s.settlements, "net_amount")).unionByName(profile("bank", s.bank, "credit"))


@query(O.sql("typed", "SELECT invoice_id, customer_name, amount, CAST(invoice_date AS VARCHAR) AS invoice_date, tds_section, status, counterparty FROM inv"))
def invoices_typed(spark, sf_dir):
    return batch.derived_sources(spark, sf_dir).invoices.withColumn("invoice_date", F.col("invoice_date").cast("string"))


@query(O.sql("typed", "SELECT entity_id, settlement_id, utr, txn_type, invoice_id, amount, fee, tax, net_amount, CAST(settled_date AS VARCHAR) AS settled_date, method FROM setl"))
def settlements_typed(spark, sf_dir):
    return batch.derived_sources(spark, sf_dir).settlements.withColumn("settled_date", F.col("settled_date").cast("string"))


@query(O.sql("typed", f"SELECT txn_id, credit, debit, CAST(value_date AS VARCHAR) AS value_date, bank, bank_ref, {O.joined_text('utrs')} AS utrs, nn FROM bnk"))
def bank_typed(spark, sf_dir):
    b = batch.derived_sources(spark, sf_dir).bank
    return b.select("txn_id", "credit", "debit", F.col("value_date").cast("string").alias("value_date"), "bank", "bank_ref", _joined("utrs").alias("utrs"), F.col("normalized_narration").alias("nn"))


@query(O.sql("typed", f"SELECT method, {BIG} AS n, CAST(sum(net_amount) AS BIGINT) AS net FROM setl WHERE txn_type = 'payment' GROUP BY method"))
def payments_only(spark, sf_dir):
    return batch.derived_sources(spark, sf_dir).payments.groupBy("method").agg(F.count("*").alias("n"), F.sum("net_amount").alias("net"))


@query(O.sql("typed", "SELECT entity_id, cp AS counterparty FROM pay"))
def invoice_lookup(spark, sf_dir):
    return blocking.payments_with_names(flow.sources(spark, sf_dir)).select("entity_id", "counterparty")


@query(O.sql("typed", "SELECT entity_id, cp[1:10] AS prefix FROM pay"))
def counterparty_prefix(spark, sf_dir):
    return blocking.payments_with_names(flow.sources(spark, sf_dir)).select("entity_id", F.substring("counterparty", 1, 10).alias("prefix"))


@query(O.sql("raw", f"SELECT txn_id, {O.paise('credit')} AS credit, {O.paise('debit')} AS debit FROM raw_bank"))
def money_to_paise(spark, sf_dir):
    return flow.raw(spark, sf_dir, "bank").select("txn_id", S.to_paise(F.col("credit")).alias("credit"), S.to_paise(F.col("debit")).alias("debit"))


@query("""SELECT o_orderkey, (CASE WHEN p < 0 THEN '-' ELSE '' END) || CAST(abs(p) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS rupees
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END AS p FROM orders)""")
def rupees_format(spark, sf_dir):
    p = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(1)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.rupees(p).alias("rupees"))


@query("SELECT o_orderkey, format('{:,}', p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS rupees FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)")
def rupees_thousands(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.rupees_grouped(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("rupees"))


def _gross(spark, sf_dir):
    return flow.sources(spark, sf_dir).invoices.select("invoice_id", "amount")


@query(O.sql("typed", f"SELECT invoice_id, {O.pct('amount', 0.02)} AS fee, {O.pct('amount', 0.05)} AS tds FROM inv"))
def pct_half_up(spark, sf_dir):
    return _gross(spark, sf_dir).select("invoice_id", S.percent_of(F.col("amount"), 0.02).cast("bigint").alias("fee"), S.percent_of(F.col("amount"), 0.05).cast("bigint").alias("tds"))


@query(O.sql("typed", f"SELECT invoice_id, {O.after_fee('amount')} AS net FROM inv"))
def net_after_fee(spark, sf_dir):
    return _gross(spark, sf_dir).select("invoice_id", S.net_after_fee(F.col("amount")).cast("bigint").alias("net"))


@query(O.sql("typed", f"SELECT entity_id, {O.joined_text('list_transform(' + O.plausible('amount', 'net_amount') + ', lambda x: lpad(CAST(x AS VARCHAR), 14, chr(48)))')} AS credits FROM pay"))
def plausible_credits(spark, sf_dir):
    padded = F.transform(S.plausible_credits(F.col("amount"), F.col("net_amount")), lambda x: F.lpad(x.cast("string"), 14, "0"))
    return flow.sources(spark, sf_dir).payments.select("entity_id", _joined(padded).alias("credits"))


@query(O.sql("typed", f"SELECT invoice_id, {O.band('amount')} AS band FROM inv"))
def amount_band(spark, sf_dir):
    return _gross(spark, sf_dir).select("invoice_id", S.amount_band(F.col("amount")).alias("band"))


DIALECTS = ("%d/%m/%y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%d-%b-%Y")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS parsed FROM orders")
def parse_date_dialects(spark, sf_dir):
    patterns = ("dd/MM/yy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy", "dd-MMM-yyyy")
    text = F
    for k, p in enumerate(patterns):
        text = text.when(F.col("o_orderkey") % 7 == k, F.concat(F.lit(" "), F.date_format("o_orderdate", p)))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.parse_date(text.otherwise("no date")).cast("string").alias("parsed"))


@query(O.sql("raw", "SELECT entity_id, CAST(DATE '1970-01-01' + CAST(floor(CAST(settled_at AS BIGINT) / 86400) AS INT) AS VARCHAR) AS settled FROM raw_gateway"))
def unix_to_date(spark, sf_dir):
    return flow.raw(spark, sf_dir, "gateway").select("entity_id", S.unix_to_date(F.col("settled_at")).cast("string").alias("settled"))


@query(O.sql("candidates", "SELECT c.entity_id, c.txn_id, CAST(b.value_date - s.settled_date AS BIGINT) AS days, abs(b.value_date - s.settled_date) <= 3 AS near FROM cand c JOIN pay s ON c.entity_id = s.entity_id JOIN bnk b ON c.txn_id = b.txn_id"))
def date_delta(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    pairs = flow.candidates(spark, sf_dir).join(s.payments.select("entity_id", "settled_date"), "entity_id").join(s.bank.select("txn_id", "value_date"), "txn_id")
    return pairs.select("entity_id", "txn_id", rules.days_apart().cast("bigint").alias("days"), S.within_days(F.col("value_date"), F.col("settled_date"), 3).alias("near"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS VARCHAR) AS later FROM orders")
def shift_days(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9).cast("int")).cast("string").alias("later"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' + d AS BIGINT) AS day FROM orders, range(-3, 4) r(d)")
def day_bucket(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(S.day_bucket(F.to_date("o_orderdate"))).alias("day")).withColumn("day", F.col("day").cast("bigint"))


@query(O.sql("raw", f"SELECT txn_id, {O.joined_text(O.utrs('narration'))} AS utrs FROM raw_bank"))
def extract_utrs(spark, sf_dir):
    return flow.raw(spark, sf_dir, "bank").select("txn_id", _joined(S.extract_utrs(F.col("narration"))).alias("utrs"))


@query(O.sql("raw", f"SELECT DISTINCT customer_name, {O.counterparty('customer_name')} AS counterparty FROM raw_invoices"))
def normalize_counterparty(spark, sf_dir):
    return flow.raw(spark, sf_dir, "invoices").select("customer_name").distinct().select("customer_name", S.normalize_counterparty(F.col("customer_name")).alias("counterparty"))


@query(O.sql("raw", f"SELECT DISTINCT customer_name, {O.name_key('customer_name')} AS name_key FROM raw_invoices"))
def counterparty_key(spark, sf_dir):
    return flow.raw(spark, sf_dir, "invoices").select("customer_name").distinct().select("customer_name", S.counterparty_key(F.col("customer_name")).alias("name_key"))


@query(O.sql("raw", f"SELECT txn_id, {O.normalized('narration')} AS nn FROM raw_bank"))
def normalize_narration(spark, sf_dir):
    return flow.raw(spark, sf_dir, "bank").select("txn_id", S.normalize_narration(F.col("narration")).alias("nn"))


@query(O.sql("typed", f"SELECT txn_id, {O.joined_text('list_distinct(' + O.alphabetic('nn') + ')')} AS tokens FROM bnk"))
def narration_tokens(spark, sf_dir):
    return flow.sources(spark, sf_dir).bank.select("txn_id", _joined("tokens").alias("tokens"))


@query(O.sql("typed", f"SELECT txn_id, {O.joined_text(O.narration_keys('nn'))} AS keys FROM bnk"))
def narration_keys(spark, sf_dir):
    return flow.sources(spark, sf_dir).bank.select("txn_id", _joined(S.narration_keys(F.col("normalized_narration"))).alias("keys"))


@query(O.sql("candidates", "SELECT c.entity_id, c.txn_id, CAST(coalesce(list_min(list_transform(b.utrs, lambda u: levenshtein(u, s.utr))), length(s.utr)) AS BIGINT) AS distance FROM cand c JOIN pay s ON c.entity_id = s.entity_id JOIN bnk b ON c.txn_id = b.txn_id"))
def utr_edit_distance(spark, sf_dir):
    pairs = rules.joined(flow.candidates(spark, sf_dir), flow.sources(spark, sf_dir))
    return pairs.select("entity_id", "txn_id", S.closest_utr_distance(F.col("utr"), F.col("utrs")).cast("bigint").alias("distance"))


@query(O.sql("typed", "SELECT entity_id, substr(sha256(entity_id || chr(0) || settlement_id || chr(0)), 1, 16) AS h FROM pay"))
def row_hash(spark, sf_dir):
    return flow.sources(spark, sf_dir).payments.select("entity_id", S.row_hash(F.col("entity_id"), F.col("settlement_id")).alias("h"))


_KEY_PARTS = ("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, sha256('model' || chr(0) || CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR) || chr(0) || coalesce(role, '') || chr(0) || coalesce(text, '') || chr(0)) AS key FROM conversations")
def cache_key(spark, sf_dir):
    parts = [F.lit("model"), *(F.col(c).cast("string") for c in _KEY_PARTS)]
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", S.sha_of(*parts).alias("key"))


def _pass_sql(name):
    return O.sql("candidates", f"SELECT DISTINCT settlement_id, entity_id, txn_id FROM {name}")


@query(_pass_sql("p_exact"))
def join_exact_amount(spark, sf_dir):
    return blocking.pass_exact(flow.sources(spark, sf_dir)).distinct()


@query(_pass_sql("p_utr"))
def join_utr(spark, sf_dir):
    return blocking.pass_utr(flow.sources(spark, sf_dir)).distinct()


@query(_pass_sql("p_rate"))
def join_rate_amount(spark, sf_dir):
    return blocking.pass_rate(flow.sources(spark, sf_dir)).distinct()


@query(_pass_sql("p_name"))
def join_counterparty_band(spark, sf_dir):
    return blocking.pass_counterparty(flow.sources(spark, sf_dir)).distinct()


@query(O.sql("candidates", "SELECT settlement_id, entity_id, txn_id, array_to_string(passes, '|') AS passes FROM cand"))
def candidates_union(spark, sf_dir):
    return blocking.candidates(flow.sources(spark, sf_dir)).withColumn("passes", F.array_join("passes", "|"))


@query(O.sql("candidates", f"SELECT pass, CAST(sum(h) AS BIGINT) AS hits, {BIG} AS pairs FROM (SELECT pass, entity_id, txn_id, count(*) AS h FROM hit GROUP BY ALL) GROUP BY pass"))
def blocking_stats(spark, sf_dir):
    return blocking.blocking_stats(flow.sources(spark, sf_dir))


@query(O.sql("links", "SELECT entity_id, txn_id, invoice_id FROM named"))
def invoice_candidates(spark, sf_dir):
    return rules.invoice_candidates(flow.best(spark, sf_dir), flow.sources(spark, sf_dir)).select("entity_id", "txn_id", "invoice_id")


@query(O.sql("typed", """SELECT invoice_id, settlement_id, entity_id, txn_id, confidence FROM (SELECT s.invoice_id, s.settlement_id, s.entity_id, b.txn_id,
CAST(CASE WHEN sum(s.net_amount) OVER (PARTITION BY b.txn_id, s.utr) = b.credit THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence FROM pay s JOIN (SELECT txn_id, credit, unnest(utrs) AS u FROM bnk) b ON b.u = s.utr)"""))
def baseline_exact_utr(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    met = s.payments.join(s.bank.select("txn_id", "credit", F.explode("utrs").alias("utr")), "utr")
    total = F.sum("net_amount").over(Window.partitionBy("txn_id", "utr"))
    return met.select("invoice_id", "settlement_id", "entity_id", "txn_id", F.when(total == F.col("credit"), 1.0).otherwise(0.7).alias("confidence"))


@query(O.sql("predicted", "SELECT p.entity_id, p.txn_id, p.invoice_id, CASE WHEN t.txn_id IS NULL THEN 0 ELSE 1 END AS label FROM pred p LEFT JOIN truth t ON p.invoice_id = t.invoice_id AND p.settlement_id = t.settlement_id AND p.txn_id = t.txn_id"))
def label_candidates(spark, sf_dir):
    return labelled(spark, sf_dir).select("entity_id", "txn_id", "invoice_id", "label")


TRIPLE = ["invoice_id", "settlement_id", "txn_id"]


def labelled(spark, sf_dir):
    truth = flow.sources(spark, sf_dir).truth.select(*TRIPLE, F.lit(1).alias("label"))
    return flow.predictions(spark, sf_dir).join(truth, TRIPLE, "left").withColumn("label", F.coalesce("label", F.lit(0)))


@query(O.sql("predicted", f"SELECT {BIG} AS n, CAST(sum(CASE WHEN t.txn_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS positives FROM pred p LEFT JOIN truth t ON p.invoice_id = t.invoice_id AND p.settlement_id = t.settlement_id AND p.txn_id = t.txn_id"))
def dataset_summary(spark, sf_dir):
    return labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("""WITH sent AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0), back AS (SELECT o_orderkey + 3 AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0),
b AS (SELECT id, count(*) AS n FROM back GROUP BY id)
SELECT coalesce(s.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'unexpected' ELSE 'duplicated' END AS verdict FROM sent s FULL OUTER JOIN b ON s.id = b.id WHERE s.id IS NULL OR b.id IS NULL OR b.n > 1""")
def reconcile_ids(spark, sf_dir):
    from ..operators.validation import reconcile_ids as run

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sent = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"))
    back = orders.where("o_orderkey % 4 <> 0").select((F.col("o_orderkey") + 3).alias("id")).unionByName(orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("id")))
    return run(sent, back)


@query(O.sql("scored", "SELECT entity_id, txn_id, rule, rule_score, layer FROM scored"))
def rule_tiers(spark, sf_dir):
    return rules.scored(flow.candidates(spark, sf_dir), flow.sources(spark, sf_dir)).select("entity_id", "txn_id", "rule", "rule_score", "layer")


@query(O.sql("scored", "SELECT entity_id, txn_id, rule, rule_score, penalty FROM best"))
def rule_resolution(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    return rules.best_pairs(rules.scored(blocking.candidates(s), s)).select("entity_id", "txn_id", "rule", "rule_score", "penalty")


@query(O.sql("links", "SELECT entity_id, txn_id, invoice_id, link_score, link_rule FROM linked"))
def invoice_link_scores(spark, sf_dir):
    return rules.link_scores(flow.best(spark, sf_dir), flow.sources(spark, sf_dir)).select("entity_id", "txn_id", "invoice_id", "link_score", "link_rule")


def _features_sql(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


NUMERIC = [n for n in rules.FEATURES if "similarity" not in n]
_NEAR_ANY = lambda xs: f"len(list_filter({xs}, lambda x: abs(credit - x) <= 5)) > 0"
_TDS_LIST = "[" + ", ".join(f"amount - {O.pct('amount', r)}" for r in S.TDS_RATES) + "]"
_SHOWN = "(icp <> '' AND contains(replace(nn, ' ', ''), icp[1:6]))"
# every candidate with the invoice chosen for it, whose name (not the receipt's alone) decides what the narration shows
_FEATURES = f"""
chosen AS (SELECT s.* EXCLUDE (rule, named), l.invoice_id AS link_invoice, l.link_score, l.link_rule, i.amount AS gross, i.invoice_date, coalesce(i.counterparty, '') AS icp FROM pair s LEFT JOIN link l ON s.entity_id = l.entity_id AND s.txn_id = l.txn_id
  LEFT JOIN inv i ON l.invoice_id = i.invoice_id),
rows AS (SELECT c.*, coalesce(f.n, 0) AS often, {_SHOWN} AS named,
  CASE WHEN list_contains(utrs, utr) AND credit = net_amount AND abs(value_date - settled_date) <= 3 THEN 'utr_amount_date' WHEN list_contains(utrs, utr) AND credit = net_amount THEN 'utr_amount'
       WHEN credit = net_amount AND {_SHOWN} AND abs(value_date - settled_date) <= 3 THEN 'exact_amount_counterparty' WHEN abs(credit - {O.after_fee("c.amount")}) <= 5 AND abs(value_date - settled_date) <= 3 THEN 'fee_adjusted'
       WHEN list_contains(utrs, utr) AND abs(credit - net_amount) <= 5 THEN 'utr_amount_tolerance' WHEN list_contains(utrs, utr) THEN 'utr_only' WHEN credit = net_amount AND abs(value_date - settled_date) <= 3 THEN 'exact_amount_date'
       WHEN {_SHOWN} AND abs(value_date - settled_date) <= 3 AND {O.similarity("icp", "nn")} >= 0.55 THEN 'fuzzy_counterparty_date' ELSE 'none' END AS rule
  FROM chosen c LEFT JOIN (SELECT counterparty, count(*) AS n FROM inv WHERE counterparty <> '' GROUP BY counterparty) f ON c.icp = f.counterparty),
feat AS (SELECT entity_id, txn_id, CAST(abs(credit - net_amount) AS DOUBLE) AS amount_delta_abs, CAST(credit - net_amount AS DOUBLE) / abs(CASE WHEN net_amount = 0 THEN 1 ELSE net_amount END) AS amount_delta_pct,
  CAST(credit = net_amount AS DOUBLE) AS amount_exact, CAST(abs(credit - net_amount) <= 5 AS DOUBLE) AS amount_within_tolerance, CAST(value_date - settled_date AS DOUBLE) AS date_delta_days,
  CAST(abs(value_date - settled_date) AS DOUBLE) AS date_delta_abs, CAST(abs(value_date - settled_date) <= 3 AS DOUBLE) AS date_within_window, CAST(list_contains(utrs, utr) AS DOUBLE) AS utr_in_narration,
  CAST(coalesce(list_min(list_transform(utrs, lambda u: levenshtein(u, utr))), length(utr)) AS DOUBLE) AS utr_edit_distance, CAST(named AS DOUBLE) AS counterparty_in_narration, CAST(often AS DOUBLE) AS counterparty_match_frequency,
  CAST(abs(credit - {O.after_fee("amount")}) <= 5 AS DOUBLE) AS delta_matches_fee, CAST({_NEAR_ANY(_TDS_LIST)} AS DOUBLE) AS delta_matches_tds, CAST({_NEAR_ANY(O.plausible("amount", "net_amount"))} AS DOUBLE) AS delta_matches_known_rate,
  CAST(0 AS DOUBLE) AS in_plausible_subset_sum, CAST(len(passes) AS DOUBLE) AS n_blocking_passes, CAST(credit > net_amount AS DOUBLE) AS credit_is_larger, CAST(coalesce(link_rule = 'receipt_given', false) AS DOUBLE) AS invoice_receipt_given,
  coalesce(link_score, 0) AS invoice_link_score, CASE WHEN gross > 0 THEN CAST(amount AS DOUBLE) / gross ELSE 0 END AS invoice_amount_ratio, CAST(coalesce(settled_date - invoice_date, 999) AS DOUBLE) AS invoice_date_delta_days,
  rule, coalesce(link_invoice, '') AS invoice_id, coalesce(link_rule, 'none') AS invoice_rule, array_to_string(passes, '|') AS passes, CAST(settled_date AS VARCHAR) AS settled_date FROM rows)
"""
_ALL_LINKS = O.LINKS.replace("{pairs}", "pair")


def candidate_rows(spark, sf_dir, similarities):
    """Every candidate, with the invoice that its receipt gives or its narration names best, the tier that fits (none: 'none') and features.

    A tier is evidence here, not a gate. Before any assignment, no subset is known, so that feature is 0.
    """
    s = flow.sources(spark, sf_dir)
    pairs = flow.once(spark, sf_dir, "joined", lambda: rules.joined(flow.candidates(spark, sf_dir), s))
    return featured(pairs, flow.once(spark, sf_dir, "candidate-links", lambda: rules.best_links(pairs, s)), s, similarities)


def featured(pairs, links, s, similarities=True):
    links = links.select("entity_id", "txn_id", F.col("invoice_id").alias("link_invoice"), "link_score", "link_rule").join(rules.billed(s, "counterparty", "amount", "invoice_date"), "link_invoice", "left")
    # candidates meet their link and its invoice at once: those without a link would be one heavy key of a join with invoices
    rows = pairs.drop("counterparty", "name_key").join(links, ["entity_id", "txn_id"], "left").withColumn("counterparty", F.coalesce("counterparty", F.lit("")))
    out = rules.features(rows, s, similarities)
    hit = rules.rule_hit(F.col("narration_similarity") if similarities else token_set_ratio("counterparty", "normalized_narration"))
    return out.withColumn("_hit", hit).select("*", F.coalesce("_hit.rule", F.lit("none")).alias("rule"), F.coalesce("_hit.rule_score", F.lit(0.0)).alias("rule_score")).drop("_hit")


def candidate_features(spark, sf_dir):
    return flow.once(spark, sf_dir, "features", lambda: candidate_rows(spark, sf_dir, True))


def _features_out(rows, names):
    return rows.select("entity_id", "txn_id", *[F.round(n, 6).alias(n) for n in names])


@query(O.sql("scored", f"SELECT entity_id, txn_id, {_features_sql(NUMERIC)} FROM feat", _ALL_LINKS, _FEATURES))
def features_numeric(spark, sf_dir):
    return _features_out(candidate_rows(spark, sf_dir, False), NUMERIC)


@query(O.sql("scored", f"SELECT p.entity_id, p.txn_id, round({O.similarity('p.cp', 'p.nn')}, 6) AS similarity FROM pair p"))
def narration_similarity(spark, sf_dir):
    """Of the name that a payment's receipt gives and a candidate's narration."""
    pairs = flow.once(spark, sf_dir, "joined", lambda: rules.joined(flow.candidates(spark, sf_dir), flow.sources(spark, sf_dir)))
    return pairs.select("entity_id", "txn_id", F.round(token_set_ratio("counterparty", "normalized_narration"), 6).alias("similarity"))


@query()
def features_similarity(spark, sf_dir):
    return _features_out(candidate_features(spark, sf_dir), ["narration_similarity", "narration_partial_similarity"])


@query()
def export_with_similarity(spark, sf_dir):
    """Every candidate with all 23 features, of which SQL lacks the partial similarity."""
    rows = candidate_features(spark, sf_dir)
    return rows.select("entity_id", "settlement_id", "txn_id", F.coalesce("link_invoice", F.lit("")).alias("invoice_id"), "rule", "rule_score", *rules.FEATURES)


@query(O.sql("scored", f"SELECT entity_id, txn_id, rule, invoice_id, invoice_rule, passes, settled_date, {_features_sql(NUMERIC)} FROM feat", _ALL_LINKS, _FEATURES))
def export_candidates(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir, False)
    return rows.select("entity_id", "txn_id", "rule", F.coalesce("link_invoice", F.lit("")).alias("invoice_id"), F.coalesce("link_rule", F.lit("none")).alias("invoice_rule"), F.array_join("passes", "|").alias("passes"), F.col("settled_date").cast("string").alias("settled_date"), *[F.round(n, 6).alias(n) for n in NUMERIC])


@query(O.sql("typed", f"SELECT counterparty, {BIG} AS n FROM inv WHERE counterparty <> '' GROUP BY counterparty"))
def counterparty_frequencies(spark, sf_dir):
    return flow.sources(spark, sf_dir).invoices.where("counterparty <> ''").groupBy("counterparty").agg(F.count("*").alias("n"))


@query(O.sql("resolved", "SELECT entity_id, invoice_id, link_rule FROM pick"))
def invoice_resolution(spark, sf_dir):
    return flow.resolved(spark, sf_dir).select("entity_id", "invoice_id", "link_rule")


_EDGES = "SELECT s.entity_id, l.invoice_id, s.txn_id, round(s.rule_score * l.link_score, 4) AS p, s.penalty, s.rule_score, l.link_score FROM scored s JOIN link l ON s.entity_id = l.entity_id AND s.txn_id = l.txn_id"
_SCORED_LINKS = O.LINKS.replace("{pairs}", "scored")


@query("WITH " + ",".join([O.STEPS["raw"], O.STEPS["typed"], O.STEPS["candidates"], O.STEPS["scored"], _SCORED_LINKS, O.greedy(_EDGES, "entity_id", "invoice_id", "p DESC, penalty, rule_score DESC, link_score DESC, entity_id, txn_id, invoice_id")]) + f" SELECT entity_id, invoice_id, txn_id, p FROM ({O.taken('entity_id, invoice_id, txn_id, p')})")
def greedy_one_to_one(spark, sf_dir):
    return matching.assigned(probability_edges(spark, sf_dir)).select("entity_id", "invoice_id", "txn_id", "p")


_PARTS = {"date proximity": "penalty", "rule tier": "rule_score", "invoice link strength": "link_score", "entity id": "entity_id", "transaction id": "txn_id"}
_RIVALS = "taken AS (" + O.taken("*").replace("e12", "(SELECT *, 1 AS rl, 1 AS rr FROM e12)") + """),
tied AS (SELECT e.* FROM e0 e JOIN (SELECT invoice_id, max(p) AS p FROM e0 GROUP BY invoice_id) b ON e.invoice_id = b.invoice_id AND e.p = b.p),
rival AS (SELECT r.*, count(*) OVER (PARTITION BY r.invoice_id) AS n, row_number() OVER (PARTITION BY r.invoice_id ORDER BY r.penalty, r.rule_score DESC, r.link_score DESC, r.entity_id, r.txn_id) AS nth
  FROM tied r JOIN taken t ON r.invoice_id = t.invoice_id AND r.entity_id <> t.entity_id)"""
_DECIDED = "CASE WHEN r.n IS NULL THEN '' " + " ".join(f"WHEN t.{c} <> r.{c} THEN '{name}'" for name, c in _PARTS.items()) + " ELSE 'identical on every component' END"


@query("WITH " + ",".join([O.STEPS["raw"], O.STEPS["typed"], O.STEPS["candidates"], O.STEPS["scored"], _SCORED_LINKS, O.greedy(_EDGES, "entity_id", "invoice_id", "p DESC, penalty, rule_score DESC, link_score DESC, entity_id, txn_id, invoice_id"), _RIVALS])
       + f" SELECT t.entity_id, t.invoice_id, t.txn_id, t.p, coalesce(r.n, 0) AS rivals, {_DECIDED} AS decided_by FROM taken t LEFT JOIN (SELECT * FROM rival WHERE nth = 1) r ON t.invoice_id = r.invoice_id")
def assignment_ties(spark, sf_dir):
    """Each taken edge with its rivals for the invoice and what decided between them."""
    return matching.assigned(probability_edges(spark, sf_dir)).select("entity_id", "invoice_id", "txn_id", "p", "rivals", "decided_by")


def probability_edges(spark, sf_dir):
    hits = flow.scored(spark, sf_dir)
    links = flow.once(spark, sf_dir, "all-links", lambda: rules.best_links(hits, flow.sources(spark, sf_dir)))
    met = links.drop("settlement_id").join(hits.select("entity_id", "txn_id", "rule_score", "penalty"), ["entity_id", "txn_id"])
    return met.select("entity_id", "invoice_id", "txn_id", F.round(F.col("rule_score") * F.col("link_score"), 4).alias("p"), "penalty", "rule_score", "link_score")


_TIE = """SELECT entity_id, CASE WHEN rival IS NULL THEN 'only candidate' WHEN p <> p2 THEN 'probability' WHEN penalty <> penalty2 THEN 'date proximity' WHEN rule_score <> rule2 THEN 'rule tier' WHEN link_score <> link2 THEN 'invoice link'
ELSE 'identical on every component' END AS decided_by FROM (SELECT *, lead(txn_id) OVER w AS rival, lead(p) OVER w AS p2, lead(penalty) OVER w AS penalty2, lead(rule_score) OVER w AS rule2, lead(link_score) OVER w AS link2, row_number() OVER w AS n
FROM edges WINDOW w AS (PARTITION BY entity_id ORDER BY p DESC, penalty, rule_score DESC, link_score DESC, txn_id, invoice_id)) WHERE n = 1"""


@query("WITH " + ",".join([O.STEPS["raw"], O.STEPS["typed"], O.STEPS["candidates"], O.STEPS["scored"], _SCORED_LINKS, f"edges AS ({_EDGES})"]) + _TIE)
def tiebreak_reason(spark, sf_dir):
    w = Window.partitionBy("entity_id").orderBy(F.desc("p"), "penalty", F.desc("rule_score"), F.desc("link_score"), "txn_id", "invoice_id")
    e = probability_edges(spark, sf_dir).select("*", F.row_number().over(w).alias("n"), *[F.lead(c).over(w).alias(f"{c}_2") for c in ("txn_id", "p", "penalty", "rule_score", "link_score")])
    differs = lambda c, name: F.when(F.col(c) != F.col(f"{c}_2"), name)
    reason = F.coalesce(F.when(F.col("txn_id_2").isNull(), "only candidate"), differs("p", "probability"), differs("penalty", "date proximity"), differs("rule_score", "rule tier"), differs("link_score", "invoice link"), F.lit("identical on every component"))
    return e.where("n = 1").select("entity_id", reason.alias("decided_by"))
