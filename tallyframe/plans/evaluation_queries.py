"""Queries on subset sums, accounting, evaluation, calibration, operating points and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import fresh_path, stored
from ..operators import accounting as A
from ..operators import calibration as C
from ..operators import blocking, chaos, cost, matching, rules, subsetsum
from ..operators import evaluation as E
from . import flow
from . import oracle as O
from .matching_queries import BIG, candidate_features, labelled
from .registry import query

THRESHOLD = 0.9

# ---- subset sums: the strict exact tiers claim first, so batches stay open
_OPEN = """
claimed AS (SELECT entity_id FROM best WHERE rule = 'utr_amount_date'),
free AS (SELECT pay.* FROM pay ANTI JOIN claimed ON pay.entity_id = claimed.entity_id),
bucket AS (SELECT settlement_id, count(*) AS members, min_by(settled_date, entity_id) AS anchor FROM free GROUP BY settlement_id HAVING count(*) >= 2),
member AS (SELECT f.settlement_id, f.entity_id, f.net_amount FROM free f JOIN bucket b ON f.settlement_id = b.settlement_id),
probe AS (SELECT b.settlement_id, b.members, k.txn_id, k.credit, k.value_date FROM bucket b JOIN bnk k ON k.credit > 0 AND abs(k.value_date - b.anchor) <= 3)
"""
_SUBSETS = """
two AS (SELECT a.settlement_id, p.txn_id, a.entity_id || '|' || b.entity_id AS subset FROM member a JOIN member b ON a.settlement_id = b.settlement_id AND a.entity_id < b.entity_id
  JOIN probe p ON p.settlement_id = a.settlement_id AND p.members <= 25 AND abs(p.credit - a.net_amount - b.net_amount) <= 5),
three AS (SELECT a.settlement_id, p.txn_id, a.entity_id || '|' || b.entity_id || '|' || c.entity_id AS subset FROM member a JOIN member b ON a.settlement_id = b.settlement_id AND a.entity_id < b.entity_id
  JOIN member c ON c.settlement_id = a.settlement_id AND b.entity_id < c.entity_id JOIN probe p ON p.settlement_id = a.settlement_id AND p.members <= 25 AND abs(p.credit - a.net_amount - b.net_amount - c.net_amount) <= 5)
"""


def claimed(spark, sf_dir):
    """Payments whose best pair is of the tier utr_amount_date."""
    return flow.claimed(spark, sf_dir)


@query(O.sql("scored", "SELECT * FROM two UNION ALL SELECT * FROM three", _OPEN, _SUBSETS))
def subset_sum_pairs(spark, sf_dir):
    return subsetsum.small_subsets(flow.sources(spark, sf_dir), claimed(spark, sf_dir))


_SIZES = "".join(f"""size{k} AS (SELECT a1.settlement_id, [{", ".join(f"a{i}.entity_id" for i in range(1, k + 1))}] AS ids, {" + ".join(f"a{i}.net_amount" for i in range(1, k + 1))} AS total FROM member a1
  {" ".join(f"JOIN member a{i} ON a{i}.settlement_id = a1.settlement_id AND a{i - 1}.entity_id < a{i}.entity_id" for i in range(2, k + 1))}),
""" for k in range(2, 6)) + """sums AS (SELECT * FROM size2 UNION ALL SELECT * FROM size3 UNION ALL SELECT * FROM size4 UNION ALL SELECT * FROM size5),
nth_sum AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY len(ids), ids) AS nth, count(*) OVER (PARTITION BY settlement_id) AS n_sums FROM sums),
call AS (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY value_date, txn_id) AS place FROM probe),
fits AS (SELECT p.settlement_id, p.txn_id, p.place, s.nth, s.ids, row_number() OVER (PARTITION BY p.settlement_id ORDER BY p.place, s.nth) AS n FROM call p JOIN nth_sum s ON p.settlement_id = s.settlement_id AND p.members <= 25 AND abs(p.credit - s.total) <= 5)
"""


@query(O.sql("scored", "SELECT settlement_id, txn_id, array_to_string(ids, '|') AS subset FROM fits WHERE n = 1", _OPEN, _SIZES))
def subset_sum_search(spark, sf_dir):
    return subsetsum.subsets(flow.sources(spark, sf_dir), claimed(spark, sf_dir))


@query(O.sql("scored", f"SELECT settlement_id, CAST(members AS BIGINT) AS members, members > 25 AS capped, {BIG} AS probes FROM probe GROUP BY settlement_id, members", _OPEN))
def subset_sum_capped(spark, sf_dir):
    near = subsetsum.targets(flow.sources(spark, sf_dir), claimed(spark, sf_dir))
    return near.select("settlement_id", "members", F.col("targets").alias("probes"), (F.col("members") > subsetsum.MOST_BUCKET).alias("capped"))


@query(O.sql("scored", """SELECT searched, skipped, round(CAST(skipped AS DOUBLE) / (searched + skipped), 6) AS rate, examined, found, settlements_capped FROM (
SELECT CAST(coalesce(sum(calls) FILTER (WHERE members <= 25), 0) AS BIGINT) AS searched, CAST(coalesce(sum(calls) FILTER (WHERE members > 25), 0) AS BIGINT) AS skipped, CAST(coalesce(sum(calls * members) FILTER (WHERE members > 25), 0) AS BIGINT) AS settlements_capped,
CAST(coalesce(sum(CASE WHEN nth IS NULL THEN calls * n_sums ELSE (calls - 1) * n_sums + nth END) FILTER (WHERE members <= 25), 0) AS BIGINT) AS examined, CAST(count(nth) AS BIGINT) AS found
FROM (SELECT c.settlement_id, c.members, max(f.nth) AS nth, coalesce(max(f.place), count(*)) AS calls, max(n_sums) AS n_sums FROM call c LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON c.settlement_id = f.settlement_id
LEFT JOIN (SELECT settlement_id, max(n_sums) AS n_sums FROM nth_sum GROUP BY 1) s ON c.settlement_id = s.settlement_id GROUP BY c.settlement_id, c.members))""", _OPEN, _SIZES))
def subset_sum_stats(spark, sf_dir):
    """A bucket is searched for one credit after another until one is explained."""
    return subsetsum.search_stats(flow.sources(spark, sf_dir), claimed(spark, sf_dir))


# ---- accounting: an invoice is held by its best prediction
_EVIDENCE = """
held AS (SELECT invoice_id, entity_id AS holder FROM pred QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY confidence DESC, entity_id) = 1),
matched AS (SELECT p.* FROM pred p JOIN held h ON p.invoice_id = h.invoice_id AND p.entity_id = h.holder WHERE p.confidence >= 0.9),
ranked AS (SELECT entity_id, txn_id, rule_score, count(*) OVER (PARTITION BY entity_id) AS n_candidates, lead(rule_score) OVER w AS second, row_number() OVER w AS n FROM scored WINDOW w AS (PARTITION BY entity_id ORDER BY rule_score DESC, penalty, txn_id)),
evid AS (SELECT r.entity_id, CAST(r.n_candidates AS BIGINT) AS n_candidates, r.rule_score AS best_score, coalesce(r.second, 0) AS second_score, r.txn_id AS best_txn_id, coalesce(l.invoice_id, '') AS best_invoice_id,
  CASE WHEN h.holder <> r.entity_id THEN h.holder ELSE '' END AS claimed_by FROM ranked r LEFT JOIN link l ON r.entity_id = l.entity_id AND r.txn_id = l.txn_id LEFT JOIN held h ON l.invoice_id = h.invoice_id WHERE r.n = 1),
capped AS (SELECT entity_id FROM (SELECT p.entity_id, count(*) OVER (PARTITION BY p.settlement_id) AS members FROM pay p ANTI JOIN best b ON p.entity_id = b.entity_id) WHERE members > 25),
exc AS (SELECT p.entity_id, p.net_amount AS amount, coalesce(e.best_txn_id, '') AS txn_id, coalesce(e.best_invoice_id, '') AS invoice_id, e.best_score AS confidence,
  CASE WHEN c.entity_id IS NOT NULL THEN 'SUBSET_SEARCH_CAPPED' WHEN coalesce(e.n_candidates, 0) = 0 THEN 'NO_CANDIDATE' WHEN e.claimed_by <> '' THEN 'INVOICE_ALREADY_CLAIMED' WHEN e.best_invoice_id = '' THEN 'NO_INVOICE_LINK'
       WHEN e.n_candidates > 1 AND e.best_score - e.second_score < 0.02 THEN 'AMBIGUOUS_CANDIDATES' ELSE 'BELOW_THRESHOLD' END AS reason_code
  FROM (SELECT pay.* FROM pay ANTI JOIN matched ON pay.entity_id = matched.entity_id) p LEFT JOIN evid e ON p.entity_id = e.entity_id LEFT JOIN capped c ON p.entity_id = c.entity_id),
codes AS (SELECT reason_code, CASE WHEN reason_code IN ('BELOW_THRESHOLD', 'LOW_CONFIDENCE', 'AMBIGUOUS_CANDIDATES') THEN 'judgement' WHEN reason_code LIKE 'LLM%' OR reason_code IN ('FIELD_PROVENANCE_FAILED', 'LOW_PARSE_CONFIDENCE') THEN 'failure' ELSE 'deterministic' END AS family, CAST(n AS BIGINT) AS n
  FROM (SELECT reason_code, count(*) AS n FROM exc GROUP BY reason_code))
"""


def held(spark, sf_dir):
    w = Window.partitionBy("invoice_id").orderBy(F.desc("confidence"), "entity_id")
    return flow.predictions(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("invoice_id", F.col("entity_id").alias("holder"))


def matched(spark, sf_dir):
    own = held(spark, sf_dir).withColumnRenamed("holder", "entity_id")
    return flow.predictions(spark, sf_dir).join(own, ["invoice_id", "entity_id"], "left_semi").where(F.col("confidence") >= THRESHOLD)


def evidence(spark, sf_dir):
    hits = flow.scored(spark, sf_dir).select("entity_id", "txn_id", F.col("rule_score").alias("score"), "penalty")
    return A.evidence(hits, flow.links(spark, sf_dir), held(spark, sf_dir))


def exceptions(spark, sf_dir):
    # evidence comes first: it writes all scored pairs, which hold the best ones
    make = lambda: A.exceptions(found=evidence(spark, sf_dir), payments=flow.sources(spark, sf_dir).payments, matched=matched(spark, sf_dir), capped=subsetsum.capped(flow.sources(spark, sf_dir), flow.best(spark, sf_dir)), threshold=THRESHOLD)
    return flow.once(spark, sf_dir, "exceptions", make)


def _acc(select):
    return O.sql("predicted", select, _EVIDENCE)


@query(_acc("SELECT *, round(best_score - second_score, 6) AS margin, n_candidates > 1 AND best_score - second_score < 0.02 AS ambiguous FROM evid"))
def settlement_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).withColumns({"margin": F.round(A.margin(), 6), "ambiguous": A.is_ambiguous()})


@query(_acc("SELECT entity_id, reason_code, txn_id, invoice_id, confidence, amount FROM exc"))
def exception_reasons(spark, sf_dir):
    return exceptions(spark, sf_dir).drop("detail")


@query(_acc("SELECT reason_code, n FROM codes"))
def exceptions_by_reason(spark, sf_dir):
    return exceptions(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("n"))


@query(_acc("SELECT round(sum(CASE WHEN family <> 'judgement' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share, CAST(sum(CASE WHEN family <> 'judgement' THEN n ELSE 0 END) AS BIGINT) AS deterministic FROM codes"))
def deterministic_share(spark, sf_dir):
    free = F.when(A.family() != "judgement", 1).otherwise(0)
    return exceptions(spark, sf_dir).agg(F.round(F.avg(free), 6).alias("share"), F.sum(free).alias("deterministic"))


@query(_acc("SELECT family, CAST(sum(n) AS BIGINT) AS n FROM codes GROUP BY family"))
def exceptions_by_family(spark, sf_dir):
    return exceptions(spark, sf_dir).groupBy(A.family().alias("family")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{f}')" for c, f in A.FAMILIES.items()) + ") t(reason_code, family)")
def reason_dimension(spark, sf_dir):
    return spark.createDataFrame(list(A.FAMILIES.items()), "reason_code string, family string")


@query(_acc(f"SELECT (SELECT {BIG} FROM pay) AS n_settlements, (SELECT {BIG} FROM matched) AS n_matched, (SELECT {BIG} FROM exc) AS n_exceptions, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM codes WHERE family = 'judgement') AS n_judgement"))
def reconcile_accounting(spark, sf_dir):
    count = lambda df, name: df.agg(F.count("*").alias(name))
    e = exceptions(spark, sf_dir)
    parts = [count(flow.sources(spark, sf_dir).payments, "n_settlements"), count(matched(spark, sf_dir), "n_matched"), count(e, "n_exceptions"), count(e.where(A.family() == "judgement"), "n_judgement")]
    return parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # one row each


_BATCHED = """taken AS (SELECT settlement_id, txn_id, unnest(ids) AS entity_id FROM fits WHERE n = 1),
both_ways AS (SELECT settlement_id, entity_id, txn_id, invoice_id, amount, settled_date, nn, rule, rule_score FROM best UNION ALL
  SELECT t.settlement_id, t.entity_id, t.txn_id, p.invoice_id, p.amount, p.settled_date, b.nn, 'subset_sum', CAST(0.8 AS DOUBLE) FROM taken t JOIN pay p ON t.entity_id = p.entity_id JOIN bnk b ON t.txn_id = b.txn_id)"""


_MATCHES = "matches AS (SELECT l.entity_id, l.invoice_id, l.txn_id, b.rule || '+' || l.link_rule AS rule, round(b.rule_score * l.link_score, 4) AS confidence FROM both_ways b JOIN pick l ON b.entity_id = l.entity_id AND b.txn_id = l.txn_id)"


def _rules_sql(select, *more):
    return O.sql("scored", select, _OPEN.replace(" WHERE rule = 'utr_amount_date'", ""), _SIZES, _BATCHED, O.LINKS.replace("{pairs}", "both_ways"), O.resolved("both_ways"), _MATCHES, *more)


def _rules_run(s, best):
    """(matched pairs, their links) of the rules' flow, from each payment's best pair; an invoice goes to one payment."""
    pairs = flow.with_batched(best, s)
    return pairs, stored(matching.resolved_links(pairs, s), "resolved")


@query(_rules_sql("SELECT * FROM matches"))
def reconcile_rules(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    pairs = flow.with_batched(rules.deciding_pairs(s), s)
    return flow.matched(pairs, s).select("entity_id", "invoice_id", "txn_id", F.concat_ws("+", "rule", "link_rule").alias("rule"), "confidence")


@query(_rules_sql("""SELECT p.entity_id, CASE WHEN m.entity_id IS NULL THEN 'exception' ELSE 'matched' END AS outcome, CASE WHEN m.entity_id IS NOT NULL THEN '' WHEN c.entity_id IS NOT NULL THEN 'SUBSET_SEARCH_CAPPED' WHEN e.n IS NULL THEN 'NO_CANDIDATE'
WHEN l.invoice_id IS NULL THEN 'NO_INVOICE_LINK' WHEN e.n > 1 AND e.score - e.second < 0.02 THEN 'AMBIGUOUS_CANDIDATES' ELSE 'LOW_CONFIDENCE' END AS reason_code, coalesce(m.txn_id, e.txn_id, '') AS txn_id, coalesce(m.invoice_id, l.invoice_id, '') AS invoice_id, coalesce(m.confidence, e.score) AS confidence
FROM pay p LEFT JOIN matches m ON p.entity_id = m.entity_id LEFT JOIN (SELECT * FROM option WHERE nth = 1) e ON p.entity_id = e.entity_id LEFT JOIN pick l ON p.entity_id = l.entity_id
LEFT JOIN (SELECT f.entity_id FROM free f JOIN bucket b ON f.settlement_id = b.settlement_id WHERE b.members > 25) c ON p.entity_id = c.entity_id""",
"""option AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS nth, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT c.entity_id, c.txn_id, coalesce(s.rule_score, 0) AS score, abs(k.value_date - q.settled_date) AS far
FROM cand c JOIN bnk k ON c.txn_id = k.txn_id JOIN pay q ON c.entity_id = q.entity_id LEFT JOIN scored s ON c.entity_id = s.entity_id AND c.txn_id = s.txn_id) WINDOW w AS (PARTITION BY entity_id ORDER BY score DESC, CASE WHEN score > 0 THEN far ELSE 0 END, txn_id))"""))
def rules_outcome(spark, sf_dir):
    """Every payment once: matched by the rules, or an exception with its reason. Candidates that no tier fits are evidence too, at score 0."""
    s = flow.sources(spark, sf_dir)
    found = stored(blocking.candidates(s), "candidates")
    hits = stored(rules.placed(rules.scored(found, s)), "scored")
    best = hits.where("place = 1").drop("place")
    pairs, linked = _rules_run(s, best)
    good = flow.predicted(pairs, linked)
    options = found.select("entity_id", "txn_id").join(hits.select("entity_id", "txn_id", "rule_score", "penalty"), ["entity_id", "txn_id"], "left").select("entity_id", "txn_id", F.coalesce("rule_score", F.lit(0.0)).alias("score"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
    own = linked.select("entity_id", "invoice_id").distinct()
    seen = A.evidence(options, options.join(own, "entity_id").select("entity_id", "txn_id", "invoice_id"), linked.select("invoice_id", F.col("entity_id").alias("holder")).limit(0))
    rest = A.exceptions(s.payments, good, seen, subsetsum.capped(s, best))
    out = good.select("entity_id", F.lit("matched").alias("outcome"), F.lit("").alias("reason_code"), "txn_id", "invoice_id", "confidence")
    return out.unionByName(rest.select("entity_id", F.lit("exception").alias("outcome"), "reason_code", "txn_id", "invoice_id", "confidence"))


@query(_rules_sql("SELECT entity_id, txn_id, rule, CAST(rule LIKE 'subset_sum%' AS DOUBLE) AS in_plausible_subset_sum, CAST(amount_exact AS DOUBLE) AS amount_exact, CAST(n_passes AS DOUBLE) AS n_blocking_passes FROM (SELECT m.*, k.credit = p.net_amount AS amount_exact, CASE WHEN rule LIKE 'subset_sum%' THEN 1 ELSE len(c.passes) END AS n_passes FROM matches m JOIN pay p ON m.entity_id = p.entity_id JOIN bnk k ON m.txn_id = k.txn_id LEFT JOIN cand c ON m.entity_id = c.entity_id AND m.txn_id = c.txn_id)"))
def rules_features(spark, sf_dir):
    """Features of the rules' matches; payments of a batch that adds up to a credit are marked."""
    s = flow.sources(spark, sf_dir)
    pairs, linked = _rules_run(s, stored(rules.best_pairs(rules.scored(blocking.candidates(s), s)), "best"))
    rows = pairs.drop("invoice_id").join(linked.select("entity_id", "txn_id", F.col("invoice_id").alias("link_invoice"), "link_score", "link_rule"), ["entity_id", "txn_id"])
    rows = rows.withColumns({"in_subset_sum": F.col("rule") == "subset_sum", "passes": F.when(F.col("rule") == "subset_sum", F.array(F.lit("subset_sum"))).otherwise(F.col("passes"))})
    return rules.features(rows, s, similarities=False).select("entity_id", "txn_id", F.concat_ws("+", "rule", "link_rule").alias("rule"), "in_plausible_subset_sum", "amount_exact", "n_blocking_passes")


@query(_acc("SELECT e.entity_id, e.reason_code, s.net_amount, coalesce(b.credit, 0) AS credit, coalesce(b.narration, '') AS narration, coalesce(i.amount, 0) AS billed, coalesce(b.credit, 0) - s.net_amount AS difference FROM exc e JOIN setl s ON e.entity_id = s.entity_id LEFT JOIN bnk b ON e.txn_id = b.txn_id LEFT JOIN inv i ON e.invoice_id = i.invoice_id"))
def exception_evidence(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    e = exceptions(spark, sf_dir).select("entity_id", "reason_code", "txn_id", "invoice_id").join(s.settlements.select("entity_id", "net_amount"), "entity_id")
    e = e.join(s.bank.select("txn_id", "credit", "narration"), "txn_id", "left").join(s.invoices.select("invoice_id", F.col("amount").alias("billed")), "invoice_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return e.select("entity_id", "reason_code", "net_amount", zero("credit").alias("credit"), F.coalesce("narration", F.lit("")).alias("narration"), zero("billed").alias("billed"), (zero("credit") - F.col("net_amount")).alias("difference"))


@query(_acc("SELECT entity_id, amount, txn_id FROM exc WHERE reason_code = 'NO_INVOICE_LINK' ORDER BY amount DESC, entity_id LIMIT 20 OFFSET 20"))
def exceptions_page(spark, sf_dir):
    return exceptions(spark, sf_dir).where("reason_code = 'NO_INVOICE_LINK'").orderBy(F.desc("amount"), "entity_id").offset(20).limit(20).select("entity_id", "amount", "txn_id")


@query(_acc("SELECT reason_code, family, n, CAST(row_number() OVER (ORDER BY n DESC, reason_code) AS INT) AS place FROM codes"))
def reason_breakdown(spark, sf_dir):
    out = exceptions_by_reason(spark, sf_dir).withColumn("family", A.family())
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason_code")))  # one row a code


# ---- evaluation
_JUDGED = f"""
judged AS (SELECT p.*, CASE WHEN t.txn_id IS NULL THEN 0 ELSE 1 END AS ok, coalesce(i.amount, b.credit, 0) AS money FROM (SELECT invoice_id, settlement_id, txn_id, max(confidence) AS confidence FROM pred GROUP BY ALL) p
  LEFT JOIN (SELECT DISTINCT * FROM truth WHERE case_type <> 'orphan') t ON p.invoice_id = t.invoice_id AND p.settlement_id = t.settlement_id AND p.txn_id = t.txn_id LEFT JOIN inv i ON p.invoice_id = i.invoice_id LEFT JOIN bnk b ON p.txn_id = b.txn_id),
tot AS (SELECT count(*) FILTER (WHERE case_type <> 'orphan') AS n_decidable, sum(i.amount) FILTER (WHERE case_type <> 'orphan') AS total_money, count(DISTINCT txn_id) FILTER (WHERE case_type = 'orphan') AS n_orphans FROM truth t LEFT JOIN inv i ON t.invoice_id = i.invoice_id),
points AS (SELECT threshold, n_predicted, n_true, matched_money, wrong_money, CAST(n_predicted AS DOUBLE) / n_decidable AS coverage, CAST(n_true AS DOUBLE) / n_predicted AS precision, CAST(n_true AS DOUBLE) / n_decidable AS recall,
  1 - CAST(wrong_money AS DOUBLE) / matched_money AS money_precision, CAST(wrong_money AS DOUBLE) / total_money AS money_error FROM (SELECT d.threshold, {BIG} AS n_predicted, CAST(sum(ok) AS BIGINT) AS n_true, CAST(sum(money) AS BIGINT) AS matched_money,
  CAST(sum((1 - ok) * money) AS BIGINT) AS wrong_money FROM (SELECT DISTINCT confidence AS threshold FROM judged) d JOIN judged j ON j.confidence >= d.threshold GROUP BY d.threshold), tot)
"""
_RATES = ("coverage", "precision", "recall", "money_precision", "money_error")


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _ev(select, *more):
    return O.sql("predicted", select, _JUDGED, *more)


def judged(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    return flow.once(spark, sf_dir, "judged", lambda: E.judged(flow.predictions(spark, sf_dir), s.truth, s.invoices, s.bank))


def points(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    return E.curve(judged(spark, sf_dir), s.truth, s.invoices)


def _wilson_sql(k, n):
    z = "1.96::DOUBLE"
    p = f"({k} / {n}::DOUBLE)"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n}))"
    return f"greatest(0.0::DOUBLE, ({p} + {z} * {z} / (2 * {n}) - {spread}) / (1 + {z} * {z} / {n}))", f"least(1.0::DOUBLE, ({p} + {z} * {z} / (2 * {n}) + {spread}) / (1 + {z} * {z} / {n}))"


@query(f"SELECT lang, {BIG} AS n, round({_wilson_sql('k', 'n')[0]}, 6) AS low, round({_wilson_sql('k', 'n')[1]}, 6) AS high FROM (SELECT d.lang, count(*) AS n, sum(quality) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang) GROUP BY lang, n, k".replace(f"{BIG} AS n", "CAST(n AS BIGINT) AS n"))
def wilson_interval(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "lang").join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(O.sql("raw", f"SELECT case_type <> 'orphan' AS decidable, {BIG} AS n FROM raw_truth GROUP BY 1"))
def truth_partition(spark, sf_dir):
    return flow.sources(spark, sf_dir).truth.groupBy((F.col("case_type") != "orphan").alias("decidable")).agg(F.count("*").alias("n"))


@query(_ev(f"""SELECT CAST(n_decidable AS BIGINT) AS n_decidable, n_predicted, n_true, n_predicted - n_true AS n_false, CAST(total_money AS BIGINT) AS total_money, matched_money, wrong_money, CAST(n_orphans AS BIGINT) AS n_orphans, n_refused,
round(CASE WHEN n_orphans > 0 THEN CAST(n_refused AS DOUBLE) / n_orphans ELSE 1 END, 6) AS refusal, round(CAST(n_predicted AS DOUBLE) / n_decidable, 6) AS coverage, round(CAST(n_true AS DOUBLE) / n_predicted, 6) AS precision, round(CAST(n_true AS DOUBLE) / n_decidable, 6) AS recall,
round(1 - CAST(wrong_money AS DOUBLE) / matched_money, 6) AS money_precision, round(CAST(wrong_money AS DOUBLE) / total_money, 6) AS money_error FROM tot, (SELECT {BIG} AS n_predicted, CAST(sum(ok) AS BIGINT) AS n_true, CAST(sum(money) AS BIGINT) AS matched_money, CAST(sum((1 - ok) * money) AS BIGINT) AS wrong_money FROM judged WHERE confidence >= 0.9),
(SELECT CAST(count(DISTINCT txn_id) AS BIGINT) AS n_refused FROM truth WHERE case_type = 'orphan' AND txn_id NOT IN (SELECT txn_id FROM judged WHERE confidence >= 0.9))"""))
def score_at_threshold(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    row = E.score_at(judged(spark, sf_dir), s.truth, s.invoices, THRESHOLD)
    return row.withColumns({c: F.round(c, 6) for c in (*_RATES, "refusal")})


@query(_ev("""SELECT t.case_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE NOT m AND t.case_type <> 'orphan') AS BIGINT) AS missed, CAST(count(*) FILTER (WHERE NOT m AND t.case_type = 'orphan') AS BIGINT) AS refused,
t.case_type IN ('tds_deducted', 'refund_netted') AS held_out FROM (SELECT t.*, CASE WHEN case_type = 'orphan' THEN txn_id IN (SELECT txn_id FROM judged WHERE confidence >= 0.9) ELSE EXISTS (SELECT 1 FROM judged j WHERE j.confidence >= 0.9 AND j.invoice_id = t.invoice_id AND j.settlement_id = t.settlement_id AND j.txn_id = t.txn_id) END AS m FROM truth t) t GROUP BY t.case_type"""))
def confusion_by_case_type(spark, sf_dir):
    return E.confusion(judged(spark, sf_dir), flow.sources(spark, sf_dir).truth, THRESHOLD)


@query(_ev(f"SELECT threshold, n_predicted, n_true, matched_money, wrong_money, {_rounded(_RATES)} FROM points"))
def risk_coverage_curve(spark, sf_dir):
    return points(spark, sf_dir).select("threshold", "n_predicted", "n_true", "matched_money", "wrong_money", *[F.round(c, 6).alias(c) for c in _RATES])


@query(_ev(f"SELECT threshold, n_predicted, n_true, matched_money, wrong_money, {_rounded(_RATES)} FROM points"))
def curve_stored(spark, sf_dir):
    path = fresh_path(spark, "curve")
    E.save_curve(points(spark, sf_dir), path)
    return E.load_curve(spark, path).select("threshold", "n_predicted", "n_true", "matched_money", "wrong_money", *[F.round(c, 6).alias(c) for c in _RATES])


@query(_ev("SELECT count(DISTINCT round(coverage, 6)) <= 1 AS degenerate FROM points"))
def curve_degenerate(spark, sf_dir):
    return points(spark, sf_dir).agg((F.countDistinct(F.round("coverage", 6)) <= 1).alias("degenerate"))


@query(_ev("SELECT threshold, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM points WHERE coverage >= 0.5 ORDER BY points.precision DESC, points.coverage DESC, threshold DESC LIMIT 1"))
def curve_at_coverage(spark, sf_dir):
    return points(spark, sf_dir).where("coverage >= 0.5").orderBy(F.desc("precision"), F.desc("coverage"), F.desc("threshold")).limit(1).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(_ev("SELECT threshold, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM points WHERE precision >= 0.9 ORDER BY points.coverage DESC, points.precision DESC, threshold DESC LIMIT 1"))
def curve_best_at_precision(spark, sf_dir):
    return points(spark, sf_dir).where("precision >= 0.9").orderBy(F.desc("coverage"), F.desc("precision"), F.desc("threshold")).limit(1).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(O.sql("predicted", """SELECT e.reason_code, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS justified, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS unjustified, round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*), 6) AS rate FROM (
SELECT e.entity_id, e.reason_code, CASE WHEN reason_code = 'NO_CANDIDATE' THEN n = 0 WHEN reason_code IN ('NO_INVOICE_LINK', 'INVOICE_ALREADY_CLAIMED') THEN NOT had_invoice ELSE had_txn END AS ok FROM exc e JOIN (
SELECT p.entity_id, count(s.txn_id) AS n, coalesce(bool_or(s.txn_id = t.txn_id), false) AS had_txn, coalesce(bool_or(a.invoice_id = t.invoice_id), false) AS had_invoice FROM pay p JOIN truth t ON t.invoice_id = replace(p.entity_id, 'pay_', 'INV')
LEFT JOIN scored s ON s.entity_id = p.entity_id LEFT JOIN link a ON a.entity_id = s.entity_id AND a.txn_id = s.txn_id GROUP BY p.entity_id) x ON e.entity_id = x.entity_id) e GROUP BY e.reason_code""", _EVIDENCE))
def reason_actionability(spark, sf_dir):
    s = flow.sources(spark, sf_dir)
    truth = s.truth.select(F.col("invoice_id").alias("true_invoice"), F.col("txn_id").alias("true_txn"), F.replace("invoice_id", F.lit("INV"), F.lit("pay_")).alias("entity_id"))
    cands = flow.scored(spark, sf_dir).select("entity_id", "txn_id").join(flow.links(spark, sf_dir).select("entity_id", "txn_id", "invoice_id"), ["entity_id", "txn_id"], "left")
    seen = s.payments.select("entity_id").join(truth, "entity_id").join(cands, "entity_id", "left").groupBy("entity_id").agg(
        F.count("txn_id").alias("n_candidates"), F.coalesce(F.bool_or(F.col("txn_id") == F.col("true_txn")), F.lit(False)).alias("had_txn"), F.coalesce(F.bool_or(F.col("invoice_id") == F.col("true_invoice")), F.lit(False)).alias("had_invoice"))
    rows = exceptions(spark, sf_dir).select("entity_id", "reason_code").join(seen, "entity_id").withColumn("ok", E.justified())
    good, bad = F.count(F.when(F.col("ok"), 1)), F.count(F.when(~F.col("ok"), 1))
    return rows.groupBy("reason_code").agg(F.count("*").alias("n"), good.alias("justified"), bad.alias("unjustified"), F.round(F.try_divide(good, good + bad), 6).alias("rate"))


# ---- calibration: a document's share of letters as a probability of its quality label
_P = """pl AS (SELECT d.doc_id, l.quality AS y, round(CAST(length(regexp_replace(coalesce(d.text, ''), '[^a-z]', '', 'g')) AS DOUBLE) / greatest(1, length(coalesce(d.text, ''))), 3) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_BIN = "CASE " + " ".join(f"WHEN p >= CAST({C.EDGES[k]!r} AS DOUBLE) THEN {k}" for k in range(9, -1, -1)) + " ELSE 0 END"
_BINS = f"bins AS (SELECT bin, CAST(count(*) AS BIGINT) AS n, avg(p) AS mean_p, avg(y) AS rate, abs(avg(p) - avg(y)) AS gap FROM (SELECT *, {_BIN} AS bin FROM pl) GROUP BY bin)"


def probabilities(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    text = F.coalesce("text", F.lit(""))
    p = F.round(F.length(F.regexp_replace(text, "[^a-z]", "")).cast("double") / F.greatest(F.lit(1), F.length(text)), 3)
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"))


@query(f"WITH {_P}, {_BINS} SELECT CAST(bin AS INT) AS bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(gap, 6) AS gap FROM bins")
def reliability_bins(spark, sf_dir):
    return C.reliability_bins(probabilities(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_p", "rate", "gap")})


@query(f"WITH {_P}, {_BINS} SELECT round((SELECT sum(n * gap) / sum(n) FROM bins), 6) AS ece, round((SELECT max(gap) FROM bins), 6) AS mce, round(avg((p - y) * (p - y)), 6) AS brier FROM pl")
def calibration_errors(spark, sf_dir):
    return C.calibration_errors(probabilities(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("ece", "mce", "brier")])


@query(O.sql("predicted", f"""SELECT threshold, n_auto, n_true, n_auto - n_true AS n_false, round(n_true / CAST(n_auto AS DOUBLE), 6) AS precision, round(n_auto / CAST(base AS DOUBLE), 6) AS coverage, n_true / CAST(n_auto AS DOUBLE) >= 0.995 AS floor_met FROM (
SELECT d.p AS threshold, {BIG} AS n_auto, CAST(sum(y) AS BIGINT) AS n_true, max(base) AS base FROM (SELECT DISTINCT p FROM rows) d JOIN rows r ON r.p >= d.p CROSS JOIN (SELECT count(*) AS base FROM rows) GROUP BY d.p)
ORDER BY floor_met DESC, CASE WHEN n_true / CAST(n_auto AS DOUBLE) >= 0.995 THEN n_auto / CAST(base AS DOUBLE) ELSE n_true / CAST(n_auto AS DOUBLE) END DESC, n_auto DESC, threshold DESC LIMIT 1""",
"rows AS (SELECT p.confidence AS p, CASE WHEN t.txn_id IS NULL THEN 0 ELSE 1 END AS y FROM pred p LEFT JOIN truth t ON p.invoice_id = t.invoice_id AND p.settlement_id = t.settlement_id AND p.txn_id = t.txn_id)"))
def operating_point(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("confidence").alias("p"), F.col("label").alias("y"))
    point = C.operating_point(rows)
    return point.withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query(O.sql("scored", "SELECT rule, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM scored GROUP BY rule"))
def rule_prior(spark, sf_dir):
    counted = flow.scored(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a rule


@query(O.sql("typed", f"SELECT CASE WHEN h < 55 THEN 0 WHEN h < 75 THEN 1 ELSE 2 END AS part, {BIG} AS n, CAST(count(DISTINCT settlement_id) AS BIGINT) AS settlements FROM (SELECT settlement_id, CAST('0x' || substr(md5('17:' || settlement_id), 1, 8) AS BIGINT) % 100 AS h FROM pay) GROUP BY 1"))
def group_split(spark, sf_dir):
    return C.group_split(flow.sources(spark, sf_dir).payments, "settlement_id").groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("settlement_id").alias("settlements"))


@query(O.sql("typed", f"SELECT settled_date >= cut AS late, {BIG} AS n FROM pay, (SELECT list_sort(list(DISTINCT settled_date))[CAST(floor(count(DISTINCT settled_date) * 0.7) AS INT) + 1] AS cut FROM pay) GROUP BY 1"))
def time_split(spark, sf_dir):
    return C.time_split(flow.sources(spark, sf_dir).payments, "settled_date").groupBy("late").agg(F.count("*").alias("n"))


def _raw(spark, sf_dir):
    return probabilities(spark, sf_dir).select("doc_id", F.col("p").alias("raw"), "y")


# pool-adjacent-violators in closed form: the fit at a level is the largest, over levels below, of the smallest, over levels above, of the means between them; lines join the levels
_ISOTONIC = f"""WITH {_P}, level AS (SELECT p AS x, row_number() OVER (ORDER BY p) AS k, sum(count(*)) OVER (ORDER BY p) AS n, sum(sum(y)) OVER (ORDER BY p) AS s FROM pl GROUP BY p),
prior AS (SELECT k, n, s FROM level UNION ALL SELECT 0, 0, 0),
low AS (SELECT b.k, a.k AS a, min(CAST(c.s - b2.s AS DOUBLE) / (c.n - b2.n)) AS m FROM level b JOIN level a ON a.k <= b.k JOIN prior b2 ON b2.k = a.k - 1 JOIN level c ON c.k >= b.k GROUP BY b.k, a.k),
fit AS (SELECT k, max(m) AS p FROM low GROUP BY k)
SELECT pl.doc_id, pl.p AS raw, round(greatest(0.0, least(1.0, fit.p)), 6) AS p FROM pl JOIN level ON level.x = pl.p JOIN fit ON fit.k = level.k"""


@query(_ISOTONIC)
def isotonic_fit(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    return C.calibrated(rows, C.fit_isotonic(rows)).select("doc_id", "raw", F.round("p", 6).alias("p"))


@query()
def platt_fit(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    return C.calibrated(rows, C.fit_platt(rows)).select("doc_id", "raw", "p")


@query()
def choose_calibrator(spark, sf_dir):
    name, errors, _ = C.choose_calibrator(_raw(spark, sf_dir))
    return spark.createDataFrame([(k, float(v), k == name) for k, v in sorted(errors.items())], "calibrator string, ece double, chosen boolean")


def _training(spark, sf_dir):
    truth = flow.sources(spark, sf_dir).truth.select(F.col("invoice_id").alias("link_invoice"), "settlement_id", "txn_id", F.lit(1.0).alias("label"))
    rows = candidate_features(spark, sf_dir).join(truth, ["link_invoice", "settlement_id", "txn_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    # every candidate, also those that no tier fits or that lose to another
    return flow.once(spark, sf_dir, "training", lambda: C.group_split(rows, "settlement_id").select("entity_id", "settlement_id", "txn_id", "link_invoice", "rule_score", "label", "part", *rules.FEATURES))


@query()
def train_model(spark, sf_dir):
    """Fit on the first part, calibrate on the second, take the operating point on the third."""
    return _train(spark, sf_dir)[1]


_FITTED = {}


def _train(spark, sf_dir):
    """((model, calibrator), operating point), fitted once a session and input folder; flow.forget() drops it with the training rows."""
    rows = _training(spark, sf_dir)
    if _FITTED.get("rows") is not rows:
        _FITTED.update(rows=rows, fitted=_fit(rows))
    return _FITTED["fitted"]


def _fit(rows):
    model = C.train(rows.where("part = 0"))
    held = C.raw_scores(rows.where("part = 1"), model).select("raw", F.col("label").alias("y"))
    _, _, calibrator = C.choose_calibrator(held)
    last = C.calibrated(C.raw_scores(rows.where("part = 2"), model), calibrator).select("p", F.col("label").cast("int").alias("y"))
    return (model, calibrator), stored(C.operating_point(last), "point")


@query()
def score_candidates(spark, sf_dir):
    (model, calibrator), _ = _train(spark, sf_dir)
    return C.calibrated(C.raw_scores(_training(spark, sf_dir), model), calibrator).select("entity_id", "txn_id", F.col("link_invoice").alias("invoice_id"), "p")


@query(O.sql("scored", f"""SELECT n_candidates, n_positive, n_candidates - n_positive AS n_negative, round(CAST(n_positive AS DOUBLE) / n_candidates, 6) AS base_rate, round(CAST(n_candidates - n_positive AS DOUBLE) / n_positive, 3) AS negatives_per_positive
FROM (SELECT {BIG} AS n_candidates, CAST(count(t.txn_id) AS BIGINT) AS n_positive FROM pair p LEFT JOIN link l ON p.entity_id = l.entity_id AND p.txn_id = l.txn_id
LEFT JOIN raw_truth t ON l.invoice_id = t.invoice_id AND p.settlement_id = t.settlement_id AND p.txn_id = t.txn_id)""", O.LINKS.replace("{pairs}", "pair")))
def dataset_profile(spark, sf_dir):
    """The class balance of the training table, written and read again."""
    path = fresh_path(spark, "dataset")
    C.write_dataset(_training(spark, sf_dir), path)
    n, good = F.count("*"), F.sum("label")
    counts = C.read_dataset(spark, path).agg(n.alias("n_candidates"), good.alias("n_positive"), (n - good).alias("n_negative"))
    return counts.withColumns({"base_rate": F.round(F.try_divide("n_positive", "n_candidates"), 6), "negatives_per_positive": F.round(F.try_divide("n_negative", "n_positive"), 3)})


@query()
def reconcile_calibrated(spark, sf_dir):
    """Every payment once: matched at the operating point, or an exception with its reason, by calibrated probabilities of all candidates.

    An assigned candidate below the point keeps its invoice and becomes an exception. A match says how many rivals had the best probability
    for its invoice, and what decided between them.
    """
    (model, calibrator), point = _train(spark, sf_dir)
    threshold = point.first()["threshold"]
    rows = C.calibrated(C.raw_scores(_training(spark, sf_dir), model), calibrator)
    rows = rows.select("entity_id", "txn_id", F.col("link_invoice").alias("invoice_id"), "p", F.col("date_delta_abs").alias("penalty"), "rule_score", F.col("invoice_link_score").alias("link_score"))
    scored = flow.once(spark, sf_dir, "probabilities", lambda: rows)
    linked = scored.where("invoice_id <> ''")
    taken = stored(matching.assigned(linked), "taken")
    good = taken.where(F.col("p") >= threshold)
    found = A.evidence(scored.select("entity_id", "txn_id", F.col("p").alias("score"), "penalty"), linked, taken.select("invoice_id", F.col("entity_id").alias("holder")))
    rest = A.exceptions(flow.sources(spark, sf_dir).payments, good, found, threshold=threshold)
    out = good.select("entity_id", F.lit("matched").alias("outcome"), F.lit("").alias("reason_code"), "txn_id", "invoice_id", F.col("p").alias("confidence"), "rivals", "decided_by")
    none = {"rivals": F.lit(0).cast("long"), "decided_by": F.lit("")}
    return out.unionByName(rest.select("entity_id", F.lit("exception").alias("outcome"), "reason_code", "txn_id", "invoice_id", "confidence").withColumns(none))


# ---- corruption of the batch and its effect
_EFFECT = "effect AS (SELECT CAST(sum(CASE WHEN rule IN ('utr_amount_date', 'utr_amount') THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(count(*) AS BIGINT) AS scored FROM best)"


def _late_typed():
    return O.STEPS["typed"].replace("bnk AS (", "bnk0 AS (", 1).replace("pay AS (SELECT s.*", "bnk AS (SELECT * REPLACE (CAST(value_date - 1 AS DATE) AS value_date) FROM bnk0),\npay AS (SELECT s.*", 1)


def _late_chain():
    """The steps on credits whose dates are a day earlier."""
    typed = _late_typed()
    return "WITH " + ",".join([O.STEPS["raw"], typed, O.STEPS["candidates"], O.STEPS["scored"], _EFFECT]) + " SELECT exact, scored FROM effect"


@query(_late_chain())
def chaos_compare(spark, sf_dir):
    """Exact matches left when every value date is a day early."""
    from dataclasses import replace

    s = flow.sources(spark, sf_dir)
    hurt = replace(s, bank=chaos.corrupted(s.bank, ["date_format_swap"]))
    best = rules.best_pairs(rules.scored(blocking.candidates(hurt), hurt))
    return best.agg(F.sum(F.when(F.col("rule").isin("utr_amount_date", "utr_amount"), 1).otherwise(0)).alias("exact"), F.count("*").alias("scored"))


def _outcome_sql(typed):
    steps = O.STEPS | {"typed": typed}
    low, high = _wilson_sql("t", "n")
    return "(" + O.materialized("WITH " + ",".join([*steps.values(), _JUDGED]) + f""" SELECT matched, payments - matched AS exceptions, CAST(matched AS DOUBLE) / payments AS coverage, CAST(t AS DOUBLE) / n AS precision, {low} AS low, {high} AS high, n - t AS false_matches, wrong_money
FROM (SELECT {BIG} AS n, CAST(sum(ok) AS BIGINT) AS t, CAST(sum((1 - ok) * money) AS BIGINT) AS wrong_money FROM judged WHERE confidence >= 0.9), (SELECT CAST(count(DISTINCT entity_id) AS BIGINT) AS matched FROM pred WHERE confidence >= 0.9), (SELECT {BIG} AS payments FROM pay)""") + ")"


_BOTH = ", ".join(f"{side[0]}.{c} AS {side}_{c}" for side in ("before", "after") for c in ("matched", "exceptions", "false_matches", "wrong_money")) + ", " + ", ".join(
    f"round({side[0]}.{c}, 6) AS {side}_{name}" for side in ("before", "after") for c, name in (("coverage", "coverage"), ("precision", "precision"), ("low", "precision_low"), ("high", "precision_high")))


@query(f"""SELECT {_BOTH}, a.false_matches <= b.false_matches AS graceful, round(a.coverage - b.coverage, 4) AS coverage_delta, a.false_matches - b.false_matches AS extra_false_matches, a.wrong_money - b.wrong_money AS extra_wrong_money,
CASE WHEN a.false_matches > b.false_matches THEN 'false matches grew' WHEN a.coverage < b.coverage THEN 'coverage fell, no new false match' ELSE 'no effect on matches' END AS reading FROM {_outcome_sql(O.STEPS["typed"])} b, {_outcome_sql(_late_typed())} a""")
def chaos_verdict(spark, sf_dir):
    """The batch as it is and with every value date a day early, at the same threshold and against the same truth."""
    from dataclasses import replace

    s = flow.sources(spark, sf_dir)
    hurt = replace(s, bank=flow.once(spark, sf_dir, "late-bank", lambda: chaos.corrupted(s.bank, ["date_format_swap"])))
    late = flow.once(spark, sf_dir, "late-predictions", lambda: flow.matched(rules.deciding_pairs(hurt), hurt))
    sides = [E.outcome(p, s.payments, s.truth, s.invoices, bank, THRESHOLD) for p, bank in ((flow.predictions(spark, sf_dir), s.bank), (late, hurt.bank))]
    out = chaos.verdict(*sides)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_coverage", "_precision", "_precision_low", "_precision_high"))})


# ---- operating points of a stored run
_CONF = "conf AS (SELECT entity_id, max(confidence) AS confidence FROM pred GROUP BY entity_id)"
_OPS = f"""ops AS (SELECT *, matched - lag(matched, 1, 0) OVER (ORDER BY matched) AS step FROM (SELECT min(threshold) AS threshold, matched, max(n_settlements) - matched AS to_review, max(accepted) - matched AS llm_bound, max(n_settlements) - max(accepted) AS never_matchable FROM (
  SELECT d.threshold, {BIG} AS matched, (SELECT {BIG} FROM pay) AS n_settlements, (SELECT {BIG} FROM conf) AS accepted FROM (SELECT DISTINCT confidence AS threshold FROM judged) d JOIN conf c ON c.confidence >= d.threshold GROUP BY d.threshold) GROUP BY matched))"""


def settlement_confidences(spark, sf_dir):
    return flow.predictions(spark, sf_dir).groupBy("entity_id").agg(F.max("confidence").alias("confidence"))


def ops(spark, sf_dir):
    """The curve's thresholds, the payments that clear each, those left to review and those that a model would be asked about; equal counts once."""
    conf, curve = settlement_confidences(spark, sf_dir), points(spark, sf_dir)
    above = Window.orderBy(F.desc("threshold"), "mark").rowsBetween(Window.unboundedPreceding, 0)  # two rows a confidence
    level = conf.groupBy(F.col("confidence").alias("threshold")).agg(F.count("*").alias("n")).withColumn("mark", F.lit(0))
    marks = level.unionByName(curve.select("threshold", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("mark")))
    cleared = marks.select("threshold", "mark", F.sum("n").over(above).alias("matched")).where("mark = 1").groupBy("matched").agg(F.min("threshold").alias("threshold"))
    n = flow.sources(spark, sf_dir).payments.agg(F.count("*").alias("n_settlements")).join(conf.agg(F.count("*").alias("accepted")))
    left = {"to_review": F.col("n_settlements") - F.col("matched"), "llm_bound": F.col("accepted") - F.col("matched"), "never_matchable": F.col("n_settlements") - F.col("accepted")}
    return cleared.join(n).withColumns(left).drop("n_settlements", "accepted").join(curve, "threshold")


@query(O.sql("predicted", "SELECT entity_id, confidence FROM conf", _CONF))
def settlement_confidence(spark, sf_dir):
    return settlement_confidences(spark, sf_dir)


def _money_sql(tin, tout, k):
    return {n: f"({tin} / 1e6 * {r[0]} + {tout} / 1e6 * {r[1]}) * {k}" for n, r in (("low", cost.CHEAPEST), ("high", cost.DEAREST))}


_BOUND = _money_sql("llm_bound * 220", "llm_bound * 168", 88)


_LOW, _HIGH = _wilson_sql("n_true", "n_predicted")


@query(O.sql("predicted", f"""SELECT o.threshold, matched, to_review, llm_bound, never_matchable, round(coverage, 6) AS coverage, n_predicted - n_true AS false_matches, round(precision, 6) AS precision, round({_LOW}, 6) AS precision_low, round({_HIGH}, 6) AS precision_high, wrong_money,
CAST((SELECT total_money FROM tot) AS BIGINT) AS total_money, round({_BOUND['low']}, 2) AS low_inr, round({_BOUND['high']}, 2) AS high_inr FROM ops o JOIN points p ON o.threshold = p.threshold""", _JUDGED, _CONF, _OPS))
def operating_points(spark, sf_dir):
    band = cost.band(F.col("llm_bound") * cost.TOKENS_IN, F.col("llm_bound") * cost.TOKENS_OUT)
    low, high = E.wilson(F.col("n_true"), F.col("n_predicted"))
    rounded = {"coverage": F.col("coverage"), "precision": F.col("precision"), "precision_low": low, "precision_high": high}
    return ops(spark, sf_dir).select(
        "threshold", "matched", "to_review", "llm_bound", "never_matchable", (F.col("n_predicted") - F.col("n_true")).alias("false_matches"), "wrong_money", "total_money",
        *[F.round(c, 6).alias(name) for name, c in rounded.items()], F.round(band["low_inr"], 2).alias("low_inr"), F.round(band["high_inr"], 2).alias("high_inr"),
    )


@query(O.sql("predicted", "SELECT matched, step FROM ops", _JUDGED, _CONF, _OPS))
def operating_point_steps(spark, sf_dir):
    w = Window.orderBy("matched")  # one row a confidence
    return ops(spark, sf_dir).select("matched", (F.col("matched") - F.lag("matched", 1, 0).over(w)).alias("step"))


@query(O.sql("predicted", "SELECT threshold, matched FROM ops ORDER BY threshold >= 0.9 DESC, CASE WHEN threshold >= 0.9 THEN threshold ELSE -threshold END LIMIT 1", _JUDGED, _CONF, _OPS))
def selected_operating_point(spark, sf_dir):
    """The lowest point at the threshold or above; where there is none, the highest."""
    enough = F.col("threshold") >= THRESHOLD
    return ops(spark, sf_dir).orderBy(enough.desc(), F.when(enough, F.col("threshold")).otherwise(-F.col("threshold"))).limit(1).select("threshold", "matched")


_CONV = "(SELECT conv_id, sum(length(text)) AS tin, count(*) * 20 AS tout FROM conversations GROUP BY conv_id)"
_BAND = _money_sql("tin", "tout", 88)


def _tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("tin"), (F.count("*") * 20).alias("tout"))


@query(f"SELECT conv_id, round({_BAND['low']}, 6) AS low_inr, round({_BAND['high']}, 6) AS high_inr FROM {_CONV}")
def cost_band(spark, sf_dir):
    b = cost.band(F.col("tin"), F.col("tout"))
    return _tokens(spark, sf_dir).select("conv_id", F.round(b["low_inr"], 6).alias("low_inr"), F.round(b["high_inr"], 6).alias("high_inr"))


_THOUSAND = _money_sql("round_even(tin * 1000.0 / n, 0)", "round_even(tout * 1000.0 / n, 0)", 88)


@query(f"SELECT round({_THOUSAND['low']}, 6) AS low_inr, round({_THOUSAND['high']}, 6) AS high_inr FROM (SELECT CAST(sum(tin) AS DOUBLE) AS tin, CAST(sum(tout) AS DOUBLE) AS tout, CAST(count(*) AS DOUBLE) AS n FROM {_CONV})")
def cost_per_thousand(spark, sf_dir):
    total = _tokens(spark, sf_dir).agg(F.sum("tin").cast("double").alias("tin"), F.sum("tout").cast("double").alias("tout"), F.count("*").alias("n"))
    b = cost.per_thousand(F.col("tin"), F.col("tout"), F.col("n"))
    return total.select(F.round(b["low_inr"], 6).alias("low_inr"), F.round(b["high_inr"], 6).alias("high_inr"))


_AUDIT = """audit AS (SELECT 'model' AS layer, 'matched' AS decision, entity_id, invoice_id, txn_id, substr(sha256(entity_id || chr(0) || settlement_id || chr(0)), 1, 16) AS settlement_hash, '' AS reason_code, confidence FROM matched
UNION ALL SELECT CASE reason_code WHEN 'NO_CANDIDATE' THEN 'blocking' WHEN 'NO_INVOICE_LINK' THEN 'invoice_link' ELSE 'model' END, 'exception', e.entity_id, e.invoice_id, e.txn_id, substr(sha256(e.entity_id || chr(0) || s.settlement_id || chr(0)), 1, 16), reason_code, confidence FROM exc e JOIN setl s ON e.entity_id = s.entity_id)"""


def audit(spark, sf_dir):
    """One record a payment, matched or not, in one shape."""
    sid = flow.sources(spark, sf_dir).settlements.select("entity_id", "settlement_id")
    h = S.row_hash(F.col("entity_id"), F.col("settlement_id")).alias("settlement_hash")
    good = matched(spark, sf_dir).select(F.lit("model").alias("layer"), F.lit("matched").alias("decision"), "entity_id", "invoice_id", "txn_id", h, F.lit("").alias("reason_code"), "confidence")
    layer = F.when(F.col("reason_code") == "NO_CANDIDATE", "blocking").when(F.col("reason_code") == "NO_INVOICE_LINK", "invoice_link").otherwise("model")
    bad = exceptions(spark, sf_dir).join(sid, "entity_id").select(layer.alias("layer"), F.lit("exception").alias("decision"), "entity_id", "invoice_id", "txn_id", h, "reason_code", "confidence")
    return good.unionByName(bad)


@query(O.sql("predicted", "SELECT * FROM audit", _EVIDENCE, _AUDIT))
def audit_records(spark, sf_dir):
    return audit(spark, sf_dir)


@query(O.sql("predicted", f"SELECT {BIG} AS n, CAST(count(*) FILTER (WHERE layer NOT IN ('blocking', 'rules', 'invoice_link', 'subset_sum', 'model', 'llm')) AS BIGINT) AS bad_layer, CAST(count(*) FILTER (WHERE decision NOT IN ('matched', 'exception')) AS BIGINT) AS bad_decision, CAST(count(*) FILTER (WHERE decision = 'exception' AND reason_code = '') AS BIGINT) AS no_reason, CAST(count(*) FILTER (WHERE decision = 'matched' AND reason_code <> '') AS BIGINT) AS odd_reason FROM audit", _EVIDENCE, _AUDIT))
def audit_violations(spark, sf_dir):
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    code, decision = F.col("reason_code"), F.col("decision")
    return audit(spark, sf_dir).agg(F.count("*").alias("n"), count(~F.col("layer").isin("blocking", "rules", "invoice_link", "subset_sum", "model", "llm"), "bad_layer"), count(~decision.isin("matched", "exception"), "bad_decision"), count((decision == "exception") & (code == ""), "no_reason"), count((decision == "matched") & (code != ""), "odd_reason"))


