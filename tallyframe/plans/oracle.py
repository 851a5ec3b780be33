"""The reconciliation steps as SQL common table expressions, from which the queries' SQL is put together."""

from __future__ import annotations

import re

from ..functions import scalars as S
from ..sources.fixture import RAW


def paise(x: str) -> str:
    return f"CAST(coalesce(trunc(TRY_CAST(replace(trim({x}), ',', '') AS DECIMAL(20,4)) * 100), 0) AS BIGINT)"


def pct(a: str, rate: float) -> str:
    return f"CAST(floor({a} * CAST({rate} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def after_fee(a: str) -> str:
    fee = pct(a, S.FEE_RATE)
    return f"({a} - {fee} - {pct(fee, S.GST_RATE)})"


def plausible(amount: str, net: str) -> str:
    tds = [f"({amount} - {pct(amount, r)})" for r in S.TDS_RATES]
    return f"list_filter(list_distinct([{', '.join([net, amount, after_fee(amount), *tds, *map(after_fee, tds)])}]), lambda x: x > 0)"


def band(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN CAST(floor(ln(CAST({p} AS DOUBLE)) / ln(CAST({S.BAND_RATIO} AS DOUBLE))) AS BIGINT) ELSE 0 END"


def counterparty(name: str) -> str:
    return f"regexp_replace(regexp_replace(trim(regexp_replace(upper({name}), '\\s+', ' ', 'g')), '( |^)({'|'.join(S.SUFFIXES)})$', ''), '[^A-Z0-9]+', '', 'g')"


def words(name: str) -> str:
    drop = ", ".join(f"'{w}'" for w in S.SUFFIX_WORDS)
    return f"list_filter(string_split(trim(regexp_replace(upper({name}), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({drop}))"


def name_key(name: str) -> str:
    w = words(name)
    return f"CASE WHEN len({w}) = 0 THEN '' WHEN len({w}) = 1 THEN ({w})[1][1:7] ELSE ({w})[1][1:4] || ({w})[2][1:3] END"


def alphabetic(nn: str) -> str:
    return f"list_filter(string_split({nn}, ' '), lambda t: regexp_full_match(t, '[A-Z]{{3,}}'))"


def narration_keys(nn: str) -> str:
    t = alphabetic(nn)
    return f"list_distinct(list_concat(list_transform(range(1, len({t})), lambda i: ({t})[i][1:4] || ({t})[i + 1][1:3]), list_transform(list_filter({t}, lambda t: length(t) >= 7), lambda t: t[1:7])))"


def normalized(n: str) -> str:
    return f"trim(regexp_replace(upper({n}), '[^A-Z0-9]+', ' ', 'g'))"


def utrs(n: str) -> str:
    return f"list_filter(regexp_extract_all({n}, '[0-9]+'), lambda x: length(x) = 12)"


def joined_text(xs: str) -> str:
    return f"array_to_string(list_sort({xs}), '|')"


TYPED = f"""
inv AS (SELECT invoice_id, customer_name, {paise("amount")} AS amount, CAST(invoice_date AS DATE) AS invoice_date, tds_section, status, {counterparty("customer_name")} AS counterparty, {name_key("customer_name")} AS ckey FROM raw_invoices),
setl AS (SELECT entity_id, settlement_id, settlement_utr AS utr, type AS txn_type, order_receipt AS invoice_id, CAST(amount AS BIGINT) AS amount, CAST(fee AS BIGINT) AS fee, CAST(tax AS BIGINT) AS tax,
  CAST(net_amount AS BIGINT) AS net_amount, DATE '1970-01-01' + CAST(floor(CAST(settled_at AS BIGINT) / 86400) AS INT) AS settled_date, method FROM raw_gateway),
bnk AS (SELECT txn_id, {paise("credit")} AS credit, {paise("debit")} AS debit, CAST(CASE WHEN bank = 'HDFC' THEN strptime(value_date, '%d/%m/%y') ELSE strptime(value_date, '%d-%m-%Y') END AS DATE) AS value_date,
  narration, bank, bank_ref, {utrs("narration")} AS utrs, {normalized("narration")} AS nn FROM raw_bank),
pay AS (SELECT s.*, coalesce(i.counterparty, '') AS cp, coalesce(i.ckey, '') AS ckey FROM setl s LEFT JOIN inv i ON s.invoice_id = i.invoice_id WHERE s.txn_type = 'payment')
"""
CANDIDATES = f"""
p_utr AS (SELECT s.settlement_id, s.entity_id, b.txn_id, 'utr' AS pass FROM pay s JOIN (SELECT DISTINCT txn_id, unnest(utrs) AS u FROM bnk) b ON b.u = s.utr),
p_exact AS (SELECT s.settlement_id, s.entity_id, b.txn_id, 'exact_amount' AS pass FROM pay s JOIN bnk b ON b.credit = s.net_amount AND b.credit > 0 AND abs(b.value_date - s.settled_date) <= 3),
p_rate AS (SELECT s.settlement_id, s.entity_id, b.txn_id, 'rate_amount' AS pass FROM (SELECT settlement_id, entity_id, settled_date, t + o AS target FROM
  (SELECT settlement_id, entity_id, settled_date, unnest({plausible("amount", "net_amount")}) AS t FROM pay), range(-5, 6) r(o)) s JOIN bnk b ON b.credit = s.target AND b.credit > 0 AND abs(b.value_date - s.settled_date) <= 3),
p_name AS (SELECT s.settlement_id, s.entity_id, b.txn_id, 'counterparty' AS pass FROM pay s JOIN (SELECT txn_id, value_date, {band("credit")} AS band, unnest({narration_keys("nn")}) AS k FROM bnk WHERE credit > 0) b
  ON b.k = s.ckey AND s.ckey <> '' AND s.cp <> '' AND b.band BETWEEN {band("s.net_amount")} - 2 AND {band("s.net_amount")} AND abs(b.value_date - s.settled_date) <= 3),
hit AS (SELECT * FROM p_utr UNION ALL SELECT * FROM p_exact UNION ALL SELECT * FROM p_rate UNION ALL SELECT * FROM p_name),
cand AS (SELECT settlement_id, entity_id, txn_id, list_sort(list_distinct(list(pass))) AS passes FROM hit GROUP BY ALL)
"""
_UTR, _SAME, _NEAR = "list_contains(b.utrs, s.utr)", "b.credit = s.net_amount", "abs(b.value_date - s.settled_date) <= 3"
_NAME = "(s.cp <> '' AND contains(replace(b.nn, ' ', ''), s.cp[1:6]))"


def similarity(a: str, b: str) -> str:
    """The token-set ratio of a name of one token and a narration: the common subsequence by bits of a HUGEINT."""
    text = f"array_to_string(list_sort(list_distinct(string_split({b}, ' '))), ' ')"
    bits = f"(CAST(pow(2, length({a})) AS HUGEINT) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE CAST(0 AS HUGEINT) END))::HUGEINT"
    left = f"list_reduce(list_transform(string_split({text}, ''), lambda c: {mask}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {bits}, {bits})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN list_contains(string_split({b}, ' '), {a}) THEN 1 ELSE CAST(2 * (length({a}) - bit_count({left})) AS DOUBLE) / (length({a}) + length({text})) END"


SIMILAR = similarity("s.cp", "b.nn")
SCORED = f"""
pair AS (SELECT c.*, s.utr, s.invoice_id, s.amount, s.net_amount, s.settled_date, s.cp, b.credit, b.value_date, b.utrs, b.nn,
  CASE WHEN {_UTR} AND {_SAME} AND {_NEAR} THEN 'utr_amount_date' WHEN {_UTR} AND {_SAME} THEN 'utr_amount' WHEN {_SAME} AND {_NAME} AND {_NEAR} THEN 'exact_amount_counterparty'
       WHEN abs(b.credit - {after_fee("s.amount")}) <= 5 AND {_NEAR} THEN 'fee_adjusted' WHEN {_UTR} AND abs(b.credit - s.net_amount) <= 5 THEN 'utr_amount_tolerance' WHEN {_UTR} THEN 'utr_only'
       WHEN {_SAME} AND {_NEAR} THEN 'exact_amount_date'
       WHEN {_NAME} AND {_NEAR} AND {SIMILAR} >= 0.55 THEN 'fuzzy_counterparty_date' END AS rule, {_NAME} AS named
  FROM cand c JOIN pay s ON c.entity_id = s.entity_id JOIN bnk b ON c.txn_id = b.txn_id),
scored AS (SELECT *, CAST(CASE rule WHEN 'utr_amount_date' THEN 0.99 WHEN 'utr_amount' THEN 0.97 WHEN 'exact_amount_counterparty' THEN 0.94 WHEN 'fee_adjusted' THEN 0.90 WHEN 'utr_amount_tolerance' THEN 0.97
  WHEN 'utr_only' THEN 0.82 WHEN 'exact_amount_date' THEN 0.70 ELSE round(CAST(0.65 AS DOUBLE) * least(1.0, {similarity("pair.cp", "pair.nn")}), 4) END AS DOUBLE) AS rule_score, CASE WHEN rule IN ('fee_adjusted', 'exact_amount_date', 'fuzzy_counterparty_date') THEN 'fuzzy' ELSE 'exact' END AS layer, abs(value_date - settled_date) / CAST(1000 AS DOUBLE) AS penalty
  FROM pair WHERE rule IS NOT NULL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rule_score DESC, penalty, txn_id) = 1)
"""


def _after_tds(gross: str, amount: str) -> str:
    return " OR ".join(f"{amount} = {gross} - {pct(gross, r)}" for r in S.TDS_RATES)


LINKS = f"""
named AS (SELECT DISTINCT p.settlement_id, p.entity_id, p.txn_id, p.amount, p.settled_date, i.invoice_id, i.amount AS gross, i.invoice_date, p.settled_date - i.invoice_date AS link_days
  FROM (SELECT settlement_id, entity_id, txn_id, amount, settled_date, unnest({narration_keys("nn")}) AS k FROM {{pairs}} WHERE invoice_id = '') p JOIN inv i ON i.ckey = p.k AND i.ckey <> '' AND p.settled_date - i.invoice_date BETWEEN -1 AND 8),
linked AS (SELECT *, CAST(CASE link_rule WHEN 'invoice_exact_amount' THEN 0.95 WHEN 'invoice_tds_adjusted' THEN 0.90 ELSE 0.55 END AS DOUBLE) AS link_score FROM (SELECT *, CASE WHEN amount = gross THEN 'invoice_exact_amount'
  WHEN {_after_tds("gross", "amount")} THEN 'invoice_tds_adjusted' WHEN CAST(amount AS DOUBLE) / gross BETWEEN 0.30 AND 0.97 THEN 'invoice_partial_payment' END AS link_rule FROM named WHERE gross > 0) WHERE link_rule IS NOT NULL),
link AS (SELECT settlement_id, entity_id, txn_id, invoice_id, CAST(1.0 AS DOUBLE) AS link_score, 'receipt_given' AS link_rule, CAST(0 AS BIGINT) AS link_days FROM {{pairs}} WHERE invoice_id <> ''
  UNION ALL SELECT settlement_id, entity_id, txn_id, invoice_id, link_score, link_rule, link_days FROM linked QUALIFY row_number() OVER (PARTITION BY entity_id, txn_id ORDER BY link_score DESC, abs(link_days), invoice_id) = 1)
"""
ROUNDS = 12


def greedy(edges: str, left: str, right: str, order: str) -> str:
    """CTEs with the edges that each round takes, over a table of edges."""
    out = [f"e0 AS MATERIALIZED (SELECT * FROM ({edges}))"]
    for k in range(ROUNDS):
        out.append(f"t{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {left} ORDER BY {order}) AS rl, row_number() OVER (PARTITION BY {right} ORDER BY {order}) AS rr FROM e{k}) WHERE rl = 1 AND rr = 1)")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} WHERE {left} NOT IN (SELECT {left} FROM t{k}) AND {right} NOT IN (SELECT {right} FROM t{k}))")
    return ",".join(out)


def taken(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM t{k}" for k in range(ROUNDS)) + f" UNION ALL SELECT {columns} FROM e{ROUNDS}"


def resolved(pairs: str) -> str:
    """pick: given receipts, then inferred links one to one."""
    free = f"SELECT settlement_id, entity_id, txn_id, invoice_id, link_score, abs(link_days) AS far, link_rule FROM linked WHERE invoice_id NOT IN (SELECT invoice_id FROM {pairs} WHERE invoice_id <> '')"
    columns = "settlement_id, entity_id, txn_id, invoice_id, link_score, link_rule"
    return greedy(free, "entity_id", "invoice_id", "link_score DESC, far, invoice_id, entity_id") + f", pick AS MATERIALIZED (SELECT {columns} FROM link WHERE link_rule = 'receipt_given' UNION ALL {taken(columns)})"


PREDICTED = """
pred AS (SELECT l.invoice_id, l.settlement_id, l.txn_id, l.entity_id, b.rule, l.link_rule, b.layer, round(b.rule_score * l.link_score, 4) AS confidence FROM best b JOIN pick l ON b.entity_id = l.entity_id AND b.txn_id = l.txn_id),
truth AS (SELECT * FROM raw_truth)
"""
STEPS = {"raw": RAW.format(orders="orders", customer="customer"), "typed": TYPED, "candidates": CANDIDATES, "scored": SCORED, "links": LINKS.replace("{pairs}", "best"), "resolved": resolved("best"), "predicted": PREDICTED}


def sql(upto: str, select: str, *more: str) -> str:
    """The steps up to one, further CTEs, and a final select."""
    names = list(STEPS)
    return materialized("WITH " + ",".join([*(STEPS[n] for n in names[: names.index(upto) + 1]), *more]) + "\n" + select)


def materialized(text: str) -> str:
    """The steps that later ones read several times are computed once."""
    return re.sub(r"\b(inv|setl|bnk|pay|cand|pair|scored|best|named|link|pred|held|matched|evid|exc|judged) AS \(", r"\1 AS MATERIALIZED (", text)
