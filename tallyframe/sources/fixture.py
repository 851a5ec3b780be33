"""A reconciliation batch derived from `orders` and `customer` by SQL that any engine runs: raw text rows, as exported by the systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLACES = "Arvandi|Belapur|Chandol|Devgarh|Ekmala|Firozbad|Gulmarg|Harsola|Indrali|Jalpura|Kotwara|Lonavat"
TRADES = "Textiles|Spices|Ceramics|Traders|Foods|Motors|Papers|Chemicals|Jewels|Plastics|Timber|Granites|Garments"


def _pct(a: str, rate: str) -> str:
    return f"CAST(floor({a} * CAST({rate} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def _rupees(p: str) -> str:
    return f"(CAST(CAST(floor(({p}) / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST(({p}) % 100 AS STRING), 2, '0'))"


def _day(d: str) -> str:
    return f"(DATE '2026-06-01' + CAST({d} AS INT))"


def _id(prefix: str, k: str) -> str:
    return f"'{prefix}' || lpad(CAST({k} AS STRING), 10, '0')"


#: Day number of 2026-06-01 since 1970.
EPOCH_DAY = 20605
#: CTEs; {orders} and {customer} name the input tables.
ROWS = f"""
n AS (SELECT greatest(90, CAST(floor(count(*) * 6 / 1000.0) AS INT)) AS span FROM {{orders}}),
b0 AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 20 AS slot, CAST(round(o_totalprice * 100) AS BIGINT) AS listed, span FROM {{orders}} CROSS JOIN n),
b1 AS (SELECT k, c, slot,
  CASE WHEN slot <= 10 THEN 'clean' WHEN slot <= 12 THEN 'fee_deducted' WHEN slot = 13 THEN 'partial_payment' WHEN slot = 14 THEN 'tds_deducted'
       WHEN slot = 15 THEN 'refund_netted' WHEN slot = 16 THEN 'date_skew' WHEN slot = 17 THEN 'rounding_drift' WHEN slot = 18 THEN 'duplicate_utr'
       ELSE 'batched_settlement' END AS case_type,
  CASE WHEN k % 4 = 0 THEN CAST(floor((listed + 500000) / 1000000.0) AS BIGINT) * 1000000 + 100000 ELSE listed END AS gross,
  CASE WHEN slot = 19 THEN CAST(floor(k / 60.0) AS BIGINT) * 60 + 19 ELSE k END AS grp,
  (k * 7 + CAST(floor(k / 90.0) AS BIGINT)) % span AS day0,
  split_part('{PLACES}', '|', CAST(c % 12 AS INT) + 1) || ' ' || split_part('{TRADES}', '|', CAST(c % 13 AS INT) + 1)
    || split_part(' Pvt Ltd| LLP| Private Limited|', '|', CAST(c % 4 AS INT) + 1) AS customer_name FROM b0),
b2 AS (SELECT *, CASE WHEN slot = 19 THEN min(day0) OVER (PARTITION BY grp) ELSE day0 END AS inv_day,
  CASE WHEN slot = 14 THEN gross - {_pct("gross", "0.05")} WHEN slot = 13 THEN {_pct("gross", "0.6")} ELSE gross END AS captured FROM b1),
b3 AS (SELECT *, CASE WHEN slot IN (11, 12, 15, 18, 19) THEN {_pct("captured", "0.02")} ELSE CAST(0 AS BIGINT) END AS fee FROM b2),
b4 AS (SELECT *, {_pct("fee", "0.18")} AS tax, inv_day + CASE WHEN slot = 19 THEN 0 ELSE k % 3 END AS set_day,
  CAST(300000000000 + CASE WHEN slot = 18 THEN CAST(floor(k / 40.0) AS BIGINT) * 40 + 18 ELSE grp END AS STRING) AS utr FROM b3),
b5 AS (SELECT *, captured - fee - tax AS net, sum(captured - fee - tax) OVER (PARTITION BY grp) AS paid, row_number() OVER (PARTITION BY grp ORDER BY k) AS nth FROM b4)"""
TABLES = f"""
raw_invoices AS (SELECT {_id("INV", "k")} AS invoice_id, customer_name, CAST({_day("inv_day")} AS STRING) AS invoice_date, CAST({_day("inv_day + 30")} AS STRING) AS due_date,
  {_rupees("gross")} AS amount, CASE WHEN slot = 14 THEN 'yes' ELSE 'no' END AS tds_applicable, CASE WHEN slot = 14 THEN '194C' ELSE '' END AS tds_section, 'open' AS status FROM b5),
raw_gateway AS (SELECT {_id("pay_", "k")} AS entity_id, 'payment' AS type, CASE WHEN k % 50 < 19 THEN {_id("INV", "k")} ELSE '' END AS order_receipt, {_id("setl_", "grp")} AS settlement_id,
  utr AS settlement_utr, CAST(captured AS STRING) AS amount, CAST(fee AS STRING) AS fee, CAST(tax AS STRING) AS tax, CAST(net AS STRING) AS net_amount,
  split_part('upi|card|netbanking|wallet', '|', CAST(k % 4 AS INT) + 1) AS method, CAST(({EPOCH_DAY} + set_day) * 86400 + 3600 AS STRING) AS settled_at FROM b5
  UNION ALL SELECT {_id("rfnd_", "k")}, 'refund', '', {_id("setl_", "grp")}, utr, CAST({_pct("gross", "0.2")} AS STRING), '0', '0', CAST(-{_pct("gross", "0.2")} AS STRING), 'upi',
  CAST(({EPOCH_DAY} + set_day) * 86400 + 7200 AS STRING) FROM b5 WHERE slot = 15),
b6 AS (SELECT k, utr, customer_name, CASE WHEN k % 2 = 0 THEN 'HDFC' ELSE 'ICICI' END AS bank, {_id("TXN", "grp")} AS txn_id,
  CAST(paid AS BIGINT) + CASE WHEN slot = 17 THEN k % 5 + 1 WHEN slot = 15 THEN -{_pct("gross", "0.2")} ELSE 0 END AS credit,
  {_day("set_day + CASE WHEN slot = 16 THEN k % 3 + 1 ELSE 0 END")} AS value_day FROM b5 WHERE nth = 1
  UNION ALL SELECT c_custkey, CAST(700000000000 + c_custkey AS STRING), 'Stray ' || split_part('{TRADES}', '|', CAST(c_custkey % 13 AS INT) + 1), 'HDFC', {_id("ORP", "c_custkey")},
  CAST(round(abs(c_acctbal) * 100) AS BIGINT) + 7, {_day("c_custkey % 90")} FROM {{customer}} WHERE c_custkey % 150 = 0),
raw_bank AS (SELECT txn_id, CASE WHEN bank = 'HDFC' THEN lpad(CAST(day(value_day) AS STRING), 2, '0') || '/' || lpad(CAST(month(value_day) AS STRING), 2, '0') || '/' || lpad(CAST(year(value_day) % 100 AS STRING), 2, '0')
    ELSE lpad(CAST(day(value_day) AS STRING), 2, '0') || '-' || lpad(CAST(month(value_day) AS STRING), 2, '0') || '-' || CAST(year(value_day) AS STRING) END AS value_date,
  CASE k % 5 WHEN 0 THEN 'NEFT CR-HDFC0000123-' || upper(customer_name) || '-' || utr WHEN 1 THEN 'upi/cr/' || utr || '/' || lower(customer_name) || '/okbank'
    WHEN 2 THEN 'RTGS/' || utr || '/' || upper(substr(customer_name, 1, 12)) WHEN 3 THEN 'IMPS-' || utr || '-' || customer_name || '-PAYMENT'
    ELSE 'BIL/ONL/' || lpad(CAST(k AS STRING), 10, '0') || '/' || upper(customer_name) END AS narration,
  {_rupees("credit")} AS credit, '' AS debit, CAST(k AS STRING) AS bank_ref, bank FROM b6),
raw_truth AS (SELECT {_id("INV", "k")} AS invoice_id, {_id("setl_", "grp")} AS settlement_id, {_id("TXN", "grp")} AS txn_id, case_type FROM b5
  UNION ALL SELECT '', '', txn_id, 'orphan' FROM b6 WHERE txn_id LIKE 'ORP%')
"""
RAW = f"{ROWS},{TABLES}"
#: What the tables take of the rows.
TAKEN = "k, slot, case_type, customer_name, gross, captured, fee, tax, net, paid, nth, grp, utr, inv_day, set_day"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an order, with sums and places in its settlement, of which the tables are projections."""
    return spark.sql(f"WITH {ROWS} SELECT {TAKEN} FROM b5", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def raw_tables(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """invoices, gateway, bank and truth as text rows; from raw_rows that were written, if given."""
    inputs = {"b5": raw_rows(spark, sf_dir) if rows is None else rows, "customer": spark.read.parquet(f"{sf_dir}/customer.parquet")}
    return {t: spark.sql(f"WITH b5 AS (SELECT * FROM {{b5}}), {TABLES} SELECT * FROM raw_{t}", **inputs) for t in ("invoices", "gateway", "bank", "truth")}
