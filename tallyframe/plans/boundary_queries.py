"""Queries on corruptions, validation around an external model, and synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import fresh_path
from ..operators import chaos, synth
from ..operators import validation as V
from ..sources.decisions import DecisionLog
from . import flow
from . import oracle as O
from .matching_queries import BIG
from .registry import query

COMMA = "format('{:,}', credit // 100) || '.' || lpad(CAST(credit % 100 AS VARCHAR), 2, '0')"
_UTR12 = "coalesce((" + O.utrs("narration") + ")[1], '000000000000')"
_NAMES = "regexp_extract_all(narration, '[A-Za-z]{4,}')[1:2]"


def _chaos_sql(expression, column="narration"):
    return O.sql("typed", f"SELECT txn_id, {expression} AS {column} FROM bnk")


def _hurt(spark, sf_dir, name, column="narration"):
    out = chaos.corrupted(flow.sources(spark, sf_dir).bank, [name])
    return out.select("txn_id", (F.col(column).cast("string") if column == "value_date" else F.col(column)).alias(column))


UNSEEN = f"'TXN|' || CAST(value_date AS VARCHAR) || '|CR|REF#' || {_UTR12} || '|REMITTER=' || CASE WHEN len({_NAMES}) = 0 THEN 'PAYER' ELSE array_to_string({_NAMES}, ' ') END || '|CHNL=RTGS|STS=SUCCESS'"


@query(_chaos_sql(UNSEEN))
def chaos_unseen_narration(spark, sf_dir):
    return _hurt(spark, sf_dir, "unseen_narration")


# RE2 has no look-around: a run of exactly twelve digits is taken with its neighbours
@query(_chaos_sql(r"regexp_replace(narration, '(^|[^0-9])([0-9]{4})([0-9]{4})([0-9]{4})($|[^0-9])', '\1\2 \3 \4\5', 'g')"))
def chaos_wrapped_utr(spark, sf_dir):
    return _hurt(spark, sf_dir, "wrapped_utr")


@query(_chaos_sql("CAST(CAST(value_date - 1 AS DATE) AS VARCHAR)", "value_date"))
def chaos_date_format_swap(spark, sf_dir):
    return _hurt(spark, sf_dir, "date_format_swap", "value_date")


@query(_chaos_sql("greatest(0, credit - CAST(floor(CAST(credit AS DOUBLE) * CAST(0.0037 AS DOUBLE)) AS BIGINT) - 11)", "credit"))
def chaos_unmodelled_fee(spark, sf_dir):
    return _hurt(spark, sf_dir, "unmodelled_fee", "credit")


_SWAP = "x"
for _a, _b in (("A", "aa"), ("I", "ee"), ("U", "oo"), ("V", "w"), ("S", "sh")):
    _SWAP = f"replace({_SWAP}, '{_a}', '{_b}')"


def transliterated(text):
    return f"array_to_string(list_transform(string_split(regexp_replace({text}, '([A-Z]{{4,}})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: CASE WHEN regexp_full_match(x, '[A-Z]{{4,}}') THEN upper({_SWAP}) ELSE x END), '')"


@query(_chaos_sql(transliterated("narration")))
def chaos_transliterated_counterparty(spark, sf_dir):
    return _hurt(spark, sf_dir, "transliterated_counterparty")


@query(_chaos_sql("substr(narration, 1, 24)"))
def chaos_truncated_narration(spark, sf_dir):
    return _hurt(spark, sf_dir, "truncated_narration")


@query(_chaos_sql(f"narration || ' AMT INR ' || {COMMA} || '/-'"))
def chaos_currency_symbol_noise(spark, sf_dir):
    return _hurt(spark, sf_dir, "currency_symbol_noise")


@query(_chaos_sql("credit + 50000 + CAST('0x' || substr(md5('merge:' || txn_id), 1, 8) AS BIGINT) % 450000", "credit"))
def chaos_merged_credits(spark, sf_dir):
    return _hurt(spark, sf_dir, "merged_credits", "credit")


@query(O.sql("typed", f"SELECT txn_id, {O.joined_text(O.utrs('substr(narration, 1, 24)'))} AS utrs, {O.normalized('substr(narration, 1, 24)')} AS nn FROM bnk"))
def chaos_rebuild(spark, sf_dir):
    out = chaos.corrupted(flow.sources(spark, sf_dir).bank, ["truncated_narration"])
    return out.select("txn_id", F.array_join(F.sort_array("utrs"), "|").alias("utrs"), F.col("normalized_narration").alias("nn"))


_PICK = "CAST('0x' || substr(md5('7:{name}:' || txn_id), 1, 8) AS BIGINT) % 10000 < 5000"


@query(O.sql("typed", f"SELECT CAST(count(*) FILTER (WHERE {_PICK.format(name='truncated_narration')} AND substr(narration, 1, 24) <> narration) AS BIGINT) AS truncated, CAST(count(*) FILTER (WHERE {_PICK.format(name='date_format_swap')}) AS BIGINT) AS moved FROM bnk"))
def chaos_touched(spark, sf_dir):
    out = chaos.corrupted(flow.sources(spark, sf_dir).bank, ["truncated_narration", "date_format_swap"], share=0.5)
    return out.agg(F.count(F.when(F.col("hit_truncated_narration"), 1)).alias("truncated"), F.count(F.when(F.col("hit_date_format_swap"), 1)).alias("moved"))


_HELD = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, $${w}$$)' for w in words)} THEN '{name}' END" for name, words in chaos.KEYWORDS.items())


@query(f"SELECT conv_id, turn, array_to_string(list_filter([{_HELD}], lambda x: x IS NOT NULL)[1:3], '|') AS corruptions FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)")
def chaos_keyword(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.array_join(chaos.by_keyword(F.col("text")), "|").alias("corruptions"))


@query(f"""SELECT conv_id, turn, CASE WHEN len(named) = 0 THEN '{chaos.DEFAULT}' ELSE array_to_string(named, '|') END AS corruptions, CASE WHEN len(named) = 0 THEN 'default' ELSE 'keyword' END AS interpreted_by,
CASE WHEN regexp_extract(t, '([0-9]{{1,3}})\\s*%', 1) <> '' THEN greatest(0.05, least(1.0, CAST(regexp_extract(t, '([0-9]{{1,3}})\\s*%', 1) AS DOUBLE) / 100)) WHEN regexp_matches(t, '\\b(all|every|whole)\\b') THEN 1.0 ELSE 0.5 END AS share
FROM (SELECT *, list_filter([{_HELD}], lambda x: x IS NOT NULL)[1:3] AS named FROM (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS t FROM conversations))""")
def chaos_interpret(spark, sf_dir):
    spec = chaos.interpret(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.array_join(spec["corruptions"], "|").alias("corruptions"), spec["interpreted_by"].alias("interpreted_by"), spec["share"].alias("share"))


@query(r"""SELECT o_orderkey, CASE WHEN regexp_extract(t, '([0-9]{1,3})\s*%', 1) <> '' THEN greatest(0.05, least(1.0, CAST(regexp_extract(t, '([0-9]{1,3})\s*%', 1) AS DOUBLE) / 100)) WHEN regexp_matches(lower(t), '\b(all|every|whole)\b') THEN 1.0 ELSE 0.5 END AS share
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'corrupt ' || CAST(o_orderkey % 130 AS VARCHAR) || ' % of rows' WHEN 1 THEN 'All of it' ELSE 'some rows' END AS t FROM orders)""")
def chaos_share(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("corrupt "), (k % 130).cast("string"), F.lit(" % of rows"))).when(k % 3 == 1, "All of it").otherwise("some rows")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", chaos.share_from_text(t).alias("share"))


# ---- validation. Items are bank rows; claims are derived from them, some wrong
_GUESS = "upper(array_to_string(list_filter(string_split(regexp_replace(narration, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[A-Za-z]{3,}') AND upper(w) NOT IN (" + ", ".join(f"'{w}'" for w in V.NOISE) + "))[1:2], ' '))"
_METHOD = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(narration), $${w}$$)' for w in words)} THEN '{m}'" for m, words in (("upi", ("upi", "@ok", "@ybl", "@paytm", "vpa")), ("neft", ("neft",)), ("imps", ("imps",)), ("rtgs", ("rtgs",)), ("card", ("card", "pos", "visa", "mastercard")), ("ach", ("ach", "nach", "mandate")))) + " ELSE 'unknown' END"
_CLAIMS = f"""claims AS (SELECT txn_id AS id, narration, nn, [credit] AS known, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '300000000001' ELSE coalesce(utrs[1], '') END AS utr, CASE WHEN k % 5 = 0 THEN 'ACME HOLDINGS' ELSE {_GUESS} END AS counterparty,
  CAST(CASE WHEN k % 3 = 0 THEN credit + 1 ELSE credit END AS VARCHAR) AS amount, CASE WHEN k % 6 = 0 THEN 'card' ELSE {_METHOD} END AS payment_method FROM (SELECT *, CAST(bank_ref AS BIGINT) AS k FROM bnk))"""
_RUNS = "regexp_extract_all(narration, '[0-9]+')"
_METHOD_FOUND = " OR ".join(f"(payment_method = '{m}' AND contains(lower(narration), $${w}$$))" for m, words in V.METHODS.items() for w in words)
_CHECKS = f"""checks AS (SELECT id, 'utr' AS field, utr AS value, CASE WHEN utr = '' THEN 'empty' WHEN list_contains({_RUNS}, utr) THEN 'present' ELSE 'absent' END AS verdict, 'required' AS policy FROM claims
UNION ALL SELECT id, 'counterparty', counterparty, CASE WHEN counterparty = '' THEN 'empty' WHEN len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(string_split(nn, ' '), x))) = 0 THEN 'present' ELSE 'absent' END, 'required' FROM (SELECT *, list_filter(regexp_extract_all(counterparty, '[A-Z0-9]+'), lambda x: length(x) >= 3) AS w FROM claims)
UNION ALL SELECT id, 'amount', amount, CASE WHEN amount = '' THEN 'empty' WHEN list_contains(known, CAST(amount AS BIGINT)) OR list_contains({_RUNS}, CAST(CAST(amount AS BIGINT) // 100 AS VARCHAR)) THEN 'present' ELSE 'absent' END, 'required' FROM claims
UNION ALL SELECT id, 'payment_method', payment_method, CASE WHEN payment_method IN ('', 'unknown') THEN 'empty' WHEN {_METHOD_FOUND} THEN 'present' ELSE 'absent' END, 'advisory' FROM claims)"""


def claims(spark, sf_dir):
    b = flow.sources(spark, sf_dir).bank
    k = F.col("bank_ref").cast("bigint")
    return b.select(
        F.col("txn_id").alias("id"), "narration", F.col("normalized_narration").alias("normalized"), F.array("credit").alias("known"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "300000000001").otherwise(F.coalesce(F.get("utrs", F.lit(0)), F.lit(""))).alias("utr"),
        F.when(k % 5 == 0, "ACME HOLDINGS").otherwise(V.counterparty_guess(F.col("narration"))).alias("counterparty"),
        F.when(k % 3 == 0, F.col("credit") + 1).otherwise(F.col("credit")).cast("string").alias("amount"), F.when(k % 6 == 0, "card").otherwise(V.method_guess(F.col("narration"))).alias("payment_method"),
    )


def checked(spark, sf_dir):
    return flow.once(spark, sf_dir, "checked", lambda: V.provenance(claims(spark, sf_dir)))


def _pv(select):
    return O.sql("typed", select, _CLAIMS, _CHECKS)


@query(_pv("SELECT id, field, coalesce(value, '') AS value, verdict, policy FROM checks"))
def provenance_checks(spark, sf_dir):
    return V.provenance(claims(spark, sf_dir))


def _one_field(name):
    sql = _pv(f"SELECT id, value, verdict FROM checks WHERE field = '{name}'")

    def run(spark, sf_dir):
        return checked(spark, sf_dir).where(F.col("field") == name).select("id", "value", "verdict")

    return sql, run


for _name, _field in (("provenance_identifier", "utr"), ("provenance_name", "counterparty"), ("provenance_amounts", "amount"), ("provenance_method", "payment_method")):
    _sql, _run = _one_field(_field)
    _run.__name__ = _name
    query(_sql)(_run)


@query(_pv("SELECT id, array_to_string(list_sort(list(field || '=' || value)), '|') AS fields FROM checks WHERE NOT (verdict = 'absent' AND policy = 'required') AND verdict <> 'empty' GROUP BY id"))
def provenance_cleaned(spark, sf_dir):
    entries = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.cleaned(checked(spark, sf_dir)).select("id", F.array_join(F.sort_array(entries), "|").alias("fields"))


@query(_pv(f"SELECT field, {BIG} AS offered, CAST(count(*) FILTER (WHERE verdict <> 'empty') AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE verdict = 'absent') AS BIGINT) AS absent, round(count(*) FILTER (WHERE verdict <> 'empty') / CAST(count(*) AS DOUBLE), 6) AS claim_rate, round(coalesce(count(*) FILTER (WHERE verdict = 'absent') / CAST(nullif(count(*) FILTER (WHERE verdict <> 'empty'), 0) AS DOUBLE), 0), 6) AS failure_rate FROM checks GROUP BY field"))
def provenance_stats(spark, sf_dir):
    return V.provenance_stats(checked(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("claim_rate", "failure_rate")})


@query(O.sql("typed", f"SELECT txn_id, {_GUESS} AS guess FROM bnk"))
def counterparty_guess(spark, sf_dir):
    return flow.sources(spark, sf_dir).bank.select("txn_id", V.counterparty_guess(F.col("narration")).alias("guess"))


@query(O.sql("typed", f"SELECT txn_id, {_METHOD} AS guess FROM bnk"))
def method_guess(spark, sf_dir):
    return flow.sources(spark, sf_dir).bank.select("txn_id", V.method_guess(F.col("narration")).alias("guess"))


_MESSAGES = ("HTTP 429", "Rate exceeded", "read timed out", "connection reset", "502 bad gateway", "invalid key", "no such model")
_MSG = "split_part('" + "|".join(_MESSAGES) + f"', '|', CAST(o_orderkey % {len(_MESSAGES)} AS INT) + 1)"


@query(f"SELECT o_orderkey, regexp_matches(lower({_MSG}), '429|rate|timeout|timed out|connection|500|502|503|504') AS again FROM orders")
def retryable(spark, sf_dir):
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("o_orderkey") % len(_MESSAGES)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", V.retryable(message).alias("again"))


# One answer in four stops early, lacks fields, or claims too much.
_RAW = """(SELECT event_id, CASE event_id % 12 WHEN 0 THEN '{"id":"' || event_id WHEN 1 THEN '{"id":"' || event_id || '"}' WHEN 2 THEN '{"id":"' || event_id || '","counterparty_name":"' || event_type || '","parse_confidence":1.5}'
ELSE '{"id":"' || event_id || '","counterparty_name":"' || event_type || '","parse_confidence":0.' || event_id % 10 || '}' END AS raw FROM events)"""


@query(f"""SELECT event_id, CASE WHEN NOT coalesce(json_valid(raw), false) THEN 'LLM_MALFORMED_RESPONSE' WHEN json_extract_string(raw, '$.counterparty_name') IS NULL OR coalesce(CAST(json_extract_string(raw, '$.parse_confidence') AS DOUBLE), -1) NOT BETWEEN 0 AND 1
THEN 'LLM_SCHEMA_INVALID' ELSE 'ok' END AS outcome FROM {_RAW}""")
def json_decode_outcomes(spark, sf_dir):
    k, name = F.col("event_id") % 12, F.concat(F.lit('","counterparty_name":"'), "event_type")
    head = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"))
    good = F.concat(head, name, F.lit('","parse_confidence":0.'), (F.col("event_id") % 10).cast("string"), F.lit("}"))
    raw = F.when(k == 0, head).when(k == 1, F.concat(head, F.lit('"}'))).when(k == 2, F.concat(head, name, F.lit('","parse_confidence":1.5}'))).otherwise(good)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", V.decoded(raw)["outcome"].alias("outcome"))


@query()
def mock_provider(spark, sf_dir):
    return flow.sources(spark, sf_dir).bank.select("txn_id", V.mock_response(F.col("txn_id"), F.col("narration")).alias("raw"))


def _exchange(spark, sf_dir):
    """Items sent and what came back: one in 50 answers is lost, one in 50 comes twice."""
    b = flow.sources(spark, sf_dir).bank
    sent = b.select(F.col("txn_id").alias("id"), F.col("normalized_narration").alias("normalized"))
    k = F.col("bank_ref").cast("bigint") % 50
    answers = b.select(F.col("txn_id").alias("id"), V.mock_response(F.col("txn_id"), F.col("narration")).alias("raw"), k.alias("k"))
    return sent, answers.where("k <> 0").unionByName(answers.where("k = 1")).select("id", "raw")


# a table of answers: batches of 20 rows, of which some are cut short once or twice, and entries that are lost, doubled, renamed, or claim too much
_WORD = "list_filter(string_split(nn, ' '), lambda w: length(w) >= 3)[1]"
_ENTRY = """'{"id":"' || CASE WHEN k % 50 = 2 THEN 'X' ELSE '' END || txn_id || '","counterparty_name":"' || CASE WHEN k % 9 = 5 THEN 'ACME HOLDINGS' ELSE word END || '","parse_confidence":' || CASE WHEN k % 9 = 4 THEN '0.2' WHEN b % 17 = 3 AND k % 20 = 6 THEN '1.5' ELSE '0.9' END || '}'"""
_ANSWERS = f"""item AS (SELECT *, CAST(floor(k / 20.0) AS BIGINT) AS b FROM (SELECT txn_id, nn, {_WORD} AS word, CAST(bank_ref AS BIGINT) AS k FROM bnk)),
body AS (SELECT b, string_agg({_ENTRY}, ',' ORDER BY txn_id, copy) AS body FROM item, range(1, 3) c(copy) WHERE k % 50 <> 0 AND (copy = 1 OR k % 50 = 1) GROUP BY b),
answer AS (SELECT b, 1 AS attempt, '{{"results":[' || body || CASE WHEN b % 11 = 0 OR b % 13 = 0 THEN '' ELSE ']}}' END AS raw FROM body UNION ALL SELECT b, 2, '{{"results":[' || body || CASE WHEN b % 13 = 0 THEN '' ELSE ']}}' END FROM body WHERE b % 11 = 0 OR b % 13 = 0 OR b % 17 = 3),
read AS (SELECT *, CASE WHEN NOT json_valid(raw) THEN 'LLM_MALFORMED_RESPONSE' WHEN len(list_filter(CAST(json_extract(raw, '$.results[*].parse_confidence') AS DOUBLE[]), lambda x: x NOT BETWEEN 0 AND 1)) > 0 THEN 'LLM_SCHEMA_INVALID' ELSE 'ok' END AS code FROM answer),
chosen AS (SELECT * FROM read QUALIFY row_number() OVER (PARTITION BY b ORDER BY CASE WHEN attempt = 1 AND code = 'ok' THEN 3 ELSE attempt END DESC) = 1),
entry AS (SELECT b, id, count(*) AS n, min_by(conf, pos) AS conf, min_by(name, pos) AS name FROM (SELECT b, generate_subscripts(ids, 1) AS pos, unnest(ids) AS id, unnest(confs) AS conf, unnest(names) AS name FROM (
  SELECT b, json_extract_string(raw, '$.results[*].id') AS ids, CAST(json_extract(raw, '$.results[*].parse_confidence') AS DOUBLE[]) AS confs, json_extract_string(raw, '$.results[*].counterparty_name') AS names FROM chosen WHERE code = 'ok')) GROUP BY b, id)"""


def _answers(spark, sf_dir):
    k, b = F.col("k"), F.col("batch")
    word = F.get(F.filter(F.split("normalized_narration", " "), lambda w: F.length(w) >= 3), F.lit(0))
    rows = flow.sources(spark, sf_dir).bank.select("txn_id", "normalized_narration", word.alias("word"), F.col("bank_ref").cast("bigint").alias("k")).withColumn("batch", F.floor(k / 20))
    claim = F.when(k % 9 == 4, "0.2").when((b % 17 == 3) & (k % 20 == 6), "1.5").otherwise("0.9")
    entry = F.concat(F.lit('{"id":"'), F.when(k % 50 == 2, "X").otherwise(""), "txn_id", F.lit('","counterparty_name":"'), F.when(k % 9 == 5, "ACME HOLDINGS").otherwise(F.col("word")), F.lit('","parse_confidence":'), claim, F.lit("}"))
    copies = F.when(k % 50 == 0, F.array().cast("array<string>")).when(k % 50 == 1, F.array(entry, entry)).otherwise(F.array(entry))
    held = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("txn_id", copies.alias("c")))).alias("all")).select("batch", F.concat(F.lit('{"results":['), F.array_join(F.flatten(F.transform("all", lambda x: x["c"])), ",")).alias("body"))
    cut = [(b % 11 == 0) | (b % 13 == 0), b % 13 == 0]
    first, second = (held.select("batch", F.lit(n + 1).alias("attempt"), F.concat("body", F.when(c, "").otherwise("]}")).alias("raw")) for n, c in enumerate(cut))
    return rows.select("batch", F.col("txn_id").alias("id"), F.col("normalized_narration").alias("normalized")), first.unionByName(second.where((b % 11 == 0) | (b % 13 == 0) | (b % 17 == 3)))


@query(O.sql("typed", """SELECT i.b AS batch, i.txn_id AS id, CASE WHEN c.code IS NULL THEN 'LLM_TRANSPORT_FAILED' WHEN c.code <> 'ok' THEN c.code WHEN coalesce(e.n, 0) <> 1 THEN 'LLM_BATCH_MISMATCH' WHEN e.name = 'ACME HOLDINGS' THEN 'FIELD_PROVENANCE_FAILED'
WHEN e.conf < 0.35 THEN 'LOW_PARSE_CONFIDENCE' ELSE 'ok' END AS outcome, coalesce(c.attempt, 0) AS calls FROM item i LEFT JOIN chosen c ON i.b = c.b LEFT JOIN entry e ON i.b = e.b AND i.txn_id = e.id""", _ANSWERS))
def llm_envelope(spark, sf_dir):
    return V.envelope(*_answers(spark, sf_dir))[0].select("batch", "id", "outcome", "calls")


@query(O.sql("typed", "SELECT b AS batch, id, n AS entries FROM entry e WHERE NOT EXISTS (SELECT 1 FROM item i WHERE i.b = e.b AND i.txn_id = e.id)", _ANSWERS))
def llm_unexpected(spark, sf_dir):
    return V.envelope(*_answers(spark, sf_dir))[1]


_FAULT = "CASE WHEN k % 50 IN (0, 1) THEN 'LLM_BATCH_MISMATCH' WHEN k % 7 = 2 THEN 'LLM_SCHEMA_INVALID' ELSE 'ok' END"


@query(O.sql("typed", f"SELECT outcome, {BIG} AS n FROM (SELECT {_FAULT} AS outcome FROM (SELECT CAST(bank_ref AS BIGINT) AS k FROM bnk)) GROUP BY outcome"))
def llm_item_outcomes(spark, sf_dir):
    return _clean_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def _clean_outcomes(spark, sf_dir):
    """Answers that echo a word of the narration, but for lost, doubled and incomplete ones."""
    b = flow.sources(spark, sf_dir).bank.withColumn("k", F.col("bank_ref").cast("bigint"))
    sent = b.select(F.col("txn_id").alias("id"), F.col("normalized_narration").alias("normalized"))
    word = F.element_at(F.filter(F.split("normalized_narration", " "), lambda w: F.length(w) >= 3), 1)
    full = F.to_json(F.struct(F.col("txn_id").alias("id"), word.alias("counterparty_name"), F.lit(0.9).alias("parse_confidence")))
    answers = b.select(F.col("txn_id").alias("id"), "k", F.when(F.col("k") % 7 == 2, F.concat(F.lit('{"id":"'), "txn_id", F.lit('"}'))).otherwise(full).alias("raw"))
    back = answers.where("k % 50 <> 0").unionByName(answers.where("k % 50 = 1")).select("id", "raw")
    return V.item_outcomes(sent, back)


@query(O.sql("typed", f"SELECT round(avg(CASE WHEN outcome <> 'ok' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, round(avg(CASE WHEN outcome = 'LLM_BATCH_MISMATCH' THEN NULL WHEN outcome = 'LLM_SCHEMA_INVALID' THEN 1.0 ELSE 0.0 END), 6) AS schema_failure_rate FROM (SELECT {_FAULT} AS outcome FROM (SELECT CAST(bank_ref AS BIGINT) AS k FROM bnk))"))
def llm_rates(spark, sf_dir):
    bad = F.avg(F.when(F.col("outcome") != "ok", 1.0).otherwise(0.0))
    shape = F.avg(F.when(F.col("outcome") == "LLM_BATCH_MISMATCH", None).when(F.col("outcome").isin("LLM_SCHEMA_INVALID", "LLM_MALFORMED_RESPONSE"), 1.0).otherwise(0.0))
    return _clean_outcomes(spark, sf_dir).agg(F.round(bad, 6).alias("failure_rate"), F.round(shape, 6).alias("schema_failure_rate"))


@query("SELECT CAST(floor((rn - 1) / 4.0) AS INT) AS batch, CAST(count(*) AS BIGINT) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1")
def llm_usage(spark, sf_dir):
    rows = V.in_batches(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 4, "conv_id", "turn")
    return rows.groupBy("batch").agg(F.count("*").alias("items"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3.0) AS INT) AS batch FROM conversations")
def prompt_batches(spark, sf_dir):
    return V.in_batches(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 3, "conv_id", "turn").select("conv_id", "turn", "batch")


@query("SELECT conv_id, string_agg('<' || role || '> ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_render(spark, sf_dir):
    line = F.struct("turn", F.concat(F.lit("<"), "role", F.lit("> "), "text").alias("line"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


_LINES = "(SELECT o_orderkey AS entry, u.i AS line, CASE WHEN u.i = 1 THEN cents WHEN u.i = 3 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS debit, CASE WHEN u.i = 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN cents - 1 ELSE cents END WHEN u.i = 3 AND o_orderkey % 5 = 0 THEN 1 WHEN u.i = 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS credit FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), range(1, 4) u(i) WHERE u.i < 3 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)"


def _lines(spark, sf_dir):
    k, i = F.col("o_orderkey"), F.col("line")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", cents.alias("cents"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line")).where((i < 3) | (k % 3 == 0) | (k % 5 == 0))
    extra = (i == 3) & (k % 5 == 0)
    debit = F.when(i == 1, F.col("cents")).when(extra, 1).otherwise(0)
    credit = F.when(i == 2, F.when(k % 3 == 0, F.col("cents") - 1).otherwise(F.col("cents"))).when(extra, 1).when(i == 3, F.when(k % 3 == 0, 1).otherwise(0)).otherwise(0)
    return rows.select(k.alias("entry"), "line", debit.alias("debit"), credit.alias("credit"))


@query(f"SELECT entry, CAST(line AS INT) AS line, (debit <> 0) <> (credit <> 0) AS valid FROM {_LINES}")
def journal_line_valid(spark, sf_dir):
    return _lines(spark, sf_dir).select("entry", "line", V.line_valid().alias("valid"))


@query(f"SELECT entry, sum(debit) = sum(credit) AND sum(debit) > 0 AND count(*) >= 2 AND bool_and((debit <> 0) <> (credit <> 0)) AS balanced FROM {_LINES} GROUP BY entry")
def journal_balanced(spark, sf_dir):
    return V.balanced(_lines(spark, sf_dir))


_KEY = "sha256(coalesce(role, '') || chr(0) || coalesce(text, '') || chr(0))"


@query(f"SELECT CAST(count(*) AS BIGINT) AS asked, CAST(count(*) - count(DISTINCT key) AS BIGINT) AS hits FROM (SELECT {_KEY} AS key FROM conversations)")
def cache_hits(spark, sf_dir):
    """Requests answered from earlier ones with the same content."""
    keyed = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(S.sha_of(F.col("role"), F.coalesce("text", F.lit(""))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("asked"), F.sum(F.col("n") - 1).alias("hits"))


@query("""WITH c AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS asked FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY asked, event_id) - 1 AS i FROM c)
SELECT event_id, round(max(asked - i * 5400.0) OVER (PARTITION BY user_id ORDER BY asked, event_id) + i * 5400.0 - asked, 3) AS waited FROM n""")
def rate_limit_schedule(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("at"))
    return V.paced(calls, 5400.0, "user_id").select(F.col("seq").alias("event_id"), F.round(F.col("start") - F.col("at"), 3).alias("waited"))


@query("SELECT conv_id, turn, coalesce(lag(role) OVER w, last(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def rotate_field(spark, sf_dir):
    return V.rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"), "role", "conv_id", "turn")


# ---- synthesis
_SHARES = "(VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(synth.SHARES.items())) + ") t(case_type, share)"
_TARGET = f"SELECT case_type, share / sum(share) OVER () AS share FROM {_SHARES} WHERE case_type NOT IN ('tds_deducted', 'refund_netted')"


@query(f"SELECT case_type, round(share, 9) AS share FROM ({_TARGET})")
def target_shares(spark, sf_dir):
    return synth.target_shares(spark, ("tds_deducted", "refund_netted")).withColumn("share", F.round("share", 9))


@query(f"SELECT case_type, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, case_type) <= 4999 - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT case_type, floor(x) AS whole, x - floor(x) AS rest FROM (SELECT case_type, round(share * 4999, 9) AS x FROM ({_TARGET})))")
def allocate_counts(spark, sf_dir):
    return synth.allocated(synth.target_shares(spark, ("tds_deducted", "refund_netted")), 4999)


@query()
def generate_batch(spark, sf_dir):
    return synth.generate(spark, 5000, seed=42)


@query(O.sql("raw", "SELECT txn_id, value_date FROM raw_bank"))
def format_date(spark, sf_dir):
    """Typed dates written back in each bank's own notation."""
    b = flow.sources(spark, sf_dir).bank
    return b.select("txn_id", F.when(F.col("bank") == "HDFC", F.date_format("value_date", "dd/MM/yy")).otherwise(F.date_format("value_date", "dd-MM-yyyy")).alias("value_date"))


@query(O.sql("raw", f"SELECT case_type, {BIG} AS n, CAST(count(DISTINCT txn_id) AS BIGINT) AS credits FROM raw_truth GROUP BY case_type"))
def fixture_case_types(spark, sf_dir):
    return flow.raw(spark, sf_dir, "truth").groupBy("case_type").agg(F.count("*").alias("n"), F.countDistinct("txn_id").alias("credits"))


_LIST = lambda xs: "(SELECT unnest(['" + "', '".join(xs) + "']) AS v)"


@query(f"SELECT v || ' ' || ['Pvt Ltd', 'LLP', 'Private Limited', 'and Company'][CAST((n - 1) % 4 AS INT) + 1] AS customer_name, CAST(n AS INT) AS n FROM (SELECT a.v || ' ' || b.v AS v, row_number() OVER (ORDER BY a.v, b.v) AS n FROM {_LIST(synth.PLACES.split('|'))} a, {_LIST(synth.TRADES.split('|'))} b) WHERE n <= 2000")
def customer_pool(spark, sf_dir):
    return synth.customer_pool(spark)


# ---- decisions of people, in two logs
_DECISION = """decision AS (SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run_id, 'pay_' || CAST(o_custkey AS VARCHAR) AS entity_id, CASE o_orderkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'escalate' ELSE 'approve' END AS action, CAST(o_orderkey AS BIGINT) AS moment FROM orders)"""


@query(f"WITH {_DECISION} SELECT run_id, entity_id, max_by(action, moment) AS action, max(moment) AS moment, {BIG} AS decisions FROM decision GROUP BY run_id, entity_id")
def decisions_merged(spark, sf_dir):
    """The latest decision on each payment after two logs that overlap were made one."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"), F.concat(F.lit("pay_"), F.col("o_custkey").cast("string")).alias("entity_id"), F.when(k % 5 == 0, "reject").when(k % 5 == 1, "escalate").otherwise("approve").alias("action"),
        F.lit("clerk").alias("approver"), F.lit("").alias("note"), F.timestamp_seconds(k).alias("decided_at"))
    log = DecisionLog(spark, fresh_path(spark, "decisions"), fresh_path(spark, "decisions-fallback"))
    at = F.unix_seconds("decided_at")
    log.append(rows.where(at % 10 < 6))
    log.append(rows.where(at % 10 < 4))  # once more
    log.append(rows.where(at % 10 >= 3), sink="fallback")
    log.merge()
    counted = log.rows().groupBy("run_id", "entity_id").agg(F.count("*").alias("decisions"))
    return log.latest().join(counted, ["run_id", "entity_id"]).select("run_id", "entity_id", "action", F.unix_seconds("decided_at").alias("moment"), "decisions")
