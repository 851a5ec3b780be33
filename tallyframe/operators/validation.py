"""Checks around an external model: ids, JSON, provenance of fields, journals, caching and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile_ids(sent: DataFrame, back: DataFrame) -> DataFrame:
    """(id, verdict) of ids that were sent and are missing, came unexpected, or came back more than once."""
    counted = back.groupBy("id").agg(F.count("*").alias("n"))
    met = sent.select("id", F.lit(True).alias("asked")).distinct().join(counted, "id", "full_outer")
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "duplicated")
    return met.select("id", verdict.alias("verdict")).where("verdict is not null")


# ---- provenance of extracted fields
# Words that show a method, and words of narrations that are no names.
METHODS = {"upi": ("upi", "vpa", "@"), "neft": ("neft",), "imps": ("imps",), "rtgs": ("rtgs",), "card": ("card", "pos", "visa", "mastercard", "rupay"), "ach": ("ach", "nach", "mandate", "ecs")}
GUESSED = {"upi": ("upi", "@ok", "@ybl", "@paytm", "vpa"), "neft": ("neft",), "imps": ("imps",), "rtgs": ("rtgs",), "card": ("card", "pos", "visa", "mastercard"), "ach": ("ach", "nach", "mandate")}
NOISE = ("NEFT", "IMPS", "RTGS", "UPI", "ACH", "NACH", "REF", "TRF", "PMT", "INF", "PAYMENT", "SETTLEMENT", "TRANSFER", "CREDIT", "DEBIT", "BANK", "FROM")
PRESENT, ABSENT, EMPTY = "present", "absent", "empty"


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _verdict(value: Column, found: Column) -> Column:
    return F.when(_empty(value), EMPTY).when(F.coalesce(found, F.lit(False)), PRESENT).otherwise(ABSENT)


def check_identifier(value: Column, narration: Column) -> Column:
    """Digits must be a whole run of digits of the narration, anything else a stretch of it."""
    runs = F.regexp_extract_all(narration, F.lit("[0-9]+"), F.lit(0))
    return _verdict(value, F.when(value.rlike("^[0-9]+$"), F.array_contains(runs, value)).otherwise(F.contains(narration, value)))


def check_name(value: Column, normalized: Column) -> Column:
    """Every word of three characters or more must be a word of the narration; a name without one fails."""
    words = F.filter(F.regexp_extract_all(F.upper(value), F.lit("[A-Z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return _verdict(value, (F.size(words) > 0) & (F.size(F.array_except(words, F.split(normalized, " "))) == 0))


def check_amount(value: Column, known: Column, narration: Column) -> Column:
    """Paise must be a known amount, or their whole rupees a run of digits of the narration."""
    paise = value.try_cast("bigint")
    written = F.array_contains(F.regexp_extract_all(narration, F.lit("[0-9]+"), F.lit(0)), F.floor(paise / 100).cast("string"))
    return _verdict(value, F.array_contains(known, paise) | written)


def check_method(value: Column, narration: Column) -> Column:
    """A method needs one of its words; unknown is no claim."""
    lowered = F.lower(narration)
    found = F.lit(False)
    for method, words in METHODS.items():
        for w in words:
            found = found | ((value == method) & F.contains(lowered, F.lit(w)))
    return F.when(value == "unknown", EMPTY).otherwise(_verdict(value, found))


def provenance(items: DataFrame) -> DataFrame:
    """A row for each item and field with its verdict. items: id, narration, normalized, known (paise), and the fields as text."""
    checks = {
        "utr": check_identifier(F.col("utr"), F.col("narration")), "counterparty": check_name(F.col("counterparty"), F.col("normalized")),
        "amount": check_amount(F.col("amount"), F.col("known"), F.col("narration")), "payment_method": check_method(F.col("payment_method"), F.col("narration")),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), check.alias("verdict"), F.lit("advisory" if name == "payment_method" else "required").alias("policy")) for name, check in checks.items()])
    return items.select("id", F.explode(rows).alias("r")).select("id", "r.*")


def cleaned(checked: DataFrame) -> DataFrame:
    """(id, fields) without those that failed a required check."""
    kept = checked.where("not (verdict = 'absent' and policy = 'required') and verdict <> 'empty'")
    return kept.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def provenance_stats(checked: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    claims, absent = count(F.col("verdict") != EMPTY), count(F.col("verdict") == ABSENT)
    return checked.groupBy("field").agg(F.count("*").alias("offered"), claims.alias("claims"), absent.alias("absent"), F.try_divide(claims, F.count("*")).alias("claim_rate"), F.coalesce(F.try_divide(absent, claims), F.lit(0.0)).alias("failure_rate"))


def counterparty_guess(narration: Column) -> Column:
    """The first two words of letters that are no noise."""
    words = F.filter(F.split(F.regexp_replace(narration, "[^A-Za-z0-9]+", " "), " "), lambda w: w.rlike("^[A-Za-z]{3,}$") & ~F.upper(w).isin(*NOISE))
    return F.upper(F.array_join(F.slice(words, 1, 2), " "))


def method_guess(narration: Column) -> Column:
    """The first method of which the narration holds a word; narrower words than those that prove a claimed method."""
    lowered, out = F.lower(narration), F
    for method, words in GUESSED.items():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(lowered, F.lit(w))
        out = out.when(held, method)
    return out.otherwise("unknown")


def retryable(message: Column) -> Column:
    # What marks an error that may pass.
    return F.lower(message).rlike("429|rate|timeout|timed out|connection|500|502|503|504")


# ---- responses as JSON
RESPONSE = "id string, counterparty_name string, parse_confidence double"
CONFIDENCE_FLOOR = 0.35


def decoded(raw: Column) -> dict[str, Column]:
    """parsed, and outcome: LLM_MALFORMED_RESPONSE if not JSON, LLM_SCHEMA_INVALID if fields lack or stray, else ok."""
    valid_json = F.call_function("try_parse_json", raw).isNotNull()
    parsed = F.from_json(raw, RESPONSE)
    complete = parsed["id"].isNotNull() & parsed["counterparty_name"].isNotNull() & F.coalesce(parsed["parse_confidence"].between(0.0, 1.0), F.lit(False))
    return {"parsed": parsed, "outcome": F.when(~F.coalesce(valid_json, F.lit(False)), "LLM_MALFORMED_RESPONSE").when(~complete, "LLM_SCHEMA_INVALID").otherwise("ok")}


def item_outcomes(sent: DataFrame, back: DataFrame) -> DataFrame:
    """One outcome for each item sent. sent: id, normalized; back: id, raw."""
    counted = back.groupBy("id").agg(F.count("*").alias("n"), F.min("raw").alias("raw"))
    met = sent.join(counted, "id", "left")
    d = decoded(F.col("raw"))
    name = check_name(d["parsed"]["counterparty_name"], F.col("normalized"))
    outcome = F.when(F.coalesce("n", F.lit(0)) != 1, "LLM_BATCH_MISMATCH").when(d["outcome"] != "ok", d["outcome"]).when(name == ABSENT, "FIELD_PROVENANCE_FAILED").when(d["parsed"]["parse_confidence"] < CONFIDENCE_FLOOR, "LOW_PARSE_CONFIDENCE").otherwise("ok")
    return met.select("id", outcome.alias("outcome"))


ENVELOPE = "results array<struct<id: string, counterparty_name: string, parse_confidence: double>>"


def chosen_answers(answers: DataFrame) -> DataFrame:
    """(batch, code, calls, results): of each batch the first answer if it can be read, else its one retry. answers: batch, attempt, raw."""
    parsed = F.from_json("raw", ENVELOPE)["results"]
    whole = F.forall(parsed, lambda r: r["id"].isNotNull() & r["counterparty_name"].isNotNull() & F.coalesce(r["parse_confidence"].between(0.0, 1.0), F.lit(False)))
    valid = F.call_function("try_parse_json", F.col("raw")).isNotNull()
    code = F.when(~F.coalesce(valid, F.lit(False)), "LLM_MALFORMED_RESPONSE").when(~F.coalesce(whole, F.lit(False)), "LLM_SCHEMA_INVALID").otherwise("ok")
    rows = answers.where("attempt in (1, 2)").select("batch", "attempt", parsed.alias("results"), code.alias("code"))
    use = F.when((F.col("attempt") == 1) & (F.col("code") == "ok"), 3).otherwise(F.col("attempt"))
    best = rows.groupBy("batch").agg(F.max_by(F.struct("code", F.col("attempt").alias("calls"), "results"), use).alias("a"))
    return best.select("batch", "a.*")


def envelope(items: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes (batch, id, outcome, detail, calls, counterparty_name) of all items, and (batch, id, entries) of ids that nobody sent.

    items: batch, id, normalized. The first entry of an id has the slot, but an id with more than one is refused, since one of them describes
    something else; ids without an entry too. A batch without an answer, or whose answer and retry can't be read, fails for all its items.
    """
    chosen = chosen_answers(answers)
    entries = chosen.where("code = 'ok'").select("batch", F.posexplode("results").alias("pos", "e")).groupBy("batch", F.col("e.id").alias("id")).agg(F.count("*").alias("entries"), F.min_by("e", "pos").alias("e"))
    met = items.join(chosen.drop("results"), "batch", "left").join(entries, ["batch", "id"], "left")
    name, code = F.col("e.counterparty_name"), F.coalesce("code", F.lit("LLM_TRANSPORT_FAILED"))
    cases = [
        (code != "ok", code, F.lit("the batch has no answer that can be read")), (F.col("entries").isNull(), F.lit("LLM_BATCH_MISMATCH"), F.lit("no entry for this row")), (F.col("entries") > 1, F.lit("LLM_BATCH_MISMATCH"), F.lit("more than one entry for this row")),
        (check_name(name, F.col("normalized")) == ABSENT, F.lit("FIELD_PROVENANCE_FAILED"), F.lit("the name is not in the narration")), (F.col("e.parse_confidence") < CONFIDENCE_FLOOR, F.lit("LOW_PARSE_CONFIDENCE"), F.lit("")),
    ]
    outcome, detail = F, F
    for condition, value, text in cases:
        outcome, detail = outcome.when(condition, value), detail.when(condition, text)
    out = met.withColumns({"outcome": outcome.otherwise("ok"), "detail": detail.otherwise("")})
    kept = F.when(F.col("outcome") == "ok", name).otherwise("")
    return out.select("batch", "id", "outcome", "detail", F.coalesce("calls", F.lit(0)).alias("calls"), kept.alias("counterparty_name")), entries.join(items.select("batch", "id"), ["batch", "id"], "left_anti").select("batch", "id", "entries")


def mock_response(item_id: Column, narration: Column) -> Column:
    """What a plausible parser would answer, with faults on a fixed share of items."""
    fault = F.pmod(F.crc32(item_id.cast("binary")), F.lit(40))
    good = F.to_json(F.struct(item_id.alias("id"), counterparty_guess(narration).alias("counterparty_name"), F.round(F.pmod(F.crc32(F.concat(item_id, F.lit("c")).cast("binary")), F.lit(100)) / 100.0, 2).alias("parse_confidence")))
    return F.when(fault == 0, F.lit("I could not parse this.")).when(fault == 1, F.concat(F.lit('{"id":"'), item_id, F.lit('"}'))).when(fault == 2, F.to_json(F.struct(item_id.alias("id"), F.lit("ACME HOLDINGS").alias("counterparty_name"), F.lit(0.9).alias("parse_confidence")))).otherwise(good)


# ---- journals, pacing, batches
def line_valid() -> Column:
    return (F.col("debit") >= 0) & (F.col("credit") >= 0) & ((F.col("debit") != 0) != (F.col("credit") != 0))


def balanced(lines: DataFrame) -> DataFrame:
    """(entry, balanced): debits equal credits and are not nil, over at least two valid lines."""
    sums = lines.groupBy("entry").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n"), F.bool_and(line_valid()).alias("ok"))
    return sums.select("entry", ((F.col("d") == F.col("c")) & (F.col("d") > 0) & (F.col("n") >= 2) & F.col("ok")).alias("balanced"))


def paced(calls: DataFrame, interval: float, by: str | None = None) -> DataFrame:
    """calls (at, seq) with `start`: evenly spaced slots, start = max(at, last start + interval), in closed form. by: one schedule a key."""
    w = Window.partitionBy(*([by] if by else [])).orderBy("at", "seq")
    i = (F.row_number().over(w) - 1).cast("double")
    free = F.max(F.col("at") - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("_i", i).withColumn("start", free + F.col("_i") * interval).drop("_i")


def in_batches(items: DataFrame, size: int, by: str, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return items.withColumn("batch", F.floor(n / size).cast("int"))


def rotated(items: DataFrame, field: str, by: str, order: str) -> DataFrame:
    """The field of the row before, the last one's for the first."""
    w = Window.partitionBy(by).orderBy(order)
    last = F.last(field).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return items.withColumn(field, F.coalesce(F.lag(field).over(w), last))
