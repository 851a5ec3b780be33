"""Scores of predictions against truth. The whole risk-coverage curve is one aggregation and one running window, not a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

TRIPLE = ["invoice_id", "settlement_id", "txn_id"]
HELD_OUT = ("tds_deducted", "refund_netted")
Z = 1.96


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """95% interval of a share, 0 to 1 without trials."""
    n, p = trials.cast("double"), successes / trials.cast("double")
    centre, spread = p + Z * Z / (2 * n), F.lit(Z) * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    below, above = (centre - spread) / (1 + Z * Z / n), (centre + spread) / (1 + Z * Z / n)
    return F.when(trials == 0, 0.0).otherwise(F.greatest(F.lit(0.0), below)), F.when(trials == 0, 1.0).otherwise(F.least(F.lit(1.0), above))


def judged(predictions: DataFrame, truth: DataFrame, invoices: DataFrame, bank: DataFrame) -> DataFrame:
    """Distinct triples at their largest confidence, with `right` and the money that each would post."""
    top = predictions.groupBy(*TRIPLE).agg(F.max("confidence").alias("confidence"))
    good = truth.where("case_type <> 'orphan'").select(*TRIPLE, F.lit(1).alias("right")).distinct()
    money = top.join(good, TRIPLE, "left").join(invoices.select("invoice_id", F.col("amount").alias("_billed")), "invoice_id", "left").join(bank.select("txn_id", F.col("credit").alias("_paid")), "txn_id", "left")
    return money.select(*TRIPLE, "confidence", F.coalesce("right", F.lit(0)).alias("right"), F.coalesce("_billed", "_paid", F.lit(0)).alias("money"))


def totals(truth: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: decidable triples, their money, orphans."""
    due = truth.join(invoices.select("invoice_id", "amount"), "invoice_id", "left")
    known = F.col("case_type") != "orphan"
    return due.agg(F.count(F.when(known, 1)).alias("n_decidable"), F.coalesce(F.sum(F.when(known, F.col("amount"))), F.lit(0)).alias("total_money"), F.countDistinct(F.when(~known, F.col("txn_id"))).alias("n_orphans"))


def rates() -> dict[str, Column]:
    """Rates over n_predicted, n_true, n_decidable, matched_money, wrong_money, total_money; empty sets count as perfect."""
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return {
        "coverage": share("n_predicted", "n_decidable", 0.0), "precision": share("n_true", "n_predicted", 1.0), "recall": share("n_true", "n_decidable", 0.0),
        "money_precision": F.when(F.col("matched_money") > 0, 1 - F.col("wrong_money") / F.col("matched_money")).otherwise(1.0), "money_error": share("wrong_money", "total_money", 0.0),
    }


def score_at(rows: DataFrame, truth: DataFrame, invoices: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and rates at a threshold."""
    kept = rows.where(F.col("confidence") >= threshold)
    wrong = 1 - F.col("right")
    sums = kept.agg(F.count("*").alias("n_predicted"), F.coalesce(F.sum("right"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("money"), F.lit(0)).alias("matched_money"), F.coalesce(F.sum(wrong * F.col("money")), F.lit(0)).alias("wrong_money"))
    refused = truth.where("case_type = 'orphan'").select("txn_id").distinct().join(kept.select("txn_id"), "txn_id", "left_anti").agg(F.count("*").alias("n_refused"))
    row = sums.join(totals(truth, invoices)).join(refused)  # one row each
    return row.withColumns(rates()).withColumns({"n_false": F.col("n_predicted") - F.col("n_true"), "refusal": F.when(F.col("n_orphans") > 0, F.col("n_refused") / F.col("n_orphans")).otherwise(1.0)})


def curve(rows: DataFrame, truth: DataFrame, invoices: DataFrame) -> DataFrame:
    """A row for each distinct confidence: counts and rates of all triples at or above it.

    The running sums go over one row a confidence (confidences have four decimals), so the window without partitions stays small.
    """
    wrong = 1 - F.col("right")
    level = rows.groupBy(F.col("confidence").alias("threshold")).agg(F.count("*").alias("n"), F.sum("right").alias("t"), F.sum("money").alias("m"), F.sum(wrong * F.col("money")).alias("w"))
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = level.select("threshold", *[F.sum(c).over(above).alias(name) for c, name in (("n", "n_predicted"), ("t", "n_true"), ("m", "matched_money"), ("w", "wrong_money"))])
    return out.join(totals(truth, invoices)).withColumns(rates())


CURVE = "threshold double, n_predicted long, n_true long, matched_money long, wrong_money long, n_decidable long, total_money long, n_orphans long, coverage double, precision double, recall double, money_precision double, money_error double"


def save_curve(points: DataFrame, path: str) -> None:
    """One JSON line a point, with the interval of its precision."""
    low, high = wilson(F.col("n_true"), F.col("n_predicted"))
    points.withColumns({"precision_low": F.round(low, 6), "precision_high": F.round(high, 6)}).write.mode("overwrite").json(path)


def load_curve(spark: SparkSession, path: str) -> DataFrame:
    """The points' own columns; others, of later writers, are not read."""
    return spark.read.schema(CURVE).json(path)


def outcome(predictions: DataFrame, payments: DataFrame, truth: DataFrame, invoices: DataFrame, bank: DataFrame, threshold: float) -> DataFrame:
    """One row on a run at a threshold: payments matched and left, coverage, precision with its interval, false matches and their money."""
    kept = predictions.where(F.col("confidence") >= threshold)
    wrong = 1 - F.col("right")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    sums = judged(kept, truth, invoices, bank).agg(F.count("*").alias("_n"), zero(F.sum("right")).alias("_t"), zero(F.sum(wrong * F.col("money"))).alias("wrong_money"))
    low, high = wilson(F.col("_t"), F.col("_n"))
    row = sums.join(kept.agg(F.countDistinct("entity_id").alias("matched"))).join(payments.agg(F.countDistinct("entity_id").alias("_all")))  # one row each
    return row.select(
        "matched", (F.col("_all") - F.col("matched")).alias("exceptions"), F.coalesce(F.try_divide("matched", "_all"), F.lit(0.0)).alias("coverage"), F.coalesce(F.try_divide("_t", "_n"), F.lit(1.0)).alias("precision"),
        low.alias("precision_low"), high.alias("precision_high"), (F.col("_n") - F.col("_t")).alias("false_matches"), "wrong_money",
    )


def confusion(rows: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    kept = rows.where(F.col("confidence") >= threshold)
    hit = kept.select(*TRIPLE, F.lit(1).alias("hit"))
    taken = kept.select("txn_id", F.lit(1).alias("taken")).distinct()
    met = truth.join(hit, TRIPLE, "left").join(taken, "txn_id", "left")
    orphan = F.col("case_type") == "orphan"
    matched = F.when(orphan, F.col("taken")).otherwise(F.col("hit")).isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return met.groupBy("case_type").agg(F.count("*").alias("total"), count(matched).alias("matched"), count(~matched & ~orphan).alias("missed"), count(~matched & orphan).alias("refused")).withColumn("held_out", F.col("case_type").isin(*HELD_OUT))


def report(rows: DataFrame, truth: DataFrame, invoices: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, scope, name, total, matched, missed, refused, money, matched_money): one pass over truth for all thresholds, counted over
    everything (scope 'all'), over seen and held-out types ('split') and by type ('case')."""
    hit = rows.select(*TRIPLE, F.col("confidence").alias("_hit"))
    taken = rows.groupBy("txn_id").agg(F.max("confidence").alias("_taken"))
    met = truth.join(hit, TRIPLE, "left").join(taken, "txn_id", "left").join(invoices.select("invoice_id", F.col("amount").alias("_due")), "invoice_id", "left")
    orphan, held = F.col("case_type") == "orphan", F.col("case_type").isin(*HELD_OUT)
    known = F.when(orphan, F.col("_taken")).otherwise(F.col("_hit"))
    at = met.select("case_type", held.alias("held_out"), orphan.alias("_orphan"), "_due", known.alias("_known"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    matched = F.coalesce(F.col("_known") >= F.col("threshold"), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    money = lambda c: F.coalesce(F.sum(F.when(c & ~F.col("_orphan"), F.col("_due"))), F.lit(0))
    sets = [["threshold"], ["threshold", "held_out"], ["threshold", "held_out", "case_type"]]
    scope = F.when(F.grouping("held_out") == 1, "all").when(F.grouping("case_type") == 1, "split").otherwise("case")
    out = at.groupingSets([[F.col(c) for c in s] for s in sets], "threshold", "held_out", "case_type").agg(
        scope.alias("scope"), F.count("*").alias("total"), count(matched).alias("matched"), count(~matched & ~F.col("_orphan")).alias("missed"), count(~matched & F.col("_orphan")).alias("refused"),
        money(F.lit(True)).alias("money"), money(matched).alias("matched_money"),
    )
    name = F.when(F.col("scope") == "all", "").when(F.col("scope") == "case", F.col("case_type")).when(F.col("held_out"), "held out").otherwise("seen")
    return out.select("threshold", "scope", name.alias("name"), "total", "matched", "missed", "refused", "money", "matched_money")


REPORT = "threshold double, scope string, name string, total long, matched long, missed long, refused long, money long, matched_money long"


def build_report(predictions: DataFrame, truth: DataFrame, invoices: DataFrame, bank: DataFrame, threshold: float, thresholds: tuple[float, ...], path: str) -> None:
    """Score, curve and counts by case type of a run, each as JSON lines in a folder of its own below path; the predictions are judged once."""
    rows = stored(judged(predictions, truth, invoices, bank), "judged")
    score_at(rows, truth, invoices, threshold).withColumn("threshold", F.lit(float(threshold))).write.mode("overwrite").json(f"{path}/score")
    save_curve(curve(rows, truth, invoices), f"{path}/curve")
    report(rows, truth, invoices, thresholds).write.mode("overwrite").json(f"{path}/cases")


SCORE = "threshold double, n_predicted long, n_true long, n_false long, n_decidable long, n_orphans long, n_refused long, total_money long, matched_money long, wrong_money long, coverage double, precision double, recall double, money_precision double, money_error double, refusal double"


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(score, curve, cases)."""
    return spark.read.schema(SCORE).json(f"{path}/score"), load_curve(spark, f"{path}/curve"), spark.read.schema(REPORT).json(f"{path}/cases")


def justified() -> Column:
    """Whether a reason's claim about what was available holds: reason_code, n_candidates, had_txn, had_invoice."""
    code = F.col("reason_code")
    return F.when(code == "NO_CANDIDATE", F.col("n_candidates") == 0).when(code.isin("NO_INVOICE_LINK", "INVOICE_ALREADY_CLAIMED"), ~F.col("had_invoice")).when(code.isin("BELOW_THRESHOLD", "LOW_CONFIDENCE", "AMBIGUOUS_CANDIDATES"), F.col("had_txn")).otherwise(True)
