"""Synthetic batches: shares of case types, exact allocation, and rows drawn by hash, so any partition makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.fixture import PLACES, TRADES

# Case types and their target shares.
SHARES = {"clean": 0.55, "batched_settlement": 0.12, "fee_deducted": 0.10, "partial_payment": 0.06, "tds_deducted": 0.05, "refund_netted": 0.04, "date_skew": 0.03, "duplicate_utr": 0.02, "rounding_drift": 0.02, "orphan": 0.01}
POOL = 2000
SUFFIXES = ("Pvt Ltd", "LLP", "Private Limited", "and Company")


def target_shares(spark: SparkSession, exclude: tuple[str, ...] = ()) -> DataFrame:
    kept = spark.createDataFrame(sorted(SHARES.items()), "case_type string, share double").where(~F.col("case_type").isin(*exclude) if exclude else F.lit(True))
    return kept.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))  # one row a case type


def allocated(shares: DataFrame, rows: int) -> DataFrame:
    """(case_type, n) by largest remainder, ties by name."""
    exact = F.round(F.col("share") * rows, 9)
    parts = shares.select("case_type", F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("rest"))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "case_type"))
    short = F.lit(rows) - F.sum("whole").over(Window.partitionBy())
    return parts.select("case_type", (F.col("whole") + F.when(place <= short, 1).otherwise(0)).cast("bigint").alias("n"))


def draw(name: str, seed: int, key: str = "id") -> Column:
    """A number in 0 to 1 that follows from the row, the seed and the draw's name."""
    return S.md5_bucket(F.concat(F.lit(f"{seed}:{name}:"), F.col(key).cast("string")), 1 << 30) / float(1 << 30)


def customer_pool(spark: SparkSession) -> DataFrame:
    """POOL names at most: places by trades in their order, the suffix by the name's place in it. Fixed lists, so no data grows it."""
    pairs = [f"{p} {t}" for p in sorted(PLACES.split("|")) for t in sorted(TRADES.split("|"))][:POOL]
    return spark.createDataFrame([(f"{v} {SUFFIXES[i % len(SUFFIXES)]}", i + 1) for i, v in enumerate(pairs)], "customer_name string, n int")


def generate(spark: SparkSession, rows: int, seed: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """id, case_type, customer_name, amount, narration of a batch; case counts are exact."""
    counts = allocated(target_shares(spark, exclude), rows)
    upto = F.sum("n").over(Window.orderBy("case_type").rowsBetween(Window.unboundedPreceding, 0))
    edges = counts.withColumns({"high": upto}).withColumn("low", F.col("high") - F.col("n")).select("case_type", "low", "high")
    ids = spark.range(rows).join(F.broadcast(edges), (F.col("id") >= F.col("low")) & (F.col("id") < F.col("high"))).select("id", "case_type")
    pick = lambda values, u: F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))
    skewed = F.pow(draw("customer", seed), 2.5)  # few customers are billed often
    name = F.concat_ws(" ", pick(PLACES.split("|"), skewed), pick(TRADES.split("|"), draw("trade", seed)), pick(SUFFIXES, draw("suffix", seed)))
    normal = F.sqrt(-2 * F.ln(F.greatest(draw("u", seed), F.lit(1e-9)))) * F.cos(2 * F.lit(3.141592653589793) * draw("v", seed))
    listed = F.floor(F.exp(F.lit(13.5) + normal)) * 100
    amount = F.when(draw("round", seed) < 0.3, F.greatest(F.lit(100_000), F.floor(listed / 1_000_000) * 1_000_000)).otherwise(listed).cast("bigint")
    utr = F.lpad(F.floor(draw("utr", seed) * 1_000_000_000_000).cast("bigint").cast("string"), 12, "0")
    corrupt = F.when(draw("name", seed) < 0.2, F.substring(F.upper("customer_name"), 1, 14)).when(draw("name", seed) < 0.4, F.replace(F.upper("customer_name"), F.lit(" "), F.lit(""))).otherwise(F.upper("customer_name"))
    narration = F.when(draw("bank", seed) < 0.5, F.concat_ws("-", F.lit("NEFT CR"), corrupt, utr)).otherwise(F.concat_ws("/", F.lit("UPI"), utr, F.lower(corrupt), F.lit("okbank")))
    return ids.withColumn("customer_name", name).select("id", "case_type", "customer_name", amount.alias("amount"), narration.alias("narration"))
