"""Batches: three input relations and an answer key, read from CSV folders or derived from tables, typed at the edge."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.storage import unsent, written
from .fixture import raw_tables

# Columns of the exports; those a batch lacks are read as ''.
GATEWAY = ("entity_id", "type", "order_receipt", "settlement_id", "settlement_utr", "amount", "fee", "tax", "net_amount", "method", "settled_at")
BANK = ("txn_id", "value_date", "narration", "credit", "debit", "bank_ref", "bank")
INVOICES = ("invoice_id", "customer_name", "invoice_date", "due_date", "amount", "tds_applicable", "tds_section", "status")
TRUTH = ("invoice_id", "settlement_id", "txn_id", "case_type")
FILES = {"gateway": "gateway_settlements.csv", "bank": "bank_statement.csv", "invoices": "invoice_ledger.csv", "truth": "truth.csv"}
COLUMNS = {"gateway": GATEWAY, "bank": BANK, "invoices": INVOICES, "truth": TRUTH}
MOST_UPLOAD_BYTES = 32 << 20
#: Sets of names up to this number are broadcast.
MOST_NAMES = 1 << 16


@dataclass(frozen=True)
class Sources:
    invoices: DataFrame
    settlements: DataFrame
    bank: DataFrame
    truth: DataFrame | None = None

    @property
    def payments(self) -> DataFrame:
        return self.settlements.where(F.col("txn_type") == "payment")

    def ledger_of(self, *columns: str) -> DataFrame:
        """One invoice for each id, with these columns; of repeated ids the one that sorts last."""
        order = ("invoice_date", "customer_name", "amount")
        return self.invoices.groupBy("invoice_id").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("i")).select("invoice_id", *[f"i.{c}" for c in columns])

    @cached_property
    def _names(self) -> DataFrame | None:
        names = written(self.invoices.select(S.counterparty_key(F.col("customer_name")).alias("name_key")).distinct().where("name_key <> ''"), "names")
        return names if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES else None

    def named(self, keyed: DataFrame) -> DataFrame:
        """keyed without rows whose name_key no invoice has, which no join on names keeps, so they need not be shuffled; all where names are many."""
        return keyed if self._names is None else keyed.join(F.broadcast(self._names), "name_key", "left_semi")

    @cached_property
    def often(self) -> DataFrame:
        """(counterparty, _often): how many invoices each has; broadcast where they are few, else their rows would meet in a few heavy keys."""
        counted = written(self.invoices.where("counterparty <> ''").groupBy("counterparty").agg(F.count("*").alias("_often")), "often")
        return F.broadcast(counted) if counted.limit(MOST_NAMES + 1).count() <= MOST_NAMES else unsent(counted)

    @property
    def ledger(self) -> DataFrame:
        return self.ledger_of(*[c for c in self.invoices.columns if c != "invoice_id"])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def typed_invoices(raw: DataFrame) -> DataFrame:
    return raw.select(_text("invoice_id").alias("invoice_id"), _text("customer_name").alias("customer_name"), S.to_paise(F.col("amount")).alias("amount"), S.parse_date(F.col("invoice_date")).alias("invoice_date"), _text("tds_section").alias("tds_section"), _text("status").alias("status"), S.normalize_counterparty(F.col("customer_name")).alias("counterparty"))


def typed_settlements(raw: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    return raw.select(_text("entity_id").alias("entity_id"), _text("settlement_id").alias("settlement_id"), _text("settlement_utr").alias("utr"), _text("type").alias("txn_type"), _text("order_receipt").alias("invoice_id"), whole("amount"), whole("fee"), whole("tax"), whole("net_amount"), S.unix_to_date(F.col("settled_at")).alias("settled_date"), _text("method").alias("method"))


def derived_narration(df: DataFrame) -> DataFrame:
    """The columns that follow from narration."""
    normalized = S.normalize_narration(F.col("narration"))
    return df.withColumns({"utrs": S.extract_utrs(F.col("narration")), "tokens": S.narration_tokens(normalized), "normalized_narration": normalized})


def typed_bank(raw: DataFrame) -> DataFrame:
    return derived_narration(raw.select(_text("txn_id").alias("txn_id"), S.to_paise(F.col("credit")).alias("credit"), S.to_paise(F.col("debit")).alias("debit"), S.parse_date(F.col("value_date")).alias("value_date"), _text("narration").alias("narration"), _text("bank").alias("bank"), _text("bank_ref").alias("bank_ref")))


def typed(raw: dict[str, DataFrame]) -> Sources:
    return Sources(typed_invoices(raw["invoices"]), typed_settlements(raw["gateway"]), typed_bank(raw["bank"]), raw.get("truth"))


def derived_sources(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> Sources:
    return typed(raw_tables(spark, sf_dir, rows))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text by header, none inferred; empty fields are ''."""
    found = spark.read.csv(path, header=True)
    return found.select(*[_text(c).alias(c) if c in found.columns else F.lit("").alias(c) for c in columns])


def load_sources(spark: SparkSession, folder: str) -> Sources:
    return typed({t: read_csv(spark, f"{folder}/{FILES[t]}", COLUMNS[t]) for t in ("gateway", "bank", "invoices")})


def load_batch(spark: SparkSession, folder: str) -> Sources:
    """A batch with its answer key, which evaluation alone reads."""
    return replace(load_sources(spark, folder), truth=read_csv(spark, f"{folder}/{FILES['truth']}", TRUTH))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, lineSep="\n", emptyValue="", quoteAll=True)


def write_batch(raw: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    for t, df in raw.items():
        write_csv(df, f"{folder}/{FILES[t]}", COLUMNS[t])
    some = next(iter(raw.values()))
    some.sparkSession.createDataFrame([{k: str(v) for k, v in manifest.items()}]).write.mode("overwrite").json(f"{folder}/manifest.json")


def ingest(spark: SparkSession, files: dict[str, str], folder: str) -> Sources:
    """Three uploaded CSV files become a batch folder; empty or oversized files and an answer key are refused."""
    if set(files) != {"gateway", "bank", "invoices"}:
        raise ValueError("an upload is gateway, bank and invoices")
    for t, path in files.items():
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if not 0 < size <= MOST_UPLOAD_BYTES:
            raise ValueError(f"{t} has {size} bytes")
        write_csv(read_csv(spark, path, COLUMNS[t]), f"{folder}/{FILES[t]}", COLUMNS[t])
    return load_sources(spark, folder)


def sealed(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder) and sha256 of every file of a batch; files are hashed whole, a row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.substring_index("path", f"{folder.rstrip('/')}/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def integrity(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """One row: recorded files, whether all are as they were (null where none is recorded), and the names of those changed or gone."""
    met = recorded.join(now.withColumnRenamed("sha256", "_now"), "name", "left")
    changed = F.sort_array(F.collect_list(F.when(~F.col("sha256").eqNullSafe(F.col("_now")), F.col("name"))))
    return met.agg(F.count("*").alias("checked"), changed.alias("mismatched")).select("checked", F.when(F.col("checked") > 0, F.size("mismatched") == 0).alias("intact"), "mismatched")


PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("invoice_id", "settlement_id", "txn_id")] + [T.StructField("confidence", T.DoubleType())] + [T.StructField(c, T.StringType()) for c in ("layer", "entity_id")])
EXCEPTION = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "reason_code", "detail", "txn_id", "invoice_id")] + [T.StructField("confidence", T.DoubleType()), T.StructField("amount", T.LongType())])


class RunStore:
    """Runs in folders: predictions and exceptions as JSON lines, meta as one JSON row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, run_id: str) -> str:
        if not run_id or any(x in run_id for x in ("/", "\\", "..")):
            raise ValueError(f"unsafe run id {run_id!r}")
        return f"{self.root}/{run_id}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, run_id: str, predictions: DataFrame, exceptions: DataFrame, meta: dict) -> None:
        folder = self._folder(run_id)
        valid = F.col("confidence").between(0.0, 1.0)
        checked = predictions.withColumn("confidence", F.when(valid, F.col("confidence")).otherwise(F.raise_error(F.lit("confidence outside 0 to 1"))))
        checked.select(*PREDICTION.names).write.mode("overwrite").json(f"{folder}/predictions")
        exceptions.select(*EXCEPTION.names).write.mode("overwrite").json(f"{folder}/exceptions")
        self.spark.createDataFrame([{k: str(v) for k, v in meta.items()}]).write.mode("overwrite").json(f"{folder}/meta")

    def load(self, run_id: str) -> tuple[DataFrame, DataFrame, dict]:
        folder = self._folder(run_id)
        meta = self.spark.read.json(f"{folder}/meta").first().asDict()
        return self.spark.read.schema(PREDICTION).json(f"{folder}/predictions"), self.spark.read.schema(EXCEPTION).json(f"{folder}/exceptions"), meta

    def exists(self, run_id: str) -> bool:
        fs, p = self._fs(f"{self._folder(run_id)}/meta")
        return fs.exists(p)

    def list_runs(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self.exists(s.getPath().getName())) if fs.exists(p) else []

    def record_decision(self, run_id: str, entity_id: str, action: str, approver: str, note: str = "") -> None:
        """One human verdict, appended."""
        if action not in ("approve", "reject", "escalate"):
            raise ValueError(f"unknown action {action!r}")
        if not approver.strip():
            raise ValueError("an approver is needed")
        row = self.spark.createDataFrame([(run_id, entity_id, action, approver.strip(), note)], "run_id string, entity_id string, action string, approver string, note string")
        row.withColumn("decided_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self._folder(run_id)}/approvals")

    def decisions_for(self, run_id: str) -> DataFrame:
        return self.spark.read.schema("run_id string, entity_id string, action string, approver string, note string, decided_at timestamp").json(f"{self._folder(run_id)}/approvals")
