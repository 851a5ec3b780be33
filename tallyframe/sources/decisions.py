"""Decisions of people on a run's exceptions: a log that takes each decision once, and a second one for when the first can't be written."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["run_id", "entity_id", "decided_at"]
DECISION = "run_id string, entity_id string, action string, approver string, note string, decided_at timestamp, stored_in string"
ACTIONS = ("approve", "reject", "edit", "escalate")
PRIMARY, FALLBACK = "primary", "fallback"


class DecisionLog:
    """Two folders of JSON lines. A decision is known by run, entity and time, so appending it again changes nothing, and merging the logs
    leaves no doubles. Each row says which log took it."""

    def __init__(self, spark: SparkSession, primary: str, fallback: str):
        self.spark, self.paths = spark, {PRIMARY: primary, FALLBACK: fallback}

    def _stored(self, sink: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[sink])
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            return self.spark.createDataFrame([], DECISION)
        return self.spark.read.schema(DECISION).json(self.paths[sink])

    def _write(self, rows: DataFrame, sink: str) -> None:
        known = self._stored(sink).select(*KEY)
        fresh = rows.dropDuplicates(KEY).join(known, KEY, "left_anti")
        fresh.select("run_id", "entity_id", "action", "approver", "note", "decided_at", F.lit(sink).alias("stored_in")).write.mode("append").json(self.paths[sink])

    def append(self, rows: DataFrame, sink: str = PRIMARY) -> str:
        """Name of the log that took the rows: the fallback if the primary could not. Unknown actions and decisions without an approver raise."""
        bad = rows.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | (F.trim(F.coalesce("approver", F.lit(""))) == "")).limit(1).count()
        if bad:
            raise ValueError("a decision needs a known action and an approver")
        if sink == PRIMARY:
            try:
                self._write(rows, PRIMARY)
                return PRIMARY
            except (PySparkException, Py4JJavaError):
                sink = FALLBACK
        self._write(rows, sink)
        return sink

    def rows(self) -> DataFrame:
        """Every decision once; of one that both logs hold, the primary's row."""
        both = self._stored(PRIMARY).unionByName(self._stored(FALLBACK))
        one = both.groupBy(*KEY).agg(F.max_by(F.struct("action", "approver", "note", "stored_in"), "stored_in").alias("d"))  # 'primary' sorts last
        return one.select(*KEY, "d.*")

    def latest(self) -> DataFrame:
        """The last decision on each entity of a run."""
        last = self.rows().groupBy("run_id", "entity_id").agg(F.max_by(F.struct("action", "approver", "note", "decided_at", "stored_in"), "decided_at").alias("d"))
        return last.select("run_id", "entity_id", "d.*")

    def merge(self) -> None:
        """Decisions that only the fallback holds go to the primary as well."""
        self._write(self._stored(FALLBACK), PRIMARY)
