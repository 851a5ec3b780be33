"""Line dedup with levelled sorted runs (built-in functions only).

Each batch of documents adds one run: the hashes of its distinct line keys with the number of its documents that hold them, sorted.
Before it is written it is merge-anti-joined with the earlier runs: keys that `min_docs` documents of one run hold are settled and
are not added again (unless the batch has an earlier first document for them). When a level holds `fanout` runs they are merged into one run of the
next level. Lines whose key stands in at least `min_docs` documents over all runs are dropped: rows meet the keys of such lines in one join.
Counts are exact below min_docs, and at least min_docs beyond.

With `keep_first` a repeated line stays in the document of the smallest id that holds it and is dropped from the others, so that a group of
copies keeps its text once.

A line's key is the line without spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns at its ends, with A-Z in lower
case. Keys are held as 96 bits of hash (64 and 32 bits of independent functions).

Defined results: null and empty text are one empty line; empty keys are never dropped; repeated rows count as documents of their own;
rows are matched with their dropped lines by a hash of the text (and by the id with keep_first, where null ids are never first, unless no
other holds the line), so null or repeated ids do no harm; an empty table adds an empty run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: Stands for a null id, which sorts last.
NO_ID = (1 << 63) - 1
RUN = "h long, g int, n long, first long"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone; text of one byte a code point takes the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line; the text is put in lower case as a whole, and only the stripping goes line by line."""
    return F.transform(lines_of(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(BLANKS)))


def key_hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.hash(key).alias("g")]


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _key_rows(docs: DataFrame, text: str, doc_id: str | None = None, places: bool = False) -> DataFrame:
    """A row for each document and distinct key: text hash t, id d, key (h, g); with places, one for each line, and its place i."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) if doc_id else F.lit(NO_ID)
    if places:
        return docs.select(_text_hash(F.col(text)).alias("t"), own.alias("d"), F.posexplode(line_keys(F.col(text))).alias("i", "k")).where("k <> ''").select("t", "d", "i", *key_hash(F.col("k")))
    keys = F.array_distinct(line_keys(F.col(text)))  # of strings, which Spark finds by a hash set
    return docs.select(_text_hash(F.col(text)).alias("t"), own.alias("d"), F.explode(keys).alias("k")).where("k <> ''").select("t", "d", *key_hash(F.col("k")))


class LineRuns:
    """Levels of sorted runs in the shared folder: key (h, g), documents n, smallest id of those."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_docs: int = 10):
        self.spark, self.fanout, self.min_docs, self.levels = spark, fanout, min_docs, [[]]

    def _write(self, counted: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "line-run")
        counted.sortWithinPartitions("h", "g").write.parquet(path)
        return self.spark.read.schema(RUN).parquet(path)

    def add(self, docs: DataFrame, text: str = "text", doc_id: str | None = None) -> None:
        found = _key_rows(docs, text, doc_id).groupBy("h", "g").agg(F.count("*").alias("n"), F.min("d").alias("first"))
        self.levels[0].append(self._write(self._unsettled(found)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level])))
            self.levels[level] = []
            level += 1

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _unsettled(self, found: DataFrame) -> DataFrame:
        """A batch's keys without those that a run has settled, by a merge of both sorted sides."""
        runs = self._runs()
        if not runs:
            return found
        settled = reduce(DataFrame.unionByName, runs).where(F.col("n") >= self.min_docs).select("h", "g", F.col("first").alias("_first")).alias("s")
        new = found.alias("f")
        known = (F.col("f.h") == F.col("s.h")) & (F.col("f.g") == F.col("s.g")) & (F.col("s._first") <= F.col("f.first"))
        return new.join(settled.hint("merge"), known, "left_anti")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def repeated(self) -> DataFrame:
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], RUN).drop("n")
        merged = runs[0] if len(runs) == 1 else self._merged(runs)
        return merged.where(F.col("n") >= self.min_docs).select("h", "g", "first")


def drop_lines(docs: DataFrame, repeated: DataFrame, text: str = "text", keep_first: str | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without the repeated lines); columns of these names are replaced.

    keep_first names the id column by which the first document of a line is told.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    met = _key_rows(docs, text, keep_first, places=True).join(repeated, ["h", "g"])
    met = met.where("d <> first") if keep_first else met
    dropped = met.groupBy("t", "d").agg(F.collect_set("i").alias("_dropped")).withColumnsRenamed({"t": "_t", "d": "_d"})
    own = F.coalesce(F.col(keep_first).cast("long"), F.lit(NO_ID)) if keep_first else F.lit(NO_ID)
    all_columns = [docs[c] for c in docs.columns]
    joined = docs.withColumns({"_t": _text_hash(F.col(text)), "_d": own}).join(dropped, ["_t", "_d"], "left")
    lines = lines_of(F.col(text))

    def without(x: Column) -> Column:
        """Lines at the places that are left; the difference goes by a hash set, so time grows with the lines."""
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_dropped"), lambda i: F.get(x, i))

    # a lambda over an array of one binds the lines, which are split once
    kept = F.when(F.col("_dropped").isNull(), lines).otherwise(F.get(F.transform(F.array(lines), without), F.lit(0)))
    out = joined.select(*all_columns, lines.alias("_lines"), kept.alias("_kept"))
    return out.select(*docs.columns, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, keep_first: str | None = None) -> DataFrame:
    """The whole of docs as one batch."""
    runs = LineRuns(docs.sparkSession, min_docs=min_docs)
    runs.add(docs, text, keep_first)
    return drop_lines(docs, runs.repeated(), text, keep_first)


def op8_line_dedup(spark, sf_dir: str, batches: int = 4) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files, runs = sorted(docs.inputFiles()), LineRuns(spark)
    for i in range(min(batches, len(files))):  # a batch is a share of the files, so the table is read once
        runs.add(spark.read.schema(docs.schema).parquet(*files[i :: min(batches, len(files))]))
    found = drop_lines(docs, runs.repeated())
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, u.i AS i, parts[u.i] AS line FROM d, unnest(range(1, len(parts) + 1)) AS u(i)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
hot AS (SELECT line_key FROM (SELECT DISTINCT doc_id, line_key FROM k) WHERE line_key <> '' GROUP BY line_key HAVING count(*) >= 10)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(h.line_key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE h.line_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.line_key = h.line_key GROUP BY k.doc_id
"""
