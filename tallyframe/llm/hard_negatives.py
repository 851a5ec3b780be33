"""Hard negatives by blocked matrix products.

Anchors are written in files of `block` rows; each file's anchors are broadcast in turn (block times vector size numbers), and every task
multiplies them with its own candidates, batch by batch, in float64, whose sums are exact below 2**53 (checked; beyond it in 64-bit integers,
and beyond those ValueError). The first pass keeps the best `n_positive` candidates of an anchor's label in each task, which merge by rank; the
second gets their scores with the anchors and keeps, for every anchor and positive, the best `n_negative` candidates of other labels inside
the window of scores that the positive allows. A task returns its best rows only, so what is shuffled follows tasks and anchors, not pairs.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part. Vectors of unequal sizes are
multiplied over the components that both have. Repeated rows count each for itself, anchors too; rows with an anchor's own id are no
positives of it. A null id is never an anchor, and comes last among equals. An empty table gives no rows. Columns other than the three named
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path
from .vectors import finite, matrix, scaled

#: Anchors multiplied at once; the id that stands for null, and the score for none.
TILE, NO_ID, NONE = 256, (1 << 63) - 1, 1 - (1 << 63)


class Best:
    """The best k candidates of each of n slots, over many batches: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.idents = np.full((n, k), NONE), np.full((n, k), NO_ID)

    def offer(self, slots: np.ndarray, scores: np.ndarray, fits: np.ndarray, idents: np.ndarray) -> None:
        """Rows of scores for these slots, of which those that fit compete."""
        k = self.scores.shape[1]
        fits = fits & (scores >= self.scores[slots, -1:])
        if scores.shape[1] > 4 * k and (many := np.flatnonzero(fits.sum(axis=1) > 4 * k)).size:
            some = np.where(fits[many], scores[many], NONE)
            fits[many] &= some >= np.partition(some, -k, axis=1)[:, -k][:, None]
        row, col = np.nonzero(fits)
        if not len(row):
            return
        some, row = np.unique(row, return_inverse=True)
        at = slots[some]
        group = np.concatenate([np.repeat(np.arange(len(at)), k), row])
        score = np.concatenate([self.scores[at].ravel(), scores[some[row], col]])
        ident = np.concatenate([self.idents[at].ravel(), idents[col]])
        order = np.lexsort((ident, -score, group))
        n = np.bincount(group, minlength=len(at))
        rank = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        first = order[rank < k]  # each slot has k at least, those that are none included
        self.scores[at], self.idents[at] = score[first].reshape(-1, k), ident[first].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores > NONE)
        return slot, self.scores[slot, place], self.idents[slot, place]


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    if exact:
        return (a[:, :n].astype(np.float64) @ b[:, :n].astype(np.float64).T).astype(np.int64)
    return a[:, :n] @ b[:, :n].T


def participants(df: DataFrame, vec_id: str, label: Column, vector: str, factor: int) -> DataFrame:
    """(id, label, v) of the rows that take part; the components of v are whole numbers."""
    return df.where(finite(F.col(vector)) & label.isNotNull()).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector), factor).alias("v"))


def _scan(rows: DataFrame, held, positives, low: int, high: int, k: int, exact: bool) -> DataFrame:
    """(anchor, slot, id, score): the best of each task. Without positives a slot is an anchor, its label's own candidates compete; with them
    (scores by anchor and slot) the candidates of other labels inside each one's window do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = held.value
        windows = positives.value if positives else None
        width = windows.shape[1] if positives else 1
        best = Best(len(ids) * width, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            c_ids, c_labels = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            v = matrix(batch.column(2))
            for t in range(0, len(ids), TILE):
                at = np.arange(t, min(t + TILE, len(ids)))
                s = _products(vectors[at], v, exact)
                same = labels[at][:, None] == c_labels
                if windows is None:
                    best.offer(at, s, same & (ids[at][:, None] != c_ids), c_ids)
                    continue
                for j in range(width):
                    p, there = windows[at, j, 0], windows[at, j, 1] > 0
                    # low * p <= 100 * s <= high * p, as bounds of s
                    least, most = -(-low * p // 100), high * p // 100
                    best.offer(at * width + j, s, there[:, None] & ~same & (s >= least[:, None]) & (s <= most[:, None]), c_ids)
        slot, score, ident = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(slot // width, pa.int32()), pa.array(slot % width, pa.int32()), pa.array(ident, pa.int64(), mask=ident == NO_ID), pa.array(score, pa.int64())], names=["anchor", "slot", "id", "score"])

    return rows.mapInArrow(run, "anchor int, slot int, id long, score long")


def _ranked(df: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90, block: int = 1 << 16) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from participants (id, label, v).

    A negative's score is between low and high hundredths of the positive's."""
    spark = rows.sparkSession
    path = fresh_path(spark, "anchors")
    size = rows.agg(F.max(F.size("v")).alias("size"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most"), F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).first()
    bound = (size["size"] or 0) * (size["most"] or 0) ** 2
    if max(low, high, 100) * bound >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit scores")
    exact = bound < 1 << 53
    rows.where(is_anchor).repartition(max(1, -(-size["anchors"] // block))).write.option("maxRecordsPerFile", block).parquet(path)
    schema = rows.schema
    dealt = rows.coalesce(max(1, -(-size["n"] // DEALT))) if rows.rdd.getNumPartitions() * DEALT > size["n"] else rows
    done = None
    for file in sorted(spark.read.schema(schema).parquet(path).inputFiles()):  # each has a block of rows at most
        anchors = spark.read.schema(schema).parquet(file).toArrow()
        ids, labels = anchors.column(0).to_numpy(), anchors.column(1).to_numpy()
        held = spark.sparkContext.broadcast((ids, labels, matrix(anchors.column(2))))
        found = fresh_path(spark, "positives")
        _ranked(_scan(dealt, held, None, low, high, n_positive, exact), n_positive).write.parquet(found)
        positives = spark.read.schema("anchor int, slot int, id long, score long, rank int").parquet(found)
        by_rank = positives.toArrow()  # n_positive rows an anchor of the block at most
        windows = np.zeros((len(ids), n_positive, 2), np.int64)
        at = by_rank.column("anchor").to_numpy(), by_rank.column("rank").to_numpy() - 1
        windows[*at, 0], windows[*at, 1] = by_rank.column("score").to_numpy(), 1
        out = fresh_path(spark, "negatives")
        negatives = _ranked(_scan(dealt, held, spark.sparkContext.broadcast(windows), low, high, n_negative, exact), n_negative)
        own = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(ids)), pa.int32()), "anchor_id": pa.array(ids, pa.int64())}))
        negatives.join(own, ["anchor", "slot"]).join(F.broadcast(names), "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(out)
        part = spark.read.schema(RESULT).parquet(out)
        done = part if done is None else done.unionByName(part)
    return done if done is not None else spark.createDataFrame([], RESULT)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Candidates that a task has at least, so that its best rows are few against them.
DEALT = 1 << 13


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(participants(rows, "vec_id", label, "embedding", 256), F.coalesce(F.col("id") % 100 == 0, F.lit(False)))


ORACLE = """with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score from kept a, kept c where a.vec_id % 100 = 0),
positive as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
  from positive p join scored n on n.anchor_id = p.anchor_id and not n.same and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10"""
