"""Centroid clustering in whole numbers, by sort-means.

In each round the distances between centroids are computed once, and each centroid's others are sorted by them. A vector is held against the
centroid of its last assignment, at a squared distance d, and against the others in the order of their distance from that one, until one lies
beyond twice the vector's own distance (squared: more than 4 * d); from there on the triangle inequality leaves none nearer, nor as near.

Rounds are passes over one table of integer vectors: a pass assigns, and sums each task's vectors by cluster before anything is shuffled, so
a hot cluster costs a row a task. Centroids (`clusters` times `size` numbers, MOST_CELLS at most) are all that reaches the driver. The
assignment of a round is written to the shared folder with the vectors, for the next to start from.

Defined results: vectors that are null, of another size, or hold a null or a non-finite component are left out; repeated rows count each for
itself; a null id is allowed and comes last among the first centroids; ties in the order of first centroids go to the smaller vector. With
fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows. Components beyond +-2**28 (after scaling,
for 64 of them) would not give exact 64-bit distances and raise ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, written
from .vectors import finite, matrix, scaled

#: Centroids times components that the driver holds.
MOST_CELLS = 1 << 24


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=-1)


def nearest(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, the smaller number of equals, given its last centroid; and how many distances that took."""
    between = _distances(centroids[:, None], centroids[None])
    cluster, distance, took = last.copy(), np.empty(len(x), np.int64), 0
    for c in np.unique(last):
        rows = np.flatnonzero(last == c)
        own = _distances(x[rows], centroids[c])
        far = np.argsort(-own, kind="stable")  # so the rows that go on are always the first ones
        rows, own = rows[far], own[far]
        best, at, took = own.copy(), np.full(len(rows), c), took + len(rows)
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            on = np.searchsorted(-4 * own, -between[c, other], side="right")
            if not on:
                break
            d = _distances(x[rows[:on]], centroids[other])
            better = (d < best[:on]) | ((d == best[:on]) & (other < at[:on]))
            best[:on][better], at[:on][better], took = d[better], other, took + on
        cluster[rows], distance[rows] = at, best
    return cluster, distance, took


def assigned(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """df with `cluster` renewed, `distance`, and `n_distances`, how many distances the search of its batch took, in the batch's first row."""

    def make():
        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            x = matrix(batch.column(batch.schema.get_field_index("v")), centroids.shape[1]).astype(np.int64)
            cluster, distance, took = nearest(x, batch.column(batch.schema.get_field_index("cluster")).to_numpy(), centroids)
            return [pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array([took] + [0] * (len(x) - 1) if len(x) else [], pa.int64())]

        return columns_of

    # the last assignment goes in as `cluster` and comes out renewed, so it is read under another name
    fields = [T.StructField("now", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n_distances", T.LongType())]
    return append_columns(df.drop("distance", "n_distances"), make, fields).drop("cluster").withColumnRenamed("now", "cluster")


def _sums(df: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors and counts of each cluster, exact."""

    def partial(batches):
        sums, counts = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            at = batch.column(1).to_numpy()
            np.add.at(sums, at, matrix(batch.column(0), size).astype(np.int64))
            counts += np.bincount(at, minlength=clusters)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = df.select("v", "cluster").mapInArrow(partial, "cluster int, n long, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    found = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((clusters, size), object), np.zeros(clusters, object)
    for r in found:
        sums[r["cluster"], r["i"]], counts[r["cluster"]] = int(r["s"]), r["n"]
    return sums, counts


def first_centroids(df: DataFrame, clusters: int, salt: Column) -> np.ndarray:
    found = df.select("v").orderBy(F.sha2(salt.cast("binary"), 256).asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in found], np.int64)


def clustered(df: DataFrame, vector: str, size: int, factor: int, clusters: int, rounds: int, salt: Column) -> tuple[DataFrame, np.ndarray]:
    """df's kept rows with `v` (integer vector), `cluster`, `distance`, and `n_distances` (see assigned); and the centroids. First centroids
    are the vectors whose `salt` text has the smallest SHA-256. Columns of df with these names are replaced, but for `vector`, which goes."""
    if clusters * size > MOST_CELLS:
        raise ValueError(f"{clusters} centroids of {size} components are more than {MOST_CELLS} numbers")
    kept = df.where(finite(F.col(vector)) & (F.size(vector) == size)).withColumn("_v", scaled(F.col(vector), factor))
    kept = kept.drop(vector, *({"v", "cluster", "distance", "n_distances", "now"} - {vector})).withColumnRenamed("_v", "v").withColumn("cluster", F.lit(0))
    table = written(kept, "vectors")
    most = table.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    if most and 4 * size * most * most >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit distances")
    centroids = first_centroids(table, clusters, salt)
    if not len(centroids):
        return table.withColumns({"distance": F.lit(0).cast("long"), "n_distances": F.lit(0).cast("long")}), centroids
    for _ in range(rounds):
        table = written(assigned(table, centroids), "assigned")
        sums, counts = _sums(table, len(centroids), size)
        held = counts > 0
        centroids = centroids.copy()
        centroids[held] = (sums[held] // counts[held, None]).astype(np.int64)
    return written(assigned(table, centroids), "assigned"), centroids


def op11_sort_means(spark, sf_dir: str, clusters: int = 16, rounds: int = 3) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, centroids = clustered(rows, "embedding", 64, 64, clusters, rounds, F.concat(F.lit("1:"), F.col("vec_id").cast("string")))
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()]) if len(centroids) else F.array(F.lit(""))
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row a centroid
    total = per.agg(F.coalesce(F.sum("cluster_inertia"), F.lit(0))).first()[0]
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"))


def _oracle(clusters: int = 16, rounds: int = 3, size: int = 64) -> str:
    """The rounds one after another, every vector held against every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (select k.row, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from kept k, c{r} c),
a{r} as (select row, cluster, distance from d{r} qualify row_number() over (partition by row order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} as (select cluster, i, sum(x) as s, count(*) as n from (select a.cluster, generate_subscripts(k.v, 1) as i, unnest(k.v) as x from a{r} a join kept k using (row)) group by all),
m{r} as (select cluster, list(((s - (((s % n) + n) % n)) // n)::bigint order by i) as v from s{r} group by cluster),
c{r + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (cluster))""")
    return f"""with kept as (select row_number() over (order by sha256('1:' || vec_id), v) as row, vec_id, v from
  (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size})),
c0 as (select (row - 1)::int as cluster, v from kept where row <= {clusters}),
{(',' + chr(10)).join(steps)}
select k.vec_id, a.cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join kept k using (row) join c{rounds} c using (cluster)"""


ORACLE = _oracle()
