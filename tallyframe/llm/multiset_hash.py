"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines). Every paragraph is hashed to a wide vector and a text's fingerprint is the sum of its
paragraphs' vectors modulo a power of two in each lane, so the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding
or subtracting its own fingerprint. A vector has two parts. EXACT lanes (modulo 2**16) come from a cryptographic digest of the paragraph and
decide equality. LIKENESS lanes (modulo 2**32, more than any text has shingles) add a +1/-1 sign vector for each three-word shingle of the paragraph; their inner products estimate shared
shingles, so the cosine of two texts' lanes is their likeness.

A fingerprint is written in base64, little endian: 32 exact lanes in two bytes each, then 128 likeness lanes in two bytes each if all fit, else
in four.

Defined results: null text counts as empty, a single empty paragraph; equal texts have equal fingerprints; likeness of equal fingerprints
is 1 and is never below 0. In `with_next`, ties of doc_id follow a hash of the text, then the text; null ids come last, and a lone document is
its own next; an empty table gives no rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX_A, MIX_B, WordHasher, append_columns, grouped, mixed, offsets_of

EXACT, LIKENESS = 32, 128
#: with_next cuts the ids at quantiles into blocks of about BLOCK_BYTES of text, at most MOST_BLOCKS; an id that fills a block by itself, and
#: null ids, are cut into SUB parts by a hash of the text.
MOST_BLOCKS, BLOCK_BYTES, SUB = 65_536, 4 << 20, 1_024


#: One bit in every byte; sums of at most 255 masked words keep each byte's count apart.
ONES, MOST_SUMMED = np.uint64(0x0101010101010101), 255


def _shingles(h: np.ndarray, para: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three-word shingles inside paragraphs, and the places of their first words; a shorter paragraph is one shingle."""
    n = len(h)
    nxt, nxt2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    same1, same2 = para[:-1] == para[1:], para[:-2] == para[2:]
    nxt[:-1][same1] = h[1:][same1]
    nxt2[:-2][same2] = h[2:][same2]
    use = np.ones(n, bool)
    use[1:] = ~same1
    use[:-2] |= same2
    s = mixed((mixed(h + MIX_A) + nxt) * MIX_B + nxt2)
    return s[use], np.flatnonzero(use)


def _bit_sums(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of words s in runs that start at cuts (each of MOST_SUMMED words at most): how often each of the 64 bits is set, by run."""
    out = np.empty((len(cuts), 8, 8), np.uint8)
    for k in range(8):
        out[:, :, k] = np.add.reduceat((s >> np.uint64(k)) & ONES, cuts).view(np.uint8).reshape(-1, 8)
    return out.reshape(-1, 64).astype(np.int64)


def _likeness_lanes(group: list[bytes], hasher: WordHasher) -> np.ndarray:
    """Sums of sign vectors of the shingles of each text."""
    out = np.zeros((len(group), LIKENESS), np.int64)
    raw = b"\n".join(group)
    h, starts = hasher.words(raw)
    if not len(h):
        return out
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    s, at = _shingles(h, np.searchsorted(breaks, starts))
    cut_at = np.searchsorted(starts[at], offsets_of(group))
    begins, ends = cut_at[:-1], cut_at[1:]
    full = np.flatnonzero(ends > begins)
    runs = -(-(ends[full] - begins[full]) // MOST_SUMMED)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    cuts = np.repeat(begins[full], runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * MOST_SUMMED
    set_bits = np.concatenate([_bit_sums(s, cuts), _bit_sums(mixed(s + MIX_B), cuts)], axis=1)
    out[full] = 2 * np.add.reduceat(set_bits, first, axis=0) - (ends[full] - begins[full])[:, None]
    return out


def vectors(texts: list[str | None], hasher: WordHasher) -> np.ndarray:
    """The lanes of each text, a row each."""
    exact, like = np.zeros((len(texts), EXACT), np.int64), np.zeros((len(texts), LIKENESS), np.int64)
    for begin, group in grouped(texts):
        like[begin : begin + len(group)] = _likeness_lanes(group, hasher)
        for k, raw in enumerate(group, begin):
            digests = b"".join([blake2b(line, digest_size=2 * EXACT).digest() for line in raw.split(b"\n")])
            exact[k] = np.frombuffer(digests, "<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.int64) & 0xFFFF
    return np.concatenate([exact, like], axis=1).astype(np.int32)


def written_out(lanes: np.ndarray) -> str:
    exact, like = lanes[:EXACT].astype("<u2"), lanes[EXACT:].astype("<i4")
    narrow = like.astype("<i2")
    return base64.b64encode(exact.tobytes() + (narrow if (narrow == like).all() else like).tobytes()).decode()


def lanes_of(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    like = np.frombuffer(raw[2 * EXACT :], "<i2" if len(raw) == 2 * (EXACT + LIKENESS) else "<i4")
    return np.concatenate([np.frombuffer(raw[: 2 * EXACT], "<u2"), like]).astype(np.int32)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b  # likeness lanes wrap at 2**32
    out[:EXACT] &= 0xFFFF
    return out


def add(a: str, b: str) -> str:
    """Fingerprint of the union of two multisets."""
    return written_out(_sum(lanes_of(a), lanes_of(b)))


def remove(a: str, b: str) -> str:
    return written_out(_sum(lanes_of(a), -lanes_of(b)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of lanes: 1 where all agree, else the cosine of the likeness lanes, at least 0."""
    x, y = (m[:, EXACT:].astype(np.float64) for m in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cos = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(a)), where=norm > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cos, 0.0, 1.0))


def fingerprints(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """docs with a fingerprint of each text column: {text column: new column}."""

    def make():
        hasher = WordHasher()

        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(list(map(written_out, vectors(batch.column(batch.schema.get_field_index(c)).to_pylist(), hasher))), pa.string()) for c in columns]

        return columns_of

    return append_columns(docs, make, [T.StructField(c, T.StringType()) for c in columns.values()])


def likenesses(docs: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """docs with the likeness of pairs of fingerprint columns: {new column: (one, other)}; null where either is null."""

    def make():
        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for pair in pairs.values():
                a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in pair)
                full = [k for k in range(len(a)) if a[k] and b[k]]
                got: list[float | None] = [None] * len(a)
                if full:
                    for k, v in zip(full, likeness(np.stack([lanes_of(a[k]) for k in full]), np.stack([lanes_of(b[k]) for k in full])), strict=True):
                        got[k] = float(v)
                out.append(pa.array(got, pa.float64()))
            return out

        return columns_of

    return append_columns(docs, make, [T.StructField(c, T.DoubleType()) for c in pairs])


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with next_<column> of the next row in descending doc_id, circularly; prepare may first add columns to the rows.

    The first row of each block is also sent to the block before it (the very first to the last block), so that every row finds its next
    within its own block after one shuffle.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, min(MOST_BLOCKS, -(-size // BLOCK_BYTES)))
    bounds = docs.agg(F.percentile_approx(doc_id, [(k + 1) / blocks for k in range(blocks - 1)], max(1000, 4 * blocks))).first()[0] if blocks > 1 else []
    counted = Counter(bounds or [])
    hot = [v for v, n in counted.items() if n > 1 and abs(v) < 1 << 53]
    cuts = sorted({float(v) for v in counted} | {float(v + 1) for v in hot})
    own = F.coalesce(F.col(doc_id).isin(hot), F.lit(False)) if hot else F.lit(False)
    split = F.col(doc_id).isNull() | own
    order_hash = F.xxhash64(text)
    docs = docs.withColumn("_at", F.col(doc_id).cast("double"))
    if cuts:
        docs = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(docs)
    else:
        docs = docs.withColumn("_bucket", F.lit(0.0))
    bucket = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int"))
    sub = F.when(split, F.shiftrightunsigned(order_hash.bitwiseXOR(F.lit(-(1 << 63))), 64 - SUB.bit_length() + 1)).otherwise(F.lit(0).cast("bigint"))
    docs = docs.withColumns({"_b": bucket, "_s": sub, "_h": order_hash, "_split": split}).drop("_at", "_bucket")
    # a block of one id starts at its least hash, others at their largest id
    heads = docs.groupBy("_b", "_s", "_split").agg(F.max(doc_id).alias("_head"), F.min("_h").alias("_least"))
    after = Window.orderBy(F.desc("_b"), "_s")  # one row a block
    last = Window.orderBy("_b", F.desc("_s"))
    ends = heads.select("_split", "_head", "_least", F.lag(F.struct("_b", "_s")).over(after).alias("_to"), F.first(F.struct("_b", "_s")).over(last).alias("_end"))
    ends = ends.select("_split", "_head", F.when(F.col("_split"), F.col("_least")).otherwise(0).alias("_least"), F.coalesce("_to", "_end").alias("_to"))
    keyed = docs.withColumn("_least", F.when(F.col("_split"), F.col("_h")).otherwise(0))
    peeks = keyed.join(F.broadcast(ends.withColumnsRenamed({"_split": "_split2", "_least": "_least2"})), F.col(doc_id).eqNullSafe(F.col("_head")) & (F.col("_least") == F.col("_least2")) & (F.col("_split") == F.col("_split2")))
    given = [c for c in docs.columns if c not in ("_b", "_s", "_split")]
    rows = docs.select(*given, "_b", "_s", F.lit(0).alias("_peek"))
    every = rows.unionByName(peeks.select(*given, F.col("_to._b").alias("_b"), F.col("_to._s").alias("_s"), F.lit(1).alias("_peek")))
    w = Window.partitionBy("_b", "_s").orderBy("_peek", F.col(doc_id).desc_nulls_last(), "_h", *columns)
    out = (prepare(every) if prepare else every).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("_peek = 0").drop("_b", "_s", "_h", "_peek")


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(docs, ["text", "fingerprint"], prepare=lambda rows: fingerprints(rows, {"text": "fingerprint"}))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))).drop("next_text")
    both = fingerprints(edited, {"edited": "edited_fingerprint"})
    found = likenesses(both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint"), {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
