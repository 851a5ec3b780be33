"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern; each distinct word of a task is folded once, its bytes merged by ascending rank, and
remembered; a text's ids are its words' ids in order. Long words (runs without a break) are folded with a heap, so that time stays
near linear. Decoding looks every id's bytes up in a literal array and concatenates the pieces, as hexadecimal text that is
turned to binary once, in the JVM.

The rank table has a fixed size (MAX_RANK_BYTES at most, checked) and travels in the closure; its path is a parameter.

Defined results: null text encodes like the empty text, to no ids; decoding null ids gives empty bytes. Repeated rows are encoded
each for itself; columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

MAX_RANK_BYTES = 16 << 20
#: Words longer than this are folded with a heap and not remembered.
LONG = 64
_L, _N, _S = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9", r"\t-\r "
#: Texts of Latin letters and signs, on whose characters the classes of PLAIN equal Unicode's.
_PLAIN_TEXT = re.compile(rf"[{_L}\x00-\x1b!-~¡-©«-±´¶-¸»¿‐-‧€ ]*")
#: Patterns, and what equals them on such texts and needs no Unicode properties, so that Python's own matcher, which is faster, can run it.
PLAIN = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the adjacent pair of lowest rank, the leftmost of equals, becomes one piece."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _fold_long(word, ranks)
    cuts, rank, none = list(range(len(word) + 1)), ranks.get, 1 << 60
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(pairs):
            pairs[i] = rank(word[cuts[i] : cuts[i + 2]], none)
    return [ranks[word[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a linked list of pieces (start -> end) and a heap of pairs, of which outdated ones are passed over."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heap.append((r, i, j, end[j])) if not ready else heapq.heappush(heap, (r, i, j, end[j]))

    ready = False
    for i in range(n):
        push(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
            continue
        alive[j], end[i] = 0, k
        if k < n:
            before[k] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    split = regex.compile(pattern).findall
    if pattern not in PLAIN:
        return split
    plain, fast = _PLAIN_TEXT.fullmatch, re.compile(PLAIN[pattern]).findall
    return lambda text: fast(text) if plain(text) else split(text)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", most_words: int = 150_000) -> DataFrame:
    """docs with `ids`, the ids of each whole text without special tokens."""

    def make():
        split, known = splitter(pattern), {}

        def ids_of(word: str) -> list[int]:
            raw = word.encode("utf-8")
            found = fold(raw, ranks)
            if len(raw) <= LONG:
                if len(known) >= most_words:
                    known.clear()
                known[word] = found
            return found

        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            parts, ends, total = [], [0], 0
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                flat: list[int] = []
                for word in split(t) if t else ():
                    flat += known.get(word) or ids_of(word)
                parts.append(np.array(flat, np.int32))
                total += len(flat)
                ends.append(total)
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

        return columns_of

    return append_columns(docs, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encoded(text: Column, ranks: dict[bytes, int], pattern: str, buckets: int = 1 << 16) -> Column:
    """The ids by higher-order functions alone: each word that is no token folds its bytes, one ranked merge a step, by a literal array of hash
    buckets of ranks (buckets is a power of two). A word of n bytes takes n * n lookups, so `encode` is the form for long texts."""
    held: list[list[dict]] = [[] for _ in range(buckets)]
    for token, rank in ranks.items():
        held[xxhash.xxh64(token, seed=42).intdigest() % buckets].append({"k": base64.b64encode(token).decode(), "r": rank})
    table = F.from_json(F.lit(json.dumps(held)), "array<array<struct<k:binary,r:int>>>")  # a literal, folded to one array

    def rank_of(piece: Column) -> Column:
        bucket = F.get(table, F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int"))
        return F.get(F.transform(F.filter(bucket, lambda e: e["k"] == piece), lambda e: e["r"]), F.lit(0))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda j: _let(F.concat(F.get(parts, j), F.get(parts, j + 1)), rank_of))

        def joined(p: Column) -> Column:
            whole = F.array(F.concat(F.get(parts, p - 1), F.get(parts, p)))
            return F.when(p.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), p - 1), whole, F.slice(parts, p + 2, F.size(parts))))

        lowest = _let(pairs, lambda r: _let(F.array_position(r, F.array_min(r)).cast("int"), joined))
        return F.when(F.size(parts) < 2, parts).otherwise(lowest)

    def folded(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.octet_length(word))
        return F.transform(F.aggregate(places, F.transform(places, lambda i: F.substring(word, i, F.lit(1))), step), rank_of)

    def ids_of(word: Column) -> Column:
        return _let(word.cast("binary"), lambda w: _let(rank_of(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded(w))))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return F.flatten(F.transform(words, ids_of))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Binary column: the bytes of the ids, one after another."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")  # a literal, folded to one array
    return F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get(table, i)), ""))


def op4_byte_bpe(spark, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, ranks, pattern or public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))
