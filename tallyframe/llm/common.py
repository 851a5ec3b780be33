"""Shared plumbing: the cluster's shared folder, Arrow column appending, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.storage import fresh_path, shared_dir, written  # noqa: F401


#: Rows that a worker turns into Python objects at once.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """df with columns computed per Arrow batch; columns of df that carry a new field's name are replaced."""
    names = [f.name for f in fields]
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = make()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns_of(batch)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(29))
    h = h * MIX_B
    return h ^ (h >> np.uint64(32))


#: The white space that parts words, by byte; and each byte's random value, the same for A-Z and a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _byte_values() -> np.ndarray:
    b = np.arange(256)
    return mixed(np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64) * MIX_A + MIX_B) | np.uint64(1)


class WordHasher:
    """64-bit hashes of all words of a byte string at once: differences of prefix sums of byte values times powers of an odd base, divided
    by the power at the word's start (odd numbers have inverses modulo 2**64), then mixed with the word's length."""

    def __init__(self):
        self.values, self.powers, self.inverses = _byte_values(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse)]))

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (A-Z as a-z) and the bytes at which they start."""
        a = np.frombuffer(raw, np.uint8)
        self._grow(len(a))
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~_SPACE[a]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.values[a] * self.powers[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * MIX_A), starts


def grouped(texts: list[str | None], most: int = 1 << 20):
    """(first place, encoded texts) of stretches of texts that hold about `most` bytes together."""
    begin, held, group = 0, 0, []
    for k, t in enumerate(texts):
        group.append((t or "").encode("utf-8", "replace"))
        held += len(group[-1]) + 1
        if held > most:
            yield begin, group
            begin, held, group = k + 1, 0, []
    if group:
        yield begin, group


def offsets_of(group: list[bytes]) -> np.ndarray:
    """Where each text starts when they are joined by one byte, and the end of all."""
    return np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])])
