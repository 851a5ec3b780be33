"""Similarities of names and narrations by insertions and deletions, which no built-in function has. The token-set ratio is a column expression:
what tokens the two share needs no comparison, and the rest is a longest common subsequence by bits of one long. The partial ratio compares
every stretch of the longer string with the shorter one, all stretches of an Arrow batch side by side."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters whose places fit the bits of a long that never overflows.
BITS = 62


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(direction: str, value: Column, places: Column) -> Column:
    return F.call_function(f"shift{direction}", value, places)


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _by_bits(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of letters, a of BITS at most: a letter of b moves all places of a at once."""
    full = _shift("left", F.lit(1).cast("long"), F.size(a)) - 1

    def step(masks: Column, kinds: Column):
        def of(s: Column, letter: Column) -> Column:
            hit = s.bitwiseAND(F.coalesce(F.get(masks, F.array_position(kinds, letter).cast("int") - 1), F.lit(0).cast("long")))
            return (s + hit).bitwiseOR(s - hit).bitwiseAND(full)

        return of

    def masks_of(kinds: Column) -> Column:
        return F.transform(kinds, lambda k: F.aggregate(F.transform(a, lambda x, i: F.when(x == k, _shift("left", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda m, x: m + x))

    return _let(F.array_distinct(a), lambda kinds: _let(masks_of(kinds), lambda masks: F.size(a) - F.bit_count(F.aggregate(b, full, step(masks, kinds)))))


def _by_rows(a: Column, b: Column) -> Column:
    """The same for arrays of any length: a row of lengths for each letter of a."""

    def row(before: Column, letter: Column) -> Column:
        def place(now: Column, j: Column) -> Column:
            met = F.get(before, j - 1) + F.when(F.get(b, j - 1) == letter, 1).otherwise(0)
            return F.concat(now, F.array(F.greatest(F.get(now, j - 1), F.get(before, j), met)))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), place)

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""

    def of(p: Column) -> Column:
        few, many = p["few"], p["many"]
        return F.when(F.size(few) == 0, 0).when(F.size(few) <= BITS, _by_bits(few, many)).otherwise(_by_rows(few, many))

    letters = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(_letters(t))
    ordered = F.when(F.char_length(a) <= F.char_length(b), F.struct(letters(a).alias("few"), letters(b).alias("many"))).otherwise(F.struct(letters(b).alias("few"), letters(a).alias("many")))
    return _let(ordered, of)


def token_set_ratio(name: str | Column, narration: str | Column) -> Column:
    """The best ratio among the shared tokens, and the shared tokens with either side's own; 0 if either has no token. Null is like ''."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (name, narration))
    tokens = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    text = lambda words: F.array_join(F.array_sort(words), " ")

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        parts = F.struct(text(F.array_intersect(x, y)).alias("both"), text(F.array_except(x, y)).alias("left"), text(F.array_except(y, x)).alias("right"))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(_let(parts, compared))

    def compared(s: Column) -> Column:
        both, left, right = (F.char_length(s[k]) for k in ("both", "left", "right"))
        some = both > 0
        shared = both + F.when(some, 1).otherwise(0)  # the shared words and the space behind them open both sides
        one, other = shared + left, shared + right
        rest = F.lit(2.0) * (shared + common_subsequence(s["left"], s["right"])) / (one + other)
        near = lambda n: F.lit(2.0) * both / (both + n)
        return F.when(some & ((left == 0) | (right == 0)), 1.0).when(some, F.greatest(rest, near(one), near(other))).otherwise(rest)

    return _let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), of)


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For each pair the best ratio of the shorter string to any stretch of the longer one that is no longer than it."""
    out = np.array([0.0 if a or b else 1.0 for a, b in pairs])
    sides = [(k, a, b) if len(a) <= len(b) else (k, b, a) for k, (a, b) in enumerate(pairs) if a and b]
    for k, short, long in [s for s in sides if len(s[1]) > BITS]:
        out[k] = max(_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))
    sides = [s for s in sides if len(s[1]) <= BITS]
    for begin in range(0, len(sides), STRETCHES // 64):
        some = sides[begin : begin + STRETCHES // 64]
        if some:
            out[[k for k, _, _ in some]] = _side_by_side([s for _, s, _ in some], [x for _, _, x in some])
    return out


#: About as many stretches are compared at once.
STRETCHES = 1 << 16


def _ratio(a: str, b: str) -> float:
    row = np.zeros(len(b) + 1, np.int64)
    letters = np.array(list(b))
    for c in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (letters == c)))
    return 2.0 * int(row[-1]) / (len(a) + len(b))


def _side_by_side(short: list[str], long: list[str]) -> np.ndarray:
    n, m = np.array([len(s) for s in short]), np.array([len(x) for x in long])
    codes = lambda texts, width: np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "replace"), "<u4"), (0, width - len(t))) for t in texts])
    wide = int(m.max())
    few, many = codes(short, int(n.max())), codes(long, wide)
    # places of each letter of the longer string in the shorter one, as bits
    masks = np.zeros(many.shape, np.uint64)
    for i in range(few.shape[1]):
        masks |= ((many == few[:, i : i + 1]) & (i < n)[:, None]).astype(np.uint64) << np.uint64(i)
    masks[np.arange(wide) >= m[:, None]] = 0
    # every stretch is a row: of pair p from place s, n letters, those before the first and after the last letter left out
    pair = np.repeat(np.arange(len(n)), n + m - 1)
    start = np.arange(len(pair)) - np.repeat(np.cumsum(n + m - 1) - (n + m - 1), n + m - 1) + 1 - n[pair]
    full = (np.uint64(1) << n[pair].astype(np.uint64)) - np.uint64(1)
    state = full.copy()
    for k in range(int(n.max())):
        at = start + k
        inside = (k < n[pair]) & (at >= 0) & (at < m[pair])
        hit = state & np.where(inside, masks[pair, np.clip(at, 0, wide - 1)], np.uint64(0))
        state = ((state + hit) | (state - hit)) & full
    common = n[pair] - np.bitwise_count(state).astype(np.int64)
    length = np.minimum(start + n[pair], m[pair]) - np.maximum(start, 0)
    best = np.zeros(len(n))
    np.maximum.at(best, pair, 2.0 * common / (n[pair] + length))
    return best


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    codes, pairs = pd.factorize(pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")]))
    return pd.Series(partial_ratios(list(pairs))[codes])
