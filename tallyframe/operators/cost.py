"""Cost bands of an external model, priced per token between two published rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per million tokens in and out of the cheapest and dearest provider, rupees per USD, tokens an exception takes.
CHEAPEST, DEAREST, INR = (0.085, 0.40), (0.15, 0.65), 88.0
TOKENS_IN, TOKENS_OUT = 220, 168


def usd(tokens_in: Column, tokens_out: Column, rate: tuple[float, float]) -> Column:
    return tokens_in / F.lit(1e6) * rate[0] + tokens_out / F.lit(1e6) * rate[1]


def band(tokens_in: Column, tokens_out: Column) -> dict[str, Column]:
    low, high = usd(tokens_in, tokens_out, CHEAPEST), usd(tokens_in, tokens_out, DEAREST)
    return {"low_usd": low, "high_usd": high, "low_inr": low * INR, "high_inr": high * INR}


def per_thousand(tokens_in: Column, tokens_out: Column, settlements: Column) -> dict[str, Column]:
    scaled = lambda t: F.bround(t * F.lit(1000.0) / settlements)
    return band(scaled(tokens_in), scaled(tokens_out))
