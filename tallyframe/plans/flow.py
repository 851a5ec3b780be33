"""The reconciliation flow in steps; a step's table is written once a session and input folder, as stored runs are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored, unsent
from ..operators import blocking, matching, rules, subsetsum
from ..sources.batch import Sources, derived_sources
from ..sources.fixture import raw_rows, raw_tables

_KEPT: dict[tuple[str, str, str], DataFrame | Sources] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = stored(make(), name)
    return _KEPT[key]


def forget() -> None:
    """Make every step anew from here on."""
    _KEPT.clear()


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    """One object, which keeps its names. The key's ids are plain projections of the rows that are written, so they are read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, "sources")
    if key not in _KEPT:
        fresh = derived_sources(spark, sf_dir, once(spark, sf_dir, "rows", lambda: raw_rows(spark, sf_dir)))
        _KEPT[key] = Sources(*(once(spark, sf_dir, t, lambda t=t: getattr(fresh, t)) for t in ("invoices", "settlements", "bank")), unsent(fresh.truth))
    return _KEPT[key]


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return raw_tables(spark, sf_dir)[table]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "candidates", lambda: blocking.candidates(sources(spark, sf_dir)))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with their place. Candidates that no step has written go on to the scores as they are, still together by credit."""
    kept = _KEPT.get((spark.sparkContext.applicationId, sf_dir, "candidates"))
    make = lambda: rules.placed(rules.scored(blocking.candidates(sources(spark, sf_dir)) if kept is None else kept, sources(spark, sf_dir)))
    return once(spark, sf_dir, "scored", make)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).drop("place")


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments whose best pair is of the strictest tier."""
    return once(spark, sf_dir, "claimed", lambda: rules.surely_best(sources(spark, sf_dir)))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payment's best pair, from the scored pairs if a step has written them, else from those that decide it."""
    if (spark.sparkContext.applicationId, sf_dir, "scored") in _KEPT:
        return _placed(spark, sf_dir).where("place = 1").drop("place", "passes")
    key = (spark.sparkContext.applicationId, sf_dir, "best")
    if key not in _KEPT:  # tables already
        _KEPT[key] = rules.deciding_pairs(sources(spark, sf_dir))
    return _KEPT[key]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "best-links", lambda: rules.best_links(best(spark, sf_dir), sources(spark, sf_dir)))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "resolved", lambda: matching.resolved_links(best(spark, sf_dir), sources(spark, sf_dir)))


def with_batched(best: DataFrame, s: Sources) -> DataFrame:
    """The rules' pairs, and for payments that no rule settled those whose batch adds up to a credit."""
    batched = stored(subsetsum.batched_pairs(s, best), "batched")
    found = rules.joined_apart(batched, s)
    if "passes" in best.columns:
        found = found.withColumn("passes", F.array().cast("array<string>"))
    hit = {"rule": F.lit("subset_sum"), "rule_score": F.lit(rules.SUBSET_SUM), "layer": F.lit("subset_sum"), "penalty": rules.date_penalty()}
    return best.unionByName(stored(found.withColumns(hit), "found"))


def _confidence() -> Column:
    return F.round(F.col("rule_score") * F.col("link_score"), 4).alias("confidence")


def predicted(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    kept = pairs.select("entity_id", "txn_id", "rule", "rule_score", "layer")
    return linked.join(kept, ["entity_id", "txn_id"]).select("invoice_id", "settlement_id", "txn_id", "entity_id", "rule", "link_rule", "layer", _confidence())


def matched(pairs: DataFrame, s: Sources) -> DataFrame:
    """What predicted has of pairs, one for each payment, and of their resolved links, which take the pairs' columns with them."""
    return matching.resolved_pairs(pairs, s, "rule", "rule_score", "layer").select("invoice_id", "settlement_id", "txn_id", "entity_id", "rule", "link_rule", "layer", _confidence())


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' matches: each payment's best credit, and an invoice that no other payment has."""
    return once(spark, sf_dir, "predictions", lambda: matched(best(spark, sf_dir), sources(spark, sf_dir)))
