"""One-to-one assignment. Greedy assignment under a strict total order equals rounds in which every edge that is first for both of its ends
is taken and all edges at taken ends are dropped, until none is left. The first edge of all is taken in each round, so rounds end; a round is
two aggregations (a minimum at each end), whose results alone meet, and two anti-joins, written out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored, unsent
from ..sources.batch import Sources
from . import rules


def one_to_one(edges: DataFrame, left: str, right: str, order: list[Column | str]) -> DataFrame:
    """The edges that greedy assignment takes, least first by `order`, a strict total order of expressions that rise (but for repeated edges,
    of which one is taken). Parts of the order that are columns go by name, so that no row holds them twice: both minima sort all edges."""
    keyed = stored(edges, "edges")
    names = [c for c in order if isinstance(c, str)]
    first_by = [c if isinstance(c, str) else c.alias(f"_k{i}") for i, c in enumerate(order)]
    taken: list[DataFrame] = []
    while keyed.limit(1).count():
        least = lambda end, others: F.min(F.struct(*[c for c in first_by if not (isinstance(c, str) and c == end)], *[c for c in others if c != end and c not in names])).alias("_e")
        at_left = keyed.groupBy(left).agg(least(left, edges.columns)).select(left, "_e.*")
        at_right = keyed.groupBy(right).agg(least(right, [left])).select(right, f"_e.{left}")
        taken.append(stored(at_left.join(at_right, [left, right]).select(*edges.columns), "taken"))
        keyed = stored(keyed.join(taken[-1].select(left), left, "left_anti").join(taken[-1].select(right), right, "left_anti").select(*keyed.columns), "edges")
    return unsent(reduce(DataFrame.unionByName, taken)) if taken else edges.limit(0)


def _link_order() -> list[Column | str]:
    """Strongest first, then fewer days apart, then by ids."""
    return [-F.col("link_score"), F.abs(F.col("link_days")), "invoice_id", "entity_id"]


def resolved_pairs(pairs: DataFrame, sources: Sources, *columns: str) -> DataFrame:
    """The resolved links of pairs, one for each payment, with columns of the pairs. Links are told apart by payment and invoice alone until they
    are taken, and pairs with a receipt stay where they are."""
    own = pairs.where("invoice_id = ''").select(*rules.PAIR, *columns)
    taken = one_to_one(rules.open_links(pairs, sources, "entity_id"), "entity_id", "invoice_id", _link_order())
    return rules.given_links(pairs, *columns).unionByName(own.join(taken, "entity_id"))


def resolved_links(pairs: DataFrame, sources: Sources, run: Column | None = None) -> DataFrame:
    """Given receipts, then inferred links one to one, by _link_order. Invoices of receipts are not free.

    run: an expression of the pairs' ids that tells runs apart, each of which has all payments and invoices for itself."""
    given = rules.given_links(pairs)
    if run is None:
        return given.unionByName(one_to_one(rules.open_links(pairs, sources, *rules.PAIR), "entity_id", "invoice_id", _link_order()))
    ends = {name: F.concat_ws("/", run, F.col(c)) for name, c in (("_payment", "entity_id"), ("_bill", "invoice_id"))}
    free = rules.fitting_links(pairs, sources).withColumns(ends).join(unsent(given.withColumns(ends).select("_bill").distinct()), "_bill", "left_anti")
    return given.unionByName(one_to_one(free, "_payment", "_bill", _link_order()).select(*given.columns))


#: What orders candidates of equal probability, and what each part is called in the record; least first.
TIES = {"date proximity": "penalty", "rule tier": "_rule", "invoice link strength": "_link", "entity id": "entity_id", "transaction id": "txn_id"}


def _with_parts(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"_rule": -F.col("rule_score"), "_link": -F.col("link_score")})


def assigned(edges: DataFrame) -> DataFrame:
    """edges (entity_id, invoice_id, txn_id, p, penalty, rule_score, link_score) that assignment takes, most probable first and ties by TIES;
    with `rivals`, the candidates of other payments that share the best probability for the invoice, and `decided_by`, the first part in which
    the taken edge differs from the first of them ('' without rivals)."""
    order = [-F.col("p"), "penalty", -F.col("rule_score"), -F.col("link_score"), "entity_id", "txn_id", "invoice_id"]
    taken = _with_parts(one_to_one(edges, "entity_id", "invoice_id", order))
    best = edges.groupBy("invoice_id").agg(F.max("p").alias("p"))
    tied = _with_parts(edges).join(best, ["invoice_id", "p"]).select("invoice_id", F.struct(*TIES.values()).alias("rival"))
    against = tied.join(taken.select("invoice_id", F.col("entity_id").alias("holder")), "invoice_id").where(F.col("rival.entity_id") != F.col("holder"))
    counted = against.groupBy("invoice_id").agg(F.count("*").alias("rivals"), F.min("rival").alias("rival"))
    decided = F.when(F.col("rivals").isNull(), "")
    for name, part in TIES.items():
        decided = decided.when(F.col(part) != F.col(f"rival.{part}"), name)
    out = taken.join(counted, "invoice_id", "left")
    return out.select(*edges.columns, F.coalesce("rivals", F.lit(0)).alias("rivals"), decided.otherwise("identical on every component").alias("decided_by"))
