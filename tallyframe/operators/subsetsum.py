"""Batched payouts: which payments of a settlement add up to a credit.

A bucket is a settlement's open payments. All sums of two to five of its members are made once, as rows numbered in the order in which a
search would try them (fewer members first, then by place), and meet the credits by an equi-join on spans of paise and weeks, so what is
shuffled follows sums and credits, not their product. A bucket takes the first credit, by day and then by id, that any of its sums explains,
and of those sums the first. Buckets over the cap are reported, not searched.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.storage import stored, unsent
from ..sources.batch import Sources
from .blocking import SPAN

# The search's bounds.
MOST_MEMBERS, MOST_BUCKET = 5, 25
#: A subset is a number of digits of this base, the places of its members from 1.
DIGITS = 5


def buckets(sources: Sources, claimed: DataFrame) -> DataFrame:
    """Unclaimed payments of settlements that have several, with the bucket's size and first date (that of the smallest id)."""
    free = sources.payments.join(claimed.select("entity_id"), "entity_id", "left_anti")
    sized = free.groupBy("settlement_id").agg(F.count("*").alias("members"), F.min_by("settled_date", "entity_id").alias("anchor")).where("members >= 2")
    return free.select("settlement_id", "entity_id", "net_amount").join(unsent(sized), "settlement_id")


def capped(sources: Sources, claimed: DataFrame) -> DataFrame:
    """(entity_id) of the open payments of buckets that are over the cap of the search."""
    return buckets(sources, claimed).where(F.col("members") > MOST_BUCKET).select("entity_id")


def batched_pairs(sources: Sources, claimed: DataFrame) -> DataFrame:
    """(settlement_id, entity_id, txn_id) of the payments of which a subset explains a credit."""
    return subsets(sources, claimed).select("settlement_id", F.explode(F.split("subset", r"\|")).alias("entity_id"), "txn_id")


def credits(sources: Sources) -> DataFrame:
    return sources.bank.where("credit > 0 and value_date is not null").select("txn_id", "credit", "value_date")


def _held(sources: Sources, claimed: DataFrame) -> DataFrame:
    """One row a bucket under the cap: anchor, and m, its members (place, entity_id, net) by id."""
    rows = buckets(sources, claimed).where((F.col("members") <= MOST_BUCKET) & F.col("anchor").isNotNull())
    m = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "net_amount"))), lambda x, i: F.struct((i + 1).alias("place"), x["entity_id"].alias("entity_id"), x["net_amount"].alias("net")))
    return rows.groupBy("settlement_id").agg(F.first("anchor").alias("anchor"), m.alias("m"))


def _sums(held: DataFrame) -> DataFrame:
    """(settlement_id, anchor, nth, total, code): every sum of two to MOST_MEMBERS members, numbered in the order of the search."""
    row = lambda total, place, code: F.struct(total.alias("total"), place.alias("last"), code.alias("code"))
    m = F.col("m")
    levels = [F.transform(m, lambda x: row(x["net"], x["place"], x["place"].cast("long")))]
    for _ in range(MOST_MEMBERS - 1):
        longer = lambda s: F.transform(F.slice(m, s["last"] + 1, F.lit(MOST_BUCKET)), lambda x: row(s["total"] + x["net"], x["place"], F.shiftleft(s["code"], DIGITS) + x["place"]))
        levels.append(F.flatten(F.transform(F.col(f"level{len(levels)}"), longer)))
        held = held.withColumn(f"level{len(levels) - 1}", levels[-2])
    held = held.withColumn(f"level{MOST_MEMBERS}", levels[-1])
    return held.select("settlement_id", "anchor", F.posexplode(F.concat(*[F.col(f"level{k}") for k in range(2, MOST_MEMBERS + 1)])).alias("nth", "s")).select("settlement_id", "anchor", "nth", "s.total", "s.code")


def _met(sums: DataFrame, sources: Sources) -> DataFrame:
    """Sums with the credits that they explain. A sum has one key of a span and a week; a credit goes to all that its tolerance touches."""
    span = lambda c: F.floor(c / SPAN)
    right = credits(sources).withColumn("span", F.explode(F.array_distinct(F.array(span(F.col("credit") - S.TOLERANCE), span(F.col("credit") + S.TOLERANCE))))).withColumn("week", F.explode(S.weeks_near(F.col("value_date"))))
    left = sums.withColumns({"span": span(F.col("total")), "week": S.week_of(F.col("anchor"))})
    return left.join(right, ["span", "week"]).where((F.abs(F.col("credit") - F.col("total")) <= S.TOLERANCE) & S.within_days(F.col("value_date"), F.col("anchor"), S.WINDOW_DAYS))


def _names(code: Column, m: Column) -> Column:
    digits = F.filter(F.transform(F.sequence(F.lit(MOST_MEMBERS - 1), F.lit(0)), lambda k: F.call_function("shiftright", code, k * DIGITS).bitwiseAND(F.lit((1 << DIGITS) - 1))), lambda d: d > 0)
    return F.array_join(F.transform(digits, lambda d: F.get(m, d.cast("int") - 1)["entity_id"]), "|")


def small_subsets(sources: Sources, claimed: DataFrame) -> DataFrame:
    """(settlement_id, txn_id, subset) of every subset of two or three members and every credit that it explains."""
    held = _held(sources, claimed)
    found = _met(_sums(held).where(F.col("code") < 1 << 3 * DIGITS), sources).select("settlement_id", "txn_id", "code")
    return found.join(held.select("settlement_id", "m"), "settlement_id").select("settlement_id", "txn_id", _names(F.col("code"), F.col("m")).alias("subset"))


def _first(sums: DataFrame, sources: Sources) -> DataFrame:
    """(settlement_id, value_date, txn_id, nth, code) of each bucket's first credit and first sum."""
    first = _met(stored(sums, "sums"), sources).groupBy("settlement_id").agg(F.min(F.struct("value_date", "txn_id", "nth", "code")).alias("f"))
    return first.select("settlement_id", "f.*")


def subsets(sources: Sources, claimed: DataFrame) -> DataFrame:
    """(settlement_id, txn_id, subset) of each bucket that explains a credit."""
    held = _held(sources, claimed)
    return _first(_sums(held), sources).join(held.select("settlement_id", "m"), "settlement_id").select("settlement_id", "txn_id", _names(F.col("code"), F.col("m")).alias("subset"))


def _places(sources: Sources) -> DataFrame:
    """Credits with their place in the order of day and id, numbered from 0 without one task seeing them all."""
    keys = ["value_date", "txn_id"]
    rows = credits(sources).select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "credit-places").withColumns({"part": F.shiftright("_at", 33), "local": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").select(*keys, (F.col("before") + F.col("local")).alias("place"))


def _windows(places: DataFrame) -> DataFrame:
    """(anchor, targets, start) for each day that has credits near it: how many, and the place of the first. One row a day."""
    days = places.groupBy("value_date").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    near = days.withColumn("anchor", F.explode(F.sequence(F.date_sub("value_date", S.WINDOW_DAYS), F.date_add("value_date", S.WINDOW_DAYS))))
    return near.groupBy("anchor").agg(F.sum("n").alias("targets"), F.min("first").alias("start"))


def targets(sources: Sources, claimed: DataFrame) -> DataFrame:
    """(settlement_id, members, targets): each bucket that has credits near its first date, and how many, from counts by day."""
    anchors = buckets(sources, claimed).select("settlement_id", "members", "anchor").distinct()
    days = credits(sources).groupBy("value_date").agg(F.count("*").alias("n")).withColumn("anchor", F.explode(F.sequence(F.date_sub("value_date", S.WINDOW_DAYS), F.date_add("value_date", S.WINDOW_DAYS))))
    return anchors.join(days.groupBy("anchor").agg(F.sum("n").alias("targets")), "anchor").select("settlement_id", "members", "targets")


def search_stats(sources: Sources, claimed: DataFrame) -> DataFrame:
    """One row: searches of a bucket for a credit (a bucket stops at the first it explains), those that the cap skipped and their share, sums
    tried, subsets found, and how often payments were named as capped."""
    places = stored(_places(sources), "places")
    first = _first(_sums(_held(sources, claimed)), sources)
    found = first.join(places, ["value_date", "txn_id"]).groupBy("settlement_id").agg(F.min("place").alias("place"), F.min("nth").alias("nth"))
    anchors = buckets(sources, claimed).select("settlement_id", "members", "anchor").distinct()
    rows = anchors.join(_windows(places), "anchor").join(found, "settlement_id", "left")
    over, hit = F.col("members") > MOST_BUCKET, F.col("place").isNotNull()
    sums = F.get(F.array(*[F.lit(sum(comb(n, k) for k in range(2, MOST_MEMBERS + 1))) for n in range(MOST_BUCKET + 1)]), F.col("members").cast("int"))
    calls = F.when(hit, F.col("place") - F.col("start") + 1).otherwise(F.col("targets"))
    tried = F.when(hit, (calls - 1) * sums + F.col("nth") + 1).otherwise(calls * sums)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = rows.agg(
        total(F.when(~over, calls)).alias("searched"), total(F.when(over, F.col("targets"))).alias("skipped"), total(F.when(~over, tried)).alias("examined"),
        F.count(F.when(hit, 1)).alias("found"), total(F.when(over, F.col("targets") * F.col("members"))).alias("settlements_capped"),
    )
    return out.withColumn("rate", F.coalesce(F.round(F.try_divide("skipped", F.col("searched") + F.col("skipped")), 6), F.lit(0.0)))
