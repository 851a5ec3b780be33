"""What the flow's joins and rounds send through the shuffle, counted in records."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import blocking, matching, rules
from tallyframe.plans import flow

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """Records that a frame's jobs write to the shuffle; nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def stages():
        gateway = spark.sparkContext._gateway
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    def count(run):
        old = stages()
        run()
        return sum(n for stage, n in stages().items() if stage not in old)

    yield count
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_rate_pass_has_a_key_for_each_target(spark, shuffled):
    s = flow.sources(spark, SF)
    targets = s.payments.select(F.explode(blocking.S.plausible_credits(F.col("amount"), F.col("net_amount")))).count()
    assert shuffled(lambda: blocking.pass_rate(s).collect()) <= targets + 5 * s.bank.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_best_links_send_a_pair_once_for_each_name(spark, shuffled):
    s, pairs = flow.sources(spark, SF), flow.best(spark, SF)
    keys = pairs.where("invoice_id = ''").select(F.explode(rules.S.narration_keys(F.col("normalized_narration")))).count()
    assert shuffled(lambda: rules.best_links(pairs, s).collect()) <= keys + 3 * s.invoices.count() + pairs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_keys_that_are_no_name_stay_where_they_are(spark, shuffled):
    s, pairs = flow.sources(spark, SF), flow.best(spark, SF)
    keys = lambda df: df.select(F.explode(rules.S.narration_keys(F.col("normalized_narration"))).alias("name_key"))
    assert s.named(keys(s.bank)).count() < keys(s.bank).count() / 2
    assert shuffled(lambda: blocking.pass_counterparty(s).collect()) < keys(s.bank).count()
    fit = rules.link_scores(pairs, s).count()
    assert shuffled(lambda: rules.link_scores(pairs, s).collect()) < s.named(keys(pairs.where("invoice_id = ''"))).count() + 3 * s.invoices.count() + 2 * fit


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_claims_need_no_candidates(spark, shuffled):
    from tallyframe.plans import evaluation_queries as E

    flow.forget()
    s, got = flow.sources(spark, SF), []
    sent = shuffled(lambda: got.extend(r[0] for r in E.claimed(spark, SF).collect()))
    assert sent <= 4 * (s.payments.count() + s.bank.count())  # candidates alone send more
    assert sorted(got) == sorted(r[0] for r in flow.best(spark, SF).where("rule = 'utr_amount_date'").select("entity_id").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_candidates_are_sent_once_for_all_features(spark, shuffled):
    from tallyframe.functions.storage import written
    from tallyframe.plans.matching_queries import featured

    s = flow.sources(spark, SF)
    pairs = written(rules.joined(flow.candidates(spark, SF), s), "joined")
    links = written(rules.best_links(pairs, s), "links")
    sent = shuffled(lambda: featured(pairs, links, s, False).collect())
    assert sent <= pairs.count() + 2 * links.count() + 3 * s.invoices.count()


def test_payments_without_receipt_are_not_one_key(spark, shuffled):
    from tallyframe.sources.batch import Sources

    pay = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("entity_id"), F.when(F.col("id") < 10, F.concat(F.lit("i"), "id")).otherwise("").alias("invoice_id"), F.lit("payment").alias("txn_type"))
    day = F.lit("2026-06-01").cast("date").alias("invoice_date")
    for ids, want in ((["i3"], {"": 2999, "FOO": 1}), (["i3", ""], {"": 9, "FOO": 1, "BAR": 2990})):
        inv = spark.createDataFrame([(i, "Bar" if i == "" else "Foo") for i in ids], "invoice_id string, customer_name string").select("*", F.upper("customer_name").alias("counterparty"), F.lit(1).alias("amount"), day)
        s, got = Sources(inv, pay, None), {}
        assert shuffled(lambda: got.update({r[0]: r[1] for r in blocking.payments_with_names(s).rdd.map(lambda r: (r.counterparty, 1)).countByKey().items()})) <= 100
        assert got == want


def test_a_round_joins_ends_not_edges(spark, shuffled):
    draw = random.Random(3)
    rows = [(f"p{a}", f"i{b}", draw.random()) for a in range(30) for b in range(30)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    order = [-F.col("w"), F.col("a"), F.col("b")]
    taken, want, used = {}, {}, set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in want and b not in used:
            want[a] = b
            used.add(b)
    sent = shuffled(lambda: taken.update((r.a, r.b) for r in matching.one_to_one(edges, "a", "b", order).collect()))
    assert taken == want
    assert sent <= 3 * len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_passes_are_flags_until_pairs_are_distinct(spark):
    s = flow.sources(spark, SF)
    found = blocking.candidates(s)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # which sorts all hits beyond 128 pairs
    want = blocking.hits(s).groupBy(*blocking.PAIR).agg(F.sort_array(F.collect_set("pass")).alias("passes"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_best_pairs_come_from_those_that_decide_them(spark, shuffled):
    s, got, want = flow.sources(spark, SF), [], []
    few = shuffled(lambda: got.extend(rules.deciding_pairs(s, rules.surely_best(s)).collect()))
    every = shuffled(lambda: want.extend(rules.best_pairs(rules.scored(blocking.candidates(s), s)).drop("passes").collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert few < 0.8 * every


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_links_are_made_of_unpaid_bills_alone(spark, shuffled):
    s, pairs, got = flow.sources(spark, SF), flow.best(spark, SF), []
    sent = shuffled(lambda: got.extend(matching.resolved_links(pairs, s).collect()))
    keys = s.named(pairs.where("invoice_id = ''").select(F.explode(rules.S.narration_keys(F.col("normalized_narration"))).alias("name_key"))).count()
    free = rules.fitting_links(pairs, s, s.invoices.join(rules.given_links(pairs).select("invoice_id"), "invoice_id", "left_anti")).count()
    assert sent <= keys + 5 * s.invoices.count() + 4 * free  # doubles and paid bills are not looked for among links
    assert len({r.invoice_id for r in got if r.link_rule != "receipt_given"}) == sum(r.link_rule != "receipt_given" for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_few_pairs_are_joined_to_each_side_alone(spark):
    from tallyframe.functions.storage import written

    s = flow.sources(spark, SF)
    pairs = written(blocking.candidates(s).select(*blocking.PAIR).where("entity_id like '%7'"), "few")
    got, want = rules.joined_apart(pairs, s), rules.joined(pairs, s)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) != []


def test_repeated_edges_are_taken_once(spark):
    rows = [("p1", "i1", 0.5, "x"), ("p1", "i1", 0.5, "x"), ("p1", "i1", 0.4, "y"), ("p2", "i1", 0.5, "x"), ("p2", "i2", 0.1, "x")]
    edges = spark.createDataFrame(rows, "a string, b string, w double, note string")
    assert sorted(map(tuple, matching.one_to_one(edges, "a", "b", [-F.col("w"), "a", "b"]).collect())) == [("p1", "i1", 0.5, "x"), ("p2", "i2", 0.1, "x")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_amounts_that_agree_by_utr_are_not_searched_for(spark, shuffled):
    """Two-digit years put most credits of a long batch in another century, so no date agrees with the payment's."""
    from dataclasses import replace

    from tallyframe.functions.storage import written

    s, got, want = flow.sources(spark, SF), [], []
    far = replace(s, bank=written(s.bank.withColumn("value_date", F.date_sub("value_date", 36525)), "far"))
    few = shuffled(lambda: got.extend(rules.deciding_pairs(far, rules.surely_best(far)).collect()))
    every = shuffled(lambda: want.extend(rules.best_pairs(rules.scored(blocking.candidates(far), far)).drop("passes").collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) != []
    assert few < 0.6 * every


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_matches_send_no_pair_that_has_a_receipt(spark, shuffled):
    s, pairs, got, want = flow.sources(spark, SF), flow.best(spark, SF), [], []
    few = shuffled(lambda: got.extend(flow.matched(pairs, s).collect()))
    more = shuffled(lambda: want.extend(flow.predicted(pairs, matching.resolved_links(pairs, s)).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) != []
    assert few <= more - 2 * pairs.where("invoice_id <> ''").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_rows_of_a_batch_are_sorted_by_settlement_once(spark, shuffled):
    from tallyframe.sources.batch import derived_sources

    flow.forget()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert shuffled(lambda: flow.sources(spark, SF)) <= orders + 50
    s, fresh = flow.sources(spark, SF), derived_sources(spark, SF)
    for t in ("invoices", "settlements", "bank", "truth"):
        assert sorted(map(repr, getattr(s, t).collect())) == sorted(map(repr, getattr(fresh, t).collect()))


@pytest.mark.parametrize("seed", [2, 3])
def test_deciding_pairs_of_odd_rows(spark, seed):
    """Repeated ids, amounts of a few paise, refunded nets, missing dates and UTRs: the best pair is the best of all candidates."""
    import datetime

    from tallyframe.sources.batch import Sources, derived_narration

    draw = random.Random(seed)
    day = lambda: draw.choice([None, *[datetime.date(2026, 6, d) for d in range(1, 7)]])
    amount = lambda: draw.choice([0, 1, 2, 3, 5, 7, 1000, 1003, 976, 10000, 9764, 9500, 9276])
    names = ["Arvandi Textiles", "Belapur Spices", "Textiles", ""]
    pay = [(f"p{draw.randrange(120)}", f"s{draw.randrange(9)}", draw.choice(["", "300000000001", "300000000002", "300000000003", "3"]), "payment", draw.choice(["", f"i{draw.randrange(20)}"]), a, a - draw.choice([0, 0, 2, 24, 2000]), day()) for a in (amount() for _ in range(160))]
    bank = [(f"t{draw.randrange(60)}", amount(), day(), draw.choice(["", "300000000001 ", "300000000002 300000000003 "]) + draw.choice(names) + draw.choice(["", " PAY"])) for _ in range(70)]
    bills = [(f"i{k % 18}", draw.choice(names), amount(), day()) for k in range(22)]
    s = Sources(
        spark.createDataFrame(bills, "invoice_id string, customer_name string, amount long, invoice_date date").withColumn("counterparty", blocking.S.normalize_counterparty(F.col("customer_name"))),
        spark.createDataFrame(pay, "entity_id string, settlement_id string, utr string, txn_type string, invoice_id string, amount long, net_amount long, settled_date date").selectExpr("*", "0L as fee", "0L as tax", "'' as method"),
        derived_narration(spark.createDataFrame(bank, "txn_id string, credit long, value_date date, narration string")),
    )
    told = ("entity_id", "txn_id", "rule_score", "penalty")
    got = sorted(map(tuple, rules.deciding_pairs(s).select(*told).collect()))
    want = rules.best_pairs(rules.scored(blocking.candidates(s), s)).select("rule", *told).collect()
    assert got == sorted(tuple(r)[1:] for r in want)
    assert len({r.rule for r in want}) >= 6


def broadcast_rows(spark, run) -> list[int]:
    """Rows of each table that a run sends whole to all tasks."""
    store = spark._jsparkSession.sharedState().statusStore()
    every = lambda seq: [seq.apply(i) for i in range(seq.size())]
    old = {e.executionId() for e in every(store.executionsList())}
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    out = []
    for i in {e.executionId() for e in every(store.executionsList())} - old:
        values = store.executionMetrics(i)
        counts = [m for n in every(store.planGraph(i).allNodes()) if n.name() == "BroadcastExchange" for m in every(n.metrics()) if m.name() == "number of output rows"]
        out += [int(v.get().replace(",", "")) for v in (values.get(m.accumulatorId()) for m in counts) if v.isDefined()]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["curve_best_at_precision", "reconcile_rules", "audit_violations", "chaos_fanout"])
def test_no_table_that_grows_is_broadcast(spark, name):
    """Where files are small, joins chosen by their size would send payments, credits and pairs through the driver."""
    from tallyframe import catalog

    flow.forget()
    rows = broadcast_rows(spark, lambda: catalog.queries()[name](spark, SF).collect())
    assert rows and max(rows) <= 200  # names, and tables of a row each
    flow.forget()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_a_late_batch_is_searched_once(spark, shuffled):
    """The verdict's late side sends less than one resolution of all its candidates, and comes to the same."""
    from dataclasses import replace

    from tallyframe import catalog
    from tallyframe.functions.storage import written
    from tallyframe.operators import chaos
    from tallyframe.plans import evaluation_queries as E

    s, got = flow.sources(spark, SF), []
    flow.predictions(spark, SF)
    few = shuffled(lambda: got.extend(catalog.queries()["chaos_verdict"](spark, SF).collect()))
    hurt = replace(s, bank=chaos.corrupted(s.bank, ["date_format_swap"]))
    best = written(rules.best_pairs(rules.scored(blocking.candidates(hurt), hurt)), "best")
    late = flow.predicted(best, matching.resolved_links(best, hurt))
    want = E.E.outcome(late, s.payments, s.truth, s.invoices, hurt.bank, E.THRESHOLD).first()
    assert [got[0][f"after_{c}"] for c in ("matched", "exceptions", "false_matches", "wrong_money")] == [want[c] for c in ("matched", "exceptions", "false_matches", "wrong_money")]
    assert few < shuffled(lambda: rules.best_pairs(rules.scored(blocking.candidates(hurt), hurt)).collect()) * 1.5
