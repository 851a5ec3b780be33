"""Times the headline queries end to end at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: From raw rows each: the steps kept in between are forgotten before every query.
HEADLINE = ("candidates_union", "rule_resolution", "export_candidates", "reconcile_rules", "greedy_one_to_one", "exception_reasons", "risk_coverage_curve", "operating_point", "reconcile_calibrated")


def main() -> None:
    from pyspark.sql import SparkSession

    from tallyframe import catalog
    from tallyframe.plans import flow

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * cpus)).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, took = catalog.queries(), {}
    flow.sources(spark, sf_dir).payments.count()  # starts the JVM's work: readers, code generation
    payments = flow.sources(spark, sf_dir).payments.count()
    for name in HEADLINE:
        flow.forget()
        began = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "settlements": payments, "settlements_per_sec_end_to_end": round(payments / took["reconcile_rules"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
