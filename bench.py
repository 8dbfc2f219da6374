"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Items, votes, features, examples, the fixture model and its scores are written once, as an engine keeps them, and timed
as ``prepare_inputs``; queries start from those tables. A query whose work is to make one of them makes it anew: b1 folds
the raw events, c14 featurises the stored items."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (sys.path[0], os.environ.get("PYTHONPATH", ""))))

from pyspark.sql import SparkSession  # noqa: E402

from palate import registry  # noqa: E402
from palate.plans.fixtures import Tables  # noqa: E402
from palate.sources.storage import scratch  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The table that a query makes itself.
ANEW = {"b1_fold_votes": "votes", "c14_featurize": "features"}
HEADLINE = (
    "b1_fold_votes",
    "c14_featurize",
    "e3_fit_grouped",
    "e9_cross_validate",
    "f1_rescore_all",
    "h2_feed_foryou",
    "h16_training_queue",
    "i5_paired_flips",
    "j2_score_distribution",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    queries, took = registry.queries(), {}
    start = time.time()
    Tables(spark, SF_DIR).store(scratch(spark, "bench"))
    took["prepare_inputs"] = round(time.time() - start, 3)
    for name in HEADLINE:
        Tables.making = ANEW.get(name)
        start = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
