"""Headline queries on one machine; prints one line of JSON."""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

from pyspark.sql import SparkSession  # noqa: E402

from postloom.plans import QUERIES  # noqa: E402
from postloom.plans.base import keep, keep_posts  # noqa: E402
from postloom.plans.graphing import search_index  # noqa: E402
from postloom.plans.logging import derived_state  # noqa: E402

#: filtered top-k, contains scan, derivations, match rate, buckets, replay, search, graph
HEADLINE = ["o_engagement_topk", "p_contains", "l_derive", "l_derive_regex", "l_derive_not", "l_derive_incremental", "p_match_rate", "a_buckets_hour", "l_replay", "l_commits", "t_bm25", "g_edges", "n_flags"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    keep_posts(spark, sf_dir, f"file://{tempfile.mkdtemp(prefix='spark-bench-')}")  # posts are read from a store, as a user's are
    made = {}
    for kind, make in (("index", search_index), ("derived", derived_state)):  # so are the index and the derived store's posts
        began = time.time()
        keep(spark, sf_dir, kind, make(spark, sf_dir), f"file://{tempfile.mkdtemp(prefix='spark-bench-')}")
        made[kind] = round(time.time() - began, 3)
    QUERIES["a_count"](spark, sf_dir).collect()  # starts the JVM's threads and loads classes
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "made_before": made, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
