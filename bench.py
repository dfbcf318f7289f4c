"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from palimpsest.plans.queries import QUERIES  # noqa: E402

HEADLINE = ["dense_topk", "weighted_recall_value", "multi_head_recall", "adaptive_heads", "tension_split", "edge_band_join", "spread_mean_2hop", "spread_gcn_sym", "graph_recall", "gate_chain", "soft_decision", "hash_embedding", "context_ema", "update_fold", "tfidf_cosine", "bm25_topk", "hybrid_topk", "hierarchical_rerank", "recall_by_category", "token_f1"]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executors
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rsplit("sf", 1)[-1].strip("/"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
