"""Time the headline queries: one JSON line, seconds per query (better of two runs)."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from casewright.plans.catalog import QUERIES
from casewright.session import build_session

HEADLINES = [
    "label_distribution", "signal_scores", "noise_filter", "canonical_dedup", "assign_label",
    "stats_report", "strip_headers", "outcome_mask_count", "token_audit", "table_fingerprint",
    "tokenize_words", "top_ngrams", "term_counts", "vocab_top_k", "stratified_split", "tfidf_transform",
    "class_mean_tfidf", "confusion_matrix", "evaluate_models", "roc_points", "linear_attribution",
    "complement_nb",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.casewright.testScanPartitions": cpus,
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    seconds = {name: round(min(run(spark, name, folder) for _ in range(2)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
