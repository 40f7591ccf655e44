"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalspark.plans import QUERIES  # noqa: E402
from evalspark.session import build_session  # noqa: E402

HEADLINE = [
    "decontam_items",
    "dirty_documents",
    "clean_chunks",
    "ngram_document_frequency",
    "overlap_statistics",
    "file_statistics",
    "fewshot_random",
    "choice_requests",
    "cache_lookup",
    "inflight_dedup",
    "longest_first_batches",
    "rolling_windows",
    "filter_sets",
    "filter_final_letter",
    "choice_scores",
    "token_f1",
    "rouge_n",
    "corpus_bleu",
    "corpus_chrf",
    "instruction_checks",
    "task_results",
    "group_scores",
    "bootstrap_mean",
    "bias_scores",
    "seed_consistency",
    "generation_telemetry",
    "sample_summary",
    "frequent_words",
    "hidden_sentences",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
