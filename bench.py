"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` (default 8) the cores.
Every query is run once to the end on a warm session; its result is counted, not kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperweave.catalog import QUERIES  # noqa: E402
from paperweave.session import build_session  # noqa: E402

HEADLINE = [
    "label_distribution_multi",
    "label_quota",
    "tokenize_clean",
    "ngram_terms",
    "document_frequency",
    "tfidf",
    "clean_abstract",
    "normalise_subjects",
    "sample_proportional",
    "stratified_split",
    "random_split",
    "sample_false",
    "build_instances",
    "reduce_by_distribution",
    "add_new_data",
    "update_from",
    "statements_by_subject",
    "match_by_title",
    "validate_match",
    "enrich",
    "fuzzy_map_labels",
    "apply_mapping",
    "macro_f1",
    "rate_window",
    "extract_page_metadata",
    "flatten_nested",
    "train_classifier",
    "batch_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "paperweave-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine and a Python worker before the clock starts
    QUERIES["similarity_ratio"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
