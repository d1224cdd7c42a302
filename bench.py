"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from freightdocs.plans.registry import QUERIES  # noqa: E402
from freightdocs.session import local_session  # noqa: E402

HEADLINE = (
    "seg_1_lines", "seg_6_label_pairs", "seg_11_tokens", "lab_2_adjacent_values", "nrm_1_key_canonical", "rte_2_doc_types",
    "ord_3_box_quantities", "ord_6_payload", "iss_1_append_merge", "iss_2_one_per_code", "rec_18_document_grounding",
    "doc_8_grid_markdown", "doc_11_page_quality", "doc_12_label_overlap", "doc_18_assembly", "log_2_newest_page",
    "log_8_status_classes", "evl_1_field_diff", "iss_8_full_reconciliation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["log_8_status_classes"](spark, sf_dir).collect()  # starts the executors
    seconds = {}
    for name in names:
        start = time.time()  # building the plan counts, and so do the tables that it writes on the way
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
