"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gossamer.plans import catalog
from gossamer.session import build_session

HEADLINE = (
    "hits_by_category",
    "pii_spans",
    "sanitized_spans",
    "merged_spans",
    "nonoverlap_selection",
    "placeholder_mapping",
    "anonymized_text",
    "restore_roundtrip",
    "pii_density_by_lang_source",
    "line_offsets",
    "keyword_in_context",
    "custom_literal_spans",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false", spark__sql__files__maxPartitionBytes="4m")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.QUERIES["hits_by_category"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001").collect()  # starts the engine
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
