"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every result is written in full to the noop sink, so no column of it can be pruned away.
"""

import json
import os
import time

from onomast.plans import catalog
from onomast.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "group_size_profile", "cutoff_explorer", "stratified_split", "split_rows", "build_triplets", "cap_triplets", "canonicalize", "match_normalize",
    "title_case", "blocking_forms", "blocked_candidates", "choose_negative", "json_extract", "record_names", "knn_join", "recall_at_k", "roc_auc",
    "threshold_sweep", "triplet_eval", "mine_exhaustive", "mine_knn", "ivf_knn", "augment_names", "stats_summary",
]


def main() -> None:
    spark = session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").write.format("noop").mode("overwrite").save()  # starts the executor threads
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
