"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints
one JSON line. Each query is timed to completion (written to a noop sink);
tables derived for the query before are dropped first, so each one pays for
everything that it needs."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blobtrail.plans import registry  # noqa: E402
from blobtrail.session import drop_written, local_session  # noqa: E402

HEADLINE = [
    "blob_id",
    "exact_blob_match",
    "tokenize",
    "shingle_set",
    "winnow_fingerprint",
    "similarity_join_jaccard",
    "similarity_join_charjaccard",
    "similarity_join_winnow",
    "similarity_join_simhash",
    "similarity_join_minhash",
    "branches_containing",
    "choose_preferred",
    "match_cascade_jaccard",
    "step_metrics",
    "repo_catalog",
    "read_fork_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2), app="blobtrail-bench")
    registry.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        registry.forget()
        drop_written(spark)
        t0 = time.time()
        df = registry.run(name, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
