"""Benchmark: the release gate's headline queries over the driver tables.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line.  ``prepare_documents`` is the one pass over the
raw documents (normalise, fingerprint, tokenise, scan for identifiers,
number rows); the detector queries then read the prepared table.
``gate_status`` audits every source as its own release in one job,
including its own prepare pass.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pii_by_kind",
    "pii_cell_count",
    "exact_duplicate_pairs",
    "exact_duplicate_evidence",
    "token_stats",
    "near_duplicate_pairs",
    "near_duplicate_evidence",
    "split_leakage_pairs",
    "split_leakage_evidence",
    "conflicting_labels",
    "conflict_evidence",
    "label_distribution",
    "class_imbalance",
    "dataset_fingerprint",
    "cell_limit_violations",
    "gate_status",
    "audit_summary",
    "evidence_capped",
    "score_by_category",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tollgate.session import local_session
    from tollgate.plans import catalog, views

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app_name="tollgate-bench")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    start = time.time()
    t = time.time()
    prep = views.documents_prepared(spark, sf_dir)
    prep.df.count()
    times["prepare_documents"] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        rows[name] = len(catalog.QUERIES[name](spark, sf_dir).collect())
        times[name] = round(time.time() - t, 3)
    total = round(time.time() - start, 3)
    # 1,000 rows that all resemble each other; the one published bound is 10 s
    from pyspark.sql import functions as F
    from tollgate import Release, audit
    common = " ".join(f"w{i}" for i in range(63))
    for turn in range(2):
        t = time.time()
        df = spark.range(1000).select(F.col("id"), F.concat(F.lit(common + " r"), F.col("id")).alias("feature"),
                                      F.lit("clear").alias("label"), F.lit("train").alias("split"))
        res = audit(df, Release(release_id="stress", provenance="own", license="own"), order_by=[F.col("id")])
        found = (res.summary.first().near_duplicate_pairs, res.evidence.count())
        times["stress_audit"] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "release_gate_total", "value": total, "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus,
                      "stress": {"pairs": found[0], "seconds": times["stress_audit"], "bound": 10}}))
    spark.stop()


if __name__ == "__main__":
    main()
