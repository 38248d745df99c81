"""Time the headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from shiftgrid.session import get_session, release
import workload

HEADLINE = (
    "rp4_verdict", "rp9_screen_score", "rp11_benchmark_edges", "st17_regulon_activity", "st2_spearman", "wn1_average_rank",
    "st11_st12_auroc_aupr", "wn6_merge_intervals", "jn7_overlaps_any", "jn8_count_fragments", "flt3_qc_rna", "st1_ln_cp10k",
    "ag9_centrality", "rs2_permutation_null", "rs5_normalised_enrichment", "rp14_rank_against_gold", "rp19_whatif_status",
    "pct_exact_percentiles", "tk2_top_abs", "st9_leave_one_out_mean",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = workload.load()
    queries["st3_pearson"](spark, folder).collect()  # start-up of the JVM and the code cache
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    release(spark)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
