"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "w1_number_messages", "a1_assemble", "a2_dialogue", "a3_transcript_scores", "a4_user_vocab",
    "a5_merge_user_vocab", "a6_usage_stats", "a9_last_updated", "a10_finalize", "a12_streaks",
    "k1_select_vocabulary", "l12_extract_terms", "w3_flag_first_use", "d2_parse_paths",
    "d5_merge_docs", "d6_update_docs", "d8_flatten_docs", "d9_export_json", "j1_resolve_plans",
    "j2_plans_from_acts", "j5_annotate_terms", "j6_build_curriculum", "j8_match_language",
    "j10_soft_match", "j11_translate", "w2_latest_acts", "r2_parse_prompts", "r4_substitute",
    "l2_complete", "l5_score_messages", "l6_grade_transcripts", "l13_extract_pos",
    "l20_extract_msgv", "l21_extract_all", "l22_batch_replies", "g1_severity_counts",
    "g2_trace_stats", "t3_session_end",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("convolytics-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # Call sites are for error messages; recording them slows down building plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from convolytics.catalog import QUERIES

    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    if "--all" in sys.argv:
        names = list(QUERIES)
    spark.read.parquet(f"{folder}/conversations.parquet").groupBy("role").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)),
            }
        )
    )


if __name__ == "__main__":
    main()
