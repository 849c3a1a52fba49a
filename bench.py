"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose
the tables and the cores.  Every query is written to Spark's noop sink, so whole
results are computed.  Names on the command line replace the default list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "route_messages", "m1_clean_language", "f11_small_talk", "c1_route_decision",
    "d1_keep_first", "d2_knowledge_base", "d3_stratified_split", "d6_short_spans", "d8_split_overlap",
    "d9_template_overlap", "v2_assistant_pairs", "v4_feedback_records",
    "e2_macro_scores", "e4_confusion_matrix", "f8_weighted_cross_entropy",
    "f1_char_vocabulary", "f1_char_tfidf", "f2_word_tfidf",
    "r3_dense_top_k", "r3_text_top_k", "r4_retrieved_documents", "c7_answer_scored", "c11_drained_stream",
    "f4_language_training", "f5_intent_training", "f6_sentiment_training",
    "f9_predict_language", "f12_predict_intent", "c7_answer_messages",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("msgflow-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # the first job of a session pays for its start
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "msgflow headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
