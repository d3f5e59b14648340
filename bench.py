"""Wall time of headline queries. Prints one JSON line."""

import json
import os
import sys
import time

from seglake import build_session
from seglake.plans import catalog

HEADLINE = [
    "flt03_strip_annotations", "flt06_collapse_punctuation", "flt08_clean_segments", "jon01_attribute_speakers", "jon03_line_at", "jon06_decision_check",
    "jon14_reemission_pairs", "jon15_similar_examples", "jon23_drop_in_intervals", "agg01_to_segments", "agg02_corpus_wer", "agg05_bench_breakdown",
    "agg06_session_metrics", "agg19_describe", "win01_merge_runs", "win15_ttr_collapse", "win18_repair_times", "win25_dedup_consecutive",
    "str02_speech_events", "str04_segment", "str19_encode_deltas", "src04b_switch_events",
]


def feed_bytes(spark, folder: str) -> dict[str, float]:
    """Characters of all full snapshots against those of the deltas, and their ratio."""
    from pyspark.sql import functions as F

    from seglake.operators.feed import encode_deltas
    from seglake.sources.tables import Tables

    snap = Tables(spark, folder).snap
    size = lambda df: df.agg(F.sum(F.length("line_text"))).first()[0] or 0
    full, delta = size(snap), size(encode_deltas(snap, ["session_id"])[1])
    return {"full": full, "delta": delta, "ratio": round(full / max(delta, 1), 2)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")),
                      "feed_bytes": feed_bytes(spark, folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
