"""Benchmark the headline queries (E01-E06, J12, M04) at $BENCH_SF_DIR on local[$BENCH_CPUS].

The corpus is prepared once (tokenised and stored as parquet, like the reference's
prepared corpus); each query then runs warm three times (median reported), forced to
completion with the `noop` sink. Shuffle bytes per query come from Spark's event log,
written to a scratch folder. Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["E01_kwic", "E02_ngrams", "E03_word_trends", "E03_word_trends_by_party", "E04_speeches_with_words",
            "E05_word_hits", "E06_speeches", "J12_co_occurrence_top100", "M04_ppmi_top100", "M04_llr_top100",
            "J12_co_occurrence"]
# Registered forms that aren't run here: five runs of each would take minutes (13.8 million pairs at sf0.1).
LEFT_OUT = ["M04_ppmi", "M04_llr"]


def top100_queries() -> dict:
    """J12 and M04 over the speeches' 100 most frequent lemmas, the same work as the first
    round's J12_co_occurrence, M04_ppmi and M04_llr. The registered queries, which take the whole
    vocabulary of conversations, are J12_co_occurrence here and those of LEFT_OUT."""
    from rostra.operators import dtm, stats
    from rostra.plans import catalog

    def pairs(spark, sf_dir):
        c = catalog.corpus(spark, sf_dir)
        return stats.co_occurrence_from_tokens(c.speech_tokens, dtm.top_n_words(c.vocab, 100).select("token"))

    def weights(metric):
        return lambda spark, sf_dir: stats.significance(pairs(spark, sf_dir), metric)

    return {"J12_co_occurrence_top100": pairs, "M04_ppmi_top100": weights("ppmi"), "M04_llr_top100": weights("llr")}


def _shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Sum of shuffle bytes written per job description, from the event log."""
    stage_desc: dict[int, str] = {}
    out: dict[str, int] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or path.endswith(".inprogress.crc"):
            continue
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                if not line.startswith("{"):
                    continue
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    desc = stage_desc.get(ev.get("Stage ID"))
                    if not desc:
                        continue
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    out[desc] = out.get(desc, 0) + int(m.get("Shuffle Bytes Written", 0))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="rostra-bench-")
    log_dir = os.path.join(scratch, "events")
    os.makedirs(log_dir)
    from rostra.model import Corpus, prepare_corpus
    from rostra.plans import catalog
    from rostra.session import build_session

    spark = build_session(f"local[{cpus}]", max(2 * cpus, 4), app="rostra-bench", extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "6g"),
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false",
        "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
    })
    sc = spark.sparkContext
    queries = catalog.queries() | top100_queries()

    # warm the JVM (code generation, class loading) on the smallest tables first, so the
    # preparation below is measured warm like the queries
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_sec = None
    if os.path.isdir(small) and small != sf_dir:
        sc.setJobDescription("warmup:prepare")
        t0 = time.time()
        prepare_corpus(Corpus(spark, small), os.path.join(scratch, "warmup"))
        warm_sec = time.time() - t0
    prepared = os.path.join(scratch, "prepared")
    sc.setJobDescription("prepare_corpus")
    t0 = time.time()
    prepare_corpus(Corpus(spark, sf_dir), prepared)
    prepare_sec = time.time() - t0
    catalog.use_prepared(sf_dir, prepared)

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        sc.setJobDescription(f"warmup:{name}")
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for i in range(3):
            sc.setJobDescription(f"run{i}:{name}")
            t = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
        sc.setJobDescription(f"count:{name}")
        rows[name] = queries[name](spark, sf_dir).count()
    sc.setJobDescription(None)
    spark.stop()
    shuffle = _shuffle_bytes(log_dir)
    per_query_shuffle = {n: shuffle.get(f"run0:{n}", 0) for n in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "prepare_sec": round(prepare_sec, 3),
        "jvm_warmup_sec": round(warm_sec, 3) if warm_sec is not None else None,
        "rows_out": rows,
        "left_out": LEFT_OUT,
        "shuffle_bytes": per_query_shuffle,
        "prepare_shuffle_bytes": shuffle.get("prepare_corpus", 0),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
