"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: twelve search bodies of a log-analytics mix: filters and text give ten hits, aggregations their buckets
TIME = {"range": {"ts": {"gte": "2024-01-01T00:00:00Z", "lt": "2024-01-02T17:40:00Z"}}}
BODIES = {
    "match_all": ("events", {"query": {"match_all": {}}, "size": 10}),
    "term_keyword": ("events", {"query": {"term": {"event_type": "error"}}, "size": 10}),
    "term_numeric": ("events", {"query": {"term": {"user_id": 404}}, "size": 10}),
    "range_numeric": ("events", {"query": {"range": {"value": {"gte": 50, "lt": 300}}}, "size": 10}),
    "match_text": ("documents", {"query": {"match": {"text": "the que"}}, "size": 10}),
    "bool_filter": ("documents", {"query": {"bool": {"must": [{"match": {"text": "que"}}], "filter": [{"term": {"lang": "es"}}, {"range": {"n_chars": {"gte": 20}}}]}}, "size": 10}),
    "agg_terms": ("events", {"size": 0, "aggs": {"by_type": {"terms": {"field": "event_type", "size": 10}}}}),
    "agg_date_hist": ("events", {"size": 0, "aggs": {"over_time": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}}}),
    "agg_nested": ("events", {"size": 0, "aggs": {"by_type": {"terms": {"field": "event_type"}, "aggs": {"avg_value": {"avg": {"field": "value"}}, "s_value": {"stats": {"field": "value"}}}}}}),
    "sort_paged": ("events", {"query": {"match_all": {}}, "sort": [{"value": "desc"}], "size": 10, "from": 100}),
    "time_range": ("events", {"query": TIME, "size": 10}),
    "time_range_agg": ("events", {"size": 0, "query": TIME, "aggs": {"by_type": {"terms": {"field": "event_type", "size": 10}}}}),
}


def main() -> None:
    from pyspark.sql import SparkSession

    from brindle.plans import catalogue

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine, took, rows = catalogue.engine(spark, SF, "events", "documents"), {}, {}
    engine.count("events").collect()  # the session's own start
    store = tempfile.mkdtemp(prefix="bench-")  # local master only
    began = time.perf_counter()
    engine.analyze("documents", ["text"], store)
    built = round(time.perf_counter() - began, 4)
    for shape, (index, body) in BODIES.items():
        times = []
        for _ in range(3):
            began = time.perf_counter()
            got = (engine.aggregate if "aggs" in body else engine.search)(index, body).collect()
            times.append(time.perf_counter() - began)
        assert got, shape
        took[shape], rows[shape] = round(sorted(times)[1], 4), len(got)
    print(json.dumps({"metric": "sum of the median seconds of 12 search shapes", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "terms_stored_once": built, "sf": Path(SF).name}))
    shutil.rmtree(store)
    spark.stop()


if __name__ == "__main__":
    main()
