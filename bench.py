"""Times the headline queries and prints one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One or two from every job: feed, search, counting, tagging, stories, ownership, dates, funding, loading, coverage.
HEADLINE = (
    "feed_balanced_newest", "feed_capped_all", "feed_counts_per_outlet", "feed_owner_subtree", "feed_names_own_owner", "feed_pages_all",
    "search_ranked", "search_postings", "mention_main_places", "article_names_text", "tags_retag_all", "article_item_mentions",
    "story_headline_terms", "story_links_48h", "graph_ancestors", "graph_descendants", "coverage_by_owner",
    "ownership_summary_lines", "owner_league_table", "outlet_match_decisions", "ownership_edges_built", "page_dates_chosen", "date_audit",
    "funding_refreshed", "funding_panels", "articles_first_per_key", "hosts_to_outlets", "coverage_report", "crawl_verdicts", "status_report",
)


def story_links_48h(spark, folder):
    """The linking job as it runs in operation: the newest 48 hours of headlines."""
    from pyspark.sql import functions as F

    from mediagraph.operators import stories
    from mediagraph.plans.bindings import Tables
    from mediagraph.plans.story_queries import with_names

    rows = with_names(Tables(spark, folder)).withColumn("outlet_id", F.col("outlet")).withColumn("story_id", F.lit(None).cast("bigint"))
    return stories.link_stories(rows, now=rows.agg(F.max("seen")).first()[0])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from mediagraph.plans.catalog import QUERIES
    from mediagraph.session import build_session

    only = sys.argv[1:]
    spark = build_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["feed_totals"](spark, folder).collect()  # start-up is not measured
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        started = time.perf_counter()
        run = globals().get(name) or QUERIES[name]
        run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
