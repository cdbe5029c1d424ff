"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from leafmill.plans.catalog import QUERIES
from leafmill.session import local_session

HEADLINE = (
    "per_host_cap", "keyword_rank", "batch_merge", "verdict_ranking", "cue_file_parse", "word_stream_to_segments",
    "segment_chapter_asof_join", "pause_paragraphs", "language_vote", "title_tidy", "book_markdown_parts", "chapter_split",
    "heading_demotion", "chapter_scorecard", "chapter_similarity", "chunked_transform_guarded", "cost_per_job",
    "cache_hit_miss_split", "latest_item_state", "feed_flatten", "track_pick", "page_node_counts", "page_to_markdown",
    "article_link_table", "item_state_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    # One untimed query: starting the JVM's reader and compiler is not the first query's cost.
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
