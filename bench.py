"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Pass query names to time only those.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plotweave.registry import spark_queries
from plotweave.session import local_session

HEADLINES = [
    "relationship_graph_edges",
    "ag_4_undirected_edge_fold",
    "ag_8_node_fold",
    "st_6_top_three_labels",
    "wn_13_event_ordinal",
    "wn_14_running_edges",
    "scoped_relationship_graph",
    "wn_2_snapshot_nodes",
    "fine_event_at_position",
    "jn_16_reading_prefix_selection",
    "jn_17_offset_to_block",
    "sc_14_locator_to_offset",
    "prj_1_catalog",
    "prj_6_manifest_chapters",
    "src_5_delta_ingest",
    "src_3_event_ingest",
    "mu_1_progress_upsert",
    "mu_3_bookmark_accept",
    "jn_18_bookmark_overlap",
    "mu_14_asset_transitions",
    "nm_2_block_extraction",
    "nm_13_chapter_titles",
    "nm_14_render_chapters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    registered = spark_queries()
    # One untimed run, so that the first headline is not charged for starting the session.
    registered["ag_4_undirected_edge_fold"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        begin = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
