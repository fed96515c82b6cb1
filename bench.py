"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from engramlake.registry import QUERIES  # noqa: E402
from engramlake.session import build_session  # noqa: E402

HEADLINE = (
    "src2_read_captures",
    "flt2_metadata_filter",
    "sen1_scan_sensitive",
    "reg4_route_by_cwd",
    "cap2_assign_turns",
    "cap3_dedup_events",
    "cap5_build_rounds",
    "cap9_bounded_retention",
    "pro4_claim_conflicts",
    "gov1_apply_mutations",
    "gov2_version_chains",
    "gov9_list_memories",
    "ret2_build_text_index",
    "ret3_bm25_search",
    "ret4_vector_search",
    "ret8_fuse",
    "ret11_graph_expand",
    "ret13_truncate_to_budget",
    "ret14_pack_context",
    "grf3_delete_nodes",
    "ent7_aggregate_supports",
    "ent11_rank_entities",
    "ent12_neighborhood",
    "ent16_display_state",
    "idx1_find_drift",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "engramlake-bench",
        f"local[{cpus}]",
        **{
            "spark__sql__shuffle__partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark__engramlake__spreadTables": cpus if cpus.isdigit() else "8",
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            "spark__driver__memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = Path(path).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
