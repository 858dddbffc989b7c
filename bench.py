"""Time the headline queries: prints one JSON line.

Each query runs once on the smallest folder first, so that the timed run measures the
work on the data rather than code generation, and its result is written to the
``noop`` sink so that every column is computed.
"""

from __future__ import annotations

import json
import os
import time

from courtside.plans import registry
from courtside.session import get_session

HEADLINE = (
    "standings", "player_team_seasons", "player_seasons", "player_career_totals", "team_seasons", "player_records",
    "rank_by_metric", "team_history_ranking", "player_games", "recent_games_of_all_players", "head_to_head", "text_search",
    "slugify", "boxscore_status", "key_diff", "resolve_player", "merge_games", "page_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    spark = get_session("bench", **{
        "spark__master": f"local[{cpus}]", "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name, where: queries[name](spark, where).write.format("noop").mode("overwrite").save()
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        if os.path.isdir(small):
            run(name, small)
        start = time.perf_counter()
        run(name, folder)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
