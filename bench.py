"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sightline.plans import experiment, registry  # noqa: E402
from sightline.session import local_session  # noqa: E402
from sightline.sources import market  # noqa: E402

#: One query of each kind; the first is the whole rotation pipeline of the reference's published cold build.
HEADLINE = (
    "momentum_top1", "feat_stock6", "feat_kbar", "feat_rolling13", "feat_extensions", "cs_zscore_members", "cs_rank_average", "cs_winsorize", "price_anchor_adjust", "asof_latest_visible", "label_normalized", "signal_weighted_blend",
    "feat_rolling_all", "feat_extensions_daily", "rotation_daily20", "ic_summary", "rank_ic_daily", "coverage_by_session", "quantile_groups", "folds_periodic", "stream_tumbling",
)


def rotation_builds(spark, sf: str) -> dict[str, float]:
    """The rotation build over 20 sessions, published: cold, and again with the same content, and again with a snapshot that is trusted."""
    prices = market.daily_panel(spark, sf)
    times = {}
    with tempfile.TemporaryDirectory() as root:
        for name, trusted in (("build_rotation_cold", False), ("build_rotation_again", False), ("build_rotation_trusted_first", True), ("build_rotation_trusted_again", True)):
            began = time.perf_counter()
            for built in experiment.build_rotation(spark, root, "bench@1", prices, registry.daily_factors(prices), trusted=trusted):
                built.read(spark).count()
            times[name] = round(time.perf_counter() - began, 3)
    del times["build_rotation_trusted_first"]
    return times


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    registry.QUERIES["momentum_top1"](spark, sf).write.format("noop").mode("overwrite").save()  # compiles and warms the reader
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    times |= rotation_builds(spark, sf)
    print(json.dumps({"metric": "panel_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
