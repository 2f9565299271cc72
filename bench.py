"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tissuelake import catalog
from tissuelake.session import local_session

llm_queries = None
if (found := find_spec("tissuelake.llm")) is not None and found.origin is not None:
    from tissuelake.llm import queries as llm_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Of the engine's own operators, one or two of each kind; of the others all.
HEADLINE = ["mean_pool", "meanmax_pool", "attention_pool", "farthest_from_mean", "cosine_to_ref", "mpp_level_plan", "grid_axis_count", "cell_tissue_fraction", "qc_patch_scores", "patch_chunk_overlap", "otsu_threshold", "stain_covariance", "channelwise_unit", "artifact_burden", "best_patch_per_class", "latest_receipt", "missing_models", "complete_models", "conformance_violations", "compare_stores", "slide_id_from_source", "trident_rows", "geojson_lines"]


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, "12g")
    queries = {n: catalog.queries()[n] for n in HEADLINE}
    if llm_queries is not None:
        queries |= llm_queries.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't timed
    seconds: dict[str, float] = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
