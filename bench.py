"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
The entity and request tables are first derived from the driver's parquet
and stored once as Parquet (``prepare_sec``, not part of the value); then
each query runs in full on the stored tables with the ``noop`` sink (every
row computed, nothing brought to the driver). The rows are counted on the way;
a job that must give a row per request or row of a table is checked against
that table's count. The value is the sum of the query times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dashboard", "status_counts", "calendar", "calendar_grid", "recent_items", "list_tasks",
    "comments_with_author", "content_detail", "default_workspace", "access_check",
    "task_ref_check", "cross_tenant_refs", "orphans", "dup_keys", "null_violations",
    "create_content", "update_content_state", "write_tasks", "write_clients",
    "apply_transitions", "replay_transitions", "claim_invites", "ordered", "cascade_delete",
]

# query -> table that it must return a row for, each
ROW_PER = {
    "create_content": "content_drafts", "write_tasks": "task_requests", "write_clients": "client_requests",
    "apply_transitions": "transition_requests", "replay_transitions": "transition_requests",
    "claim_invites": "claims", "access_check": "access_requests", "ordered": "tasks",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    import uuid

    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from slatework.plans import catalog  # noqa: F401  (fills the registry)
    from slatework.plans.registry import BODIES
    from slatework.session import ensure_checkpoint_dir, local_session
    from slatework.sources.fixtures import Fixtures

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # The entity tables are derived from the driver's parquet once and stored
    # as Parquet (what a production user has); the operators are then timed
    # on those stored tables.
    t0 = time.perf_counter()
    fx = Fixtures(spark, sf_dir)
    needed = sorted({u for n in names for u in BODIES[n][1]})
    fx.store(f"{ensure_checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}", needed)
    prepare = round(time.perf_counter() - t0, 3)
    BODIES["status_counts"][0](fx).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    times, rows = {}, {}
    for name in names:
        seen = Observation()
        t0 = time.perf_counter()
        df = BODIES[name][0](fx).observe(seen, F.count(F.lit(1)).alias("rows"))
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = seen.get["rows"]
    wrong = {n: (rows[n], want) for n in names if n in ROW_PER and rows[n] != (want := fx[ROW_PER[n]].count())}
    if wrong:
        raise SystemExit(f"rows and rows expected: {wrong}")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "prepare_sec": prepare,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
