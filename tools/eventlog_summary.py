"""Summarise a Spark event log per job group (bench.py sets one per query).

usage: BENCH_EVENTLOG_DIR=/tmp/run-x/events python bench.py
       python tools/eventlog_summary.py /tmp/run-x/events
Per query (timed runs only): jobs, stages, summed task time, shuffle write
bytes (per run), the largest single-task shuffle read (a skew signal).
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys


def lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    d = sys.argv[1]
    files = [f for f in glob.glob(os.path.join(d, "**", "*"), recursive=True)
             if os.path.isfile(f) and os.path.basename(f).startswith(("events_", "local-", "app-"))]
    job_group: dict[int, str] = {}
    stage_job: dict[int, int] = {}
    agg = collections.defaultdict(lambda: collections.Counter())
    max_read = collections.defaultdict(int)
    for path in files:
        if True:
            for line in lines(path):
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    if g and not g.startswith("warmup:"):
                        job_group[e["Job ID"]] = g
                        agg[g]["jobs"] += 1
                        for sid in e.get("Stage IDs", []):
                            stage_job[sid] = e["Job ID"]
                elif ev == "SparkListenerTaskEnd":
                    job = stage_job.get(e.get("Stage ID"))
                    g = job_group.get(job)
                    if g is None:
                        continue
                    m = e.get("Task Metrics") or {}
                    agg[g]["task_ms"] += m.get("Executor Run Time", 0)
                    agg[g]["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    r = m.get("Shuffle Read Metrics") or {}
                    read = r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                    agg[g]["shuffle_read_bytes"] += read
                    max_read[g] = max(max_read[g], read)
                elif ev == "SparkListenerStageCompleted":
                    sid = e["Stage Info"]["Stage ID"]
                    g = job_group.get(stage_job.get(sid))
                    if g is not None:
                        agg[g]["stages"] += 1
    print("| query | jobs | stages | task s | shuffle write MB | max task shuffle read MB |")
    print("|---|---|---|---|---|---|")
    for g in sorted(agg):
        a = agg[g]
        print(f"| {g} | {a['jobs']} | {a['stages']} | {a['task_ms'] / 1000:.2f} | "
              f"{a['shuffle_write_bytes'] / 1e6:.2f} | {max_read[g] / 1e6:.2f} |")


if __name__ == "__main__":
    main()
