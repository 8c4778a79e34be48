"""Job durations from a Spark event log (no UI needed).

    BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tools/job_times.py /tmp/run-XXXXXX [min_ms]

Prints, per job group (bench query), the number of jobs, their summed
duration and the slowest jobs with their call sites.
"""

from __future__ import annotations

import glob
import io
import json
import sys
from collections import defaultdict


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    root = sys.argv[1]
    min_ms = int(sys.argv[2]) if len(sys.argv) > 2 else 200
    files = sorted(glob.glob(f"{root}/**/events_*", recursive=True)) or sorted(glob.glob(f"{root}/*"))
    jobs: dict[int, list] = {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                infos = e.get("Stage Infos", [])
                name = infos[-1].get("Stage Name", "") if infos else ""
                group = e.get("Properties", {}).get("spark.jobGroup.id", "")
                jobs[e["Job ID"]] = [e["Submission Time"], None, name, group]
            elif e["Event"] == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]][1] = e["Completion Time"]
    by_group = defaultdict(list)
    for jid, (start, end, name, group) in jobs.items():
        if end is not None:
            by_group[group].append((end - start, jid, name))
    for group, items in by_group.items():
        print(f"[{group or '-'}] jobs={len(items)} sum_ms={sum(d for d, _, _ in items)}")
        for d, jid, name in sorted(items, reverse=True):
            if d >= min_ms:
                print(f"    {d:7d} ms  job {jid:5d}  {name[:100]}")


if __name__ == "__main__":
    main()
