"""Summarise stage and task durations from a Spark event log folder.

Usage: python tools/stage_times.py <eventlog dir or file>
"""

import glob
import io
import json
import os
import sys

import zstandard


def lines(path):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        yield from raw.decode().splitlines()


def main():
    stages, tasks = {}, {}
    for line in lines(sys.argv[1]):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"][:40], si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0))
        elif e["Event"] == "SparkListenerTaskEnd":
            ti = e["Task Info"]
            tasks.setdefault(e["Stage ID"], []).append(ti["Finish Time"] - ti["Launch Time"])
    for k, (name, n, ms) in sorted(stages.items()):
        t = tasks.get(k, [0])
        print(f"stage {k:3d} {name:40s} tasks={n:4d} wall={ms:6d}ms max_task={max(t):6d}ms sum={sum(t):7d}ms")


if __name__ == "__main__":
    main()
