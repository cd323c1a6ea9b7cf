"""Stage times from a Spark event log (written by BENCH_EVENT_LOG=<dir>).
Usage: python scripts/stage_times.py <event log file or folder> [top_n]"""

from __future__ import annotations

import io
import json
import os
import sys


def _lines(path):
    """Lines of an event log: a file or a rolling-log folder, plain or zstd."""
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("events_")]
             if os.path.isdir(path) else [path])
    for name in files:
        if name.endswith(".zstd"):
            import zstandard
            with open(name, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(name) as f:
                yield from f


def main(argv):
    path, top = argv[1], int(argv[2]) if len(argv) > 2 else 20
    stages = []
    for line in _lines(path):
        e = json.loads(line)
        if e.get("Event") == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            start, end = info.get("Submission Time"), info.get("Completion Time")
            if start and end:
                stages.append((end - start, info["Stage ID"], info["Stage Name"][:60], info["Number of Tasks"]))
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.1f} s in total")
    for ms, sid, name, tasks in stages[:top]:
        print(f"{ms / 1000:8.2f} s  stage {sid:5d}  tasks {tasks:5d}  {name}")


if __name__ == "__main__":
    main(sys.argv)
