"""Summarise a Spark event log: the slowest stages with task counts, shuffle and spill bytes.

Usage: python tools/stage_times.py <event-log-file-or-dir> [top_n]
"""

from __future__ import annotations

import io
import json
import os
import sys


def _lines(fname: str):
    if fname.endswith(".zstd"):
        import zstandard
        with open(fname, "rb") as fh:
            reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            yield from reader
    else:
        with open(fname) as fh:
            yield from fh


def stages(path: str):
    files = ([os.path.join(d, f) for d, _, fs in os.walk(path) for f in sorted(fs) if f.startswith("events_")
              or f.startswith("local-") or f.startswith("app-")] if os.path.isdir(path) else [path])
    for fname in files:
        for line in _lines(fname):
            if True:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerStageCompleted":
                    continue
                info = ev["Stage Info"]
                acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
                yield {
                    "stage": info["Stage ID"], "name": info["Stage Name"][:60], "tasks": info["Number of Tasks"],
                    "ms": (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0),
                    "shuffle_read": int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                    + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0),
                    "shuffle_write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                    "spill": int(acc.get("internal.metrics.diskBytesSpilled", 0) or 0),
                }


def main(argv):
    top = int(argv[2]) if len(argv) > 2 else 15
    rows = sorted(stages(argv[1]), key=lambda r: -r["ms"])[:top]
    print(f"{'stage':>6} {'ms':>7} {'tasks':>5} {'shuf_rd':>10} {'shuf_wr':>10} {'spill':>8}  name")
    for r in rows:
        print(f"{r['stage']:>6} {r['ms']:>7} {r['tasks']:>5} {r['shuffle_read']:>10} {r['shuffle_write']:>10} "
              f"{r['spill']:>8}  {r['name']}")


if __name__ == "__main__":
    main(sys.argv)
