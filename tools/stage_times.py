"""Stage timings from a Spark event log (no UI needed).

Usage: python tools/stage_times.py <event-log dir or file> [--top N]

Run a job with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir``
pointing at a scratch folder (``bench.py`` does this when
``BENCH_EVENT_LOG`` is set), then point this at that folder. Prints one
line per completed stage: start offset, duration, task count, name.
"""

from __future__ import annotations

import io
import json
import os
import sys


def _files(path: str):
    if os.path.isfile(path):
        yield path
        return
    for root, _, files in os.walk(path):
        for f in sorted(files):
            if not f.startswith(".") and "appstatus" not in f:
                yield os.path.join(root, f)


def _lines(f: str):
    raw = open(f, "rb").read()
    if f.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    elif f.endswith(".lz4") or f.endswith(".snappy"):
        raise SystemExit(f"unsupported codec for {f}; set spark.eventLog.compression.codec=zstd")
    return raw.decode().splitlines()


def stages(path: str) -> list[tuple[int, float, float, int, str]]:
    out = {}
    for f in _files(path):
        for line in _lines(f):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                out[si["Stage ID"]] = (si["Stage ID"], si["Submission Time"] / 1000,
                                       (si["Completion Time"] - si["Submission Time"]) / 1000,
                                       si["Number of Tasks"], si["Stage Name"])
    return sorted(out.values(), key=lambda r: r[1])


def main(argv: list[str]) -> None:
    rows = stages(argv[1])
    top = int(argv[argv.index("--top") + 1]) if "--top" in argv else None
    if not rows:
        print("no completed stages found")
        return
    t0 = rows[0][1]
    shown = sorted(rows, key=lambda r: -r[2])[:top] if top else rows
    for sid, sub, dur, ntask, name in shown:
        print(f"stage {sid:5d}  t+{sub - t0:8.2f}s  {dur:7.2f}s  tasks={ntask:5d}  {name[:70]}")


if __name__ == "__main__":
    main(sys.argv)
