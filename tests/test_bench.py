"""bench.py prints one JSON line with the fields the driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    p = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "items_bbox", "cdc_diff"],
                       capture_output=True, text=True, env=env, timeout=600)
    lines = [line for line in p.stdout.splitlines() if line.strip()]
    assert p.returncode == 0 and len(lines) == 1, p.stderr[-2000:]
    out = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(out)
    assert out["unit"] == "sec" and out["sf"] == "0.001" and set(out["queries"]) == {"items_bbox", "cdc_diff"}
    assert not out["errors"]
